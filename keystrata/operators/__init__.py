"""Stateless operators over versioned tables and run metadata."""
