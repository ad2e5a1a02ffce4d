"""Errors of the store. retriable: the caller may simply try again."""

from __future__ import annotations

from collections.abc import Sequence


class StoreError(Exception):
    retriable = False


class StoreClosed(StoreError):
    """The store is closed: neither reads nor writes."""


class StorePoisoned(StoreError):
    """A write failed half-way: reads go on, writes don't."""


class TxConflict(StoreError):
    """Another transaction committed one of the keys after this one's snapshot."""

    retriable = True

    def __init__(self, keys: list[bytes]):
        super().__init__(f"{len(keys)} keys were committed after the snapshot")
        self.keys = keys


class TxFinished(StoreError):
    """The transaction was committed or rolled back before."""

    def __init__(self, op: str):
        super().__init__(f"{op} on a finished transaction")
        self.op = op


class DirectoryLocked(StoreError):
    """Another process owns the directory."""


class Corrupt(StoreError):
    """A checksum or a format doesn't hold. before: what was read up to the damage."""

    def __init__(self, message: str, before: Sequence[object] = ()):
        super().__init__(message)
        self.before = list(before)


class SnapshotCollected(StoreError):
    """The snapshot lies below what compaction keeps."""

    def __init__(self, seq: int, floor: int):
        super().__init__(f"versions below {floor} were collected, {seq} can't be read")
        self.seq, self.floor = seq, floor


class UnsupportedVersion(StoreError):
    """Written by a format that this version doesn't know."""
