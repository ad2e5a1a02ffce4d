"""Settings of a store."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

MIB = 1 << 20


@dataclass(frozen=True)
class StoreConfig:
    """runs_dir may be any path that Spark writes; log_dir is local to the driver."""

    runs_dir: str
    log_dir: str
    memtable_bytes: int = 16 * MIB
    group_limit: int = 64
    write_retries: int = 10
    l0_trigger: int = 4
    l0_stall: int = 16
    level_multiplier: int = 10
    rotation_bytes: int = 16 * MIB
    rotation_edits: int = 10_000
    auto_compact: bool = True
    #: Flushes and compactions in threads of their own; without them, writers do them in line.
    workers: bool = True
    #: Sealed memtables that may wait for a flush before writers wait, too.
    sealed_limit: int = 2
    #: How long the first of a group of writers waits for others, in milliseconds.
    sync_window_ms: int = 0
    #: Seqs below the newest that compaction leaves readable, and bytes of a row group.
    history_seqs: int = 0
    block_bytes: int = MIB
    #: Decoded blocks of runs that point reads keep in the driver.
    cache_bytes: int = 256 * MIB
    #: Target size of compacted runs and capacity of level 1; from the settings above where None.
    run_bytes: int | None = None
    l1_bytes: int | None = None

    def __post_init__(self) -> None:
        if self.run_bytes is None:
            object.__setattr__(self, "run_bytes", self.memtable_bytes)
        if self.l1_bytes is None:
            object.__setattr__(self, "l1_bytes", self.memtable_bytes * self.l0_trigger)
        for name in ("runs_dir", "log_dir"):
            if not getattr(self, name):
                raise ValueError(f"{name} must be given")
        for f in fields(self):
            value = getattr(self, f.name)
            least = 0 if f.name in ("sync_window_ms", "history_seqs") else 1
            if f.type.startswith("int") and (not isinstance(value, int) or value < least):
                raise ValueError(f"{f.name} must be an integer of at least {least}")
        if self.l0_stall <= self.l0_trigger:
            raise ValueError("l0_stall must be above l0_trigger")

    @classmethod
    def load(cls, path: str) -> StoreConfig:
        """From a JSON file, or a YAML one where a YAML library is installed."""
        with open(path) as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls(**yaml.safe_load(text))
        return cls(**json.loads(text))
