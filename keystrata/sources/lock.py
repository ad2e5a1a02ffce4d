"""One process owns a directory."""

from __future__ import annotations

import fcntl
import os
from collections.abc import Iterable

from keystrata.errors import DirectoryLocked

_HELD: set[str] = set()


class DirectoryLocks:
    """Locks on distinct directories, taken in order of their real paths."""

    def __init__(self, folders: Iterable[str]):
        self._files: list[tuple[str, object]] = []
        try:
            for folder in sorted({os.path.realpath(f) for f in folders}):
                os.makedirs(folder, exist_ok=True)
                if folder in _HELD:
                    raise DirectoryLocked(folder)
                f = open(os.path.join(folder, ".lock"), "w")
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except OSError as e:
                    f.close()
                    raise DirectoryLocked(folder) from e
                _HELD.add(folder)
                self._files.append((folder, f))
        except DirectoryLocked:
            self.release()
            raise

    def release(self) -> None:
        while self._files:
            folder, f = self._files.pop()
            f.close()
            _HELD.discard(folder)
