"""Hashes of words and shingles over raw UTF-8 bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
#: Bytes handled at once; longer texts are cut between words, so memory doesn't follow the text.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * _FOLD
    x = x ^ (x >> np.uint64(29))
    x = x * _STEP
    return x ^ (x >> np.uint64(32))


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and first byte of each word of lower-cased data."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, np.uint64), first
    size = last - first
    letters = raw[inside]
    starts = np.cumsum(size) - size
    powers = np.multiply.accumulate(np.full(int(size.max()), _STEP, np.uint64))
    place = np.arange(len(letters)) - np.repeat(starts, size)
    hashed = np.add.reduceat(_BYTE[letters] * powers[place], starts)
    return mix(hashed + size.astype(np.uint64) * _FOLD), first


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, A-Z lower-cased, cut at ASCII white space."""
    group: list[bytes] = []
    held = 0

    def of_group() -> Iterator[np.ndarray]:
        hashes, first = _hash_words(b"\n".join(group))
        ends = np.cumsum([len(x) + 1 for x in group])
        cuts = [0, *np.searchsorted(first, ends).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield hashes[a:b]

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held + len(data) > PIECE and group:
            yield from of_group()
            group, held = [], 0
        if len(data) <= PIECE:
            group.append(data)
            held += len(data) + 1
            continue
        parts, at = [], 0
        while at < len(data):
            end = at + PIECE
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            parts.append(_hash_words(data[at:end])[0])
            at = end
        yield np.concatenate(parts)
    if group:
        yield from of_group()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words as one if there are fewer."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    rolled = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        rolled = rolled * _STEP + words[i : n - width + 1 + i]
    return np.unique(mix(rolled + np.uint64(width)))
