"""Token ids of documents in raw binary shards with a minimal perfect hash index.

A shard is three files. `.ids` holds all its ids one after another, little-endian and unsigned,
two bytes each if the vocabulary allows it and four if not. `.keys` has a JSON string or null a
line, in order of the ids. `.idx` is what keyed access needs, each part at a place that follows
from the header: HEADER; the bits of each level of the perfect hash; then the blocks of all
levels, 512 bits with the number of bits set before them; then for each slot a fingerprint,
the offset in ids and the number of ids. A lookup reads the header once, then one block a level
and one slot, whatever the number of keys.
"""

from __future__ import annotations

import hashlib
import json
import string
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.shared import give_back, new_path, written
from keystrata.llm.words import mix

#: Pieces that a worker keeps ready, in each of two halves, and bits that tell which came before.
READY, SEEN_BITS = 400_000, 25
#: The letters of ASCII and Latin-1, no one of which composes with another or changes its number of letters in lower case; and marks behind words of them.
LETTER = frozenset(c for c in map(chr, range(256)) if c.isalpha() and c not in "\xaa\xb5\xba")
MARKS = string.punctuation
#: Texts that are encoded at once: their pieces stay in a core's cache.
TEXTS = 64
#: Ids that are read at once.
TOGETHER = 1 << 20
#: Bits of a level of the perfect hash for each key that reaches it, and bits of a block.
ROOM, BLOCK = 2, 512
#: Magic, keys, salt, bytes of an id, levels; then the bits of each level.
HEADER, LEVEL = struct.Struct("<8sQQII"), struct.Struct("<Q")
MAGIC = b"tokshard"
BITS = np.dtype([("before", "<u8"), ("bits", "u1", BLOCK // 8)])
SLOT = np.dtype([("mark", "<u4"), ("start", "<u8"), ("n", "<u8")])
#: Names that the file systems of this machine's library have for those of Spark.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


class _Ready(dict):
    """Ids by piece; pieces asked for in vain are noted, and None is given.

    A piece is kept from its second time on, as most pieces come only once. Whether it came
    before is one bit by its hash; a bit set by another piece only keeps one piece more.
    """

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self.older: dict[str, bytes] = {}
        self.new: set[str] = set()
        self.seen = bytearray(1 << SEEN_BITS >> 3)

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.older.get(piece)
        if ids is None:
            self.new.add(piece)
        else:
            self[piece] = ids
        return ids

    def keep(self, made: dict[str, bytes]) -> None:
        seen, mask = self.seen, (1 << SEEN_BITS) - 1
        for piece, ids in made.items():
            at = hash(piece) & mask
            bit = 1 << (at & 7)
            if seen[at >> 3] & bit:
                self[piece] = ids
            else:
                seen[at >> 3] |= bit

    def turn(self) -> None:
        """When full, what is here becomes the older half, and the half before it goes."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
            self.seen = bytearray(len(self.seen))


class Encoder:
    """Ids of whole texts, equal to encoding each text at once.

    The tokenizer drops white space and never joins what stands on both sides of it, so texts
    are cut at spaces and newlines, and each distinct piece is encoded once and kept. The
    tokenizer cuts a piece of Latin-1 letters with ASCII marks behind them between the two; the
    letters are one word to it, whose lower case goes straight to its model with its bytes
    written as the tokenizer's letters. Any other piece takes the tokenizer's whole way.
    """

    def __init__(self, path: str, dtype: str, ready: int | None = None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        self.ready = _Ready(READY if ready is None else ready)
        self.marks: dict[str, bytes] = {}
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: byte_level.pre_tokenize_str(c)[0][0] for c in LETTER if not c.isascii() and c == c.lower()})

    def _plain(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: Iterable[int]) -> bytes:
        out = array(self.dtype.char, ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def _learn(self) -> dict[str, bytes]:
        """The ids of all pieces that were asked for in vain."""
        ready, marks, model = self.ready, self.marks, self.tokenizer.model
        pieces, ready.new = ready.new, set()
        made: dict[str, bytes] = {}
        stems: dict[str, bytes] = {}
        others = []
        for piece in pieces:
            word = piece.rstrip(MARKS)
            plain = word.isascii()
            if not (word.isalpha() if plain else LETTER.issuperset(word)):
                others.append(piece)
                continue
            stem = word.lower()
            ids = stems.get(stem)
            if ids is None:
                ids = ready[stem] or self._packed([t.id for t in model.tokenize(stem if plain else stem.translate(self.letters))])
                stems[stem] = ids
            if len(word) < len(piece):
                mark = piece[len(word) :]
                if mark not in marks:
                    marks[mark] = self._plain(mark)
                ids += marks[mark]
            made[piece] = ids
        if others:
            done = self.tokenizer.encode(others, is_pretokenized=True, add_special_tokens=False)
            ids = self._packed(done.ids)
            owner = np.array(done.word_ids, np.int64)
            cuts = (np.searchsorted(owner, np.arange(len(others) + 1)) * self.dtype.itemsize).tolist()
            made.update((piece, ids[a:b]) for piece, a, b in zip(others, cuts, cuts[1:]))
        ready.new = set()
        ready.keep(stems | made)
        return made

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        self.ready.turn()
        get = self.ready.__getitem__
        split = [text.replace("\n", " ").split(" ") for text in texts]
        found = [list(map(get, pieces)) for pieces in split]
        made = self._learn() if self.ready.new else {}
        for pieces, have in zip(split, found):
            yield b"".join([made[p] if x is None else x for p, x in zip(pieces, have)])


@cache
def _encoder(path: str, dtype: str, ready: int) -> Encoder:
    """One for each worker process, which keeps its pieces from task to task."""
    return Encoder(path, dtype, ready)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit integers by levels of bits without collision.

    On each level every key left takes a place; keys alone in theirs set its bit and are done.
    A key's slot is the number of bits set before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sums = [np.concatenate([[0], np.cumsum(bits)]) for bits in levels]
        before = np.concatenate([[0], np.cumsum([s[-1] for s in sums])]).astype(np.int64)
        self.ranks = [s + b for s, b in zip(sums, before)]
        self.size = int(before[-1])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = -(-len(keys) * ROOM // BLOCK) * BLOCK
            place = cls._place(keys, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(levels)

    def blocks(self) -> np.ndarray:
        """The bits of all levels by block, with the number of bits set before each."""
        parts = []
        for bits, rank in zip(self.levels, self.ranks):
            part = np.empty(len(bits) // BLOCK, BITS)
            part["before"], part["bits"] = rank[:-1:BLOCK], np.packbits(bits).reshape(-1, BLOCK // 8)
            parts.append(part)
        return np.concatenate(parts) if parts else np.empty(0, BITS)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a key that isn't there."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            place = self._place(keys[left], i, len(bits))
            here = bits[place]
            out[left[here]] = self.ranks[i][place[here]]
            left = left[~here]
        return out


def _hashes(keys: Sequence[tuple[str | None, int]], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit integer and a 32-bit fingerprint of each key and its occurrence."""
    raw = b"".join(hashlib.blake2b(repr((k, i, salt)).encode(), digest_size=12).digest() for k, i in keys)
    whole = np.frombuffer(raw, np.dtype([("key", "<u8"), ("mark", "<u4")]))
    return whole["key"].copy(), whole["mark"].copy()


def _numbered(keys: Iterable[str | None]) -> list[tuple[str | None, int]]:
    """Keys with their occurrence; equal keys are neighbours."""
    out, seen, last = [], 0, object()
    for key in keys:
        seen = seen + 1 if key == last else 0
        out.append((key, seen))
        last = key
    return out


def _index(keys: list[str | None], starts: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """The bytes of `.idx`. Equal keys are told apart by occurrence."""
    numbered = _numbered(keys)
    salt = 0
    while len(np.unique((found := _hashes(numbered, salt))[0])) < len(keys):
        salt += 1
    hashed, marks = found
    table = PerfectHash.of(hashed)
    slot = table.slots(hashed)
    by_slot = np.empty(len(keys), SLOT)
    by_slot["mark"][slot], by_slot["start"][slot], by_slot["n"][slot] = marks, starts, counts
    head = HEADER.pack(MAGIC, len(keys), salt, width, len(table.levels)) + b"".join(LEVEL.pack(len(x)) for x in table.levels)
    return head + table.blocks().tobytes() + by_slot.tobytes()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that Spark names, and the path in it.

    Local, S3, HDFS, Google and Azure stores are known, under Spark's names for them, as far as
    this machine's library was built with them; others raise an error that names the scheme.
    """
    scheme, sep, rest = uri.partition("://")
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{sep}{rest}")
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise ValueError(f"token shards can't be written to a {scheme} path; name another folder") from e


class Shard:
    """Keyed reads of a shard: a block a level, a fingerprint and one seek into the ids for each key."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path = fs, path
        self.idx, self.ids = fs.open_input_file(f"{path}.idx"), fs.open_input_file(f"{path}.ids")
        magic, self.n, self.salt, self.width, levels = HEADER.unpack(self.idx.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}.idx isn't an index")
        sizes = [LEVEL.unpack(self.idx.read(LEVEL.size))[0] for _ in range(levels)]
        at = HEADER.size + levels * LEVEL.size
        self.levels = []
        for size in sizes:
            self.levels.append((size, at))
            at += size // BLOCK * BITS.itemsize
        self.slots_at = at

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.idx.close()
        self.ids.close()

    def _read(self, at: int, kind: np.dtype, n: int = 1) -> np.ndarray:
        self.idx.seek(at)
        return np.frombuffer(self.idx.read(kind.itemsize * n), kind)

    def find(self, key: str | None, occurrence: int = 0) -> tuple[int, int] | None:
        """Offset and number of a document's ids; None for a key whose fingerprint isn't there."""
        hashed, mark = _hashes([(key, occurrence)], self.salt)
        for level, (size, at) in enumerate(self.levels):
            block, bit = divmod(int(PerfectHash._place(hashed, level, size)[0]), BLOCK)
            held = self._read(at + block * BITS.itemsize, BITS)[0]
            bits = np.unpackbits(held["bits"])
            if bits[bit]:
                slot = self._read(self.slots_at + (int(held["before"]) + int(bits[:bit].sum())) * SLOT.itemsize, SLOT)[0]
                return (int(slot["start"]), int(slot["n"])) if slot["mark"] == mark[0] else None
        return None

    def read(self, start: int, n: int) -> np.ndarray:
        self.ids.seek(start * self.width)
        return np.frombuffer(self.ids.read(n * self.width), f"<u{self.width}").astype("<u4")

    def get(self, key: str | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document, None for a key that isn't there."""
        found = self.find(key, occurrence)
        return None if found is None else self.read(*found)

    def _table(self) -> tuple[PerfectHash, np.ndarray]:
        """The whole index, for reads of all keys."""
        levels = [np.unpackbits(self._read(at, BITS, size // BLOCK)["bits"].reshape(-1)).astype(bool) for size, at in self.levels]
        return PerfectHash(levels), self._read(self.slots_at, SLOT, self.n)

    def keys(self) -> list[str | None]:
        with self.fs.open_input_file(f"{self.path}.keys") as f:
            return [json.loads(x) for x in f.read().split(b"\n")[:-1]]

    def in_order(self) -> Iterator[tuple[str | None, int, np.ndarray]]:
        """key, start and ids of every document, each found by its key."""
        keys = self.keys()
        hashed, marks = _hashes(_numbered(keys), self.salt)
        table, by_slot = self._table()
        slots = table.slots(hashed)
        if (slots < 0).any() or (by_slot["mark"][slots] != marks).any():
            raise ValueError("a key of the shard isn't in its index")
        starts, counts = by_slot["start"][slots].astype(np.int64), by_slot["n"][slots].astype(np.int64)
        i = 0
        while i < len(slots):
            # Neighbours in the file are read together, up to a bound or one document.
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + TOGETHER)))
            ids = self.read(int(starts[i]), int(starts[j - 1] + counts[j - 1] - starts[i]))
            for n in range(i, j):
                at = int(starts[n] - starts[i])
                yield keys[n], int(starts[n]), ids[at : at + int(counts[n])]
            i = j


def _write_shard(rows: Iterator[pd.DataFrame], folder: str, tokenizer: str, end: int, width: int, ready: int) -> Iterator[pd.DataFrame]:
    fs, base = file_system(folder)
    name = f"{base}/shard-{TaskContext.get().partitionId():06d}"
    draft = f"{name}.{uuid.uuid4().hex}"
    encoder = _encoder(tokenizer, f"<u{width}", ready)
    last = np.array([end], encoder.dtype).tobytes()
    keys: list[str | None] = []
    counts: list[int] = []
    out = None
    for frame in rows:
        if out is None:
            out = fs.open_output_stream(f"{draft}.ids")
        # A few texts at a time, so that memory follows the longest text and not the batch.
        texts, doc_keys = frame["text"].tolist(), frame["doc_key"].tolist()
        for i in range(0, len(texts), TEXTS):
            made = list(encoder.encode([t or "" for t in texts[i : i + TEXTS]]))
            out.write(last.join([*made, b""]))
            keys += doc_keys[i : i + TEXTS]
            counts += [len(ids) // width + 1 for ids in made]
        # Before the next batch comes.
        del frame, texts, doc_keys
    if out is None:
        return
    out.close()
    n = np.array(counts, np.uint64)
    with fs.open_output_stream(f"{draft}.keys") as f:
        for i in range(0, len(keys), 1 << 16):
            f.write(b"".join(json.dumps(k).encode() + b"\n" for k in keys[i : i + (1 << 16)]))
    with fs.open_output_stream(f"{draft}.idx") as f:
        f.write(_index(keys, np.cumsum(n) - n, n, width))
    # A second attempt writes the same bytes; each file appears whole.
    for part in ("ids", "keys", "idx"):
        fs.move(f"{draft}.{part}", f"{name}.{part}")
    yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "path": [name], "n_docs": [len(keys)], "n_ids": [int(n.sum())]})
    del keys, counts, n
    give_back()


def _read_shards(rows: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    # All is written, so the pieces that a worker kept for it can go.
    _encoder.cache_clear()
    give_back()
    fs, _ = file_system(folder)
    for frame in rows:
        for path, before in zip(frame["path"], frame["before"]):
            with Shard(fs, path) as shard:
                found = [(key, before + start, len(ids), zlib.crc32(ids.tobytes())) for key, start, ids in shard.in_order()]
            yield pd.DataFrame(found, columns=["doc_key", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, shards: int | None = None, folder: str | None = None, ready: int = READY) -> tuple[str, DataFrame]:
    """Encode every whole text into shards by ascending key; folder and manifest are returned.

    The manifest has shard, path, n_docs, n_ids and before (ids in all shards before it). Null
    texts are empty, so only the end id stands for them; null keys come first; rows that repeat
    a key are neighbours, in order of their text's hash, and are told apart by occurrence. A
    key on very many rows goes on in the next shard, where its occurrences are counted anew, so
    no shard is larger for it. Texts may be of any length: a few are encoded at a time. An
    empty table gives an empty manifest; further columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else 4
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    parts = shards or max(1, source.rdd.getNumPartitions())
    # The row's place cuts a key, and even equal rows, that would fill a shard.
    tied = source.withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(parts, "k", "h", "at").sortWithinPartitions("k", "h", "at")
    made = written(
        ordered.select(F.col("k").cast("string").alias("doc_key"), "text")
        .mapInPandas(lambda rows: _write_shard(rows, folder, tokenizer, end, width, ready), "shard int, path string, n_docs long, n_ids long"),
        "tokens-manifest",
    )
    before, rows = 0, []
    for row in made.orderBy("shard").collect():  # one row a shard
        rows.append((row["shard"], row["path"], row["n_docs"], row["n_ids"], before))
        before += row["n_ids"]
    return folder, spark.createDataFrame(rows, "shard int, path string, n_docs long, n_ids long, before long")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_key (as string), start, n_tokens and ids_crc32 of every document, from the files."""
    spread = manifest.repartition(max(1, manifest.count())).select("path", "before")
    return spread.mapInPandas(lambda rows: _read_shards(rows, folder), "doc_key string, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, ready: int = READY) -> DataFrame:
    """Write the shards and give each document's place in them, as read back.

    ready: pieces that a worker keeps in each of two halves, about 200 bytes each.
    """
    folder, manifest = write_tokens(docs, tokenizer, key, text, end, ready=ready)
    found = read_tokens(docs.sparkSession, folder, manifest)
    return found.select(F.col("doc_key").cast(docs.schema[key].dataType).alias(key), "start", "n_tokens", "ids_crc32")
