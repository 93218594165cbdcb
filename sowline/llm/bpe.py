"""Byte-level BPE in two tiers.

Texts are cut into pre-tokens by the vocabulary's pattern.  A pre-token whose
bytes are a vocabulary entry is resolved by a minimal perfect hash (hash and
displace: one displacement per bucket sends every entry to a slot of its own,
and as many slots as entries).  Any other pre-token starts as single bytes in
a doubly linked list; a heap yields the adjacent pair of lowest rank, leftmost
first, until no pair is in the vocabulary.

The ranks file is read once on the driver and shipped to the tasks; it must
have at most ``MAX_ENTRIES`` entries.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from sowline.llm.common import Memo, freed, slices

MAX_ENTRIES = 1 << 20
PAIRS = 1 << 18             # symbol pairs whose rank a Python worker remembers
BUCKET = 4                  # entries per bucket of the perfect hash, on average
MIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """``(bytes, rank)`` of a ranks file: base64 and number on each line."""
    with open(path, "rb") as f:
        ranks = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
    if not 0 < len(ranks) <= MAX_ENTRIES:
        raise ValueError(f"{path}: {len(ranks)} entries; 1 to {MAX_ENTRIES} are allowed")
    return ranks


def _slot(h: int, displacement: int, n: int) -> int:
    x = (h ^ (displacement * MIX)) & MASK
    x = ((x ^ (x >> 31)) * MIX) & MASK
    return (x ^ (x >> 29)) % n


class PerfectHash:
    """Minimal perfect hash of byte strings to their numbers."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        self.n = len(entries)
        self.buckets = -(-self.n // BUCKET)
        self.displacements = [0] * self.buckets
        self.keys: list = [None] * self.n
        self.values = [0] * self.n
        groups: list[list] = [[] for _ in range(self.buckets)]
        for key, value in entries:
            h = xxh64_intdigest(key)
            groups[h % self.buckets].append((h, key, value))
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            d = 0
            while groups[b]:
                slots = [_slot(h, d, self.n) for h, _, _ in groups[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.displacements[b] = d
            if groups[b]:
                for s, (_, key, value) in zip(slots, groups[b]):
                    self.keys[s], self.values[s] = key, value

    def get(self, key: bytes) -> int | None:
        h = xxh64_intdigest(key)
        s = _slot(h, self.displacements[h % self.buckets], self.n)
        return self.values[s] if self.keys[s] == key else None


class Codec:
    """Encoder and decoder over a perfect hash of the ranks and a pattern."""

    def __init__(self, whole: PerfectHash, pattern: str):
        self.whole = whole
        self.pattern = regex.compile(pattern)
        self.bytes_of = dict(zip(whole.values, whole.keys))
        self.single = [whole.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs: dict[tuple[int, int], int] = {}     # rank of two adjacent symbols, -1 for none
        self.memo = Memo()                              # encoded pre-tokens

    def _rank(self, pair: tuple[int, int]) -> int:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        r = self.whole.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])
        self.pairs[pair] = r = -1 if r is None else r
        return r

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token that is no entry itself.  A heap item is
        ``rank << 32 | position``; it holds if the pair at that position still
        has that rank."""
        known, rank = self.pairs.get, self._rank
        ids: list = [self.single[b] for b in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i, pair in enumerate(zip(ids, ids[1:])):
            if (r := known(pair)) is None:
                r = rank(pair)
            if r >= 0:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            item = pop(heap)
            r, i = item >> 32, item & 0xFFFFFFFF
            j = after[i]
            if ids[i] is None or j >= n:
                continue
            pair = (ids[i], ids[j])
            if (s := known(pair)) is None:
                s = rank(pair)
            if s != r:
                continue                    # one of the two has been merged since
            ids[i], ids[j] = r, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = (r, ids[k])
                if (s := known(pair)) is None:
                    s = rank(pair)
                if s >= 0:
                    push(heap, s << 32 | i)
            h = before[i]
            if h >= 0:
                pair = (ids[h], r)
                if (s := known(pair)) is None:
                    s = rank(pair)
                if s >= 0:
                    push(heap, s << 32 | h)
        return [x for x in ids if x is not None]

    def piece(self, token: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit numbers."""
        out = self.memo.old.get(token)
        if out is None:
            data = token.encode()
            whole = self.whole.get(data)
            ids = [whole] if whole is not None else self.merge(data)
            out = struct.pack(f"<{len(ids)}I", *ids)
        self.memo.put(token, out)
        return out

    def encode(self, text: str) -> bytes:
        piece, memo = self.piece, self.memo
        return b"".join([memo.young.get(t) or piece(t) for t in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(key: tuple[str, str], whole) -> Codec:
    """One codec a worker process, whatever the number of tasks."""
    if key not in _CODECS:
        _CODECS[key] = Codec(whole.value, key[1])
    return _CODECS[key]


def _shipped(spark, path: str, pattern: str):
    """The perfect hash, built once; its size is bounded by MAX_ENTRIES."""
    ranks = read_ranks(path)
    digest = hashlib.sha256(repr(ranks).encode()).hexdigest()
    return spark.sparkContext.broadcast(PerfectHash(ranks)), (digest, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``n_tokens`` and ``ids`` (binary, little-endian
    unsigned 32-bit) of every whole text; NULL and empty texts have none.
    Special tokens are ordinary text."""
    shipped, key = _shipped(docs.sparkSession, path, pattern)
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shipped)
        for whole in freed(batches):
            for batch in slices(whole, "_text"):
                ids = [codec.encode(t or "") for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                                  pa.array(ids, pa.binary())], names=[*keep, "n_tokens", "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` plus ``decoded`` (binary): the bytes of its ids."""
    shipped, key = _shipped(encoded.sparkSession, path, pattern)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shipped)
        for whole in freed(batches):
            for batch in slices(whole, ids):
                out = pa.array([codec.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
