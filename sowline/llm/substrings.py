"""Substring deduplication with difference-cover anchors.

A window is ``width`` consecutive words.  A word is removed if a window that
covers it also starts in a document with a smaller id.

* Anchors: windows of ``width - PERIOD + 1`` words that start at positions p
  with ``p mod PERIOD`` in ``COVER``.  COVER is a difference cover: for any
  positions i and j some shift d < PERIOD brings both i + d and j + d into it.
  So two equal windows always share an anchor at the same shift, and only 3 of
  7 positions are hashed.
* Documents are dealt into blocks by id.  Inside a block every anchor counts
  once, so a passage that a third of all documents hold is one row a block,
  not one a document.  A window over the anchor's hash tells each block which
  of its anchors two or more documents share.
* Extension: only the windows around a shared anchor, at its shift, are hashed
  in full (96 bits), once a block, with the smallest id that holds them.  The
  smallest id over all blocks goes back to the blocks, which remove words.

Documents are shuffled once, by block, their texts compressed; every other row
is a few numbers.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sowline.llm.common import NO_ID, slices, with_block, word_ids, words_of

WIDTH = 13
BLOCK_DOCS = 6144
LOWEST = -(1 << 63)
PACKED_BYTES = 2 << 20  # compressed bytes of text that are worked on at a time
PERIOD = 7
COVER = (0, 1, 3)       # a difference cover modulo 7
MIXES = np.random.default_rng(7).integers(1 << 63, size=(3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hashes(words: pa.Array) -> np.ndarray:
    ids, distinct = word_ids(words)
    one = np.fromiter(map(xxh64_intdigest, distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    return one[ids]


def _window_hashes(words: np.ndarray, width: int, lane: int, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at ``starts`` (multilinear over word
    hashes, then mixed)."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(width):
        out += (words[starts + k] ^ (words[starts + k] >> np.uint64(29))) * MIXES[lane, k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


class Block:
    """Words of some documents, one after another."""

    def __init__(self, ids: pa.Array, texts: pa.Array, width: int):
        self.ids = np.asarray(pc.fill_null(ids, NO_ID)).astype(np.int64)
        self.offsets, self.words = words_of(texts)
        self.hashes = _word_hashes(self.words)
        self.width = width
        lengths = np.diff(self.offsets)
        n = len(self.hashes)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(n) - self.offsets[:-1][self.row] if n else np.zeros(0, np.int64)
        self.left = lengths[self.row] - self.place if n else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """``(positions, hashes)`` of the anchors."""
        width = self.width - PERIOD + 1
        covered = np.isin(self.place % PERIOD, COVER) & (self.left >= width)
        at = np.flatnonzero(covered)
        return at, _window_hashes(self.hashes, width, 0, at)

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(positions, high, low)`` of the windows that hold one of the
        ``shared`` anchors (sorted hashes)."""
        at, hashes = self.anchors()
        if not len(shared) or not len(at):
            none = np.zeros(0, np.uint64)
            return np.zeros(0, np.int64), none, none
        spot = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
        at = at[shared[spot] == hashes]
        near = np.zeros(len(self.hashes) + 1, dtype=bool)
        for shift in range(PERIOD):
            ok = self.place[at] >= shift
            near[at[ok] - shift] = True
        starts = np.flatnonzero(near[:-1] & (self.left >= self.width))
        return starts, *self.pair(starts)

    def pair(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the windows at ``starts``."""
        return (_window_hashes(self.hashes, self.width, 1, starts),
                _window_hashes(self.hashes, self.width, 2, starts) >> np.uint64(32))


def _per_hash(hashes: list, ids: list, second: list | None = None):
    """Distinct hashes with the smallest and the largest id of each."""
    hashes, ids = np.concatenate(hashes), np.concatenate(ids)
    keys = [ids, hashes] if second is None else [ids, np.concatenate(second), hashes]
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys[1:]], axis=0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1 if len(first) else first
    return [k[first].view(np.int64) for k in reversed(keys[1:])], keys[0][first], keys[0][last]


def _packed(dealt: DataFrame) -> DataFrame:
    """``dealt`` with its texts compressed (NULL as empty)."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=9, write_content_size=True)
        for batch in batches:
            texts = pa.array([press.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts, batch.column("block")], names=["id", "text", "block"])

    return dealt.select("id", "text", "block").mapInArrow(run, "id long, text binary, block long")


def _parts(docs: pa.Table, width: int):
    press = zstandard.ZstdDecompressor()
    for batch in docs.combine_chunks().to_batches():
        for part in slices(batch, "text", PACKED_BYTES):
            texts = pa.array([press.decompress(t) for t in part.column("text").to_pylist()], pa.binary()).cast(pa.large_binary())
            yield part.column("id"), Block(part.column("id"), texts.cast(pa.large_string()), width)


def _anchor_rows(width: int):
    def run(key, docs):
        hashes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, block in _parts(docs, width):
            at, h = block.anchors()
            hashes.append(h)
            ids.append(block.ids[block.row[at]])
        (h,), low, high = _per_hash(hashes, ids)
        return pa.table({"h": h, "holder": 2 * key[0].as_py() + (low < high).astype(np.int64)})
    return run


def _window_rows(width: int):
    def run(key, docs, shared):
        known = np.sort(np.asarray(shared.column("h").combine_chunks()).astype(np.int64).view(np.uint64)) if shared.num_rows else np.zeros(0, np.uint64)
        first, second, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, block in _parts(docs, width) if len(known) else ():
            at, a, b = block.windows(known)
            first.append(a)
            second.append(b)
            ids.append(block.ids[block.row[at]])
        (a, b), low, high = _per_hash(first, ids, second)
        return pa.table({"a": a, "b": b.astype(np.uint32).view(np.int32), "holder": 2 * key[0].as_py() + (low < high).astype(np.int64), "low": low})
    return run


def _kept_rows(width: int):
    def run(key, docs, repeated):
        a, b, least = (np.asarray(repeated.column(c).combine_chunks()).astype(np.int64) if repeated.num_rows else np.zeros(0, np.int64)
                       for c in ("a", "b", "least"))
        b = b & 0xFFFFFFFF
        order = np.lexsort([b, a])
        a, b, least = a[order], b[order], least[order]
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        for ids, block in _parts(docs, width):
            gone = np.zeros(len(block.hashes) + 1, dtype=np.int64)
            if len(a):
                at, x, y = _all_windows(block, a)
                hit = _smaller(a, b, least, x, y, block.ids[block.row[at]])
                np.add.at(gone, at[hit], 1)
                np.add.at(gone, at[hit] + width, -1)
            gone = np.cumsum(gone)[:-1] > 0
            stay = block.words.filter(pa.array(~gone))
            left = np.concatenate([[0], np.cumsum(~gone)])[block.offsets]
            lists = pa.LargeListArray.from_arrays(pa.array(left), stay)
            out["doc_id"].append(ids)
            out["n_words"].append(pa.array(np.diff(block.offsets)))
            out["n_removed"].append(pa.array(np.diff(block.offsets) - np.diff(left)))
            out["kept"].append(pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()))
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
        return pa.table({k: pa.chunked_array(v, type=types[k]) for k, v in out.items()})
    return run


def _all_windows(block: Block, high: np.ndarray):
    """Windows whose first hash is among the sorted ``high`` values."""
    starts = np.flatnonzero(block.left >= block.width)
    x = _window_hashes(block.hashes, block.width, 1, starts).view(np.int64)
    known = high[np.minimum(np.searchsorted(high, x), len(high) - 1)] == x
    starts = starts[known]
    x, y = block.pair(starts)
    return starts, x.view(np.int64), y.view(np.int64)


def _smaller(a, b, least, x, y, ids) -> np.ndarray:
    """Whether the table (a, b) -> least, sorted by a then b, holds (x, y) with
    a smaller id than ``ids``."""
    spot, end = np.searchsorted(a, x), np.searchsorted(a, x, side="right")
    hit = np.zeros(len(x), dtype=bool)
    while (open_ := spot < end).any():      # more than one step only if two windows share their first 64 bits
        at = np.where(open_, spot, 0)
        hit |= open_ & (b[at] == y) & (least[at] < ids)
        spot = spot + 1
    return hit


def deduplicated(docs: DataFrame, width: int = WIDTH, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every row: ``kept`` are the
    words that stay, joined by one space.

    Windows are judged on the input.  NULL and blank texts have no words, texts
    of fewer than ``width`` words lose none.  A NULL doc_id counts as larger
    than any other; rows of one id never remove each other's words.
    """
    if not width >= PERIOD:
        raise ValueError(f"windows have {PERIOD} words at least")
    dealt = _packed(with_block(docs.select(F.col("doc_id").alias("id"), "text"), "id", block_docs))
    blocks = lambda: dealt.groupBy("block")
    # holder: the block's number twice, plus 1 if two or more of its documents hold the hash
    anchors = blocks().applyInArrow(_anchor_rows(width), "h long, holder long")
    several = F.col("holder") % 2 == 1
    block = F.shiftright("holder", 1).alias("block")
    shared = (anchors.select("h", "holder", (several | (F.count("*").over(Window.partitionBy("h")) > 1)).alias("shared"))
              .where("shared").select("h", block))
    windows = blocks().cogroup(shared.groupBy("block")).applyInArrow(_window_rows(width), "a long, b int, holder long, low long")
    repeated = (windows.select("a", "b", "holder", "low", F.min("low").over(Window.partitionBy("a", "b")).alias("least"))
                .where(several | (F.col("low") > F.col("least")))
                # the one document of a block without "several" is not the least: any value below its id does
                .select("a", "b", block, F.when(several, F.col("least")).otherwise(LOWEST).alias("least")))
    return blocks().cogroup(repeated.groupBy("block")).applyInArrow(
        _kept_rows(width), "doc_id long, n_words long, n_removed long, kept string")
