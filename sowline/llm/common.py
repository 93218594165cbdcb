"""Helpers shared by the training-data operators: whole-text tokenising on
Arrow arrays, bounded slices of a batch, blocks of documents, stored tables."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sowline.session import checkpoint_dir

# Bytes of text that a Python task turns into word arrays at a time.
SLICE_BYTES = 4 << 20
# Documents of one block (see with_block).
BLOCK_DOCS = 2048
# Bytes of the results that a Python worker remembers (see Memo).
MEMO_BYTES = 96 << 20
# A NULL document id sorts after every other id.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan ``{base}/{name}.parquet`` (one file or a folder)."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/sowline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


def discarded(df: DataFrame) -> None:
    """Delete the folder of a ``stored`` table that nothing reads any more."""
    path = _FOLDERS.pop(df, None)
    if path:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what the last one held goes back to the system before the
    next one comes, and at the end of the task."""
    pool = pa.default_memory_pool()
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()
    pool.release_unused()


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` whose ``column`` holds ``limit``
    bytes at most (or a single longer text)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def words_of(texts) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text (NULL: none).

    Returns ``(offsets, words)``: the words of text i are
    ``words[offsets[i]:offsets[i + 1]]``.
    """
    texts = pc.fill_null(_array(texts), "")
    texts = texts.cast(pa.large_string())
    lists = _array(pc.ascii_split_whitespace(texts))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if full.all():
        return offsets, flat
    kept = np.concatenate([[0], np.cumsum(full)])
    return kept[offsets], flat.filter(pa.array(full))


def word_ids(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``(ids, distinct)``: the words as numbers into their distinct values."""
    coded = _array(words.dictionary_encode())
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def with_block(docs: DataFrame, key: str, size: int = BLOCK_DOCS) -> DataFrame:
    """Add ``block``: rows dealt by a hash of ``key`` and text into blocks of
    about ``size`` documents.

    A block is the unit that one Python call works on; per-block results are
    aggregated inside the block before any shuffle, so a word or passage that
    a third of all documents hold counts once per block.
    """
    n = max(1, -(-docs.count() // size))
    return docs.withColumn("block", F.pmod(F.xxhash64(key, "text"), F.lit(n)).cast("long"))


class Memo:
    """Results by text, bounded in bytes: the newest half and the half before
    it.  Long texts hardly come again and are not kept."""

    COST = 200              # of an entry beside its key and value
    LONGEST = 64

    def __init__(self, limit: int = MEMO_BYTES):
        self.half, self.size = limit // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) > self.LONGEST:
            return
        if self.size >= self.half:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += self.COST + len(key) + len(value)
