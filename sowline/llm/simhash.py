"""SimHash near-duplicates by generalised pigeonhole.

A document's fingerprint holds, per bit, the majority of its shingles'
XXH64 bits.  Distinct fingerprints are linked when they differ in at most
``max_bits`` bits:

1. Bits are grouped into partitions so that correlated bits share one.  The
   correlations come from bit and bit-pair counts over all fingerprints
   (64 x 64 sums, whatever the corpus).
2. Every partition i gets its own threshold t_i >= -1 with
   ``sum(t_i + 1) = max_bits + 1``: two fingerprints within ``max_bits``
   differ in at most t_i bits of some partition i.  A dynamic program picks
   the thresholds, and the number of partitions, of least estimated work.
3. Every fingerprint probes the values within t_i bits of its own in each
   partition with t_i >= 0; full distances are checked inside the join.

A partition value that more than ``hot`` fingerprints hold is not joined pair
by pair.  Its fingerprints, and those that probe it, are linked through their
one-bit neighbours instead: two fingerprints differ in at most 2k bits exactly
if they share a point within k bits of both.  That is 65 rows a fingerprint
for k = 1, and a point is shared by at most 65 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sowline.llm.common import freed, slices, stored, unused, words_of
from sowline.llm.components import components
from sowline.operators.skew import split_lookup

BITS = 64
SEED = 42
SMALL = 500_000            # pairs of id and hash that may be broadcast
CHUNK = 1 << 15            # shingles whose bits are unpacked at a time
# Rough work of one probed value against one candidate pair, for the estimate.
PROBE_COST, PAIR_COST = 1.0, 0.2


def _majority(data: bytes, ends: np.ndarray, starts: np.ndarray) -> int:
    counts = np.zeros(BITS, dtype=np.int64)
    n = len(starts)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())
        hashes = np.array([xxh64_intdigest(data[s:e], SEED) for s, e in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        whole = len(bits) // 255 * 255      # sums of 255 bits fit a byte
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(texts: pa.Array, shingle: int) -> np.ndarray:
    """64-bit fingerprints (as signed numbers) of whole texts."""
    offsets, words = words_of(pc.ascii_lower(texts))
    sizes = np.asarray(pc.binary_length(words)).astype(np.int64)
    data = " ".join(words.to_pylist()).encode()
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b > a:
            k = min(shingle, b - a)
            out[i] = _majority(data, ends[a + k - 1:b], starts[a:b - k + 1])
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``fp`` (bigint) of every row's whole ``text``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer
    than ``shingle`` words has its whole sequence as one shingle; NULL, empty
    and blank texts have fingerprint 0.
    """
    rows = docs.select(*[F.col(k) for k in keep], F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in freed(batches):
            for batch in slices(whole, "_text"):
                fp = pa.array(fingerprint(batch.column("_text"), shingle))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), fp], names=[*keep, "fp"])

    return rows.mapInArrow(run, schema)


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = np.asarray(batch.column(0)).astype("<i8")
            for at in range(0, len(values), CHUNK):
                part = np.unpackbits(values[at:at + CHUNK].view(np.uint8), bitorder="little")
                part = part.reshape(-1, BITS).astype(np.float32)
                total += part.T @ part
            yield from ()
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])

    # 4096 sums, whatever the number of fingerprints
    sums = nodes.select("fp").mapInArrow(run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS, BITS))
    for r in sums.collect():
        both[r.i, r.j] = r.n
    return nodes.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of bits of near-equal size; each grows by the bit that
    correlates most with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(sorted(left), key=lambda b: tie[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: tie[b, group].mean())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def within(bits: list[int], most: int) -> list[int]:
    """Masks over ``bits`` with at most ``most`` bits set."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]


def allocate(n: int, costs: list[list[float]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with ``sum(t + 1) = max_bits + 1``;
    ``costs[i][t + 1]`` is the work of partition i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (value, chosen) in best.items():
            for extra in range(max_bits + 2 - spent):
                new = (value + cost[extra], chosen + [extra - 1])
                if spent + extra not in step or new[0] < step[spent + extra][0]:
                    step[spent + extra] = new
        best = step
    return best[max_bits + 1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def plan(nodes: DataFrame, max_bits: int, choices: tuple = (2, 3, 4)) -> list[tuple[int, int, list[int]]]:
    """``(mask, threshold, bits)`` of each probed partition.

    The pairs that agree on a whole partition are counted exactly (sum of
    squared value counts over all fingerprints); pairs within t bits follow
    from them by the chance that the partition's bits differ.
    """
    n, both = bit_statistics(nodes)
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-9, 1 - 1e-9)
    layouts = {m: group_bits(n, both, m) for m in choices}
    masks = [(m, i, _signed(sum(1 << b for b in bits))) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    values = nodes.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value"))
        for m, i, mask in masks])).alias("x")).select("x.*")
    equal = {(r.m, r.i): float(r.pairs) for r in values.groupBy("m", "i", "value").count()
             .groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    found = None
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            chance = np.zeros(max_bits + 1)      # of exactly k differing bits
            chance[0] = 1.0
            for b in bits:
                chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
                chance[0] *= 1 - differ[b]
            pairs = equal.get((m, i), 0.0) * np.cumsum(chance) / chance[0]
            costs.append([0.0] + [PROBE_COST * n * len(within(bits, t)) + PAIR_COST * min(float(n) * n, pairs[t])
                                  for t in range(max_bits + 1)])
        cost, thresholds = allocate(n, costs, max_bits)
        if found is None or cost < found[0]:
            found = (cost, [(_signed(sum(1 << b for b in bits)), t, bits)
                            for bits, t in zip(groups, thresholds) if t >= 0])
    return found[1]


def links(nodes: DataFrame, max_bits: int = 2, hot: int = 512) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all fingerprint pairs
    within ``max_bits`` bits."""
    parts = plan(nodes, max_bits)
    held = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value"))
        for i, (mask, _, _) in enumerate(parts)])).alias("x")).select("fp", "x.*")
    asked = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(_signed(flip))).alias("value"))
        for i, (mask, t, bits) in enumerate(parts) for flip in within(bits, t)])).alias("x")).select("fp", "x.*")
    crowded = stored(held.groupBy("part", "value").count().where(F.col("count") > hot).select("part", "value"), "crowded")
    a = asked.join(crowded, ["part", "value"], "left_anti").select("part", "value", F.col("fp").alias("u"))
    b = held.select("part", "value", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    pairs = a.join(b, (a.part == b.part) & (a.value == b.value) & near).select("u", "v")
    # the crowded values: exact through shared neighbours
    dense = asked.join(crowded, ["part", "value"], "left_semi").select("fp").distinct()
    flips = within(list(range(BITS)), -(-max_bits // 2))
    points = dense.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(x))) for x in flips])).alias("point"))
    shared = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    if max_bits % 2 == 0:
        stars = shared.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
    else:       # one bit too wide: look again at the pairs of each point
        stars = (shared.select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v"))
                 .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
    return pairs.union(stars.where("u <> v"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, hot: int = 512,
                    id_col: str = "doc_id", text: str = "text", extra: tuple = ()) -> DataFrame:
    """One row per input row: ``id_col``, ``extra`` columns, ``fp`` and
    ``component_id``, the smallest id among the documents that can be reached
    over links (itself included; NULL only where no reachable row has an id).

    Rows are linked by fingerprint alone, so repeated rows and repeated ids
    share a component if their texts do.  An empty table gives an empty result.
    """
    held = stored(fingerprints(docs, shingle, text, (id_col, *extra)), "fingerprints")
    nodes = stored(held.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(links(nodes, max_bits, hot))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "root").join(least, "root").select("fp", "component_id", "root")
    return held.join(labels, "fp")


def without(docs: DataFrame, gone: DataFrame, digest: str) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, ``digest``) is not in ``gone``
    (columns gone_id and gone_hash, distinct pairs; a NULL id is a value).

    Up to ``SMALL`` pairs are broadcast, so no text is shuffled; more of them
    meet the documents in a shuffle join.
    """
    small = gone.limit(SMALL + 1).count() <= SMALL
    return docs.join(F.broadcast(gone) if small else gone,
                     docs["doc_id"].eqNullSafe(gone["gone_id"]) & (docs[digest] == gone["gone_hash"]), "left_anti")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group: that of the
    smallest doc_id.  Of several rows with that id the first by text hash
    stays, once.  Columns are unchanged."""
    digest = unused(docs, "text_hash")
    marked = docs.withColumn(digest, F.xxhash64(F.coalesce("text", F.lit(""))))
    classes = near_duplicates(marked, shingle, max_bits, extra=(digest,))
    rows = stored(classes.groupBy("root", "doc_id", digest).agg(F.count(F.lit(1)).alias("copies")), "rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", digest)).alias("x"))
    named = split_lookup(rows, first, ["root"], "inner")
    stays = F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col(digest) == F.col(f"x.{digest}"))
    # neither rows to drop nor repeated ones come through the anti join
    gone = stored(named.where(~stays | (F.col("copies") > 1))
                  .select(F.col("doc_id").alias("gone_id"), F.col(digest).alias("gone_hash"), stays.alias("repeated")), "gone")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = without(marked, gone.drop("repeated"), digest).select(*columns)
    # the rows that stay but are there several times: one of each
    again = F.broadcast(gone.where("repeated")) if gone.limit(SMALL + 1).count() <= SMALL else gone.where("repeated")
    several = marked.join(again, marked["doc_id"].eqNullSafe(again["gone_id"]) & (marked[digest] == again["gone_hash"]), "left_semi")
    one = several.groupBy("doc_id", digest).agg(F.first(F.struct(*columns)).alias("row"))
    return once.unionByName(one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
