"""Whitening of embeddings by a weighted multiplicity covariance.

Every vector entry c becomes the whole number ``x = floor(scale * c) + offset``.
Equal x vectors are grouped; the fit list holds each distinct one with a
weight: its number of rows, or one.

* Sums and covariance: the distinct vectors are centred at the whole number
  next to their mean before they are multiplied (one matrix product a batch);
  all products are whole numbers and summed exactly, and what the centre lacks
  to the mean is taken off exactly too.  The result doesn't depend on how the
  rows are dealt.
* Components are the unit eigenvectors of the covariance, largest eigenvalue
  first, each with its largest entry positive.
* Every distinct vector is whitened once and joined back to its rows.  A
  vector that very many rows share is joined by broadcast (``split_lookup``).

Vectors of different lengths lie in different spaces: each length has a fit of
its own.  The driver gets the sums and the covariance of every length,
``MAX_CELLS`` numbers at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowline.llm.common import stored
from sowline.operators.skew import split_lookup

SCALE, OFFSET = 64, 1_000_000
LIMIT = 1 << 45         # of |scale * c|; entries beyond it count as not finite
EXACT = 1 << 53         # whole numbers that a double holds
MAX_CELLS = 1 << 24
ROWS = 2048             # vectors multiplied at a time
LONG = (1 << 63) - 1


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row less the offset in the smallest of 2, 4 or 8 bytes an entry
    that holds all of it: equal rows, equal bytes.  The first byte is the size."""
    x = x - OFFSET
    most = np.abs(x).max(axis=1) if x.shape[1] else np.zeros(len(x), dtype=np.int64)
    out: list = [None] * len(x)
    for size, least, limit in ((2, -1, 1 << 15), (4, 1 << 15, 1 << 31), (8, 1 << 31, LONG)):
        rows = np.flatnonzero((most >= least) & (most < limit))
        data = x[rows].astype(f"<i{size}").tobytes()
        n = size * x.shape[1]
        for k, i in enumerate(rows.tolist()):
            out[i] = bytes([size]) + data[n * k:n * (k + 1)]
    return out


def unpacked(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, x)`` of packed vectors by length and size."""
    values = column.to_pylist()
    groups: dict[tuple[int, int], list[int]] = {}
    for i, v in enumerate(values):
        groups.setdefault((v[0], len(v)), []).append(i)
    for (size, n), places in sorted(groups.items()):
        data = b"".join([values[i][1:] for i in places])
        yield np.array(places), np.frombuffer(data, dtype=f"<i{size}").reshape(len(places), (n - 1) // size).astype(np.int64) + OFFSET


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id_col`` and ``x`` (packed) of the rows whose vector is not NULL and
    has only finite entries (and none beyond ``LIMIT / scale``)."""
    rows = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector}`").cast("array<double>").alias("_v")).where("_v is not null")
    schema = rows.select(f"`{id_col}`").schema.add("x", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = pc.list_flatten(lists)
            values = np.asarray(pc.fill_null(flat, float("nan")))
            sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            ends = np.cumsum(sizes)
            found: list = [None] * batch.num_rows
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(SCALE * values)
                bad = ~(np.abs(scaled) <= LIMIT)            # also NaN
            spoilt = np.concatenate([[0], np.cumsum(bad)])
            good = spoilt[ends] == spoilt[ends - sizes]
            for n in np.unique(sizes[good]).tolist():
                rows_n = np.flatnonzero(good & (sizes == n))
                x = scaled[(ends - sizes)[rows_n][:, None] + np.arange(n)].astype(np.int64) + OFFSET
                for i, packed in zip(rows_n.tolist(), _packed(x)):
                    found[i] = packed
            x = pa.array(found, pa.binary())
            keep = pc.is_valid(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), x.filter(keep)], names=[id_col, "x"])

    return rows.mapInArrow(run, schema)


def _weights(batch: pa.RecordBatch, weights: str) -> np.ndarray:
    return np.ones(batch.num_rows, dtype=np.int64) if weights == "one" else np.asarray(batch.column("rows")).astype(np.int64)


def _sums(distinct: DataFrame, weights: str) -> dict[int, tuple[int, list[int]]]:
    """Per vector length: total weight and sum of every dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            w = _weights(batch, weights)
            for places, x in unpacked(batch.column("x")):
                kept = totals.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                kept[0] += int(w[places].sum())
                kept[1] = [a + b for a, b in zip(kept[1], _exact(w[places][None, :], x)[0])]
        rows = [(d, i, s) for d, (n, sums) in totals.items() for i, s in enumerate([n, *sums])]
        yield _decimals(rows, ["d", "i"])

    found = distinct.mapInArrow(run, "d int, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for d in {r.d for r in found}:
        at = {r.i: int(r.s) for r in found if r.d == d}
        out[d] = (at[0], [at[i + 1] for i in range(d)])
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """Matrix product of whole numbers as Python integers, through doubles
    where these hold every sum."""
    most = lambda m: int(np.abs(m).max()) if m.size else 0
    if most(a) * most(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).tolist()
    return (a.astype(object) @ b.astype(object)).tolist()


def _decimals(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    from decimal import Context, Decimal

    exact = Context(prec=38)
    keys = [pa.array([r[k] for r in rows], pa.int32()) for k in range(len(names))]
    values = pa.array([exact.create_decimal(r[-1]) if r[-1] else Decimal(0) for r in rows], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([*keys, values], names=[*names, "s"])


def covariance(distinct: DataFrame, sums: dict[int, tuple[int, list[int]]], weights: str) -> dict[int, np.ndarray]:
    """Covariance (divisor: total weight) per vector length."""
    if sum(d * d for d in sums) > MAX_CELLS:
        raise ValueError(f"the covariances have more than {MAX_CELLS} entries")
    centre = {d: np.array([_nearest(s, n) for s in total], dtype=np.int64) for d, (n, total) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            w = _weights(batch, weights)
            for places, x in unpacked(batch.column("x")):
                d = x.shape[1]
                for at in range(0, len(places), ROWS):
                    c = x[at:at + ROWS] - centre[d]
                    wc = c * w[places[at:at + ROWS]][:, None] if int(w.max()) * LIMIT < LONG else c.astype(object) * w[places[at:at + ROWS]][:, None]
                    part = np.array(_exact(wc.T, c), dtype=object)
                    parts[d] = parts.get(d, 0) + part.reshape(d, d)
        yield _decimals([(d, i, int(s)) for d, part in parts.items() for i, s in enumerate(part.ravel())], ["d", "i"])

    found = distinct.mapInArrow(run, "d int, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").alias("s"))
    products = {d: [0] * (d * d) for d in sums}
    for r in found.collect():
        products[r.d][r.i] = int(r.s)
    out = {}
    for d, (n, total) in sums.items():
        rest = [s - n * int(m) for s, m in zip(total, centre[d])]      # what the centre lacks, times n
        # n * n * covariance is a whole number
        out[d] = np.array([[(n * products[d][i * d + j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)]).reshape(d, d)
    return out


def _nearest(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def components(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors (rows), each with its
    largest entry positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order].T
    top = np.abs(vectors).argmax(axis=1) if len(values) else []
    sign = np.where(vectors[np.arange(len(values)), top] < 0, -1.0, 1.0)
    return values, vectors * sign[:, None]


def whiten(vectors: DataFrame, most: int = 16, weights: str = "one", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per remaining row of ``vectors``: ``id_col``, ``x`` (packed),
    ``dims``, ``n`` (total weight of its length's fit list), ``deviation``
    (sum of ``(n * x - S) ** 2``, exact; NULL beyond a long), ``whitened``
    (array of double, ``most`` components at most), ``explained`` (array) and
    ``identity_error`` (largest absolute entry of the whitened covariance less
    the identity, over the components of the row's length).

    ``weights`` is ``one`` or ``counts``.  Rows whose vector is NULL or has
    NULL or non-finite entries are left out; an empty vector has no
    components.  A component without variance (as with a single distinct
    vector) can't be whitened: its values are 0 and it counts in no
    ``identity_error``.  Repeated ids stay repeated; an empty table gives an
    empty result.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights: one or counts")
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_col, vector), "vectors")
    distinct = stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("rows")), "distinct")
    sums = _sums(distinct, weights)
    fits = {}
    for d, cov in covariance(distinct, sums, weights).items():
        e, v = components(cov)
        k = min(most, d)
        flat = np.finfo(float).eps * d * max(float(e[0]), 1e-300) if d else 0.0
        scale = np.array([1 / math.sqrt(x) if x > flat else 0.0 for x in e[:k]])
        trace = float(np.trace(cov))
        fits[d] = (*sums[d], v[:k] * scale[:, None], [float(x) / trace if trace > 0 else 0.0 for x in e[:k]], scale > 0)
    shipped = spark.sparkContext.broadcast(fits)
    schema = "x binary, rows long, dims int, n long, deviation long, whitened array<double>, explained array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            dims, n, dev = np.zeros(m, dtype=np.int32), np.zeros(m, dtype=np.int64), [0] * m
            white: list = [None] * m
            share: list = [None] * m
            for places, x in unpacked(batch.column("x")):
                d = x.shape[1]
                total, s, project, explained, _ = shipped.value[d]
                centre = [_nearest(a, total) for a in s]
                rest = [a - total * c for a, c in zip(s, centre)]
                c = x - np.array(centre, dtype=np.int64).reshape(1, d)
                far = (int(np.abs(c).max()) + 1) * total if c.size else 0
                whole = (c if far * far * max(d, 1) < LONG else c.astype(object)) * total - np.array(rest, dtype=np.int64 if far < LONG else object)
                values = (c - np.array([r / total for r in rest])) @ project.T
                squares = (whole * whole).sum(axis=1).tolist()
                for k, i in enumerate(places.tolist()):
                    dims[i], n[i], white[i], share[i] = d, total, values[k].tolist(), explained
                    dev[i] = squares[k] if squares[k] <= LONG else None
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("rows"), pa.array(dims), pa.array(n), pa.array(dev, pa.int64()),
                                              pa.array(white, pa.list_(pa.float64())), pa.array(share, pa.list_(pa.float64()))],
                                             names=["x", "rows", "dims", "n", "deviation", "whitened", "explained"])

    whitened = stored(distinct.mapInArrow(run, schema), "whitened")
    error = identity_error(whitened, fits, weights)
    lookup = whitened.drop("rows").withColumn("identity_error", _by_length(error))
    return split_lookup(rows, lookup, ["x"], "inner")


def _by_length(error: dict[int, float]):
    """The error of the row's vector length."""
    found = F.lit(0.0)
    for d, e in error.items():
        found = F.when(F.col("dims") == d, F.lit(float(e))).otherwise(found)
    return found


def identity_error(whitened: DataFrame, fits: dict, weights: str) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' covariance less the
    identity, per vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            w, dims = _weights(batch, weights), np.asarray(batch.column("dims"))
            lists = batch.column("whitened")
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                values = np.asarray(pc.list_flatten(lists.take(pa.array(at)))).reshape(len(at), -1)
                values = np.column_stack([np.ones(len(at)), values])        # sums ride along
                parts[d] = parts.get(d, 0) + (values * w[at][:, None]).T @ values
        rows = [(d, i, s) for d, p in parts.items() for i, s in enumerate(p.ravel().tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.float64())], names=["d", "i", "s"])

    sums = whitened.select("rows", "dims", "whitened").mapInArrow(run, "d int, i int, s double").groupBy("d", "i").agg(F.sum("s").alias("s"))
    found: dict[int, dict[int, float]] = {}
    for r in sums.collect():
        found.setdefault(r.d, {})[r.i] = r.s
    out = {}
    for d, cells in found.items():
        size = math.isqrt(len(cells))
        m = np.array([cells[i] for i in range(size * size)]).reshape(size, size)
        n, kept = m[0, 0], fits[d][-1]
        # whitened values are centred; their mean is rounding alone
        cov = m[1:, 1:] / n - np.outer(m[0, 1:], m[0, 1:]) / (n * n)
        off = np.abs(cov - np.eye(size - 1))[np.ix_(kept, kept)]
        out[d] = float(off.max()) if off.size else 0.0
    return out
