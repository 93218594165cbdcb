import math
from fractions import Fraction

import numpy as np
import pytest

from sowline.llm import whiten
from sowline.llm.queries import QUERIES

BASE = "/root/testdata/sf0.001"


def naive(vectors, weights="one", most=16):
    """The same from plain lists: exact sums, one vector at a time."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    counts = {}
    for _, x in kept:
        counts[tuple(x)] = counts.get(tuple(x), 0) + 1
    if not counts:
        return []
    weight = {x: 1 if weights == "one" else c for x, c in counts.items()}
    n, d = sum(weight.values()), len(kept[0][1])
    s = [sum(w * x[k] for x, w in weight.items()) for k in range(d)]
    mean = [Fraction(a, n) for a in s]
    cov = [[float(sum(w * (x[a] - mean[a]) * (x[b] - mean[b]) for x, w in weight.items()) / n) for b in range(d)] for a in range(d)]
    e, v = np.linalg.eigh(np.array(cov))
    out = []
    for i, x in kept:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for k in range(min(most, d)):
            lam, vec = e[d - 1 - k], v[:, d - 1 - k]
            out.append((i, k + 1, n, dev, sum(float(x[a] - mean[a]) * vec[a] for a in range(d)) / math.sqrt(lam), lam / sum(e)))
    return out


def check(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:4] == w[:4]
        assert abs(abs(g[4]) - abs(w[4])) < 1e-7 and abs(g[5] - w[5]) < 1e-9 * abs(w[5])


def rows_of(df):
    return [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in df.collect()]


def test_query_equals_brute_force(spark):
    df = QUERIES["op12_embedding_whitening"](spark, BASE)
    got = df.collect()
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{BASE}/embeddings.parquet").collect()]
    d = len(vectors[0][1])
    if len(vectors) > d:        # else the smallest eigenvalues are zero
        check(rows_of(df), naive(vectors))


def exploded(white):
    return [(r.vec_id, k + 1, r.n, r.deviation, w, e) for r in white.collect() for k, (w, e) in enumerate(zip(r.whitened, r.explained))]


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_copies_nulls_and_clashing_columns(spark, weights):
    rng = np.random.default_rng(4)
    pool = [[float(c) for c in rng.normal(size=5)] for _ in range(40)]
    vectors = [(i, pool[0] if i % 3 == 0 else pool[i % 40]) for i in range(300)]
    vectors += [(None, pool[1]), (7, pool[2]), (7, pool[2]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0]),
                (902, [float("nan")] * 5), (903, [1.0, 2.0, float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 5, 6.0) for i, v in vectors], "vec_id long, embedding array<double>, x int, n double").repartition(9)
    white = whiten.whiten(df, 3, weights)
    check(exploded(white), naive(vectors, weights, 3))
    assert all(r.identity_error < 1e-9 for r in white.collect())


def test_sums_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=8) * 1e4]) for i in range(200)], "vec_id long, embedding array<double>")
    a, b = (sorted(exploded(whiten.whiten(df.repartition(k), 8))) for k in (1, 13))
    assert [r[:4] for r in a] == [r[:4] for r in b] and all(x[4] == y[4] for x, y in zip(a, b))


def test_large_numbers_lengths_and_flat_components(spark):
    big = [(1, [3e9, -2e9]), (2, [3e9, 5e9]), (3, [-4e9, 1.0])]
    other = [(4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0])]        # one distinct vector: no variance
    df = spark.createDataFrame(big + other + [(6, []), (7, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whiten.whiten(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    exact = {i: dev for i, k, _, dev, _, _ in naive(big) if k == 1}
    assert {i: got[i].deviation for i in (1, 2, 3)} == {i: d if d < 1 << 63 else None for i, d in exact.items()}
    assert got[4].whitened == got[5].whitened == [0.0] * 3 and got[4].n == 1 and got[6].whitened == []
    assert got[1].identity_error < 1e-9 and got[4].identity_error == 0.0


def test_empty_table_and_all_dropped(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
