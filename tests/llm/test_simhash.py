import itertools
import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sowline.llm import simhash
from sowline.llm.components import components


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot,max_bits", [(512, 2), (2, 2), (2, 1), (3, 3)])
def test_links_match_brute_force(spark, hot, max_bits):
    rng = random.Random(hot)
    fps = {0, -1, 1 << 62}
    for base in (0x0F0F0F0F12345678, -(1 << 63), 77):
        for _ in range(25):
            x = base & ((1 << 64) - 1)
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    nodes = spark.createDataFrame([(f, f) for f in fps], "fp long, least long")
    got = {r.node: r.root for r in components(simhash.links(nodes, max_bits, hot)).collect()}
    want = brute_components([(a, b) for a, b in itertools.combinations(fps, 2)
                             if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= max_bits], fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_whole_operator_and_edge_cases(spark):
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    rows = [(5, "One two  three\tfour", "x"), (3, "one TWO three\nfour", "y"), (9, None, None), (4, "", "z"),
            (8, " \t", "z"), (None, "one two three four", "q"), (7, "a b", "q"), (7, "a b", "q"), (1, long, "s"), (2, "É b", "s"),
            (6, "é b", "s"), (11, None, "t"), (None, "nobody else", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fp & ((1 << 64) - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {(i, brute_fingerprint(t)) for i, t, _ in rows}
    assert {g[:2] for g in got} == fps
    by = {g[0]: g[2] for g in got if g[0] is not None}
    assert by[5] == by[3] == 3 and by[9] == by[4] == by[8] == by[11] == 4 and by[7] == 7 and by[2] != by[6]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7] and ids.count(None) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_thresholds_cover_the_distance():
    cost, chosen = simhash.allocate(10, [[0, 5, 50, 500], [0, 1, 2, 300], [0, 100, 200, 300]], 2)
    assert sum(t + 1 for t in chosen) == 3 and chosen == [0, 1, -1] and cost == 7


def test_component_chain(spark):
    chain = spark.range(0, 200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(201)}


def test_keep_one_of_many_equal_rows_and_beyond_the_broadcast(spark, monkeypatch):
    rows = [(None, "same text here", i) for i in range(30)] + [(4, "same text here", 1), (4, "same text here", 1), (9, "other words there", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, nth int").repartition(5)
    for small in (simhash.SMALL, 0):
        monkeypatch.setattr(simhash, "SMALL", small)
        assert sorted(tuple(r) for r in simhash.keep_one(docs).collect()) == [(4, "same text here", 1), (9, "other words there", 2)]
