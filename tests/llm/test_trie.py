import hashlib
import random
import zlib

import pytest

from sowline.llm import trie
from sowline.llm.queries import QUERIES

BASE = "/root/testdata/sf0.001"


def naive(rows, group=100, most=6):
    """Nodes from a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (c % group if c >= 0 else -(-c % group))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) if p in kids else 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(ends.get(p, [])))
                   for p, m in members.items()), key=str)


def check(spark, rows, partitions=7, block=trie.BLOCK, schema="conv_id long, turn long, role string, text string"):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # else these few rows are one partition
    try:
        df = spark.createDataFrame(rows, schema).repartition(partitions)
        got = sorted(map(tuple, trie.prefix_trie(df, block=block).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = naive([r[:4] for r in rows])
    assert len(got) == len(want)
    assert got == want


def conversations(seed, n=60, longest=12, words=3, ids=400):
    rng = random.Random(seed)
    rows, pool = [], []
    for c in rng.sample(range(ids), n):
        if pool and rng.random() < 0.6:
            turns = list(rng.choice(pool))[:rng.randrange(longest + 1)] + [rng.randrange(words) for _ in range(rng.randrange(4))]
        else:
            turns = [rng.randrange(words) for _ in range(rng.randrange(1, longest))]
        pool.append(turns)
        rows += [(c, i, ["user", "assistant"][i % 2], "x" * t + "é") for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations_equal_brute_force(spark, seed):
    check(spark, conversations(seed))


def test_blocks_of_long_conversations(spark):
    check(spark, conversations(3, n=50, longest=20, words=2), block=3)      # many blocks, and ends at block starts


def test_long_and_equal_conversations(spark):
    turns = [(i, "user", f"text {i % 7}") for i in range(200)]
    rows = [(c, *t) for c in (100, 101, 205, 207) for t in turns[:200 - c % 5]]
    rows += [(c, *t) for c in range(300, 340) for t in turns[:64]]      # copies that end with a block
    rows += [(c, *t) for c in range(340, 350) for t in turns[:65]]
    check(spark, rows)


def test_nulls_ties_negative_ids_and_clashing_columns(spark):
    rows = [(-7, None, None, "b"), (-7, None, None, "a"), (-7, 1, "user", None), (-107, 1, "user", None), (-107, 1, "user", None),
            (0, 0, "", ""), (1, 5, "user", "y" * 5000), (None, 1, "user", "lost"), (103, 0, "a", "b"), (104, 0, "ab", ""), (205, 0, "user", "z")]
    rows = [(*r, 4, "x", 9) for r in rows]
    check(spark, rows, schema="conv_id long, turn long, role string, text string, depth long, pkey string, pos long")


def test_empty_table_and_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    check(spark, [(lone, 0, "user", "gone")])       # its base is absent and its only turn is left out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{BASE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_conversation_trie"](spark, BASE).collect()), key=str) == naive(rows)
