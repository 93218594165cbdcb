import random

import pytest

from sowline.llm import substrings


def brute(rows, width):
    seen = {}
    texts = [((i if i is not None else substrings.NO_ID), i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    for key, _, words in texts:
        for p in range(len(words) - width + 1):
            g = tuple(words[p:p + width])
            seen[g] = min(seen.get(g, key), key)
    out = []
    for key, i, words in texts:
        gone = {q for p in range(len(words) - width + 1) if seen[tuple(words[p:p + width])] < key for q in range(p, p + width)}
        out.append((i, len(words), len(gone), " ".join(w for q, w in enumerate(words) if q not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,width,block", [(1, 13, 4), (2, 7, 2), (3, 13, 2048), (4, 20, 7)])
def test_equals_brute_force(spark, seed, width, block):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(30)}" for _ in range(rng.choice([6, 7, 13, 14, 25, 60]))] for _ in range(6)] + [["a"] * 40, ["a", "b"] * 20]
    rows = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < .6 else [f"q{rng.randrange(500)}" for _ in range(rng.randrange(20))]
        rows.append((i * 3 % 41, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(None, rows[5][1]), (None, rows[6][1]), (7, rows[5][1]), (7, rows[5][1]), (100, None), (101, ""), (102, " \n"),
             (103, "é\xa0x " * 30), (104, "é\xa0x " * 31), (105, " ".join(f"w{j % 997}" for j in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as id")
    got = sorted([tuple(r) for r in substrings.deduplicated(docs, width, block).collect()], key=str)
    assert got == brute(rows, width)


def test_cover_is_a_difference_cover():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + d) % substrings.PERIOD in substrings.COVER and (j + d) % substrings.PERIOD in substrings.COVER
                       for d in range(substrings.PERIOD))


def test_empty_table(spark):
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
