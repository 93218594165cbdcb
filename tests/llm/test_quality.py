import math

import pytest
from pyspark.sql import functions as F

from sowline.llm import quality


def brute(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "é # $$ | <b>\n é # $$ | <b>\né # $$ | <b>",
         "a\x1cb\x85c\xa0d e", "one\ntwo\n\none\n two\ntwo", "a b c d a b c e b c d", "p q r " * 40, " ".join(f"w{i % 701}" for i in range(2000))]


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "n o", None), (3, "a", "en"), (3, "a", "en")],
                                 "doc_id long, text string, lang string").selectExpr("*", "1 as quality_words", "2 as kept")
    got = quality.features(docs).select("doc_id", "text", "quality").collect()
    assert len(got) == docs.count()
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == brute(r.text), r.text
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (1000, 3, 0.01), (5000, 20, 0.01), (100000, 900, 0.01), (50, 10, 0.01), (1, 0, 0.5)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), p).alias("x")).first().x
    want = 1.0 if k > n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                                              + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-8)


def test_certified_cutoffs_reject_junk_only(spark):
    good = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}$$$" for i in range(60))
    n = 3000
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, good).otherwise(junk).alias("text"),
                                     F.lit("en").alias("lang"))
    docs = docs.union(spark.createDataFrame([(9001, junk, "fr"), (9002, junk, None)], "doc_id long, text string, lang string"))
    labels = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") < n).cast("int").alias("quality"))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == set(range(n)) | {9001, 9002}       # no labels, no cutoff
    few = quality.keep_good(docs, labels.where("doc_id % 100 = 0"))
    assert few.count() == docs.count()                # 30 good documents certify nothing


def test_small_strata_reject_junk_and_the_promise_holds_for_all_rules_together(spark):
    """Four strata of 320 good documents certify; where junk looks like good ones, no step does."""
    good = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}$$$" for i in range(60))
    rows = [(i, junk if i % 400 >= 320 else good, f"l{i // 400}") for i in range(1600)]
    # stratum l4: 320 labelled good, 40 of them as full of symbols as the bad
    rows += [(2000 + i, junk if i < 40 or i >= 320 else good, "l4") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(if(doc_id < 2000, doc_id % 400 < 320, doc_id < 2320) as int) as quality")
    steps = {r.stratum: r.step for r in quality.certified_steps(quality.features(docs), labels).collect()}
    assert set(steps) == {"l0", "l1", "l2", "l3"}
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, _, lang in rows if lang == "l4" or i % 400 < 320}


def test_first_step_is_the_loosest_that_rejects(spark):
    names = list(quality.CUTOFFS)
    for scores in ([0.0] * 6, [0.02] * 6, [0.021, 0, 0, 0, 0, 0], [0, 0, 0, 0, 7.2, 0.23], [9.0, 0, 0, 0, 0, 0]):
        row = spark.createDataFrame([tuple(map(float, scores))], names).select(quality.first_step(F.struct(*names)).alias("x")).first()
        over = [any(v > quality.CUTOFFS[r][-1 - step] for r, v in zip(names, scores)) for step in range(quality.N_STEPS)]
        assert row.x == (over.index(True) if True in over else quality.N_STEPS)


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 49, "x", 0, "z"), (2, " ".join(f"b{i}" for i in range(50)), "y", 1, "z"), (None, None, None, None, None)],
                                 "doc_id long, text string, lang string, kept int, quality string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [2]
    assert quality.keep_good(docs.limit(0), labels).count() == 0 and quality.keep_good(docs, labels.limit(0)).count() == 1


def test_windows_whose_hashes_agree_in_many_bits(spark):
    """Only whole hashes make windows equal: these share the top 41 bits."""
    base = 0x123456789AB << 20
    for hashes, want in (([base, base + 1, base + 2, -base], 0), ([base, 5, base, base + 1], 5), ([], 0)):
        df = spark.createDataFrame([(hashes,)], "h array<bigint>")
        keys = df.select(F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("k"))
        assert keys.select(quality._repeat_words(F.col("k")).alias("n")).first().n == want
