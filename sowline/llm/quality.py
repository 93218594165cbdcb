"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every document gets base counts and rule scores (higher is worse).  A step
gives every rule a cutoff and rejects what is above any of them; steps go from
loose to strict, so their rejections are nested.  For each stratum (language)
the labelled good documents that a step rejects are counted, and the exact
binomial test asks whether the step would reject more than ``limit`` of the
good ones: it is certified if ``P(Binomial(n, limit) <= k)`` is at most the
stratum's level and all looser steps are certified (tests in a fixed order
need no correction among themselves).  The level is ``error`` divided by the
number of strata with enough good labels to certify anything if they were
alone, which does not depend on how their tests end.  So with probability
``1 - error`` no applied step, and it is all rules together, breaks its
promise.  Of a stratum's certified steps the one that best separates bad from
good labelled documents is applied; a stratum without any rejects nothing by
the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sowline.llm.common import stored, unused

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[^#*$%&|<>]+"       # all that is no symbol

LIMIT = 0.02        # of a stratum's good documents that all rules together may reject
ERROR = 0.05        # chance that any applied step breaks that promise
GOOD_WEIGHT = 10.0  # a rejected share of good documents against one of bad ones

# Cutoffs by rule from strict to loose, one a step; a document is rejected above the cutoff.
RATIOS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.5, 2.0)
CUTOFFS = {
    "symbols": RATIOS,              # symbols a word
    "duplicate_lines": RATIOS,      # share of lines equal to an earlier one
    "repeated_words": RATIOS,       # share of words in repeated 3-word windows
    "capitals": RATIOS,             # share of A-Z in words
    "long_words": (5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0, 100.0),
    "short_words": (0.20, 0.21, 0.22, 0.23, 0.24, 0.25, 0.28, 0.3, 0.33, 0.4, 0.5, 0.6, 0.7, 0.9),  # words a character
}
N_STEPS = len(RATIOS)           # step 0 has the last and loosest cutoff of every rule


def _repeat_words(keys: Column) -> Column:
    """Words covered by a window whose hash occurs twice or more.

    ``keys`` are the windows' (hash, index) in order, so that equal windows are
    neighbours (empty where no hash occurs twice).  It is a column, not an
    expression: inside a lambda an expression would be worked out anew for
    each element.
    """
    group = lambda i: F.get(keys, i)["h"]
    hits = F.filter(keys, lambda k, i: ((i > 0) & (k["h"] == group(i - 1))) | F.coalesce(k["h"] == group(i + 1), F.lit(False)))
    places = F.sort_array(F.transform(hits, lambda k: k["i"].cast("long")))
    zero = F.lit(0).cast("long")
    return F.aggregate(places, F.struct(zero.alias("n"), zero.alias("end")),
                       lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end")),
                       lambda acc: acc["n"])


def features(docs: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """``docs`` plus one struct column ``quality``: the base counts, the rule
    scores and the stratum.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.  NULL, empty and
    blank texts have no words and every count and score 0; a NULL stratum is
    the stratum ''.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = {k: unused(docs, f"quality_{k}") for k in ("words", "lines", "hashes", "keys")}
    words, lines, hashes, keys = (F.col(v) for v in names.values())
    trimmed = F.btrim(t, F.lit(BLANKS))
    n = F.size(words)
    cut = docs.withColumns({
        names["words"]: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)),
        names["lines"]: F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""),
    })
    cut = cut.withColumn(names["hashes"], F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3),
                    lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))))
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    cut = cut.withColumn(names["keys"], F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.filter(pairs, lambda x: F.lit(False)))
                         .otherwise(F.sort_array(pairs)))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    # The counts are chains of array expressions.  A filter on them would be
    # pushed below the projections that hold their steps, and each step would
    # be worked out again for every use; a row-counting condition keeps it above.
    base = cut.withColumn("quality", F.when(F.monotonically_increasing_id() >= 0, F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(keys).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")))).drop(*names.values())
    q = F.col("quality")
    return base.withColumn("quality", F.struct(
        "quality.*",
        ((q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])).alias("base_failed"),
        F.struct(per(q["n_symbols"], q["n_words"]).alias("symbols"), per(q["n_dup_lines"], q["n_lines"]).alias("duplicate_lines"),
                 per(q["n_repeat_words"], q["n_words"]).alias("repeated_words"),
                 per(q["n_capitals"], q["word_chars"]).alias("capitals"),
                 per(q["word_chars"], q["n_words"]).alias("long_words"),
                 per(q["n_words"], q["word_chars"]).alias("short_words")).alias("scores")))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, carried back."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    back = F.lit(0.0)
    for k in range(8):
        back = back + F.log(x + k)
    return series - back


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k <= n p, and 1 above (not small there).

    Terms are summed from k downwards; 40 standard deviations below, a term is
    under e^-800 of the first, so the sum is whole in double precision.
    """
    n, k = n.cast("double"), k.cast("double")
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 100).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, i: F.struct((acc["sum"] + acc["term"]).alias("sum"),
                                (acc["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term")),
        lambda acc: acc["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(first) * total)


def first_step(scores: Column) -> Column:
    """The loosest step that rejects a document; N_STEPS if none does."""
    def steps_passed(rule, cutoffs):
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: c >= scores[rule]))

    by_rule = [steps_passed(rule, cutoffs) for rule, cutoffs in CUTOFFS.items()]
    return F.least(*by_rule)


def step_counts(featured: DataFrame, labels: DataFrame) -> DataFrame:
    """``(stratum, step, n_good, good_over, n_bad, bad_over)`` of labelled documents.

    ``labels`` has doc_id and quality (1 good, 0 bad, NULL ignored; of repeated
    ids the best label counts).  Documents are joined by id; rows without an id
    or a label take no part.  At most 15 rows a stratum and partition are
    shuffled, so no stratum is gathered in one task.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    scored = featured.select("doc_id", F.col("quality.stratum").alias("stratum"), first_step(F.col("quality.scores")).alias("first"))
    is_good = F.col("good") == 1
    firsts = scored.join(marks, "doc_id").groupBy("stratum", "first").agg(
        F.sum(is_good.cast("long")).alias("g"), F.sum((~is_good).cast("long")).alias("b"))
    over = lambda c: F.sum(F.when(F.col("first") <= F.col("step"), F.col(c)).otherwise(0))
    return firsts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(N_STEPS - 1)))).groupBy("stratum", "step").agg(
        F.sum("g").alias("n_good"), over("g").alias("good_over"), F.sum("b").alias("n_bad"), over("b").alias("bad_over"))


def certified_steps(featured: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """``(stratum, step)``: the step to apply, for strata with a certified one."""
    counts = stored(step_counts(featured, labels), "step-counts")
    able = counts.where((F.col("step") == 0) & (F.col("n_good") * -math.log1p(-limit) >= -math.log(error))).count()
    good = binomial_tail(F.col("n_good"), F.col("good_over"), limit) <= error / max(1, able)
    # a stratum has one row a step here
    looser = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("bad_over") / F.greatest("n_bad", F.lit(1)) - GOOD_WEIGHT * F.col("good_over") / F.greatest("n_good", F.lit(1))
    return (counts.withColumn("certified", F.min(good).over(looser)).where("certified and bad_over > 0")
            .groupBy("stratum").agg(F.max(F.struct(gain.alias("gain"), (-F.col("step")).alias("loose"))).alias("best"))
            .select("stratum", (-F.col("best.loose")).alias("step")))


def judge(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """``docs`` plus ``quality`` (see ``features``) and ``kept``.

    The steps are a table of one row a stratum; documents meet it by
    stratum, as a broadcast only if Spark finds the table small enough.
    """
    featured = features(docs)
    steps = stored(certified_steps(featured, labels, limit, error), "steps")
    stratum, step = unused(docs, "step_stratum"), unused(docs, "step_applied")
    steps = steps.select(F.col("stratum").alias(stratum), F.col("step").alias(step))
    joined = featured.join(steps, F.col("quality.stratum") == F.col(stratum), "left")
    over = F.coalesce(first_step(F.col("quality.scores")) <= F.col(step), F.lit(False))
    return joined.withColumn("kept", ~F.col("quality.base_failed") & ~over).drop(stratum, step)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged."""
    own = {c: unused(docs, f"plain_{c}") for c in docs.columns if c.lower() in ("quality", "kept")}
    judged = judge(docs.withColumnsRenamed(own), labels).where("kept").drop("quality", "kept")
    return judged.withColumnsRenamed({v: k for k, v in own.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])
