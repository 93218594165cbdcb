"""Exact quantiles, describe() and the 1.5 x IQR outlier filter.

pandas ``quantile`` / DuckDB ``quantile_cont`` interpolate linearly between
the values at ranks floor(h) and floor(h)+1, h = p * (n - 1).  Spark's
``percentile`` gives the same numbers but merges every distinct value of a
group in one task, which breaks down when one group holds a third of the data.

``exact_quantiles`` finds the ranked values through histograms instead:

1. every value gets an order-preserving key made of its binary exponent and
   its mantissa bits, 16 bits per level (no pass over the data is needed to
   choose the buckets);
2. counts per (group, level-0 bucket) -- partial aggregation, a bounded
   number of rows per group whatever the group size;
3. cumulative counts over the buckets of a group locate the bucket holding
   each target rank; the next level repeats this with the next 16 bits inside
   the chosen bucket only;
4. only the distinct values of the innermost chosen buckets are sorted, each
   bucket by itself: at most 2^(52 - 16 * levels) distinct values.

Every shuffle moves counts or chosen buckets, never a whole group, and the
answer is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sowline.functions.numeric import lerp, round_half_even

DESCRIBE_PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


LEVEL_BITS = 16


def with_order_buckets(df: DataFrame, v: str, levels: int = 2) -> DataFrame:
    """Add ``__b0 .. __b{levels-1}``: together a monotone key of double ``v``.

    ``__b0`` holds the sign, the binary exponent and the top 16 mantissa bits;
    each further level the next 16 bits (reversed for negative values so the
    keys keep the value order).  Values equal in all levels differ at most in
    the last 52 - 16 * levels mantissa bits.  Built in steps (one column each)
    so the expression tree stays small.
    """
    a, e0, e = F.col("__oa"), F.col("__oe0"), F.col("__oe")
    mask = (1 << LEVEL_BITS) - 1
    big = F.lit(1 << 62)
    out = (df
           .withColumn("__oa", F.abs(F.col(v)))
           # infinities get buckets of their own below; their exponent is not used
           .withColumn("__oe0", F.floor(F.log2(F.when(a == float("inf"), F.lit(1.0)).otherwise(a))).cast("long"))
           # log2 may be off by one next to a power of two: correct it exactly
           .withColumn("__oe", F.when(a < F.pow(F.lit(2.0), e0), e0 - 1)
                       .when(a >= F.pow(F.lit(2.0), e0 + 1), e0 + 1).otherwise(e0))
           # all 52 fraction bits as an exact integer (scaling by powers of two is exact)
           .withColumn("__om", F.when(a == float("inf"), F.lit(0)).otherwise(F.least(F.greatest(
               F.floor((a / F.pow(F.lit(2.0), e) - F.lit(1.0)) * F.lit(float(1 << 52))).cast("long"),
               F.lit(0)), F.lit((1 << 52) - 1)))))
    top = F.shiftright(F.col("__om"), 52 - LEVEL_BITS)
    neg = F.col(v) < 0
    out = out.withColumn("__b0", F.when(F.col(v) == 0, F.lit(0))
                         .when(a == float("inf"), F.when(F.col(v) > 0, big).otherwise(-big))
                         .otherwise(F.signum(F.col(v)).cast("long")
                                    * ((e + F.lit(1100)) * F.lit(1 << LEVEL_BITS) + top + F.lit(1)))
                         .cast("long"))
    for i in range(1, levels):
        k = F.shiftright(F.col("__om"), 52 - LEVEL_BITS * (i + 1)).bitwiseAND(F.lit(mask))
        out = out.withColumn(f"__b{i}", F.when((F.col(v) == 0) | (a == float("inf")), F.lit(0))
                             .when(neg, F.lit(mask) - k).otherwise(k).cast("long"))
    return out.drop("__oa", "__oe0", "__oe", "__om")


def exact_quantiles(df: DataFrame, group_by: Sequence[str], value: str,
                    probs: Mapping[str, float], levels: int = 2) -> DataFrame:
    """One row per group with one column per entry of ``probs`` (name -> p).

    Null and NaN values are ignored and rows with a null group key are
    dropped, as pandas ``groupby`` does.  Groups with no value are absent.
    ``levels`` bucket levels of 16 mantissa bits each: the final sort of a
    chosen bucket holds at most 2^(52 - 16 * levels) distinct values (2^20
    with the default), whatever the data.
    """
    g = list(group_by)
    keep = F.col("__v").isNotNull() & ~F.isnan("__v")
    for c in g:
        keep = keep & F.col(c).isNotNull()
    vals = with_order_buckets(
        df.select(*g, F.col(value).cast("double").alias("__v")).where(keep), "__v", levels)
    bcols = [f"__b{i}" for i in range(levels)]
    # explicit: a join below would otherwise infer this filter on one branch
    # only, and the uses of ``dist`` could no longer share one exchange
    vals = vals.where(F.col("__b0").isNotNull())
    dist = vals.groupBy(*g, *bcols, "__v").agg(F.count(F.lit(1)).alias("__c"))

    # level 0: histogram per group; targets are the ranks floor(h), floor(h)+1
    hist = dist.groupBy(*g, "__b0").agg(F.sum("__c").alias("__cnt"))
    wg = Window.partitionBy(*g)
    hist = (hist
            .withColumn("__start", F.coalesce(F.sum("__cnt").over(
                wg.orderBy("__b0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("__n", F.sum("__cnt").over(wg)))
    names = list(probs)
    tgt = F.array(*[
        F.struct(F.lit(i).alias("q"), F.lit(float(probs[name])).alias("p"), F.lit(side).alias("side"))
        for i, name in enumerate(names) for side in (0, 1)])
    t = (hist.select(*g, "__b0", "__start", "__cnt", "__n", F.explode(tgt).alias("__t"))
         .withColumn("__h", F.col("__t.p") * (F.col("__n") - 1).cast("double"))
         .withColumn("__k0", F.floor("__h").cast("long"))
         .withColumn("__k", F.when(F.col("__t.side") == 0, F.col("__k0"))
                     .otherwise(F.least(F.col("__k0") + 1, F.col("__n") - 1))))
    chosen = (t.where((F.col("__k") >= F.col("__start"))
                      & (F.col("__k") < F.col("__start") + F.col("__cnt")))
              .select(*g, "__b0", F.col("__t.q").alias("__q"), F.col("__t.side").alias("__side"),
                      (F.col("__h") - F.col("__k0").cast("double")).alias("__frac"),
                      (F.col("__k") - F.col("__start")).alias("__k")))
    # rows of the chosen buckets only, once per target pointing into them
    # (at most two per probability)
    tkeys = ["__q", "__side"]
    cand = dist.join(chosen, on=g + ["__b0"], how="inner")
    # deeper levels: histogram of the next 16 bits inside each chosen bucket
    for i in range(1, levels):
        b = f"__b{i}"
        path = g + tkeys + [f"__b{j}" for j in range(i)]
        h = cand.groupBy(*path, b).agg(F.sum("__c").alias("__cnt"), F.first("__k").alias("__kk"),
                                       F.first("__frac").alias("__ff"))
        h = h.withColumn("__start", F.coalesce(F.sum("__cnt").over(
            Window.partitionBy(*path).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)))
        pick = (h.where((F.col("__kk") >= F.col("__start"))
                        & (F.col("__kk") < F.col("__start") + F.col("__cnt")))
                .select(*path, b, (F.col("__kk") - F.col("__start")).alias("__k2")))
        cand = (cand.join(pick, on=path + [b], how="inner")
                .withColumn("__k", F.col("__k2")).drop("__k2"))
    # final: the distinct values of each chosen innermost bucket, sorted alone
    part = g + tkeys + bcols
    wb = Window.partitionBy(*part).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (cand.withColumn("__end", F.sum("__c").over(wb))
              .where((F.col("__end") - F.col("__c") <= F.col("__k")) & (F.col("__k") < F.col("__end"))))
    aggs = []
    for i, _ in enumerate(names):
        hit = F.col("__q") == i
        aggs += [F.max(F.when(hit & (F.col("__side") == 0), F.col("__v"))).alias(f"__a{i}"),
                 F.max(F.when(hit & (F.col("__side") == 1), F.col("__v"))).alias(f"__z{i}"),
                 F.max(F.when(hit, F.col("__frac"))).alias(f"__f{i}")]
    pair = picked.groupBy(*g).agg(*aggs)
    return pair.select(*g, *[lerp(F.col(f"__a{i}"), F.col(f"__z{i}"), F.col(f"__f{i}")).alias(name)
                             for i, name in enumerate(names)])


def overall_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], levels: int = 2) -> DataFrame:
    """One row with one column per entry of ``probs`` over all rows.

    Without a group key the targets are two rows a probability, so they are
    broadcast and each level reads the scan again: only bucket counts are
    shuffled, and of the values only those in the innermost chosen buckets, at
    most 2^(52 - 16 * levels) distinct ones a target.  NULL and NaN are
    ignored; without any value the result is NULL.
    """
    vals = with_order_buckets(df.select(F.col(value).cast("double").alias("__v"))
                              .where(F.col("__v").isNotNull() & ~F.isnan("__v")), "__v", levels)
    names = list(probs)
    target = ["__q", "__side", "__frac", "__k"]
    end = lambda w, b: F.sum("__cnt").over(w.orderBy(b).rowsBetween(Window.unboundedPreceding, 0))

    # bucket counts: at most 2^17 rows a binary exponent
    every = Window.partitionBy()
    hist = vals.groupBy("__b0").agg(F.count(F.lit(1)).alias("__cnt")) \
        .withColumns({"__end": end(every, "__b0"), "__n": F.sum("__cnt").over(every)})
    tgt = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(probs[name])).alias("p"), F.lit(side).alias("side"))
                    for i, name in enumerate(names) for side in (0, 1)])
    h = F.col("__t.p") * (F.col("__n") - 1).cast("double")
    ranks = hist.withColumn("__t", F.explode(tgt)).withColumn("__h", h).withColumn("__k0", F.floor("__h").cast("long")) \
        .withColumn("__k", F.when(F.col("__t.side") == 0, F.col("__k0")).otherwise(F.least(F.col("__k0") + 1, F.col("__n") - 1)))
    hit = (F.col("__k") < F.col("__end")) & (F.col("__k") >= F.col("__end") - F.col("__cnt"))
    inside = (F.col("__k") - (F.col("__end") - F.col("__cnt"))).alias("__k")
    chosen = ranks.where(hit).select(F.col("__t.q").alias("__q"), F.col("__t.side").alias("__side"),
                                     (F.col("__h") - F.col("__k0").cast("double")).alias("__frac"), inside, "__b0")
    path, one = ["__b0"], Window.partitionBy("__q", "__side")
    for i in range(1, levels):
        b = f"__b{i}"
        counts = vals.join(F.broadcast(chosen), path).groupBy(*target, *path, b).agg(F.count(F.lit(1)).alias("__cnt"))
        chosen = counts.withColumn("__end", end(one, b)).where(hit).select("__q", "__side", "__frac", inside, *path, b)
        path.append(b)
    last = vals.join(F.broadcast(chosen), path).groupBy(*target, "__v").agg(F.count(F.lit(1)).alias("__cnt"))
    picked = last.repartition(1).withColumn("__end", end(one, "__v")).where(hit)
    at = lambda i, side, c: F.max(F.when((F.col("__q") == i) & (F.col("__side") == side), F.col(c)))
    row = picked.groupBy().agg(*[a for i, _ in enumerate(names) for a in (
        at(i, 0, "__v").alias(f"__a{i}"), at(i, 1, "__v").alias(f"__z{i}"), at(i, 0, "__frac").alias(f"__f{i}"))])
    return row.select(*[lerp(F.col(f"__a{i}"), F.col(f"__z{i}"), F.col(f"__f{i}")).alias(name) for i, name in enumerate(names)])


def describe(df: DataFrame, group_by: Sequence[str], value: str, digits: int | None = 1,
             stats: Sequence[str] = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")) -> DataFrame:
    """pandas ``groupby(...)[value].describe()`` with optional numpy-style rounding.

    ``std`` is the sample standard deviation; count is cast to double like pandas.
    """
    g = list(group_by)
    raw = F.col(value).cast("double")
    # NaN counts as missing (pandas); a group whose values are all missing
    # stays, with count 0; rows with a null group key are dropped
    base = df.select(*g, F.when(F.isnan(raw), F.lit(None)).otherwise(raw).alias("__dv"))
    for c in g:
        base = base.where(F.col(c).isNotNull())
    v = F.col("__dv")
    aggs = {
        "count": F.count(v).cast("double"),
        "mean": F.avg(v),
        "std": F.stddev_samp(v),
        "min": F.min(v),
        "max": F.max(v),
    }
    simple = base.groupBy(*g).agg(*[aggs[s].alias(s) for s in aggs])
    qnames = {k: p for k, p in DESCRIBE_PROBS.items() if k in stats}
    if qnames:
        out = simple.join(exact_quantiles(base, g, "__dv", qnames), on=g, how="left")
    else:
        out = simple
    cols = []
    for s in stats:
        c = F.col(s)
        if digits is not None and s != "count":
            c = round_half_even(c, digits)
        cols.append(c.alias(s))
    return out.select(*g, *cols)


def iqr_filter(df: DataFrame, group_by: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Keep rows with Q1 - k*IQR <= value <= Q3 + k*IQR within their group.

    The per-group bounds are a one-row-per-group table joined back on the group
    key; AQE broadcasts it when its measured size is small and otherwise splits
    skewed partitions.
    """
    g = list(group_by)
    q = exact_quantiles(df, g, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    bounds = q.select(*g, (F.col("q1") - F.lit(k) * iqr).alias("__lb"),
                      (F.col("q3") + F.lit(k) * iqr).alias("__ub"))
    ren = {c: f"__g{i}" for i, c in enumerate(g)}
    bounds = bounds.select(*[F.col(c).alias(ren[c]) for c in g], "__lb", "__ub")
    cond = [df[c].eqNullSafe(F.col(ren[c])) for c in g]
    joined = df.join(bounds, on=cond, how="inner")
    return (joined.where((F.col(value) >= F.col("__lb")) & (F.col(value) <= F.col("__ub")))
            .select(*[df[c] for c in df.columns]))


def median_by(df: DataFrame, group_by: Sequence[str], value: str, out: str = "median",
              digits: int | None = None) -> DataFrame:
    """groupby().median()."""
    q = exact_quantiles(df, group_by, value, {out: 0.5})
    if digits is not None:
        q = q.withColumn(out, round_half_even(out, digits))
    return q
