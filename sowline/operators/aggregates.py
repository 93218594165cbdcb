"""Aggregation operators (A1-A29 that need more than one ``F.*`` call).

All are single ``groupBy().agg()`` passes (partial aggregation on the map
side), except the zero-fill which is a left join from a parameter-sized
calendar dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sowline.functions.numeric import round_half_up


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def sum_when(cond: Column, value: Column | str | int = 1, otherwise=0) -> Column:
    """SUM(CASE WHEN cond THEN value ELSE 0 END)."""
    v = F.col(value) if isinstance(value, str) else F.lit(value) if not isinstance(value, Column) else value
    return F.sum(F.when(cond, v).otherwise(F.lit(otherwise)))


def zero_fill(dim: DataFrame, facts: DataFrame, on: Sequence[tuple[str, str]],
              value: str, group_right: Sequence[str] = (), mode: str = "faithful",
              out: str = "counted") -> DataFrame:
    """Calendar LEFT JOIN facts, SUM(value) with 0 for missing.

    ``on``: pairs (dim column, fact column).
    * ``faithful`` (M2/M3): group by the dim's first column (the day) plus
      ``group_right`` taken from the *fact* side, as the source does, so
      unmatched dim rows of a day collapse into one row with null fact labels;
    * ``dense``: group by the dim columns only (the caller puts every label in
      the dim), one row per dim row.
    The dim is parameter-sized (days x sites) and, being the preserved side of
    the outer join, never the build side; the facts are pre-aggregated to the
    dim grain, so they are the small build side (broadcast by AQE when their
    measured size allows, sort-merge otherwise).
    """
    d_alias, f_alias = dim.alias("d"), facts.alias("f")
    cond = [F.col(f"d.{a}") == F.col(f"f.{b}") for a, b in on]
    j = d_alias.join(f_alias, cond, "left")
    dim_keys = [F.col(f"d.{c}").alias(c) for c in dim.columns]
    if mode == "faithful":
        first = dim.columns[0]
        keys = [F.col(f"d.{first}").alias(first)] + [F.col(f"f.{c}").alias(c) for c in group_right]
    elif mode == "dense":
        keys = dim_keys
    else:
        raise ValueError(mode)
    return j.groupBy(*keys).agg(F.coalesce(F.sum(F.col(f"f.{value}")), F.lit(0)).alias(out))


def progress_status(df: DataFrame, group_by: Sequence[str], entry: str, done: Column,
                    digits: int = 2) -> DataFrame:
    """Total entries, filled entries, status bucket and percent.

    total = COUNT(entry) (nulls ignored), filled = SUM(done ? 1 : 0),
    pct = filled * 100.0 / total; status 'Not Start' (0), 'In Progress'
    (between), 'Completed' (100); null when there is no entry.
    """
    agg = df.groupBy(*_cols(group_by)).agg(
        F.count(F.col(entry)).alias("total_entries"),
        F.sum(F.when(done, 1).otherwise(0)).alias("filled_entries"))
    pct = F.try_divide(F.col("filled_entries").cast("double") * F.lit(100.0),
                       F.col("total_entries").cast("double"))
    return (agg.withColumn("__pct", pct)
            .withColumn("fill_status",
                        F.when(F.col("__pct") == 0, "Not Start")
                        .when((F.col("__pct") > 0) & (F.col("__pct") < 100), "In Progress")
                        .when(F.col("__pct") == 100, "Completed"))
            .withColumn("filled_pct", round_half_up(F.col("__pct"), digits))
            .drop("__pct"))


def null_profile(df: DataFrame) -> DataFrame:
    """Number of nulls in each column, as (column, n_null) rows."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, n_null)")


def histogram(df: DataFrame, value: str, edges: Sequence[float], group_by: Sequence[str] = (),
              out: str = "n") -> DataFrame:
    """Counts per bin with explicit, increasing edges.

    Bin i holds edges[i] <= v < edges[i+1]; the last bin is closed on the
    right (numpy ``histogram``); values outside all bins are dropped.
    """
    v = F.col(value)
    b = None
    last = len(edges) - 2
    for i in range(len(edges) - 1):
        lo, hi = float(edges[i]), float(edges[i + 1])
        cond = (v >= lo) & ((v <= hi) if i == last else (v < hi))
        b = F.when(cond, F.lit(i)) if b is None else b.when(cond, F.lit(i))
    binned = df.withColumn("bin", b).where(F.col("bin").isNotNull())
    lo_arr = F.array(*[F.lit(float(e)) for e in edges[:-1]])
    hi_arr = F.array(*[F.lit(float(e)) for e in edges[1:]])
    return (binned.groupBy(*_cols(group_by), "bin").agg(F.count(F.lit(1)).alias(out))
            .withColumn("bin_lo", F.element_at(lo_arr, F.col("bin") + 1))
            .withColumn("bin_hi", F.element_at(hi_arr, F.col("bin") + 1)))


def describe_string(df: DataFrame, group_by: Sequence[str], value: str) -> DataFrame:
    """Pandas describe() of a text column: count, unique, top, freq.

    ``top`` is the most frequent value; ties go to the smallest value (pandas
    leaves them unspecified).  Two aggregations, both partial.
    """
    g = _cols(group_by)
    per_value = df.where(F.col(value).isNotNull()).groupBy(*g, value).agg(
        F.count(F.lit(1)).alias("__f"))
    return per_value.groupBy(*g).agg(
        F.sum("__f").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by(F.col(value), F.struct((-F.col("__f")).alias("nf"), F.col(value).alias("v"))).alias("top"),
        F.max("__f").alias("freq"))


def string_agg(col: str, sep: str = ",", distinct: bool = True, sort: bool = True) -> Column:
    """Comma list of the group's values (sorted for a stable result)."""
    arr = F.collect_set(F.col(col)) if distinct else F.collect_list(F.col(col))
    if sort:
        arr = F.array_sort(arr)
    return F.nullif(F.array_join(arr.cast("array<string>"), sep), F.lit(""))
