"""Window operators W1-W7.

Scale notes
-----------
* ``next_in_group`` (lead, W3) can split each group into ordered sub-groups
  (``split_by``, e.g. the hour of the start time).  Rows are then only ever
  sorted inside one sub-group, and the last row of each sub-group borrows the
  first value of the next non-empty sub-group from a one-row-per-sub-group
  table.  A hot machine-day therefore never lands in a single task.
* ``running_total`` is meant for pre-aggregated (day-grain) input, where a
  partition holds at most one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def running_total(df: DataFrame, value: str, partition_by: Sequence[str], order_by: Sequence[str],
                  out: str = "running_total") -> DataFrame:
    """SUM(value) OVER (PARTITION BY ... ORDER BY ... ROWS UNBOUNDED PRECEDING..CURRENT ROW)."""
    w = (Window.partitionBy(*_cols(partition_by)).orderBy(*_cols(order_by))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.sum(value).over(w))


def next_in_group(df: DataFrame, value: str, partition_by: Sequence[str], order_by: Sequence[str],
                  out: str, split_by: Column | None = None) -> DataFrame:
    """LEAD(value) within ``partition_by`` ordered by ``order_by``.

    ``split_by`` must be monotone in the ordering (for example the hour bucket
    of the ordering timestamp).  With it, the sort happens per
    (group, sub-group) and the cross-sub-group hand-off goes through a small
    table, so no task ever holds a whole hot group.
    """
    part = _cols(partition_by)
    order = _cols(order_by)
    if split_by is None:
        w = Window.partitionBy(*part).orderBy(*order)
        return df.withColumn(out, F.lead(value).over(w))

    sub = "__sub"
    keyed = df.withColumn(sub, split_by)
    keys = part + [sub]
    w = Window.partitionBy(*keys).orderBy(*order)
    inner = (keyed
             .withColumn(out, F.lead(value).over(w))
             .withColumn("__last", F.lead(F.lit(1)).over(w).isNull()))
    # one row per sub-group with its first value (partial aggregation), then
    # the first value of the following non-empty sub-group.  When the carried
    # value is the leading ordering column, the first value is simply its
    # minimum (a hash aggregate); otherwise min_by over the ordering.
    if value == order[0]:
        first = F.min(F.col(value))
    else:
        first = F.min_by(F.col(value), F.struct(*[F.col(c) for c in order]))
    firsts = keyed.groupBy(*keys).agg(first.alias("__first"))
    wsub = Window.partitionBy(*part).orderBy(sub)
    hand_off = firsts.select(*keys, F.lead("__first").over(wsub).alias("__next_first"))
    joined = inner.join(hand_off, on=keys, how="left")
    return (joined
            .withColumn(out, F.when(F.col("__last"), F.col("__next_first")).otherwise(F.col(out)))
            .drop("__last", "__next_first", sub))


def gap_to_next(df: DataFrame, start: str, finish: str, partition_by: Sequence[str],
                order_by: Sequence[str], out_gap: str = "gap", out_floor: str = "gap_floor0",
                split_by: Column | None = None) -> DataFrame:
    """Next start minus own finish; negatives (overlap) and the last event (null) -> 0."""
    nxt = next_in_group(df, start, partition_by, order_by, "__next_start", split_by=split_by)
    gap = F.col("__next_start") - F.col(finish)
    return (nxt.withColumn(out_gap, gap)
            .withColumn(out_floor, F.when(F.col(out_gap) > 0, F.col(out_gap)).otherwise(F.lit(0)))
            .drop("__next_start"))


def pct_change(df: DataFrame, value: str, order_by: str, partition_by: Sequence[str] = (),
               out: str = "pct_change") -> DataFrame:
    """pandas 2.x ``pct_change``: previous non-null value (forward fill), x / prev - 1.

    Division by zero gives null here (pandas gives inf).  ``partition_by`` keeps
    the window distributed when the series is split by scenario or crop.
    """
    w = Window.partitionBy(*_cols(partition_by)).orderBy(order_by)
    prev = F.last(F.col(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cur = F.last(F.col(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.try_divide(cur, prev) - F.lit(1.0))


def duplicate_flag(df: DataFrame, subset: Sequence[str], out: str = "is_duplicate") -> DataFrame:
    """pandas ``duplicated(subset, keep=False)``: every copy of a repeated key is flagged.

    Computed as a count per key joined back (partial aggregation), not as a
    window, so a hot key is pre-aggregated before the shuffle.  Null keys are
    matched to each other, as pandas does.
    """
    keys = _cols(subset)
    ren = {c: f"__k{i}" for i, c in enumerate(keys)}
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(*[F.col(c).alias(ren[c]) for c in keys], "__n")
    cond = [df[k].eqNullSafe(F.col(ren[k])) for k in keys]
    joined = df.join(counts, on=cond, how="left")
    return joined.select(*[df[c] for c in df.columns], (F.col("__n") > 1).alias(out))
