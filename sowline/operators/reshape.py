"""Pivot and reshape (R1-R4).  Pivot values are always listed explicitly, so the
plan is fixed before the data is read (no extra job to discover values)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_sum(df: DataFrame, index: Sequence[str], category: str, columns: Mapping[str, object],
              value: str | None = None, null_column: str | None = None,
              fill_zero: bool = True) -> DataFrame:
    """R2: SUM(CASE WHEN category = v THEN value END) per listed value.

    ``columns`` maps output name -> category value.  ``null_column`` also
    gets a column for rows whose category is null (what PIVOT cannot do).
    With ``fill_zero`` missing combinations are 0 (the CASE ... ELSE 0 form);
    otherwise null.
    """
    val = F.lit(1) if value is None else F.col(value)
    other = F.lit(0) if fill_zero else F.lit(None)
    aggs = [F.sum(F.when(F.col(category) == F.lit(v), val).otherwise(other)).alias(name)
            for name, v in columns.items()]
    if null_column:
        aggs.append(F.sum(F.when(F.col(category).isNull(), val).otherwise(other)).alias(null_column))
    return df.groupBy(*index).agg(*aggs)


def pivot_table(df: DataFrame, index: Sequence[str], category: str, columns: Mapping[str, object],
                value: str, agg: str = "sum") -> DataFrame:
    """Pandas ``pivot(index, columns, values)``: one cell per (index, category);
    a missing combination is null."""
    fn = getattr(F, agg)
    return df.groupBy(*index).agg(*[
        fn(F.when(F.col(category) == F.lit(v), F.col(value))).alias(name)
        for name, v in columns.items()])


def pivot_listagg(df: DataFrame, index: Sequence[str], category: str, columns: Mapping[str, object],
                  value: str, sep: str = ",") -> DataFrame:
    """PIVOT(STRING_AGG(value, ',')) per listed category; distinct values in
    sorted order so the text is stable; null when a category has no value."""
    def agg(v) -> Column:
        arr = F.array_sort(F.collect_set(F.when(F.col(category) == F.lit(v), F.col(value))))
        return F.nullif(F.array_join(arr.cast("array<string>"), sep), F.lit(""))
    return df.groupBy(*index).agg(*[agg(v).alias(name) for name, v in columns.items()])
