"""Merges whose NULL names match NULL names, kept as classes.

A pandas merge pairs every row without a name with every row without a name:
its output grows with the product.  Here the two sides are kept apart and only
their classes meet: one row per name, NULL being a name, with how often it
occurs on either side.  Counts, sums and per-row matches of the merged table
follow from the classes; pairs are made only when asked for.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sowline.operators.skew import split_lookup

KEY = "__key"


def _keyed(df: DataFrame, on: str) -> DataFrame:
    # a struct is never NULL itself, and two structs of NULL are equal
    return df.withColumn(KEY, F.struct(F.col(on).alias("name")))


def merge_classes(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                  left_sums: Mapping[str, Column] | None = None, right_aggs: Mapping[str, Column] | None = None,
                  out: str = "name") -> DataFrame:
    """One row per name of ``left``: ``n_left``, ``n_right`` (0 without a
    match) and ``n_rows``, the rows of the left merge for it.

    ``left_sums`` (name -> column) are summed over the merged rows, so each
    left row counts once per match (once without one); ``right_aggs`` (name ->
    aggregate) describe the matches and are NULL without one.  Both sides are
    aggregated before they meet: output and work are linear in the input.
    """
    ls, ra = dict(left_sums or {}), dict(right_aggs or {})
    lc = _keyed(left, left_on).groupBy(KEY).agg(F.count(F.lit(1)).alias("n_left"), *[F.sum(c).alias(n) for n, c in ls.items()])
    rc = _keyed(right, right_on).groupBy(KEY).agg(F.count(F.lit(1)).alias("n_right"), *[c.alias(n) for n, c in ra.items()])
    times = F.greatest(F.coalesce("n_right", F.lit(0)), F.lit(1))
    return lc.join(rc, KEY, "left").select(
        F.col(f"{KEY}.name").alias(out), "n_left", F.coalesce("n_right", F.lit(0).cast("long")).alias("n_right"),
        (F.col("n_left") * times).alias("n_rows"), *[(F.col(n) * times).alias(n) for n in ls], *ra)


def attach_class(left: DataFrame, right: DataFrame, left_on: str, right_on: str, aggs: Mapping[str, Column]) -> DataFrame:
    """Every row of ``left`` once, with ``aggs`` over the ``right`` rows of its
    name (NULL names included); heavy names are salted."""
    classes = _keyed(right, right_on).groupBy(KEY).agg(*[c.alias(n) for n, c in aggs.items()])
    return split_lookup(_keyed(left, left_on), classes, [KEY]).drop(KEY)


def expand(left: DataFrame, right: DataFrame, left_on: str, right_on: str, max_rows: int) -> DataFrame:
    """The merged rows themselves; refused when they are more than ``max_rows``.

    ``right_on`` is dropped; other columns must differ in name.
    """
    n = merge_classes(left, right, left_on, right_on).agg(F.sum("n_rows")).scalar()
    total = left.sparkSession.range(1).select(n.alias("n")).first().n or 0
    if total > max_rows:
        raise ValueError(f"the merge has {total} rows, more than {max_rows}; use its classes")
    return _keyed(left, left_on).join(_keyed(right, right_on).drop(right_on), KEY, "left").drop(KEY)
