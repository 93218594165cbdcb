"""Equi joins that keep a hot key out of a single task.

A key that holds more than ``1 / parts`` of all rows is heavy; there are
fewer than ``parts`` of these, whatever the data, so their list can be
broadcast.  Rows of a heavy key are dealt over ``SALTS`` salts and the key's
lookup row is repeated once a salt; all other keys have salt 0.  Rows whose
key is NULL match nothing and are dealt over the salts too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than this share of the rows (1 / PARTS) is dealt over SALTS.
PARTS = 200
SALTS = 64


def heavy_keys(rows: DataFrame, keys: Sequence[str], parts: int = PARTS) -> DataFrame:
    """Distinct key values with more than ``1 / parts`` of all rows: fewer
    than ``parts`` rows.  NULL keys are no keys."""
    k = list(keys)
    counts = rows.select(*k).dropna(subset=k).groupBy(*k).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("__n") * parts > total).select(*k)


def split_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left",
                 parts: int = PARTS, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``lookup`` that shares their ``keys``.

    ``lookup`` has one row a key (aggregate first) and the same key names;
    rows with a NULL key match nothing.  ``how`` is ``left`` or ``inner``.
    Every row of ``rows`` comes back once (``left``) or at most once.
    ``counted`` is where heavy keys are counted: ``rows`` themselves, or a table
    that ``rows`` was made of by other lookups (cheaper, and none is missed
    that held ``1 / parts`` there).
    """
    if how not in ("left", "inner"):
        raise ValueError("split_lookup supports left and inner")
    k = list(keys)
    extra = [c for c in lookup.columns if c not in k]
    heavy = F.broadcast(heavy_keys(rows if counted is None else counted, k, parts).withColumn("__heavy", F.lit(True)))
    absent = F.lit(False)
    for c in k:
        absent = absent | F.col(c).isNull()
    # of the row's content and task: the same again if a task runs again
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]) % 65536 + F.spark_partition_id(), F.lit(SALTS)).cast("int")
    left = rows.join(heavy, k, "left").withColumn("__salt", F.when(F.col("__heavy") | absent, salt).otherwise(F.lit(0))).drop("__heavy")
    all_salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    right = lookup.dropna(subset=k).join(heavy, k, "left") \
        .withColumn("__salt", F.explode(F.when(F.col("__heavy"), all_salts).otherwise(F.array(F.lit(0))))).drop("__heavy")
    return left.join(right, [*k, "__salt"], how).select(*rows.columns, *extra)


def split_lookups(rows: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str], str]], parts: int = PARTS) -> DataFrame:
    """Several ``split_lookup`` one after another, as (lookup, keys, how) with
    keys of ``rows``; every key is counted on ``rows``."""
    out = rows
    for lookup, keys, how in lookups:
        out = split_lookup(out, lookup, keys, how, parts, counted=rows)
    return out
