"""Ordered text aggregates of bounded size.

``listagg`` builds a key's whole text in one task.  Here the distinct values of
a key are numbered by range partitions, cut into parts of ``size`` values, and
each part is one row; a hot key is many rows over many tasks.  The parts put
after each other, with the separator between, are the text of ``listagg``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowline.operators.ordered import row_numbers

PART_VALUES = 1000


def text_parts(df: DataFrame, keys: Sequence[str], value: str, sep: str = ",", size: int = PART_VALUES) -> DataFrame:
    """``keys``, ``part`` (from 0), ``n_values`` and ``text``: the distinct
    values in ascending (byte) order, ``size`` a part.

    The size is the same for every key.  A NULL key is a key of its own, NULL
    values are left out, and a key without a value has no part.
    """
    v = df.select(*keys, F.col(value).cast("string").alias("__v")).where(F.col("__v").isNotNull()).distinct()
    ranked = row_numbers(v, [F.col("__v").asc()], out="__rank", within=keys)
    part = F.floor((F.col("__rank") - 1) / F.lit(size)).cast("long")
    values = F.transform(F.array_sort(F.collect_list(F.struct("__rank", "__v"))), lambda x: x["__v"])
    return ranked.groupBy(*keys, part.alias("part")).agg(F.count(F.lit(1)).alias("n_values"), F.array_join(values, sep).alias("text"))


def wide_parts(df: DataFrame, index: Sequence[str], category: str, columns: Mapping[str, object], value: str,
               sep: str = ",", size: int = PART_VALUES) -> DataFrame:
    """One row per ``index`` and part, one text column per listed
    category; NULL where a category has no such part."""
    listed = df.where(F.col(category).isin(list(columns.values())))
    parts = text_parts(listed, [*index, category], value, sep, size)
    return parts.groupBy(*index, "part").agg(*[
        F.max(F.when(F.col(category) == F.lit(c), F.col("text"))).alias(name) for name, c in columns.items()])


def whole_text(parts: DataFrame, keys: Sequence[str], sep: str = ",") -> DataFrame:
    """The text of ``listagg`` from its parts: one row a key, which has to hold it."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    return parts.groupBy(*keys).agg(F.array_join(ordered, sep).alias("text"))
