"""Exact distinct counts over several grains from one pass.

A whole-number id is a bit: its word is ``id >> 6``, its place ``id & 63``.
Words are built once at the finest grain and OR-ed up the levels, so a coarser
grain reads words instead of counting the rows again.  A word row stands for
up to 64 ids and is dealt by (keys, word): a hot group is many rows over many
tasks, and every step is a hash aggregation with map-side combine.  Ids that
lie far apart cost one row each, as a plain distinct does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, BITS = "__word", "__bits"


def id_words(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """One row per ``keys`` and word with the bits of its ids.

    ``id_col`` is a whole number (any sign).  A NULL key is a group of its
    own; NULL ids set no bit, but their group stays with a count of 0.
    """
    i = F.col(id_col).cast("long")
    place = i.bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    return df.select(*keys, F.shiftright(i, 6).alias(WORD), bit.alias(BITS)) \
        .groupBy(*keys, WORD).agg(F.bit_or(BITS).alias(BITS))


def merge_words(words: DataFrame, keys: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """The words of a coarser grain: ``keys`` are columns of ``words`` or
    name -> expression over them."""
    named = [c.alias(n) for n, c in keys.items()] if isinstance(keys, Mapping) else [F.col(k) for k in keys]
    return words.groupBy(*named, WORD).agg(F.bit_or(BITS).alias(BITS))


def count_words(words: DataFrame, keys: Sequence[str], out: str = "n_distinct") -> DataFrame:
    """COUNT(DISTINCT id) per ``keys``, which must be the grain of ``words``."""
    return words.groupBy(*keys).agg(F.coalesce(F.sum(F.bit_count(BITS).cast("long")), F.lit(0).cast("long")).alias(out))
