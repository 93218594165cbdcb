"""Identifier extraction from free text.

Every text is scanned whole.  Numbers, underscore names, "name Lnn" names
and "a - b (n sets)" ranges are pulled out with ``regexp_extract_all``
(``java_pattern`` gives Python's ``re`` classes to Java); each range expands
to every id in it, level by level, so no task builds one enormous array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The four patterns of the source extraction.
ID_PATTERN = r"\b\d+\b"
BLOCK_PATTERN = r"\b\w+_\w+\b"
NAME_PATTERN = r"\b\w+ L\d+\b"
RANGE_PATTERN = r"(\d+)\s*-\s*(\d+)\s*\(.*?(\d+)\s*sets.*?\)"

RANGE_CHUNK = 1 << 16

# Python's classes of str patterns, spelled for Java: \w is every letter,
# number and underscore (no combining marks), \s also holds the separators
# 0x1C-0x1F, and "." stops at a line feed alone (Unix lines).
WORD = r"[\p{L}\p{N}_]"


def java_pattern(pattern: str) -> str:
    """One of the patterns above as a Java pattern of the same meaning.

    Every ``\\b`` of the patterns stands at an end, next to a word character.
    """
    if pattern.startswith(r"\b"):
        pattern = f"(?<!{WORD})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?!{WORD})"
    for python, java in ((r"\w", WORD), (r"\d", r"\p{Nd}"), (r"\s", r"[\s\x1C-\x1F]")):
        pattern = pattern.replace(python, java)
    return "(?Ud)" + pattern


def _all(text, pattern, group=0):
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(group))


def _expand(rows: DataFrame, keep: Sequence[str], chunk: int) -> DataFrame:
    """``(keep..., __id)`` for every id of the ranges ``__a`` to ``__b``.

    Offsets are cut into chunks of ``chunk`` in as many levels as the widest
    possible range needs, so no array is longer than ``chunk`` (or 2^16 in the
    first level), however wide the range.
    """
    out = rows.withColumn("__at", F.lit(0).cast("long")).withColumn(
        "__end", (F.col("__b") - F.col("__a")).try_cast("long")).where(F.col("__end").isNotNull())
    steps = [chunk]
    while steps[-1] * (1 << 16) < 1 << 62:
        steps.append(steps[-1] * min(chunk, 1 << 16))
    for step in reversed(steps):
        out = out.select(*keep, "__a", F.explode(F.sequence("__at", "__end", F.lit(step).cast("long"))).alias("__at"), "__end")
        out = out.withColumn("__end", F.col("__at") + F.least(F.col("__end") - F.col("__at"), F.lit(step - 1).cast("long")))
    # the ids of one chunk are spread by document and chunk
    out = out.repartition(*keep, "__a", "__at")
    out = out.select(*keep, "__a", F.explode(F.sequence("__at", "__end")).alias("__at"))
    return out.select(*keep, (F.col("__a") + F.col("__at")).alias("__id"))


def extract_ids(df: DataFrame, text: str, keep: Sequence[str],
                range_chunk: int = RANGE_CHUNK) -> DataFrame:
    """Rows (keep..., set_id, block_name, set_name): one per extracted item, deduplicated.

    ``set_id`` is numeric (DECIMAL(38,0)); exactly one of the three item
    columns is set per row.  Rows of a text with nothing in it vanish.
    """
    keep = list(keep)
    base = df.select(*keep, F.col(text).alias("__t")).where(F.col("__t").isNotNull())
    simple = base.select(
        *keep,
        F.concat(
            F.transform(_all("__t", ID_PATTERN), lambda x: F.struct(
                x.alias("set_id"), F.lit(None).cast("string").alias("block_name"),
                F.lit(None).cast("string").alias("set_name"))),
            F.transform(_all("__t", BLOCK_PATTERN), lambda x: F.struct(
                F.lit(None).cast("string").alias("set_id"), x.alias("block_name"),
                F.lit(None).cast("string").alias("set_name"))),
            F.transform(_all("__t", NAME_PATTERN), lambda x: F.struct(
                F.lit(None).cast("string").alias("set_id"),
                F.lit(None).cast("string").alias("block_name"), x.alias("set_name"))),
        ).alias("__items"))
    items = simple.select(*keep, F.explode("__items").alias("__i")).select(
        *keep, F.col("__i.set_id").try_cast("decimal(38,0)").alias("set_id"),
        F.col("__i.block_name").alias("block_name"), F.col("__i.set_name").alias("set_name"))

    # ranges: start, end, count; kept when end >= start and count > 1
    # whole range matches in one pass over the text; the three groups are then
    # read from each (short) match -- the pattern has no look-around or end
    # anchor, so re-matching a match yields the same groups
    rng = base.select(*keep, F.explode(_all("__t", RANGE_PATTERN, 0)).alias("__m"))
    grp = lambda k: F.regexp_extract("__m", java_pattern(RANGE_PATTERN), k)
    rng = (rng.select(*keep, grp(1).try_cast("decimal(38,0)").alias("__a"),
                      grp(2).try_cast("decimal(38,0)").alias("__b"),
                      grp(3).try_cast("decimal(38,0)").alias("__n"))
           .where((F.col("__b") >= F.col("__a")) & (F.col("__n") > 1)))
    expanded = _expand(rng, keep, range_chunk)
    range_items = expanded.select(
        *keep, F.col("__id").cast("decimal(38,0)").alias("set_id"),
        F.lit(None).cast("string").alias("block_name"), F.lit(None).cast("string").alias("set_name"))
    return items.unionByName(range_items).dropDuplicates()
