"""Chat formatting with Spark expressions only.

A conversation becomes one text.  Turns are sorted by turn number, adjacent
turns of one role share one block:

    <s>[role]text<+>text</s><s>[role]text</s>

``OPEN role HEAD`` starts a block, ``CLOSE`` ends it, ``JOIN`` stands between
the turns of one block.  Inside roles and texts a backslash and the
characters ``<``, ``[`` and ``]`` are replaced by two-character codes
(``ESCAPES``), so that no text can hold a mark and every text can be read back.

Turns are first put together in parts of ``PART_TURNS`` consecutive turns,
then parts into conversations: a part is bounded, and a conversation row is as
long as the conversation itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE, JOIN = "<s>[", "]", "</s>", "<+>"
PART_TURNS = 256


# Fixed values of the template: what stands for a character inside texts and
# roles.  The backslash comes first when escaping and last when reading back.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c"))


def escape(text: Column) -> Column:
    """``text`` without any of the characters that marks are made of."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _chain(rows: Column) -> Column:
    """One struct (first, last, body) from an array of such structs: bodies in
    order, joined within a block where roles meet, else by a new block."""
    empty = F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"),
                     F.array().cast("array<string>").alias("body"))
    return F.aggregate(
        rows, empty,
        lambda acc, r: F.struct(
            F.coalesce(acc["first"], r["first"]).alias("first"), r["last"].alias("last"),
            F.concat(acc["body"], F.when(acc["last"].isNull(), F.array(r["body"]))
                     .when(acc["last"] == r["first"], F.array(F.lit(JOIN), r["body"]))
                     .otherwise(F.array(F.lit(CLOSE + OPEN), r["first"], F.lit(HEAD), r["body"]))).alias("body")),
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"), F.array_join(acc["body"], "").alias("body")))


def formatted(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted)`` of every conversation.

    ``turns`` has conv_id, turn, role and text, one row a turn.  NULL texts
    and roles are empty; a NULL conv_id is a conversation like any other; NULL
    turn numbers come first; rows of one turn number are ordered by role, then
    text, and repeated rows are turns of their own.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.floor(F.col("turn") / PART_TURNS)
    parts = turns.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    parts = parts.withColumn("rows", F.transform("turns", lambda t: F.struct(
        escape(t["role"]).alias("first"), escape(t["role"]).alias("last"), escape(t["text"]).alias("body"))))
    parts = parts.select("conv_id", "part", _chain(F.col("rows")).alias("x"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "x"))).alias("parts"))
    whole = whole.withColumn("x", _chain(F.transform("parts", lambda p: p["x"])))
    return whole.select("conv_id", F.concat(F.lit(OPEN), "x.first", F.lit(HEAD), "x.body", F.lit(CLOSE)).alias("formatted"))


def read_back(texts: DataFrame, column: str = "formatted") -> DataFrame:
    """``texts`` plus ``turns``: array of (role, text, loss) of every turn,
    read from the formatted text alone; ``loss`` marks assistant turns."""
    inner = F.col(column).substr(F.lit(len(OPEN) + 1), F.length(column) - len(OPEN + CLOSE))
    blocks = F.split(inner, r"</s><s>\[")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, HEAD, 1)
        body = block.substr(F.length(role) + 2, F.length(block))
        return F.transform(F.split(body, r"<\+>"), lambda t: F.struct(
            unescape(role).alias("role"), unescape(t).alias("text"), (role == "assistant").alias("loss")))

    return texts.withColumn("turns", F.flatten(F.transform(blocks, turns)))
