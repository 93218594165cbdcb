"""Ordered results without a one-task window.

Rows are dealt by sampled range bounds of the ordering columns, sorted inside
each partition and numbered there; a partition's rows are then moved on by the
counts of the partitions before it.  The carry holds one row a partition (or a
group's part of one), so no task sees a whole table or a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sowline.session import materialize

_LOCAL = (1 << 33) - 1          # monotonically_increasing_id: partition << 33 | row


def _sorted_parts(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in range partitions, each sorted, with ``__pid`` and ``__at``.

    Equal ordering values are told apart by the row's place in the input, so a
    value that a third of all rows hold is dealt over several partitions.
    Stored once: the bounds are sampled, and both uses must see the same ones.
    """
    tie = "__tie"
    keyed = df.withColumn(tie, F.monotonically_increasing_id())
    cols = [*order, F.col(tie)]
    dealt = keyed.repartitionByRange(*cols).sortWithinPartitions(*cols).drop(tie)
    n = F.monotonically_increasing_id()
    return materialize(dealt.withColumn("__id", n)).withColumn("__pid", F.shiftright("__id", 33)) \
        .withColumn("__at", F.col("__id").bitwiseAND(F.lit(_LOCAL))).drop("__id")


def row_numbers(df: DataFrame, order: Sequence[Column], out: str = "row_number",
                within: Sequence[str] = ()) -> DataFrame:
    """``df`` plus ``out``: ROW_NUMBER() OVER ([PARTITION BY within] ORDER BY order).

    ``order`` are ordering columns (``F.col("x").desc_nulls_last()`` ...; they
    may be columns that a later select hides).  Ties get different numbers in
    an unspecified order, as in SQL.
    """
    group = list(within)
    parts = _sorted_parts(df, [*[F.col(c).asc() for c in group], *order])
    # named apart: a NULL group is a group as any other and must match itself
    ids = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]
    runs = parts.groupBy(*ids, "__pid").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*[f"__g{i}" for i in range(len(group))]).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = runs.select(*[f"__g{i}" for i in range(len(group))], F.col("__pid").alias("__p"), "__first",
                        F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    on = parts["__pid"] == carry["__p"]
    for i, c in enumerate(group):
        on = on & parts[c].eqNullSafe(carry[f"__g{i}"])
    if not group:
        carry = F.broadcast(carry)          # one row a partition
    number = F.col("__before") + F.col("__at") - F.col("__first") + 1
    return parts.join(carry, on).select(*[parts[c] for c in df.columns], number.cast("long").alias(out))
