"""Running values over long ordered groups: scan per block, carry per block.

A window with PARTITION BY puts a whole group into one task.  Here a group is
cut into blocks that follow its order (an hour, a day, a range of positions);
the window runs inside (group, block), and what the earlier blocks hand on is
computed from one row a block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_scan(df: DataFrame, within: Sequence[str], order: Sequence[str], block: Column,
               sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None,
               inclusive: bool = True) -> DataFrame:
    """``df`` plus running sums and last non-null values per group.

    * ``within``: the group's columns (a NULL is a group of its own);
    * ``order``: the ordering columns, ascending with NULL first; ``block`` must not fall along them
      (for example the day of the ordering timestamp);
    * ``sums``: name -> column, SUM over all rows up to this one (NULL until
      the first non-null value);
    * ``lasts``: name -> column, the last non-null value up to this row;
    * ``inclusive=False`` leaves the row itself out.
    """
    group = list(within)
    sums, lasts = dict(sums or {}), dict(lasts or {})
    src = df.withColumns({"__b": block, **{f"__s{i}": c for i, c in enumerate(sums.values())},
                          **{f"__l{i}": c for i, c in enumerate(lasts.values())}})
    inside = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = {**{f"__os{i}": F.sum(f"__s{i}").over(inside) for i in range(len(sums))},
           **{f"__ol{i}": F.last(f"__l{i}", ignorenulls=True).over(inside) for i in range(len(lasts))}}
    rows = src.withColumns(own)

    # one row a block: its sums and its last non-null values
    key = F.struct(*order)
    totals = [F.sum(f"__s{i}").alias(f"__ts{i}") for i in range(len(sums))]
    totals += [F.max_by(F.when(F.col(f"__l{i}").isNotNull(), F.col(f"__l{i}")),
                        F.when(F.col(f"__l{i}").isNotNull(), key)).alias(f"__tl{i}") for i in range(len(lasts))]
    ids = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]
    blocks = src.groupBy(*ids, "__b").agg(*totals)
    before = Window.partitionBy(*[f"__g{i}" for i in range(len(group))]).orderBy(F.col("__b").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*[f"__g{i}" for i in range(len(group))], F.col("__b").alias("__cb"),
                          *[F.sum(f"__ts{i}").over(before).alias(f"__cs{i}") for i in range(len(sums))],
                          *[F.last(f"__tl{i}", ignorenulls=True).over(before).alias(f"__cl{i}") for i in range(len(lasts))])
    on = rows["__b"].eqNullSafe(carry["__cb"])
    for i, c in enumerate(group):
        on = on & rows[c].eqNullSafe(carry[f"__g{i}"])
    joined = rows.join(carry, on, "left")
    zero = lambda s, c: F.when(F.col(s).isNull(), F.col(c)).otherwise(F.col(s) + F.coalesce(F.col(c), F.lit(0)))
    return joined.select(*[rows[c] for c in df.columns],
                         *[zero(f"__os{i}", f"__cs{i}").alias(n) for i, n in enumerate(sums)],
                         *[F.coalesce(f"__ol{i}", f"__cl{i}").alias(n) for i, n in enumerate(lasts)])
