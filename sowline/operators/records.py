"""Stored nested records: sets -> entries -> materials.

A record is a piece of one set: its attributes and an array of entries, each
with an array of materials and of instructions.  Records are written once as
Parquet; reports read only the nested fields they use and fold arrays inside
the row (``transform``, ``filter``, ``aggregate``), so nothing is shuffled below
a report's own grouping.  A set or an entry with very many children is several
pieces of bounded size: a report that groups by set or entry sees them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sowline.operators.nested import collect_bounded
from sowline.sources.tables import store

MATERIALS = 1000        # of one entry piece, about
ENTRIES = 200           # of one record, about


def nested_records(children: DataFrame, set_id: str, entry_id: str, material: Column, group: Column,
                   instructions: Sequence[tuple[str, Column]]) -> DataFrame:
    """(set_id, entries, whole) from flat child rows.

    ``entries`` holds (entry_id, groups, materials, instructions): ``material``
    is a struct per child row, ``group`` a label out of a small fixed domain,
    ``instructions`` are (code, value) texts per child row.  Children without
    a set or an entry are in no record.

    A set of at most ``ENTRIES`` children is one record (``whole``): its rows
    are shuffled once and its entries are made inside the row.  The larger sets
    are counted out first; only their rows take the way of ``_pieces``.
    """
    given = F.array(*[F.struct(F.lit(c).alias("code"), v.cast("string").alias("value")) for c, v in instructions])
    named = children.where(F.col(set_id).isNotNull() & F.col(entry_id).isNotNull())
    rows = named.select(F.col(set_id), F.col(entry_id), group.alias("g"), material.alias("m"), given.alias("i"))
    counts = named.groupBy(F.col(set_id).alias("__large")).agg(F.count(F.lit(1)).alias("n"))
    # stored: its size is known when the join with it is planned
    large = store(counts.where(F.col("n") > ENTRIES).select("__large"), "large-sets")
    same = rows[set_id] == large["__large"]
    some = large.limit(1).count() > 0
    small = rows.join(large, same, "left_anti") if some else rows
    # dealt out before they are grouped: no sort of whole scans before the shuffle
    line = F.struct(F.col(entry_id).alias("entry_id"), "g", "m", "i")
    sets = small.repartition(set_id).groupBy(set_id).agg(F.collect_list(line).alias("__lines"))

    def entry(key):
        own = F.filter("__lines", lambda x: x["entry_id"] == key)
        groups = F.filter(F.array_distinct(F.transform(own, lambda x: x["g"])), lambda g: g.isNotNull())
        return F.struct(key.alias("entry_id"), F.sort_array(groups).alias("groups"), F.transform(own, lambda x: x["m"]).alias("materials"),
                        F.flatten(F.transform(own, lambda x: x["i"])).alias("instructions"))

    out = sets.select(set_id, F.transform(F.array_distinct(F.transform("__lines", lambda x: x["entry_id"])), entry).alias("entries"),
                      F.lit(True).alias("whole"))
    return out.unionByName(_pieces(rows.join(large, same, "left_semi"), set_id, entry_id)) if some else out


def _pieces(rows: DataFrame, set_id: str, entry_id: str) -> DataFrame:
    """Records of bounded size of sets with any number of children."""
    keys = [set_id, entry_id]
    parts = collect_bounded(rows, keys, F.struct("m", "i"), "rows", MATERIALS)
    groups = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("g")).alias("groups"))
    entry = F.struct(F.col(entry_id).alias("entry_id"), "groups", F.transform("rows", lambda r: r["m"]).alias("materials"),
                     F.flatten(F.transform("rows", lambda r: r["i"])).alias("instructions"))
    return collect_bounded(parts.join(groups, keys).select(set_id, entry.alias("entry")), [set_id], F.col("entry"), "entries", ENTRIES) \
        .drop("part_no").withColumn("whole", F.lit(False))


def coded_max(instructions: Column, code: str) -> Column:
    """N9 inside the row: the largest value among the instructions of a code
    as DECIMAL(38,9); NULL without one."""
    return F.array_max(F.transform(F.filter(instructions, lambda x: x["code"] == code), lambda x: x["value"].cast("decimal(38,9)")))


def any_of(values: Column, wanted: Sequence[str]) -> Column:
    """Whether the array holds one of the labels (an inner unnest and an IN,
    grouped by the record again); false for NULL and empty arrays."""
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])), F.lit(False))
