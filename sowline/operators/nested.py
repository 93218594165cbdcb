"""Array and nested-record operators.

``explode`` runs inside the scan stage (no shuffle).  Arrays are per-record
lists (ids of one packet, instructions of one set), so each row's expansion
is bounded by its own array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array_col: str, alias: str, outer: bool = False,
           keep_array: bool = False) -> DataFrame:
    """N1 (inner: rows with null or empty arrays vanish, M6) / N2 (outer: kept, M7)."""
    fn = F.explode_outer if outer else F.explode
    out = df.select("*", fn(F.col(array_col)).alias(alias))
    return out if keep_array else out.drop(array_col)


def unnest_pairs(df: DataFrame, a: str, a_alias: str, b: str, b_alias: str) -> DataFrame:
    """Two independent inner unnests of one row (every a element x every b element)."""
    return unnest(unnest(df, a, a_alias), b, b_alias)


def unnest_nested(df: DataFrame, outer_array: str, outer_alias: str, inner_field: str,
                  inner_alias: str, outer: bool = False) -> DataFrame:
    """Entries -> materials: explode the outer array, then its element's inner array."""
    first = unnest(df, outer_array, outer_alias, outer=outer)
    fn = F.explode_outer if outer else F.explode
    return first.select("*", fn(F.col(f"{outer_alias}.{inner_field}")).alias(inner_alias))


def concat_unnest(df: DataFrame, arrays: Sequence[str], alias: str) -> DataFrame:
    """ARRAY_CONCAT(a, b) then UNNEST."""
    return df.select("*", F.explode(F.concat(*[F.col(a) for a in arrays])).alias(alias))


def collect_bounded(df: DataFrame, key: Sequence[str], element: Column, out: str,
                    max_len: int = 1000, sort: bool = False) -> DataFrame:
    """Per-key arrays of ``element`` holding about ``max_len`` elements each.

    Rows are (key..., part_no, out).  A key with n elements is split into
    ceil(n / max_len) parts by a hash of the element.  Equal elements of a key
    are counted first and dealt out in runs of ``max_len`` / 64, so neither
    a key nor one element that holds a third of all rows becomes one giant
    array.  Nothing is dropped: NULL keys and NULL elements stay, and the union
    of a key's parts is its whole list.  Only the key and the columns of
    ``element`` are read.
    """
    k, run = list(key), max(1, max_len // 64)
    once = df.select(*k, element.alias("__e")).groupBy(*k, "__e").agg(F.count(F.lit(1)).alias("__c"))
    total = once.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(k)]).agg(F.sum("__c").alias("__n"))
    same = [once[c].eqNullSafe(total[f"__k{i}"]) for i, c in enumerate(k)]
    parts = F.ceil(F.col("__n") / F.lit(float(max_len))).cast("long")
    runs = once.join(total, same).withColumn(
        "__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__c") - 1) / run).cast("long"))))
    tagged = runs.withColumn("part_no", F.pmod(F.xxhash64("__e", "__run"), parts))
    size = F.least(F.lit(run), F.col("__c") - F.col("__run") * run).cast("int")
    arr = F.flatten(F.collect_list(F.array_repeat("__e", size)))
    if sort:
        arr = F.array_sort(arr)
    return tagged.groupBy(*k, "part_no").agg(arr.alias(out))


def nest_children(df: DataFrame, key: Sequence[str], fields: Sequence[str], out: str,
                  max_children: int | None = None) -> DataFrame:
    """One row per key with an array of child structs, in a fixed (sorted) order.

    With ``max_children`` a key holding more children is split into
    ceil(n / max_children) rows (``part_no``, about max_children children
    each; see ``collect_bounded``), so no single row or task holds an
    unbounded list.  Nothing is dropped: the union of a key's parts is its
    whole child list.
    """
    child = F.struct(*[F.col(f) for f in fields])
    if max_children is None:
        return df.groupBy(*key).agg(F.array_sort(F.collect_list(child)).alias(out))
    return collect_bounded(df, key, child, out, max_len=max_children, sort=True)


def kv_pivot(df: DataFrame, group_by: Sequence[str], array_col: str, key_field: str,
             value_field: str, keys: Mapping[str, str], cast: str = "decimal(38,9)") -> DataFrame:
    """Explode key/value structs, then MAX(CASE WHEN key = k THEN CAST(value) END) per k."""
    e = unnest(df, array_col, "__kv")
    return e.groupBy(*group_by).agg(*[
        F.max(F.when(F.col(f"__kv.{key_field}") == F.lit(k),
                     F.col(f"__kv.{value_field}").cast(cast))).alias(out)
        for out, k in keys.items()])


def filter_elements(df: DataFrame, array_col: str, pred, out: str | None = None) -> DataFrame:
    """Keep only array elements satisfying ``pred`` (higher-order filter, no explode)."""
    return df.withColumn(out or array_col, F.filter(F.col(array_col), pred))
