"""Joins and set operators with the source's exact semantics.

Scale notes
-----------
* No operator here plans a nested-loop join: the disjunctive join is two equi
  joins, NOT IN is an anti join plus two scalar subqueries (row and null count).
* Lookups built from data (distinct dims, per-key aggregates) are left to
  AQE: it broadcasts them when their measured size is under
  ``spark.sql.autoBroadcastJoinThreshold`` and otherwise keeps a shuffle join,
  splitting skewed partitions.  Only parameter-sized tables are broadcast
  explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowline.operators.skew import split_lookup
from sowline.sources.tables import store

SENT = 10_000           # listed values of a column that are sent to the rows


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def or_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_key: str,
            how: str = "inner") -> DataFrame:
    """``left JOIN right ON right_key = a OR right_key = b [OR ...]`` as equi joins.

    Branch i keeps a pair only if no earlier key already matched it (null-safe),
    so every matching pair appears once, exactly as the OR join returns it.
    ``how='left'`` also keeps left rows matching no key (null right columns).
    """
    keys = _cols(left_keys)
    parts = []
    for i, k in enumerate(keys):
        j = left.join(right, left[k] == right[right_key], "inner")
        for prev in keys[:i]:
            j = j.where(~F.coalesce(left[prev] == right[right_key], F.lit(False)))
        parts.append(j)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if how == "left":
        matched = out.select(*[left[c] for c in left.columns]).distinct()
        # left rows with no match on any key
        cond = [left[c].eqNullSafe(matched[c]) for c in left.columns]
        lonely = left.join(matched, cond, "left_anti")
        for c in right.columns:
            lonely = lonely.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
        out = out.unionByName(lonely)
    elif how != "inner":
        raise ValueError("or_join supports inner and left")
    return out


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """SQL ``left_key NOT IN (SELECT right_key FROM right)``.

    * any null in the subquery -> no row qualifies;
    * a null left key qualifies only when the subquery is empty.
    Built as an anti join on the non-null keys (shuffle or broadcast, chosen
    by AQE) and one scalar subquery that holds both counts, so it never falls
    back to a nested-loop join the way a large NOT IN subquery can.
    """
    rk = right.select(F.col(right_key).alias("__rk"))
    # 0: no rows, 1: no nulls, 2: some null (partial aggregation, one value)
    rows, known = F.count(F.lit(1)), F.count("__rk")
    state = rk.agg(F.when(rows == 0, 0).when(rows == known, 1).otherwise(2)).scalar()
    keys = rk.where(F.col("__rk").isNotNull()).distinct()
    anti = left.join(keys, left[left_key] == keys["__rk"], "left_anti")
    return anti.where(F.when(F.col(left_key).isNotNull(), 1).otherwise(0) >= state)


def match_else(base: DataFrame, direct: DataFrame, direct_key: str, base_key: str,
               indirect: DataFrame, indirect_key: str, base_key2: str, value: str,
               out: str = "resolved", inner_second: bool = False) -> DataFrame:
    """Value from the direct lookup, else from the second lookup.

    ``direct`` and ``indirect`` must have one row per key (aggregate first).
    ``inner_second=True`` gives the variant whose second join is inner.
    """
    d = direct.select(F.col(direct_key).alias("__dk"), F.col(value).alias("__direct"))
    i = indirect.select(F.col(indirect_key).alias("__ik"), F.col(value).alias("__indirect"))
    j = base.join(d, base[base_key] == d["__dk"], "left")
    j = j.join(i, j[base_key2] == i["__ik"], "inner" if inner_second else "left")
    return (j.withColumn(out, F.coalesce("__direct", "__indirect"))
            .withColumn("match_kind", F.when(F.col("__direct").isNotNull(), "direct")
                        .when(F.col("__indirect").isNotNull(), "indirect").otherwise("none"))
            .drop("__dk", "__ik"))


def outer_add(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Pandas ``frame_a + frame_b`` aligned on the index.

    Full outer join on the keys; a key present on one side only gives null
    (no coalesce), like pandas.
    """
    k = _cols(keys)
    aa = a.select(*k, *[F.col(v).alias(f"__a_{v}") for v in values])
    bb = b.select(*k, *[F.col(v).alias(f"__b_{v}") for v in values])
    j = aa.join(bb, on=k, how="full")
    return j.select(*k, *[(F.col(f"__a_{v}") + F.col(f"__b_{v}")).alias(v) for v in values])


def upsert_rows(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``frame.loc[key] = row``: replace rows with the same key, append the rest."""
    k = _cols(keys)
    kept = df.join(rows.select(*k), on=k, how="left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def remove_rows(df: DataFrame, to_remove: DataFrame, mode: str = "per_column") -> DataFrame:
    """Drop rows of ``df`` described by ``to_remove``.

    * ``exact``: a null-safe anti join on all columns (what the source meant);
    * ``per_column``: pandas ``df.isin(to_remove.to_dict('list')).all(axis=1)``
      -- a row goes when *each* of its values occurs somewhere in the same
      column of ``to_remove`` (M17), which can also drop rows never listed.
      NULL occurs where NULL is listed.

    Per column, the listed values are stored once each and looked up by every
    row: a short list is sent to the rows, by a longer one the rows are dealt
    out, a value that very many of them share over salts (``split_lookup``).
    """
    cols = df.columns
    if mode == "exact":
        cond = [df[c].eqNullSafe(to_remove[c]) for c in cols]
        return df.join(to_remove, cond, "left_anti")
    if mode != "per_column":
        raise ValueError(mode)
    out, every = df, F.lit(True)
    for i, c in enumerate(cols):
        # a struct is never NULL itself, and two structs of NULL are equal
        values = store(to_remove.select(F.struct(F.col(c).alias("v")).alias("__v")).distinct().withColumn(f"__hit{i}", F.lit(True)), "listed-values")
        out = out.withColumn("__v", F.struct(F.col(c).alias("v")))
        if values.limit(SENT + 1).count() <= SENT:
            out = out.join(F.broadcast(values), "__v", "left").drop("__v")
        else:
            out = split_lookup(out, values, ["__v"]).drop("__v")
        every = every & F.coalesce(f"__hit{i}", F.lit(False))
    return out.where(~every).select(*cols)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """UNION ALL by name; ``allow_missing`` null-fills absent columns (pd.concat)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION (distinct); names come from the first branch, columns by position."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def in_list_flag(df: DataFrame, key: str, dim: DataFrame, dim_key: str, out: str) -> DataFrame:
    """``CASE WHEN key IN (SELECT dim_key ...)`` as a boolean column via a distinct dim.

    Null keys are never in the list here (the CASE then falls to ELSE).
    """
    d = dim.select(F.col(dim_key).alias("__dk")).where(F.col("__dk").isNotNull()).distinct()
    j = df.join(d.withColumn("__hit", F.lit(True)), df[key] == d["__dk"], "left")
    return j.withColumn(out, F.coalesce(F.col("__hit"), F.lit(False))).drop("__dk", "__hit")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows seen by both feeds (inner join on the shared keys)."""
    return a.join(b, on=_cols(keys), how="inner")
