"""Nested-data family.

Per-order arrays are built from ``lineitem`` (the lines of one order) with
``collect_bounded``: an order with very many lines becomes several arrays of
about ``MAX_ARRAY`` elements, so no row or task holds an unbounded list.
Orders without lines get a null array through the left join, which the inner
unnest drops and the outer one keeps (M6, M7).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sowline.functions.dates import utc_day
from sowline.functions.text import coalesce_as_string
from sowline.operators.nested import (collect_bounded, kv_pivot, unnest, unnest_nested,
                                     unnest_pairs)
from sowline.operators.reshape import pivot_listagg
from sowline.plans.registry import register
from sowline.sources.tables import read_table


MAX_ARRAY = 1000


def T(spark, base, name):
    return read_table(spark, base, name)


def _order_lines(spark, base):
    o = T(spark, base, "orders").select("o_orderkey")
    lines = collect_bounded(T(spark, base, "lineitem"), ["l_orderkey"], F.col("l_linenumber"),
                            "lines", MAX_ARRAY)
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", "lines")


@register("unnest_inner", sql="""
SELECT o_orderkey, l_linenumber AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def q_unnest_inner(spark, base):
    return unnest(_order_lines(spark, base), "lines", "line")


@register("unnest_outer", sql="""
SELECT o_orderkey, l_linenumber AS line FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def q_unnest_outer(spark, base):
    return unnest(_order_lines(spark, base), "lines", "line", outer=True)


@register("unnest_double", sql="""
WITH f AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS flag FROM lineitem),
l AS (SELECT l_orderkey AS k, l_linenumber AS line FROM lineitem)
SELECT f.k AS l_orderkey, f.flag, l.line FROM f JOIN l ON f.k = l.k""")
def q_unnest_double(spark, base):
    li = T(spark, base, "lineitem")
    # flags per order are at most the three return flags (a set over a fixed
    # domain); lines come in bounded parts, so each row's product is bounded
    flags = li.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    lines = collect_bounded(li, ["l_orderkey"], F.col("l_linenumber"), "lines", MAX_ARRAY)
    arr = flags.join(lines, "l_orderkey")
    return unnest_pairs(arr, "flags", "flag", "lines", "line").select("l_orderkey", "flag", "line")


@register("unnest_nested", sql="""
SELECT l_orderkey, l_linestatus, l_linenumber, l_partkey FROM lineitem""")
def q_unnest_nested(spark, base):
    li = T(spark, base, "lineitem")
    # one record per order: entries (one per line status) each holding its
    # materials (line number, part) -- two array levels inside one record
    entries = collect_bounded(li, ["l_orderkey", "l_linestatus"],
                              F.struct("l_linenumber", "l_partkey"), "materials", MAX_ARRAY)
    orders = collect_bounded(entries, ["l_orderkey"], F.struct("l_linestatus", "materials"),
                             "entries", MAX_ARRAY)
    flat = unnest_nested(orders, "entries", "e", "materials", "m")
    return flat.select("l_orderkey", F.col("e.l_linestatus").alias("l_linestatus"),
                       F.col("m.l_linenumber").alias("l_linenumber"),
                       F.col("m.l_partkey").alias("l_partkey"))


@register("kv_pivot_product", sql="""
WITH kv AS (
  SELECT l_orderkey,
         max(CASE WHEN l_linenumber = 1 THEN CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(38,9)) END) AS q1,
         max(CASE WHEN l_linenumber = 2 THEN CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(38,9)) END) AS q2
  FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(q1 AS DOUBLE) AS q1, CAST(q2 AS DOUBLE) AS q2,
       CAST(q1 * q2 AS DOUBLE) AS product FROM kv""")
def q_kv_pivot_product(spark, base):
    li = T(spark, base, "lineitem")
    arr = collect_bounded(li, ["l_orderkey"], F.struct(
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("code"),
        F.col("l_quantity").cast("string").alias("value")), "instructions", MAX_ARRAY)
    kv = kv_pivot(arr, ["l_orderkey"], "instructions", "code", "value", {"q1": "L1", "q2": "L2"})
    return kv.select("l_orderkey", F.col("q1").cast("double").alias("q1"),
                     F.col("q2").cast("double").alias("q2"),
                     (F.col("q1") * F.col("q2")).cast("double").alias("product"))


@register("string_agg_pivot", sql="""
SELECT l_orderkey,
  array_to_string(list_sort(list_distinct(list(l_linenumber) FILTER (WHERE l_returnflag = 'A'))), ',') AS A,
  array_to_string(list_sort(list_distinct(list(l_linenumber) FILTER (WHERE l_returnflag = 'N'))), ',') AS N,
  array_to_string(list_sort(list_distinct(list(l_linenumber) FILTER (WHERE l_returnflag = 'R'))), ',') AS R
FROM lineitem GROUP BY l_orderkey""")
def q_string_agg_pivot(spark, base):
    li = T(spark, base, "lineitem")
    return pivot_listagg(li, ["l_orderkey"], "l_returnflag", {"A": "A", "N": "N", "R": "R"},
                         "l_linenumber")


@register("coalesce_typed", sql="""
SELECT l_orderkey, l_linenumber,
       coalesce(CAST(CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS VARCHAR),
                CAST(CASE WHEN l_returnflag = 'N' THEN l_partkey END AS VARCHAR),
                CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS obs_value
FROM lineitem""")
def q_coalesce_typed(spark, base):
    li = T(spark, base, "lineitem")
    f = F.col("l_returnflag")
    return li.select("l_orderkey", "l_linenumber", coalesce_as_string(
        F.when(f == "A", F.col("l_linenumber")), F.when(f == "N", F.col("l_partkey")),
        utc_day("l_shipdate")).alias("obs_value"))
