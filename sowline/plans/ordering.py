"""Ordered results (O1-O4): the place of every row is a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowline.functions.dates import utc_day
from sowline.operators.ordered import row_numbers
from sowline.plans.registry import register
from sowline.sources.tables import read_table


@register("ordered_sets", sql="""
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS rte_date,
       row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_custkey, o_orderkey) AS place
FROM orders WHERE o_orderstatus = 'F'""")
def q_ordered_sets(spark, base):
    # newest first, then two ascending columns (O1, O2)
    o = read_table(spark, base, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", utc_day("o_orderdate").alias("rte_date"))
    return row_numbers(o, [F.col("rte_date").desc(), F.col("o_custkey").asc(), F.col("o_orderkey").asc()], out="place")


@register("ordered_by_hidden_column", sql="""
WITH s AS (SELECT l_partkey, max(CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END) AS last_filled, count(*) AS n_lines
           FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
SELECT l_partkey, n_lines, row_number() OVER (ORDER BY last_filled ASC NULLS FIRST, n_lines DESC, l_partkey) AS place FROM s""")
def q_ordered_by_hidden_column(spark, base):
    # the leading sort column is not part of the result (O3); NULL sorts first
    s = read_table(spark, base, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(
        F.max(F.when(F.col("l_linestatus") == "F", utc_day("l_shipdate"))).alias("last_filled"), F.count(F.lit(1)).alias("n_lines"))
    numbered = row_numbers(s, [F.col("last_filled").asc_nulls_first(), F.col("n_lines").desc(), F.col("l_partkey").asc()], out="place")
    return numbered.select("l_partkey", "n_lines", "place")


@register("ordered_within_site", sql="""
SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS place
FROM supplier""")
def q_ordered_within_site(spark, base):
    # sorted values of every group
    s = read_table(spark, base, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return row_numbers(s, [F.col("s_acctbal").desc_nulls_last(), F.col("s_suppkey").asc()], out="place", within=["s_nationkey"])
