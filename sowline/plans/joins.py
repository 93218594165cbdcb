"""Relational family: outer joins and WHERE, NOT IN, OR joins, lookups with
fallback, duplicate probes, reconciliation, trace chains, UNION (J1-J20,
P12, P23, A4, A13, U2, C15, C28, C36, C38-C41, C45)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowline.functions.dates import ntz, utc_day
from sowline.operators.nested import collect_bounded, unnest
from sowline.operators.relational import (in_list_flag, match_else, not_in, or_join, reconcile,
                                          union_distinct)
from sowline.plans.registry import register
from sowline.sources.tables import read_table


def T(spark, base, name):
    return read_table(spark, base, name)


@register("left_join_keep", sql="""
SELECT o_orderkey, count(r.l_linenumber) AS n_lines
FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') r
  ON o_orderkey = r.l_orderkey
GROUP BY o_orderkey""")
def q_left_join_keep(spark, base):
    o = T(spark, base, "orders").select("o_orderkey")
    r = T(spark, base, "lineitem").where(F.col("l_returnflag") == "R") \
        .select("l_orderkey", "l_linenumber")      # filter inside the right side: stays outer
    return o.join(r, o.o_orderkey == r.l_orderkey, "left").groupBy("o_orderkey") \
            .agg(F.count("l_linenumber").alias("n_lines"))


@register("left_join_where", sql="""
SELECT o_orderkey, count(l_linenumber) AS n_lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag = 'R'
GROUP BY o_orderkey""")
def q_left_join_where(spark, base):
    o = T(spark, base, "orders").select("o_orderkey")
    li = T(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    # a WHERE on the right side after a LEFT JOIN keeps only matched rows (M2)
    return o.join(li, o.o_orderkey == li.l_orderkey, "left") \
            .where(F.col("l_returnflag") == "R").groupBy("o_orderkey") \
            .agg(F.count("l_linenumber").alias("n_lines"))


@register("not_in", sql="""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_not_in(spark, base):
    c = T(spark, base, "customer").select("c_custkey", "c_name")
    sub = T(spark, base, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return not_in(c, "c_custkey", sub, "o_custkey")


@register("not_in_with_null", sql="""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END
                        FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_not_in_with_null(spark, base):
    c = T(spark, base, "customer").select("c_custkey", "c_name")
    sub = T(spark, base, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_custkey"))
        .alias("k"))
    return not_in(c, "c_custkey", sub, "k")


@register("or_join", sql="""
SELECT s_suppkey, n_nationkey FROM supplier
JOIN nation ON (n_nationkey = s_nationkey OR n_regionkey = s_nationkey)""")
def q_or_join(spark, base):
    n = T(spark, base, "nation").select("n_nationkey", "n_regionkey")
    s = T(spark, base, "supplier").select("s_suppkey", "s_nationkey")
    return or_join(n, s, ["n_nationkey", "n_regionkey"], "s_nationkey") \
        .select("s_suppkey", "n_nationkey")


@register("match_else", sql="""
WITH r AS (SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R'),
d1 AS (SELECT l_orderkey AS k, min(CAST(l_shipdate AS DATE)) AS d FROM r GROUP BY 1),
d2 AS (SELECT o_custkey AS k, min(CAST(l_shipdate AS DATE)) AS d
       FROM r JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey, d1.d AS direct_date, d2.d AS indirect_date,
       coalesce(d1.d, d2.d) AS resolved_date,
       CASE WHEN d1.d IS NOT NULL THEN 'direct' WHEN d2.d IS NOT NULL THEN 'indirect'
            ELSE 'none' END AS match_kind
FROM orders LEFT JOIN d1 ON o_orderkey = d1.k LEFT JOIN d2 ON o_custkey = d2.k""")
def q_match_else(spark, base):
    o = T(spark, base, "orders").select("o_orderkey", "o_custkey")
    r = T(spark, base, "lineitem").where(F.col("l_returnflag") == "R") \
        .select("l_orderkey", utc_day("l_shipdate").alias("d"))
    d1 = r.groupBy("l_orderkey").agg(F.min("d").alias("d"))
    d2 = r.join(o, r.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.min("d").alias("d"))
    out = match_else(o, d1, "l_orderkey", "o_orderkey", d2, "o_custkey", "o_custkey", "d",
                     out="resolved_date")
    return out.select("o_orderkey", F.col("__direct").alias("direct_date"),
                      F.col("__indirect").alias("indirect_date"), "resolved_date", "match_kind")


@register("min_max_dates_by_key", sql="""
SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS first_ship,
       max(CAST(l_shipdate AS DATE)) AS last_ship
FROM lineitem GROUP BY l_orderkey""")
def q_min_max_dates_by_key(spark, base):
    li = T(spark, base, "lineitem")
    return li.groupBy("l_orderkey").agg(F.min(utc_day("l_shipdate")).alias("first_ship"),
                                        F.max(utc_day("l_shipdate")).alias("last_ship"))


@register("having_duplicates", sql="""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_having_duplicates(spark, base):
    li = T(spark, base, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")) \
             .where(F.col("n") > 1)


@register("reconcile_feeds", sql="""
WITH a AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day FROM events
           WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'),
b AS (SELECT user_id, event_id FROM events WHERE event_type = 'click')
SELECT a.user_id, a.event_id, a.day FROM a JOIN b ON a.user_id = b.user_id AND a.event_id = b.event_id""")
def q_reconcile_feeds(spark, base):
    ev = T(spark, base, "events")
    a = ev.where((F.col("ts") >= ntz("2024-01-05")) & (F.col("ts") < ntz("2024-01-25"))) \
          .select("user_id", "event_id", utc_day("ts").alias("day"))
    b = ev.where(F.col("event_type") == "click").select("user_id", "event_id")
    return reconcile(a, b, ["user_id", "event_id"])


@register("trace_chain", sql="""
SELECT c_custkey, o_orderkey, l_linenumber, p_name, s_name,
       strftime(l_shipdate, '%m-%d-%Y') AS ship_date_text
FROM customer, orders, lineitem, part, supplier
WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey
  AND l_suppkey = s_suppkey AND c_mktsegment = 'MACHINERY'""")
def q_trace_chain(spark, base):
    c = T(spark, base, "customer").where(F.col("c_mktsegment") == "MACHINERY")
    o, li = T(spark, base, "orders"), T(spark, base, "lineitem")
    p, s = T(spark, base, "part"), T(spark, base, "supplier")
    j = (c.join(o, c.c_custkey == o.o_custkey)
         .join(li, o.o_orderkey == li.l_orderkey)
         .join(p, li.l_partkey == p.p_partkey)
         .join(s, li.l_suppkey == s.s_suppkey))
    return j.select("c_custkey", "o_orderkey", "l_linenumber", "p_name", "s_name",
                    F.date_format("l_shipdate", "MM-dd-yyyy").alias("ship_date_text"))


@register("existence_label", sql="""
SELECT l_returnflag,
       CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
            THEN 'cat3' ELSE 'cat2' END AS category,
       count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def q_existence_label(spark, base):
    li = T(spark, base, "lineitem").select("l_returnflag", "l_suppkey")
    dim = T(spark, base, "supplier").where(F.col("s_acctbal") > 5000).select("s_suppkey")
    flagged = in_list_flag(li, "l_suppkey", dim, "s_suppkey", "__in")
    return flagged.groupBy("l_returnflag", F.when(F.col("__in"), "cat3").otherwise("cat2")
                           .alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register("compliance_status", sql="""
SELECT s_suppkey, s_name, n_name, 'flagged' AS status
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_regionkey = 0
UNION
SELECT s_suppkey, s_name, n_name, 'flagged' AS status
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
WHERE s_acctbal < 1000""")
def q_compliance_status(spark, base):
    s, n, r = T(spark, base, "supplier"), T(spark, base, "nation"), T(spark, base, "region")
    b1 = (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
          .where(F.col("r_regionkey") == 0)
          .select("s_suppkey", "s_name", "n_name", F.lit("flagged").alias("status")))
    b2 = (s.where(F.col("s_acctbal") < 1000).join(n, s.s_nationkey == n.n_nationkey, "left")
          .select("s_suppkey", "s_name", "n_name", F.lit("flagged").alias("status")))
    return union_distinct([b1, b2])


@register("first_shipments", sql="""
SELECT DISTINCT l_partkey AS set_id, CAST(o_orderdate AS DATE) AS ship_date
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def q_first_shipments(spark, base):
    o, li = T(spark, base, "orders"), T(spark, base, "lineitem")
    # a shipment record = order day + the list of set ids it carries
    shipments = (collect_bounded(li, ["l_orderkey"], F.col("l_partkey"), "set_ids", 1000)
                 .join(o, F.col("l_orderkey") == o.o_orderkey)
                 .select(utc_day("o_orderdate").alias("ship_date"), "set_ids"))
    return unnest(shipments, "set_ids", "set_id").select("set_id", "ship_date").distinct()
