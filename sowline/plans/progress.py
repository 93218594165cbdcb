"""Progress and stock-versus-request family.

Mapping: an order is a set, its lines are the set's entries, line status 'F'
means filled; parts carry stock (size x 10) against requested line quantity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sowline.functions.dates import utc_day
from sowline.operators.aggregates import progress_status, sum_when
from sowline.operators.nested import nest_children
from sowline.plans.registry import register
from sowline.sources.tables import read_table

PCT_SQL = "CAST(filled_entries AS DOUBLE) * 100.0 / CAST(total_entries AS DOUBLE)"


def T(spark, base, name):
    return read_table(spark, base, name)


def _progress(spark, base):
    li = T(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    o = T(spark, base, "orders").select("o_orderkey", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return progress_status(j, ["o_orderkey", "o_orderpriority"], "l_linenumber",
                           F.col("l_linestatus") == "F")


SQL_PROGRESS = f"""
p0 AS (SELECT o_orderkey, o_orderpriority, count(l_linenumber) AS total_entries,
              CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled_entries
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT *, {PCT_SQL} AS pct FROM p0)"""


@register("progress_status", sql=f"""
WITH {SQL_PROGRESS}
SELECT o_orderkey, o_orderpriority, total_entries, filled_entries,
       CASE WHEN pct = 0 THEN 'Not Start' WHEN pct > 0 AND pct < 100 THEN 'In Progress'
            WHEN pct = 100 THEN 'Completed' END AS fill_status,
       sign(pct) * floor(abs(pct) * 100 + 0.5) / 100 AS filled_pct
FROM p""")
def q_progress_status(spark, base):
    return _progress(spark, base)


@register("almost_done_semi", sql=f"""
WITH {SQL_PROGRESS}
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_linestatus <> 'F'
  AND l_orderkey IN (SELECT o_orderkey FROM p WHERE pct > 50 AND pct < 100)""")
def q_almost_done_semi(spark, base):
    pr = _progress(spark, base)
    pct = F.col("filled_entries") * 100.0 / F.col("total_entries")
    sets = pr.where((pct > 50) & (pct < 100)).select("o_orderkey")
    li = T(spark, base, "lineitem").where(F.col("l_linestatus") != "F") \
        .select("l_orderkey", "l_linenumber", "l_partkey")
    return li.join(sets, li.l_orderkey == sets.o_orderkey, "left_semi")


_COMBOS = [(f, s) for f in ("A", "N", "R") for s in ("F", "O")]


@register("conditional_sums", sql="""
WITH s AS (SELECT l_suppkey, """ + ",\n       ".join(
    f"sum(CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN l_quantity ELSE 0 END)"
    f" AS qty_{f.lower()}{s.lower()}" for f, s in _COMBOS) + """
  FROM lineitem GROUP BY l_suppkey)
SELECT *, CASE WHEN qty_af + qty_nf >= qty_ao THEN 'Enough for ready sets' ELSE 'Not enough for ready sets' END
          AS ready_check,
          CASE WHEN qty_af + qty_nf + qty_rf >= qty_ao + qty_no + qty_ro THEN 'Enough for all'
               ELSE 'Not Enough for all' END AS all_check
FROM s""")
def q_conditional_sums(spark, base):
    li = T(spark, base, "lineitem")
    sums = li.groupBy("l_suppkey").agg(*[
        sum_when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s),
                 F.col("l_quantity"), 0.0).alias(f"qty_{f.lower()}{s.lower()}") for f, s in _COMBOS])
    c = F.col
    return sums.withColumn("ready_check", F.when(c("qty_af") + c("qty_nf") >= c("qty_ao"),
                                              "Enough for ready sets").otherwise("Not enough for ready sets")) \
               .withColumn("all_check", F.when(c("qty_af") + c("qty_nf") + c("qty_rf")
                                               >= c("qty_ao") + c("qty_no") + c("qty_ro"),
                                               "Enough for all").otherwise("Not Enough for all"))


@register("seed_check", sql="""
SELECT p_partkey, min(p_size * 10.0::DOUBLE) AS stock, sum(l_quantity) AS requested,
       min(p_size * 10.0::DOUBLE) - sum(l_quantity) AS remaining,
       CASE WHEN min(p_size * 10.0::DOUBLE) - sum(l_quantity) < 0 THEN 'Not Enough Seed'
            ELSE 'Enough Seed' END AS status
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey""")
def q_seed_check(spark, base):
    p, li = T(spark, base, "part"), T(spark, base, "lineitem")
    # requests are summed per part before the join (pre-aggregation): the
    # join then sees one row per part on each side
    req = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("requested"))
    stock = p.select("p_partkey", (F.col("p_size") * 10.0).alias("stock"))
    j = stock.join(req, stock.p_partkey == req.l_partkey)
    rem = F.col("stock") - F.col("requested")
    return j.select("p_partkey", "stock", "requested", rem.alias("remaining"),
                    F.when(rem < 0, "Not Enough Seed").otherwise("Enough Seed").alias("status"))


@register("latest_status_date", sql="""
SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS rte_date
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def q_latest_status_date(spark, base):
    o = T(spark, base, "orders").where(F.col("o_orderstatus") == "F")
    return o.groupBy("o_custkey").agg(F.max(utc_day("o_orderdate")).alias("rte_date"))


# Order keys of one part of a customer's list: the same for every customer, so a
# row holds at most this many orders however many the customer has.
PART_KEYS = 65536


@register("nest_children", sql=f"""
SELECT o_custkey, CAST(floor(o_orderkey / {PART_KEYS}) AS BIGINT) AS part_no,
       CAST(to_json(list({{'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus}}
                         ORDER BY o_orderkey, o_orderstatus)) AS VARCHAR) AS orders_json,
       count(*) AS n_orders
FROM orders GROUP BY 1, 2""")
def q_nest_children(spark, base):
    o = T(spark, base, "orders").withColumn("part_no", F.floor(F.col("o_orderkey") / PART_KEYS).cast("long"))
    nested = nest_children(o, ["o_custkey", "part_no"], ["o_orderkey", "o_orderstatus"], "orders")
    return nested.select("o_custkey", "part_no", F.to_json("orders").alias("orders_json"),
                         F.size("orders").cast("long").alias("n_orders"))
