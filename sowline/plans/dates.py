"""Date chains: three dates per filled cell, process lag per set, site dates
(C27-C29, C32, C35-C38, J11, J18, J19).

Mapping: a line with status 'F' is a filled cell of the cassette (and set) of
its order, the part its inventory, the supplier its planting session and, by
its last digits, the hopper that filled it.  An event is a machine event on
the inventory whose legacy code is 'L' and the user's number; every third part
was received in exchange for another one.  Orders with status 'F' are ready to
execute.

Cells are looked up by inventory, set and session; each of these may hold a
third of all cells, so the lookups split off heavy keys (``split_lookup``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowline.functions.dates import ntz, utc_day
from sowline.operators.relational import or_join
from sowline.operators.skew import split_lookup, split_lookups
from sowline.plans.registry import register
from sowline.sources.tables import constants, read_table

FILLED_SINCE, EVENTS_SINCE = "1996-01-01", "2024-01-03"
ROSTER = [(f"{i:03d}", "S1" if i < 12 else "S2", f"Cat {i % 3 + 1}") for i in range(16)]


def T(spark, base, name):
    return read_table(spark, base, name)


def filled_cells(spark, base) -> DataFrame:
    """Row-level filled cells with site and category of the hopper."""
    roster = constants(spark, ROSTER, "hopper string, site string, category string")
    li = T(spark, base, "lineitem").where((F.col("l_linestatus") == "F") & (F.col("l_shipdate") >= ntz(FILLED_SINCE)))
    cells = li.select(F.col("l_orderkey").alias("cassette_id"), F.col("l_linenumber").alias("cell_number"), F.col("l_suppkey").alias("session_id"),
                      F.col("l_partkey").alias("inventory"), F.col("l_shipdate").alias("filled_on"),
                      F.lpad((F.col("l_suppkey") % 20).cast("string"), 3, "0").alias("hopper"))
    return cells.join(F.broadcast(roster), "hopper").drop("hopper")


def inventory(spark, base) -> DataFrame:
    return T(spark, base, "part").select(F.col("p_partkey").alias("barcode"), F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("legacy"), "p_size")


def exchanges(spark, base) -> DataFrame:
    code = lambda c: F.concat(F.lit("L"), c.cast("string"))
    p = F.col("p_partkey")
    return T(spark, base, "part").where("p_size % 3 = 0").select(code(p).alias("receiver"), code((p * 7) % 500).alias("sender"))


def process_times(spark, base) -> DataFrame:
    """First and last machine event per legacy code (summed before any join)."""
    ev = T(spark, base, "events").where(F.col("ts") >= ntz(EVENTS_SINCE))
    return ev.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last")) \
        .select(F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("bid"), "first", "last").where("bid is not null")


def resolved(spark, base) -> DataFrame:
    """One row per inventory barcode: events under its own code (direct) and
    under the code of its sender, else its own (indirect)."""
    inv, times = inventory(spark, base), process_times(spark, base)
    own = times.select(F.col("bid").alias("legacy"), F.col("first").alias("first_direct"), F.col("last").alias("last_direct"))
    sent = times.select(F.col("bid").alias("code"), F.col("first").alias("first_indirect"), F.col("last").alias("last_indirect"))
    codes = inv.join(exchanges(spark, base), F.col("receiver") == F.col("legacy"), "left").withColumn("code", F.coalesce("sender", "legacy"))
    return codes.join(own, "legacy", "left").join(sent, "code", "left").select(
        F.col("barcode").alias("inventory"), "p_size", "first_direct", "last_direct", "first_indirect", "last_indirect")


def dated_cells(spark, base, indirect: bool = True) -> DataFrame:
    """C27 (direct match only) / C28: cell, category or plot type, and three
    dates: inventory available, ready to execute, cassette finalized."""
    cells = filled_cells(spark, base).where("site = 'S1'").drop("site", "filled_on")
    day = lambda c: F.col(c).cast("date")
    available = F.coalesce(day("last_direct"), day("last_indirect")) if indirect else day("last_direct")
    lookup = resolved(spark, base).select("inventory", "p_size", available.alias("available_date"))
    ready = T(spark, base, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderkey").alias("cassette_id")) \
        .agg(F.max(utc_day("o_orderdate")).alias("rte_date"))
    sessions = T(spark, base, "supplier").select(F.col("s_suppkey").alias("session_id"), F.date_add(
        F.lit(dt.date(1996, 1, 1)), (F.col("s_suppkey") % 700).cast("int")).alias("finalized_date"))
    out = split_lookups(cells, [(lookup, ["inventory"], "inner"), (ready, ["cassette_id"], "left"), (sessions, ["session_id"], "left")])
    kind = F.when(F.col("p_size") % 7 == 0, "border").when(F.col("p_size") % 11 == 0, "buffer").otherwise(F.col("category"))
    return out.select("cassette_id", "cell_number", kind.alias("cat_type"), "session_id", "available_date", "rte_date", "finalized_date").distinct()


CHAIN_SQL = f"""
roster(hopper, site, category) AS (VALUES {', '.join(str(r) for r in ROSTER)}),
cells AS (SELECT l_orderkey AS cassette_id, l_linenumber AS cell_number, l_suppkey AS session_id, l_partkey AS inventory, l_shipdate AS filled_on, site, category
          FROM lineitem JOIN roster ON lpad(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') = hopper
          WHERE l_linestatus = 'F' AND l_shipdate >= DATE '{FILLED_SINCE}'),
inv AS (SELECT p_partkey AS barcode, 'L' || p_partkey AS legacy, p_size FROM part),
ex AS (SELECT 'L' || p_partkey AS receiver, 'L' || ((p_partkey * 7) % 500) AS sender FROM part WHERE p_size % 3 = 0),
s3 AS (SELECT 'L' || user_id AS bid, ts FROM events WHERE ts >= TIMESTAMP '{EVENTS_SINCE}'),
d1 AS (SELECT barcode, min(ts) AS first, max(ts) AS last FROM s3 JOIN inv ON bid = legacy GROUP BY 1),
d2 AS (SELECT barcode, min(ts) AS first, max(ts) AS last FROM inv LEFT JOIN ex ON receiver = legacy JOIN s3 ON coalesce(sender, legacy) = bid GROUP BY 1)"""


def three_dates_sql(indirect: bool) -> str:
    available = "CAST(coalesce(d1.last, d2.last) AS DATE)" if indirect else "CAST(d1.last AS DATE)"
    return CHAIN_SQL + f""",
rte AS (SELECT o_orderkey AS set_id, max(CAST(o_orderdate AS DATE)) AS rte_date FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
dated AS (
  SELECT DISTINCT cassette_id, cell_number, CASE WHEN p_size % 7 = 0 THEN 'border' WHEN p_size % 11 = 0 THEN 'buffer' ELSE category END AS cat_type,
         session_id, {available} AS available_date, rte_date,
         CASE WHEN s_suppkey IS NOT NULL THEN DATE '1996-01-01' + CAST(s_suppkey % 700 AS INTEGER) END AS finalized_date
  FROM cells JOIN inv ON inv.barcode = inventory LEFT JOIN d1 ON d1.barcode = inventory LEFT JOIN d2 ON d2.barcode = inventory
  LEFT JOIN rte ON rte.set_id = cassette_id LEFT JOIN supplier ON s_suppkey = session_id WHERE site = 'S1')"""


@register("three_dates_direct", sql=f"WITH {three_dates_sql(False)} SELECT * FROM dated")
def q_three_dates_direct(spark, base):
    return dated_cells(spark, base, indirect=False)


@register("three_dates", sql=f"WITH {three_dates_sql(True)} SELECT * FROM dated")
def q_three_dates(spark, base):
    return dated_cells(spark, base)


@register("cells_by_category_row", sql=f"""
WITH {CHAIN_SQL}
SELECT cassette_id, cell_number, site, category, CAST(filled_on AS DATE) AS filled_date,
       CASE WHEN p_size % 7 = 0 THEN 'border' WHEN p_size % 11 = 0 THEN 'buffer' ELSE category END AS cat_type
FROM cells JOIN inv ON inv.barcode = inventory""")
def q_cells_by_category_row(spark, base):
    # The row level, before any count
    kind = F.when(F.col("p_size") % 7 == 0, "border").when(F.col("p_size") % 11 == 0, "buffer").otherwise(F.col("category"))
    sizes = inventory(spark, base).select(F.col("barcode").alias("inventory"), "p_size")
    cells = split_lookup(filled_cells(spark, base), sizes, ["inventory"], "inner")
    return cells.select("cassette_id", "cell_number", "site", "category", utc_day("filled_on").alias("filled_date"), kind.alias("cat_type"))


KINDS = ("Cat 1", "Cat 2", "Cat 3", "border", "buffer")


@register("finalized_by_kind", sql=f"""
WITH {three_dates_sql(True)}
SELECT finalized_date, {', '.join(f"sum(CASE WHEN cat_type = '{k}' THEN 1 ELSE 0 END)::BIGINT AS {k.lower().replace(' ', '_')}" for k in KINDS)}
FROM dated GROUP BY 1""")
def q_finalized_by_kind(spark, base):
    # Date x row type / category
    return dated_cells(spark, base).groupBy("finalized_date").agg(*[
        F.count(F.when(F.col("cat_type") == k, 1)).alias(k.lower().replace(" ", "_")) for k in KINDS])


# ------------------------------------------------------------- process lag
LAG_SQL = CHAIN_SQL + """,
lag AS (SELECT cassette_id AS set_id, max(coalesce(d1.first, d2.first)) AS process_start, max(coalesce(d1.last, d2.last)) AS process_finish,
               max(filled_on) AS flex_fill
        FROM cells LEFT JOIN d1 ON d1.barcode = inventory LEFT JOIN d2 ON d2.barcode = inventory GROUP BY 1),
acked AS (SELECT lag.*, CAST(left(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 10) AS DATE) AS acknowledged FROM lag LEFT JOIN orders ON o_orderkey = set_id),
pipeline AS (SELECT DISTINCT p_brand AS crop, c_mktsegment AS market, acked.*
             FROM acked LEFT JOIN lineitem ON l_orderkey = set_id JOIN part ON p_partkey = l_partkey
             JOIN orders ON o_orderkey = set_id JOIN customer ON c_custkey = o_custkey)"""

SET_LINES = 250_000     # lines of the sets of one task, about


def process_lag(spark, base) -> DataFrame:
    """Crop, market and four times per set; a set of several crops
    has a row for each."""
    times = resolved(spark, base).select("inventory", F.coalesce("first_direct", "first_indirect").alias("first"),
                                         F.coalesce("last_direct", "last_indirect").alias("last"))
    # parts by set in proportion to the lines, so that no task's share grows with them
    parts = max(1, -(-T(spark, base, "lineitem").count() // SET_LINES))
    cells = split_lookup(filled_cells(spark, base).select("cassette_id", "inventory", "filled_on"), times, ["inventory"])
    lag = cells.repartition(parts, "cassette_id").groupBy(F.col("cassette_id").alias("set_id")).agg(
        F.max("first").alias("process_start"), F.max("last").alias("process_finish"), F.max("filled_on").alias("flex_fill"))
    o = T(spark, base, "orders").select(F.col("o_orderkey").alias("set_id"), "o_custkey",
                                        F.left(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(10)).cast("date").alias("acknowledged"))
    c = T(spark, base, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("market"))
    brands = T(spark, base, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("crop"))
    # distinct crops per set before they meet the sets
    crops = split_lookup(T(spark, base, "lineitem").select(F.col("l_orderkey").alias("set_id"), "l_partkey"), brands, ["l_partkey"], "inner") \
        .select("set_id", "crop").repartition(parts, "set_id").distinct()
    heads = o.join(c, "o_custkey").repartition(parts, "set_id")
    return lag.join(heads, "set_id").join(crops, "set_id").select(
        "crop", "market", "set_id", "process_start", "process_finish", "flex_fill", "acknowledged")


@register("process_lag", sql=f"WITH {LAG_SQL} SELECT * FROM pipeline")
def q_process_lag(spark, base):
    return process_lag(spark, base)


@register("process_lag_duplicates", sql=f"""
WITH {LAG_SQL},
days AS (SELECT DISTINCT crop, market, set_id, CAST(process_start AS DATE) AS process_start, CAST(process_finish AS DATE) AS process_finish,
                CAST(flex_fill AS DATE) AS flex_fill, acknowledged FROM pipeline)
SELECT set_id, count(*) AS n FROM days GROUP BY 1 HAVING count(*) > 1""")
def q_process_lag_duplicates(spark, base):
    days = process_lag(spark, base).select("crop", "market", "set_id", *[F.col(c).cast("date").alias(c) for c in ("process_start", "process_finish", "flex_fill")],
                                           "acknowledged").distinct()
    return days.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ------------------------------------------------------------- site dates
@register("site_dates", sql=CHAIN_SQL.replace("\nroster", "WITH roster", 1) + """,
fts AS (SELECT DISTINCT coalesce(sender, receiver) AS code FROM inv JOIN ex ON receiver = legacy OR sender = legacy),
proc AS (SELECT inv.barcode, ts FROM s3 JOIN inv ON bid = legacy JOIN fts ON code = bid),
packets AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
            WHERE s_name LIKE concat((SELECT r_name FROM region WHERE r_regionkey = 0) , '%') IS NOT TRUE AND l_linestatus = 'F' AND l_shipdate >= DATE '1996-01-01' GROUP BY 1, 2)
SELECT l.l_orderkey AS set_id, o_custkey AS experiment_id, min(ts) AS process_start, max(ts) AS process_end,
       min(a) AS packet_fill_start, max(b) AS packet_fill_end
FROM lineitem l JOIN (SELECT barcode, min(ts) AS ts FROM proc GROUP BY 1 UNION ALL SELECT barcode, max(ts) FROM proc GROUP BY 1) p ON p.barcode = l.l_partkey
JOIN packets k ON k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber JOIN orders ON o_orderkey = l.l_orderkey
WHERE l.l_returnflag IN ('A', 'N') GROUP BY 1, 2""")
def q_site_dates(spark, base):
    inv, ex = inventory(spark, base), exchanges(spark, base)
    codes = or_join(ex, inv, ["receiver", "sender"], "legacy").select(F.coalesce("sender", "receiver").alias("bid")).distinct()
    proc = process_times(spark, base).join(codes, "bid", "left_semi").join(inv, F.col("bid") == F.col("legacy")) \
        .select(F.col("barcode").alias("l_partkey"), "first", "last")
    li = T(spark, base, "lineitem")
    prefix = T(spark, base, "region").where("r_regionkey = 0").select(F.concat("r_name", F.lit("%")).alias("p")).scalar()
    there = T(spark, base, "supplier").where(~F.coalesce(F.call_function("like", F.col("s_name"), prefix), F.lit(False))).select(F.col("s_suppkey").alias("l_suppkey"))
    packets = split_lookup(li.where((F.col("l_linestatus") == "F") & (F.col("l_shipdate") >= ntz(FILLED_SINCE)))
                           .select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"), there, ["l_suppkey"], "inner") \
        .groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    entries = li.where(F.col("l_returnflag").isin("A", "N")).select("l_orderkey", "l_linenumber", "l_partkey")
    # folded per entry before it meets the packets
    timed = split_lookup(entries, proc, ["l_partkey"], "inner").groupBy("l_orderkey", "l_linenumber").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    o = T(spark, base, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("experiment_id"))
    return timed.join(packets, ["l_orderkey", "l_linenumber"]).join(o, "l_orderkey").groupBy(F.col("l_orderkey").alias("set_id"), "experiment_id").agg(
        F.min("first").alias("process_start"), F.max("last").alias("process_end"), F.min("a").alias("packet_fill_start"), F.max("b").alias("packet_fill_end"))
