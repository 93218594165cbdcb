"""Daily cell and packet reports in full, with running totals, and the two
traces (C1, C3, C4, C5, C7, C8, C40, C41, W1, W2).

Cells: ``lineitem`` of status F are cells filled at a station (hopper
``l_suppkey`` mod 12) whose set, ``orders`` of the target year, names the crop;
status O are cells filled by serial whose field, ``part``, names it.  Packets:
the scans of both machine types, counted through three routes (packet numbers,
plots, packaging plans).  ``customer`` are entries, ``nation`` requests,
``supplier`` packaging plans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sowline.config import Declares
from sowline.functions.dates import in_local_days, ntz, utc_day
from sowline.operators.aggregates import zero_fill
from sowline.operators.dims import calendar, machine_dim
from sowline.operators.distinct import count_words, id_words
from sowline.operators.relational import union_all
from sowline.operators.reshape import pivot_sum
from sowline.operators.scan import block_scan
from sowline.operators.skew import split_lookup
from sowline.operators.windows import running_total
from sowline.plans.coverage import PACKET_BARCODE, SQL_BARCODE, _barcode
from sowline.plans.feeds import SQL_SITE, _site
from sowline.plans.registry import register
from sowline.sources.tables import read_table

CELLS = Declares(dt.date(1998, 1, 1), dt.date(1998, 12, 30), sites=("S0", "S1"), labels=("ECONOMY", "STANDARD"))
TARGET_YEAR, STATION = 1998, "10002"
ROSTER = {"S0": ("10002-001", "10002-002", "10002-004", "10002-007"), "S1": ("10002-005", "10002-008", "10002-010", "10003-011")}
# checked in order: 10002-007 is in both lists and becomes cat3 (M9)
CATEGORIES = (("cat3", ("10002-004", "10002-007", "10002-008")), ("cat2", ("10002-001", "10002-007", "10002-010")))

PACKETS = Declares(dt.date(1998, 1, 1), dt.date(1998, 12, 30), sites=("S0", "S1"), labels=("1-URGENT", "2-HIGH", "5-LOW"))
# packet machines by category, checked in order
CAT3_SERIALS = ("004", "006", "009", "015")
CAT2_SERIALS = ("003", "006", "012", "018")
PLAN_CROPS = ("NATION_3", "NATION_7", "NATION_12")

SQL_DAYS = "generate_series(DATE '1998-01-01', DATE '1998-12-30', INTERVAL 1 DAY) g(d)"
SQL_SERIAL = "CASE l_suppkey % 12 WHEN 11 THEN '10003-' ELSE '10002-' END || lpad(CAST(l_suppkey % 12 AS VARCHAR), 3, '0')"
SQL_CELLS = f"""
roster AS (
  SELECT serial, ltrim(regexp_extract(serial, '^[a-zA-Z0-9_.+-]+\\-([a-zA-Z0-9-.]+$)', 1), '0') AS hopper, site,
         CASE WHEN serial IN ('10002-004', '10002-007', '10002-008') THEN 'cat3'
              WHEN serial IN ('10002-001', '10002-007', '10002-010') THEN 'cat2' END AS category
  FROM (VALUES ('10002-001', 'S0'), ('10002-002', 'S0'), ('10002-004', 'S0'), ('10002-007', 'S0'),
               ('10002-005', 'S1'), ('10002-008', 'S1'), ('10002-010', 'S1'), ('10003-011', 'S1')) v(serial, site)),
station_cells AS (
  SELECT CAST(l.l_shipdate AS DATE) AS date, coalesce(ps.o_orderpriority, 'Velocity Crop Unknown') AS crop, r.site, r.category,
         count(*) AS n_cells
  FROM lineitem l
  LEFT JOIN (SELECT o_orderkey, o_orderpriority FROM orders WHERE year(o_orderdate) = 1998) ps ON ps.o_orderkey = l.l_orderkey
  JOIN roster r ON r.hopper = CAST(l.l_suppkey % 12 AS VARCHAR)
  WHERE l.l_linestatus = 'F' AND CASE l.l_suppkey % 12 WHEN 11 THEN '10003' ELSE '10002' END = '10002'
    AND CAST(l.l_shipdate AS DATE) >= DATE '1998-01-01'
  GROUP BY ALL),
serial_cells AS (
  SELECT CAST(l.l_shipdate AS DATE) AS date, coalesce(f.crop, 'FTS Crop Unknown') AS crop, r.site, r.category, count(*) AS n_cells
  FROM (SELECT l_shipdate, {SQL_SERIAL} AS serial, {SQL_BARCODE} AS barcode,
               'Brand#' || CAST(l_partkey % 25 + 1 AS VARCHAR) AS field_id
        FROM lineitem WHERE l_linestatus = 'O') l
  LEFT JOIN (SELECT DISTINCT p_type AS crop, p_brand FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_size < 10) f
    ON f.p_brand = l.field_id
  JOIN roster r ON r.serial = l.serial
  WHERE CAST(l.l_shipdate AS DATE) >= DATE '1998-01-01' AND starts_with(l.barcode, 'P0')
  GROUP BY ALL),
merged AS (SELECT * FROM station_cells UNION ALL SELECT * FROM serial_cells),
date_range AS (SELECT CAST(g.d AS DATE) AS day, v.s AS site FROM {SQL_DAYS}, (VALUES ('S0'), ('S1')) v(s)),
by_category AS (
  SELECT d.day, m.site, m.category, CAST(coalesce(sum(m.n_cells), 0) AS BIGINT) AS counted
  FROM date_range d LEFT JOIN merged m ON d.day = m.date AND d.site = m.site
  WHERE m.site = 'S0' GROUP BY d.day, m.site, m.category)"""


def _cells(spark, base, keys):
    """Counts of both cell feeds per ``date``, ``site`` and ``keys`` ("crop" or
    "category"); every feed is counted per machine and day before its lookup."""
    roster = machine_dim(spark, ROSTER, CATEGORIES)     # sized by its parameters
    number = F.col("l_suppkey") % 12
    prefix = F.when(number == 11, "10003").otherwise("10002")
    li = read_table(spark, base, "lineitem").where(in_local_days("l_shipdate", "UTC", CELLS.start_date, CELLS.end_date))
    date = utc_day("l_shipdate").alias("date")

    by_hopper = li.where((F.col("l_linestatus") == "F") & (prefix == STATION)) \
        .select(date, number.cast("string").alias("hopper"), F.col("l_orderkey").alias("o_orderkey")) \
        .join(F.broadcast(roster.select("hopper", "site", "category")), "hopper")
    by_serial = li.where((F.col("l_linestatus") == "O") & _barcode().startswith("P0")).select(
        date, F.concat(prefix, F.lit("-"), F.lpad(number.cast("string"), 3, "0")).alias("serial"),
        F.concat(F.lit("Brand#"), (F.col("l_partkey") % 25 + 1).cast("string")).alias("p_brand")) \
        .join(F.broadcast(roster.select("serial", "site", "category")), "serial")
    count = F.count(F.lit(1)).alias("n")
    first = by_hopper.groupBy("date", "site", "category", "o_orderkey").agg(count)
    second = by_serial.groupBy("date", "site", "category", "p_brand").agg(count)
    # a field of two crops gives its cells twice, as the source's join does
    fields = read_table(spark, base, "part").where(F.col("p_type").isin(*CELLS.labels) & (F.col("p_size") < 10)) \
        .select(F.col("p_type").alias("crop"), "p_brand").distinct()
    second = split_lookup(second, fields, ["p_brand"])
    if "crop" in keys:      # the set is a key of its table: without its crop the lookup changes nothing
        sets = read_table(spark, base, "orders").where((F.col("o_orderdate") >= ntz(f"{TARGET_YEAR}-01-01")) & (F.col("o_orderdate") < ntz(f"{TARGET_YEAR + 1}-01-01"))) \
            .select("o_orderkey", F.col("o_orderpriority").alias("crop"))
        first = split_lookup(first, sets, ["o_orderkey"]).withColumn("crop", F.coalesce("crop", F.lit("Velocity Crop Unknown")))
        second = second.withColumn("crop", F.coalesce("crop", F.lit("FTS Crop Unknown")))
    out = ["date", "site", *keys]
    return union_all([f.groupBy(*out).agg(F.sum("n").alias("n_cells")) for f in (first, second)])


def _cells_by_category(spark, base):
    # the filter on the cells' site drops the days without cells, so the calendar bounds the days only
    dim = calendar(spark, CELLS.start_date, CELLS.end_date, CELLS.sites)
    filled = zero_fill(dim, _cells(spark, base, ["category"]), [("day", "date"), ("site", "site")], "n_cells",
                       group_right=["site", "category"], mode="faithful", out="counted")
    return filled.where(F.col("site") == "S0")


@register("cells_daily", sql=f"""
WITH {SQL_CELLS},
counted_cells AS (
  SELECT d.day, m.crop, m.site, CAST(coalesce(sum(m.n_cells), 0) AS BIGINT) AS counted
  FROM date_range d LEFT JOIN merged m ON d.day = m.date AND d.site = m.site
  GROUP BY d.day, m.crop, m.site)
SELECT *, CAST(sum(counted) OVER (PARTITION BY crop, site ORDER BY day
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_counted
FROM counted_cells""")
def q_cells_daily(spark, base):
    dim = calendar(spark, CELLS.start_date, CELLS.end_date, CELLS.sites)
    counted = zero_fill(dim, _cells(spark, base, ["crop"]), [("day", "date"), ("site", "site")], "n_cells",
                        group_right=["crop", "site"], mode="faithful", out="counted")
    # a row a day in each group
    return running_total(counted, "counted", ["crop", "site"], ["day"], out="total_counted")


@register("cells_daily_by_category", sql=f"""
WITH {SQL_CELLS}
SELECT day, site, category, counted FROM by_category""")
def q_cells_daily_by_category(spark, base):
    return _cells_by_category(spark, base)


@register("cells_daily_category_columns", sql=f"""
WITH {SQL_CELLS}
SELECT day, CAST(sum(CASE WHEN category = 'cat2' THEN counted END) AS BIGINT) AS cat2,
       CAST(sum(CASE WHEN category = 'cat3' THEN counted END) AS BIGINT) AS cat3
FROM by_category GROUP BY day""")
def q_cells_daily_category_columns(spark, base):
    return pivot_sum(_cells_by_category(spark, base), ["day"], "category", {"cat2": "cat2", "cat3": "cat3"},
                     value="counted", fill_zero=False)


SQL_PLAN_CROPS = ", ".join(f"'{c}'" for c in PLAN_CROPS)
SQL_PACKETS = f"""
scans AS (
  SELECT *, lpad(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') AS serial, {SQL_BARCODE} AS barcode, {SQL_SITE} AS site,
         CASE l_linenumber WHEN 7 THEN 'TOTALIZER' WHEN 6 THEN NULL ELSE 'BATCH' END AS source_barcode
  FROM lineitem),
all_packets AS (
  SELECT CAST(l_shipdate AS DATE) AS date, barcode, site, serial, l_orderkey AS record_id,
         CASE WHEN serial IN ('004', '006', '009', '015') THEN 'cat3'
              WHEN serial IN ('003', '006', '012', '018') THEN 'cat2' END AS category
  FROM scans
  WHERE l_linestatus IN ('F', 'O') AND site IN ('S0', 'S1') AND source_barcode <> 'TOTALIZER'
    AND regexp_matches(barcode, '{PACKET_BARCODE}') AND l_shipdate >= TIMESTAMP '1998-01-01'),
requests AS (SELECT c.c_custkey AS entry_id, n.n_name AS crop FROM customer c
             JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 4),
numbered AS (
  SELECT v.date, v.site, v.serial, v.category, r.crop, count(*) AS n_packets
  FROM (SELECT a.*, unnest(CASE WHEN p.p_size > 25 THEN [p.p_partkey, p.p_partkey + 1] ELSE [p.p_partkey] END) AS entry_id
        FROM all_packets a JOIN part p ON TRY_CAST(a.barcode AS BIGINT) = p.p_partkey WHERE regexp_matches(a.barcode, '^\\d')) v
  LEFT JOIN requests r ON r.entry_id = v.entry_id
  GROUP BY ALL),
plots AS (
  SELECT a.date, a.site, a.serial, a.category, o.o_orderpriority AS crop, count(DISTINCT a.record_id) AS n_packets
  FROM all_packets a JOIN orders o ON a.barcode = 'P0' || CAST(o.o_orderkey AS VARCHAR)
  WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY ALL),
plots_by_site AS (
  SELECT a.date, a.site, o.o_orderpriority AS crop, count(DISTINCT a.record_id) AS n_packets
  FROM all_packets a JOIN orders o ON a.barcode = 'P0' || CAST(o.o_orderkey AS VARCHAR)
  WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY ALL),
planned AS (
  SELECT v.date, v.site, CAST(NULL AS VARCHAR) AS category,
         CASE r.crop WHEN 'NATION_7' THEN 'NATION_3' ELSE r.crop END AS crop, count(*) AS n_packets
  FROM (SELECT CAST(l.l_shipdate AS DATE) AS date, CASE WHEN s.s_nationkey < 5 THEN 'S1' ELSE 'S0' END AS site,
               unnest(CASE WHEN l.l_quantity > 25 THEN [l.l_partkey, l.l_partkey + 1] ELSE [l.l_partkey] END) AS entry_id
        FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey < 15
        WHERE l.l_returnflag = 'R' AND l.l_shipdate >= TIMESTAMP '1998-01-01') v
  LEFT JOIN requests r ON r.entry_id = v.entry_id AND r.crop IN ({SQL_PLAN_CROPS})
  GROUP BY v.date, v.site, r.crop)"""


def _category(serial):
    return F.when(serial.isin(*CAT3_SERIALS), "cat3").when(serial.isin(*CAT2_SERIALS), "cat2")


def _packets_daily(spark, base, by_machine):
    """Packets of the three routes per ``date`` and ``site`` (and machine
    category), those without a crop left out, as the report's filter does."""
    li = read_table(spark, base, "lineitem").where(in_local_days("l_shipdate", "UTC", PACKETS.start_date, PACKETS.end_date))
    date = utc_day("l_shipdate").alias("date")
    source = F.when(F.col("l_linenumber") == 7, "TOTALIZER").when(F.col("l_linenumber") != 6, "BATCH")
    feed = lambda status: li.where((F.col("l_linestatus") == status) & (source != "TOTALIZER")).select(
        date, _site().alias("site"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 3, "0").alias("serial"),
        _barcode().alias("barcode"), F.col("l_orderkey").alias("record_id"))
    scans = union_all([feed("F"), feed("O")]).where(F.col("site").isin(*PACKETS.sites) & F.col("barcode").rlike(PACKET_BARCODE))
    machine = ["serial"] if by_machine else []
    keys = ["date", "site", *machine]

    entries = F.when(F.col("p_size") > 25, F.array(F.col("p_partkey"), F.col("p_partkey") + 1)).otherwise(F.array("p_partkey"))
    packets = read_table(spark, base, "part").select("p_partkey", entries.alias("entry_ids"))
    entry = read_table(spark, base, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_nationkey").alias("n_nationkey"))
    requests = read_table(spark, base, "nation").where("n_regionkey < 4").select("n_nationkey", F.col("n_name").alias("crop"))
    # a row without a crop is left out at the end: both lookups are inner ones
    entry_crops = entry.join(requests, "n_nationkey").select("entry_id", "crop")

    # additive, so counted per packet and day before the lookups: a hot packet is one row a machine day
    numbers = scans.where(F.col("barcode").rlike(r"^\d")) \
        .groupBy(*keys, F.col("barcode").try_cast("bigint").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    numbered = split_lookup(numbers, packets, ["p_partkey"], "inner").select(*keys, "n", F.explode("entry_ids").alias("entry_id"))
    numbered = split_lookup(numbered, entry_crops.select("entry_id"), ["entry_id"], "inner").groupBy(*keys).agg(F.sum("n").alias("n"))

    plots = read_table(spark, base, "orders").where(F.col("o_orderpriority").isin(*PACKETS.labels)) \
        .select(F.concat(F.lit("P0"), F.col("o_orderkey").cast("string")).alias("barcode"), F.col("o_orderpriority").alias("crop"))
    scanned = split_lookup(scans.where(F.col("barcode").startswith("P0")), plots, ["barcode"], "inner")
    plotted = count_words(id_words(scanned, [*keys, "crop"], "record_id"), [*keys, "crop"], "n").drop("crop")

    plan = read_table(spark, base, "supplier").where("s_nationkey < 15").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    pair = F.when(F.col("l_quantity") > 25, F.array(F.col("l_partkey"), F.col("l_partkey") + 1)).otherwise(F.array("l_partkey"))
    planned = split_lookup(li.where("l_returnflag = 'R'").select(date, "l_suppkey", pair.alias("entry_ids")), plan, ["l_suppkey"], "inner") \
        .select("date", F.when(F.col("s_nationkey") < 5, "S1").otherwise("S0").alias("site"), F.explode("entry_ids").alias("entry_id")) \
        .groupBy("date", "site", "entry_id").agg(F.count(F.lit(1)).alias("n"))
    listed = entry_crops.where(F.col("crop").isin(*PLAN_CROPS)).select("entry_id")
    planned = split_lookup(planned, listed, ["entry_id"], "inner").groupBy("date", "site").agg(F.sum("n").alias("n"))

    routes = [numbered, plotted, planned.withColumn("serial", F.lit(None).cast("string")) if by_machine else planned]
    out = union_all([r.select(*keys, "n") for r in routes])
    return out.select("date", "site", _category(F.col("serial")).alias("category"), "n") if by_machine else out


@register("packets_daily", sql=f"""
WITH {SQL_PACKETS},
merged AS (
  SELECT date, site, crop, sum(n_packets) AS n FROM numbered GROUP BY ALL
  UNION ALL SELECT date, site, crop, n_packets FROM plots_by_site
  UNION ALL SELECT date, site, crop, n_packets FROM planned),
counted_packets AS (
  SELECT d.day, m.site, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS counted
  FROM (SELECT CAST(g.d AS DATE) AS day FROM {SQL_DAYS}) d LEFT JOIN merged m ON d.day = m.date
  WHERE m.crop IS NOT NULL GROUP BY d.day, m.site),
totals AS (
  SELECT *, CAST(sum(counted) OVER (PARTITION BY site ORDER BY day
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_counted
  FROM counted_packets)
SELECT * FROM totals WHERE site = 'S0'""")
def q_packets_daily(spark, base):
    # packets without a crop are out, and days without packets with them: the days are those of the data
    counted = _packets_daily(spark, base, False).groupBy(F.col("date").alias("day"), "site").agg(F.sum("n").alias("counted"))
    return running_total(counted, "counted", ["site"], ["day"], out="total_counted").where(F.col("site") == "S0")


@register("packets_daily_category_columns", sql=f"""
WITH {SQL_PACKETS},
merged AS (
  SELECT date, site, category, crop, n_packets FROM numbered
  UNION ALL SELECT date, site, category, crop, n_packets FROM plots
  UNION ALL SELECT date, site, category, crop, n_packets FROM planned),
counted_packets AS (
  SELECT d.day, m.site, m.category, coalesce(sum(m.n_packets), 0) AS counted
  FROM (SELECT CAST(g.d AS DATE) AS day FROM {SQL_DAYS}) d LEFT JOIN merged m ON d.day = m.date
  WHERE m.crop IS NOT NULL AND m.site = 'S0' GROUP BY d.day, m.site, m.category)
SELECT day, CAST(sum(CASE WHEN category = 'cat2' THEN counted END) AS BIGINT) AS cat2,
       CAST(sum(CASE WHEN category = 'cat3' THEN counted END) AS BIGINT) AS cat3,
       CAST(sum(CASE WHEN category IS NULL THEN counted END) AS BIGINT) AS none
FROM counted_packets GROUP BY day""")
def q_packets_daily_category_columns(spark, base):
    days = _packets_daily(spark, base, True).where(F.col("site") == "S0").withColumnRenamed("date", "day")
    return pivot_sum(days, ["day"], "category", {"cat2": "cat2", "cat3": "cat3"}, value="n", null_column="none", fill_zero=False)


@register("event_running_totals", sql="""
WITH e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
SELECT event_id, event_type,
       CAST(sum(cents) OVER w AS BIGINT) AS total_cents,
       count(*) OVER w AS total_events,
       last_value(CASE WHEN user_id % 2 = 0 THEN user_id END IGNORE NULLS) OVER w AS last_even_user
FROM e
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_event_running_totals(spark, base):
    # event grain: a type may hold a third of all events, so the window runs inside (type, day) and days hand on their sums
    ev = read_table(spark, base, "events").select("event_id", "event_type", "ts", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    out = block_scan(ev, ["event_type"], ["ts", "event_id"], utc_day("ts"),
                     sums={"total_cents": F.col("cents"), "total_events": F.lit(1).cast("long")},
                     lasts={"last_even_user": F.when(F.col("user_id") % 2 == 0, F.col("user_id"))})
    return out.select("event_id", "event_type", "total_cents", "total_events", "last_even_user")


@register("plant_trace", sql=f"""
WITH a AS (
  SELECT o.o_orderkey AS entry_id, c.c_name AS cassette_barcode, c.c_custkey AS cassette_id, o.o_orderpriority AS crop,
         TRY_CAST(CASE WHEN o.o_orderkey % 7 = 0 THEN 'cell ' ELSE '' END || CAST(o.o_orderkey % 40 AS VARCHAR) AS DECIMAL(38, 9)) AS cell_number
  FROM orders o JOIN customer c ON 'Customer#' || lpad(CAST(o.o_custkey AS VARCHAR), 9, '0') = c.c_name),
b AS (
  SELECT a.*, e.event_id % 2000 AS packet, e.value AS fill_quantity
  FROM a JOIN events e ON e.user_id = a.cassette_id AND CAST(e.event_id % 40 AS DECIMAL(38, 9)) = a.cell_number
  WHERE year(e.ts) >= 2024),
c AS (
  SELECT {SQL_BARCODE} AS barcode, {SQL_SITE} AS site, 'YTP' AS batch_type, l_quantity AS batch_count FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL
  SELECT {SQL_BARCODE}, {SQL_SITE}, 'NSP', l_quantity FROM lineitem WHERE l_linestatus = 'O')
SELECT b.cassette_id, CAST(b.cell_number AS BIGINT) AS cell_number, b.cassette_barcode, b.packet, b.entry_id, b.crop, b.fill_quantity,
       c.site, c.batch_type, c.batch_count
FROM b JOIN c ON CAST(b.packet AS VARCHAR) = c.barcode WHERE c.site = 'S0'""")
def q_plant_trace(spark, base):
    text = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "cell ").otherwise(""), (F.col("o_orderkey") % 40).cast("string"))
    planted = read_table(spark, base, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("crop"), text.try_cast("decimal(38,9)").alias("cell_number"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("cassette_barcode"))
    cassettes = read_table(spark, base, "customer").select(F.col("c_name").alias("cassette_barcode"), F.col("c_custkey").alias("cassette_id"))
    # a cell text that is no number matches nothing: left out before any shuffle
    rows = split_lookup(planted.dropna(subset=["cell_number"]), cassettes, ["cassette_barcode"], "inner")
    filled = read_table(spark, base, "events").where(F.col("ts") >= ntz("2024-01-01")).select(
        F.col("user_id").alias("cassette_id"), (F.col("event_id") % 40).cast("decimal(38,9)").alias("cell_number"),
        (F.col("event_id") % 2000).alias("packet"), F.col("value").alias("fill_quantity"))
    # many planted rows and many fillings of one cell are all wanted: the heavy cells' rows are dealt, their fillings repeated
    rows = split_lookup(rows, filled, ["cassette_id", "cell_number"], "inner").withColumn("barcode", F.col("packet").cast("string"))
    li = read_table(spark, base, "lineitem").where((_site() == "S0") & (F.col("l_returnflag") == "N"))
    feed = lambda status, kind: li.where(F.col("l_linestatus") == status).select(
        _barcode().alias("barcode"), _site().alias("site"), F.lit(kind).alias("batch_type"), F.col("l_quantity").alias("batch_count"))
    scans = union_all([feed("F", "YTP"), feed("O", "NSP")])     # only packet numbers can equal a packet: plots and validations are out
    return split_lookup(rows, scans, ["barcode"], "inner").select(
        "cassette_id", F.col("cell_number").cast("long").alias("cell_number"), "cassette_barcode", "packet", "entry_id", "crop", "fill_quantity",
        "site", "batch_type", "batch_count")


@register("packet_trace", sql=f"""
WITH p AS (
  SELECT p_partkey AS packet, p_name AS packet_group, p_size AS sequence_number, p_partkey * 3 AS inventory_barcode,
         unnest(CASE WHEN p_size > 25 THEN [p_partkey, p_partkey + 1] ELSE [p_partkey] END) AS entry_id
  FROM part),
ts AS (SELECT c_custkey AS entry_id, c_name AS set_name, c_custkey % 100 AS set_id, c_nationkey AS request_id FROM customer),
cr AS (SELECT n_nationkey AS request_id, n_name AS crops,
              unnest(CASE WHEN n_regionkey % 2 = 0 THEN [10, 20] ELSE [15] END) AS plot_row_length
       FROM nation WHERE n_regionkey < 4),
scans AS (SELECT l_linestatus, {SQL_BARCODE} AS barcode, l_quantity AS batch_count, lpad(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') AS serial,
                 strftime(l_shipdate, '%m-%d-%Y') AS child_scan FROM lineitem)
SELECT DISTINCT pp.s_nationkey AS fulfillment_group, cr.crops, cr.plot_row_length, ts.set_name, ts.set_id, ts.entry_id,
       p.inventory_barcode, l.c_custkey AS lot_id, i.o_orderpriority AS material, p.packet, p.packet_group, p.sequence_number,
       y.batch_count AS ytp_batch_count, y.serial AS ytp_serial, y.barcode AS ytp_barcode, y.child_scan AS ytp_child_scan,
       n.batch_count AS nsp_batch_count, n.serial AS nsp_serial, n.barcode AS nsp_barcode, n.child_scan AS nsp_child_scan
FROM p
JOIN ts ON ts.entry_id = p.entry_id
JOIN supplier pp ON pp.s_suppkey = ts.set_id AND pp.s_nationkey = 4
JOIN cr ON cr.request_id = ts.request_id
LEFT JOIN scans y ON CAST(p.packet AS VARCHAR) = y.barcode AND y.l_linestatus = 'F'
LEFT JOIN scans n ON CAST(p.packet AS VARCHAR) = n.barcode AND n.l_linestatus = 'O'
LEFT JOIN orders i ON i.o_orderkey = p.inventory_barcode
LEFT JOIN customer l ON l.c_custkey = i.o_custkey AND l.c_nationkey < 20
WHERE ts.set_name LIKE '%0000%'""")
def q_packet_trace(spark, base):
    entries = F.when(F.col("p_size") > 25, F.array(F.col("p_partkey"), F.col("p_partkey") + 1)).otherwise(F.array("p_partkey"))
    packets = read_table(spark, base, "part").select(
        F.col("p_partkey").alias("packet"), F.col("p_name").alias("packet_group"), F.col("p_size").alias("sequence_number"),
        (F.col("p_partkey") * 3).alias("inventory_barcode"), F.explode(entries).alias("entry_id"))
    sets = read_table(spark, base, "customer").where(F.col("c_name").like("%0000%")).select(
        F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("set_name"), (F.col("c_custkey") % 100).alias("set_id"),
        F.col("c_nationkey").alias("request_id"))
    plans = read_table(spark, base, "supplier").where("s_nationkey = 4").select(
        F.col("s_suppkey").alias("set_id"), F.col("s_nationkey").alias("fulfillment_group"))
    lengths = F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit(10), F.lit(20))).otherwise(F.array(F.lit(15)))
    requests = read_table(spark, base, "nation").where("n_regionkey < 4").select(
        F.col("n_nationkey").alias("request_id"), F.col("n_name").alias("crops"), F.explode(lengths).alias("plot_row_length"))
    inventory = read_table(spark, base, "orders").select(
        F.col("o_orderkey").alias("inventory_barcode"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("material"))
    lots = read_table(spark, base, "customer").where("c_nationkey < 20").select("c_custkey", F.col("c_custkey").alias("lot_id"))
    li = read_table(spark, base, "lineitem").where(F.col("l_returnflag") == "N")

    def scans(status, name):
        # the report lists distinct rows, so equal scans are one row before they multiply
        return li.where(F.col("l_linestatus") == status).select(
            _barcode().alias("barcode"), F.col("l_quantity").alias(f"{name}_batch_count"),
            F.lpad((F.col("l_suppkey") % 20).cast("string"), 3, "0").alias(f"{name}_serial"), _barcode().alias(f"{name}_barcode"),
            F.date_format("l_shipdate", "MM-dd-yyyy").alias(f"{name}_child_scan")).distinct()

    # the inner joins narrow the packets before the scans are met
    rows = split_lookup(packets, sets.join(plans, "set_id").join(requests, "request_id").drop("request_id"), ["entry_id"], "inner")
    # a lot may hold a third of the inventory, so lots are met there; a packet and its inventory are keys of their tables
    stock = split_lookup(inventory, lots, ["c_custkey"]).drop("c_custkey")
    rows = rows.join(stock, "inventory_barcode", "left").withColumn("barcode", F.col("packet").cast("string"))
    rows = rows.join(scans("F", "ytp"), "barcode", "left").join(scans("O", "nsp"), "barcode", "left")
    return rows.drop("barcode").distinct()
