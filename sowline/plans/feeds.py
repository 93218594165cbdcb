"""Packet and cell feeds in full: season totals, sessions shipped, row-level
events by local day (C6, C9, C10, C12, C16, P10).

``lineitem`` is the scan log: line status F and O are the two machine types,
``l_suppkey`` the machine (its site by remainder), ``l_shipdate`` the UTC scan
time.  Return flag A scans carry a plot barcode (P0 + order), N scans a packet
number (the part), R scans are validations.  ``part`` is the packet table with
its entry ids, ``customer`` the entries, ``nation`` the requests with their
crop, ``orders`` the plots and sets.  ``events`` are filled cells.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sowline.config import Declares
from sowline.functions.dates import in_local_days, local_day, utc_day
from sowline.functions.text import decode_hopper, ltrim_chars
from sowline.operators.distinct import count_words, id_words, merge_words
from sowline.operators.relational import union_all
from sowline.operators.skew import split_lookup
from sowline.plans.coverage import PACKET_BARCODE, SQL_BARCODE, _barcode
from sowline.plans.registry import register
from sowline.sources.tables import constants, read_table

SEASONS = Declares(dt.date(1997, 1, 1), dt.date(1999, 12, 31), sites=("S0", "S1"),
                   labels=("1-URGENT", "2-HIGH", "NATION_3", "NATION_7", "NATION_12", "NATION_20"))
ZONE, SITES, CROPS = SEASONS.local_time_zone, SEASONS.sites, SEASONS.labels
CELLS = Declares(dt.date(2024, 1, 10), dt.date(2024, 1, 31))
SHIP_START, SHIP_END = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
# machine serials of the row-level report; hoppers 4, 7 and 11
SERIALS = ("10002-004", "10002-007", "10003-011")

SQL_LOCAL = "CAST(timezone('America/Chicago', timezone('UTC', {0})) AS DATE)".format
SQL_SITE = "CASE l_suppkey % 3 WHEN 0 THEN 'S0' WHEN 1 THEN 'S1' ELSE 'S2' END"
SQL_CROPS = ", ".join(f"'{c}'" for c in CROPS)


def _site():
    return F.when(F.col("l_suppkey") % 3 == 0, "S0").when(F.col("l_suppkey") % 3 == 1, "S1").otherwise("S2")


def _season(day):
    return F.when(F.month(day) < 7, "Q1/Q2").when(F.month(day) >= 7, "Q3/Q4")


def _packets(spark, base):
    """Scans of both machine types at the listed sites and years, by local day."""
    li = read_table(spark, base, "lineitem").where(
        (F.col("l_shipdate") >= F.lit(SEASONS.start_date).cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit(SEASONS.end_date + dt.timedelta(days=1)).cast("timestamp_ntz")))
    feed = lambda status: li.where(F.col("l_linestatus") == status).select(
        local_day("l_shipdate", ZONE).alias("date"), _site().alias("site"), _barcode().alias("barcode"),
        F.col("l_orderkey").alias("record_id"))
    return union_all([feed("F"), feed("O")]).where(F.col("site").isin(*SITES) & F.col("barcode").rlike(PACKET_BARCODE))


def _velocity_days(spark, base):
    """Packets by number, unnested to their entries, with the crop of the request."""
    # additive, so counted per packet before any lookup: a hot packet is one row a day and site
    scans = _packets(spark, base).where(F.col("barcode").rlike(r"^\d")) \
        .groupBy("date", "site", F.col("barcode").try_cast("bigint").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.when(F.col("p_size") > 25, F.array(F.col("p_partkey"), F.col("p_partkey") + 1)).otherwise(F.array("p_partkey"))
    packets = read_table(spark, base, "part").select("p_partkey", entries.alias("entry_ids"))
    entry = read_table(spark, base, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_nationkey").alias("n_nationkey"))
    request = read_table(spark, base, "nation").select("n_nationkey", F.col("n_name").alias("crop"))
    rows = scans.join(packets, "p_partkey").select("date", "site", "n", F.explode("entry_ids").alias("entry_id"))
    by_request = rows.join(entry, "entry_id", "left").groupBy("date", "site", "n_nationkey").agg(F.sum("n").alias("n"))
    return by_request.join(request, "n_nationkey", "left").groupBy("date", "site", "crop") \
        .agg(F.sum("n").alias("n_packets")).withColumn("source", F.lit("velocity"))


def _plot_words(spark, base):
    """Scanned records of plots as bits per day, site and crop."""
    plots = read_table(spark, base, "orders").where(F.col("o_orderpriority").isin(*CROPS)) \
        .select(F.concat(F.lit("P0"), F.col("o_orderkey").cast("string")).alias("barcode"), F.col("o_orderpriority").alias("crop"))
    scans = split_lookup(_packets(spark, base).where(F.col("barcode").startswith("P0")), plots, ["barcode"], "inner")
    return id_words(scans, ["date", "site", "crop"], "record_id")


def _plot_days(spark, base):
    return count_words(_plot_words(spark, base), ["date", "site", "crop"], "n_packets").withColumn("source", F.lit("plots"))


SQL_PACKETS = f"""
all_packets AS (
  SELECT {SQL_LOCAL('l_shipdate')} AS date, {SQL_SITE} AS site, {SQL_BARCODE} AS barcode, l_orderkey AS record_id
  FROM lineitem
  WHERE l_linestatus IN ('F', 'O') AND year(l_shipdate) IN (1997, 1998, 1999) AND {SQL_SITE} IN ('S0', 'S1')
    AND regexp_matches({SQL_BARCODE}, '{PACKET_BARCODE}')),
velocity AS (
  SELECT v.date, v.site, n.n_name AS crop, 'velocity' AS source, count(*) AS n_packets
  FROM (SELECT a.date, a.site, unnest(CASE WHEN p.p_size > 25 THEN [p.p_partkey, p.p_partkey + 1] ELSE [p.p_partkey] END) AS entry_id
        FROM all_packets a JOIN part p ON TRY_CAST(a.barcode AS BIGINT) = p.p_partkey
        WHERE regexp_matches(a.barcode, '^\\d')) v
  LEFT JOIN customer c ON c.c_custkey = v.entry_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  GROUP BY ALL),
plot_scans AS (
  SELECT a.date, a.site, o.o_orderpriority AS crop, a.record_id
  FROM all_packets a JOIN orders o ON a.barcode = 'P0' || CAST(o.o_orderkey AS VARCHAR)
  WHERE o.o_orderpriority IN ({SQL_CROPS})),
plots AS (SELECT date, site, crop, 'plots' AS source, count(DISTINCT record_id) AS n_packets FROM plot_scans GROUP BY ALL)"""


@register("packets_by_season", sql=f"""
WITH {SQL_PACKETS}
SELECT site, CAST(year(date) AS INTEGER) AS year, CASE WHEN month(date) < 7 THEN 'Q1/Q2' ELSE 'Q3/Q4' END AS season,
       crop, source, CAST(sum(n_packets) AS BIGINT) AS n_packets
FROM (SELECT * FROM velocity UNION ALL SELECT * FROM plots)
WHERE crop IN ({SQL_CROPS}) GROUP BY ALL""")
def q_packets_by_season(spark, base):
    days = union_all([_velocity_days(spark, base), _plot_days(spark, base)]).where(F.col("crop").isin(*CROPS))
    return days.groupBy("site", F.year("date").alias("year"), _season("date").alias("season"), "crop", "source") \
        .agg(F.sum("n_packets").alias("n_packets"))


@register("packets_by_day", sql=f"""
WITH {SQL_PACKETS}
SELECT date, site, crop, source, n_packets, CAST(year(date) AS INTEGER) AS year,
       CASE WHEN month(date) < 7 THEN 'Q1/Q2' ELSE 'Q3/Q4' END AS season
FROM velocity""")
def q_packets_by_day(spark, base):
    # the numbered feed alone, crops that no request names included
    return _velocity_days(spark, base).withColumns({"year": F.year("date"), "season": _season("date")})


@register("plots_by_grain", sql=f"""
WITH {SQL_PACKETS},
s AS (SELECT *, CAST(year(date) AS INTEGER) AS year, CASE WHEN month(date) < 7 THEN 'Q1/Q2' ELSE 'Q3/Q4' END AS season FROM plot_scans)
SELECT 'day' AS grain, site, crop, year, season, date, count(DISTINCT record_id) AS n_records FROM s GROUP BY ALL
UNION ALL
SELECT 'season', site, crop, year, season, NULL, count(DISTINCT record_id) FROM s GROUP BY ALL
UNION ALL
SELECT 'site', site, NULL, NULL, NULL, NULL, count(DISTINCT record_id) FROM s GROUP BY ALL""")
def q_plots_by_grain(spark, base):
    # a record scanned on two days counts once a season: bits are merged, counts are not summed
    days = merge_words(_plot_words(spark, base), {
        "site": F.col("site"), "crop": F.col("crop"), "year": F.year("date"), "season": _season("date"), "date": F.col("date")})
    seasons = merge_words(days, ["site", "crop", "year", "season"])
    sites = merge_words(seasons, ["site"])
    grain = lambda name, words, keys: count_words(words, keys, "n_records").withColumn("grain", F.lit(name))
    out = grain("day", days, ["site", "crop", "year", "season", "date"])
    for name, words, keys in (("season", seasons, ["site", "crop", "year", "season"]), ("site", sites, ["site"])):
        out = out.unionByName(grain(name, words, keys), allowMissingColumns=True)
    return out


@register("sessions_by_ship_date", sql=f"""
WITH feeds AS (
  SELECT CAST(l_shipdate AS DATE) AS date, {SQL_SITE} AS site, l_orderkey AS set_id, p.p_type AS crop
  FROM lineitem LEFT JOIN part p ON p.p_partkey = l_partkey AND p.p_size <= 40 WHERE l_returnflag = 'N'
  UNION ALL
  SELECT CAST(l_shipdate AS DATE), {SQL_SITE}, l_orderkey, 'plots' FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL
  SELECT CAST(l_shipdate AS DATE), CASE WHEN s.s_nationkey < 5 THEN 'S1' ELSE 'S0' END, l_orderkey, 'other'
  FROM lineitem JOIN supplier s ON s.s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND s.s_nationkey < 15),
counted AS (
  SELECT f.date AS day, f.site, f.set_id, CAST(sh.o_orderdate AS DATE) AS ship_date, count(*) AS counted
  FROM feeds f LEFT JOIN orders sh ON sh.o_orderkey = f.set_id AND sh.o_orderstatus <> 'P'
  WHERE f.crop IS NOT NULL AND f.date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'
  GROUP BY ALL)
SELECT c.ship_date, c.site, count(DISTINCT sg.o_custkey) AS count_ps, CAST(sum(c.counted) AS BIGINT) AS n_packets
FROM counted c LEFT JOIN orders sg ON sg.o_orderkey = c.set_id
WHERE c.site = 'S0' GROUP BY c.ship_date, c.site""")
def q_sessions_by_ship_date(spark, base):
    li = read_table(spark, base, "lineitem").where(in_local_days("l_shipdate", "UTC", SHIP_START, SHIP_END))
    day = utc_day("l_shipdate").alias("date")
    part = read_table(spark, base, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("crop"))
    plan = read_table(spark, base, "supplier").where("s_nationkey < 15").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    key = [day, _site().alias("site"), F.col("l_orderkey").alias("o_orderkey")]
    # only packets with a crop are counted, so the lookup of the crop is an inner one
    numbered = split_lookup(li.where("l_returnflag = 'N'").select(*key, "l_partkey"), part.dropna(), ["l_partkey"], "inner") \
        .select("date", "site", "o_orderkey")
    plots = li.where("l_returnflag = 'A'").select(*key)
    others = split_lookup(li.where("l_returnflag = 'R'").select("l_suppkey", day, F.col("l_orderkey").alias("o_orderkey")), plan, ["l_suppkey"], "inner") \
        .select("date", F.when(F.col("s_nationkey") < 5, "S1").otherwise("S0").alias("site"), "o_orderkey")
    # counted per day and set before the lookups: a hot set is one row a day
    counted = union_all([numbered, plots, others]).where(F.col("site") == "S0") \
        .groupBy("date", "site", "o_orderkey").agg(F.count(F.lit(1)).alias("counted"))
    sets = read_table(spark, base, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("session"), F.when(F.col("o_orderstatus") != "P", utc_day("o_orderdate")).alias("ship_date"))
    rows = counted.groupBy("site", "o_orderkey").agg(F.sum("counted").alias("counted")).join(sets, "o_orderkey", "left")
    # the packets of a session's sets ride along with its bit
    totals = rows.groupBy("ship_date", "site").agg(F.sum("counted").alias("n_packets"))
    n = count_words(id_words(rows, ["ship_date", "site"], "session"), ["ship_date", "site"], "count_ps")
    on = n["ship_date"].eqNullSafe(totals["ship_date"]) & n["site"].eqNullSafe(totals["site"])
    return n.join(totals, on).select(n["ship_date"], n["site"], "count_ps", "n_packets")


@register("cell_event_rows", sql=f"""
WITH hoppers AS (SELECT ltrim(regexp_extract(s, '^[a-zA-Z0-9_.+-]+\\-([a-zA-Z0-9-.]+$)', 1), '0') AS h
                 FROM (VALUES ('10002-004'), ('10002-007'), ('10003-011')) v(s)),
fields AS (SELECT DISTINCT p_type AS crop, p_brand AS field_name FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_size < 10)
SELECT {SQL_LOCAL('e.ts')} AS date, CAST(e.user_id % 12 AS VARCHAR) AS machine_id,
       coalesce(c.c_mktsegment, 'Velocity Crop Unknown') AS crop, CAST(e.event_id AS VARCHAR) AS packet_bid
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_nationkey < 13
WHERE {SQL_LOCAL('e.ts')} >= DATE '2024-01-10' AND e.event_type <> 'error'
  AND CAST(e.user_id % 12 AS VARCHAR) IN (SELECT h FROM hoppers)
UNION ALL
SELECT {SQL_LOCAL('l_shipdate')}, ltrim(right(serial, 3), '0'), coalesce(f.crop, 'FTS Crop Unknown'), barcode
FROM (SELECT l_shipdate, CASE l_suppkey % 12 WHEN 11 THEN '10003-' ELSE '10002-' END || lpad(CAST(l_suppkey % 12 AS VARCHAR), 3, '0') AS serial,
             {SQL_BARCODE} AS barcode, 'Brand#' || CAST(l_partkey % 25 + 1 AS VARCHAR) AS field_id FROM lineitem) l
LEFT JOIN fields f ON f.field_name = l.field_id
WHERE {SQL_LOCAL('l_shipdate')} >= DATE '1998-06-01'
  AND serial IN ('10002-004', '10002-007', '10003-011') AND starts_with(barcode, 'P0')""")
def q_cell_event_rows(spark, base):
    # the roster is sized by its parameters; its decoded hoppers are the membership list (P10)
    roster = constants(spark, [(s,) for s in SERIALS], "serial string").select("serial", decode_hopper("serial").alias("machine_id"))
    cells = read_table(spark, base, "events").where(in_local_days("ts", ZONE, CELLS.start_date) & (F.col("event_type") != "error")) \
        .select(local_day("ts", ZONE).alias("date"), (F.col("user_id") % 12).cast("string").alias("machine_id"),
                F.col("user_id").alias("c_custkey"), F.col("event_id").cast("string").alias("packet_bid")) \
        .join(F.broadcast(roster.select("machine_id").distinct()), "machine_id", "left_semi")
    sessions = read_table(spark, base, "customer").where("c_nationkey < 13").select("c_custkey", F.col("c_mktsegment").alias("crop"))
    first = split_lookup(cells, sessions, ["c_custkey"]).select(
        "date", "machine_id", F.coalesce("crop", F.lit("Velocity Crop Unknown")).alias("crop"), "packet_bid")

    number = F.col("l_suppkey") % 12
    li = read_table(spark, base, "lineitem").where(in_local_days("l_shipdate", ZONE, dt.date(1998, 6, 1))).select(
        local_day("l_shipdate", ZONE).alias("date"),
        F.concat(F.when(number == 11, "10003-").otherwise("10002-"), F.lpad(number.cast("string"), 3, "0")).alias("serial"),
        _barcode().alias("packet_bid"), F.concat(F.lit("Brand#"), (F.col("l_partkey") % 25 + 1).cast("string")).alias("p_brand"))
    fields = read_table(spark, base, "part").where("p_type IN ('ECONOMY', 'STANDARD') AND p_size < 10") \
        .select(F.col("p_type").alias("crop"), "p_brand").distinct()
    # a field of two crops gives its cells twice, as the source's join does
    second = split_lookup(li.where(F.col("serial").isin(*SERIALS) & F.col("packet_bid").startswith("P0")), fields, ["p_brand"]) \
        .select("date", ltrim_chars(F.substr("serial", F.lit(-3)), "0").alias("machine_id"),
                F.coalesce("crop", F.lit("FTS Crop Unknown")).alias("crop"), "packet_bid")
    return union_all([first, second])


@register("packet_fill_events", sql=f"""
SELECT {SQL_LOCAL('l_shipdate')} AS date, 'YTP-' || CAST(l_suppkey AS VARCHAR) AS machine_serial, {SQL_BARCODE} AS barcode
FROM lineitem WHERE l_linestatus = 'F' AND {SQL_SITE} = 'S0' AND NOT starts_with({SQL_BARCODE}, 'VALIDATION')
  AND {SQL_LOCAL('l_shipdate')} >= DATE '1999-02-19'
UNION ALL
SELECT {SQL_LOCAL('l_shipdate')}, 'NSP-' || CAST(l_suppkey AS VARCHAR), {SQL_BARCODE}
FROM lineitem WHERE l_linestatus = 'O' AND {SQL_SITE} = 'S0' AND NOT starts_with({SQL_BARCODE}, 'VALIDATION')
  AND {SQL_LOCAL('l_shipdate')} >= DATE '1999-02-19'""")
def q_packet_fill_events(spark, base):
    li = read_table(spark, base, "lineitem").where(in_local_days("l_shipdate", ZONE, dt.date(1999, 2, 19))) \
        .where((_site() == "S0") & ~_barcode().startswith("VALIDATION"))
    feed = lambda status, kind: li.where(F.col("l_linestatus") == status).select(
        local_day("l_shipdate", ZONE).alias("date"), F.concat(F.lit(kind), F.col("l_suppkey").cast("string")).alias("machine_serial"),
        _barcode().alias("barcode"))
    return union_all([feed("F", "YTP-"), feed("O", "NSP-")])
