"""Predicates, string functions, casts and small reports (P14-P19, P22, P30,
F11-F16, F22, F25, J6, J7, N6, N10, A14, A27, A29, C11-C13, C34, C42)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sowline.functions.dates import ntz, utc_day
from sowline.functions.numeric import round_half_even
from sowline.functions.text import first_word, substr_from_marker
from sowline.operators.aggregates import string_agg
from sowline.operators.nested import collect_bounded, concat_unnest, filter_elements, unnest
from sowline.operators.relational import not_in, union_all
from sowline.plans import machines as PM
from sowline.plans.registry import register
from sowline.sources.tables import read_table

# Fixed value: packet barcodes that count start with P0 or a digit.
PACKET_BARCODE = r"^P0|^\d"
MAX_ARRAY = 1000    # elements per per-record array (see nested.collect_bounded)


def T(spark, base, name):
    return read_table(spark, base, name)


def _barcode():
    f = F.col("l_returnflag")
    return (F.when(f == "A", F.concat(F.lit("P0"), F.col("l_orderkey").cast("string")))
            .when(f == "N", F.col("l_partkey").cast("string"))
            .otherwise(F.concat(F.lit("VALIDATION"), F.col("l_linenumber").cast("string"))))


SQL_BARCODE = ("CASE WHEN l_returnflag = 'A' THEN 'P0' || CAST(l_orderkey AS VARCHAR) "
               "WHEN l_returnflag = 'N' THEN CAST(l_partkey AS VARCHAR) "
               "ELSE 'VALIDATION' || CAST(l_linenumber AS VARCHAR) END")


@register("packet_season_counts", sql=f"""
WITH feeds AS (
  SELECT 'S0' AS site, CAST(l_shipdate AS DATE) AS date, {SQL_BARCODE} AS barcode
  FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL
  SELECT 'S1' AS site, CAST(l_shipdate AS DATE) AS date, {SQL_BARCODE} AS barcode
  FROM lineitem WHERE l_linestatus = 'O')
SELECT site, CASE WHEN date >= DATE '1998-01-01' THEN 'Q1/Q2' ELSE 'Q3/Q4' END AS season,
       count(barcode) AS n_packets
FROM feeds
WHERE regexp_matches(barcode, '{PACKET_BARCODE}') AND NOT starts_with(barcode, 'VALIDATION')
GROUP BY 1, 2""")
def q_packet_season_counts(spark, base):
    li = T(spark, base, "lineitem")
    feed = lambda status, site: li.where(F.col("l_linestatus") == status).select(
        F.lit(site).alias("site"), utc_day("l_shipdate").alias("date"), _barcode().alias("barcode"))
    feeds = union_all([feed("F", "S0"), feed("O", "S1")])
    kept = feeds.where(F.col("barcode").rlike(PACKET_BARCODE)
                       & ~F.startswith(F.col("barcode"), F.lit("VALIDATION")))
    season = F.when(F.col("date") >= F.lit(dt.date(1998, 1, 1)), "Q1/Q2").otherwise("Q3/Q4")
    return kept.groupBy("site", season.alias("season")).agg(F.count("barcode").alias("n_packets"))


@register("predicate_mix", sql="""
SELECT p_partkey, p_name, (p_size > 20) IS TRUE AS big,
       (CASE WHEN p_size > 45 THEN NULL ELSE p_size > 20 END) IS NOT FALSE AS big_or_unknown
FROM part
WHERE p_name LIKE '%ring%' AND p_type NOT LIKE 'SMALL%'
  AND coalesce(contains(p_brand, '#1'), false)""")
def q_predicate_mix(spark, base):
    p = T(spark, base, "part")
    big = F.col("p_size") > 20
    maybe = F.when(F.col("p_size") > 45, F.lit(None)).otherwise(big)
    return p.where(F.col("p_name").like("%ring%") & ~F.col("p_type").like("SMALL%")
                   & F.coalesce(F.col("p_brand").contains("#1"), F.lit(False))) \
            .select("p_partkey", "p_name", big.eqNullSafe(F.lit(True)).alias("big"),
                    (~maybe.eqNullSafe(F.lit(False))).alias("big_or_unknown"))


@register("string_functions", sql="""
SELECT p_partkey, left(p_name, 5) AS name_left, substr(p_brand, -2) AS brand_tail,
       split_part(p_name, ' ', 1) AS first_word,
       substr(p_name, greatest(instr(p_name, 'ri'), 1), 6) AS from_marker,
       CAST(strptime('2024-01-' || lpad(CAST(least(p_size, 28) AS VARCHAR), 2, '0'), '%Y-%m-%d') AS DATE)
         AS parsed_date,
       p_brand || '/' || p_type AS label
FROM part""")
def q_string_functions(spark, base):
    p = T(spark, base, "part")
    day_text = F.concat(F.lit("2024-01-"), F.lpad(F.least("p_size", F.lit(28)).cast("string"), 2, "0"))
    return p.select("p_partkey", F.left("p_name", F.lit(5)).alias("name_left"),
                    F.substr("p_brand", F.lit(-2)).alias("brand_tail"),
                    first_word("p_name").alias("first_word"),
                    substr_from_marker("p_name", "ri", 6).alias("from_marker"),
                    F.to_date(day_text, "yyyy-MM-dd").alias("parsed_date"),
                    F.concat("p_brand", F.lit("/"), "p_type").alias("label"))


@register("cast_key_join", sql="""
SELECT c_custkey, count(o_orderkey) AS n_orders
FROM customer JOIN orders ON TRY_CAST(substr(c_name, 10) AS BIGINT) = o_custkey
GROUP BY c_custkey""")
def q_cast_key_join(spark, base):
    c, o = T(spark, base, "customer"), T(spark, base, "orders")
    key = F.substring("c_name", 10, 1 << 20).try_cast("long")
    return c.join(o, key == o.o_custkey).groupBy("c_custkey") \
            .agg(F.count("o_orderkey").alias("n_orders"))


@register("concat_unnest", sql="""
SELECT l_orderkey, l_partkey AS id FROM lineitem
UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem""")
def q_concat_unnest(spark, base):
    li = T(spark, base, "lineitem")
    arr = collect_bounded(li, ["l_orderkey"], F.struct("l_partkey", "l_suppkey"), "lines", MAX_ARRAY)
    arr = arr.select("l_orderkey", F.transform("lines", lambda x: x["l_partkey"]).alias("parts"),
                     F.transform("lines", lambda x: x["l_suppkey"]).alias("supps"))
    return concat_unnest(arr, ["parts", "supps"], "id").select("l_orderkey", "id")


@register("array_filter", sql="""
SELECT l_orderkey, CAST(l_quantity AS VARCHAR) AS value FROM lineitem WHERE l_linenumber = 1""")
def q_array_filter(spark, base):
    li = T(spark, base, "lineitem")
    arr = collect_bounded(li, ["l_orderkey"], F.struct(
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("code"),
        F.col("l_quantity").cast("string").alias("value")), "instructions", MAX_ARRAY)
    kept = filter_elements(arr, "instructions", lambda x: x["code"] == F.lit("L1"))
    return unnest(kept, "instructions", "i").select("l_orderkey", F.col("i.value").alias("value"))


@register("daily_means", sql=f"""
WITH {PM.SQL_RUN}
SELECT date, round_even(avg(plots_per_hour) * 10000, 0) / 10000 AS mean_plots_per_hour,
       round_even(avg(runtime_hours) * 10000, 0) / 10000 AS mean_runtime_hours
FROM daily GROUP BY date""")
def q_daily_means(spark, base):
    d = PM.daily(spark, base)
    return d.groupBy("date").agg(
        round_half_even(F.avg("plots_per_hour"), 4).alias("mean_plots_per_hour"),
        round_half_even(F.avg("runtime_hours"), 4).alias("mean_runtime_hours"))


@register("last_received", sql="""
WITH jars AS (SELECT user_id AS jar_id, max(ts) AS jar_received FROM (
                SELECT user_id, ts FROM events WHERE event_type = 'purchase'
                UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'signup') j
              GROUP BY 1),
tubes AS (SELECT user_id AS jar_id, json_extract_string(props, '$.k') AS set_id FROM events
          WHERE event_type = 'view' AND value > 10)
SELECT set_id, max(jar_received) AS last_received FROM tubes JOIN jars USING (jar_id)
GROUP BY set_id""")
def q_last_received(spark, base):
    ev = T(spark, base, "events")
    feed = lambda t: ev.where(F.col("event_type") == t).select("user_id", "ts")
    jars = union_all([feed("purchase"), feed("signup")]).groupBy(F.col("user_id").alias("jar_id")) \
        .agg(F.max("ts").alias("jar_received"))
    tubes = ev.where((F.col("event_type") == "view") & (F.col("value") > 10)).select(
        F.col("user_id").alias("jar_id"), F.get_json_object("props", "$.k").alias("set_id"))
    return tubes.join(jars, "jar_id").groupBy("set_id").agg(F.max("jar_received").alias("last_received"))


@register("bind_parameter", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2000-01-01'""")
def q_bind_parameter(spark, base):
    o = T(spark, base, "orders")
    return spark.sql(
        "SELECT o_orderkey, o_custkey, o_totalprice FROM {o} "
        "WHERE o_orderstatus = :status AND o_orderdate >= CAST(:since AS TIMESTAMP_NTZ)",
        args={"status": "O", "since": "2000-01-01"}, o=o)


@register("string_agg", sql="""
SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities
FROM orders GROUP BY o_custkey""")
def q_string_agg(spark, base):
    return T(spark, base, "orders").groupBy("o_custkey").agg(
        string_agg("o_orderpriority").alias("priorities"))


@register("distinct_since", sql="""
SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'S0' ELSE 'S1' END AS site, event_type AS machine
FROM events WHERE ts >= TIMESTAMP '2024-01-15'""")
def q_distinct_since(spark, base):
    ev = T(spark, base, "events").where(F.col("ts") >= ntz("2024-01-15"))
    return ev.select(F.when(F.col("user_id") % 2 == 0, "S0").otherwise("S1").alias("site"),
                     F.col("event_type").alias("machine")).distinct()


@register("row_type_counts", sql="""
SELECT CASE l_linenumber WHEN 1 THEN 'border' WHEN 7 THEN 'buffer' ELSE 'plot' END AS row_type,
       l_linestatus, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def q_row_type_counts(spark, base):
    li = T(spark, base, "lineitem")
    n = F.col("l_linenumber")
    rt = F.when(n == 1, "border").when(n == 7, "buffer").otherwise("plot")
    return li.groupBy(rt.alias("row_type"), "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@register("labelled_daily_counts", sql="""
WITH ps AS (SELECT p_partkey, p_type AS crop FROM part WHERE p_size > 25)
SELECT CAST(l_shipdate AS DATE) AS date, coalesce(ps.crop, 'Crop Unknown') AS crop,
       count(*) AS n_cells
FROM lineitem LEFT JOIN ps ON l_partkey = ps.p_partkey
WHERE l_shipdate >= TIMESTAMP '2000-01-01'
GROUP BY 1, 2""")
def q_labelled_daily_counts(spark, base):
    li = T(spark, base, "lineitem").where(F.col("l_shipdate") >= ntz("2000-01-01"))
    # the lookup is filtered inside the right side, so the join stays outer;
    # unmatched rows get the 'Crop Unknown' label (P25)
    ps = T(spark, base, "part").where(F.col("p_size") > 25).select("p_partkey", F.col("p_type").alias("crop"))
    j = li.join(ps, li.l_partkey == ps.p_partkey, "left")
    return j.groupBy(utc_day("l_shipdate").alias("date"),
                     F.coalesce(F.col("crop"), F.lit("Crop Unknown")).alias("crop")) \
            .agg(F.count(F.lit(1)).alias("n_cells"))


@register("relabel_then_group", sql="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' ELSE o_orderpriority END AS label,
       count(*) AS n
FROM orders GROUP BY year(o_orderdate), o_orderpriority""")
def q_relabel_then_group(spark, base):
    o = T(spark, base, "orders")
    # grouped by the raw value, labelled afterwards: two raw values give two
    # rows with one label until a later roll-up sums them
    g = o.groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH") \
             .otherwise(F.col("o_orderpriority"))
    return g.select("year", label.alias("label"), "n")


@register("first_last_times", sql="""
SELECT l_orderkey, min(l_shipdate) AS first_time, max(l_shipdate) AS last_time,
       count(*) AS n_lines
FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def q_first_last_times(spark, base):
    li = T(spark, base, "lineitem")
    # timestamps stay timestamp_ntz (DATETIME without zone), not days
    return li.groupBy("l_orderkey").agg(
        F.min(F.col("l_shipdate").cast("timestamp_ntz")).alias("first_time"),
        F.max(F.col("l_shipdate").cast("timestamp_ntz")).alias("last_time"),
        F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") > 1)


@register("dynamic_prefix_filter", sql="""
SELECT p_partkey, p_type, p_name FROM part
WHERE p_type LIKE concat((SELECT min(p_type) FROM part WHERE p_size > 40), '%')""")
def q_dynamic_prefix_filter(spark, base):
    p = T(spark, base, "part")
    # LIKE CONCAT((scalar subquery), '%'): the prefix is a scalar subquery
    # evaluated once, then a literal for the filter
    prefix = p.where(F.col("p_size") > 40).agg(F.min("p_type")).scalar()
    return p.where(F.like(F.col("p_type"), F.concat(prefix, F.lit("%")))) \
            .select("p_partkey", "p_type", "p_name")


@register("cells_per_jar", sql="""
SELECT l_suppkey AS jar_id, l_returnflag AS counter_group, l_partkey AS set_id,
       f.o_orderpriority AS session, count(*) AS n_cells
FROM lineitem
JOIN (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') f
  ON l_orderkey = f.o_orderkey
WHERE l_linestatus = 'F' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)
GROUP BY 1, 2, 3, 4""")
def q_cells_per_jar(spark, base):
    li = T(spark, base, "lineitem").where(F.col("l_linestatus") == "F")
    fields = T(spark, base, "orders").where(F.col("o_orderstatus") == "F") \
        .select("o_orderkey", "o_orderpriority").distinct()            # J8: distinct dim
    carry_over = T(spark, base, "part").where(F.col("p_size") == 1).select("p_partkey")
    kept = not_in(li, "l_partkey", carry_over, "p_partkey")            # P12 / M8
    j = kept.join(fields, kept.l_orderkey == fields.o_orderkey)
    return j.groupBy(F.col("l_suppkey").alias("jar_id"), F.col("l_returnflag").alias("counter_group"),
                     F.col("l_partkey").alias("set_id"), F.col("o_orderpriority").alias("session")) \
            .agg(F.count(F.lit(1)).alias("n_cells"))


@register("sessions_shipped", sql="""
SELECT CAST(o_orderdate AS DATE) AS ship_date, p_brand AS site, count(DISTINCT p_type) AS n_sessions
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2""")
def q_sessions_shipped(spark, base):
    o, li, p = T(spark, base, "orders"), T(spark, base, "lineitem"), T(spark, base, "part")
    # shipment records carry their set ids as text (array<string>)
    ids = collect_bounded(li, ["l_orderkey"], F.col("l_partkey").cast("string"), "set_ids",
                          MAX_ARRAY)
    shipments = ids.join(o, ids.l_orderkey == o.o_orderkey) \
                   .select(utc_day("o_orderdate").alias("ship_date"), "set_ids")
    sets = unnest(shipments, "set_ids", "set_id")
    # join on the id cast back to a number (J7); try_cast keeps dirty ids out
    j = sets.join(p, sets.set_id.try_cast("long") == p.p_partkey)
    return j.groupBy("ship_date", F.col("p_brand").alias("site")) \
            .agg(F.countDistinct("p_type").alias("n_sessions"))
