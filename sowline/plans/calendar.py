"""Calendar family: daily counts, zero fill, running totals, roll-ups, category
columns (A2, A12, A16, W1, W2, C3-C9, C14, R2, R3, M1-M5, M9).

Daily facts come from ``events`` (UTC day of ``ts``; site = user parity,
crop = event type), ``lineitem`` (ship day; three return-flag feeds) and
``orders`` (order day).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sowline.config import Declares
from sowline.functions.dates import local_day, ntz, utc_day
from sowline.operators.aggregates import zero_fill
from sowline.operators.dims import calendar, machine_dim
from sowline.operators.relational import union_all
from sowline.operators.reshape import pivot_sum, pivot_table
from sowline.operators.windows import running_total
from sowline.plans.registry import register
from sowline.sources.tables import read_table

# the "declares" of the event and feed reports
EVENTS = Declares(dt.date(2024, 1, 1), dt.date(2024, 2, 4), sites=("S0", "S1", "S2"),
                  labels=("click", "view", "purchase", "signup", "error", "refund"))
FEEDS = Declares(dt.date(1998, 1, 1), dt.date(1998, 12, 31), sites=("S0", "S1"))
EV_START, EV_END = EVENTS.start_date, EVENTS.end_date
EVENT_TYPES, SITES, LOCAL_TZ = EVENTS.labels, EVENTS.sites, EVENTS.local_time_zone
FEED_START, FEED_END = FEEDS.start_date, FEEDS.end_date
# category lists checked in order: '2-HIGH' is in both and becomes cat3 (M9)
CAT3 = ("1-URGENT", "2-HIGH")
CAT2 = ("2-HIGH", "3-MEDIUM")
PRIORITY_CODES = {"p1": "1-URGENT", "p2": "2-HIGH", "p3": "3-MEDIUM", "p4": "4-NOT SPECIFIED",
                  "p5": "5-LOW"}
# machine roster (serial -> site) and category lists checked in order: 'click'
# is in both lists and becomes cat3 (M9); 'refund' is on the roster but has no events
ROSTER = {"S0": ("click", "view", "error"), "S1": ("purchase", "signup", "refund")}
ROSTER_CATEGORIES = (("cat3", ("click", "purchase")), ("cat2", ("click", "view", "signup")))

SQL_EV_CAL = """
cal AS (SELECT CAST(g.d AS DATE) AS day, v.t AS event_type
        FROM generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY) g(d),
             (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error'), ('refund')) v(t))"""
SQL_SITE_CAL = """
cal AS (SELECT CAST(g.d AS DATE) AS day, v.s AS site
        FROM generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY) g(d),
             (VALUES ('S0'), ('S1'), ('S2')) v(s)),
f AS (SELECT CAST(ts AS DATE) AS date, CASE WHEN user_id % 2 = 0 THEN 'S0' ELSE 'S1' END AS site,
             event_type, count(*) AS n
      FROM events GROUP BY ALL),
counted AS (
  SELECT cal.day, f.event_type, f.site, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS counted
  FROM cal LEFT JOIN f ON cal.day = f.date AND cal.site = f.site
  GROUP BY cal.day, f.event_type, f.site)"""


def _events_in_range(spark, base):
    ev = read_table(spark, base, "events")
    # range predicate on the raw column: reaches the parquet reader
    return ev.where((F.col("ts") >= ntz(EV_START.isoformat()))
                    & (F.col("ts") < ntz((EV_END + dt.timedelta(days=1)).isoformat())))


def _site_counts(spark, base):
    ev = _events_in_range(spark, base)
    facts = ev.groupBy(utc_day("ts").alias("date"),
                       F.when(F.col("user_id") % 2 == 0, "S0").otherwise("S1").alias("site"),
                       "event_type").agg(F.count(F.lit(1)).alias("n"))
    # the calendar is the preserved side of the outer join, so it cannot be the
    # build side; the facts (pre-aggregated to the day grain) are, and AQE
    # broadcasts them when their measured size is small
    dim = calendar(spark, EV_START, EV_END, SITES)
    return zero_fill(dim, facts, [("day", "date"), ("site", "site")], "n",
                     group_right=["event_type", "site"], mode="faithful", out="counted")


@register("daily_counts_dense", sql=f"""
WITH {SQL_EV_CAL},
f AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT cal.day, cal.event_type, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS n_events
FROM cal LEFT JOIN f ON cal.day = f.day AND cal.event_type = f.event_type
GROUP BY cal.day, cal.event_type""")
def q_daily_counts_dense(spark, base):
    ev = _events_in_range(spark, base)
    facts = ev.groupBy(utc_day("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    # parameter-sized: days x listed types (preserved side of the outer join)
    dim = calendar(spark, EV_START, EV_END, EVENT_TYPES, site_col="event_type")
    return zero_fill(dim, facts, [("day", "day"), ("event_type", "event_type")], "n",
                     mode="dense", out="n_events")


@register("daily_counts_faithful", sql=f"""
WITH {SQL_SITE_CAL}
SELECT day, event_type, site, counted FROM counted""")
def q_daily_counts_faithful(spark, base):
    return _site_counts(spark, base)


@register("running_total", sql=f"""
WITH {SQL_SITE_CAL}
SELECT day, event_type, site, counted,
       CAST(sum(counted) OVER (PARTITION BY event_type, site ORDER BY day
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS total_counted
FROM counted""")
def q_running_total(spark, base):
    return running_total(_site_counts(spark, base), "counted", ["event_type", "site"], ["day"],
                         out="total_counted")


@register("three_feed_union", sql="""
WITH li AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag, l_orderkey FROM lineitem
            WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'),
feeds AS (
  SELECT day, 'S0' AS site, count(*) AS n FROM li WHERE l_returnflag = 'A' GROUP BY day
  UNION ALL
  SELECT day, 'S1' AS site, count(DISTINCT l_orderkey) AS n FROM li WHERE l_returnflag = 'N' GROUP BY day
  UNION ALL
  SELECT day, 'S0' AS site, count(*) AS n FROM li WHERE l_returnflag = 'R' GROUP BY day),
cal AS (SELECT CAST(g.d AS DATE) AS day, v.s AS site
        FROM generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY) g(d),
             (VALUES ('S0'), ('S1')) v(s)),
daily AS (SELECT cal.day, cal.site, CAST(coalesce(sum(feeds.n), 0) AS BIGINT) AS counted
          FROM cal LEFT JOIN feeds ON cal.day = feeds.day AND cal.site = feeds.site
          GROUP BY cal.day, cal.site),
run AS (SELECT *, CAST(sum(counted) OVER (PARTITION BY site ORDER BY day
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM daily)
SELECT day, site, counted, total FROM run WHERE site = 'S0'""")
def q_three_feed_union(spark, base):
    li = read_table(spark, base, "lineitem").where(
        (F.col("l_shipdate") >= ntz("1998-01-01"))
        & (F.col("l_shipdate") < ntz("1999-01-01")))
    li = li.select(utc_day("l_shipdate").alias("day"), "l_returnflag", "l_orderkey")
    a = li.where(F.col("l_returnflag") == "A").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    n = li.where(F.col("l_returnflag") == "N").groupBy("day").agg(
        F.countDistinct("l_orderkey").alias("n"))
    r = li.where(F.col("l_returnflag") == "R").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    feeds = union_all([a.withColumn("site", F.lit("S0")), n.withColumn("site", F.lit("S1")),
                       r.withColumn("site", F.lit("S0"))])
    dim = calendar(spark, FEED_START, FEED_END, FEEDS.sites)
    daily = zero_fill(dim, feeds, [("day", "day"), ("site", "site")], "n", mode="dense",
                      out="counted")
    run = running_total(daily, "counted", ["site"], ["day"], out="total")
    return run.where(F.col("site") == "S0")   # filter after the window (W2)


@register("plots_processed_daily", sql="""
SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS n_plots
FROM events WHERE event_type <> 'error' GROUP BY 1""")
def q_plots_processed_daily(spark, base):
    ev = read_table(spark, base, "events").where(F.col("event_type") != "error")
    return ev.groupBy(utc_day("ts").alias("date")).agg(F.countDistinct("user_id").alias("n_plots"))


@register("local_day_counts", sql="""
SELECT CAST(ts AS DATE) AS day_utc,
       CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS day_local,
       count(*) AS n
FROM events GROUP BY 1, 2""")
def q_local_day_counts(spark, base):
    ev = read_table(spark, base, "events")
    return ev.groupBy(utc_day("ts").alias("day_utc"), local_day("ts", LOCAL_TZ).alias("day_local")) \
             .agg(F.count(F.lit(1)).alias("n"))


@register("season_rollup", sql="""
WITH lvl1 AS (
  SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority, o_orderstatus,
         count(DISTINCT o_custkey) AS n
  FROM orders GROUP BY 1, 2, 3)
SELECT CAST(year(day) AS INTEGER) AS year, CASE WHEN month(day) <= 6 THEN 'H1' ELSE 'H2' END AS season,
       o_orderpriority, 'orders' AS source, CAST(sum(n) AS BIGINT) AS n_total
FROM lvl1 GROUP BY 1, 2, 3, 4""")
def q_season_rollup(spark, base):
    o = read_table(spark, base, "orders")
    lvl1 = o.groupBy(utc_day("o_orderdate").alias("day"), "o_orderpriority", "o_orderstatus") \
            .agg(F.countDistinct("o_custkey").alias("n"))    # distinct per fine group (M5)
    return lvl1.groupBy(F.year("day").alias("year"),
                        F.when(F.month("day") <= 6, "H1").otherwise("H2").alias("season"),
                        "o_orderpriority", F.lit("orders").alias("source")) \
               .agg(F.sum("n").alias("n_total"))


@register("category_columns", sql="""
WITH c AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'cat3'
              WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'cat2' END AS category
  FROM orders)
SELECT year, CAST(sum(CASE WHEN category = 'cat2' THEN 1 ELSE 0 END) AS BIGINT) AS cat2,
       CAST(sum(CASE WHEN category = 'cat3' THEN 1 ELSE 0 END) AS BIGINT) AS cat3,
       CAST(sum(CASE WHEN category IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS none
FROM c GROUP BY year""")
def q_category_columns(spark, base):
    o = read_table(spark, base, "orders")
    pr = F.col("o_orderpriority")
    cat = F.when(pr.isin(*CAT3), "cat3").when(pr.isin(*CAT2), "cat2")
    c = o.select(F.year("o_orderdate").alias("year"), cat.alias("category"))
    return pivot_sum(c, ["year"], "category", {"cat2": "cat2", "cat3": "cat3"}, null_column="none")


@register("date_by_category_pivot", sql=f"""
WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(*) AS n FROM orders
           GROUP BY 1, 2)
SELECT year,
       max(CASE WHEN o_orderpriority = '1-URGENT' THEN n END) AS p1,
       max(CASE WHEN o_orderpriority = '2-HIGH' THEN n END) AS p2,
       max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN n END) AS p3,
       max(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN n END) AS p4,
       max(CASE WHEN o_orderpriority = '5-LOW' THEN n END) AS p5
FROM c GROUP BY year""")
def q_date_by_category_pivot(spark, base):
    o = read_table(spark, base, "orders")
    counts = o.groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority") \
              .agg(F.count(F.lit(1)).alias("n"))
    return pivot_table(counts, ["year"], "o_orderpriority", PRIORITY_CODES, "n", agg="max")


@register("category_by_roster", sql="""
WITH roster AS (SELECT * FROM (VALUES ('click', 'S0'), ('view', 'S0'), ('error', 'S0'),
                                      ('purchase', 'S1'), ('signup', 'S1'), ('refund', 'S1')) v(serial, site)),
dim AS (SELECT serial, site,
               CASE WHEN serial IN ('click', 'purchase') THEN 'cat3'
                    WHEN serial IN ('click', 'view', 'signup') THEN 'cat2' END AS category
        FROM roster)
SELECT CAST(ts AS DATE) AS day, dim.site, dim.category, count(*) AS n_events
FROM events JOIN dim ON events.event_type = dim.serial
GROUP BY 1, 2, 3""")
def q_category_by_roster(spark, base):
    ev = read_table(spark, base, "events")
    dim = F.broadcast(machine_dim(spark, ROSTER, ROSTER_CATEGORIES))   # roster-sized
    j = ev.join(dim, ev.event_type == dim.serial)
    return j.groupBy(utc_day("ts").alias("day"), "site", "category") \
            .agg(F.count(F.lit(1)).alias("n_events"))
