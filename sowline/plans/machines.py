"""Machine processing family (C47-C52, A20-A25, W3-W4, W8) on ``events``.

Mapping: site = parity of ``user_id`` ('S0' even, 'S1' odd), machine =
``user_id`` (machines grow with the data, a machine day does not), plot =
``event_id``, start = ``ts`` (a UTC instant), finish = start + ``value``
seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sowline.functions.dates import epoch_micros, seconds_to_micros
from sowline.operators import machines as M
from sowline.operators.quantiles import describe, iqr_filter, median_by
from sowline.plans.registry import register
from sowline.session import materialize
from sowline.sources.tables import read_table


def machine_events(spark: SparkSession, base: str) -> DataFrame:
    ev = read_table(spark, base, "events")
    start = epoch_micros("ts")
    return ev.where(F.col("value").isNotNull()).select(
        F.when(F.col("user_id") % 2 == 0, F.lit("S0")).otherwise(F.lit("S1")).alias("site"),
        F.col("user_id").alias("machine"),
        F.col("event_id").alias("plot_id"),
        start.alias("start_us"),
        (start + seconds_to_micros("value")).alias("finish_us"))


def plots(spark, base):
    return M.plot_processing_times(machine_events(spark, base), "site", "machine", "plot_id",
                                   "start_us", "finish_us")


def downtime(spark, base):
    # the per-plot table feeds both branches of the split lead (the in-block
    # sort and the block hand-off): stored once instead of aggregated twice
    return M.machine_downtime(materialize(plots(spark, base)))


def runtime(spark, base):
    return M.machine_runtime(downtime(spark, base))


def daily(spark, base):
    return M.plots_per_hour(runtime(spark, base))


# ---------------------------------------------------------------- SQL oracle
SQL_PLOTS = """
ev AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'S0' ELSE 'S1' END AS site,
         user_id AS machine, event_id AS plot_id,
         epoch_us(ts) AS start_us,
         epoch_us(ts) + CAST(round(value * 1000000.0) AS BIGINT) AS finish_us
  FROM events WHERE value IS NOT NULL),
pl AS (
  SELECT site, machine, plot_id, min(start_us) AS start_us, max(finish_us) AS finish_us
  FROM ev WHERE finish_us IS NOT NULL GROUP BY site, machine, plot_id),
plots AS (
  SELECT *, CAST(make_timestamp(finish_us) AS DATE) AS date,
         finish_us - start_us AS processing_us,
         CAST(finish_us - start_us AS DOUBLE) / 1e6 AS processing_seconds
  FROM pl)"""

SQL_DOWN = SQL_PLOTS + """,
dn0 AS (
  SELECT *, lead(start_us) OVER (PARTITION BY site, machine, date ORDER BY start_us, plot_id)
            - finish_us AS diff_us
  FROM plots),
down AS (
  SELECT *, CASE WHEN diff_us > 0 THEN diff_us ELSE 0 END AS downtime_us,
         CAST(diff_us AS DOUBLE) / 1e6 AS diff_seconds,
         CAST(CASE WHEN diff_us > 0 THEN diff_us ELSE 0 END AS DOUBLE) / 1e6 AS downtime_seconds
  FROM dn0)"""

SQL_RUN = SQL_DOWN + """,
run0 AS (
  SELECT site, machine, date,
         sum(CASE WHEN downtime_us <= 300000000 THEN downtime_us + processing_us
                  ELSE processing_us END) AS runtime_us,
         count(*) AS n_plots_processed
  FROM down GROUP BY site, machine, date),
run AS (
  SELECT *, CAST(runtime_us AS DOUBLE) / 1e6 AS runtime_seconds,
         round_even(CAST(runtime_us AS DOUBLE) / 1e6 / 60.0 / 60.0 * 100, 0) / 100 AS runtime_hours
  FROM run0),
runf AS (SELECT * FROM run WHERE runtime_hours < 18.0),
daily AS (
  SELECT *, CASE WHEN runtime_hours = 0 THEN NULL
                 ELSE CAST(n_plots_processed AS DOUBLE) / runtime_hours END AS plots_per_hour,
         strftime(date, '%m-%d') AS month_day, CAST(weekofyear(date) AS INTEGER) AS week
  FROM runf)"""


def _describe_sql(src: str, keys: str, v: str, digits: int | None = 1,
                  stats=("count", "mean", "std", "min", "p25", "p50", "p75", "max"),
                  where: str = "") -> str:
    def rnd(e):
        if digits is None:
            return e
        s = 10 ** digits
        return f"round_even(({e}) * {s}, 0) / {s}"
    exprs = {
        "count": f"CAST(count({v}) AS DOUBLE)",
        "mean": rnd(f"avg({v})"),
        "std": rnd(f"stddev_samp({v})"),
        "min": rnd(f"min({v})"),
        "p25": rnd(f"quantile_cont({v}, 0.25)"),
        "p50": rnd(f"quantile_cont({v}, 0.5)"),
        "p75": rnd(f"quantile_cont({v}, 0.75)"),
        "max": rnd(f"max({v})"),
    }
    sel = ", ".join(f"{exprs[s]} AS {s}" for s in stats)
    w = f"WHERE {where}" if where else ""     # aggregates skip nulls; all-null groups stay
    return f"SELECT {keys}, {sel} FROM {src} {w} GROUP BY {keys}"


def _iqr_sql(src: str, keys: str, v: str) -> str:
    on = " AND ".join(f"s.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    return f"""(SELECT s.* FROM {src} s JOIN (
        SELECT {keys}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3
        FROM {src} GROUP BY {keys}) b ON {on}
      WHERE s.{v} >= b.q1 - 1.5 * (b.q3 - b.q1) AND s.{v} <= b.q3 + 1.5 * (b.q3 - b.q1))"""


@register("plot_processing_times", sql=f"""
WITH {SQL_PLOTS}
SELECT site, machine, plot_id, date, processing_seconds FROM plots""")
def q_plot_processing_times(spark, base):
    return plots(spark, base).select("site", "machine", "plot_id", "date", "processing_seconds")


@register("machine_downtime", sql=f"""
WITH {SQL_DOWN}
SELECT site, machine, plot_id, date, diff_seconds, downtime_seconds FROM down""")
def q_machine_downtime(spark, base):
    return downtime(spark, base).select("site", "machine", "plot_id", "date", "diff_seconds",
                                        "downtime_seconds")


@register("machine_runtime", sql=f"""
WITH {SQL_RUN}
SELECT site, machine, date, runtime_seconds, runtime_hours, n_plots_processed FROM runf""")
def q_machine_runtime(spark, base):
    return runtime(spark, base).select("site", "machine", "date", "runtime_seconds",
                                       "runtime_hours", "n_plots_processed")


@register("plots_per_hour", sql=f"""
WITH {SQL_RUN}
SELECT site, machine, date, n_plots_processed, runtime_hours, plots_per_hour, month_day, week
FROM daily""")
def q_plots_per_hour(spark, base):
    return daily(spark, base).select("site", "machine", "date", "n_plots_processed",
                                     "runtime_hours", "plots_per_hour", "month_day", "week")


@register("machines_running", sql=f"""
WITH {SQL_RUN}
SELECT site, date, count(DISTINCT machine) AS n_machines FROM daily GROUP BY site, date""")
def q_machines_running(spark, base):
    return M.machines_running(daily(spark, base))


@register("describe_processing", sql=f"""
WITH {SQL_PLOTS}
{_describe_sql('plots', 'site', 'processing_seconds', 1)}""")
def q_describe_processing(spark, base):
    return describe(plots(spark, base), ["site"], "processing_seconds", digits=1)


@register("describe_downtime", sql=f"""
WITH {SQL_DOWN}
{_describe_sql('down', 'site', 'downtime_seconds', 0)}""")
def q_describe_downtime(spark, base):
    # one input, several consumers (moments, rank histogram, bucket sort): the
    # gap computation is stored once instead of recomputed per branch
    return describe(materialize(downtime(spark, base)), ["site"], "downtime_seconds", digits=0)


@register("describe_no_outliers", sql=f"""
WITH {SQL_PLOTS}
{_describe_sql(_iqr_sql('plots', 'site', 'processing_seconds'), 'site', 'processing_seconds', 1)}""")
def q_describe_no_outliers(spark, base):
    p = materialize(plots(spark, base))
    return describe(materialize(iqr_filter(p, ["site"], "processing_seconds")), ["site"],
                    "processing_seconds", digits=1)


@register("describe_rate_by_week", sql=f"""
WITH {SQL_RUN}
{_describe_sql('daily', 'site, week', 'plots_per_hour', None,
               stats=('count', 'p25', 'p50', 'p75', 'max'), where='plots_per_hour <= 100')}""")
def q_describe_rate_by_week(spark, base):
    d = materialize(daily(spark, base).where(
        F.col("plots_per_hour") <= F.lit(float(M.MAX_PLOTS_PER_HOUR))))
    return describe(d, ["site", "week"], "plots_per_hour", digits=None,
                    stats=("count", "p25", "p50", "p75", "max"))


@register("median_downtime", sql=f"""
WITH {SQL_DOWN}
SELECT site, round_even(quantile_cont(downtime_seconds, 0.5) * 10, 0) / 10 AS median
FROM down GROUP BY site""")
def q_median_downtime(spark, base):
    return median_by(materialize(downtime(spark, base)), ["site"], "downtime_seconds", digits=1)


@register("share_over_threshold", sql=f"""
WITH {SQL_DOWN}
SELECT round_even(CAST(count(*) FILTER (WHERE downtime_seconds >= 300) AS DOUBLE)
                  / count(*) * 100, 0) AS pct_over FROM down""")
def q_share_over_threshold(spark, base):
    return M.share_over_threshold(downtime(spark, base), "downtime_seconds",
                                  float(M.DOWNTIME_THRESHOLD_SECONDS))
