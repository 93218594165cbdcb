"""Machine processing analytics.

Input: one row per machine event with a start and a finish instant.  All
durations are integer microseconds (exact, order-independent sums); seconds
and hours are derived at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowline.functions.dates import iso_week, micros_to_date, micros_to_seconds, month_day
from sowline.functions.numeric import round_half_even, safe_ratio
from sowline.operators.windows import gap_to_next

# Fixed values of the source analysis.
DOWNTIME_THRESHOLD_SECONDS = 5 * 60   # a gap above this is downtime, not run time
RUNTIME_CUTOFF_HOURS = 18             # machine days at or above this are dropped
MAX_PLOTS_PER_HOUR = 100              # plots/hour above this are outliers

MACHINE_KEYS = ("site", "machine")


def plot_processing_times(df: DataFrame, site: str, machine: str, plot: str,
                          start_us: str, finish_us: str) -> DataFrame:
    """Earliest start, latest finish and seconds per (site, machine, plot).

    The day of a plot is the UTC day of its finish.  Rows without a finish are
    dropped, like the source filter.
    """
    agg = (df.where(F.col(finish_us).isNotNull())
           .groupBy(F.col(site).alias("site"), F.col(machine).alias("machine"),
                    F.col(plot).alias("plot_id"))
           .agg(F.min(start_us).alias("start_us"), F.max(finish_us).alias("finish_us")))
    return (agg
            .withColumn("date", micros_to_date("finish_us"))
            .withColumn("processing_us", F.col("finish_us") - F.col("start_us"))
            .withColumn("processing_seconds", micros_to_seconds("processing_us")))


def machine_downtime(plots: DataFrame, split_hours: int | None = 1) -> DataFrame:
    """Gap from each plot's finish to the next start on the same machine and day.

    Negative gaps (overlaps) and the last plot of the day give 0 downtime (M15).
    The ordering is (start, plot id), so ties are broken deterministically.
    With ``split_hours`` the sort runs per machine-day-hour block (see
    ``windows.next_in_group``): a block holds what one machine does in an
    hour (the source treats more than 100 plots an hour as an outlier), and
    the hand-off table has at most 24 rows per machine day, so neither level
    grows with the data however hot one machine day is.
    """
    # pandas groupby drops rows whose group key is null
    plots = plots.where(F.col("site").isNotNull() & F.col("machine").isNotNull()
                        & F.col("date").isNotNull())
    split = None
    if split_hours:
        split = F.floor(F.col("start_us") / F.lit(split_hours * 3_600_000_000)).cast("long")
    out = gap_to_next(plots, "start_us", "finish_us", ["site", "machine", "date"],
                      ["start_us", "plot_id"], out_gap="diff_us", out_floor="downtime_us",
                      split_by=split)
    return (out.withColumn("diff_seconds", micros_to_seconds("diff_us"))
            .withColumn("downtime_seconds", micros_to_seconds("downtime_us")))


def machine_runtime(downtime: DataFrame, threshold_seconds: int = DOWNTIME_THRESHOLD_SECONDS,
                    cutoff_hours: float | None = RUNTIME_CUTOFF_HOURS) -> DataFrame:
    """Run time per machine day = processing + gaps up to the threshold.

    Hours are seconds/60/60 rounded half-to-even to 2 places; machine days at
    or above ``cutoff_hours`` are removed.
    """
    thr_us = int(threshold_seconds) * 1_000_000
    run_us = F.when(F.col("downtime_us") <= F.lit(thr_us),
                    F.col("downtime_us") + F.col("processing_us")).otherwise(F.col("processing_us"))
    daily = (downtime.groupBy("site", "machine", "date")
             .agg(F.sum(run_us).alias("runtime_us"), F.count(F.lit(1)).alias("n_plots_processed")))
    daily = (daily.withColumn("runtime_seconds", micros_to_seconds("runtime_us"))
             .withColumn("runtime_hours",
                         round_half_even(F.col("runtime_seconds") / F.lit(60.0) / F.lit(60.0), 2)))
    if cutoff_hours is not None:
        daily = daily.where(F.col("runtime_hours") < F.lit(float(cutoff_hours)))
    return daily


def plots_per_hour(runtime: DataFrame) -> DataFrame:
    """Plots per run hour per machine day, with month-day and ISO week labels.

    ``runtime`` already carries the plot count of the same machine day (the
    source merges two aggregations over the same keys; here both come from one
    aggregation, so no second shuffle is needed).
    """
    return (runtime
            .withColumn("plots_per_hour", safe_ratio("n_plots_processed", "runtime_hours"))
            .withColumn("month_day", month_day("date"))
            .withColumn("week", iso_week("date")))


def machines_running(daily: DataFrame, by: Sequence[str] = ("site", "date")) -> DataFrame:
    """Distinct machines working per site and day."""
    return daily.groupBy(*by).agg(F.countDistinct("machine").alias("n_machines"))


def share_over_threshold(df: DataFrame, value: str, threshold, digits: int = 0,
                         group_by: Sequence[str] = ()) -> DataFrame:
    """Percent of rows with value >= threshold, rounded half-to-even."""
    pct = F.avg(F.when(F.col(value) >= F.lit(threshold), 1.0).otherwise(0.0)) * F.lit(100.0)
    return df.groupBy(*group_by).agg(round_half_even(pct, digits).alias("pct_over"))
