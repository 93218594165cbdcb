"""Small dimensions: calendar, machine roster, working-day finish dates.

Every dimension here is sized by its parameters (days in a range, machines in
a roster), never by the data, so broadcasting it is safe.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sowline.functions.text import decode_hopper


def calendar(spark: SparkSession, start: dt.date, end: dt.date, sites: Sequence[str] | None = None,
             day_col: str = "day", site_col: str = "site") -> DataFrame:
    """One row per day from start to end inclusive (x sites when given).

    Days x sites come from two generators in one projection, not from a join.
    """
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias(day_col))
    if sites is None:
        return days
    return days.select(day_col, F.explode(F.array(*[F.lit(x) for x in sites])).alias(site_col))


def machine_dim(spark: SparkSession, machines_by_site: Mapping[str, Sequence[str]],
                category_lists: Sequence[tuple[str, Sequence[str]]] = (),
                default_category: str | None = None) -> DataFrame:
    """Serial, decoded hopper, site and category.

    ``category_lists`` is checked in order, so a serial in two lists gets the
    first one's category (M9).
    """
    rows = [(serial, site) for site, serials in machines_by_site.items() for serial in serials]
    df = spark.createDataFrame(rows, "serial string, site string")
    cat = None
    for name, members in category_lists:
        cond = F.col("serial").isin(list(members))
        cat = F.when(cond, F.lit(name)) if cat is None else cat.when(cond, F.lit(name))
    if cat is None:
        cat = F.lit(default_category)
    elif default_category is not None:
        cat = cat.otherwise(F.lit(default_category))
    return df.select("serial", decode_hopper("serial").alias("hopper"), "site",
                     cat.cast("string").alias("category"))


def nth_working_day_after(start: Column, n: Column, saturdays: Column) -> Column:
    """The day after the n-th working day counted from ``start`` (n >= 1).

    Working days are Monday-Friday, plus Saturday when ``saturdays``.  A start
    on a day off moves to the next working day (the source loops forever there).
    Closed-form week arithmetic: no calendar table, no join, no window.
    """
    wd = F.weekday(start)                      # Monday = 0
    per_week = F.when(saturdays, F.lit(6)).otherwise(F.lit(5))
    shift = F.when(wd >= per_week, F.lit(7) - wd).otherwise(F.lit(0))
    s = F.date_add(start, shift)               # first working day on or after start
    p = F.weekday(s)                           # position in its week
    off = n - 1 + p
    week_start = F.date_add(s, -p)
    last = F.date_add(week_start, (F.floor(off / per_week) * 7 + F.pmod(off, per_week)).cast("int"))
    return F.date_add(last, 1)


def finish_date(start: Column, required: Column, daily: Column, saturdays: Column) -> Column:
    """C55 stage: start plus enough working days to reach ``required`` at ``daily`` per day.

    n = ceil(required / daily); required <= 0 returns the start unchanged, and
    a daily amount of 0 never gets there: NULL.
    """
    n = F.ceil(required.cast("double") / F.when(daily != 0, daily))
    return F.when(required.cast("double") <= 0, start).otherwise(
        nth_working_day_after(start, n, saturdays))
