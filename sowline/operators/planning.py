"""Planning arithmetic: plan units, plan growth, capacity finish dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sowline.functions.numeric import round_half_even
from sowline.operators.dims import finish_date
from sowline.operators.relational import outer_add, upsert_rows
from sowline.operators.windows import pct_change

# Fixed values of the source: the four stages of the capacity simulation
# (machines, hours per day, units per hour, output conversion, units needed
# before the next stage may start, Saturday work).
STAGES = (
    ("processing", 2, 2.0, 19.0, 1, 1000, False),
    ("packet_fill", 13, 2.2, 257.3, 1, 20300, False),
    ("field_building", 5, 4.0, 631.6, 1, 20300, False),
    ("flex_filling", 11, 2.2, 407.0, 2, 2000, True),
)
BASE_YEAR_ROW = {"year": 2024, "cells": 902686.0, "packets": 404245.0}


def plan_units(df: DataFrame, plots: str, rows_per_plot: str, default_rows: float) -> DataFrame:
    """cells = plots x rows (null rows -> default); packets = cells when one
    row, cells / 2 when more, else 0."""
    rows = F.coalesce(F.col(rows_per_plot).cast("double"), F.lit(float(default_rows)))
    cells = F.col(plots).cast("double") * rows
    packets = F.when(rows == 1, cells).when(rows > 1, cells / 2).otherwise(F.lit(0.0))
    return df.withColumn("rows_per_plot_filled", rows).withColumn("cells", cells) \
             .withColumn("packets", packets)


def plan_totals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells and packets summed by the given keys."""
    return df.groupBy(*by).agg(F.sum("cells").alias("cells"), F.sum("packets").alias("packets"))


def plan_growth(a: DataFrame, b: DataFrame, base_row: DataFrame, key: str = "year",
                digits: int = 2) -> DataFrame:
    """Two plans added (aligned, null when one side lacks a year), the base
    year row put in (replacing that year if present), year-over-year change."""
    total = outer_add(a, b, [key], ["cells", "packets"])
    total = upsert_rows(total, base_row.select(key, "cells", "packets"), [key])
    out = pct_change(total, "cells", key, out="cells_yoy")
    out = pct_change(out, "packets", key, out="packets_yoy")
    return (out.withColumn("cells_yoy", round_half_even("cells_yoy", digits))
            .withColumn("packets_yoy", round_half_even("packets_yoy", digits)))


def stage_daily(n_machines, runtime_hrs, per_hour, conversion) -> Column:
    """Units per working day, multiplied in the source's order."""
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return lit(n_machines) * lit(runtime_hrs) * lit(per_hour) * lit(conversion)


def capacity_chain(df: DataFrame, start: str, first_required: str | None = None,
                   stages=STAGES) -> DataFrame:
    """Start dates of each stage in turn; each stage starts when the previous
    one has produced the units the next one needs.  ``first_required`` lets the
    first stage's requirement come from the data."""
    cur = F.col(start)
    out = df
    for i, (name, machines, hours, rate, conv, required, sat) in enumerate(stages):
        out = out.withColumn(f"{name}_start", cur)
        req = F.col(first_required) if (i == 0 and first_required) else F.lit(required)
        cur = finish_date(F.col(f"{name}_start"), req,
                          stage_daily(float(machines), hours, rate, float(conv)), F.lit(sat))
    return out.withColumn("shipping_start", cur)
