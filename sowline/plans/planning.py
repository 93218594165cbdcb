"""Planning family (C53-C55, J17, R5, W5) and column profiles.

Plan rows come from ``lineitem`` joined to ``part``: year = ship year, crop =
part type, plots = quantity, rows per plot = line number - 2 (null for the
first two lines).  The "yield" plan is the non-returned lines, the "nursery"
plan the returned ones.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sowline.operators.aggregates import describe_string, histogram, null_profile
from sowline.operators.planning import (BASE_YEAR_ROW, capacity_chain, plan_growth, plan_totals,
                                        plan_units)
from sowline.operators.relational import outer_add
from sowline.plans.registry import register
from sowline.sources.tables import read_table

BASE_YEAR = 1996
EXCLUDED_CROP = "ECONOMY"
HIST_EDGES = [float(x) for x in range(0, 55, 5)]


def T(spark, base, name):
    return read_table(spark, base, name)


def _plan_rows(spark, base):
    li, p = T(spark, base, "lineitem"), T(spark, base, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(F.year("l_shipdate").alias("year"), F.col("p_type").alias("crop"),
                    "l_returnflag", "l_shipdate", F.col("l_quantity").alias("plots"),
                    F.when(F.col("l_linenumber") <= 2, F.lit(None))
                    .otherwise((F.col("l_linenumber") - 2).cast("double")).alias("rows_per_plot"))


def _yield(spark, base):
    rows = _plan_rows(spark, base).where(F.col("l_returnflag") != "R")
    return plan_units(rows, "plots", "rows_per_plot", 2.0)


def _nursery(spark, base):
    rows = _plan_rows(spark, base).where(F.col("l_returnflag") == "R")
    return plan_units(rows, "plots", "rows_per_plot", 1.0)


def _units_sql(default: float, where: str) -> str:
    rows = (f"coalesce(CASE WHEN l_linenumber <= 2 THEN NULL "
            f"ELSE CAST(l_linenumber - 2 AS DOUBLE) END, {default})")
    cells = f"(l_quantity * {rows})"
    return f"""(SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_type AS crop, {cells} AS cells,
       CASE WHEN {rows} = 1 THEN {cells} WHEN {rows} > 1 THEN {cells} / 2 ELSE 0.0 END AS packets
     FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where})"""


SQL_Y = _units_sql(2.0, "l_returnflag <> 'R'")
SQL_N = _units_sql(1.0, "l_returnflag = 'R'")


@register("plan_units", sql=f"""
SELECT year, crop, sum(cells) AS cells, sum(packets) AS packets FROM {SQL_Y} y GROUP BY 1, 2""")
def q_plan_units(spark, base):
    return plan_totals(_yield(spark, base), ["year", "crop"])


@register("plan_units_excl", sql=f"""
SELECT year, sum(cells) AS cells, sum(packets) AS packets FROM {SQL_Y} y
WHERE crop <> '{EXCLUDED_CROP}' GROUP BY 1""")
def q_plan_units_excl(spark, base):
    return plan_totals(_yield(spark, base).where(F.col("crop") != EXCLUDED_CROP), ["year"])


@register("outer_add", sql=f"""
WITH a AS (SELECT year, crop, sum(cells) AS cells, sum(packets) AS packets FROM {SQL_Y} y GROUP BY 1, 2),
b AS (SELECT year, crop, sum(cells) AS cells, sum(packets) AS packets FROM {SQL_N} n GROUP BY 1, 2)
SELECT coalesce(a.year, b.year) AS year, coalesce(a.crop, b.crop) AS crop,
       a.cells + b.cells AS cells, a.packets + b.packets AS packets
FROM a FULL OUTER JOIN b ON a.year = b.year AND a.crop = b.crop""")
def q_outer_add(spark, base):
    a = plan_totals(_yield(spark, base), ["year", "crop"])
    b = plan_totals(_nursery(spark, base), ["year", "crop"])
    return outer_add(a, b, ["year", "crop"], ["cells", "packets"])


@register("yoy_change", sql=f"""
WITH a AS (SELECT year, sum(cells) AS cells, sum(packets) AS packets FROM {SQL_Y} y GROUP BY 1),
b AS (SELECT year, sum(cells) AS cells, sum(packets) AS packets FROM {SQL_N} n GROUP BY 1),
t AS (SELECT coalesce(a.year, b.year) AS year, a.cells + b.cells AS cells,
             a.packets + b.packets AS packets
      FROM a FULL OUTER JOIN b ON a.year = b.year),
u AS (SELECT * FROM t WHERE year <> {BASE_YEAR}
      UNION ALL SELECT {BASE_YEAR}, {BASE_YEAR_ROW['cells']}::DOUBLE, {BASE_YEAR_ROW['packets']}::DOUBLE),
w AS (SELECT *,
  last_value(cells IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_cur,
  last_value(cells IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_prev,
  last_value(packets IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_cur,
  last_value(packets IGNORE NULLS) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_prev
  FROM u)
SELECT year, cells, packets,
       round_even((CASE WHEN c_prev = 0 THEN NULL ELSE c_cur / c_prev END - 1.0) * 100, 0) / 100 AS cells_yoy,
       round_even((CASE WHEN p_prev = 0 THEN NULL ELSE p_cur / p_prev END - 1.0) * 100, 0) / 100 AS packets_yoy
FROM w""")
def q_yoy_change(spark, base):
    a = plan_totals(_yield(spark, base), ["year"])
    b = plan_totals(_nursery(spark, base), ["year"])
    base_row = spark.createDataFrame(
        [(BASE_YEAR, BASE_YEAR_ROW["cells"], BASE_YEAR_ROW["packets"])],
        "year int, cells double, packets double")
    # one row per year: the ordered window runs on a table of a handful of rows
    return plan_growth(a, b, base_row)


def _stage_sql() -> str:
    from sowline.operators.planning import STAGES
    parts = ["s0 AS (SELECT s_suppkey, DATE '2024-01-01' + s_nationkey AS processing_start, "
             "CAST(trunc(abs(s_acctbal)) AS BIGINT) AS req0 FROM supplier)"]
    prev = "s0"
    names = [s[0] for s in STAGES] + ["shipping"]
    for i, (name, machines, hours, rate, conv, required, sat) in enumerate(STAGES):
        start = f"{name}_start"
        req = "req0" if i == 0 else str(required)
        daily = f"(CAST({float(machines)} AS DOUBLE) * {hours} * {rate} * CAST({float(conv)} AS DOUBLE))"
        per = 6 if sat else 5
        wd = f"CAST(isodow({start}) - 1 AS INTEGER)"
        sh = f"(CASE WHEN {wd} >= {per} THEN 7 - {wd} ELSE 0 END)"
        s = f"({start} + {sh})"
        p = f"CAST(isodow({s}) - 1 AS INTEGER)"
        n = f"CAST(ceil(CAST({req} AS DOUBLE) / {daily}) AS BIGINT)"
        off = f"({n} - 1 + {p})"
        last = f"({s} - {p} + CAST(({off} // {per}) * 7 + ({off} % {per}) AS INTEGER))"
        nxt = names[i + 1] + "_start"
        parts.append(f"s{i + 1} AS (SELECT *, CASE WHEN CAST({req} AS DOUBLE) <= 0 THEN {start} "
                     f"ELSE {last} + 1 END AS {nxt} FROM {prev})")
        prev = f"s{i + 1}"
    cols = ", ".join(f"{n}_start" for n in names)
    return "WITH " + ",\n".join(parts) + f"\nSELECT s_suppkey, {cols} FROM {prev}"


@register("capacity_finish", sql=_stage_sql())
def q_capacity_finish(spark, base):
    s = T(spark, base, "supplier").select(
        "s_suppkey", F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("s_nationkey")).alias("start"),
        F.abs("s_acctbal").cast("long").alias("req0"))
    out = capacity_chain(s, "start", first_required="req0")
    return out.select("s_suppkey", "processing_start", "packet_fill_start", "field_building_start",
                      "flex_filling_start", "shipping_start")


@register("describe_string", sql="""
WITH f AS (SELECT o_orderstatus, o_orderpriority, count(*) AS f FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2)
SELECT o_orderstatus, CAST(sum(f) AS BIGINT) AS count, count(*) AS unique,
       arg_min(o_orderpriority, (-f, o_orderpriority)) AS top, max(f) AS freq
FROM f GROUP BY o_orderstatus""")
def q_describe_string(spark, base):
    return describe_string(T(spark, base, "orders"), ["o_orderstatus"], "o_orderpriority")


@register("null_profile", sql="""
WITH j AS (SELECT o.o_orderkey, o.o_orderstatus, a.n_lines, a.first_ship
           FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines,
                                           min(CAST(l_shipdate AS DATE)) AS first_ship
                                    FROM lineitem GROUP BY 1) a ON o.o_orderkey = a.l_orderkey)
SELECT 'o_orderkey' AS column_name, CAST(count(*) - count(o_orderkey) AS BIGINT) AS n_null FROM j
UNION ALL SELECT 'o_orderstatus', CAST(count(*) - count(o_orderstatus) AS BIGINT) FROM j
UNION ALL SELECT 'n_lines', CAST(count(*) - count(n_lines) AS BIGINT) FROM j
UNION ALL SELECT 'first_ship', CAST(count(*) - count(first_ship) AS BIGINT) FROM j""")
def q_null_profile(spark, base):
    o = T(spark, base, "orders").select("o_orderkey", "o_orderstatus")
    a = T(spark, base, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min(F.to_date("l_shipdate")).alias("first_ship"))
    j = o.join(a, o.o_orderkey == a.l_orderkey, "left").select(
        "o_orderkey", "o_orderstatus", "n_lines", "first_ship")
    return null_profile(j)


def _hist_sql() -> str:
    e = HIST_EDGES
    cases = " ".join(
        f"WHEN l_quantity >= {e[i]} AND l_quantity {'<=' if i == len(e) - 2 else '<'} {e[i + 1]} "
        f"THEN {i}" for i in range(len(e) - 1))
    return f"""
WITH b AS (SELECT l_returnflag, CASE {cases} END AS bin FROM lineitem)
SELECT l_returnflag, CAST(bin AS INTEGER) AS bin, count(*) AS n,
       CAST(bin * 5.0 AS DOUBLE) AS bin_lo, CAST(bin * 5.0 + 5.0 AS DOUBLE) AS bin_hi
FROM b WHERE bin IS NOT NULL GROUP BY l_returnflag, bin"""


@register("histogram_bins", sql=_hist_sql())
def q_histogram_bins(spark, base):
    return histogram(T(spark, base, "lineitem"), "l_quantity", HIST_EDGES, ["l_returnflag"])
