"""Results kept bounded: merges by class, texts in parts, overall quantiles,
CSV with rejects (A20, A29, C46, J15, M11, R1, S4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowline.functions.dates import utc_day
from sowline.functions.text import coalesce_as_string
from sowline.operators.factored import attach_class, merge_classes
from sowline.operators.quantiles import overall_quantiles
from sowline.operators.textparts import text_parts, wide_parts
from sowline.plans.registry import register
from sowline.session import checkpoint_dir
from sowline.sources.tables import read_csv_checked, read_table

PART = 200      # values a text part
ORDER_CSV = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                          T.StructField("price", T.DoubleType()), T.StructField("order_date", T.DateType())])

SQL_NAMES = """
cells AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS seeds,
                 CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'SET-' || CAST(l_suppkey AS VARCHAR) END AS set_name FROM lineitem),
releases AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'SET-' || CAST(o_custkey % 150 AS VARCHAR) END AS set_name,
                    CAST(o_orderdate AS DATE) AS released FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT set_name, count(*) AS n, min(released) AS first_release, max(released) AS last_release FROM releases GROUP BY set_name)"""


def _cells(spark, base):
    name = F.when(F.col("l_returnflag") != "R", F.concat(F.lit("SET-"), F.col("l_suppkey").cast("string")))
    return read_table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("seeds"), name.alias("set_name"))


def _releases(spark, base):
    name = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("SET-"), (F.col("o_custkey") % 150).cast("string")))
    return read_table(spark, base, "orders").where("o_orderstatus = 'F'").select(name.alias("release_name"), utc_day("o_orderdate").alias("released"))


@register("merge_by_name_classes", sql=f"""
WITH {SQL_NAMES},
c AS (SELECT set_name, count(*) AS n_left, sum(seeds) AS seeds FROM cells GROUP BY set_name)
SELECT c.set_name, c.n_left, coalesce(r.n, 0) AS n_right, c.n_left * greatest(coalesce(r.n, 0), 1) AS n_rows,
       CAST(c.seeds * greatest(coalesce(r.n, 0), 1) AS BIGINT) AS seeds, r.first_release, r.last_release
FROM c LEFT JOIN r ON c.set_name IS NOT DISTINCT FROM r.set_name""")
def q_merge_by_name_classes(spark, base):
    return merge_classes(_cells(spark, base), _releases(spark, base), "set_name", "release_name", left_sums={"seeds": F.col("seeds")},
                         right_aggs={"first_release": F.min("released"), "last_release": F.max("released")}, out="set_name")


@register("attach_release_by_name", sql=f"""
WITH {SQL_NAMES}
SELECT cells.*, r.n AS n_matches, r.first_release FROM cells LEFT JOIN r ON cells.set_name IS NOT DISTINCT FROM r.set_name""")
def q_attach_release_by_name(spark, base):
    return attach_class(_cells(spark, base), _releases(spark, base), "set_name", "release_name",
                        {"n_matches": F.count(F.lit(1)), "first_release": F.min("released")})


@register("overall_median", sql="""
SELECT quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS median,
       quantile_cont(l_extendedprice, 0.75) AS p75 FROM lineitem""")
def q_overall_median(spark, base):
    return overall_quantiles(read_table(spark, base, "lineitem"), "l_extendedprice", {"p25": 0.25, "median": 0.5, "p75": 0.75})


@register("string_agg_parts", sql=f"""
WITH v AS (SELECT DISTINCT l_returnflag, CAST(l_partkey AS VARCHAR) AS v FROM lineitem),
n AS (SELECT *, (row_number() OVER (PARTITION BY l_returnflag ORDER BY v) - 1) // {PART} AS part FROM v)
SELECT l_returnflag, part, count(*) AS n_values, string_agg(v, ',' ORDER BY v) AS text FROM n GROUP BY l_returnflag, part""")
def q_string_agg_parts(spark, base):
    # three keys hold all rows; each is as many rows as its values need
    return text_parts(read_table(spark, base, "lineitem"), ["l_returnflag"], "l_partkey", size=PART)


@register("observations_wide", sql=f"""
WITH o AS (SELECT l_suppkey, l_returnflag,
                  coalesce(CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey AS VARCHAR) END, CASE WHEN l_returnflag = 'N' THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END,
                           CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS VARCHAR) END, l_linestatus) AS value FROM lineitem),
v AS (SELECT DISTINCT * FROM o),
n AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY value) - 1) // {PART} AS part FROM v),
p AS (SELECT l_suppkey, l_returnflag, part, string_agg(value, ',' ORDER BY value) AS text FROM n GROUP BY ALL)
SELECT l_suppkey, part, max(CASE WHEN l_returnflag = 'A' THEN text END) AS seeds, max(CASE WHEN l_returnflag = 'N' THEN text END) AS dates,
       max(CASE WHEN l_returnflag = 'R' THEN text END) AS ratings
FROM p GROUP BY l_suppkey, part""")
def q_observations_wide(spark, base):
    # an observation holds its value in one of four typed columns
    flag = F.col("l_returnflag")
    value = coalesce_as_string(F.when(flag == "A", F.col("l_partkey")), F.when(flag == "N", utc_day("l_shipdate")),
                               F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")), F.col("l_linestatus"))
    obs = read_table(spark, base, "lineitem").select("l_suppkey", "l_returnflag", value.alias("value"))
    return wide_parts(obs, ["l_suppkey"], "l_returnflag", {"seeds": "A", "dates": "N", "ratings": "R"}, "value", size=PART)


@register("csv_rejects", sql="""
WITH o AS (SELECT *, o_orderkey % 50 AS m, CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) AS head,
                  CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS VARCHAR) AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders)
SELECT CASE WHEN m NOT IN (7, 13, 19, 23) THEN o_orderkey END AS o_orderkey, CASE WHEN m NOT IN (7, 13, 19, 23) THEN o_custkey END AS o_custkey,
       CASE WHEN m NOT IN (7, 13, 19, 23, 31) THEN CAST(price AS DOUBLE) END AS price,
       CASE WHEN m NOT IN (7, 13, 19, 23) THEN CAST(o_orderdate AS DATE) END AS order_date,
       CASE m WHEN 7 THEN head || ',n/a,' || day WHEN 13 THEN head || ',' || price || ',someday' WHEN 19 THEN head || ',' || price || ',' || day || ',more'
              WHEN 23 THEN head END AS line
FROM o""")
def q_csv_rejects(spark, base):
    # orders written as CSV with dirty lines (bad number, bad day, a field too many, too few; an empty price is none), then read back
    m = F.col("o_orderkey") % 50
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    price, day = F.col("o_totalprice").cast("decimal(14,2)").cast("string"), utc_day("o_orderdate").cast("string")
    line = F.when(m == 7, F.concat_ws(",", key, cust, F.lit("n/a"), day)).when(m == 13, F.concat_ws(",", key, cust, price, F.lit("someday"))) \
        .when(m == 19, F.concat_ws(",", key, cust, price, day, F.lit("more"))).when(m == 23, F.concat_ws(",", key, cust)) \
        .when(m == 31, F.concat_ws(",", key, cust, F.lit(""), day)).otherwise(F.concat_ws(",", key, cust, price, day))
    path = f"{checkpoint_dir(spark).rstrip('/')}/sowline-orders-csv-{uuid.uuid4().hex}"
    read_table(spark, base, "orders").select(line.alias("value")).write.text(path)
    good, rejects = read_csv_checked(spark, path, ORDER_CSV, header=False, name="orders-csv")
    return good.unionByName(rejects, allowMissingColumns=True)
