"""Split joins, global row numbers and block scans against plain windows and joins."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sowline.operators.ordered import row_numbers
from sowline.operators.scan import block_scan
from sowline.operators.skew import heavy_keys, split_lookup


def _events(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice([1] * 6 + [2, 3, None]), rng.choice([None, *range(400)]), i, rng.choice([None, *range(-5, 6)])) for i in range(n)]
    return spark.createDataFrame(rows, "g int, t int, id int, v int").repartition(7)


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_row_numbers_equal_the_window(spark):
    df = _events(spark)
    order = [F.col("t").desc_nulls_last(), F.col("id").asc()]
    _same(row_numbers(df, order), df.withColumn("row_number", F.row_number().over(Window.orderBy(*order)).cast("long")))
    w = Window.partitionBy("g").orderBy(*order)
    _same(row_numbers(df, order, within=["g"]), df.withColumn("row_number", F.row_number().over(w).cast("long")))


def test_row_numbers_of_ties_and_empty(spark):
    same = spark.range(500).select(F.lit(1).alias("k"))
    assert sorted(r.row_number for r in row_numbers(same, [F.col("k")]).collect()) == list(range(1, 501))
    assert row_numbers(same.where("k = 2"), [F.col("k")]).count() == 0


def test_equal_values_are_dealt_over_partitions(spark):
    from sowline.operators.ordered import _sorted_parts
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # these few rows would become one
    try:
        parts = _sorted_parts(spark.range(8000).select(F.lit(1).alias("k")), [F.col("k")])
        sizes = [r["count"] for r in parts.groupBy("__pid").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 4000


@pytest.mark.parametrize("inclusive", [True, False])
def test_block_scan_equals_the_window(spark, inclusive):
    df = _events(spark)
    w = Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.withColumns({"s": F.sum("v").over(w), "n": F.sum(F.lit(1)).over(w), "l": F.last("v", ignorenulls=True).over(w)})
    got = block_scan(df, ["g"], ["t", "id"], F.floor(F.col("t") / 20), sums={"s": F.col("v"), "n": F.lit(1)},
                     lasts={"l": F.col("v")}, inclusive=inclusive)
    _same(got, want)
    assert block_scan(df.where("false"), ["g"], ["t", "id"], F.col("t"), sums={"s": F.col("v")}).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_lookup_equals_the_join(spark, how):
    df = _events(spark).select("id", F.when(F.col("g") == 3, F.col("id")).otherwise(F.col("g")).alias("k"))
    lookup = spark.range(0, 3000, 2).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("x"))
    lookup = lookup.union(spark.sql("select 1, 7L")).union(spark.sql("select cast(null as int), 5L"))
    assert {r.k for r in heavy_keys(df, ["k"], 20).collect()} == {1, 2}
    _same(split_lookup(df, lookup, ["k"], how, 20), df.join(lookup, "k", how).select("id", "k", "x"))


def test_split_lookup_on_two_keys_and_empty(spark):
    df = _events(spark)
    lookup = df.groupBy("g", "t").agg(F.count("*").alias("n"))
    _same(split_lookup(df, lookup, ["g", "t"], "left", 10), df.join(lookup, ["g", "t"], "left").select("g", "t", "id", "v", "n"))
    assert split_lookup(df.where("false"), lookup, ["g", "t"]).count() == 0
