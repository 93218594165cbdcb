"""Distinct bits, local-day ranges, merges by class, text parts, overall
quantiles and CSV rejects on hand-made frames."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowline.functions.dates import in_local_days, local_day
from sowline.operators.distinct import count_words, id_words, merge_words
from sowline.operators.factored import attach_class, expand, merge_classes
from sowline.operators.quantiles import overall_quantiles
from sowline.operators.textparts import text_parts, whole_text
from sowline.sources.tables import read_csv_checked


def test_distinct_bits_merge_up_the_levels(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([None, -1, -64, -65, 0, 63, 64, 1 << 62, rng.randrange(500)]))
            for _ in range(2000)] + [("only null", 0, None)]
    words = id_words(spark.createDataFrame(rows, "g string, d int, id long"), ["g", "d"], "id")
    fine, coarse = {}, {}
    for g, d, i in rows:
        fine.setdefault((g, d), set()).add(i)
        coarse.setdefault(g, set()).add(i)
    size = lambda s: len(s - {None})
    assert {(r.g, r.d): r.n_distinct for r in count_words(words, ["g", "d"]).collect()} == {k: size(v) for k, v in fine.items()}
    up = merge_words(words, {"g": F.col("g")})
    assert {r.g: r.n_distinct for r in count_words(up, ["g"]).collect()} == {k: size(v) for k, v in coarse.items()}
    assert count_words(id_words(spark.createDataFrame([], "g string, id long"), ["g"], "id"), ["g"]).count() == 0


@pytest.mark.parametrize("zone,first,last", [
    ("America/Chicago", dt.date(2024, 3, 10), dt.date(2024, 3, 10)),      # 23 hours
    ("America/Chicago", dt.date(2024, 11, 3), dt.date(2024, 11, 3)),      # 25 hours
    ("America/Sao_Paulo", dt.date(2018, 11, 4), dt.date(2018, 11, 5)),    # no midnight
    ("America/Havana", dt.date(2024, 11, 3), dt.date(2024, 11, 3)),       # midnight twice
    ("Asia/Kolkata", dt.date(2024, 1, 1), dt.date(2024, 1, 2))])
def test_local_day_range_equals_the_local_day(spark, zone, first, last):
    start = dt.datetime.combine(first, dt.time()) - dt.timedelta(days=2)
    ts = spark.range(6 * 96).select(F.timestamp_add("MINUTE", F.col("id") * 15, F.lit(str(start)).cast("timestamp_ntz")).alias("ts"))
    by_range = {r.ts for r in ts.where(in_local_days("ts", zone, first, last)).collect()}
    by_day = {r.ts for r in ts.where(local_day("ts", zone).between(F.lit(first), F.lit(last))).collect()}
    assert by_range == by_day and by_day


def test_local_day_range_reaches_the_reader(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.timestamp_add("HOUR", F.col("id"), F.lit("2024-01-10").cast("timestamp_ntz")).alias("ts")).write.parquet(path)
    df = spark.read.parquet(path).where(in_local_days("ts", "America/Chicago", dt.date(2024, 1, 10), dt.date(2024, 1, 10)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-10T06:00)" in plan and "LessThan(ts,2024-01-11T06:00)" in plan
    assert df.count() == 4


LEFT = [("x", 1), ("x", 2), (None, 4), (None, 8), (None, 16), ("only left", 32)]
RIGHT = [("x", 10), (None, 20), (None, 30), ("only right", 40)]


def _sides(spark):
    return spark.createDataFrame(LEFT, "name string, v long"), spark.createDataFrame(RIGHT, "rname string, w long")


def test_merge_classes_count_as_pandas(spark):
    left, right = _sides(spark)
    merged = pd.DataFrame(LEFT, columns=["name", "v"]).merge(pd.DataFrame(RIGHT, columns=["name", "w"]), how="left", on="name")
    want = merged.fillna({"name": "~"}).groupby("name").agg(n=("v", "size"), v=("v", "sum"))
    got = merge_classes(left, right, "name", "rname", {"v_sum": F.col("v")}, {"w_min": F.min("w")}).collect()
    assert {r.name or "~": (r.n_rows, r.v_sum) for r in got} == {k: (x.n, x.v) for k, x in want.iterrows()}
    assert {r.name: (r.n_right, r.w_min) for r in got} == {"x": (1, 10), None: (2, 20), "only left": (0, None)}
    pairs = expand(left, right, "name", "rname", max_rows=len(merged)).select("v", "w").collect()
    assert sorted((r.v, r.w or 0) for r in pairs) == sorted((v, 0 if np.isnan(w) else w) for v, w in zip(merged.v, merged.w))
    with pytest.raises(ValueError):
        expand(left, right, "name", "rname", max_rows=len(merged) - 1)


def test_the_class_of_no_name_stays_linear(spark):
    left = spark.range(50_000).select(F.lit(None).cast("string").alias("name"), "id")
    right = spark.range(50_000).select(F.lit(None).cast("string").alias("rname"), F.col("id").alias("w"))
    row = merge_classes(left, right, "name", "rname").collect()
    assert [(r.n_left, r.n_rows) for r in row] == [(50_000, 50_000 ** 2)]
    attached = attach_class(left, right, "name", "rname", {"n": F.count(F.lit(1)), "w": F.min("w")})
    assert attached.columns == ["name", "id", "n", "w"]
    assert attached.agg(F.count("*"), F.sum("n"), F.max("w")).first()[:] == (50_000, 50_000 ** 2, 0)


def test_text_parts_make_the_whole_text(spark):
    rng = random.Random(5)
    rows = [("hot", f"v{rng.randrange(3000)}") for _ in range(9000)] + [("é", "ü"), ("é", "z"), ("é", None), (None, "n"), ("none", None)]
    parts = text_parts(spark.createDataFrame(rows, "k string, v string"), ["k"], "v", size=64)
    got = {r.k: r.text for r in whole_text(parts, ["k"]).collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, set()).add(v)
    assert got == {k: ",".join(sorted(v, key=lambda s: s.encode())) for k, v in want.items()}
    sizes = [r.n_values for r in parts.where("k = 'hot'").orderBy("part").collect()]
    assert set(sizes[:-1]) == {64} and len(sizes) == -(-len(want["hot"]) // 64)


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [0.0, -0.0, 5.0], [-3.5] * 7 + [1e-300, 1e300], [1.0 + k * 2 ** -50 for k in range(40)],
    [float("inf"), 1.0, 2.0, float("-inf")], [-(1.5 ** k) for k in range(-40, 40)]])
def test_overall_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    row = overall_quantiles(df, "v", {"a": 0.0, "b": 0.3, "m": 0.5, "z": 1.0}).collect()
    assert len(row) == 1
    with np.errstate(invalid="ignore"):
        want = [np.quantile(np.array(values), p) for p in (0.0, 0.3, 0.5, 1.0)]
    for have, w in zip(row[0], want):
        assert np.isnan(w) or have == pytest.approx(w, rel=1e-15, abs=0)


def test_overall_quantiles_of_nothing_and_their_plan(spark):
    empty = overall_quantiles(spark.createDataFrame([(None,)], "v double"), "v", {"m": 0.5})
    assert [r.m for r in empty.collect()] == [None]
    plan = overall_quantiles(spark.range(1000).selectExpr("id * 0.5 AS v"), "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    # the chosen buckets are planned again for each level that reads them
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_csv_rejects_lose_no_line(spark, tmp_path):
    path = tmp_path / "dirty.csv"
    path.write_text("id,price,day\n1,2.5,2024-01-01\n2,n/a,2024-01-02\n3,,2024-01-03\n4,1.0,soon\n5,1.0\n6,1.0,2024-01-01,x\n\"7\",\"8\",2024-02-29\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("day", T.DateType())])
    good, rejects = read_csv_checked(spark, str(path), schema)
    assert [(r.id, r.price) for r in good.orderBy("id").collect()] == [(1, 2.5), (3, None), (7, 8.0)]
    assert sorted(r.line for r in rejects.collect()) == ["2,n/a,2024-01-02", "4,1.0,soon", "5,1.0", "6,1.0,2024-01-01,x"]
    # one column alone gives the same rows
    assert good.select("id").count() == 3


def test_small_sets_are_records_made_in_one_shuffle(spark):
    from sowline.operators.records import ENTRIES, nested_records

    lines = [(1, 1, "A", 10), (1, 1, "N", 11), (1, 1, "A", 10), (1, None, None, 12), (None, 2, "R", 13), (2, 3, "A", 14)]
    lines += [(3, i % 2, "AN"[i % 2], i // 3) for i in range(ENTRIES + 50)]
    rows = spark.createDataFrame(lines, "s long, e int, g string, q long")
    small = nested_records(rows.where("s is null or s < 3"), "s", "e", F.struct("q"), F.col("g"), [("Q", F.col("q"))])
    assert small._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = nested_records(rows, "s", "e", F.struct("q"), F.col("g"), [("Q", F.col("q"))]).collect()
    assert [r.s for r in got if r.whole].count(1) == 1 and all(r.whole == (r.s != 3) for r in got)
    flat = sorted(str((r.s, e.entry_id, m.q, i.value, tuple(e.groups))) for r in got for e in r.entries for m, i in zip(e.materials, e.instructions))
    groups = {}
    lines = [x for x in lines if x[0] is not None and x[1] is not None]
    for s, e, g, _ in lines:
        groups.setdefault((s, e), set()).update([g] if g else [])
    assert flat == sorted(str((s, e, q, str(q), tuple(sorted(groups[s, e])))) for s, e, _, q in lines)


@pytest.mark.parametrize("sent", [0, 10_000])
def test_rows_are_removed_without_a_row_per_value(spark, monkeypatch, sent):
    from sowline.operators import relational

    monkeypatch.setattr(relational, "SENT", sent)
    rng = random.Random(5)
    rows = [tuple(rng.choice([*range(6), None]) if k < 2 else rng.choice(["a", "b", None]) for k in range(3)) for _ in range(300)]
    listed = [r for r in rows if r[0] in (1, None)][:12]
    df = spark.createDataFrame(rows, "x long, y int, z string")
    got = relational.remove_rows(df, spark.createDataFrame(listed, df.schema))
    assert "Generate explode(array(struct" not in got._jdf.queryExecution().executedPlan().toString().replace("named_struct", "struct").replace("struct(__c", "struct")
    assert " distinct" not in got._jdf.queryExecution().logical().toString().lower()
    found = [{r[k] for r in listed} for k in range(3)]
    want = [r for r in rows if not all(r[k] in found[k] for k in range(3))]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert relational.remove_rows(df, df.limit(0)).count() == 300


def test_sets_of_the_process_lag_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    from sowline.plans import dates

    base = "/root/testdata/sf0.001"
    want = sorted(map(str, dates.process_lag(spark, base).collect()))
    monkeypatch.setattr(dates, "SET_LINES", 500)
    got = dates.process_lag(spark, base)
    n = -(-spark.read.parquet(f"{base}/lineitem.parquet").count() // 500)
    assert f", {n}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert want and sorted(map(str, got.collect())) == want
