"""Hand-made frames for the semantic rules (M1-M20) and the small cases the
driver tables cannot show."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sowline.functions.dates import local_day, utc_day
from sowline.functions.numeric import round_half_even, round_half_up
from sowline.functions.text import decode_hopper, safe_decimal, substr_from_marker
from sowline.operators import relational as R
from sowline.operators.aggregates import (describe_string, histogram, null_profile,
                                          progress_status, string_agg, zero_fill)
from sowline.operators.dims import calendar, finish_date, machine_dim
from sowline.operators.nested import kv_pivot, unnest
from sowline.operators.planning import capacity_chain
from sowline.operators.quantiles import describe, exact_quantiles, iqr_filter
from sowline.operators.textids import extract_ids
from sowline.operators.windows import duplicate_flag, gap_to_next, pct_change, running_total


def _key(t):
    return tuple((x is None, str(x)) for x in t)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=_key)


def test_m1_utc_and_local_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 5, 1, 0),)], "ts timestamp_ntz")
    r = df.select(utc_day("ts").alias("u"), local_day("ts", "America/Chicago").alias("l")).first()
    assert r.u == dt.date(2024, 3, 5) and r.l == dt.date(2024, 3, 4)


def test_m2_m3_zero_fill_faithful_and_dense(spark):
    dim = calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 3), ["A", "B"])
    facts = spark.createDataFrame([(dt.date(2024, 1, 1), "A", "corn", 2),
                                   (dt.date(2024, 1, 1), "B", "corn", 1),
                                   (dt.date(2024, 1, 2), "A", "soy", 5)],
                                  "date date, site string, crop string, n long")
    faithful = zero_fill(dim, facts, [("day", "date"), ("site", "site")], "n",
                         group_right=["crop", "site"], mode="faithful")
    got = {(r.day, r.crop, r.site): r.counted for r in faithful.collect()}
    assert got[(dt.date(2024, 1, 2), None, None)] == 0     # unmatched site B collapses
    assert got[(dt.date(2024, 1, 3), None, None)] == 0     # both sites collapse to one row
    assert len(got) == 5
    dense = zero_fill(dim, facts.drop("crop"), [("day", "date"), ("site", "site")], "n", mode="dense")
    assert dense.count() == 6 and dense.where("counted = 0").count() == 3


def test_m4_m5_fanout_and_distinct_per_group(spark):
    pk = spark.createDataFrame([(1, ["e1", "e2"], "r1", "g1"), (2, ["e3"], "r1", "g2")],
                               "packet long, entries array<string>, record string, grp string")
    assert unnest(pk, "entries", "e").count() == 3          # rows, not packets
    per_group = pk.groupBy("grp").agg(F.countDistinct("record").alias("n"))
    assert per_group.agg(F.sum("n")).first()[0] == 2        # not globally distinct


def test_m6_m7_inner_and_outer_unnest(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, ["a"]), (4, ["a", "b"])],
                               "k long, arr array<string>")
    assert rows(unnest(df, "arr", "x"), "k", "x") == [(3, "a"), (4, "a"), (4, "b")]
    outer = rows(unnest(df, "arr", "x", outer=True), "k", "x")
    assert outer == [(1, None), (2, None), (3, "a"), (4, "a"), (4, "b")]


def test_m8_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    sub = spark.createDataFrame([(1,)], "v long")
    sub_null = spark.createDataFrame([(1,), (None,)], "v long")
    empty = spark.createDataFrame([], "v long")
    assert rows(R.not_in(left, "k", sub, "v")) == [(2,)]
    assert R.not_in(left, "k", sub_null, "v").count() == 0
    assert R.not_in(left, "k", empty, "v").count() == 3   # null key kept on empty subquery
    spark.createDataFrame([(1,), (2,), (None,)], "k long").createOrReplaceTempView("l_m8")
    sub_null.createOrReplaceTempView("s_m8")
    assert spark.sql("SELECT * FROM l_m8 WHERE k NOT IN (SELECT v FROM s_m8)").count() == 0


def test_m9_category_order(spark):
    d = machine_dim(spark, {"S0": ["10002-019", "10002-031", "10002-004"]},
                    [("Cat 3", ["10002-019", "10002-031"]), ("Cat 2", ["10002-019", "10002-004"])])
    got = {r.serial: (r.hopper, r.category) for r in d.collect()}
    assert got["10002-019"] == ("19", "Cat 3")
    assert got["10002-004"] == ("4", "Cat 2")


def _pandas_quantile(vals, p):
    return float(pd.Series(vals).quantile(p))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_exact_quantiles_against_pandas(spark, levels):
    rnd = random.Random(7)
    data = []
    for g in range(5):
        n = 1 if g == 0 else (2 if g == 1 else rnd.randint(3, 400))
        for _ in range(n):
            data.append((f"g{g}", rnd.choice([rnd.uniform(-1e3, 1e3), rnd.randint(-3, 3) * 1.0,
                                                0.0, -0.0, 1e-300, 5e15])))
    data += [("hot", float(i % 97) * 0.25) for i in range(3000)]     # one big group, many ties
    data += [("narrow", 1.7e9 + i * 1e-3) for i in range(500)]       # one 2^-16 bucket: deeper levels
    data += [(None, 1.0), ("g2", None), ("g3", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, levels=levels).collect()}
    pdf = pd.DataFrame(data, columns=["g", "v"]).dropna()
    assert set(got) == set(pdf.g.unique())          # null key dropped like pandas (M10)
    for g, grp in pdf.groupby("g"):
        for name, p in probs.items():
            assert math.isclose(got[g][name], _pandas_quantile(grp.v, p), rel_tol=1e-12,
                                abs_tol=1e-12), (g, name)


def test_describe_and_iqr_filter_against_pandas(spark):
    rnd = random.Random(3)
    data = [(s, rnd.expovariate(1 / 100)) for s in ("A", "B") for _ in range(300)]
    data += [("A", 5000.0), ("B", 9000.0)]
    df = spark.createDataFrame(data, "site string, v double")
    pdf = pd.DataFrame(data, columns=["site", "v"])
    d = {r.site: r for r in describe(df, ["site"], "v", digits=None).collect()}
    ref = pdf.groupby("site").v.describe()
    for s in ("A", "B"):
        for mine, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert math.isclose(d[s][mine], ref.loc[s, theirs], rel_tol=1e-9)

    def f(g):
        q1, q3 = g.v.quantile(.25), g.v.quantile(.75)
        return g[(g.v >= q1 - 1.5 * (q3 - q1)) & (g.v <= q3 + 1.5 * (q3 - q1))]
    kept = pdf.groupby("site", group_keys=False)[["site", "v"]].apply(f)
    mine = iqr_filter(df, ["site"], "v")
    assert mine.count() == len(kept)
    assert sorted(r.v for r in mine.collect()) == sorted(kept.v)


def test_m11_m17_m18_remove_rows(spark):
    final = spark.createDataFrame(
        [(1, 1, "x", None), (1, 1, "x", dt.date(2024, 1, 1)),     # found: keep the dated copy
         (2, 1, "y", None), (2, 1, "y", None),                    # found by neither: both go (M18)
         (1, 2, "z", None), (1, 2, "z", None),
         (2, 2, "x", None),                                       # unique, every value listed (M17)
         (3, 1, "x", None)],                                      # unique, cassette not listed
        "cassette long, cell long, name string, d date")
    dup = duplicate_flag(final, ["cassette", "cell"], "dup")
    to_del = dup.where("dup AND d IS NULL").drop("dup")
    per_col = rows(R.remove_rows(final, to_del, "per_column"))
    assert per_col == [(1, 1, "x", dt.date(2024, 1, 1)), (3, 1, "x", None)]
    exact = rows(R.remove_rows(final, to_del, "exact"))
    assert exact == [(1, 1, "x", dt.date(2024, 1, 1)), (2, 2, "x", None), (3, 1, "x", None)]
    # pandas merge matches null keys to each other (M11): eqNullSafe join
    a = spark.createDataFrame([(None, 1), ("n", 2)], "name string, i int")
    b = spark.createDataFrame([(None, "d0"), ("n", "d1")], "name string, d string")
    assert rows(a.join(b, a.name.eqNullSafe(b.name), "left").select("i", "d")) == [(1, "d0"), (2, "d1")]


def test_m12_outer_add_and_m16_pct_change(spark):
    a = spark.createDataFrame([(2025, 10.0), (2026, 20.0)], "year int, cells double")
    b = spark.createDataFrame([(2025, 1.0), (2027, 5.0)], "year int, cells double")
    got = {r.year: r.cells for r in R.outer_add(a, b, ["year"], ["cells"]).collect()}
    assert got == {2025: 11.0, 2026: None, 2027: None}
    s = pd.Series([100.0, None, 150.0, 0.0, 30.0])
    df = spark.createDataFrame([(i, None if pd.isna(v) else v) for i, v in enumerate(s)],
                               "i int, v double")
    mine = [r.pct_change for r in pct_change(df, "v", "i").orderBy("i").collect()]
    ref = s.ffill().pct_change(fill_method=None)  # what pandas 2.x does by default
    for m, r_ in zip(mine, ref):
        if pd.isna(r_) or math.isinf(r_):
            assert m is None                    # division by zero -> null (pandas: inf)
        else:
            assert math.isclose(m, r_)


def test_m13_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.5,), (0.375,), (-2.5,)], "x double")
    got = df.select(round_half_even("x", 2).alias("e2"), round_half_even("x", 0).alias("e0"),
                    round_half_up("x", 2).alias("u2"), round_half_up("x", 0).alias("u0")).collect()
    import numpy as np
    for r, x in zip(got, [0.125, 2.5, 0.375, -2.5]):
        assert r.e2 == np.round(x, 2) and r.e0 == np.round(x, 0)
    assert [r.u2 for r in got] == [0.13, 2.5, 0.38, -2.5]
    assert [r.u0 for r in got] == [0.0, 3.0, 0.0, -3.0]


def test_m15_gaps_split_equals_plain(spark):
    base = dt.datetime(2024, 1, 1, 23, 50)
    ev = [("m1", 0, 0, 100), ("m1", 1, 60, 120),            # overlap -> 0
          ("m1", 2, 480, 500), ("m1", 3, 800, 810),          # gap exactly 300 s
          ("m1", 4, 3700, 3710), ("m2", 5, 0, 10)]          # crosses an hour; last of day
    us = 1_000_000
    df = spark.createDataFrame(
        [(m, p, int(base.timestamp() * us) + s * us, int(base.timestamp() * us) + f * us, "d")
         for m, p, s, f in ev], "machine string, plot long, start_us long, finish_us long, day string")
    keys, order = ["machine", "day"], ["start_us", "plot"]
    plain = gap_to_next(df, "start_us", "finish_us", keys, order, "gap", "down")
    split = gap_to_next(df, "start_us", "finish_us", keys, order, "gap", "down",
                        split_by=F.floor(F.col("start_us") / 600_000_000))
    assert rows(plain, "plot", "gap", "down") == rows(split, "plot", "gap", "down")
    down = {r.plot: r.down for r in plain.collect()}
    assert down[1] == 360 * us and down[0] == 0 and down[2] == 300 * us and down[5] == 0


def test_m19_substr_marker_and_casts(spark):
    df = spark.createDataFrame([("MK-XYZ123",), ("ab MK-1",), ("none",), (None,)], "s string")
    got = [r[0] for r in df.select(substr_from_marker("s", "MK", 4)).collect()]
    assert got == ["MK-X", "MK-1", "none", None]
    d = spark.createDataFrame([("12.5",), ("abc",), ("",)], "s string")
    assert [r[0] for r in d.select(safe_decimal("s").cast("string")).collect()] == \
        ["12.500000000", None, None]
    h = spark.createDataFrame([("10002-004",), ("10002-000",), ("bad",)], "s string")
    assert [r[0] for r in h.select(decode_hopper("s")).collect()] == ["4", "", None]


def test_m20_string_agg_and_pivot_listagg(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k long, v string")
    got = {r.k: r.s for r in df.groupBy("k").agg(string_agg("v").alias("s")).collect()}
    assert got == {1: "a,b", 2: None}


def test_progress_status_buckets(spark):
    df = spark.createDataFrame([(1, "e1", None), (1, "e2", None), (2, "e1", 1), (2, "e2", None),
                                (3, "e1", 1), (4, None, None)], "s long, e string, filled int")
    got = {r.s: (r.total_entries, r.filled_entries, r.fill_status, r.filled_pct)
           for r in progress_status(df, ["s"], "e", F.col("filled").isNotNull()).collect()}
    assert got[1] == (2, 0, "Not Start", 0.0)
    assert got[2] == (2, 1, "In Progress", 50.0)
    assert got[3] == (1, 1, "Completed", 100.0)
    assert got[4] == (0, 0, None, None)


def _items(ids=(), blocks=(), names=()):
    return {(i, None, None) for i in ids} | {(None, b, None) for b in blocks} | {(None, None, n) for n in names}


def test_c30_extract_ids(spark):
    # expected rows written by hand from the meaning of Python's \\w, \\d, \\b and "."
    cases = [
        ("Sets 480664 - 480669 (6 sets) and AB_12x plus foo L3", _items([6, *range(480664, 480670)], ["AB_12x"], ["foo L3"])),
        ("reversed 500 - 400 (3 sets), single 7 - 9 (1 sets)", _items([500, 400, 3, 7, 9, 1])),
        ("é12 café_bar naïve L12 12é x_y_z 0042", _items([42], ["café_bar", "x_y_z"], ["naïve L12"])),
        ("nothing here", _items()),
        (None, _items()),
        ("é\u0301a_b", _items([], ["a_b"])),                       # a combining mark is no word character
        ("x²_y", _items([], ["x²_y"])),                            # a superscript is
        ("1 - 3 (a\r 5 sets)", _items([1, 2, 3, 5])),             # "." passes a carriage return
        ("1 - 3 (a\u0085 5 sets)", _items([1, 2, 3, 5])),         # and a next-line character
        ("1 - 3 (a\n 5 sets)", _items([1, 3, 5])),                # but no line feed
        ("12345678901234567890 - 12345678901234567892 (3 sets)", _items([3, 12345678901234567890, 12345678901234567891, 12345678901234567892])),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc long, text string")
    got = extract_ids(df, "text", ["doc"], range_chunk=4).collect()
    for i, (text, want) in enumerate(cases):
        assert {(None if r.set_id is None else int(r.set_id), r.block_name, r.set_name) for r in got if r.doc == i} == want, text


def test_c30_very_wide_range_starts(spark):
    df = spark.createDataFrame([(1, 10**6, 10**15)], "doc long, a long, b long").selectExpr(
        "doc", "cast(a as decimal(38,0)) as __a", "cast(b as decimal(38,0)) as __b")
    from sowline.operators.textids import RANGE_CHUNK, _expand
    plan = _expand(df.withColumn("__b", F.col("__a") + 200_000), ["doc"], RANGE_CHUNK)
    assert plan.agg(F.count("*").alias("n"), F.min("__id").alias("a"), F.max("__id").alias("b")).first()[:] == (200_001, 10**6, 10**6 + 200_000)


def test_c55_golden_chain_and_edges(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 10),)], "start date")
    r = capacity_chain(df, "start").first()
    assert (r.packet_fill_start, r.field_building_start, r.flex_filling_start, r.shipping_start) == \
        (dt.date(2024, 1, 30), dt.date(2024, 2, 2), dt.date(2024, 2, 6), dt.date(2024, 2, 7))
    cases = spark.createDataFrame([
        (dt.date(2024, 1, 6), 10.0, 10.0, False),    # Saturday start, Saturdays off -> Mon
        (dt.date(2024, 1, 7), 10.0, 10.0, True),     # Sunday start -> Mon
        (dt.date(2024, 1, 6), 20.0, 10.0, True),     # Saturday worked: Sat, Mon
        (dt.date(2024, 1, 10), 0.0, 10.0, False),    # nothing required: start itself
        (dt.date(2024, 1, 12), 50.0, 10.0, False)],  # exact multiple: 5 working days
        "start date, req double, daily double, sat boolean")
    got = [r[0] for r in cases.select(finish_date(F.col("start"), F.col("req"), F.col("daily"),
                                                  F.col("sat"))).collect()]
    assert got == [dt.date(2024, 1, 9), dt.date(2024, 1, 9), dt.date(2024, 1, 9),
                   dt.date(2024, 1, 10), dt.date(2024, 1, 19)]


def test_or_join_matches_nested_loop(spark):
    left = spark.createDataFrame([(1, 2), (2, 2), (3, None), (4, 9)], "a long, b long")
    right = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x long")
    mine = rows(R.or_join(left, right, ["a", "b"], "x"))
    ref = rows(left.join(right, (left.a == right.x) | (left.b == right.x)))
    assert mine == ref
    mine_left = rows(R.or_join(left, right, ["a", "b"], "x", how="left"), "a", "x")
    ref_left = rows(left.join(right, (left.a == right.x) | (left.b == right.x), "left"), "a", "x")
    assert mine_left == ref_left


def test_upsert_histogram_profile_describe_string(spark):
    df = spark.createDataFrame([(2024, 1.0), (2025, 2.0)], "year int, cells double")
    new = spark.createDataFrame([(2024, 9.0), (2023, 3.0)], "year int, cells double")
    assert rows(R.upsert_rows(df, new, ["year"])) == [(2023, 3.0), (2024, 9.0), (2025, 2.0)]
    h = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (10.0,), (11.0,)], "q double")
    assert rows(histogram(h, "q", [0, 5, 10]), "bin", "n") == [(0, 2), (1, 2)]
    nulls = {r.column_name: r.n_null for r in null_profile(
        spark.createDataFrame([(1, None), (None, None)], "a int, b string")).collect()}
    assert nulls == {"a": 1, "b": 2}
    s = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("x", "a"), ("x", None)],
                              "g string, v string")
    r = describe_string(s, ["g"], "v").first()
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (4, 2, "a", 2)


def test_kv_pivot_and_running_total(spark):
    df = spark.createDataFrame(
        [(1, [("SEEDS", "10"), ("PACKETS", "3")]), (2, [("SEEDS", "12.5"), ("SEEDS", "2")])],
        "k long, ins array<struct<code:string,value:string>>")
    got = {r.k: (r.seeds, r.packets) for r in kv_pivot(
        df, ["k"], "ins", "code", "value", {"seeds": "SEEDS", "packets": "PACKETS"}).collect()}
    assert {k: (float(s), None if p is None else float(p)) for k, (s, p) in got.items()} == \
        {1: (10.0, 3.0), 2: (12.5, None)}
    # with ANSI on, bad numeric text must go through try_cast
    bad = spark.createDataFrame([(1, [("SEEDS", "x")])],
                                "k long, ins array<struct<code:string,value:string>>")
    e = unnest(bad, "ins", "i")
    out = e.groupBy("k").agg(F.max(F.when(F.col("i.code") == "SEEDS",
                                          F.col("i.value").try_cast("decimal(38,9)"))).alias("s"))
    assert out.first().s is None
    d = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 5)], "site string, day int, n long")
    assert rows(running_total(d, "n", ["site"], ["day"]), "site", "day", "running_total") == \
        [("a", 1, 2), ("a", 2, 5), ("b", 1, 5)]


def test_calendar_grid_has_no_join(spark):
    cal = calendar(spark, dt.date(2024, 1, 30), dt.date(2024, 2, 2), ["A", "B", "C"])
    assert cal.count() == 12
    plan = cal._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_event_time_helpers_ignore_session_zone(spark):
    from sowline.functions.dates import epoch_micros, micros_to_date, micros_to_ts
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 9, 30),)], "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        out = []
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            r = df.select(epoch_micros("ts").alias("us"), utc_day("ts").alias("d"),
                          local_day("ts", "America/Chicago").alias("l")).first()
            back = df.select(micros_to_ts(epoch_micros("ts")).alias("t"),
                             micros_to_date(epoch_micros("ts")).alias("d2")).first()
            out.append((r.us, r.d, r.l, back.t, back.d2))
        assert len(set(out)) == 1
        assert out[0][0] == 1710063000 * 1_000_000 and out[0][2] == dt.date(2024, 3, 10)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_r1_observation_pivot_two_values_and_none(spark):
    from sowline.operators.reshape import pivot_listagg
    obs = spark.createDataFrame([("p1", "HT", "12"), ("p1", "HT", "10"), ("p1", "MST", "3"),
                                 ("p2", "MST", None), ("p2", "MST", "4")],
                                "plot string, trait string, v string")
    got = {r.plot: (r.HT, r.MST, r.YLD) for r in pivot_listagg(
        obs, ["plot"], "trait", {"HT": "HT", "MST": "MST", "YLD": "YLD"}, "v").collect()}
    assert got == {"p1": ("10,12", "3", None), "p2": (None, "4", None)}


def test_c49_runtime_cutoff_and_c50_zero_hours(spark):
    from sowline.operators.machines import machine_runtime, plots_per_hour
    us = 1_000_000
    rows = [("S", "m", dt.date(2024, 1, 1), 1, 0, 3600 * 19 * us, 0),      # 19 h: dropped (>= 18)
            ("S", "m", dt.date(2024, 1, 2), 2, 0, 0, 400 * us),            # gap > 300 s: not run time
            ("S", "m", dt.date(2024, 1, 3), 3, 0, 0, 300 * us)]            # gap == 300 s: run time
    df = spark.createDataFrame(rows, "site string, machine string, date date, plot_id long, "
                                     "start_us long, processing_us long, downtime_us long")
    rt = {r.date: r.runtime_seconds for r in machine_runtime(df).collect()}
    assert rt == {dt.date(2024, 1, 2): 0.0, dt.date(2024, 1, 3): 300.0}
    pph = {r.date: r.plots_per_hour for r in plots_per_hour(machine_runtime(df)).collect()}
    assert pph[dt.date(2024, 1, 2)] is None                               # 0 hours: null, not inf
    assert pph[dt.date(2024, 1, 3)] == 1 / 0.08


def test_m19_second_marker_only(spark):
    from sowline.functions.text import substr_from_marker
    df = spark.createDataFrame([("xx SEC-9",)], "s string")
    first = substr_from_marker("s", "MK", 4)
    second = substr_from_marker("s", "SEC", 5)
    # INSTR returns 0 -> SUBSTR from position 1: the first branch is never null,
    # so an NVL to the second marker never fires (the source's behaviour)
    r = df.select(F.coalesce(first, second).alias("v")).first()
    assert r.v == "xx S"


def test_n7_nest_children_bounded_parts(spark):
    from sowline.operators.nested import nest_children
    rows = [("hot", i) for i in range(250)] + [("cold", 1), ("cold", 2)]
    df = spark.createDataFrame(rows, "k string, child long")
    whole = {r.k: [c.child for c in r.kids] for r in nest_children(df, ["k"], ["child"], "kids").collect()}
    assert whole["cold"] == [1, 2] and whole["hot"] == list(range(250))
    parts = nest_children(df, ["k"], ["child"], "kids", max_children=100).collect()
    hot = [r for r in parts if r.k == "hot"]
    assert len(hot) <= 3 and sorted(c.child for r in hot for c in r.kids) == list(range(250))
    assert [(r.part_no, [c.child for c in r.kids]) for r in parts if r.k == "cold"] == [(0, [1, 2])]


def test_describe_keeps_all_missing_group_and_skips_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", None),
                                (None, 5.0)], "g string, v double")
    got = {r.g: r for r in describe(df, ["g"], "v", digits=None).collect()}
    assert set(got) == {"a", "b"}                              # null key dropped (M10)
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["p50"]) == (2.0, 2.0, 2.0)
    assert got["b"]["count"] == 0.0 and got["b"]["mean"] is None and got["b"]["p50"] is None


def test_collect_bounded_splits_a_hot_key(spark):
    from sowline.operators.nested import collect_bounded
    rows = [("hot", i, i % 7) for i in range(5000)] + [("cold", 0, 1)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    parts = collect_bounded(df, ["k"], F.col("v"), "vs", max_len=1000).collect()
    hot = [r for r in parts if r.k == "hot"]
    assert len(hot) == 5 and max(len(r.vs) for r in hot) < 1300     # about max_len each
    assert sorted(x for r in hot for x in r.vs) == sorted(i % 7 for i in range(5000))
    assert [(r.part_no, r.vs) for r in parts if r.k == "cold"] == [(0, [1])]


def test_collect_bounded_loses_nothing(spark):
    from sowline.operators.nested import collect_bounded
    rows = [(1, "a", 0)] * 3000 + [(None, "b", 0), (None, None, 0), (2, None, 0), (2, "c", 1)]
    df = spark.createDataFrame(rows, "k int, v string, unread int")
    got = [(r.k, sorted(r.vs, key=str)) for r in collect_bounded(df, ["k"], F.col("v"), "vs", max_len=1000).collect()]
    assert len([v for k, v in got if k == 1]) > 1
    union = {}
    for k, v in got:
        union.setdefault(k, []).extend(v)
    assert {k: sorted(v, key=str) for k, v in union.items()} == {1: ["a"] * 3000, None: [None, "b"], 2: [None, "c"]}


def test_n7_query_keeps_a_hot_customer_in_one_row(spark, tmp_path):
    import json

    from sowline.plans.progress import q_nest_children
    spark.range(3003).selectExpr("id as o_orderkey", "if(id < 3000, 1L, 2L) as o_custkey", "'F' as o_orderstatus") \
        .write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_custkey: r for r in q_nest_children(spark, str(tmp_path)).collect()}
    assert {k: (r.part_no, r.n_orders) for k, r in got.items()} == {1: (0, 3000), 2: (0, 3)}
    assert [c["o_orderkey"] for c in json.loads(got[1].orders_json)] == list(range(3000))
    assert q_nest_children(spark, str(tmp_path)).count() == 2


def test_n7_query_cuts_a_wide_customer_by_key_range(spark, tmp_path):
    from sowline.plans.progress import PART_KEYS, q_nest_children
    spark.range(10).selectExpr(f"id * {PART_KEYS // 4} as o_orderkey", "1L as o_custkey", "'F' as o_orderstatus") \
        .write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.part_no: r.n_orders for r in q_nest_children(spark, str(tmp_path)).collect()}
    assert got == {0: 4, 1: 4, 2: 2}
