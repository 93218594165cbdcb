"""Property tests: the skew-safe operators against their plain definitions."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sowline.operators import relational as R
from sowline.operators.quantiles import exact_quantiles
from sowline.operators.windows import next_in_group

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow])

values = st.one_of(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False),
                   st.integers(min_value=-5, max_value=5).map(float))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), values), min_size=1, max_size=120),
       st.sampled_from([1, 2, 3]))
def test_exact_quantiles_equal_numpy(spark, data, levels):
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.9, "qx": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, levels=levels).collect()}
    for g in {x for x, _ in data}:
        vs = np.array([v for x, v in data if x == g])
        for name, p in probs.items():
            ref = float(np.quantile(vs, p))      # linear interpolation, like pandas
            assert math.isclose(got[g][name], ref, rel_tol=1e-12, abs_tol=1e-9), (g, name)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["m1", "m2"]), st.integers(0, 5000)),
                min_size=1, max_size=80, unique_by=lambda t: t[1]))
def test_split_lead_equals_plain_lead(spark, data):
    df = spark.createDataFrame([(m, t, i) for i, (m, t) in enumerate(data)],
                               "m string, t long, id long")
    plain = next_in_group(df, "t", ["m"], ["t", "id"], "nxt")
    split = next_in_group(df, "t", ["m"], ["t", "id"], "nxt", split_by=F.floor(F.col("t") / 300))
    a = sorted((r.id, r.nxt) for r in plain.collect())
    b = sorted((r.id, r.nxt) for r in split.collect())
    assert a == b
    w = Window.partitionBy("m").orderBy("t", "id")
    ref = sorted((r.id, r.nxt) for r in df.withColumn("nxt", F.lead("t").over(w)).collect())
    assert a == ref


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)),
                          st.one_of(st.none(), st.integers(0, 4))), min_size=1, max_size=12),
       st.lists(st.one_of(st.none(), st.integers(0, 4)), min_size=0, max_size=8))
def test_or_join_equals_nested_loop(spark, left_rows, right_vals):
    left = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(left_rows)],
                                 "id long, a long, b long")
    right = spark.createDataFrame([(j, v) for j, v in enumerate(right_vals)], "rid long, x long")
    for how in ("inner", "left"):
        mine = sorted(map(tuple, R.or_join(left, right, ["a", "b"], "x", how=how)
                          .select("id", "rid").collect()), key=str)
        ref = sorted(map(tuple, left.join(right, (left.a == right.x) | (left.b == right.x), how)
                         .select("id", "rid").collect()), key=str)
        assert mine == ref, how


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=0, max_size=10),
       st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=0, max_size=6))
def test_not_in_equals_sql(spark, left_vals, right_vals):
    left = spark.createDataFrame([(v,) for v in left_vals], "k long")
    right = spark.createDataFrame([(v,) for v in right_vals], "v long")
    left.createOrReplaceTempView("p_left")
    right.createOrReplaceTempView("p_right")
    ref = sorted(map(tuple, spark.sql(
        "SELECT k FROM p_left WHERE k NOT IN (SELECT v FROM p_right)").collect()), key=str)
    mine = sorted(map(tuple, R.not_in(left, "k", right, "v").collect()), key=str)
    assert mine == ref
