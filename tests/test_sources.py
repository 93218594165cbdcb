import datetime as dt
import os
import tempfile

from sowline.session import checkpoint_dir, materialize
from sowline.sources.tables import constants, read_csv, read_materialized, write_results


def test_write_results_and_read_back(spark):
    out = tempfile.mkdtemp(prefix="sowline-results-")
    a = constants(spark, [(1, "x"), (2, "y")], "k long, v string")
    b = constants(spark, [(dt.date(2024, 1, 1), 3)], "d date, n long")
    paths = write_results({"cells": a, "pivot": b}, out)
    assert set(paths) == {"cells", "pivot"}
    assert read_materialized(spark, paths["cells"]).count() == 2
    paths_csv = write_results({"cells": a}, os.path.join(out, "csv"), fmt="csv")
    back = read_csv(spark, paths_csv["cells"], "k long, v string")
    assert sorted(r.k for r in back.collect()) == [1, 2]


def test_materialize_uses_session_checkpoint_dir(spark):
    d = checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
    df = materialize(constants(spark, [(1,), (2,)], "k long"))
    assert df.count() == 2 and d


def test_write_set_is_seen_by_its_manifest(spark):
    from sowline.sources.tables import read_result, write_set
    out = tempfile.mkdtemp(prefix="sowline-set-")
    a = constants(spark, [(1, "x"), (2, None)], "k long, v string")
    b = constants(spark, [(7.5,)], "n double")
    first = write_set({"a": a, "b": b}, out)
    assert sorted(map(tuple, read_result(spark, out, "a").collect())) == [(1, "x"), (2, None)]
    # a second set whose write failed half way: no manifest line, so the first one is still read
    b.write.parquet(os.path.join(out, "unfinished"))
    assert read_result(spark, out, "b").columns == ["n"] and read_result(spark, out, "b").first().n == 7.5
    second = write_set({"a": a.where("k = 1")}, out)
    assert read_result(spark, out, "a").count() == 1 and read_result(spark, out, "a", first).count() == 2 and first != second


def test_release_workbook_holds_five_results(spark):
    from sowline.plans.textual import SHEETS, release_workbook
    from sowline.sources.tables import read_result
    out = tempfile.mkdtemp(prefix="sowline-workbook-")
    run = release_workbook(spark, "/root/testdata/sf0.001", out)
    assert read_result(spark, out, "cells", run).count() > 0
    assert all(read_result(spark, out, f"by_{c}", run).columns[0] == "day" for c in SHEETS)


def test_plan_sheet_round_trip(spark):
    from pyspark.sql import functions as F

    from sowline.operators.planning import plan_totals, plan_units
    from sowline.sources.tables import read_plan_sheet
    out = tempfile.mkdtemp(prefix="sowline-sheet-")
    sheet = constants(spark, [(2025, "Corn", 10.0, None), (2025, "Soy", 4.0, 1.0),
                              (2026, "Corn", 6.0, 3.0)],
                      "Year int, Crop string, Plots double, Rows_Per_Plot double")
    sheet.coalesce(1).write.option("header", True).csv(os.path.join(out, "yield"))
    plan = read_plan_sheet(spark, os.path.join(out, "yield"), "yield")
    units = plan_units(plan, "plots", "Rows_Per_Plot", 2.0)
    got = {r.Year: (r.cells, r.packets) for r in plan_totals(units, ["Year"]).collect()}
    # null rows -> 2: cells 20, packets 10; one row: 4 / 4; three rows: 18 / 9
    assert got == {2025: (24.0, 14.0), 2026: (18.0, 9.0)}
    assert units.where(F.col("rows_per_plot_filled") == 2.0).count() == 1


class _FakeConf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _FakeContext:
    def __init__(self, master, ckpt=None):
        self.master, self._ckpt = master, ckpt

    def getCheckpointDir(self):
        return self._ckpt

    def setCheckpointDir(self, d):
        self._ckpt = d


class _FakeSession:
    def __init__(self, master, conf=None):
        self.sparkContext = _FakeContext(master)
        self.conf = _FakeConf(conf or {})


def test_checkpoint_dir_rules():
    import pytest
    # a cluster must name a shared folder: no machine-local fallback
    with pytest.raises(ValueError):
        checkpoint_dir(_FakeSession("yarn"))
    # the cluster's setting is used as is
    s = _FakeSession("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs:///shared/ckpt"
    # local mode (tests) gets a scratch folder only when none is set
    local = _FakeSession("local[2]")
    d = checkpoint_dir(local)
    assert os.path.isdir(d) and local.conf.get("spark.checkpoint.dir") == d
