"""The daily reports and traces on hand-made tables: NULLs, machines in two
lists, fields of two crops, hot keys, empty tables."""

import datetime as dt

import pytest

from sowline.plans import daily

DAY = dt.datetime(1998, 3, 1, 5)
SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    "customer": "c_custkey long, c_name string, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_nationkey int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
}
ROWS = {
    # hopper 4 and 7 are S0; 7 is in both category lists; 11 is another station; 3 is on no roster
    "lineitem": [(1, 1, 4, 1, 10.0, "R", "F", DAY), (1, 1, 7, 1, 10.0, "R", "F", DAY), (9, 1, 7, 1, 10.0, "R", "F", DAY),
                 (1, 1, 11, 1, 10.0, "R", "F", DAY), (1, 1, 3, 1, 10.0, "R", "F", DAY), (None, 1, 4, 1, 10.0, "R", "F", DAY),
                 (1, 1, 4, 1, 10.0, "R", "F", None), (1, 1, 4, 1, 10.0, "R", "F", dt.datetime(1999, 1, 1)),
                 # field Brand#2 has two crops, Brand#3 none
                 (1, 1, 4, 1, 10.0, "A", "O", DAY), (1, 2, 4, 1, 10.0, "A", "O", DAY)],
    "orders": [(1, 1, "F", dt.datetime(1998, 1, 1), "2-HIGH"), (9, 1, "F", dt.datetime(1997, 12, 31), "2-HIGH")],
    "part": [(1, "n", "Brand#2", "ECONOMY", 1), (2, "n", "Brand#2", "STANDARD", 1), (3, "n", "Brand#3", "ECONOMY", 10)],
    "customer": [(1, "Customer#000000001", 1), (2, "Customer#000000002", 2)],
    "nation": [(1, "NATION_3", 1), (2, "NATION_4", 4)],
    "supplier": [(1, 4), (4, 3), (7, 8)],
    "events": [],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    def make(rows):
        base = tmp_path_factory.mktemp("daily")
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(rows.get(name, []), schema).write.parquet(str(base / f"{name}.parquet"))
        return str(base)
    return make


def test_cells_by_category_and_crop(spark, folder):
    base = folder(ROWS)
    got = {(r.day.isoformat(), r.site, r.category): r.counted for r in daily.q_cells_daily_by_category(spark, base).collect()}
    # hopper 4 twice (its set known or NULL), hopper 7 twice; serial 10002-004 twice for Brand#2 and once for Brand#3
    assert got == {("1998-03-01", "S0", "cat3"): 7}
    rows = daily.q_cells_daily(spark, base).collect()
    found = {r.crop: (r.counted, r.total_counted) for r in rows if r.site}
    assert found == {"2-HIGH": (2, 2), "Velocity Crop Unknown": (2, 2), "ECONOMY": (1, 1), "STANDARD": (1, 1), "FTS Crop Unknown": (1, 1)}
    # days without cells stay, one row a day for both sites
    assert len([r for r in rows if r.site is None]) == 364 and {r.counted for r in rows if r.site is None} == {0}
    assert daily.q_cells_daily_category_columns(spark, base).collect()[0].asDict() == {"day": dt.date(1998, 3, 1), "cat2": None, "cat3": 7}


def test_packets_leave_out_totals_and_unknown_sources(spark, folder):
    scan = lambda line, flag, sup=6, part=1: (1, part, sup, line, 10.0, flag, "F", DAY)
    rows = {**ROWS, "lineitem": [scan(1, "N"), scan(6, "N"), scan(7, "N"), scan(1, "N", part=2), scan(1, "A"), scan(2, "A"), scan(1, "A", sup=9),
                                 scan(1, "R", sup=1), scan(1, "R", sup=7)]}
    base = folder(rows)
    # a packet number with a crop (part 2 leads to a request of no listed region), one record of the plot, one planned packet at S0
    got = daily.q_packets_daily(spark, base).collect()
    assert [(r.day, r.site, r.counted, r.total_counted) for r in got] == [(dt.date(1998, 3, 1), "S0", 3, 3)]
    # per machine the plot's record counts once each; serials 006 and 009 are cat3, planned packets have no machine
    wide = daily.q_packets_daily_category_columns(spark, base).collect()
    assert [(r.cat2, r.cat3, r.none) for r in wide] == [(None, 3, 1)]


def test_hot_plan_and_hot_packet_lose_nothing(spark, folder):
    rows = {**ROWS, "lineitem": [(i, 1, 6, 1, 10.0, "N", "F", DAY) for i in range(2000)] + [(i, 1, 7, 1, 10.0, "R", "F", DAY) for i in range(2000)]}
    assert daily.q_packets_daily(spark, folder(rows)).collect()[0].counted == 4000


def test_traces(spark, folder):
    rows = {**ROWS,
            # cell 1 of cassette 1 twice planted (orders 1 and 41); order 7's cell text is no number
            "orders": [(1, 1, "F", DAY, "a"), (41, 1, "F", DAY, "b"), (7, 1, "F", DAY, "c"), (2, None, "F", DAY, "d")],
            "events": [(1, dt.datetime(2024, 1, 1), 1, "x", 2.0), (41, dt.datetime(2023, 12, 31), 1, "x", 3.0), (7, dt.datetime(2024, 1, 1), 1, "x", 4.0)],
            "lineitem": [(5, 1, 3, 1, 10.0, "N", "F", DAY), (5, 1, 6, 1, 20.0, "N", "O", DAY), (5, 1, 4, 1, 10.0, "N", "F", DAY), (1, 9, 3, 1, 10.0, "A", "F", DAY)],
            "supplier": [(1, 4)]}
    base = folder(rows)
    got = sorted((r.entry_id, r.packet, r.batch_type, r.batch_count) for r in daily.q_plant_trace(spark, base).collect())
    assert got == [(1, 1, "NSP", 20.0), (1, 1, "YTP", 10.0), (41, 1, "NSP", 20.0), (41, 1, "YTP", 10.0)]
    trace = daily.q_packet_trace(spark, base).collect()
    # packet 1 holds entry 1 (set 1, plan 1, request NATION_3 with one row length); two scans of one machine kind, one of the other
    assert len(trace) == 2 and {(r.packet, r.entry_id, r.plot_row_length, r.nsp_child_scan) for r in trace} == {(1, 1, 15, "03-01-1998")}
    assert {r.ytp_serial for r in trace} == {"003", "004"}


def test_empty_tables(spark, folder):
    base = folder({})
    assert daily.q_cells_daily(spark, base).count() == 364 and daily.q_cells_daily_by_category(spark, base).count() == 0
    for q in (daily.q_packets_daily, daily.q_packets_daily_category_columns, daily.q_plant_trace, daily.q_packet_trace, daily.q_event_running_totals):
        assert q(spark, base).count() == 0


def test_event_totals_of_null_and_tied_rows(spark, folder):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, 3, "a", None), (2, at, 4, "a", 1.5), (3, at + dt.timedelta(days=2), 5, "a", 0.25), (4, at, 2, None, 1.0), (5, None, 8, "a", 1.0)]
    got = {r.event_id: (r.total_cents, r.total_events, r.last_even_user) for r in daily.q_event_running_totals(spark, folder({"events": rows})).collect()}
    assert got == {5: (100, 1, 8), 1: (100, 2, 8), 2: (250, 3, 4), 3: (275, 4, 4), 4: (100, 1, 2)}
