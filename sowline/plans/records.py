"""Set progress and stock checks over stored nested records.

Mapping: an order is a set, its customer the experiment and the customer's
nation the capacity request.  An entry is a line number of the order; its
lines are its materials and packets, a line with status 'F' is filled on its
ship date.  Orders with status 'F' or 'P' are ready to execute on their order
day.  The entry's site and home site stand for its geography, the request's
environment is a list with the region of an even nation, else empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowline.functions.dates import utc_day
from sowline.functions.numeric import round_half_up
from sowline.operators.records import any_of, coded_max, nested_records
from sowline.plans.registry import register
from sowline.sources.tables import read_table, store

_STORED: dict[tuple, DataFrame] = {}


def set_records(spark, base) -> DataFrame:
    """The nested records of the order tables, written once a session."""
    o, li = read_table(spark, base, "orders"), read_table(spark, base, "lineitem")
    key = (spark.sparkContext.applicationId, *sorted(o.inputFiles() + li.inputFiles()))
    if key not in _STORED:
        lines = li.select("l_orderkey", "l_linenumber", "l_returnflag", F.struct(
            F.col("l_partkey").alias("barcode"), F.when(F.col("l_suppkey") % 5 == 0, "label").otherwise("inventory").alias("product"),
            F.when(F.col("l_linestatus") == "F", utc_day("l_shipdate")).alias("filled_date"), "l_quantity").alias("m"))
        entries = nested_records(lines, "l_orderkey", "l_linenumber", F.col("m"), F.col("l_returnflag"),
                                 [("PACK_ENT", F.col("m.l_quantity")), ("SEEDS_PACK", F.col("l_linenumber"))])
        c, n, r = (read_table(spark, base, t) for t in ("customer", "nation", "region"))
        requests = n.join(r, n.n_regionkey == r.r_regionkey).select(
            "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.array(F.struct(F.col("r_name").alias("homesite"))))
            .otherwise(F.array().cast("array<struct<homesite:string>>")).alias("environment"))
        heads = (o.join(c, o.o_custkey == c.c_custkey).join(requests, c.c_nationkey == requests.n_nationkey)
                 .select(F.col("o_orderkey").alias("set_id"), F.col("o_custkey").alias("experiment_id"), F.col("c_name").alias("experiment_name"),
                         F.col("c_nationkey").alias("vcr"), F.col("o_orderstatus").alias("status"), utc_day("o_orderdate").alias("audit_day"), "environment"))
        _STORED[key] = store(heads.join(entries, heads.set_id == entries.l_orderkey).drop("l_orderkey"), "records")
    return _STORED[key]


READY = "status IN ('F', 'P')"
SINCE = "1997-07-31"
READY_SINCE = f"{READY} AND audit_day >= DATE '{SINCE}'"

LINES_SQL = """
l AS (SELECT o_orderkey AS set_id, o_custkey AS experiment_id, c_name AS experiment_name, c_nationkey AS vcr, r_name, o_orderstatus AS status,
             CAST(o_orderdate AS DATE) AS audit_day, l_linenumber AS entry_id, l_partkey AS barcode, l_returnflag AS grp, l_quantity,
             CASE WHEN l_suppkey % 5 = 0 THEN 'label' ELSE 'inventory' END AS product,
             CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS filled_date
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
      JOIN lineitem ON l_orderkey = o_orderkey)"""


@register("set_progress_report", sql=f"""
WITH {LINES_SQL},
rte AS (SELECT set_id, vcr, experiment_name, experiment_id, entry_id, 'site ' || (entry_id % 3) AS site,
               coalesce(CASE WHEN entry_id % 2 = 0 THEN 'home ' || (entry_id % 4) END, CASE WHEN vcr % 2 = 0 THEN r_name END) AS homesite,
               max(audit_day) AS rte_date
        FROM l WHERE status IN ('F', 'P') AND audit_day >= DATE '{SINCE}' AND grp IN ('A', 'N') GROUP BY ALL),
f AS (SELECT rte.*, l.filled_date FROM rte LEFT JOIN l USING (set_id, entry_id)),
p AS (SELECT set_id, vcr, experiment_name, experiment_id, rte_date, homesite, site, count(entry_id) AS total_entries,
             count(filled_date) AS filled_entries, count(filled_date) * 100.0::DOUBLE / count(entry_id) AS pct FROM f GROUP BY ALL)
SELECT set_id, vcr, experiment_name, experiment_id, rte_date, homesite, site, total_entries, filled_entries,
       CASE WHEN pct = 0 THEN 'Not Start' WHEN pct > 0 AND pct < 100 THEN 'In Progress' WHEN pct = 100 THEN 'Completed' END AS fill_status,
       sign(pct) * floor(abs(pct) * 100 + 0.5) / 100 AS filled_pct
FROM p""")
def q_set_progress_report(spark, base):
    r = set_records(spark, base).where(READY_SINCE)
    # folded in the row: entries of a wanted group, with their packets counted
    e = F.transform(F.filter("entries", lambda e: any_of(e["groups"], ["A", "N"])), lambda e: F.named_struct(
        F.lit("entry_id"), e["entry_id"], F.lit("total"), F.size(e["materials"]),
        F.lit("filled"), F.size(F.filter(e["materials"], lambda m: m["filled_date"].isNotNull()))))
    per = (r.select("set_id", "vcr", "experiment_name", "experiment_id", "audit_day", F.explode_outer("environment.homesite").alias("env"), e.alias("e"))
           .select("*", F.explode("e").alias("x")))
    i = F.col("x.entry_id")
    own = F.when(i % 2 == 0, F.concat(F.lit("home "), (i % 4).cast("string")))
    p = per.groupBy("set_id", "vcr", "experiment_name", "experiment_id", F.col("audit_day").alias("rte_date"), F.coalesce(own, "env").alias("homesite"),
                    F.concat(F.lit("site "), (i % 3).cast("string")).alias("site")) \
        .agg(F.sum("x.total").alias("total_entries"), F.sum("x.filled").alias("filled_entries"))
    pct = F.col("filled_entries") * F.lit(100.0) / F.col("total_entries")
    return p.select("*", F.when(pct == 0, "Not Start").when((pct > 0) & (pct < 100), "In Progress").when(pct == 100, "Completed").alias("fill_status"),
                    round_half_up(pct, 2).alias("filled_pct"))


@register("set_list", sql=f"""
WITH {LINES_SQL}
SELECT DISTINCT set_id, experiment_name, experiment_id, audit_day AS rte_date
FROM l JOIN part ON p_partkey = barcode AND p_size >= 25
WHERE status IN ('F', 'P') AND year(audit_day) = 1998
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = set_id AND l_linenumber = entry_id AND l_returnflag LIKE 'N%')""")
def q_set_list(spark, base):
    r = set_records(spark, base).where(f"{READY} AND audit_day >= DATE '1998-01-01' AND audit_day < DATE '1999-01-01'")
    codes = F.array_distinct(F.flatten(F.transform(
        F.filter("entries", lambda e: F.exists(e["groups"], lambda g: g.startswith("N"))), lambda e: e["materials"]["barcode"])))
    held = r.select("set_id", "experiment_name", "experiment_id", F.col("audit_day").alias("rte_date"), F.explode(codes).alias("barcode"))
    stock = read_table(spark, base, "part").where("p_size >= 25").select(F.col("p_partkey").alias("barcode"))
    return held.join(stock, "barcode", "left_semi").select("set_id", "experiment_name", "experiment_id", "rte_date").distinct()


def _inventory(spark, base):
    return read_table(spark, base, "part").select(F.col("p_partkey").alias("barcode"), (F.col("p_size") * 10.0).alias("quantity"))


@register("experiment_stock_v1", sql=f"""
WITH {LINES_SQL},
g AS (SELECT DISTINCT set_id, entry_id, grp AS wanted FROM l WHERE grp IN ('A', 'N')),
r AS (SELECT experiment_id, experiment_name, wanted, barcode, sum(l_quantity) AS requested FROM l JOIN g USING (set_id, entry_id)
      WHERE status IN ('F', 'P') GROUP BY ALL)
SELECT experiment_id, experiment_name, wanted, barcode, requested, p_size * 10.0::DOUBLE AS quantity, p_size * 10.0::DOUBLE - requested AS difference
FROM r LEFT JOIN part ON p_partkey = barcode""")
def q_experiment_stock_v1(spark, base):
    # two independent unnests of an entry: its groups and its materials
    e = set_records(spark, base).where(READY).select("experiment_id", "experiment_name", F.explode("entries").alias("e"))
    pairs = e.select("experiment_id", "experiment_name", F.explode(F.filter("e.groups", lambda g: g.isin("A", "N"))).alias("wanted"), F.col("e.materials").alias("ms"))
    m = pairs.select("experiment_id", "experiment_name", "wanted", F.explode("ms").alias("m"))
    r = m.groupBy("experiment_id", "experiment_name", "wanted", F.col("m.barcode").alias("barcode")).agg(F.sum("m.l_quantity").alias("requested"))
    return r.join(_inventory(spark, base), "barcode", "left").select(
        "experiment_id", "experiment_name", "wanted", "barcode", "requested", "quantity", (F.col("quantity") - F.col("requested")).alias("difference"))


@register("material_stock_v1", sql=f"""
WITH {LINES_SQL},
r AS (SELECT barcode, sum(l_quantity) AS requested, count(DISTINCT set_id) AS n_sets FROM l WHERE product = 'inventory' GROUP BY ALL)
SELECT barcode, requested, n_sets, p_size * 10.0::DOUBLE AS quantity, p_size * 10.0::DOUBLE - requested AS difference
FROM r JOIN part ON p_partkey = barcode""")
def q_material_stock_v1(spark, base):
    # entries -> materials, the element filter inside the row
    kept = F.flatten(F.transform("entries", lambda e: F.filter(e["materials"], lambda m: m["product"] == "inventory")))
    m = set_records(spark, base).select("set_id", F.explode(kept).alias("m")).select("set_id", F.col("m.barcode").alias("barcode"), F.col("m.l_quantity").alias("q"))
    per_set = m.groupBy("barcode", "set_id").agg(F.sum("q").alias("q"))
    r = per_set.groupBy("barcode").agg(F.sum("q").alias("requested"), F.count(F.lit(1)).alias("n_sets"))
    return r.join(_inventory(spark, base), "barcode").select("*", (F.col("quantity") - F.col("requested")).alias("difference"))


RAW_SQL = LINES_SQL + f""",
req AS (SELECT set_id, entry_id, max(l_quantity) AS packet, max(l_quantity) * max(entry_id) AS quantity FROM l GROUP BY ALL),
bar AS (SELECT DISTINCT set_id, entry_id, barcode, p_size * 10.0::DOUBLE AS stock FROM l JOIN part ON p_partkey = barcode WHERE product = 'inventory'),
combined AS (
  SELECT DISTINCT vcr, experiment_name, experiment_id, bar.barcode, l.set_id, filled_date, l.entry_id, req.quantity, packet, stock,
         CASE WHEN status IN ('F', 'P') AND audit_day >= DATE '{SINCE}' THEN l.set_id END AS gl_set_id,
         CASE WHEN status IN ('F', 'P') AND audit_day >= DATE '{SINCE}' THEN audit_day END AS rte_date
  FROM l JOIN req ON req.set_id = l.set_id AND req.entry_id = l.entry_id JOIN bar ON bar.set_id = l.set_id AND bar.entry_id = l.entry_id)"""
SUMS_SQL = "sum(quantity) AS set_requested_quantity, sum(packet) AS set_requested_packet, min(stock) AS inventory_quantity"
RAW_KEYS = ["vcr", "experiment_name", "experiment_id", "barcode", "set_id", "gl_set_id", "rte_date", "filled_date"]


def _repeated(spark, base) -> DataFrame:
    """Sets with several whole records (their order, customer or nation has
    several rows), written once a session."""
    r = set_records(spark, base)
    key = ("repeated", spark.sparkContext.applicationId, *sorted(r.inputFiles()))
    if key not in _STORED:
        n = r.where("whole").groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
        _STORED[key] = store(n.where("n > 1").select("set_id"), "repeated-sets")
    return _STORED[key]


def combined(spark, base) -> DataFrame:
    """One row per entry, inventory barcode and filled date of the entry, with
    the entry's requested amounts (the join of three unnests of the records).

    In the only, whole record of a set the three meet inside the row; only
    sets with several records are unnested apart and joined.
    """
    ready = F.expr(READY_SINCE)
    key = ["set_id", "entry_id"]
    heads = [c for c in RAW_KEYS if c not in ("barcode", "filled_date", "set_id")]
    p, s = coded_max(F.col("e.instructions"), "PACK_ENT"), coded_max(F.col("e.instructions"), "SEEDS_PACK")
    codes = F.array_distinct(F.filter("e.materials", lambda m: m["product"] == "inventory")["barcode"])
    days = F.array_distinct("e.materials.filled_date")

    def entries(r):
        return r.select("vcr", "experiment_name", "experiment_id", "set_id", F.when(ready, F.col("set_id")).alias("gl_set_id"),
                        F.when(ready, F.col("audit_day")).alias("rte_date"), F.explode("entries").alias("e")) \
            .select("*", F.col("e.entry_id").alias("entry_id"))

    def amounts(p, s):
        return p.cast("double").alias("packet"), (p * s).cast("double").alias("quantity")

    r, repeated = set_records(spark, base), _repeated(spark, base)
    only = entries(r.where("whole").join(repeated, "set_id", "left_anti")).where("entry_id is not null")
    rows = only.select(*heads, *key, *amounts(p, s), codes.alias("codes"), F.explode(days).alias("filled_date")) \
        .select("*", F.explode("codes").alias("barcode")).drop("codes")
    several = entries(r.where("not whole").unionByName(r.where("whole").join(repeated, "set_id", "left_semi")))
    request = several.select(*key, p.alias("p"), s.alias("s")).groupBy(*key).agg(*amounts(F.max("p"), F.max("s")))
    asked = several.select(*key, F.explode(codes).alias("barcode")).distinct()
    filled = several.select(*key, *heads, F.explode(days).alias("filled_date")).distinct()
    rows = rows.unionByName(filled.join(request, key).join(asked, key))
    return rows.join(_inventory(spark, base).withColumnRenamed("quantity", "stock"), "barcode")


def _sums(df, keys):
    return df.groupBy(*keys).agg(F.sum("quantity").alias("set_requested_quantity"), F.sum("packet").alias("set_requested_packet"),
                                 F.min("stock").alias("inventory_quantity"))


@register("experiment_requests_raw", sql=f"WITH {RAW_SQL} SELECT {', '.join(RAW_KEYS)}, {SUMS_SQL} FROM combined GROUP BY ALL")
def q_experiment_requests_raw(spark, base):
    return _sums(combined(spark, base), RAW_KEYS)


@register("material_requests_raw", sql=f"WITH {RAW_SQL} SELECT {', '.join(RAW_KEYS[3:])}, {SUMS_SQL} FROM combined GROUP BY ALL")
def q_material_requests_raw(spark, base):
    return _sums(combined(spark, base), RAW_KEYS[3:])


@register("experiment_stock_check", sql=f"""
WITH {RAW_SQL},
raw AS (SELECT {', '.join(RAW_KEYS)}, {SUMS_SQL} FROM combined GROUP BY ALL),
latest AS (SELECT experiment_id, max(rte_date) AS rte_date FROM raw WHERE gl_set_id IS NOT NULL GROUP BY 1),
g AS (SELECT vcr, experiment_name, experiment_id, barcode, min(inventory_quantity) AS inventory_quantity,
             sum(CASE WHEN gl_set_id IS NOT NULL AND filled_date IS NULL THEN set_requested_quantity ELSE 0 END) AS ready_open_seed,
             sum(CASE WHEN gl_set_id IS NOT NULL AND filled_date IS NULL THEN set_requested_packet ELSE 0 END) AS ready_open_packet,
             sum(CASE WHEN gl_set_id IS NOT NULL AND filled_date IS NOT NULL THEN set_requested_quantity ELSE 0 END) AS ready_filled_seed,
             sum(CASE WHEN gl_set_id IS NULL AND filled_date IS NULL THEN set_requested_quantity ELSE 0 END) AS other_open_seed
      FROM raw GROUP BY 1, 2, 3, 4)
SELECT vcr, experiment_name, latest.experiment_id, latest.rte_date, barcode, ready_open_seed, ready_open_packet, ready_filled_seed, inventory_quantity,
       inventory_quantity >= ready_open_seed AS enough_for_ready, inventory_quantity >= ready_open_seed + other_open_seed AS enough_for_all
FROM latest LEFT JOIN g ON latest.experiment_id = g.experiment_id""")
def q_experiment_stock_check(spark, base):
    c = combined(spark, base)
    ready, filled = F.col("gl_set_id").isNotNull(), F.col("filled_date").isNotNull()
    pick = lambda cond, v: F.sum(F.when(cond, F.col(v)).otherwise(F.lit(0.0)))
    # sums of the raw report's sums are sums of its rows: one grouping
    g = c.groupBy("vcr", "experiment_name", "experiment_id", "barcode").agg(
        F.min("stock").alias("inventory_quantity"), pick(ready & ~filled, "quantity").alias("ready_open_seed"),
        pick(ready & ~filled, "packet").alias("ready_open_packet"), pick(ready & filled, "quantity").alias("ready_filled_seed"),
        pick(~ready & ~filled, "quantity").alias("other_open_seed"), F.max("rte_date").alias("latest"))
    # the experiment's latest day over its materials
    last = g.groupBy("experiment_id").agg(F.max("latest").alias("rte_date")).where("rte_date is not null")
    stock, need = F.col("inventory_quantity"), F.col("ready_open_seed")
    return last.join(g.drop("latest"), "experiment_id", "left").select(
        "vcr", "experiment_name", "experiment_id", "rte_date", "barcode", "ready_open_seed", "ready_open_packet", "ready_filled_seed", "inventory_quantity",
        (stock >= need).alias("enough_for_ready"), (stock >= need + F.col("other_open_seed")).alias("enough_for_all"))


@register("material_stock_check", sql=f"""
WITH {RAW_SQL},
raw AS (SELECT {', '.join(RAW_KEYS[3:])}, {SUMS_SQL} FROM combined GROUP BY ALL),
total AS (SELECT barcode, sum(set_requested_quantity) AS inventory_total_requested FROM raw GROUP BY 1)
SELECT raw.barcode, min(inventory_total_requested) AS inventory_total_requested, sum(set_requested_quantity) AS inventory_current_requested,
       sum(set_requested_packet) AS packet_current_requested, min(inventory_quantity) AS inventory_quantity,
       CASE WHEN min(inventory_quantity) - sum(set_requested_quantity) < 0 THEN 'Not Enough Seed' END AS note
FROM raw JOIN total ON total.barcode = raw.barcode WHERE filled_date IS NULL GROUP BY 1""")
def q_material_stock_check(spark, base):
    open_ = F.col("filled_date").isNull()
    g = combined(spark, base).groupBy("barcode").agg(
        F.sum("quantity").alias("inventory_total_requested"), F.sum(F.when(open_, F.col("quantity"))).alias("inventory_current_requested"),
        F.sum(F.when(open_, F.col("packet"))).alias("packet_current_requested"), F.min("stock").alias("inventory_quantity"),
        F.count(F.when(open_, 1)).alias("n")).where("n > 0").drop("n")
    short = F.col("inventory_quantity") - F.col("inventory_current_requested") < 0
    return g.select("*", F.when(short, "Not Enough Seed").alias("note"))
