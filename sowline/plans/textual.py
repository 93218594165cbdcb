"""Text family: serial decoding, tolerant casts, id extraction from whole
documents, date attachment with duplicate removal (F17-F26, C30, C31, J15,
J16, U3, W6, R3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sowline.functions.text import SERIAL_PATTERN, decode_hopper, safe_decimal
from sowline.operators.relational import remove_rows, union_all
from sowline.operators.reshape import pivot_table
from sowline.operators.skew import split_lookup
from sowline.operators.textids import RANGE_PATTERN, extract_ids
from sowline.plans.registry import register
from sowline.session import checkpoint_dir
from sowline.sources.tables import read_result, read_table, store, write_set


def T(spark, base, name):
    return read_table(spark, base, name)


SQL_SERIAL = SERIAL_PATTERN.replace("'", "''")


@register("machine_decode", sql=f"""
WITH s AS (SELECT c_custkey, c_mktsegment || '-' || substr(c_name, 10) AS serial FROM customer)
SELECT c_custkey, serial,
       CASE WHEN regexp_matches(serial, '{SQL_SERIAL}')
            THEN ltrim(regexp_extract(serial, '{SQL_SERIAL}', 1), '0') END AS hopper
FROM s""")
def q_machine_decode(spark, base):
    c = T(spark, base, "customer")
    serial = F.concat(F.col("c_mktsegment"), F.lit("-"), F.substring("c_name", 10, 1 << 20))
    return c.select("c_custkey", serial.alias("serial")).select(
        "c_custkey", "serial", decode_hopper("serial").alias("hopper"))


@register("safe_cast", sql="""
SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DECIMAL(38,9)) AS brand_num,
       TRY_CAST(p_name AS DECIMAL(38,9)) AS name_num
FROM part""")
def q_safe_cast(spark, base):
    p = T(spark, base, "part")
    return p.select("p_partkey", safe_decimal(F.replace("p_brand", F.lit("Brand#"), F.lit("")))
                    .alias("brand_num"), safe_decimal("p_name").alias("name_num"))


# Unicode word characters as Python's re sees them: letters, numbers, underscore.
_W = r"[\p{L}\p{N}_]"


@register("extract_ids", sql=rf"""
WITH d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{_W}+')) AS t FROM d),
ids AS (SELECT doc_id, source, TRY_CAST(t AS DECIMAL(38,0)) AS set_id,
               NULL::VARCHAR AS block_name, NULL::VARCHAR AS set_name
        FROM tok WHERE regexp_full_match(t, '\p{{Nd}}+')),
blocks AS (SELECT doc_id, source, NULL::DECIMAL(38,0) AS set_id, t AS block_name,
                  NULL::VARCHAR AS set_name
           FROM tok WHERE regexp_full_match(t, '{_W}+_{_W}+')),
names AS (SELECT doc_id, source, NULL::DECIMAL(38,0) AS set_id, NULL::VARCHAR AS block_name,
                 unnest(regexp_extract_all(text, '{_W}+ L\p{{Nd}}+')) AS set_name FROM d),
rg AS (SELECT doc_id, source,
              unnest(regexp_extract_all(text, '{RANGE_PATTERN}', 1)) AS a,
              unnest(regexp_extract_all(text, '{RANGE_PATTERN}', 2)) AS b,
              unnest(regexp_extract_all(text, '{RANGE_PATTERN}', 3)) AS n
       FROM d),
ranges AS (SELECT doc_id, source, CAST(unnest(generate_series(CAST(a AS BIGINT), CAST(b AS BIGINT)))
                  AS DECIMAL(38,0)) AS set_id, NULL::VARCHAR AS block_name, NULL::VARCHAR AS set_name
           FROM rg WHERE CAST(b AS BIGINT) >= CAST(a AS BIGINT) AND CAST(n AS BIGINT) > 1)
SELECT DISTINCT * FROM (SELECT * FROM ids UNION ALL SELECT * FROM blocks
                        UNION ALL SELECT * FROM names UNION ALL SELECT * FROM ranges)""")
def q_extract_ids(spark, base):
    docs = T(spark, base, "documents")
    return extract_ids(docs, "text", ["doc_id", "source"])


# ------------------------------------------------------------ C31 attach date
RELEASE_ID_MIN_SIZE = 25       # parts above this size have a release row by id
RELEASE_NAME_MAX_SIZE = 5      # names whose smallest part is below this have a row by name


def _cells(spark, base):
    li, p = T(spark, base, "lineitem"), T(spark, base, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(F.col("l_partkey").alias("__part"), F.col("l_orderkey").alias("cassette_id"), F.col("l_linenumber").alias("cell_number"),
                    F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_partkey"))
                    .alias("set_id"),
                    F.col("p_name").alias("set_name"), F.col("l_linestatus").alias("cat_type"))


def _release_dates(spark, base):
    p = T(spark, base, "part")
    by_id = p.where(F.col("p_size") > RELEASE_ID_MIN_SIZE).select(
        F.col("p_partkey").alias("rel_set_id"), F.lit(None).cast("string").alias("rel_set_name"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("p_size")).alias("rel_date"))
    by_name = p.groupBy("p_name").agg(F.min("p_size").alias("m")).where(
        F.col("m") < RELEASE_NAME_MAX_SIZE).select(
        F.lit(None).cast("long").alias("rel_set_id"), F.col("p_name").alias("rel_set_name"),
        F.date_add(F.lit(dt.date(2024, 3, 1)), F.col("m")).alias("rel_date"))
    return by_id, by_name


def attach_dates(spark, base, mode: str = "per_column"):
    """Release date by set id, else by set name; then duplicate removal.

    A pandas merge also matches a null set name to every null name (M11).
    That would pair each null-named cell with every id-only release row (all
    pairs of the null group), so null names match nothing here; the source
    notes that cells with a set id always carry a name, where both rules agree.
    """
    cells, (by_id, by_name) = _cells(spark, base), _release_dates(spark, base)
    # by id where the cells already lie by part; stored, as several steps read it
    by_id = by_id.where(F.col("rel_set_id").isNotNull())
    merged1 = store(cells.join(by_id, (cells["__part"] == by_id["rel_set_id"]) & cells["set_id"].isNotNull(), "left").drop("__part"), "attached")
    retry = merged1.where(F.col("set_id").isNotNull() & F.col("rel_date").isNull()).select(*[c for c in cells.columns if c != "__part"])
    # the names are stored, so that their size is known to the plan of the join
    merged2 = store(retry.join(store(by_name, "release-names"), retry.set_name == F.col("rel_set_name"), "left"), "attached-names")
    final = union_all([merged1, merged2])
    undated = final.where(F.col("rel_date").isNull())
    # rows to delete have no date and so no release columns: a dated row can't
    # match them and is never shuffled, an undated one matches in those columns
    own = ["cassette_id", "cell_number", "set_id", "set_name", "cat_type"]
    cell = ["cassette_id", "cell_number"]
    repeated = final.groupBy(*[F.col(c).alias(f"__{c}") for c in cell]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    listed = store(undated.select(*own).join(repeated, [undated[c].eqNullSafe(repeated[f"__{c}"]) for c in cell], "left_semi"), "listed")
    kept = remove_rows(undated.select(*own), listed, mode=mode)
    return final.where(F.col("rel_date").isNotNull()).unionByName(kept, allowMissingColumns=True)


SQL_ATTACH = f"""
cells AS (SELECT l_orderkey AS cassette_id, l_linenumber AS cell_number,
                 CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_partkey END AS set_id,
                 p_name AS set_name, l_linestatus AS cat_type
          FROM lineitem JOIN part ON l_partkey = p_partkey),
rel AS (SELECT p_partkey AS rel_set_id, NULL::VARCHAR AS rel_set_name,
              DATE '2024-01-01' + p_size AS rel_date FROM part WHERE p_size > {RELEASE_ID_MIN_SIZE}
       UNION ALL
       SELECT NULL::BIGINT, p_name, DATE '2024-03-01' + min(p_size) FROM part GROUP BY p_name
       HAVING min(p_size) < {RELEASE_NAME_MAX_SIZE}),
m1 AS (SELECT c.*, rel.* FROM cells c LEFT JOIN rel ON c.set_id = rel.rel_set_id
       WHERE c.set_id IS NOT NULL),
m2 AS (SELECT c.*, rel.* FROM (SELECT cassette_id, cell_number, set_id, set_name, cat_type
                              FROM m1 WHERE rel_date IS NULL) c
       LEFT JOIN rel ON c.set_name = rel.rel_set_name),
rest AS (SELECT *, NULL::BIGINT AS rel_set_id, NULL::VARCHAR AS rel_set_name, NULL::DATE AS rel_date
         FROM cells WHERE set_id IS NULL),
fin AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM rest),
dup AS (SELECT *, count(*) OVER (PARTITION BY cassette_id, cell_number) > 1 AS is_dup FROM fin),
del AS (SELECT * FROM dup WHERE is_dup AND rel_date IS NULL),
kept AS (
  SELECT * FROM fin WHERE rel_date IS NOT NULL
  UNION ALL
  SELECT f.* FROM (SELECT * FROM fin WHERE rel_date IS NULL) f
""" + "".join(f"""  LEFT JOIN (SELECT DISTINCT coalesce('v' || {c}, 'n') AS v, 1 AS hit FROM del) k{i} ON k{i}.v = coalesce('v' || f.{c}, 'n')
""" for i, c in enumerate(("cassette_id", "cell_number", "set_id", "set_name", "cat_type"))) + """
  WHERE k0.hit IS NULL OR k1.hit IS NULL OR k2.hit IS NULL OR k3.hit IS NULL OR k4.hit IS NULL)"""


@register("attach_date_dedupe", sql=f"""
WITH {SQL_ATTACH}
SELECT * FROM kept""")
def q_attach_date_dedupe(spark, base):
    return attach_dates(spark, base)


@register("release_date_pivot", sql=f"""
WITH {SQL_ATTACH},
c AS (SELECT rel_date, cat_type, count(*) AS n FROM kept WHERE rel_date IS NOT NULL GROUP BY 1, 2)
SELECT rel_date, max(CASE WHEN cat_type = 'F' THEN n END) AS cat_f,
       max(CASE WHEN cat_type = 'O' THEN n END) AS cat_o
FROM c GROUP BY rel_date""")
def q_release_date_pivot(spark, base):
    kept = attach_dates(spark, base).where(F.col("rel_date").isNotNull())   # groupby drops nulls (M10)
    counts = kept.groupBy("rel_date", "cat_type").agg(F.count(F.lit(1)).alias("n"))
    return pivot_table(counts, ["rel_date"], "cat_type", {"cat_f": "F", "cat_o": "O"}, "n", agg="max")


_WRITTEN: dict[tuple, tuple[str, str]] = {}


def release_workbook(spark, base, out_dir: str) -> str:
    """The five results of the date chain in one set: every cell with
    its dates, and cells per category by each of its four dates.  The chain is
    run once and stored; all results are read off it."""
    from sowline.plans.dates import dated_cells
    release = attach_dates(spark, base).groupBy("cassette_id", "cell_number").agg(F.max("rel_date").alias("release_date"))
    cells = store(split_lookup(dated_cells(spark, base), release, ["cassette_id", "cell_number"]), "workbook-cells")

    def by_date(column):
        n = cells.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("day"), "cat_type").agg(F.count(F.lit(1)).alias("n_cells"))
        return pivot_table(n, ["day"], "cat_type", {f"n_{k.lower().replace(' ', '_')}": k for k in KINDS}, "n_cells", agg="max")

    return write_set({"cells": cells, **{f"by_{c}": by_date(c) for c in SHEETS}}, out_dir)


SHEETS = ("available_date", "rte_date", "finalized_date", "release_date")
KINDS = ("Cat 1", "Cat 2", "Cat 3", "border", "buffer")


def _sheet(spark, base, name):
    """A result of the workbook, which is written once a session."""
    key = (spark.sparkContext.applicationId, *sorted(f for t in ("lineitem", "part", "events", "orders", "supplier") for f in T(spark, base, t).inputFiles()))
    if key not in _WRITTEN:
        folder = f"{checkpoint_dir(spark).rstrip('/')}/sowline-workbook"
        _WRITTEN[key] = (folder, release_workbook(spark, base, folder))
    folder, run = _WRITTEN[key]
    return read_result(spark, folder, name, run)


def workbook_sql() -> str:
    from sowline.plans.dates import three_dates_sql
    attach = SQL_ATTACH.replace("cells AS (", "rcells AS (", 1).replace("FROM cells", "FROM rcells")
    return three_dates_sql(True) + "," + attach + """,
release AS (SELECT cassette_id, cell_number, max(rel_date) AS release_date FROM kept GROUP BY 1, 2),
book AS (SELECT dated.*, release_date FROM dated LEFT JOIN release USING (cassette_id, cell_number))"""


@register("workbook_cells", sql=f"WITH {workbook_sql()} SELECT * FROM book")
def q_workbook_cells(spark, base):
    return _sheet(spark, base, "cells")


def _register_sheets():
    for column in SHEETS:
        counts = ", ".join(f"nullif(count(*) FILTER (cat_type = '{k}'), 0) AS n_{k.lower().replace(' ', '_')}" for k in KINDS)

        @register(f"workbook_by_{column}", sql=f"WITH {workbook_sql()} SELECT {column} AS day, {counts} FROM book WHERE {column} IS NOT NULL GROUP BY 1")
        def q_sheet(spark, base, column=column):
            return _sheet(spark, base, f"by_{column}")


_register_sheets()
