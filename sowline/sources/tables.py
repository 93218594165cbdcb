"""Table scans, CSV readers with declared schemas, inline constant tables and
multi-result writers.

Parquet scans are lazy: Catalyst prunes the columns a query does not use and
pushes filters into the reader, so callers should select/filter on the result
rather than pre-narrowing by hand.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowline.session import checkpoint_dir

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan one parquet table ``{base}/{name}.parquet`` (file or folder)."""
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


def read_materialized(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored result written by ``write_results``."""
    return spark.read.parquet(path)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a result as Parquet into the shared checkpoint folder and read
    it back.  Later reads prune columns and nested fields, and a lost executor
    costs a re-read only."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/sowline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             header: bool = True, **options) -> DataFrame:
    """CSV with header and an explicit schema (no inference pass over the data)."""
    reader = spark.read.option("header", header).schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                     name: str = "csv", **options) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) of a CSV; no line is lost.

    A line with a value that its column cannot hold, or with another number of
    fields, is a reject: its whole text in ``line``.  An empty field is NULL
    and no reject.  The file is parsed once, with all columns, into the
    checkpoint folder: a parse of fewer columns would not see bad values in
    the others.
    """
    bad = "__line"
    raw = read_csv(spark, path, T.StructType([*schema.fields, T.StructField(bad, T.StringType())]), header,
                   mode="PERMISSIVE", columnNameOfCorruptRecord=bad, **options)
    parsed = store(raw, name)
    good = parsed.where(F.col(bad).isNull()).drop(bad)
    return good, parsed.where(F.col(bad).isNotNull()).select(F.col(bad).alias("line"))


def constants(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A small literal dimension (machine lists, site codes, scenarios)."""
    return spark.createDataFrame([tuple(r) for r in rows], schema=schema)


def write_results(results: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet",
                  mode: str = "overwrite") -> dict[str, str]:
    """One folder per named result (the workbook-with-sheets pattern).

    ``out_dir`` must be a shared location (object store / HDFS), never a
    machine-local folder, so results survive executor loss.
    """
    written = {}
    for name, df in results.items():
        path = os.path.join(out_dir, name)
        w = df.write.mode(mode)
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.format(fmt).save(path)
        written[name] = path
    return written


def write_set(results: Mapping[str, DataFrame], out_dir: str) -> str:
    """Several results in one write, seen all or not at all.

    Rows are tagged by result and written once, partitioned by the tag, into a
    folder of their own; a manifest that names the folder and every result's
    columns is written last.  Readers go by the manifest, so they never see
    half a set, and a failed write leaves the former set in place.  Columns of
    one name must have one type in all results.
    """
    tagged = None
    for name, df in results.items():
        part = df.withColumn("result", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    spark, run = tagged.sparkSession, uuid.uuid4().hex
    tagged.write.partitionBy("result").parquet(f"{out_dir.rstrip('/')}/{run}")
    manifest = json.dumps({"run": run, "results": {n: df.columns for n, df in results.items()}})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("append").text(f"{out_dir.rstrip('/')}/manifest")
    return run


def read_result(spark: SparkSession, out_dir: str, name: str, run: str | None = None) -> DataFrame:
    """One result of the set that ``write_set`` wrote last, or of the given run."""
    folder = f"{out_dir.rstrip('/')}/manifest"
    # one line a set that was written here
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_modification_time").alias("at"))
    newest = lines.where(F.get_json_object("value", "$.run") == run) if run else lines
    manifest = json.loads(newest.orderBy(F.col("at").desc()).first().value)
    table = spark.read.parquet(f"{out_dir.rstrip('/')}/{manifest['run']}").where(F.col("result") == name)
    return table.select(*manifest["results"][name])


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """LIMIT n (head); the limit is the feature here."""
    return df.limit(n)


# Declared schemas of the two exported planning sheets (S5); the plot count
# column is "Plots" in one sheet and "SRE" in the other.
PLAN_SHEET_SCHEMAS = {
    "yield": "Year int, Crop string, Plots double, Rows_Per_Plot double",
    "nursery": "Year int, Crop string, SRE double, Rows_Per_Plot double",
}


def read_plan_sheet(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """An exported planning sheet (CSV with header) with its declared schema,
    the plot count renamed to ``plots``."""
    df = read_csv(spark, path, PLAN_SHEET_SCHEMAS[kind])
    plots = "Plots" if kind == "yield" else "SRE"
    return df.withColumnRenamed(plots, "plots")
