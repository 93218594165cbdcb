"""Session settings and lineage cutting.

Cluster settings win: options are only filled in where the session does not
already carry a value (``spark.checkpoint.dir`` in particular is read from the
session and set only when unset, e.g. in tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume.  UTC session zone makes EXTRACT(DATE FROM ts)
# the UTC day (the local day is an explicit operator parameter).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of materialize() go away with their DataFrames
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sowline", extra: dict | None = None) -> SparkSession:
    """Get or create the session.

    ``DEFAULTS`` only fill settings nobody set (spark-submit / cluster
    configuration and an already running session win); ``shuffle_partitions``
    and ``extra`` are the caller's explicit choices and always apply.
    """
    from pyspark import SparkConf, SparkContext

    explicit = dict(extra or {})
    if shuffle_partitions:
        explicit["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if SparkContext._active_spark_context is None:
        launched = SparkConf()          # properties handed over by spark-submit, if any
        for k, v in DEFAULTS.items():
            if not launched.contains(k):
                builder = builder.config(k, v)
    for k, v in explicit.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only in local mode (tests, one machine) and only when the session has
    none is a scratch folder created and registered.  On a cluster an unset
    folder is an error: a machine-local folder would not survive executor
    loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS / object store)")
        current = tempfile.mkdtemp(prefix="sowline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used where a result feeds several consumers (the "stored result read by
    other queries" pattern); survives executor loss because the data lives in
    the shared folder, not on executor-local disk.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
