"""Connected components of a link table by star contraction.

Edges are pairs of 64-bit node ids.  Every round is two shuffles over the
remaining edges; the table of a round is stored in the shared folder, so no
round depends on an executor's memory.  Nothing is collected but two totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowline.llm.common import discarded, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link: ``root`` is the smallest
    node of its component.

    ``edges`` has columns ``u`` and ``v`` (bigint, any direction, repeats and
    loops allowed).  Rounds go on until the star table no longer changes.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "links")
    seen = None
    while True:
        total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total[0] == 0 or tuple(total) == seen:
            break
        seen = tuple(total)
        before, edges = edges, stored(_small_star(_large_star(edges)), "stars")
        discarded(before)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
