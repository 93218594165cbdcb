"""Registered query of the whitening operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowline.llm import whiten
from sowline.llm.common import table
from sowline.llm.registry import query


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    """Up to 16 whitened components of every vector, each distinct vector
    counting once in the fit."""
    white = whiten.whiten(table(spark, sf_dir, "embeddings"), most=16, weights="one")
    each = white.select("vec_id", "n", "deviation", "explained", "identity_error",
                        F.posexplode("whitened").alias("place", "value"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
                       F.element_at("explained", F.col("place") + 1).alias("explained"), "identity_error")
