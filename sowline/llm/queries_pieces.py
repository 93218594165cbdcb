"""Registered query of the SentencePiece operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sowline.llm import pieces
from sowline.llm.common import table
from sowline.llm.registry import query


@query("op11_sentencepiece")
def op11(spark, sf_dir):
    """Ids of every whole text with an end id, and the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"),
                        (F.col("agrees") & F.col("decoded_agrees")).alias("agrees"))
