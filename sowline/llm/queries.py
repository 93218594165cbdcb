"""All queries of the package; importing the modules fills the registry."""

import corpus_pipeline
from sowline.llm import queries_chat, queries_dedup, queries_pieces, queries_text, queries_vectors, queries_web  # noqa: F401
from sowline.llm.registry import ORACLE, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
