"""Registered query of the conversation trie."""

from __future__ import annotations

from sowline.llm import trie
from sowline.llm.common import table
from sowline.llm.registry import query


@query("op13_conversation_trie")
def op13(spark, sf_dir):
    """All nodes of the trie of the rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
