"""Registered queries of the deduplication operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sowline.llm import simhash, substrings
from sowline.llm.common import table
from sowline.llm.registry import query


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    """Three-word shingles, links at 2 or fewer differing bits."""
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SUBSTRING_SQL = """
with d as (select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
           from documents),
pos as (select rid, doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13),
win as (select rid, doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) as h from pos),
least as (select h, min(doc_id) as least from win group by h),
gone as (select distinct rid, unnest(range(i, i + 13)) as i from win join least using (h) where least < doc_id),
words as (select rid, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from d),
kept as (select rid, string_agg(w, ' ' order by i) as kept, count(*) as n from words anti join gone using (rid, i) group by rid)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (rid)
"""


@query("op2_substring_dedup", SUBSTRING_SQL)
def op2(spark, sf_dir):
    """Words that no 13-word window of an earlier document covers."""
    kept = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
