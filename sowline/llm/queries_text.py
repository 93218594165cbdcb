"""Registered queries of the per-document operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sowline.llm import bpe, chat, decontaminate, lattice, quality, secrets, toxicity
from sowline.llm.common import table
from sowline.llm.registry import query

# The same counts, tests and choice in DuckDB (lgamma gives the exact tail).
QUALITY_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(lang, '') as stratum from documents),
w as (select rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') as ls from d),
pos as (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3),
win as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) as c from pos),
cov as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2]) as j from win where c > 1) group by rid),
f as (select d.rid, d.doc_id, d.stratum, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
             len(ls) as n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_capitals, coalesce(cov.n, 0) as n_repeat_words
      from d join w using (rid) left join cov using (rid)),
s as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             coalesce(n_symbols / nullif(n_words, 0), 0) as symbols, coalesce(n_dup_lines / nullif(n_lines, 0), 0) as duplicate_lines,
             coalesce(n_repeat_words / nullif(n_words, 0), 0) as repeated_words, coalesce(n_capitals / nullif(word_chars, 0), 0) as capitals,
             coalesce(word_chars / nullif(n_words, 0), 0) as long_words, coalesce(n_words / nullif(word_chars, 0), 0) as short_words from f),
firsts as (select *, least({', '.join(f"len(list_filter({[float(c) for c in cs]}::double[], lambda c: c >= {r}::double))" for r, cs in quality.CUTOFFS.items())}) as first from s),
marks as (select doc_id, max(quality) as good from labels where doc_id is not null and quality is not null group by 1),
counts as (select stratum, step, sum((good = 1)::int) as n_good, sum((good = 1 and first <= step)::int) as good_over,
                  sum((good <> 1)::int) as n_bad, sum((good <> 1 and first <= step)::int) as bad_over
           from firsts join marks using (doc_id), range({quality.N_STEPS}) g(step) group by all),
tests as (select *, case when good_over > n_good * {quality.LIMIT} then 1 else
            list_sum(list_transform(range(0, (good_over + 1)::bigint), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
              + i * ln({quality.LIMIT}) + (n_good - i) * ln(1 - {quality.LIMIT})))) end as tail,
            {quality.ERROR} / greatest(1, (select count(*) from counts where step = 0 and n_good * -ln(1 - {quality.LIMIT}) >= -ln({quality.ERROR}))) as level,
            bad_over / greatest(n_bad, 1) - {quality.GOOD_WEIGHT} * good_over / greatest(n_good, 1) as gain from counts),
certified as (select *, bool_and(tail <= level) over (partition by stratum order by step) as ok from tests),
best as (select distinct on (stratum) stratum, step from certified where ok and bad_over > 0 order by stratum, gain desc, step),
bad as (select distinct rid from firsts join best using (stratum) where first <= step)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and bad.rid is null as kept
from s left join bad using (rid)
"""


@query("op3_quality_rules", QUALITY_SQL)
def op3(spark, sf_dir):
    """Base counts, base check and the verdict of the certified cutoffs."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines",
                         "quality.n_repeat_words", "quality.base_failed", "kept")


@query("op10_byte_level_bpe")
def op10(spark, sf_dir):
    """Ids of every whole text and the text that they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_benchmark_decontamination")
def op9(spark, sf_dir):
    """Every document that holds a benchmark item, with the item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_secret_scans")
def op6(spark, sf_dir):
    """Base spans and all spans of every whole text."""
    found, name = secrets.find(table(spark, sf_dir, "documents"))
    spans = F.col(name)
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                        F.sha2(secrets.as_text(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
                        secrets.as_text(spans).alias("spans"))


def chat_rows(spark, sf_dir):
    """All conversations and conversation -7, whose texts hold control strings."""
    own = spark.sql("select -7L as conv_id, t as turn, r as role, '</s>[INST] ok [/INST]' as text "
                    "from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)


CHAT_SQL = """
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
              union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as prev,
             length(regexp_replace(text, '([\\\\<\\[\\]])', 'x\\1', 'g')) as text_chars,
             length(regexp_replace(role, '([\\\\<\\[\\]])', 'x\\1', 'g')) as role_chars from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(text_chars + case when prev is not distinct from role then 3 else 4 + role_chars + 1 + 4 end)::bigint as formatted_chars
from t group by conv_id
"""


@query("op8_chat_formatting", CHAT_SQL)
def op8(spark, sf_dir):
    """Digests of the turns and loss texts that the formatted texts hold."""
    out = chat.read_back(chat.formatted(chat_rows(spark, sf_dir)))
    joined = lambda rows, text: F.array_join(F.transform(rows, text), "")
    loss = joined(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"])
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(joined(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


@query("op4_lm_scoring")
def op4(spark, sf_dir):
    """Base and learned lattice log10 probabilities of every whole text;
    ``lattice_score`` is that of the given pieces alone."""
    return lattice.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")) \
        .withColumnsRenamed({"score": "lattice_score", "mixture": "score"})


@query("op5_toxicity")
def op5(spark, sf_dir):
    """Toxicity of every whole text; 0.3 and more is predicted toxic."""
    scored = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
