import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sowline.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = lattice.read_vocabulary(PATH)


def all_paths(word, logp):
    """Sum over all segmentations, by recursion over the first piece."""
    pieces = {p: logp[i] for i, (p, n) in enumerate(zip(VOCABULARY[0], VOCABULARY[2])) if n < 0}
    spelled = {n: logp[i] for i, n in enumerate(VOCABULARY[2]) if n >= 0}

    def rest(text):
        if not text:
            return 1.0
        total = sum(math.exp(pieces[text[:k]]) * rest(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces)
        if text[0] not in pieces:
            total += math.exp(sum(spelled[b] for b in text[0].encode())) * rest(text[1:])
        return total
    return math.log(rest(lattice.MARK + word))


def test_forward_is_the_sum_over_all_segmentations():
    words = ["the", "a", "é🙂x", "thetion", "日本", "####", "zzzqzz"]
    model = lattice.Lattice(VOCABULARY[0], np.array(VOCABULARY[1]), VOCABULARY[2])
    assert model.score(pa.array(words)) == pytest.approx([all_paths(w, VOCABULARY[1]) for w in words])


def test_temperature_is_the_likeliest(spark):
    model = lattice.Lattice(VOCABULARY[0], np.array(VOCABULARY[1]), VOCABULARY[2])
    counts = {"the": 500, "reading": 3, "qzx日": 2}
    words = spark.createDataFrame([*counts.items(), ("unseen" * 9, 0)], "word string, n long")
    likely = {}
    for t in lattice.TEMPERATURES:
        logp = lattice.tempered(VOCABULARY[1], t)
        assert np.exp(logp).sum() == pytest.approx(1)
        likely[t] = sum(n * all_paths(w, logp) for w, n in counts.items())
        assert model.score(pa.array(list(counts)), (logp,))[0] == pytest.approx([all_paths(w, logp) for w in counts])
    assert lattice.fit(words, VOCABULARY) == max(likely, key=likely.get)
    assert lattice.fit(words.where("n = 0"), VOCABULARY) == 1.0


def test_whole_scores_are_sums_over_all_segmentations(spark):
    texts = {1: "the cat sat", 2: "The mat\tthe 日é", 3: "", 5: "a cat a mat zqz", 6: None, 8: "the"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lower = {i: (t or "").lower().split() for i, t in texts.items()}
    train = Counter(w for i, ws in lower.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    ends = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in texts)
    share = ends / (ends + sum(train.values()))
    likely = lambda t: sum(n * all_paths(w, lattice.tempered(VOCABULARY[1], t)) for w, n in train.items())
    logp = lattice.tempered(VOCABULARY[1], max(lattice.TEMPERATURES, key=likely))
    want = {i: math.log10(share) + sum(math.log10(1 - share) + all_paths(w, logp) / math.log(10) for w in ws) for i, ws in lower.items()}
    assert {r.doc_id: r.score for r in lattice.scores(docs, PATH).collect()} == pytest.approx(want)


def test_scores(spark):
    rows = [(i, f"The cat {i} sat\ton the MAT {'x' * (i % 9)}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "É é 日本 " + "y" * 3000), (104, "never seen wordforms"), (5, rows[5][1]), (None, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as held", "2 as block", "'w' as word")
    got = lattice.scores(docs, PATH).collect()
    assert len(got) == len(rows)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [w.decode() for w in (t or "").translate(lower).encode().split()] + [None]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted([(str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
                    round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 8)) for i, t in rows])
    assert sorted([(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in got]) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[100].score == by[101].score == by[102].score == pytest.approx(math.log10(counts[None] / n))
    assert by[104].score / by[104].n_tokens < by[1].score / by[1].n_tokens
    assert lattice.scores(docs.limit(0), PATH).count() == 0


def test_total_probability_of_words_is_at_most_one(spark):
    """Whole-word arcs and pieces together: seen words cannot exceed the mass left by the end."""
    docs = spark.createDataFrame([(i, "aa bb cc dd aa bb aa") for i in range(50)], "doc_id long, text string")
    one = lattice.scores(docs.union(spark.createDataFrame([(10_000 + k, w) for k, w in enumerate(("aa", "bb", "cc", "dd"))], docs.schema)), PATH)
    rows = {r.doc_id: r for r in one.collect()}
    end = math.log10(sum(1 for r in rows.values() if not r.held_out) / rows[10_000].train_tokens)
    assert sum(10 ** (rows[10_000 + k].score - end) for k in range(4)) < 1


def test_adapted_pieces_are_their_expected_uses(spark):
    prior = lattice.tempered(VOCABULARY[1], 1.0)
    words = {"the": 3, "thetion": 1, "日q": 2, "unseen": 0}
    uses = Counter()

    def paths(text):
        if not text:
            yield 0.0, ()
        spelled = tuple(VOCABULARY[2].index(b) for b in text[:1].encode())
        steps = [((i,), k) for k in range(1, len(text) + 1) if (i := PIECES.get(text[:k])) is not None]
        if text and text[0] not in PIECES:
            steps.append((spelled, 1))
        for ids, k in steps:
            for lp, more in paths(text[k:]):
                yield lp + sum(prior[i] for i in ids), ids + more

    PIECES = {p: i for i, (p, n) in enumerate(zip(VOCABULARY[0], VOCABULARY[2])) if n < 0}
    for word, n in words.items():
        found = list(paths(lattice.MARK + word)) if n else []
        total = sum(math.exp(lp) for lp, _ in found)
        for lp, ids in found:
            for i in ids:
                uses[i] += math.exp(lp) / total
    want = lattice.PRIOR * np.exp(prior)
    for i, n in uses.items():
        want[i] += n
    table = spark.createDataFrame([*words.items()], "word string, n long")
    got = lattice.adapt(table, (VOCABULARY[0], prior, VOCABULARY[2]), rounds=1)
    assert got == pytest.approx(np.log(want / want.sum()), abs=1e-9)
    assert lattice.adapt(table.where("n = 0"), (VOCABULARY[0], prior, VOCABULARY[2])) == pytest.approx(prior)


def test_scores_of_held_out_rows_are_near_the_base(spark, tmp_path):
    from sowline.llm.queries import QUERIES

    rng = np.random.default_rng(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    names = ["".join(rng.choice(syllables, 2 + k % 3)) for k in range(3000)]
    usual = 1 / np.arange(1, 3001)
    texts = [" ".join(rng.choice(names, 120, p=usual / usual.sum())) for _ in range(300)]
    rows = [*enumerate(texts), (300, None), (301, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op4_lm_scoring"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(302))
    assert all(math.isfinite(r.score) and math.isfinite(r.lattice_score) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)
    assert sum(r.lattice_score for r in held) < 1.5 * sum(r.base_score for r in held)
