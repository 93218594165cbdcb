import random

import numpy as np
import pyarrow as pa
import pytest

from sowline.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("er", "th", "an", "in", "or", "re") for b in ("tion", "he", "ed", "ing", "at", "en", "st")]
    rude = ["idiot", "moron", "trash"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 30, 90]))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(rude) + rng.choice(["", ".", "!"])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_gradients(monkeypatch):
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity.new_weights(rng).items()}
    features = toxicity.word_features(["idiot", "the", "of", "éa", "x"])
    words, mask = rng.integers(0, 5, (toxicity.WINDOW, 6)), (np.arange(toxicity.WINDOW)[:, None] < np.array([24, 3, 10, 1, 24, 7])).astype(float)
    label = np.array([0, 1, 1, 0, 1, 0.0])

    def loss():
        x = toxicity.embed(w, features).astype(float)
        got = toxicity.forward(w, {s: (x @ w[f"in_{s}"] + w[f"bias_{s}"])[words] for s in "fb"}, mask)
        return np.mean(np.log1p(np.exp(got)) - label * got)
    grad = toxicity.gradients(w, features, words, mask, label)
    for k in w:
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        old, eps = w[k][i], 1e-3
        w[k][i] = old + eps
        up = loss()
        w[k][i] = old - eps
        down = loss()
        w[k][i] = old
        assert grad[k][i] == pytest.approx((up - down) / 2 / eps, rel=0.05, abs=1e-4), k


def test_network_equals_one_written_step_by_step():
    rng = np.random.default_rng(4)
    w = {k: v.astype(np.float64) for k, v in toxicity.new_weights(rng).items()}
    for way in "fb":
        w[f"bias_{way}"] = rng.standard_normal(3 * toxicity.HIDDEN)
    words = ["idiot", "the", "of", "", "é", "reading"]
    features = toxicity.word_features(words)
    starts, lengths, ids = np.array([0, 2, 5]), np.array([6, 3, 1]), np.arange(len(words))
    got = toxicity.logits(w, features, ids, starts, lengths)

    sigmoid, size = lambda v: 1 / (1 + np.exp(-v)), toxicity.HIDDEN
    inputs = []
    for i in range(len(words)):
        grams = [w["gram"][g] for g, owner in zip(features[1], features[2]) if owner == i]
        inputs.append(np.concatenate([w["word"][features[0][i]], np.mean(grams, axis=0) if grams else np.zeros(toxicity.GRAM_DIM)]))
    for window, (start, length) in enumerate(zip(starts, lengths)):
        both = {}
        for way in "fb":
            state, both[way] = np.zeros(size), {}
            for p in range(length) if way == "f" else reversed(range(length)):
                x, rec = inputs[start + p] @ w[f"in_{way}"] + w[f"bias_{way}"], state @ w[f"rec_{way}"]
                update, reset = sigmoid(x[:size] + rec[:size]), sigmoid(x[size:2 * size] + rec[size:2 * size])
                new = np.tanh(x[2 * size:] + reset * rec[2 * size:])
                state = update * state + (1 - update) * new
                both[way][p] = state
        states = [np.concatenate([both["f"][p], both["b"][p]]) for p in range(length)]
        weights = np.exp([np.tanh(h @ w["att"] + w["att_bias"]) @ w["att_out"] for h in states])
        pooled = sum(a * h for a, h in zip(weights / weights.sum(), states))
        assert got[window] == pytest.approx(pooled @ w["out"] + w["out_bias"][0], abs=1e-4)


def test_windows_cover_every_word():
    for n in (0, 1, 24, 25, 36, 37, 100):
        text, start, length = toxicity.windows_of(np.array([0, n, n + 3]))
        own = text == 0
        assert {p for s, size in zip(start[own], length[own]) for p in range(s, s + size)} == set(range(n))


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (2002, "..."), (None, "a b"), (2003, "er " * 30_000 + "idiot")],
                                 "doc_id long, text string").selectExpr("*", "1 as held_out", "'x' as score")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None), (2, rows[2][2]), (2, rows[2][2])], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score == 0 and by[2003].score >= 0.3
    held = [(by[i].score >= 0.3, y) for i, _, y in rows if by[i].held_out]
    assert len(held) > 150 and sum(p == y for p, y in held) / len(held) > 0.95


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.3 for r in toxicity.scores(docs, none).collect())
    assert toxicity.scores(docs.limit(0), none).count() == 0
    assert toxicity.score_texts(toxicity.fit([], [], (0, 0)), pa.array([None, "x"], pa.string()))[0] == 0
