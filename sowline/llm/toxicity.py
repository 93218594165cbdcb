"""Toxicity scores from a bidirectional GRU with attention pooling, in numpy.

A word enters as two vectors: one of its own (by a hash of the word) and the
mean over its character n-grams (by hashes, with marks at the word's ends).
Windows of ``WINDOW`` words start every ``STRIDE`` words to the end of the
text; forward and backward states of a window are pooled by attention, and a
text's logit is the largest of its windows'.

Labels belong to documents, so training picks one window a document: at first
the one whose words and n-grams have the largest log-odds in the sample,
later the one that the network itself scores highest.  A fifth of the sample
is kept back for the last step, a logistic map from the largest logit to a
probability at the labels' true rate.

The fit uses ``SAMPLE`` labelled documents of each class at most, of
``SAMPLE_CHARS`` characters at most, chosen by a hash of the id; it runs in one
task and returns the weights.  Scores are computed where texts are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sowline.llm.common import slices, unused
from sowline.llm.decontaminate import normal_words
from sowline.llm.lattice import is_held_out

SAMPLE, SAMPLE_CHARS = 2500, 20_000
WINDOW, STRIDE = 24, 12
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 15
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 12, 8, 8
EPOCHS, BATCH, RATE = 8, 128, 0.01
GRAMS = (3, 4, 5)
WINDOWS_AT_ONCE, WORDS_AT_ONCE = 1024, 32768
# Products above this many multiply-adds are cut up: libraries start threads
# for larger ones, and a task has one core.
PRODUCT = 200_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word bucket, n-gram buckets, word of each n-gram)``."""
    hashes = np.array([xxh64_intdigest(w, 1) for w in words], dtype=np.uint64)
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    grams, owners = [], []
    for n in GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ codes[k:len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            inside = owner[:len(h)] == owner[n - 1:]
            grams.append((h[inside] % np.uint64(GRAM_BUCKETS)).astype(np.int64))
            owners.append(owner[:len(h)][inside])
    if not grams:
        return (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), grams[order], owners[order]


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, length)`` of all overlapping windows of all texts."""
    n = np.diff(offsets)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, offsets[:-1][text] + start, np.minimum(WINDOW, n[text] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -30, 30)))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of matrices in pieces of PRODUCT multiply-adds at most."""
    step = max(1, PRODUCT // max(1, b.shape[1]))
    if a.shape[0] > a.shape[1]:
        rows = max(1, step // max(1, a.shape[1]))
        return np.concatenate([a[i:i + rows] @ b for i in range(0, len(a), rows)]) if len(a) else a @ b
    inner = max(1, step // max(1, a.shape[0]))
    return sum(a[:, i:i + inner] @ b[i:i + inner] for i in range(0, max(1, a.shape[1]), inner))


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    inputs = WORD_DIM + GRAM_DIM
    w = {"word": normal(WORD_BUCKETS, WORD_DIM, scale=0.1), "gram": normal(GRAM_BUCKETS, GRAM_DIM, scale=0.3)}
    for way in "fb":
        w[f"in_{way}"] = normal(inputs, 3 * HIDDEN, scale=inputs ** -0.5)
        w[f"bias_{way}"] = np.zeros(3 * HIDDEN, np.float32)
        w[f"rec_{way}"] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5)
    w["att"], w["att_bias"] = normal(2 * HIDDEN, ATTENTION, scale=0.3), np.zeros(ATTENTION, np.float32)
    w["att_out"] = normal(ATTENTION, scale=0.3)
    w["out"], w["out_bias"] = normal(2 * HIDDEN, scale=0.3), np.zeros(1, np.float32)
    return w


def embed(w: dict, features: tuple) -> np.ndarray:
    """Input vector of every distinct word."""
    words, grams, owners = features
    out = np.zeros((len(words), WORD_DIM + GRAM_DIM), np.float32)
    out[:, :WORD_DIM] = w["word"][words]
    counts = np.bincount(owners, minlength=len(words))
    first = np.append(0, np.cumsum(counts))
    for at in range(0, len(words), WORDS_AT_ONCE):
        full = at + np.flatnonzero(counts[at:at + WORDS_AT_ONCE])
        if len(full):
            own = grams[first[full[0]]:first[full[-1] + 1]]
            sums = np.add.reduceat(w["gram"][own], first[full] - first[full[0]], axis=0)
            out[full, WORD_DIM:] = sums / counts[full, None].astype(np.float32)
    return out


def _states(x: np.ndarray, mask: np.ndarray, rec: np.ndarray, back: bool, trace: list | None):
    """States [step, window, unit] of one direction; ``x`` are the projected
    inputs [step, window, 3 * unit], masked steps keep the state."""
    steps, many, _ = x.shape
    h, out = np.zeros((many, HIDDEN), np.float32), np.empty((steps, many, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        a = h @ rec
        gates = _sigmoid(x[t, :, :2 * HIDDEN] + a[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN:] + r * a[:, 2 * HIDDEN:])
        m = mask[t][:, None]
        if trace is not None:
            trace.append((t, h, z, r, n, a[:, 2 * HIDDEN:], m))
        h = h + m * (1 - z) * (n - h)
        out[t] = h
    return out


def forward(w: dict, x: dict, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logits of windows; ``x`` holds the projected inputs of both ways."""
    keep = {way: [] for way in "fb"} if trace is not None else {"f": None, "b": None}
    h = np.concatenate([_states(x[way], mask, w[f"rec_{way}"], way == "b", keep[way]) for way in "fb"], axis=2)
    u = np.tanh(h @ w["att"] + w["att_bias"])
    e = np.where(mask > 0, u @ w["att_out"], -1e9)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[:, :, None] * h).sum(axis=0)
    if trace is not None:
        trace.update(keep=keep, h=h, u=u, a=a, pooled=pooled)
    return pooled @ w["out"] + w["out_bias"][0]


def _gather(starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(word, mask)`` of windows, step first."""
    step = np.arange(WINDOW)[:, None]
    mask = (step < lengths).astype(np.float32)
    return ids[np.minimum(starts + step, len(ids) - 1)], mask


def logits(w: dict, features: tuple, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logits of all windows, a bounded number at a time."""
    x = embed(w, features)
    projected = {way: times(x, w[f"in_{way}"]) + w[f"bias_{way}"] for way in "fb"}
    out = np.zeros(len(starts), np.float32)
    for at in range(0, len(starts), WINDOWS_AT_ONCE):
        part = slice(at, at + WINDOWS_AT_ONCE)
        words, mask = _gather(starts[part], lengths[part], ids)
        out[part] = forward(w, {way: projected[way][words] for way in "fb"}, mask)
    return out


def gradients(w: dict, features: tuple, words: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict:
    """Gradients of the mean log loss of some windows."""
    used, local = np.unique(words, return_inverse=True)
    local = local.reshape(words.shape)
    counts = np.bincount(features[2], minlength=len(features[0]))
    first = np.cumsum(counts) - counts
    sizes = counts[used]
    take = np.repeat(first[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    own = (features[0][used], features[1][take], np.repeat(np.arange(len(used)), sizes))
    x = embed(w, own)
    trace: dict = {}
    got = forward(w, {way: (times(x, w[f"in_{way}"]) + w[f"bias_{way}"])[local] for way in "fb"}, mask, trace)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    d = ((_sigmoid(got) - label) / len(label)).astype(np.float32)
    g["out"], g["out_bias"][0] = trace["pooled"].T @ d, d.sum()
    dpool = d[:, None] * w["out"]
    h, u, a = trace["h"], trace["u"], trace["a"]
    dh = a[:, :, None] * dpool
    da = (h * dpool).sum(axis=2)
    de = a * (da - (a * da).sum(axis=0))
    g["att_out"] = np.tensordot(de, u, axes=2)
    du = de[:, :, None] * w["att_out"] * (1 - u * u)
    g["att"], g["att_bias"] = np.tensordot(h, du, axes=([0, 1], [0, 1])), du.sum(axis=(0, 1))
    dh = dh + du @ w["att"].T
    dx = np.zeros_like(x)
    for k, way in enumerate("fb"):
        rec = w[f"rec_{way}"]
        after = np.zeros((len(label), HIDDEN), np.float32)
        dproj = np.zeros((*words.shape, 3 * HIDDEN), np.float32)
        for t, before, z, r, n, an, m in reversed(trace["keep"][way]):
            dht = dh[t, :, k * HIDDEN:(k + 1) * HIDDEN] + after
            dn = dht * m * (1 - z) * (1 - n * n)
            dz = dht * m * (before - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            dproj[t] = np.concatenate([dz, dr, dn], axis=1)
            drec = np.concatenate([dz, dr, dn * r], axis=1)
            g[f"rec_{way}"] += before.T @ drec
            after = dht * (1 - m * (1 - z)) + drec @ rec.T
        flat = dproj.reshape(-1, 3 * HIDDEN)
        g[f"in_{way}"], g[f"bias_{way}"] = times(x[local].reshape(-1, x.shape[1]).T, flat), flat.sum(axis=0)
        np.add.at(dx, local.ravel(), times(flat, w[f"in_{way}"].T))
    np.add.at(g["word"], own[0], dx[:, :WORD_DIM])
    np.add.at(g["gram"], own[1], (dx[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None])[own[2]])
    return g


def _log_odds(items_of, label: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of items by document counts; ``items_of(i)`` are the
    items of document i."""
    df = np.zeros((2, size))
    for i, y in enumerate(label.tolist()):
        df[y, np.unique(items_of(i))] += 1
    rate = [(df[k] + 1) / ((label == k).sum() + 2) for k in (0, 1)]
    return np.log(rate[1]) - np.log(rate[0])


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic map from logit to probability, by Newton steps."""
    theta = np.array([1.0, 0.0])
    design = np.stack([x.astype(float), np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-2 * (theta - [1.0, 0.0])
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(texts: list, labels: list[int], rates: tuple[int, int]) -> dict:
    """Weights and calibration from a sample; ``rates`` are the numbers of all
    labelled documents of class 0 and 1.  A sample without both classes gives
    the constant rate."""
    label = np.asarray(labels, dtype=np.int64)
    offsets, ids, distinct = normal_words(pa.array(texts, pa.string()))
    total = max(1, sum(rates))
    if len(set(labels)) < 2 or not len(ids):
        rate = min(max(rates[1] / total, 1e-3), 0.2)
        return {"weights": None, "slope": 1.0, "shift": float(np.log(rate / (1 - rate)))}
    features = word_features(distinct.to_pylist())
    text, starts, lengths = windows_of(offsets)
    own = [np.unique(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    sizes = np.bincount(features[2], minlength=len(features[0]))
    first = np.cumsum(sizes) - sizes

    def grams_of(i: int) -> np.ndarray:
        n = sizes[own[i]]
        return features[1][np.repeat(first[own[i]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    word_odds = _log_odds(own.__getitem__, label, len(distinct))
    gram_odds = _log_odds(grams_of, label, GRAM_BUCKETS)
    best = word_odds.copy()
    np.maximum.at(best, features[2], gram_odds[features[1]])
    words, mask = _gather(starts, lengths, ids)
    score = np.where(mask > 0, best[words], -9).max(axis=0)
    rng = np.random.default_rng(5)
    w = new_weights(rng)
    held = np.arange(len(label)) % 5 == 4
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    has = np.unique(text)
    for epoch in range(EPOCHS):
        if epoch >= 2:
            score = logits(w, features, ids, starts, lengths)
        order = np.lexsort([-score, text])
        top = order[np.r_[True, np.diff(text[order]) > 0]]
        low = np.flatnonzero(np.diff(np.r_[-1, text]) > 0)
        counts = np.bincount(text, minlength=len(label))[has]
        other = low + rng.integers(0, counts)               # any window of the clean documents
        pick = np.concatenate([top[~held[text[top]]], other[~held[text[other]] & (label[text[other]] == 0)]])
        pick = rng.permutation(pick)
        for at in range(0, len(pick), BATCH):
            part = pick[at:at + BATCH]
            words, mask = _gather(starts[part], lengths[part], ids)
            grad = gradients(w, features, words, mask, label[text[part]].astype(np.float32))
            step += 1
            for k, g in grad.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                w[k] -= RATE * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    score = logits(w, features, ids, starts, lengths)
    most = np.full(len(label), score.min(), np.float32)
    np.maximum.at(most, text, score)
    weight = np.array([rates[k] / max(1, (label[held] == k).sum()) for k in (0, 1)])[label[held]]
    slope, shift = _platt(most[held], label[held].astype(float), weight / weight.mean())
    return {"weights": w, "slope": slope, "shift": shift}


def score_texts(model: dict, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts: the largest over all windows; NULL, empty and
    blank texts score 0."""
    offsets, ids, distinct = normal_words(texts)
    out = np.zeros(len(offsets) - 1)
    full = np.diff(offsets) > 0
    if model["weights"] is None:
        out[full] = 1 / (1 + np.exp(-model["shift"]))
        return out
    if full.any():
        text, starts, lengths = windows_of(offsets)
        most = np.full(len(out), -np.inf)
        np.maximum.at(most, text, logits(model["weights"], word_features(distinct.to_pylist()), ids, starts, lengths))
        out[full] = 1 / (1 + np.exp(-np.clip(model["slope"] * most[full] + model["shift"], -30, 30)))
    return out


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> dict:
    """The model from the labelled documents outside the held-out fold.

    Of repeated label rows of an id the largest label counts; rows without an
    id or a label and blank texts take no part.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.select("doc_id", (F.col("toxic") != 0).cast("int").alias("label")).where(~is_held_out(folds, held))
    rates = {r.label: r.n for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rates = (rates.get(0, 0), rates.get(1, 0))
    # ids are chosen before any text is read: at most 2 * sample of them, which
    # bounds what is broadcast, and no text but theirs is moved
    ids = [marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id")).limit(sample) for k in (0, 1)]
    texts = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    chosen = texts.orderBy(F.xxhash64("doc_id", "text")).limit(2 * sample)

    def run(key, rows):
        rows = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), rows.column("label").to_pylist()))
        model = fit([t for _, t, _ in rows], [y for _, _, y in rows], rates)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = chosen.groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary").collect()
    return pickle.loads(rows[0].model) if rows else fit([], [], rates)


def scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, held_out and score (0 to 1) of every row's whole text."""
    model = train(docs, labels, folds, held)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    mark = unused(docs, "held_out")
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], is_held_out(folds, held).alias(mark), F.col("text").alias("_text"))
    names = [*keep, "held_out", "score"]
    schema = rows.drop("_text").withColumnRenamed(mark, "held_out").schema.add("score", "double")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "_text"):
                columns = [batch.column(k) for k in (*keep, mark)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score_texts(shipped.value, batch.column("_text")))], names=names)

    return rows.mapInArrow(run, schema)
