import random
from collections import namedtuple

import pyarrow as pa
import pytest

from sowline.llm import decontaminate as D

Piece = namedtuple("Piece", "item_id question answer")


@pytest.mark.parametrize("seed", range(6))
def test_wand_equals_full_scores(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(D, "BLOCK", rng.choice([1, 2, 4, 16]))
    terms = [f"t{i:02d}" for i in range(30)]
    weights = {(p, t): rng.choice([rng.random() ** 4, 0.25]) for p in range(37) for t in rng.sample(terms, 8)}
    index = D.Index([Piece(p, "", "") for p in range(37)], weights)
    names = index.terms.to_pylist()
    for _ in range(60):
        asked = sorted(rng.sample(range(len(names)), rng.randrange(1, 15)))
        threshold = rng.choice([0.05, 0.25, 0.5, 1.0])
        want = {}
        for (p, t), w in weights.items():
            if names.index(t) in asked:
                want[p] = want.get(p, 0) + w
        want = {p: pytest.approx(w) for p, w in want.items() if w >= threshold - 1e-9}
        assert dict(index.wand(asked, threshold)) == want


def brute(docs, items, threshold, overlap):
    """Every passage against every piece, in full."""
    import math
    from collections import Counter

    pieces = []
    for item, text in items:
        words = D.plain(text)
        n = -(-len(words) // D.PIECE)
        pieces += [(item, words[len(words) * k // n:len(words) * (k + 1) // n], *D.question_answer(text)) for k in range(n)]
    df = Counter(t for _, w, _, _ in pieces for t in set(w))
    mean = sum(len(w) for _, w, _, _ in pieces) / max(1, len(pieces))
    out = {}
    for key, text in docs:
        raw = (text or "").encode().split()
        all_words = [x.decode().lower().strip(D.EDGES) for x in raw]
        kept = [w for w in all_words if w]
        for item, words, question, answer in pieces:
            n = len(pieces)
            own = {t: math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * f * (D.K1 + 1) / (f + D.K1 * (1 - D.B + D.B * len(words) / mean))
                   for t, f in Counter(words).items()}
            total = sum(own.values())
            for a in range(0, max(1, len(all_words)), D.CELL):
                score = sum(own.get(t, 0) for t in set(all_words[a:a + 2 * D.CELL])) / total
                if score >= threshold - 1e-9:
                    def share(wanted):
                        size = {len(g) for g in D.grams(wanted)}
                        have = {tuple(kept[i:i + s]) for s in size for i in range(len(kept))}
                        return len(D.grams(wanted) & have) / len(D.grams(wanted)) if wanted else 1.0
                    q, an = share(question), share(answer)
                    if min(q, an) >= overlap:
                        out[key, item] = max(out.get((key, item), 0), score)
    return out


def test_operator_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(150)] + ["the", "of", "and"] * 20
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(rng.choice([6, 20, 45, 130])) + ". " + make(8) + ".") for i in range(12)] + [(50, None), (51, " . "), (None, "só um ítem curto aqui")]
    docs = [(i, make(rng.choice([0, 3, 40, 300]))) for i in range(25)]
    docs += [(100 + i, make(rng.randrange(90)) + "\n" + (t or "").upper() + "\t" + make(50)) for i, t in items if i is not None]
    docs += [(200, items[3][1][:len(items[3][1]) // 3]), (None, items[2][1]), (201, None), (201, items[2][1]), (202, make(2000) + " " + items[1][1]),
             (203, "Só um ítem, curto aqui!")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as score")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for threshold, overlap in ((0.5, 0.5), (0.3, 0.0)):
        got = {(r.doc_id, r.item_id): pytest.approx(r.score, abs=1e-9) for r in D.contaminated(frame, bench, threshold, overlap).collect()}
        assert got == brute([(i, t) for i, t in docs], items, threshold, overlap)
    clean = D.keep_clean(frame, bench)
    assert clean.columns == frame.columns
    bad = {k for k, _ in brute(docs, items, 0.5, 0.5)}
    left = [r.doc_id for r in clean.collect()]
    assert {i for i, _ in docs} - bad | {201} == set(left) and left.count(201) == 1


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items, no_items = spark.createDataFrame([(1, "a b")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, no_items).count() == 0
    assert D.contaminated(none, items).count() == 0
    assert D.keep_clean(docs, no_items).count() == 1
    assert [r.item_id for r in D.contaminated(docs, items).collect()] == [1]


def test_search_of_nothing():
    index = D.Index([Piece(1, "a", "b")], {(0, "a"): 0.5, (0, "b"): 0.5})
    assert index.search(pa.array([None, "", "  "], pa.string()), 0.5, 0.5) == []


@pytest.mark.parametrize("seed", [8, 9])
def test_edited_copies_are_found_and_clean_texts_are_not(spark, seed):
    """Every copy with one changed word, nearly all with 10 % of the words
    changed; no clean text, and hardly a question with another answer (by chance
    its common words can stand in the answer's order)."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = ["the", "of", "and", "in", "is", "to", "a", "was"]
    make = lambda n: " ".join(rng.choice(common if rng.random() < 0.4 else vocab) for _ in range(n))
    items = [(i, make(rng.randrange(12, 60)) + ". " + make(rng.randrange(5, 14)) + ".") for i in range(60)]
    noise = lambda: make(rng.randrange(20, 200))
    one, tenth, docs = {}, {}, []

    def put(text):
        docs.append((len(docs), noise() + " " + text + " " + noise()))
        return len(docs) - 1

    for item, text in items:
        words = text.split()
        for at in range(len(words)):
            new = "other" + "." * words[at].endswith(".")
            one[put(" ".join(words[:at] + [new] + words[at + 1:]))] = item
        for _ in range(5):
            tenth[put(" ".join("other" + "." * w.endswith(".") if rng.random() < 0.1 else w for w in words))] = item
    first_clean = len(docs)
    for item, text in items:
        put(noise())
        put(text.split(". ")[0] + ". " + make(9) + ".")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                                           spark.createDataFrame(items, "item_id long, text string")).collect()}
    missed = [d for d in one.items() if d not in found]
    lost = [d for d in tenth.items() if d not in found]
    other = {first_clean + 2 * k + 1 for k in range(len(items))}
    chance = [d for d in found if d[0] in other]
    wrong = [d for d in found if d[0] not in other and d not in {*one.items(), *tenth.items()}]
    print(len(one), len(missed), len(tenth), len(lost), len(chance), len(wrong))
    assert not missed and len(lost) <= 0.05 * len(tenth) and len(chance) <= 0.02 * len(items) and not wrong


def test_aligned_words():
    words = "a b c d e f g h".split()
    assert D.aligned(words, [words], 5) == 1.0
    assert D.aligned(words, ["x a b y c d f g h z".split()], 5) == 7 / 8
    assert D.aligned(words, [words[::-1]], 5) == 0.0
    assert D.aligned(words, ["a b".split() + ["x"] * 20 + words[2:4] + ["x"] * 20 + words[4:]], 5) == 0.0
    assert [D.needed(n, False) for n in (1, 2, 3, 5, 6, 10)] == [1, 2, 2, 4, 4, 7] and [D.needed(n, True) for n in (1, 3, 4, 5)] == [1, 3, 3, 4]
