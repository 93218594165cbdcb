"""Benchmark decontamination: BM25 over an inverted index of test items.

The test items are the index, every passage of every document is a query.

* Items of more than ``PIECE`` words are indexed as several pieces.  Impacts
  are BM25 term weights divided by the piece's own total, so a passage that
  holds the whole piece scores 1 whatever the piece's length.
* Pieces are dealt into shards of ``SHARD`` at most.  A shard's postings, a
  bounded table, are shipped to all tasks; every shard meets every passage.
  Postings are cut into blocks of ``BLOCK`` pieces with the largest impact of
  each block (block-max).
* A passage is ``2 * CELL`` words, a new one starts every ``CELL`` words, to
  the end of the text.  ``wand`` walks the cursors of its terms, finds the
  pivot from the terms' largest impacts, skips blocks whose block maxima
  cannot reach the threshold, and scores the rest in full: it returns exactly
  the pieces at or above the threshold.  Passages that no block can bring to
  the threshold are set aside by the same sums for many passages at a time.
* A retrieved item is verified for its question and for its answer, which must
  both be in the document: ``OVERLAP`` of the part's word 5-grams anywhere in
  it, or ``ALIGNED`` of the part's words in their order within a window of
  about the part's length near a retrieved passage.  The second holds for short
  parts with changed, missing or added words too.  The answer is the item's last sentence (or its last
  third, if it has but one), the question is the rest.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sowline.llm.common import freed, slices, stored, unused, word_ids, words_of

PIECE = 48          # words of an indexed piece at most
SHARD = 4096        # pieces whose postings are shipped together
BLOCK = 4           # pieces of one block
CELL = 32           # words between two passages' starts
THRESHOLD = 0.5     # of a piece's own score
GRAM = 5            # words compared when an item is verified
OVERLAP = 0.5       # share of question and of answer n-grams in the document
ALIGNED = 0.66      # or share of question and of answer words, in order and close together
K1, B = 1.2, 0.75
EDGES = ".,;:!?\"'()[]{}<>#*$%&|"


def normal_words(texts) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(offsets, ids, distinct)`` of lower-cased words without punctuation
    at their ends; words of punctuation alone are the empty word."""
    offsets, words = words_of(texts)
    ids, distinct = word_ids(words)
    return offsets, ids, pc.utf8_trim(pc.utf8_lower(distinct), characters=EDGES)


def plain(text: str | None) -> list[str]:
    """The normal words of one text, without empty ones."""
    _, ids, distinct = normal_words(pa.array([text], pa.string()))
    names = distinct.to_pylist()
    return [w for w in map(names.__getitem__, ids.tolist()) if w]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the item's question and answer; NULL and blank texts have none."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text or "") if plain(s)]
    if len(sentences) > 1 and len(plain(sentences[-1])) >= GRAM:
        return plain(" ".join(sentences[:-1])), plain(sentences[-1])
    words = plain(text)
    cut = len(words) - max(min(GRAM, len(words)), len(words) // 3)
    return words[:cut], words[cut:]


def grams(words: list[str]) -> set:
    """Word n-grams; a shorter sequence is one gram."""
    return {tuple(words[i:i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))} if words else set()


def needed(n: int, alone: bool) -> int:
    """Words of a part of ``n`` that must be found in order; a part that is a
    whole item may lack one, and none if it has less than four."""
    return max(math.ceil(ALIGNED * n), (n - 1 if n > 3 else n) if alone else 0)


def aligned(wanted: list[str], regions: list[list[str]], least: int) -> float:
    """The largest share of ``wanted`` that a window of a region holds in
    order, 0 if it is less than ``least`` words.

    Windows are a quarter longer than ``wanted``; those with too few of its
    words are skipped, the rest are compared by bit-parallel longest common
    subsequence.
    """
    n, best = len(wanted), 0
    step = max(1, n // 16)
    width, whole = n + max(2, n // 4) + step - 1, (1 << n) - 1
    places: dict[str, int] = defaultdict(int)
    for i, w in enumerate(wanted):
        places[w] |= 1 << i
    for words in regions:
        bits = [places.get(w, 0) for w in words]
        held = np.concatenate([[0], np.cumsum([b > 0 for b in bits])])
        starts = np.arange(0, len(words), step)
        enough = held[np.minimum(starts + width, len(words))] - held[starts] >= max(least, 1)
        for start in starts[enough].tolist():
            free = whole
            for b in bits[start:start + width]:
                if b:
                    taken = free & b
                    free = ((free + taken) | (free - taken)) & whole
            best = max(best, n - free.bit_count())
    return best / n if best >= least else 0.0


def _pieces(items: DataFrame) -> DataFrame:
    """(item_id, piece, n_words, terms) of every item with a word, and the
    item's question and answer as texts of normal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.int64()), ("piece", pa.int32()), ("n_words", pa.int32()),
                            ("terms", pa.list_(pa.string())), ("question", pa.string()), ("answer", pa.string())])
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = plain(text)
                n = -(-len(words) // PIECE)
                question, answer = map(" ".join, question_answer(text))
                for k in range(n):
                    part = words[len(words) * k // n:len(words) * (k + 1) // n]
                    rows.append({"item_id": item, "piece": k, "n_words": len(part), "terms": part,
                                 "question": question, "answer": answer})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "item_id long, piece int, n_words int, terms array<string>, question string, answer string")


class Index:
    """Postings of one shard: pieces numbered in order of (block, place)."""

    def __init__(self, pieces: list, weights: dict[tuple[int, str], float]):
        """``weights``: impact by (number of the piece, term)."""
        self.items = [p.item_id for p in pieces]
        self.parts = [(p.question, p.answer) for p in pieces]
        self.question = [grams(p.question.split()) for p in pieces]
        self.answer = [grams(p.answer.split()) for p in pieces]
        lists: dict[str, list] = defaultdict(list)
        for (piece, term), w in sorted(weights.items()):
            lists[term].append((piece, w))
        self.terms = pa.array(sorted(lists), pa.string())
        self.blocks = -(-len(pieces) // BLOCK)
        self.places = [[p for p, _ in lists[t]] for t in self.terms.to_pylist()]
        self.impacts = [[w for _, w in lists[t]] for t in self.terms.to_pylist()]
        self.block_max = np.zeros((len(lists), self.blocks), dtype=np.float32)
        for t, (places, impacts) in enumerate(zip(self.places, self.impacts)):
            for p, w in zip(places, impacts):
                self.block_max[t, p // BLOCK] = max(self.block_max[t, p // BLOCK], np.nextafter(np.float32(w), np.float32(9)))
        self.most = self.block_max.max(axis=1) if self.blocks else np.zeros(0, np.float32)

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """``(piece, score)`` of all pieces that score ``threshold`` or more
        for the distinct ``terms``."""
        cursors = [[self.places[t][0], 0, t] for t in terms]
        out = []
        end = len(self.items)
        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort()
            bound, pivot = 0.0, None
            for i, (place, _, t) in enumerate(cursors):
                bound += float(self.most[t])
                if bound >= threshold - 1e-6:
                    pivot = i
                    break
            if pivot is None:
                return out
            place = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == place:
                pivot += 1
            block = place // BLOCK
            if sum(float(self.block_max[c[2], block]) for c in cursors[:pivot + 1]) < threshold - 1e-6:
                # nothing up to the block's end, or to the next cursor, can reach it
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, place + 1)
            elif cursors[0][0] == place:
                here = [c for c in cursors[:pivot + 1] if c[0] == place]
                score = sum(self.impacts[c[2]][c[1]] for c in here)
                if score >= threshold - 1e-9:
                    out.append((place, score))
                goal = place + 1
            else:
                goal = place
            for c in cursors[:pivot + 1]:
                if c[0] < goal:
                    places = self.places[c[2]]
                    c[1] = bisect_left(places, goal, c[1])
                    c[0] = places[c[1]] if c[1] < len(places) else end

    def search(self, texts: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """``(row, item_id, score, question share, answer share)`` of the
        verified pieces of every text, the best passage's score of each."""
        offsets, ids, distinct = normal_words(texts)
        found = pc.fill_null(pc.index_in(distinct, value_set=self.terms), -1)
        term = np.asarray(found).astype(np.int64)[ids]
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        cells_of = -(-np.diff(offsets) // CELL)
        first_cell = np.concatenate([[0], np.cumsum(cells_of)])
        cell = first_cell[rows] + (np.arange(len(ids)) - offsets[rows]) // CELL
        known = term >= 0
        width = max(1, len(self.terms))
        pairs = np.unique(cell[known] * width + term[known])
        cell, term = pairs // width, pairs % width
        starts = np.searchsorted(cell, np.arange(first_cell[-1] + 1))
        bounds = np.zeros((first_cell[-1] + 1, self.blocks), dtype=np.float32)
        full = np.flatnonzero(starts[1:] > starts[:-1])
        for part in np.array_split(full, max(1, len(term) * max(1, self.blocks) // (1 << 23))):
            if len(part):
                a, b = starts[part[0]], starts[part[-1] + 1]
                bounds[part] = np.add.reduceat(self.block_max[term[a:b]], starts[part] - a, axis=0)
        last = np.zeros(first_cell[-1] + 1, dtype=bool)
        last[first_cell[1:][cells_of > 0] - 1] = True
        after = np.where(last[:-1, None], 0, bounds[1:]) if len(bounds) > 1 else bounds[:0]
        likely = np.flatnonzero(((bounds[:-1] + after).max(axis=1) if self.blocks else np.zeros(len(after))) >= threshold - 1e-3)
        best: dict[tuple[int, int], float] = {}
        cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        for c in likely.tolist():
            stop = c + 1 if last[c] else c + 2
            terms = sorted(set(term[starts[c]:starts[stop]].tolist()))
            row = int(np.searchsorted(first_cell, c, side="right")) - 1
            for piece, score in self.wand(terms, threshold):
                best[row, piece] = max(best.get((row, piece), 0.0), score)
                cells[row, piece].append((c - int(first_cell[row])) * CELL)
        names, out, seen = None, [], {}
        for (row, piece), score in sorted(best.items()):
            if row not in seen:
                names = names or distinct.to_pylist()
                words = [w for w in map(names.__getitem__, ids[offsets[row]:offsets[row + 1]].tolist()) if w]
                seen = {row: (grams(words), words)}
            own = seen[row][0]
            shares = []
            for wanted in (self.question[piece], self.answer[piece]):
                short = [g for g in wanted if len(g) < GRAM]
                hits = len(wanted & own) if not short else sum(
                    any(tuple(seen[row][1][i:i + len(g)]) == g for i in range(len(seen[row][1]))) for g in short)
                shares.append(hits / len(wanted) if wanted else 1.0)
            if min(shares) < overlap:
                parts = [p.split() for p in self.parts[piece]]
                reach, ends = sum(map(len, parts)), []
                for place in cells[row, piece]:
                    low, high = max(0, place - reach), place + 2 * CELL + reach
                    if ends and low <= ends[-1][1]:
                        ends[-1][1] = high
                    else:
                        ends.append([low, high])
                known = ids[offsets[row]:offsets[row + 1]]
                near = [[w for w in map(names.__getitem__, known[low:high].tolist()) if w] for low, high in ends]
                for k, part in enumerate(parts):
                    if shares[k] < overlap:
                        share = aligned(part, near, needed(len(part), not all(parts)))
                        if not share:
                            break
                        shares[k] = share
                else:
                    out.append((row, self.items[piece], score, *shares))
            else:
                out.append((row, self.items[piece], score, *shares))
        return out


def build_indexes(items: DataFrame) -> Iterator[Index]:
    """One index after another, each of ``SHARD`` pieces at most.

    Document frequencies are counted over all items in Spark; only one
    shard's pieces and postings are on the driver at a time.
    """
    pieces = stored(_pieces(items).withColumn("row", F.row_number().over(
        Window.partitionBy(F.pmod(F.xxhash64("item_id", "piece"), F.lit(64))).orderBy("item_id", "piece", "answer"))
        * 64 + F.pmod(F.xxhash64("item_id", "piece"), F.lit(64))), "pieces")
    total = pieces.agg(F.count("*").alias("n"), F.avg("n_words").alias("words"), F.max("row").alias("last")).first()
    if not total.n:
        return
    postings = pieces.select("row", "n_words", F.explode("terms").alias("term")).groupBy("row", "n_words", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (total.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / total.words))
    weighed = stored(postings.join(df, "term").select("row", "term", (idf * tf).alias("w")), "postings")
    for low in range(0, total.last + 1, SHARD):
        inside = (F.col("row") >= low) & (F.col("row") < low + SHARD)
        rows = sorted(pieces.where(inside).select("row", "item_id", "question", "answer").collect(), key=lambda p: p.row)
        number = {p.row: i for i, p in enumerate(rows)}
        raw = [(number[r.row], r.term, r.w) for r in weighed.where(inside).collect()]
        own: dict[int, float] = defaultdict(float)
        for i, _, w in raw:
            own[i] += w
        if rows:
            yield Index(rows, {(i, t): w / own[i] for i, t, w in raw})


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                 keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document row and test item found in it: ``keep`` columns,
    item_id, score (of the best passage, 1 = the whole piece), question_share
    and answer_share.

    NULL, empty and blank texts hold nothing; items without a word are in no
    document; repeated item ids are found each on their own and reported once.
    Rows without a doc_id are searched like any other.  No row of the corpus
    is shuffled: passages are searched where they are read.
    """
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_text"))
    spark = docs.sparkSession
    schema = rows.drop("_text").schema
    for name, kind in (("item_id", "long"), ("score", "double"), ("question_share", "double"), ("answer_share", "double")):
        schema = schema.add(name, kind)

    def searched(shipped) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for whole in freed(batches):
                for batch in slices(whole, "_text"):
                    best: dict[tuple[int, int], tuple] = {}
                    for row, item, *scores in index.search(batch.column("_text"), threshold, overlap):
                        best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), tuple(scores))
                    take = pa.array([row for row, _ in best], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(take) for k in keep), pa.array([i for _, i in best], pa.int64()),
                         *(pa.array([v[n] for v in best.values()], pa.float64()) for n in range(3))],
                        names=[*keep, "item_id", "score", "question_share", "answer_share"])
        return rows.mapInArrow(run, schema)

    found = None
    for index in build_indexes(items):
        part = searched(spark.sparkContext.broadcast(index))
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, columns unchanged.

    A document row is known by its id and a hash of its text, so of rows that
    share an id only those with a contaminated text go.
    """
    digest = unused(docs, "text_hash")
    marked = docs.withColumn(digest, F.xxhash64(F.coalesce("text", F.lit(""))))
    hit = stored(contaminated(marked, items, keep=("doc_id", digest))
                 .select(F.col("doc_id").alias("hit_id"), F.col(digest).alias("hit_hash")).distinct(), "leaks")
    return (marked.join(hit, marked["doc_id"].eqNullSafe(hit["hit_id"]) & (marked[digest] == hit["hit_hash"]), "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
