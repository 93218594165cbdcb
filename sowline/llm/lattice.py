"""Language-model scores from a subword lattice.

A word's lattice holds all its segmentations into pieces of an existing
subword vocabulary; the first piece begins with the vocabulary's word mark,
characters without a piece are spelled in bytes.  The pieces are weighted by
the vocabulary's own scores.  The forward recursion in log space gives the
probability of all paths together; pieces do not cross words, so a text's log
probability is the sum over its words and the end.

* One number is fitted for the weights: a temperature, the power to which all
  pieces' probabilities are raised before they are made to sum to one.  Of
  ``TEMPERATURES`` the one that gives the training words, each as often as it
  occurs, the highest likelihood is taken.  One sum a temperature comes to the
  driver.
* A token is the end with the training documents' share of ends, else a word.
* ``mixture`` is the model learned from the training documents: the lattice has
  an arc for every whole training word, by absolute discounting
  ``(count - d) / tokens`` with d from the numbers of words seen once and
  twice, and the mass set free goes to the pieces, whose probabilities are
  adapted from the tempered ones to the training words (see ``adapt``).

Words are counted over all training documents.  Every distinct word is scored
once, whatever its number of documents; the scores go to blocks of documents
(see ``with_block``), where a word counts once a block, and are summed there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sowline.llm.common import SLICE_BYTES, slices, stored, with_block, word_ids, words_of

MARK = "▁"
MAX_PIECES = 1 << 20
TEMPERATURES = (0.5, 0.75, 1.0, 1.25)
BLOCK_DOCS = 4096
CELLS = 4 << 20         # lattice arcs worked on at a time
WORDS = 1 << 16         # words scored in one call
ROUNDS = 2              # of adapting the pieces to the training words
PRIOR = 1000.0          # pieces that the given probabilities count as
M1 = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 20) - 1)
NONE = -1


def read_vocabulary(path: str) -> tuple[list[str], list[float], list[int]]:
    """``(pieces, log probabilities, byte numbers)`` of a sentencepiece model.

    The byte number is -1 but for byte pieces.  Scores that are merge ranks
    (0, -1, -2, ...) count as ranks of a Zipf law; others are log
    probabilities.  Control and unknown pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > MAX_PIECES:
        raise ValueError(f"{path}: more than {MAX_PIECES} pieces")
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces, scores = [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids]
    numbers = [int(p[3:5], 16) if model.is_byte(i) else -1 for i, p in zip(ids, pieces)]
    if all(s == int(s) and s <= 0 for s in scores):
        scores = [-math.log(2 - s) for s in scores]
    total = np.logaddexp.reduce(scores)
    return pieces, [s - total for s in scores], numbers


def _hash(codes: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = (h ^ codes) * M1
    return h ^ (h >> np.uint64(29))


class Lattice:
    """Piece arcs of many words at a time."""

    def __init__(self, pieces: list[str], logp: np.ndarray, numbers: list[int]):
        self.logp = np.append(np.asarray(logp, dtype=np.float64), -np.inf)     # the last stands for no piece
        self.byte = np.full(256, NONE)
        spelled = []
        for i, (piece, number) in enumerate(zip(pieces, numbers)):
            if number >= 0:
                self.byte[number] = i
            else:
                spelled.append((piece, i))
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks byte pieces")
        self.longest = max(len(p) for p, _ in spelled)
        keys = np.zeros(len(spelled), dtype=np.uint64)
        for n in range(1, self.longest + 1):
            same = [k for k, (p, _) in enumerate(spelled) if len(p) == n]
            if same:
                codes = np.array([[ord(c) for c in spelled[k][0]] for k in same], dtype=np.uint64)
                h = np.zeros(len(same), dtype=np.uint64)
                for j in range(n):
                    h = _hash(codes[:, j], h)
                keys[same] = h
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i in spelled])[order]
        self.marked = np.zeros(int(LOW) + 1, dtype=bool)
        self.marked[keys & LOW] = True
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")

    def arcs(self, codes: np.ndarray) -> np.ndarray:
        """Piece number of word w's characters i .. i + k at ``[i, k, w]``."""
        length, words = codes.shape
        out = np.full((length, min(self.longest, length), words), len(self.logp) - 1, dtype=np.int32)
        h = np.zeros((length, words), dtype=np.uint64)
        for k in range(out.shape[1]):
            h = _hash(codes[k:], h[:length - k])        # of the strings from every place
            # most strings are no piece: the low bits tell before a search
            near = np.flatnonzero(self.marked[h & LOW])
            found = h.ravel()[near]
            spot = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[spot] == found
            out[near[hit] // words, k, near[hit] % words] = self.ids[spot[hit]]
        return out

    def spell(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log probability of every character in bytes where it has no piece
        of its own, else -inf."""
        out = np.full(codes.shape, -np.inf)
        lone = first == len(self.logp) - 1
        for code in np.unique(codes[lone]).tolist():
            out[lone & (codes == code)] = self.logp[[int(self.byte[b]) for b in chr(code).encode("utf-8", "surrogatepass")]].sum()
        return out

    def sweep(self, codes: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(totals, single)``: the log probability of all paths to every
        place ``[i, w]``, and that of characters spelled in bytes.

        Paths to a place are summed as plain numbers relative to that place.
        """
        p, single = np.exp(self.logp), np.exp(self.spell(codes, arcs[:, 0]))
        length, words = codes.shape
        reach = arcs.shape[1]
        alpha, totals = np.zeros((length + 1, words)), np.zeros((length + 1, words))
        alpha[0] = 1.0
        with np.errstate(divide="ignore"):
            for i in range(length):
                if i:
                    scale = np.where(alpha[i] > 0, alpha[i], 1.0)
                    alpha[i:i + reach] /= scale
                    totals[i] = totals[i - 1] + np.log(scale)
                alpha[i + 1] += alpha[i] * single[i]
                for k in range(min(reach, length - i)):
                    alpha[i + k + 1] += alpha[i] * p[arcs[i, k]]
            totals[length] = totals[length - 1] + np.log(alpha[length])
        return totals, single

    def forward(self, codes: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """Log probability of all paths to the end of every word."""
        return self.sweep(codes, arcs)[0][-1]

    def expected(self, words: pa.Array) -> np.ndarray:
        """How often every piece is used in the words, each word's paths
        weighted by their probability given the word."""
        p, none = np.exp(self.logp), len(self.logp) - 1
        out = np.zeros(len(self.logp))
        for _, codes in self.groups(words):
            arcs = self.arcs(codes)
            totals, single = self.sweep(codes, arcs)
            length = codes.shape[0]
            # share[i]: of the paths, those through place i; a step's share is
            # that of its end times the step's part in all paths to there
            share, used = np.ones(totals.shape), np.zeros(arcs.shape)
            for i in range(length - 1, -1, -1):
                step = share[i + 1] * single[i] * np.exp(totals[i] - totals[i + 1])
                for code in np.unique(codes[i, step > 0]).tolist():
                    spelled = step[codes[i] == code].sum()
                    for b in chr(code).encode("utf-8", "surrogatepass"):
                        out[self.byte[b]] += spelled
                share[i] = step
                for k in range(min(arcs.shape[1], length - i)):
                    used[i, k] = share[i + k + 1] * p[arcs[i, k]] * np.exp(totals[i] - totals[i + k + 1])
                    share[i] += used[i, k]
            out += np.bincount(arcs.ravel(), weights=used.ravel(), minlength=len(out))
        out[none] = 0
        return out[:none]

    def groups(self, words: pa.Array):
        """``(places, codes)`` of the words by length, a bounded number of
        arcs at a time; ``codes[i, w]`` is character i of word w, mark first."""
        sizes = np.asarray(pc.utf8_length(words)).astype(np.int64)
        order = np.argsort(sizes, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(sizes[order]) > 0]) if len(order) else []
        for a, b in zip(starts, np.append(starts[1:], len(order)) if len(order) else []):
            n = int(sizes[order[a]])
            step = max(1, CELLS // ((n + 1) * min(n + 1, self.longest)))
            for at in range(a, b, step):
                places = order[at:min(b, at + step)]
                text = "".join(words.take(pa.array(places)).to_pylist())
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(places), n)
                yield places, np.concatenate([np.full((1, len(places)), ord(MARK), dtype=np.uint64), codes.T.astype(np.uint64)])

    def score(self, words: pa.Array, weights: tuple = ()) -> np.ndarray:
        """Natural log probability of every word; with ``weights`` (several
        log probabilities of all pieces) one row for each of them."""
        own = self.logp
        rows = [np.append(w, -np.inf) for w in weights] or [own]
        out = np.zeros((len(rows), len(words)))
        for places, codes in self.groups(words):
            arcs = self.arcs(codes)
            for k, self.logp in enumerate(rows):
                out[k, places] = self.forward(codes, arcs)
        self.logp = own
        return out if weights else out[0]


def together(batches):
    """Batches of words put together up to ``WORDS`` words or ``SLICE_BYTES``."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= WORDS or size >= SLICE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def tempered(logp, temperature: float) -> np.ndarray:
    """The probabilities to the power of ``temperature``, summing to one."""
    out = np.asarray(logp) * temperature
    return out - np.logaddexp.reduce(out)


def is_held_out(folds: int, held: int):
    """crc32 of the id as text modulo ``folds`` is ``held`` (a NULL id counts as '')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held


def count_words(docs: DataFrame, training) -> DataFrame:
    """``(word, n)``: every distinct word of all documents and its count in
    the training ones.  Counts are summed per batch, then per task, before
    the shuffle."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), training.cast("long").alias("train"))

    def run(batches):
        for whole in batches:
            tables = []
            for batch in slices(whole, "text"):
                offsets, words = words_of(pc.ascii_lower(batch.column("text")))
                ids, distinct = word_ids(words)
                train = np.repeat(np.asarray(batch.column("train")), np.diff(offsets))
                n = np.bincount(ids, weights=train, minlength=len(distinct)).astype(np.int64)
                tables.append(pa.table({"word": distinct.cast(pa.large_string()), "n": n}))
            if tables:
                summed = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
                yield from pa.table({"word": summed["word"].cast(pa.string()), "n": summed["n_sum"]}).to_batches()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, vocabulary, temperatures: tuple = TEMPERATURES) -> float:
    """The temperature that makes the training words of ``words`` (word, n),
    each n times, likeliest; the first of equal ones."""
    shipped = words.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        lattice = Lattice(*shipped.value)
        weights = tuple(tempered(shipped.value[1], t) for t in temperatures)
        sums = np.zeros(len(temperatures))
        for batch in together(batches):
            sums += lattice.score(batch.column("word"), weights) @ np.asarray(batch.column("n")).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["k", "lp"])

    found = words.where("n > 0").mapInArrow(run, "k int, lp double").groupBy("k").agg(F.sum("lp").alias("lp")).collect()
    total = {r.k: r.lp for r in found}
    return temperatures[max(total, key=lambda k: (total[k], -k))] if total else 1.0


def adapt(words: DataFrame, vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The vocabulary's log probabilities adapted to the training words of
    ``words`` (word, n): expectation-maximisation over all segmentations.

    Every distinct training word counts once, as the pieces stand for words
    not met before; the given probabilities count as ``PRIOR`` pieces.
    One number a piece comes to the driver.
    """
    spark, prior = words.sparkSession, np.exp(np.asarray(vocabulary[1]))
    seen = words.where("n > 0").select("word")
    logp = np.asarray(vocabulary[1], dtype=float)
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast((vocabulary[0], logp, vocabulary[2]))

        def run(batches):
            lattice = Lattice(*shipped.value)
            sums = np.zeros(len(shipped.value[0]))
            for batch in together(batches):
                sums += lattice.expected(batch.column("word"))
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["piece", "uses"])

        found = seen.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        if not found.num_rows:
            break
        uses = PRIOR * prior
        uses[np.asarray(found["piece"].combine_chunks())] += np.asarray(found["uses"].combine_chunks())
        logp = np.log(uses / uses.sum())
        shipped.unpersist()
    return logp


def scores(docs: DataFrame, path: str, folds: int = 7, held: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (the given pieces' lattice) and mixture (the learned one's) in log10.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z and
    one end.  NULL, empty and blank texts have the end alone.  Repeated rows
    count as often as they occur.
    """
    spark = docs.sparkSession
    vocabulary = read_vocabulary(path)
    out = is_held_out(folds, held)
    ends = docs.where(~out).count()
    words = stored(count_words(docs, ~out), "words")
    of = lambda test: F.coalesce(F.sum(F.when(test, 1)), F.lit(0))
    totals = words.agg(F.sum("n").alias("n"), of(F.col("n") > 0).alias("v"), of(F.col("n") == 1).alias("once"),
                       of(F.col("n") == 2).alias("twice")).first()
    n_train, distinct = (totals.n or 0) + ends, totals.v + (ends > 0)
    base = math.log10(n_train + distinct + 1)
    discount = totals.once / (totals.once + 2 * totals.twice) if totals.once else 0.5
    # the pieces' share; all of it where there are no training words
    spelled = discount * totals.v / n_train if totals.v else 1.0
    share = max(ends, 1) / max(n_train, 1)
    end = math.log10(share)
    word = math.log10(max(1 - share, 1 / (n_train + 1)))        # a token that is no end
    logp = tempered(vocabulary[1], fit(words, vocabulary))
    adapted = adapt(words, (vocabulary[0], logp, vocabulary[2]))
    shipped = spark.sparkContext.broadcast(((vocabulary[0], logp, vocabulary[2]), adapted))

    def score_words(batches):
        given, learned = shipped.value
        lattice = Lattice(*given)
        for batch in together(batches):
            whole = np.maximum(np.asarray(batch.column("n")) - discount, 0) / max(n_train, 1)
            paths, adapted_paths = lattice.score(batch.column("word"), (given[1], learned))
            with np.errstate(divide="ignore"):
                mixed = np.logaddexp(np.log(whole), math.log(spelled) + adapted_paths) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(word + paths / math.log(10)), pa.array(mixed)],
                                             names=["word", "n", "lp", "mixed"])

    scored = words.mapInArrow(score_words, "word string, n long, lp double, mixed double")
    dealt = with_block(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), out.alias("held")), "doc_id", BLOCK_DOCS)

    def vocabulary_of(docs_table):
        """The block's words as numbers into its sorted distinct words: the
        same in every run, in whatever order the rows come."""
        offsets, found = words_of(pc.ascii_lower(docs_table.column("text").combine_chunks()))
        ids, names = word_ids(found)
        order = np.asarray(pc.array_sort_indices(names)).astype(np.int64)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return offsets, place[ids] if len(ids) else ids, names.take(pa.array(order))

    def asked(key, docs_table):
        _, _, names = vocabulary_of(docs_table)
        return pa.table({"word": names.cast(pa.string()), "block": np.full(len(names), key[0].as_py(), dtype=np.int64),
                         "place": np.arange(len(names))})

    def summed(key, docs_table, replies):
        offsets, ids, names = vocabulary_of(docs_table)
        n, lp, mixed = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        if replies.num_rows:
            at = np.asarray(replies.column("place").combine_chunks()).astype(np.int64)
            n[at] = np.asarray(replies.column("n").combine_chunks())
            lp[at] = np.asarray(replies.column("lp").combine_chunks())
            mixed[at] = np.asarray(replies.column("mixed").combine_chunks())
        per = [np.append(0.0, np.cumsum(x[ids])) for x in ((n > 0).astype(float),)]
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        unit = np.log10(n + 1) - base
        total = [math.log10(ends + 1) - base + unit[ids[a:b]].sum() for a, b in spans]
        model = [end + lp[ids[a:b]].sum() for a, b in spans]
        known = (np.diff(per[0][offsets]) + (ends > 0)).astype(np.int64)
        size = docs_table.num_rows
        return pa.table({"doc_id": docs_table.column("doc_id"), "held_out": docs_table.column("held"),
                         "n_tokens": np.diff(offsets) + 1, "n_known": known, "train_tokens": np.full(size, n_train, dtype=np.int64),
                         "base_score": np.array(total, dtype=float), "score": np.array(model, dtype=float),
                         "mixture": np.array([end + mixed[ids[a:b]].sum() for a, b in spans], dtype=float)})

    pairs = dealt.groupBy("block").applyInArrow(asked, "word string, block long, place long")
    replies = pairs.join(scored, "word").select("block", "place", "n", "lp", "mixed")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixture double")
