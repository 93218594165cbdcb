"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding starts from the single characters of the normalised text.  An agenda
(a heap ordered by score, then by place) holds the adjacent symbol pairs whose
joined string is a piece; the best pair is merged, its new neighbours enter
the agenda, and entries whose symbols have gone are passed over.  Symbols that
are no piece are spelled in byte pieces.

Merges never cross a place whose two characters follow each other in no piece.
If no piece has a space mark behind another character, the text is therefore
cut in front of every run of marks, and if none holds a line feed, around line
feeds; each such segment is encoded once a batch.  Where the vocabulary has
such pieces, the whole text is one segment.

Every Arrow batch is checked against the sentencepiece library: its distinct
segments are encoded by the library too, and the decoded texts are compared
with the library's.  The outcome is a column, nothing is replaced by it.

The model file is read on the driver and shipped to the tasks; it must have
at most ``MAX_PIECES`` pieces.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowline.llm.common import Memo, freed, slices, word_ids

MARK = "▁"
UNKNOWN = " ⁇ "         # what the unknown id decodes to
MAX_PIECES = 1 << 20
BITS = 21               # of a symbol number; one more than MAX_PIECES needs
LOW = (1 << BITS) - 1
NEVER = np.int64(1) << 62       # after every rank
SHORT = 48              # characters of a segment that is merged beside others of its length
CELLS = 1 << 18         # symbols worked on at a time
GROUP = 16              # words that the library encodes in a row
MEMO_BYTES = 64 << 20   # of the segments that a worker remembers
SLICE_BYTES = 8 << 20   # of texts whose segments are looked up together


def _one_by_one(e):
    """An invalid byte becomes one replacement character."""
    return "�", e.start + 1


codecs.register_error("sowline_each_byte", _one_by_one)


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=proto)
        sp, size = self.library, self.library.get_piece_size()
        if size > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        self.prefix = sp.normalize("a") == MARK + "a"
        self.feed = sp.encode("\n")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = {sp.id_to_piece(i): i for i in range(size)
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        scores = {i: sp.get_score(i) for i in normal.values()}
        if any(sp.is_unused(i) for i in range(size)) or not all(sp.is_byte(i) for i in self.byte):
            raise ValueError("the vocabulary has unused pieces or lacks byte pieces")
        if not all(s == int(s) and s <= 0 for s in scores.values()):
            raise ValueError("scores are no merge ranks: not a merge-type vocabulary")
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # characters that only longer pieces hold are symbols too, spelled in bytes if they stay alone
        lone = sorted({c for p in normal for c in p} - normal.keys())
        self.size, self.unknown = size, LOW
        self.number = {**normal, **{c: size + k for k, c in enumerate(lone)}}
        if size + len(lone) >= LOW:
            raise ValueError("too many symbols")
        self.pairs: dict[int, int] = {}      # left << BITS | right -> rank << BITS | joined
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = self.number.get(piece[:k]), self.number.get(piece[k:])
                if a is not None and b is not None:
                    self.pairs[a << BITS | b] = rank[scores[i]] << BITS | i
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.of_code = np.full(0x110000, LOW, dtype=np.int32)
        for c, i in self.number.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i
        self.crossing = any(a != MARK and b == MARK for p in normal for a, b in zip(p, p[1:]))
        self.feeds = any("\n" in p for p in normal)
        self.surface = [self._surface(i) for i in range(size)]
        # pieces as bytes; ids that need a closer look: raw bytes, and control or unknown ids
        self.spelled = pa.array([x.encode("utf-8", "surrogateescape") for x in self.surface], pa.binary())
        self.special = np.array([sp.is_byte(i) and int(sp.id_to_piece(i)[3:5], 16) > 127 for i in range(size)])
        self.plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(size)])
        self.memo = Memo(MEMO_BYTES)

    @staticmethod
    def _bytes(text: str) -> str:
        return text.encode("utf-8", "surrogateescape").decode("utf-8", "sowline_each_byte")

    def _surface(self, i: int) -> str:
        sp = self.library
        if sp.is_control(i):
            return ""
        if sp.is_unknown(i):
            return UNKNOWN
        if sp.is_byte(i):
            b = int(sp.id_to_piece(i)[3:5], 16)
            return chr(b) if b < 128 else chr(0xDC00 + b)       # a surrogate marks a raw byte
        return sp.id_to_piece(i).replace(MARK, " ")

    def merge(self, text: str) -> list[int]:
        """Ids of one segment.  An agenda entry is ``rank << 32 | place``; it
        holds if the pair at that place still has that rank."""
        number, unknown, get = self.number.get, self.unknown, self.pairs.get
        ids: list = [number(c, unknown) for c in text]
        n = len(ids)
        if n > 1:
            agenda = []
            for i in range(n - 1):
                v = get(ids[i] << BITS | ids[i + 1])
                if v is not None:
                    agenda.append(v >> BITS << 32 | i)
            if agenda:
                heapq.heapify(agenda)
                after, before = list(range(1, n + 1)), list(range(-1, n - 1))
                pop, push = heapq.heappop, heapq.heappush
                while agenda:
                    entry = pop(agenda)
                    i = entry & 0xFFFFFFFF
                    left = ids[i]
                    j = after[i]
                    if left is None or j >= n:
                        continue
                    v = get(left << BITS | ids[j])
                    if v is None or v >> BITS != entry >> 32:
                        continue            # one of the two has been merged since
                    ids[i] = left = v & LOW
                    ids[j] = None
                    after[i] = k = after[j]
                    if k < n:
                        before[k] = i
                        v = get(left << BITS | ids[k])
                        if v is not None:
                            push(agenda, v >> BITS << 32 | i)
                    h = before[i]
                    if h >= 0:
                        v = get(ids[h] << BITS | left)
                        if v is not None:
                            push(agenda, v >> BITS << 32 | h)
        if max(ids, key=lambda x: -1 if x is None else x) < self.size:
            return [x for x in ids if x is not None]
        out = []
        for x, c in zip(ids, text):
            if x is not None:
                out += [x] if x < self.size else [self.byte[b] for b in c.encode()]
        return out

    def _values(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and joined symbol of adjacent symbols, ``NEVER`` for none."""
        key = left.astype(np.int64) << BITS | right
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.values[spot], NEVER)

    def merge_many(self, texts: list[str]) -> list[bytes]:
        """``merge`` of many segments as little-endian 32-bit ids.

        Segments of one length are worked on side by side: a row holds a
        segment's agenda, one entry a place.  Every step takes each row's best
        entry (the leftmost of the lowest rank), joins its symbols and renews
        the entries beside it; all rows lose one symbol, so they stay a table.
        Long segments and ones with characters of no piece take ``merge``.
        """
        out: list = [None] * len(texts)
        groups: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            groups.setdefault(len(t), []).append(i)
        for n, members in groups.items():
            step = max(1, CELLS // n)
            for at in range(0, len(members) if n <= SHORT else 0, step):
                rows = members[at:at + step]
                codes = np.frombuffer("".join([texts[i] for i in rows]).encode("utf-32-le"), dtype="<u4")
                self._side_by_side(np.array(rows), self.of_code[codes].reshape(-1, n), out)
            for i in members:
                if out[i] is None:
                    out[i] = np.array(self.merge(texts[i]), dtype="<i4").tobytes()
        return out

    def _side_by_side(self, rows: np.ndarray, ids: np.ndarray, out: list) -> None:
        known = (ids < self.size).all(axis=1)
        rows, ids = rows[known], ids[known]
        agenda = self._values(ids[:, :-1], ids[:, 1:])
        while len(rows):
            n = ids.shape[1]
            if n > 1:
                rank = agenda >> BITS
                best = rank.argmin(axis=1)
                at = np.arange(len(rows))
                value = agenda[at, best]
                done = value == NEVER
            else:
                done = np.ones(len(rows), dtype=bool)
            if done.any():
                data = np.ascontiguousarray(ids[done], dtype="<i4").tobytes()
                for k, i in enumerate(rows[done].tolist()):
                    out[i] = data[4 * n * k:4 * n * (k + 1)]
                if done.all():
                    return
                rows, ids, agenda, best, value = (x[~done] for x in (rows, ids, agenda, best, value))
                at = np.arange(len(rows))
            ids[at, best] = value & LOW
            stay = np.ones(ids.shape, dtype=bool)
            stay[at, best + 1] = False
            ids = ids[stay].reshape(len(rows), n - 1)
            stay = np.ones(agenda.shape, dtype=bool)
            stay[at, best] = False                  # the entry that was taken
            agenda = agenda[stay].reshape(len(rows), n - 2)
            if n > 2:
                has = np.flatnonzero(best < n - 2)
                b = best[has]
                agenda[has, b] = self._values(ids[has, b], ids[has, b + 1])
                has = np.flatnonzero(best > 0)
                b = best[has]
                agenda[has, b - 1] = self._values(ids[has, b - 1], ids[has, b])

    def _segments(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All segments of the texts in a row, and the first one of every text
        (one more number at the end)."""
        parts = [t.encode() for t in texts]
        data = b"".join(parts)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        b = np.frombuffer(data + b"\0" * 2, dtype=np.uint8)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[starts] = True
        if not self.crossing:
            mark = (b[:-2] == 0xE2) & (b[1:-1] == 0x96) & (b[2:] == 0x81)
            cut[:-1] |= mark
            cut[3:-1] &= ~(mark[3:] & mark[:-3])        # a run of marks stays together
            if not self.feeds:
                feed = b[:-2] == 0x0A
                cut[:-1] |= feed
                cut[1:] |= feed
            cut[starts] = True
        cut[-1] = True
        offsets = np.flatnonzero(cut)
        segments = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        return segments, np.searchsorted(offsets, starts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of all texts in a row without ends, the first id of every text
        (one more number at the end), and whether the library gives the same
        for all segments that were new."""
        segments, first = self._segments(self.library.normalize(texts) if texts else [])
        number, distinct = word_ids(segments)
        names = distinct.to_pylist()
        ids = list(map(self.memo.young.get, names))
        fresh = []
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = self.memo.get(names[i])
            if ids[i] is None:
                fresh.append(i)
        new = [names[i] for i in fresh]
        for i, found in zip(fresh, self.merge_many(new)):
            ids[i] = found
            self.memo.put(names[i], found)
        # every segment's ids, from those of the distinct ones
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), dtype="<i4")
        place = np.concatenate([[0], np.cumsum(size)])[:-1]
        sizes = size[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        short = np.int32 if max(len(pool), int(ends[-1])) < 1 << 31 else np.int64
        at = np.repeat((place[number] - ends[:-1]).astype(short), sizes)
        at += np.arange(ends[-1], dtype=short)
        flat = pool[at]
        return flat, ends[first], self._checked({s: ids[i] for s, i in zip(new, fresh)})

    def _checked(self, new: dict[str, bytes]) -> bool:
        """Whether the library encodes these segments of normalised texts
        alike.  Its normaliser puts a mark in front: that of a segment's own or
        that of a line feed before it, whose ids are left out again.  Words
        that begin with a mark are asked ``GROUP`` in a row; a run of marks
        would go on in the next word's mark and is asked alone."""
        if not self.prefix or self.crossing:
            plain, rest, feed = [], list(new), 0
        else:
            plain = [s for s in new if s[0] == MARK and s[-1] != MARK]
            rest = [s for s in new if s[0] != MARK or s[-1] == MARK]
            feed = len(self.feed)
        groups = [plain[i:i + GROUP] for i in range(0, len(plain), GROUP)]
        alone = ["\n" + s if feed else s for s in rest]
        if self.prefix and self.crossing:
            alone = [s[1:] if s[:1] == MARK else s for s in rest]
        asked = ["".join(g)[1:] for g in groups] + alone
        theirs = self.library.encode(asked, num_threads=1) if asked else []
        theirs[len(groups):] = [t[feed:] for t in theirs[len(groups):]]
        ours = [b"".join(map(new.__getitem__, g)) for g in groups] + [new[s] for s in rest]
        sizes = [4 * n for n in map(len, theirs)]
        flat = np.fromiter(chain.from_iterable(theirs), dtype="<i4", count=sum(sizes) // 4)
        return sizes == list(map(len, ours)) and flat.tobytes() == b"".join(ours)

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.surface.__getitem__, ids))
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:          # raw bytes; a control piece ends their run
                text = "".join(self._bytes("".join(map(self.surface.__getitem__, run)))
                               for _, run in groupby(ids, self.library.is_control))
        # the space that the normaliser put in front of the first piece
        if self.prefix and text.startswith(" "):
            first = next((i for i in ids if not self.library.is_control(i)), None)
            if first is not None and not self.library.is_byte(first) and not self.library.is_unknown(first):
                text = text[1:]
        return text


    def decode_many(self, lists: pa.Array) -> list[str]:
        """``decode`` of every list of ids: pieces are looked up and joined for
        all lists at once; lists with raw bytes are decoded one by one."""
        offsets = np.asarray(lists.offsets).astype(np.int64)
        ids = np.asarray(lists.values)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < self.size:
            raise ValueError("an id is outside the vocabulary")
        joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.spelled.take(pa.array(ids))), b"")
        raw = np.concatenate([[0], np.cumsum(self.special[ids])])[offsets]
        out = []
        for i, (a, b, text) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), joined.to_pylist())):
            if raw[i] < raw[i + 1] or (a < b and not self.plain[ids[a]]):
                out.append(self.decode(ids[a:b].tolist()))
            else:
                text = text.decode()
                out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


_MODELS: dict[bytes, Pieces] = {}


def _pieces(proto: bytes) -> Pieces:
    """One codec a worker process, whatever the number of tasks."""
    if proto not in _MODELS:
        _MODELS[proto] = Pieces(proto)
    return _MODELS[proto]


def _shipped(spark, path: str):
    with open(path, "rb") as f:
        proto = f.read()
    Pieces(proto)               # a wrong kind of model fails here, not in the tasks
    return spark.sparkContext.broadcast(proto)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple = ("doc_id",), end: bool = True) -> DataFrame:
    """``keep`` columns plus ``ids`` (array of int, an end id last if ``end``)
    and ``agrees`` (boolean: the library encodes the row's batch alike).

    NULL and empty texts have the end id alone.  Texts are whole, whatever
    their length; control pieces' names in a text are ordinary text.
    """
    shipped = _shipped(docs.sparkSession, path)
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*rows.drop("_text").schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("agrees", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shipped.value)
        tail = np.array([pieces.library.eos_id()] if end else [], dtype="<i4").tobytes()
        for whole in freed(batches):
            for batch in slices(whole, "_text", SLICE_BYTES):
                flat, first, agree = pieces.encode([t or "" for t in batch.column("_text").to_pylist()])
                if end:
                    flat = np.insert(flat, first[1:], pieces.library.eos_id())
                    first = first + np.arange(len(first))
                lists = pa.LargeListArray.from_arrays(first, pa.array(flat)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), lists, pa.array([agree] * batch.num_rows)],
                                                 names=[*keep, "ids", "agrees"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` plus ``decoded`` (text of its ids; NULL ids: empty) and
    ``decoded_agrees`` (the library's text is the same).  An id outside the
    vocabulary is an error, as in the library."""
    shipped = _shipped(encoded.sparkSession, path)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType()),
                           T.StructField("decoded_agrees", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shipped.value)
        for whole in freed(batches):
            step = 256
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                column = pc.if_else(pc.is_valid(batch.column(ids)), batch.column(ids), pa.scalar([], batch.column(ids).type))
                texts = pieces.decode_many(column)
                lists = column.to_pylist()
                theirs = pieces.library.decode(lists, num_threads=1) if lists else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()),
                                                  pa.array([a == b for a, b in zip(texts, theirs)])],
                                                 names=[*batch.schema.names, "decoded", "decoded_agrees"])

    return encoded.mapInArrow(run, schema)
