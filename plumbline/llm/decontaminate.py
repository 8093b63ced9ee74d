"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Words are runs without white space or ASCII punctuation, A-Z lower-cased. A text is contaminated by an item of n words
if some stretch of it is within n - ceil(0.8 n) word edits (insert, delete, replace) of the whole item.

The CGK walk reads a sequence with a pointer: at step j it puts out the word it stands on and moves on if the j-th
random bit of that word is one. Two sequences at a small edit distance so get outputs at a small Hamming distance,
as the walks fall in step again after an edit. ``WALKS`` walks with different random bits are taken over item-sized
windows of each text; from each, ``tables`` keys of ``SAMPLE`` sampled steps are looked up among those of the items.
The steps are sampled within 1.5 times the item's words, so the windows of each class of item sizes have tables of
their own. Windows begin at every ``STRIDE``-th word (``SHORT_STRIDE`` for items of under ``SHORT`` words), and items
are indexed from as many of their first words each, so an item is aligned with a window wherever it stands. Items of over ``SEGMENT`` words are indexed by segments, one of
which has no more than its share of the edits; those of ``HALVES`` words or more are indexed by their halves too, one of which has no more
than half of the edits.

Windows that have too few words of any item are not walked: a part of an item with no more than its share of the edits
leaves more of them. Matches of keys are candidates. Each is verified exactly: the least edit distance between the whole item and any
stretch of the text around the window. More walks and tables raise recall; the tests measure it.

Nothing is shuffled. Items are collected in blocks of about ``BLOCK`` words (a longer item is one of its own), each a pass
of its own over the texts. A Python worker builds a block's index once and keeps it for all its tasks.

Edge cases: items without words match nothing; an item without an id matches, with null as item_id; null or empty
texts are clean; an item of up to 4 words must occur as it is; repeated rows are judged alike, each for itself;
repeated items are items of their own; empty tables of texts or items give an empty result, or keep every text; extra
columns pass through clean().
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.counts import Lookup
from plumbline.llm.text import LETTERS, Words, map_arrow, mix, slices

SIMILARITY = 0.8
STRIDE, SHORT_STRIDE, SHORT = 8, 2, 24
SEGMENT = 48
HALVES = 32
WALKS, TABLES, SAMPLE = 4, 10, 4
BLOCK = 400_000
CHUNK = 4 << 20
CLASSES = (1, 2, 4, 8, 12, 16, 24, 32, 48)  # the least words of each class of item sizes
_REACH = 1.5
_SEED = 20_240_501
_BITS = 16
_M = np.uint64(0x9E3779B97F4A7C15)


def allowed(n: int) -> int:
    """Edits that an item of n words may have."""
    return n - -(-n * int(SIMILARITY * 100) // 100)


def class_of(n: int) -> int:
    return int(np.searchsorted(CLASSES, n, "right")) - 1


class Index:
    """Keys of the items' windows in all tables."""

    def __init__(self, items: list[tuple[int, np.ndarray]], stride: int = STRIDE):
        """items: (item_id, hashes of its words)."""
        self.stride = stride
        self.items = [(i, h) for i, h in items if len(h)]
        pieces: dict[int, list[tuple[int, int]]] = {}
        #: For each class: how many of as many words as its least size a window has in common with the items, if it
        #: begins where a part of the class begins that has no more than its share of the edits.
        self.least: dict[int, int] = {}
        self.vocabulary = Lookup(np.unique(np.concatenate([h for _, h in self.items])) if self.items else np.zeros(0, np.uint64), 16)
        for k, (_, h) in enumerate(self.items):
            whole = max(1, len(h) // SEGMENT)
            for parts in {whole, 2 * whole} if len(h) >= HALVES else {whole}:
                edits = allowed(len(h)) // parts  # that some part has at most
                edges = [len(h) * p // parts for p in range(parts + 1)]
                for a, b in zip(edges, edges[1:]):
                    for o in range(min(stride, b - a)):
                        c = class_of(min(b - a - o, SEGMENT))
                        pieces.setdefault(c, []).append((k, a + o))
                        self.least[c] = min(self.least.get(c, CLASSES[c]), CLASSES[c] - edits)
        rng = np.random.default_rng(_SEED)
        steps = {c: max(1, int(_REACH * n)) for c, n in enumerate(CLASSES)}
        plan = {c: [[np.sort(rng.choice(s, min(SAMPLE, s), replace=False)) for _ in range(TABLES if s > SAMPLE else 1)] for _ in range(WALKS)] for c, s in steps.items()}
        self.classes = sorted(pieces)
        #: For each walk and step: the tables that take that step's output.
        self.take: list[list[list[int]]] = []
        self.tables: list[tuple[int, int]] = [(c, t) for c in self.classes for t in range(len(plan[c][0]))]
        self.steps = max([steps[c] for c in self.classes], default=0)
        for w in range(WALKS):
            self.take.append([[i for i, (c, t) in enumerate(self.tables) if j in plan[c][w][t]] for j in range(self.steps)])
        self.keys: list[list[tuple]] = []
        whose = {c: np.array(pieces[c], np.int32).reshape(-1, 2) for c in self.classes}
        every = np.concatenate([np.concatenate([h, np.zeros(self.steps + 1, np.uint64)]) for _, h in self.items] or [np.zeros(0, np.uint64)])
        base = np.concatenate([[0], np.cumsum([len(h) + self.steps + 1 for _, h in self.items])])
        for w in range(WALKS):
            row = []
            at = {c: np.array([base[k] + o for k, o in pieces[c]]) for c in self.classes}
            found = {c: self.walk(self.symbols(every, w), at[c], w) for c in self.classes}
            for i, (c, _) in enumerate(self.tables):
                key = found[c][i]
                order = np.argsort(key, kind="stable")
                seen = np.zeros(1 << _BITS, bool)
                seen[(key >> np.uint64(64 - _BITS)).astype(np.int64)] = True
                row.append((seen, key[order], order.astype(np.int32), whose[c]))
            self.keys.append(row)

    def walk(self, x: np.ndarray, start: np.ndarray, w: int) -> list[np.ndarray]:
        """The keys in each table of the windows of ``x``, symbols of walk w, that begin at ``start``."""
        pos = start.astype(np.int64)
        out = [np.zeros(len(pos), np.uint64) for _ in self.tables]
        for j in range(self.steps):
            v = x.take(pos)
            for i in self.take[w][j]:
                out[i] *= _M
                out[i] += v
            v >>= np.uint64(j % 61)
            v &= np.uint64(1)
            pos += v.view(np.int64)
        return out

    @staticmethod
    def symbols(h: np.ndarray, w: int) -> np.ndarray:
        return mix(h ^ np.uint64(0xA0761D6478BD642F * (w + 1) % (1 << 64)))

    def candidates(self, h: np.ndarray, start: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """Distinct (item's place, where the item would begin in h) of all matches of keys."""
        known = np.concatenate([[0], np.cumsum(self.vocabulary.find(h) >= 0)])
        enough = np.zeros(len(start), bool)
        for c in self.classes:
            enough |= known[np.minimum(start + CLASSES[c], len(h))] - known[start] >= self.least[c]
        start, out = start[enough], []
        padded = np.concatenate([h, np.zeros(self.steps + 1, np.uint64)])
        for w in range(WALKS):
            x = self.symbols(padded, w)
            for a in range(0, len(start), block):
                out += self._match(x, start[a : a + block], w)
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def _match(self, x: np.ndarray, start: np.ndarray, w: int) -> list[np.ndarray]:
        keys = self.walk(x, start, w)
        out = []
        for i, (seen, key, order, whose) in enumerate(self.keys[w]):
            k = keys[i]
            maybe = np.flatnonzero(seen.take((k >> np.uint64(64 - _BITS)).view(np.int64)))
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(key, k[maybe], "left"), np.searchsorted(key, k[maybe], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            who = whose[order[at]].astype(np.int64)
            out.append(np.column_stack([who[:, 0], np.repeat(start[maybe], n) - who[:, 1]]))
        return out


def verify(item: np.ndarray, h: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least edit distance, where the best stretch ends) of the item and any stretch of h around each of ``begin``
    within [low, high). Distances over what is allowed are only known to be so."""
    n, k = len(item), allowed(len(item))
    width = n + 4 * k + 2 * STRIDE
    first = begin - 2 * k - STRIDE
    at = first[:, None] + np.arange(width)
    inside = (at >= low[:, None]) & (at < high[:, None])
    far = np.full(len(begin), n + 1)
    stop = np.zeros(len(begin), np.int64)
    words = h[np.clip(at, 0, max(len(h) - 1, 0))] if len(h) else np.zeros(at.shape, np.uint64)
    ranks = np.sort(item)
    place = np.minimum(np.searchsorted(ranks, words), n - 1)
    shared = ((ranks[place] == words) & inside).sum(1)
    for rows in np.array_split(np.flatnonzero(shared >= n - k), max(1, len(begin) // 4096)):
        if not len(rows):
            continue
        d = np.zeros((len(rows), width + 1), np.int32)
        step = np.arange(width + 1, dtype=np.int32)
        for i in range(n):
            differs = (words[rows] != item[i]) | ~inside[rows]
            new = np.empty_like(d)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(d[:, :-1] + differs, d[:, 1:] + 1)
            d = np.minimum.accumulate(new - step, axis=1) + step
        best = d.argmin(1)
        far[rows] = d[np.arange(len(rows)), best]
        stop[rows] = first[rows] + best
    return far, stop


def _blocks(items: DataFrame) -> list[list[tuple[int | None, str]]]:
    words = F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))  # nearly those of LETTERS: enough for a size
    rows = items.where("text is not null").select("item_id", "text")
    n = -(-(rows.agg(F.sum(words).alias("n")).first().n or 0) // BLOCK) or 1
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [sorted(((r.item_id, r.text) for r in (rows.where(part == b) if n > 1 else rows).collect()), key=order) for b in range(n)]


def hits(part: pa.RecordBatch, indexes: list[Index], text: str) -> tuple[np.ndarray, list]:
    """((row, place in the list of items, distance, word where the best stretch ends) of each match in the batch, best
    of each pair; the list of items)."""
    words = Words(part.column(text), table=LETTERS)
    h = words.hashes()
    items = [x for index in indexes for x in index.items]
    out, base = [np.zeros((0, 4), np.int64)], 0
    for index in indexes:
        if len(h) and index.items:
            found = _hits(words, h, index)
            found[:, 1] += base
            out.append(found)
        base += len(index.items)
    return np.concatenate(out), items


def _hits(words: Words, h: np.ndarray, index: Index) -> np.ndarray:
    per = -(-words.n // index.stride)
    doc = np.repeat(np.arange(words.docs), per)
    start = words.first[doc] + index.stride * (np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per))
    found = index.candidates(h, start)
    out = [np.zeros((0, 4), np.int64)]
    cuts = np.flatnonzero(np.diff(found[:, 0], prepend=-1, append=-1)) if len(found) else np.zeros(0, int)
    for a, b in zip(cuts, cuts[1:]):
        k, begin = int(found[a, 0]), found[a:b, 1]
        n = len(index.items[k][1])
        # The window lies in one document, but its item may begin before that document does.
        home = [np.searchsorted(words.first, np.clip(at, 0, len(h) - 1), "right") - 1 for at in (begin, begin + n // 2)]
        other = np.flatnonzero(home[0] != home[1])
        for at, who in ((begin, home[1]), (begin[other], home[0][other])):
            if len(at):
                far, stop = verify(index.items[k][1], h, at, words.first[who], words.first[who + 1])
                good = far <= allowed(n)
                out.append(np.column_stack([who[good], np.full(good.sum(), k), far[good], stop[good] - words.first[who[good]]]))
    every = np.concatenate(out)
    every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
    keep = np.ones(len(every), bool)
    keep[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    return every[keep]


def _index(block: list[tuple[int, str]]) -> list[Index]:
    """Short items have a closer stride: an offset of a few words would leave too little of them."""
    words = Words(pa.array([t for _, t in block], pa.string()), table=LETTERS)
    h = words.hashes()
    items = [(i, h[a:b]) for (i, _), a, b in zip(block, words.first, words.first[1:])]
    return [Index([x for x in items if len(x[1]) >= SHORT]), Index([x for x in items if len(x[1]) < SHORT], SHORT_STRIDE)]


_built: dict[str, list[Index]] = {}


def _kept(name: str, shared) -> list[Index]:
    """The index of a block, built once in each Python worker; one block's at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = _index(shared.value)
    return _built[name]


def matches(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word): the best match of each text and item."""
    schema = "doc_id bigint, item_id bigint, distance int, item_words int, end_word bigint"
    rows, out = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), None
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # about BLOCK words

        def run(batches, shared=shared, name=uuid.uuid4().hex):
            index = _kept(name, shared)
            for batch in batches:
                for part in slices(batch, "text", CHUNK):
                    m, items = hits(part, index, "text")
                    which = [items[k] for k in m[:, 1]]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(m[:, 0])), pa.array([i for i, _ in which], pa.int64()), pa.array(m[:, 2].astype(np.int32)), pa.array([len(h) for _, h in which], pa.int32()), pa.array(m[:, 3])],
                        ["doc_id", "item_id", "distance", "item_words", "end_word"],
                    )

        found = map_arrow(rows, run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns as they were."""
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # about BLOCK words

        def run(batches, shared=shared, name=uuid.uuid4().hex):
            index = _kept(name, shared)
            for batch in batches:
                for part in slices(batch, text, CHUNK):
                    keep = np.ones(part.num_rows, bool)
                    keep[hits(part, index, text)[0][:, 0]] = False
                    yield part.filter(pa.array(keep))

        docs = map_arrow(docs, run, docs.schema)
    return docs
