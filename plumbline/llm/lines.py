"""Line dedup by an exact set-similarity join.

A line (split at \\n, with at least one word) is the set of its distinct words ``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased; two lines match if the Jaccard similarity of their sets is 0.8 or more. A line is removed if it matches
an earlier one, by doc_id (null last), then by the text's hash, then by place. So of equal sets only the first line
can stay, and it stays unless some other set that it matches occurs first; the join needs each distinct set once.

Words are ordered by rarity (as the tasks' counts tell, without words that a task has once): words outside the ``HOT`` most frequent ones first, by hash, then the frequent ones by
rising count. Any fixed order gives the same matches; rarity keeps the lists short. With s words, a set is looked up
by its first s - ceil(0.8 s) + 1 words and is filed under its first s - ceil(8/9 s) + 1 ones, which is enough to meet
every set of its own size or larger. Pairs that share such a word must pass the length filter, the positional filter
(no more common words than what is left behind the shared places) and a filter by 256-bit sketches: the bits in which
the exclusive or of two sketches differ are no more than the words in which the sets differ. All are lossless.

A first round over the prefixes of all distinct sets tells which sets have a pair that passes; a second one, over those
sets with all their words, verifies the pairs. A pair is verified where it meets first, at the first word by rarity that
both have, so it counts once. No pair leaves a task: what does is each set's number of matches and the earliest of them, so
a family of n similar lines moves and stores in proportion to n.

Sets and postings (a set under one word of its prefix) travel as packed blobs, one row for each bucket and batch, so
the shuffles move few rows; each bucket's pairs are formed by numpy in pieces of bounded size. A word that has too many
postings for one task is dealt over cells: pairs of blocks of its sets, each a task's work of its own.

The texts are read three times: for the counts of words, for the sets, and for the complete words of those sets that
the first round found (by a bitmap of fixed size; where it is full, more sets are taken along, none is missed).

Sets of up to 3 words match equal sets only and are neither filed nor looked up. Sets are told apart by a 64-bit hash.

Edge cases: null, empty and blank texts have no lines to remove and a row of their own in summary(); lines without
words stay; rows that repeat a doc_id and a text are one document and lose the same lines; an empty table gives an
empty result; extra columns pass through remove(), and are ignored by summary().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import textstats as ts
from plumbline.llm.counts import Lookup, frequent, word_counts
from plumbline.llm.text import Words, map_arrow, mix, slices, tasks_for
from plumbline.plans.lineage import cut

HOT = 1 << 17
#: In how many parts the postings of the two rounds are taken, one after the other.
SLICES, WHOLE_SLICES = 4, 3
SIMILARITY = 0.8  # written out as 4/5 and 8/9 below
#: Postings of one task, and of one cell of a word that has more.
TASK = 400_000
CELL = 2000
_SLOTS = 4096  # in which the postings of words are counted: a word with over 1/1000 of all is seen
_FLUSH = 1 << 16  # sets that a task packs together
_PAIRS = 1 << 20  # pairs that are formed at once
_WORDS = 1 << 22  # words that are compared at once
_BITMAP = 25  # the bitmap of sets to verify: 2 ** 25 bits, 4 MB


def _within(line: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by (line, upper 44 bits of key)."""
    if len(line) and line[-1] >= 1 << 20:
        return np.lexsort((key >> np.uint64(20), line))
    return np.argsort((line.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    total = np.cumsum(count)
    return np.repeat(begin - (total - count), count) + np.arange(total[-1] if len(total) else 0)


class Sets:
    """The lines of a chunk of texts as sets of distinct words, each in ascending order of (line, hash)."""

    def __init__(self, column: pa.Array):
        w = Words(column)
        self.doc, start, end = ts.lines(w)
        first = np.searchsorted(w.start, start)
        last = np.searchsorted(w.start, end)
        line = np.repeat(np.arange(len(start)), last - first)
        h = w.hashes()
        order = _within(line, h)
        h, line = h[order], line[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.h, self.line = h[new], line[new]
        self.first = np.searchsorted(self.line, np.arange(len(start) + 1))
        self.size = np.diff(self.first)
        self.key = mix(self.total(self.h) + self.size.astype(np.uint64))
        breaks = np.flatnonzero(w.data == 10)
        self.place = np.searchsorted(breaks, start) - np.searchsorted(breaks, w.offsets)[self.doc]  # of the line in its text, from 0, lines without words included
        self.docs = w.docs
        self.text_hash = ts.span_hashes(w, w.offsets[:-1], w.offsets[1:])

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first[:-1]) if len(self.size) else np.zeros(0, x.dtype)  # no line is empty


def _texts(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))


_HEAD = np.dtype([("key", np.uint64), ("sketch", np.uint64, 4), ("size", np.int32), ("m", np.int32), ("n", np.int64), ("d", np.int64), ("k", np.int64), ("place", np.int64)])
_POSTING = np.dtype([("set", np.int32), ("word", np.uint32), ("i", np.int32)])


class Packed:
    """Distinct sets. head: key, sketch, size, m words in ``words``, in n lines, the first of them (d, k, place)."""

    def __init__(self, head: np.ndarray, words: np.ndarray):
        self.head, self.words = head, words

    def begin(self) -> np.ndarray:
        return np.cumsum(self.head["m"], dtype=np.int64) - self.head["m"]

    def take(self, at: np.ndarray) -> Packed:
        return Packed(self.head[at], self.words[ranges(self.begin()[at], self.head["m"][at].astype(np.int64))])

    def blob(self) -> bytes:
        return np.array([len(self.head), self.words.itemsize], np.int64).tobytes() + self.head.tobytes() + self.words.tobytes()

    @staticmethod
    def of(blob: bytes) -> Packed:
        n, size = np.frombuffer(blob, np.int64, 2).tolist()
        head = np.frombuffer(blob, _HEAD, n, 16)
        return Packed(head, np.frombuffer(blob, np.uint64 if size == 8 else np.uint32, -1, 16 + head.nbytes))

    @staticmethod
    def join(parts: list[Packed]) -> Packed:
        return Packed(np.concatenate([p.head for p in parts]), np.concatenate([p.words for p in parts]))

    def distinct(self) -> Packed:
        """Equal keys as one set: their lines added up, the first of their first lines."""
        h = self.head
        order = np.lexsort((h["place"], h["k"], h["d"], h["key"]))
        first = np.flatnonzero(np.append(True, h["key"][order][1:] != h["key"][order][:-1])) if len(h) else np.zeros(0, np.int64)
        out = self.take(order[first])
        out.head["n"] = np.add.reduceat(h["n"][order], first) if len(h) else out.head["n"]
        return out


def _ranks(hot: tuple[np.ndarray, np.ndarray]) -> tuple[Lookup, np.ndarray]:
    hot_h, hot_c = hot
    rank = np.empty(len(hot_h) + 1, np.int64)
    rank[np.argsort(hot_c, kind="stable")] = np.arange(1, len(hot_h) + 1)
    rank[-1] = 0
    return Lookup(hot_h), rank


def prefix(size: np.ndarray) -> np.ndarray:
    """How many words a set is looked up by; sets of up to 3 words by none."""
    return np.where(size > 3, size - -(-4 * size // 5) + 1, 0)


def _pack(s: Sets, doc_id: np.ndarray, ranks: tuple[Lookup, np.ndarray], lines: np.ndarray, whole: bool) -> Packed:
    """The sets of ``lines``, with all words (64 bits each), or with those of the prefix (32 bits, enough to meet), by
    rarity. A word's bit in the sketch is told by its lowest six bits and its two highest, by which a line's words are in order."""
    lookup, rank = ranks
    head = np.zeros(len(lines), _HEAD)
    size = s.size[lines]
    at = ranges(s.first[lines], size) if len(lines) < len(s.size) else np.arange(len(s.h))
    h, line = s.h[at], np.repeat(np.arange(len(lines)), size)
    begin = np.cumsum(size) - size
    head["key"], head["size"], head["n"], head["place"] = s.key[lines], size, 1, s.place[lines]
    head["k"] = s.text_hash[s.doc[lines]].view(np.int64)
    head["d"] = doc_id[s.doc[lines]]
    part = (line << 2) | (h >> np.uint64(62)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    sketch = np.zeros(4 * len(lines), np.uint64)
    if len(h):
        sketch[part[first]] = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), first)
    head["sketch"] = sketch.reshape(-1, 4)
    head["m"] = size if whole else prefix(size)
    # Words of a line are in the order of their hashes, so the place breaks ties as the hash would.
    place = np.arange(len(h)) - begin[line]
    order = _within(line, (rank[lookup.find(h)].astype(np.uint64) << np.uint64(46)) | (place.astype(np.uint64) << np.uint64(20)))
    words = h[order[ranges(begin, head["m"].astype(np.int64))]]
    return Packed(head, words if whole else (words >> np.uint64(32)).astype(np.uint32))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


_LAST = (1 << 63) - 1  # null ids come last


def _dealt(sets: Packed, buckets: int) -> pa.RecordBatch:
    """(bucket, blob) by the keys modulo ``buckets``."""
    where = (sets.head["key"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([sets.take(order[edges[b] : edges[b + 1]]).blob() for b in full], pa.binary())], ["bucket", "blob"])


def distinct_sets(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(blob, n): all sets, each once, with their prefixes; n: postings of the blob. One pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # HOT words

    def run(batches):
        ranks, waiting, n = _ranks(shared.value), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(part.column("text"))
                waiting.append(_pack(s, _ids(part.column("doc_id")), ranks, np.arange(len(s.size)), False))
                n += len(s.size)
                if n >= _FLUSH:
                    yield _dealt(Packed.join(waiting).distinct(), buckets)
                    waiting, n = [], 0
        if n:
            yield _dealt(Packed.join(waiting).distinct(), buckets)

    return _merged(map_arrow(docs, run, "bucket int, blob binary"), buckets)


def _merged(dealt: DataFrame, buckets: int) -> DataFrame:
    """(blob, n) of the rows (bucket, blob): each set once. A bucket's sets are as many as a task's share."""

    def run(batches):
        blobs = [Packed.of(b) for batch in batches for b in batch.column("blob").to_pylist()]
        if blobs:
            sets = Packed.join(blobs).distinct()
            for a in range(0, len(sets.head), _FLUSH):
                part = sets.take(np.arange(a, min(a + _FLUSH, len(sets.head))))
                yield pa.RecordBatch.from_arrays([pa.array([part.blob()], pa.binary()), pa.array([int(prefix(part.head["size"]).sum())], pa.int64())], ["blob", "n"])

    return map_arrow(dealt.repartition(buckets, "bucket"), run, "blob binary, n bigint")


def _prefix_words(sets: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, word of 32 bits, place) of each posting."""
    n = prefix(sets.head["size"]).astype(np.int64)
    who = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    words = sets.words[sets.begin()[who] + i]
    return who, words if words.itemsize == 4 else (words >> np.uint64(32)).astype(np.uint32), i


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many postings the words of each of _SLOTS slots have."""

    def run(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for b in batch.column("blob").to_pylist():
                total += np.bincount(_prefix_words(Packed.of(b))[1] % np.uint32(_SLOTS), minlength=_SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLOTS), pa.int32()), pa.array(total)], ["slot", "n"])

    out = np.zeros(_SLOTS, np.int64)
    for r in map_arrow(sets.select("blob"), run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # _SLOTS rows
        out[r.slot] = r.n
    return out


#: A posting of the first round has all that the filters need.
_FLAT = np.dtype([("word", np.uint32), ("i", np.int32), ("size", np.int32), ("key", np.uint64), ("sketch", np.uint64, 4)])


def postings(sets: DataFrame, blocks: np.ndarray, buckets: int, k: int, of_slices: int, whole: bool) -> DataFrame:
    """(bucket, cell, sets, posts) of the words whose hash is k modulo ``of_slices``; ``sets`` is null if not ``whole``.
    ``blocks``: into how many blocks the sets of a slot's words are dealt; a cell is a pair of blocks, -1 if there is one
    block only."""

    def rows(sets, who, word, i, where, cell):
        order = np.argsort(where)
        who, word, i = who[order], word[order], i[order]
        edges = np.searchsorted(where[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        heads, posts = None, []
        if whole:
            heads = []
            for b in full:
                at = slice(edges[b], edges[b + 1])
                used, mine = np.unique(who[at], return_inverse=True)
                p = np.empty(len(mine), _POSTING)
                p["set"], p["word"], p["i"] = mine, word[at], i[at]
                heads.append(sets.take(used).blob())
                posts.append(p.tobytes())
        else:
            p = np.empty(len(who), _FLAT)
            p["word"], p["i"] = word, i
            for c in ("size", "key", "sketch"):
                p[c] = sets.head[c][who]
            raw = memoryview(p).cast("B") if len(p) else b""
            posts = [bytes(raw[edges[b] * _FLAT.itemsize : edges[b + 1] * _FLAT.itemsize]) for b in full]
        heads = pa.array(heads, pa.binary()) if whole else pa.nulls(len(full), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), cell), pa.int64()), heads, pa.array(posts, pa.binary())], ["bucket", "cell", "sets", "posts"])

    def run(batches):
        for batch in batches:
            for b in batch.column("blob").to_pylist():
                sets = Packed.of(b)
                who, word, i = _prefix_words(sets)
                at = np.flatnonzero(word % np.uint32(of_slices) == k)
                who, word, i = who[at], word[at], i[at]
                where = (mix(word.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                of = blocks[word % np.uint32(_SLOTS)]
                cold = of == 1
                if cold.any():
                    yield rows(sets, who[cold], word[cold], i[cold], where[cold], -1)
                for n in np.unique(of[~cold]):
                    some = np.flatnonzero(of == n)
                    block = (sets.head["key"][who[some]] % np.uint64(n)).astype(np.int64)
                    for a in range(n):
                        for c in range(a, n):
                            mine = some[(block == a) | (block == c)]
                            if len(mine):
                                yield rows(sets, who[mine], word[mine], i[mine], where[mine], (int(n) << 40) | (a << 20) | c)

    return map_arrow(sets.select("blob"), run, "bucket int, cell bigint, sets binary, posts binary")


def _meet(word: np.ndarray, size: np.ndarray, i: np.ndarray, key: np.ndarray, sketch: np.ndarray, cell: int, once: bool):
    """(postings of the smaller set, of the larger one) of pairs that pass the filters, in pieces. ``once``: only where a
    pair's first common word may be."""
    order = np.argsort((word.astype(np.uint64) << np.uint64(32)) | size.astype(np.uint64))
    word, size, i, key, sketch = word[order], size[order].astype(np.int64), i[order].astype(np.int64), key[order], sketch[order]
    filed = i < size - -(-8 * size // 9) + 1
    group = np.cumsum(np.append(True, word[1:] != word[:-1])) - 1
    # Where in the group the sizes from a set's own to 5 / 4 of it are.
    at = (group << 32) | size
    x = np.flatnonzero(filed & (np.bincount(group)[group] > 1))
    low, high = np.searchsorted(at, at[x], "left"), np.searchsorted(at, (group[x] << 32) | (size[x] * 5 // 4), "right")
    many = high - low > 1
    x, low, count = x[many], low[many], (high - low)[many]
    block = (key % np.uint64(cell >> 40)).astype(np.int64) if cell >= 0 else None
    across = cell >= 0 and (cell >> 20) & 0xFFFFF != cell & 0xFFFFF
    total, edge = np.cumsum(count), 0
    while edge < len(x):
        to = max(edge + 1, int(np.searchsorted(total, (total[edge - 1] if edge else 0) + _PAIRS, "right")))
        a, y = np.repeat(x[edge:to], count[edge:to]), ranges(low[edge:to], count[edge:to])
        edge = to
        near = (size[a] < size[y]) | ((size[a] == size[y]) & (key[a] < key[y]))
        if across:
            near &= block[a] != block[y]
        a, y = a[near], y[near]
        sizes, left = size[a] + size[y], np.minimum(size[a] - i[a], size[y] - i[y])
        near = 9 * (left if once else left + np.minimum(i[a], i[y])) >= 4 * sizes
        far = np.bitwise_count(sketch[a[near]] ^ sketch[y[near]]).sum(1, dtype=np.int64)
        near[near] = 9 * far <= sizes[near]
        if near.any():
            yield order[a[near]], order[y[near]]


def common(words: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How many words the stretches of n_a words from a and of n_b words from b on share, for each pair."""
    out = np.zeros(len(a), np.int64)
    total, at = np.cumsum(n_a + n_b), 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _WORDS, "right")))
        pair = np.concatenate([np.repeat(np.arange(to - at), n[at:to]) for n in (n_a, n_b)])
        w = np.concatenate([words[ranges(s[at:to], n[at:to])] for s, n in ((a, n_a), (b, n_b))])
        order = _within(pair, w) if len(pair) and pair.max() < 1 << 20 else np.lexsort((w, pair))
        pair, w = pair[order], w[order]
        twice = (w[1:] == w[:-1]) & (pair[1:] == pair[:-1])
        out[at:to] = np.bincount(pair[1:][twice], minlength=to - at)
        at = to
    return out


def _by_cell(batches) -> dict[int, list]:
    """The blobs of postings() by cell: (sets, posts)."""
    found: dict[int, list] = {}
    for batch in batches:
        for c, s, p in zip(*[batch.column(name).to_pylist() for name in ("cell", "sets", "posts")]):
            found.setdefault(c, []).append((s, p))
    return found


def _rounds(sets: DataFrame, buckets: int, cell: int, whole: bool, run, schema: str) -> DataFrame:
    """``run`` over the cells of all postings, a slice after the other."""
    n = slot_counts(sets)
    total = int(n.sum())
    most = max(cell, 4 * total // _SLOTS)
    blocks = np.where(n > most, -(-n // max(most // 2, 1)), 1)
    of_slices = WHOLE_SLICES if whole else SLICES
    tasks = max(buckets, -(-total // (TASK * of_slices)))
    out = None
    for k in range(of_slices):
        part = cut(map_arrow(postings(sets, blocks, tasks, k, of_slices, whole).repartition(tasks, "bucket", "cell"), run, schema))
        out = part if out is None else out.unionByName(part)
    return out


def candidates(sets: DataFrame, buckets: int, cell: int = CELL) -> DataFrame:
    """(key) of sets that the filters cannot tell apart from another one; a key may come repeatedly."""

    def run(batches):
        for c, blobs in _by_cell(batches).items():
            p = np.concatenate([np.frombuffer(b, _FLAT) for _, b in blobs])
            key, hit = np.ascontiguousarray(p["key"]), np.zeros(len(p), bool)
            for a, y in _meet(p["word"], p["size"], p["i"], key, np.ascontiguousarray(p["sketch"]), c, False):
                hit[a] = True
                hit[y] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[hit]).view(np.int64))], ["key"])

    return _rounds(sets, buckets, cell, False, run, "key bigint")


_LINK = "key bigint, n bigint, d bigint, k bigint, place bigint, n_links bigint, other_d bigint, other_k bigint, other_place bigint"


def links(sets: DataFrame, buckets: int, cell: int = CELL) -> DataFrame:
    """For sets with all their words, rows of (a set and its first line, matches that a cell found, the earliest)."""

    def run(batches):
        for c, blobs in _by_cell(batches).items():
            sets = [Packed.of(s) for s, _ in blobs]
            p = np.concatenate([np.frombuffer(b, _POSTING) for _, b in blobs])
            base = np.cumsum([0, *[len(s.head) for s in sets[:-1]]])
            who = p["set"] + np.repeat(base, [len(b) // _POSTING.itemsize for _, b in blobs])
            sets = Packed.join(sets)
            h, begin, i, size = sets.head, sets.begin(), p["i"].astype(np.int64), sets.head["size"].astype(np.int64)
            found = []
            for a, y in _meet(p["word"], h["size"][who], i, h["key"][who], h["sketch"][who], c, True):
                x_, y_ = who[a], who[y]
                # 32 bits of two words may agree where the words do not.
                new = sets.words[begin[x_] + i[a]] == sets.words[begin[y_] + i[y]]
                x_, y_, a, y = x_[new], y_[new], a[new], y[new]
                new = common(sets.words, begin[x_], i[a], begin[y_], i[y]) == 0
                x_, y_ = x_[new], y_[new]
                good = 9 * common(sets.words, begin[x_], size[x_], begin[y_], size[y_]) >= 4 * (size[x_] + size[y_])
                found.append(_tally(h, x_[good], y_[good]))
            if found:
                t = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t[c]).view(np.int64)) for c in t.dtype.names], list(t.dtype.names))

    return _rounds(sets, buckets, cell, True, run, _LINK)


_TALLY = np.dtype([(c.split()[0], np.int64) for c in _LINK.split(", ")])


def _tally(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each set in x or y: how often, and the earliest first line among its partners."""
    one, other = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.lexsort((h["place"][other], h["k"][other], h["d"][other], h["key"][one]))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.append(True, h["key"][one][1:] != h["key"][one][:-1])) if len(one) else np.zeros(0, np.int64)
    out = np.empty(len(first), _TALLY)
    a, b = h[one[first]], h[other[first]]
    out["key"], out["n_links"] = a["key"].view(np.int64) if len(a) else 0, np.diff(np.append(first, len(one)))
    for c in ("n", "d", "k", "place"):
        out[c] = a[c]
    for c in ("d", "k", "place"):
        out[f"other_{c}"] = b[c]
    return out


def bitmap(keys: DataFrame) -> np.ndarray:
    """2 ** _BITMAP bits: those of the keys' first bits are set."""
    slot = F.shiftrightunsigned("key", 64 - _BITMAP)
    bits = keys.select(slot.alias("slot")).select(F.expr("shiftrightunsigned(slot, 6)").alias("at"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    t = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (_BITMAP - 6) rows at most
    out = np.zeros(1 << (_BITMAP - 6), np.uint64)
    out[t.column("at").to_numpy()] = t.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


_READ = "doc_id bigint, k bigint, keys array<bigint>, places array<bigint>, bucket int, blob binary"


def read(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, buckets: int) -> DataFrame:
    """In one pass over the texts, rows of two kinds. (doc_id, k, keys, places) of each document; k: the text's hash.
    (bucket, blob): the sets of over 3 words that ``wanted``, a bitmap(), has, with all their words."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, wanted))  # HOT words, 4 MB
    names = ["doc_id", "k", "keys", "places", "bucket", "blob"]

    def run(batches):
        hot, wanted = shared.value
        ranks, waiting, n = _ranks(hot), [], 0

        def flush():
            batch = _dealt(Packed.join(waiting).distinct(), buckets)
            none = [pa.nulls(len(batch), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*none, *batch.columns], names)

        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(part.column("text"))
                slot = s.key >> np.uint64(64 - _BITMAP)
                hit = (wanted[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                lines = np.flatnonzero(hit & (s.size > 3))
                if len(lines):
                    waiting.append(_pack(s, _ids(part.column("doc_id")), ranks, lines, True))
                    n += len(lines)
                begin = pa.array(np.searchsorted(s.doc, np.arange(s.docs + 1)).astype(np.int32))
                keys, places = pa.ListArray.from_arrays(begin, pa.array(s.key.view(np.int64))), pa.ListArray.from_arrays(begin, pa.array(s.place))
                none = [pa.nulls(s.docs, pa.int32()), pa.nulls(s.docs, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s.text_hash.view(np.int64)), keys, places, *none], names)
                if n >= _FLUSH:
                    yield flush()
                    waiting, n = [], 0
        if n:
            yield flush()

    return map_arrow(docs, run, _READ)


def _repeated(sets: DataFrame) -> DataFrame:
    """(key, n, d, k, place) of the sets of two lines or more."""

    def run(batches):
        for batch in batches:
            for b in batch.column("blob").to_pylist():
                h = Packed.of(b).head
                h = h[h["n"] > 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[c]).view(np.int64)) for c in ("key", "n", "d", "k", "place")], ["key", "n", "d", "k", "place"])

    return map_arrow(sets.select("blob"), run, "key bigint, n bigint, d bigint, k bigint, place bigint")


def _judged(docs: DataFrame, hot_words: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, k, keys, places) of each document, (key, n, first, n_links, late) of each set that occurs twice or more
    or matches another)."""
    buckets = tasks_for(docs)
    hot = frequent(word_counts(docs, least=2), hot_words)
    sets = cut(distinct_sets(docs, hot, buckets))
    wanted, repeated = bitmap(candidates(sets, buckets, cell)), cut(_repeated(sets))
    del sets  # the second round needs the space
    found = cut(read(docs, hot, wanted, buckets))
    whole = cut(_merged(found.where("bucket is not null").select("bucket", "blob"), buckets))
    matched = links(whole, buckets, cell)
    line = lambda p="": F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("d", "k", "place")])
    rows = matched.select("key", "n", line().alias("first"), "n_links", line("other_").alias("other"))
    rows = rows.unionByName(repeated.select("key", "n", line().alias("first"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("struct<d:bigint,k:bigint,place:bigint>").alias("other")))
    judged = rows.groupBy("key").agg(F.max("n").alias("n"), F.min("first").alias("first"), F.sum("n_links").alias("n_links"), F.min("other").alias("other"))
    late = F.coalesce(F.col("other") < F.col("first"), F.lit(False))
    return found.where("bucket is null").drop("bucket", "blob"), cut(judged.select("key", "n", "first", "n_links", late.alias("late")))


def _by_key(lines: DataFrame, judged: DataFrame, busy: int) -> DataFrame:
    """The join by key. Sets of over ``busy`` lines, and of over 1 / 5000 of all, are broadcast (5,000 at most), so no
    task gets all lines of a frequent set."""
    total = judged.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(busy, total // 5000)
    few = F.broadcast(judged.where(often))
    rare = lines.join(F.broadcast(judged.where(often).select("key")), "key", "left_anti")
    return rare.join(judged.where(~often), "key").unionByName(lines.join(few, "key"))


def summary(docs: DataFrame, text: str = "text", id: str = "doc_id", hot_words: int = HOT, cell: int = CELL, busy: int = 1000) -> DataFrame:
    """(doc_id, text_hash, n_lines, line_classes, n_links, removed_lines) of each document (rows that share doc_id and
    text are one). line_classes: the class (the set's hash in hex) of each line that has a word, by place; n_links: other classes that
    its lines match, summed over its lines; removed_lines: places, ascending."""
    texts, judged = _judged(_texts(docs, text, id), hot_words, cell)
    texts = cut(texts.groupBy("doc_id", "k").agg(F.first("keys").alias("keys"), F.first("places").alias("places")))
    lines = texts.select("doc_id", "k", F.explode(F.arrays_zip("keys", "places")).alias("l")).select("doc_id", "k", F.col("l.keys").alias("key"), F.col("l.places").alias("place"))
    own = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.col("k"), F.col("place"))
    marked = _by_key(lines, judged, busy).select("doc_id", "k", "n_links", F.when(F.col("late") | (own != F.col("first")), F.col("place")).alias("place"))
    marked = marked.groupBy(F.col("doc_id").alias("__id"), F.col("k").alias("__k")).agg(F.sum("n_links").alias("n_links"), F.sort_array(F.collect_list("place")).alias("removed"))
    out = texts.join(marked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__k")), "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", F.col("k").alias("text_hash"), F.size("keys").cast("long").alias("n_lines"), F.transform("keys", lambda k: F.lower(F.lpad(F.hex(k), 16, "0"))).alias("line_classes"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("removed", none).alias("removed_lines"))


def remove(docs: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the texts' matching lines removed, all else as it was."""
    late = summary(docs, text, id, **options).where(F.size("removed_lines") > 0)
    late = late.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__k"), "removed_lines")
    keyed = with_text_hash(docs, text)
    same = F.col(id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__k"))
    pieces = F.split(F.col(text), "\n")
    kept = F.filter(pieces, lambda x, i: ~F.array_contains("removed_lines", i.cast("long")))
    new = F.when(F.col("removed_lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return keyed.join(late, same, "left").withColumn(text, new).drop("__id", "__k", "__hash", "removed_lines")


def with_text_hash(docs: DataFrame, text: str) -> DataFrame:
    schema = T.StructType([*docs.schema, T.StructField("__hash", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                w = Words(part.column(text))
                h = ts.span_hashes(w, w.offsets[:-1], w.offsets[1:])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h.view(np.int64))], schema.fieldNames())

    return map_arrow(docs, run, schema)
