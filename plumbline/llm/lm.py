"""Scoring whole documents with a gated recurrent language model.

Counts: every training document gives its words (A-Z lower-cased) and one end; N tokens, V distinct, c of each.

Model: the ``WORDS`` most frequent tokens (the end always) and ``unknown`` are the vocabulary of a GRU with a
class-factored softmax. A word outside of it has the probability of ``unknown`` times its add-one share among all
words outside: (c + 1) / (N' + V' + 1), so the model is a distribution over the same tokens as the base score. A
document's score is the sum over all its tokens, end included, its state being carried from window to window.

Training: truncated backpropagation in numpy, on every training document. Texts are sent as word numbers to shards of
about ``SHARD_TOKENS`` tokens by a hash of the text; equal texts are learned from once with their number as weight, so
copies make no shard large. A first model is trained in one task on about ``WARM_DOCS`` texts, those with the smallest
hashes; from it, every shard trains its own on all of its texts, in the order of their hashes, and the mean of all,
weighted by tokens, is the model. Means are taken by rounds of ``FAN`` shards, so no task and not the driver gets all of
them. Shards, order and means depend on the texts alone, so partitioning and lost executors change nothing.

Scoring is one pass over the texts. Counts of the ``HOT`` most frequent words are broadcast; a text's other words are
joined with the table of counts by their hash, so no table that grows with the vocabulary is broadcast.

Words are told apart by a 64-bit hash. Repeated copies of a document count as often as they occur.

Edge cases: null and empty texts have the end as their only token; null ids are not held out (no remainder) and
train; a repeated row is scored for itself; with no training documents every token has probability one by the base
(N = V = 0) and the model's initial weights score; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import gru
from plumbline.llm.counts import Lookup, frequent, word_counts
from plumbline.llm.text import Words, map_arrow, slices, span_hashes
from plumbline.plans.lineage import cut

WORDS = 1022
HIDDEN = 16
HOT = 1 << 17
WARM_DOCS = 600
WARM_PASSES = 3
RATE, RATE_AFTER = 1e-2, 4e-3
FAN = 64
SEED = 11
#: Not the hash of any word that is likely to occur.
END = 0x6A09E667F3BCC908
CHUNK_TOKENS = 1_000_000
SHARD_TOKENS = 4_000_000
#: Longer texts are learned from in pieces, each from a state of zeros, as a text's steps follow one another.
PIECE = 4096
_LN10 = math.log(10)


@dataclass
class Vocabulary:
    """Numbers by falling count; hashes of the known words sorted, and the number of each."""

    hashes: np.ndarray
    number: np.ndarray
    unknown: int
    end: int
    counts: np.ndarray

    def __post_init__(self):
        self.lookup = Lookup(self.hashes, 16)
        self.classes = gru.classes_of(len(self.counts))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        at = self.lookup.find(h)
        return np.where(at >= 0, self.number[at], self.unknown).astype(np.int32) if len(self.number) else np.full(len(h), self.unknown, np.int32)

    def texts(self, words: Words) -> list[np.ndarray]:
        ids = self.numbers(words.hashes())
        stop = np.array([self.end], np.int32)
        return [np.concatenate([ids[a:b], stop]) for a, b in zip(words.first, words.first[1:])]


def vocabulary(hot_h: np.ndarray, hot_c: np.ndarray, total: int, ends: int) -> Vocabulary:
    words = np.flatnonzero(hot_h != np.uint64(END))
    best = words[np.lexsort((hot_h[words], -hot_c[words]))][:WORDS]
    h, c = hot_h[best], hot_c[best]
    counts = np.concatenate([c, [total - ends - c.sum(), ends]])  # the last two: unknown, end
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(counts), np.int64)
    place[order] = np.arange(len(counts))
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], place[: len(h)][by_hash], int(place[-2]), int(place[-1]), counts[order])


def _pack(key: np.ndarray, count: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
    return b"".join([np.int64(len(key)).tobytes(), key.tobytes(), count.tobytes(), size.tobytes(), ids.tobytes()])


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(key, count, word numbers) of each distinct text of the blobs, by key."""
    keys, counts, texts = [], [], []
    for b in blobs:
        n = int(np.frombuffer(b, np.int64, 1)[0])
        size = np.frombuffer(b, np.int64, n, 8 + 16 * n)
        keys.append(np.frombuffer(b, np.uint64, n, 8))
        counts.append(np.frombuffer(b, np.int64, n, 8 + 8 * n))
        ids, edge = np.frombuffer(b, np.int16, -1, 8 + 24 * n), np.cumsum(size)
        texts += [ids[e - k : e] for e, k in zip(edge, size)]
    key, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts)), [texts[i] for i in first]


def _pieces(texts: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The texts in pieces of at most PIECE words, with the count of each."""
    out = [[t[a : a + PIECE].astype(np.int32) for a in range(0, len(t), PIECE)] for t in texts]
    return [x for parts in out for x in parts], np.repeat(count, [len(parts) for parts in out])


def encoded(docs: DataFrame, shared, shards: int) -> DataFrame:
    """(shard, blob): the texts as word numbers; each task's equal texts are packed together."""

    def run(batches):
        vocab = shared.value[0]
        keys, texts, tokens = [], [], 0

        def flush():
            key, first, count = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            shard = (key % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            full, blobs = np.flatnonzero(np.diff(edges)), []
            for s in full:
                at = order[edges[s] : edges[s + 1]]
                mine = [texts[i] for i in first[at]]
                blobs.append(_pack(key[at], count[at].astype(np.int64), np.array([len(t) for t in mine], np.int64), np.concatenate(mine)))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                keys.append(span_hashes(words.padded, words.offsets[:-1], np.diff(words.offsets)))
                texts += [t.astype(np.int16) for t in vocab.texts(words)]
                tokens += len(words.start) + words.docs
                if tokens >= CHUNK_TOKENS:
                    yield flush()
                    keys, texts, tokens = [], [], 0
        if texts:
            yield flush()

    return map_arrow(docs.select("text"), run, "shard bigint, blob binary")


def _train(docs: DataFrame, vocab: Vocabulary, p: gru.Params, tokens: int, ends: int) -> gru.Params:
    """``docs``: the rows to learn from, ``tokens`` of them in all and ``ends`` texts."""
    if len(vocab.counts) >= 1 << 15:
        raise ValueError("word numbers have 16 bits")
    context = docs.sparkSession.sparkContext
    size, shards = len(p.flat()), -(-tokens // SHARD_TOKENS)
    shared = context.broadcast((vocab, p))
    sent = cut(encoded(docs, shared, shards))
    least = min((1 << 64) - 1, (WARM_DOCS << 64) // ends)

    def few(batches):
        for batch in batches:
            for b in batch.column("blob").to_pylist():
                key, _, texts = _unpack([b])
                at = np.flatnonzero(key <= np.uint64(least))
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array([texts[i].tobytes() for i in at], pa.binary())], ["key", "ids"])

    def row(shard, n, p):
        flat = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(p.flat().astype(np.float32)))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), flat], ["shard", "n", "p"])

    def warm(batches):
        rows = sorted((k, b) for batch in batches for k, b in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()))
        if rows:
            texts, _ = _pieces([np.frombuffer(b, np.int16) for _, b in rows], np.ones(len(rows)))
            p = shared.value[1].like(shared.value[1].flat())
            adam = gru.Adam(p)
            for k in range(WARM_PASSES):
                gru.train(p, shared.value[0].classes, texts, RATE / (k + 1), adam=adam)
            yield row(0, 1, p)

    schema = "shard bigint, n bigint, p array<float>"
    picked = map_arrow(sent.select("blob"), few, "key bigint, ids binary").groupBy("key").agg(F.first("ids").alias("ids"))
    first = map_arrow(picked.repartition(1), warm, schema).collect()  # one row
    if first:
        p = p.like(np.array(first[0].p, np.float32))
    begun = context.broadcast(p)

    def learn(batches):
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for s, b in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
                found.setdefault(s, []).append(b)
        for s in sorted(found):
            _, count, texts = _unpack(found.pop(s))
            texts, count = _pieces(texts, count)
            length = np.array([len(t) for t in texts], np.int64)
            p = begun.value.like(begun.value.flat())
            adam, edge = gru.Adam(p), np.cumsum(length)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + CHUNK_TOKENS, "right")))
                gru.train(p, shared.value[0].classes, texts[at:to], RATE_AFTER, adam=adam, weight=count[at:to])
                at = to
            yield row(s, int(count @ length), p)

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        n = t.column("n").to_numpy()
        out, share = np.zeros(size, np.float32), (n / n.sum()).astype(np.float32)
        for x, w in zip(t.column("p"), share):
            out += np.asarray(x.values.to_numpy()) * w
        lists = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(out))
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py() // FAN], pa.int64()), "n": pa.array([n.sum()]), "p": lists})

    models = cut(map_arrow(sent.repartition(shards, "shard"), learn, schema))
    while True:
        models = cut(models.groupBy(F.floor(F.col("shard") / FAN).alias("g")).applyInArrow(mean, schema))
        shards = -(-shards // FAN)
        if shards == 1:
            return p.like(np.array(models.first().p, np.float32))


def score(docs: DataFrame, held_out, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; ``held_out``: a boolean
    column of ``docs``; those rows are scored and not learned from."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = rows.where(~F.col("held_out")).select("doc_id", "text")
    signed_end = END - (1 << 64) if END >= 1 << 63 else END
    counts = cut(word_counts(learn, end=signed_end))
    got = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h") == signed_end, F.col("c"))).alias("e")).first()
    total, distinct, ends = got.n or 0, got.v, got.e or 0
    hot_h, hot_c = frequent(counts, HOT)
    vocab = vocabulary(hot_h, hot_c, total, ends)
    p = gru.start(vocab.counts, vocab.classes, HIDDEN, HIDDEN, SEED)
    if total:
        p = _train(learn, vocab, p, total, ends)
    shared = docs.sparkSession.sparkContext.broadcast((hot_h, hot_c, vocab, p))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, hot_known bigint, hot_logs double, out_logs double, n_out bigint, model double, rare array<struct<h:bigint,n:bigint>>"

    def run(batches):
        hot_h, hot_c, vocab, p = shared.value
        hot, logs = Lookup(hot_h), np.log10(np.append(hot_c, 0) + 1.0)
        log_end = math.log10(ends + 1)
        waiting, texts, tokens = [], [], 0

        def flush():
            model = gru.log_probabilities(p, vocab.classes, texts) / _LN10
            at = 0
            for columns, lists in waiting:
                n = len(columns[0])
                out = [*columns, pa.array(model[at : at + n]), lists]
                at += n
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "hot_known", "hot_logs", "out_logs", "n_out", "model", "rare"])

        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                h = words.hashes()
                at = hot.find(h)
                known = at >= 0
                value = np.where(known, logs[at], 0.0)
                ids = vocab.numbers(h)
                out = ids == vocab.unknown
                rare = np.flatnonzero(~known)
                doc, key = words.doc()[rare], h[rare].view(np.int64)
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(doc)))
                entries = pa.StructArray.from_arrays([pa.array(key[first]), pa.array(times.astype(np.int64))], ["h", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(words.docs + 1)).astype(np.int32)), entries)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(words.n.astype(np.int64) + 1), pa.array(words.sums(known.astype(np.int64)) + (ends > 0)), pa.array(words.sums(value) + log_end), pa.array(words.sums(value * out)), pa.array(words.sums(out.astype(np.int64)))]
                waiting.append((columns, lists))
                stop = np.array([vocab.end], np.int32)
                texts += [np.concatenate([ids[a:b], stop]) for a, b in zip(words.first, words.first[1:])]
                tokens += len(h) + words.docs
                if tokens >= CHUNK_TOKENS:
                    yield from flush()
                    waiting, texts, tokens = [], [], 0
        if waiting:
            yield from flush()

    scored = cut(map_arrow(rows.withColumn("doc_id", F.col("doc_id").cast("long")), run, schema)).withColumn("row", F.monotonically_increasing_id())
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n")
    found = rare.join(counts, "h").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    out = scored.drop("rare").join(found, "row", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    outside_n, outside_v = total - int(vocab.counts.sum() - vocab.counts[vocab.unknown]), distinct - len(vocab.hashes) - (ends > 0)
    return out.select(
        F.col("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_logs") + rare_logs - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("out_logs") + rare_logs - F.col("n_out") * F.lit(math.log10(max(outside_n + outside_v + 1, 1)))).alias("score"),
    )
