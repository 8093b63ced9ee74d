"""Toxicity by a classifier chain.

The categories are predicted one after the other: each is a linear model over the words of the text that also gets
the probabilities of all categories before it. When it is trained, those are out-of-fold predictions, so a later
model does not learn to trust an earlier one more than it deserves on new texts.

A text's features are the hashes of its distinct words and of their first bytes (``PREFIX``), words being split at
white space and ASCII punctuation and A-Z lower-cased. Whole texts are read, whatever their length.

Labels: the table has one human label, toxic. The finer categories before it in the chain are kinds of toxic texts
that are found in the labelled ones: spherical k-means over the words that set toxic texts apart, weighted by their
rarity. No word is written down here. The last link, toxic, learns from the human label alone.

Models are fitted on the driver from at most ``max_train`` labelled documents (by the order of a hash of doc_id, half
of them toxic if there are so many, weighted back to the share of toxic ones among all labels); all else covers all rows.

Edge cases: a null or empty text has no features and gets the intercept's probabilities; without any labelled row, or
with labels of one kind only, every category has the share seen (zero without labels); rows of labels with a null
doc_id or label are not used; repeated labels count once, and of several texts with one doc_id the one with the
smallest hash is learned from; an empty table gives an empty result; extra columns pass through, and a column that has
the name of an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.linear import Rows, fit_logistic, sigmoid
from plumbline.llm.text import LETTERS, Words, map_arrow, slices

KINDS = 2
CHAIN = (*[f"kind_{k + 1}" for k in range(KINDS)], "toxic")
PREFIX = 5
MAX_TRAIN = 5000
FOLDS = 3
FEATURES = 8192
#: Features in which kinds of toxic texts are told apart.
KIND_FEATURES = 512
THRESHOLD = 0.35
L2 = 2e-5
_BITS = 20
_SALT = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Chain:
    names: tuple[str, ...]
    features: np.ndarray  # sorted hashes
    models: list[tuple[np.ndarray, np.ndarray, float]]

    def __post_init__(self):
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.features >> np.uint64(64 - _BITS)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the features, or -1."""
        if not len(self.features):
            return np.full(len(h), -1)
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.features, h[maybe]), len(self.features) - 1)
        hit = self.features[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def probabilities(self, rows: Rows) -> np.ndarray:
        p = np.zeros((rows.height, 0))
        for w, v, b in self.models:
            p = np.column_stack([p, sigmoid(rows.dot(w) + p @ v + b)])
        return p


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each feature, repeats included."""
    doc, long = words.doc(), words.end - words.start > PREFIX
    return np.concatenate([doc, doc[long]]), np.concatenate([words.hashes(), words.hashes(PREFIX)[long] ^ _SALT])


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(features of each text, its toxic label, its weight) of the sample."""
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).alias("y")).distinct()
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    half = max_train // 2
    take = {True: max(half, max_train - share.get(False, 0)), False: max(half, max_train - share.get(True, 0))}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(n, max_train)) for y, n in take.items()]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # max_train rows at most
    rows = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), table=LETTERS)
                doc, h = features(words)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                doc, h = doc[keep], h[keep]
                first = np.searchsorted(doc, np.arange(words.docs + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([lists, part.column("y")], ["h", "y"])

    table = map_arrow(rows, extract, "h array<bigint>, y boolean").toArrow()
    x = [np.asarray(v.values.to_numpy()).view(np.uint64) if len(v) else np.zeros(0, np.uint64) for v in table.column("h")]
    y = np.array(table.column("y").to_pylist(), float)
    weight = np.ones(len(y))
    for kind in (True, False):
        n = int((y == kind).sum())
        if n:
            weight[y == kind] = share[kind] / n
    return x, y, weight


def kinds(rows: list[np.ndarray], telling: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The kind of each row by spherical k-means over the columns ``telling``. The first centre is the first row with
    the most of them, each next one the row that is farthest from all before; rows without any are of kind 0."""
    x = np.stack([np.isin(telling, r) for r in rows]).astype(np.float32)
    x *= np.log((len(rows) + 1) / (x.sum(0) + 1)).astype(np.float32) + np.float32(0.1)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), np.float32(1e-9))
    at = [int(np.argmax((x > 0).sum(1)))] if x.shape[1] else [0]
    while len(at) < KINDS:
        at.append(int(np.argmin((x @ x[at].T).max(1))))
    centre, kind = x[at], np.zeros(len(x), int)
    for _ in range(rounds):
        new = np.argmax(x @ centre.T, 1)
        if (new == kind).all():
            break
        kind = new
        for k in range(KINDS):
            if (kind == k).any():
                mean = x[kind == k].sum(0)
                centre[k] = mean / max(float(np.sqrt((mean * mean).sum())), 1e-9)
    return kind


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Chain:
    x, toxic, weight = training_rows(docs, labels, max_train)
    order = sorted(range(len(x)), key=lambda i: (toxic[i], len(x[i]), x[i].tobytes()))  # not by arrival
    x, toxic, weight = [x[i] for i in order], toxic[order], weight[order]
    nothing = np.zeros(0, np.uint64)
    if not len(x) or toxic.min() == toxic.max():
        p = float(toxic[0]) if len(x) else 0.0
        b = 40.0 if p else -40.0
        return Chain(CHAIN, nothing, [(np.zeros(0), np.zeros(k), b) for k in range(len(CHAIN))])
    every = np.concatenate(x)
    hashes, back = np.unique(every, return_inverse=True)
    pos = np.bincount(back, np.repeat(toxic, [len(h) for h in x]), len(hashes))
    df = np.bincount(back, minlength=len(hashes))
    rate = toxic.mean()
    z = np.abs(pos - df * rate) / np.sqrt(df * rate * (1 - rate))
    good = np.flatnonzero((df >= 3) & (z >= 2.5))
    good = good[np.argsort(-z[good], kind="stable")[:FEATURES]]
    telling = np.zeros(len(hashes), bool)
    telling[[i for i in good if pos[i] > df[i] * rate][:KIND_FEATURES]] = True
    good = np.sort(good)
    chosen, telling = hashes[good], np.flatnonzero(telling[good])
    blank = Chain(CHAIN, chosen, [])
    rows = [np.unique(i[i >= 0]) for i in (blank.find(h) for h in x)]
    fold = np.arange(len(x)) % FOLDS
    parts = [(np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(FOLDS)]
    sparse = Rows(rows, len(chosen))
    kind = np.full(len(x), -1)
    kind[toxic == 1] = kinds([r for r, t in zip(rows, toxic) if t], telling)
    y = np.column_stack([*[kind == k for k in range(KINDS)], toxic]).astype(float)
    before, models = np.zeros((len(x), 0)), []
    for c in range(len(CHAIN)):
        models.append(fit_logistic(sparse, before, y[:, c], weight, L2))
        out = np.zeros(len(x))
        if c + 1 < len(CHAIN):
            for train, test in parts:
                w, v, b = fit_logistic(Rows([rows[i] for i in train], len(chosen)), before[train], y[train, c], weight[train], L2)
                out[test] = sigmoid(Rows([rows[i] for i in test], len(chosen)).dot(w) + before[test] @ v + b)
            before = np.column_stack([before, out])
    return Chain(CHAIN, chosen, models)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with a probability column p_<category> for each link of the chain and the verdict ``toxic``."""
    added = [f"p_{c}" for c in chain.names]
    kept = [f for f in docs.schema if f.name not in {*added, "is_toxic"}]
    schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in added], T.StructField("is_toxic", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast((chain.names, chain.features, chain.models))

    def run(batches):
        model = Chain(*shared.value)
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text), table=LETTERS)
                doc, h = features(words)
                at = model.find(h)
                hit = np.unique(doc[at >= 0] * len(model.features) + at[at >= 0]) if len(model.features) else np.zeros(0, np.int64)
                width = max(len(model.features), 1)
                first = np.searchsorted(hit // width, np.arange(words.docs + 1))
                rows = Rows([hit[a:b] % width for a, b in zip(first, first[1:])], len(model.features))
                p = model.probabilities(rows)
                columns = [part.column(f.name) for f in kept] + [pa.array(p[:, k]) for k in range(p.shape[1])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p[:, -1] >= THRESHOLD)], schema.fieldNames())

    return map_arrow(docs.select([f.name for f in kept]), run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    return score(docs, fit(docs, labels, max_train))
