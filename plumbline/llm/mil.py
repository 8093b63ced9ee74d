"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words (all of them, whatever its length). Each passage is encoded from
measures of its bytes and words by a learned layer h = tanh(x W + b). Gated attention, a_k ~ exp(w . (tanh(h_k V) *
sigmoid(h_k U))) over the passages of a text, is learned together with it from labels of whole documents only; the
score is the logistic function of the attention-weighted sum of the h_k.

The model is fitted on the driver from at most ``max_train`` labels, those with the smallest hashes of doc_id;
scoring reads every row. labels, lang, source and doc_id are never inputs of a score.

Edge cases: a null, empty or blank text is one passage of zeros; without labels of both kinds the score is the share
of label 1 seen (one half without any); labels with a null id or label are not used; repeated labels count once, and of
several texts with one doc_id the one with the smallest hash is learned from; an empty table gives an empty result; extra columns pass through score(), those that
have the name of an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import textstats as ts
from plumbline.llm.linear import sigmoid
from plumbline.llm.text import LETTERS, Words, map_arrow, slices

PASSAGE = 64
HIDDEN, GATE = 24, 12
MAX_TRAIN = 4000
EPOCHS = 40
_CLASSES = (
    ts.IS_UPPER, ts.IS_LOWER, ts.IS_DIGIT, ts.IS_HIGH, ts.IS_SYMBOL, ts.IS_PUNCT, ts.lut(b"."), ts.lut(b","), ts.lut(b"!?"),
    ts.lut(b"|"), ts.lut(b"\n"), ts.lut(b"<>{}[]"), ts.lut(b"/\\@:"), ts.lut(b"#*$%&"), ts.lut(b"-_=+~^`"), ts.lut(b"\"'()"),
)
WIDTH = len(_CLASSES) + 9


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(measures of all passages, one row each; index of each text's first passage, then their number)."""
    w = Words(column, lower=False)
    n_passages = np.maximum(-(-w.n // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(n_passages)])
    x = np.zeros((first[-1], WIDTH), np.float32)
    if not len(w.start):
        return x, first
    doc = np.repeat(np.arange(w.docs), n_passages)
    place = np.arange(first[-1]) - first[doc]
    has = w.n[doc] > 0
    a = w.first[doc] + place * PASSAGE
    b = np.minimum(a + PASSAGE, w.first[doc + 1])
    a, b, filled = a[has], b[has], np.flatnonzero(has)
    n = (b - a).astype(np.float32)
    s, e = w.start[a], w.end[b - 1]
    size = np.maximum(e - s, 1)
    for k, members in enumerate(_CLASSES):
        total = ts.running(members[w.data])
        x[filled, k] = np.sqrt((total[e] - total[s]) / size)
    h, who = w.hashes(), w.doc()
    plain = Words(column, table=LETTERS)
    length = ts.running(w.end - w.start)
    square = ts.running((w.end - w.start) ** 2)
    passage = np.repeat(np.arange(len(a)), b - a)
    again, near, windows = (ts.running(m) for m in (ts.repeats(who, h), ts.repeats(passage, h), ts.repeated_words(w, h)))
    letters = ts.running(ts.IS_LETTERISH[w.data])
    bare = ts.running(letters[w.end] == letters[w.start])
    k = len(_CLASSES)
    mean = (length[b] - length[a]) / n
    x[filled, k] = mean / 10
    x[filled, k + 1] = np.sqrt(np.maximum((square[b] - square[a]) / n - mean**2, 0)) / 10
    x[filled, k + 2] = (again[b] - again[a]) / n
    x[filled, k + 3] = (near[b] - near[a]) / n
    x[filled, k + 4] = (windows[b] - windows[a]) / n
    x[filled, k + 5] = (bare[b] - bare[a]) / n
    x[filled, k + 6] = n / PASSAGE
    x[filled, k + 7] = np.log1p(w.n[doc[has]]) / 10
    x[filled, k + 8] = (np.searchsorted(plain.start, e) - np.searchsorted(plain.start, s)) / n / 2
    return np.minimum(x, 4), first


class Model:
    """Parameters by name; arrays, so it is small whatever the input's size."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        logit = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = np.exp(logit - np.maximum.reduceat(logit, first[:-1])[bag])
        a /= np.add.reduceat(a, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return x, h, t, g, a, bag, z, sigmoid(z @ p["c"] + p["d"])

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, t, g, a, bag, z, out = self.forward(x, first)
        r = (out - y) / len(y)
        dz = r[:, None] * p["c"]
        da = (h * dz[bag]).sum(1)
        dlogit = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
        dtg = dlogit[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - h * h)
        return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ dlogit, "c": z.T @ r, "d": r.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 5e-3, size: int = 64, seed: int = 7):
        every = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
        self.mean, self.scale = every.mean(0), every.std(0) + 0.05
        r = np.random.default_rng(seed)
        m, v, k = {q: 0.0 for q in self.p}, {q: 0.0 for q in self.p}, 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), size):
                pick = order[at : at + size]
                first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
                k += 1
                step = rate * (1 - epoch / epochs)
                for q, grad in self.gradient(np.concatenate([bags[i] for i in pick]), first, y[pick]).items():
                    grad = grad + 1e-4 * self.p[q]
                    m[q] = 0.9 * m[q] + 0.1 * grad
                    v[q] = 0.999 * v[q] + 0.001 * grad * grad
                    self.p[q] = self.p[q] - step * (m[q] / (1 - 0.9**k)) / (np.sqrt(v[q] / (1 - 0.999**k)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """A model of the labelled ones among ``docs``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", (F.col(label) > 0).cast("double").alias("y"))
    known = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # max_train labels at most
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x, first = encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array((first * WIDTH).astype(np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, part.column("y")], ["doc_id", "x", "y"])

    t = map_arrow(rows, run, "doc_id bigint, x array<float>, y double").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    bags = [np.asarray(v.values.to_numpy(zero_copy_only=False)).reshape(-1, WIDTH) for v in t.column("x")]
    y = np.array(t.column("y").to_pylist(), float)
    model = Model()
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        model.p["c"][:] = 0
        model.p["d"][:] = np.log(p / (1 - p))
        return model
    return model.fit(bags, y)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    kept = [f for f in docs.schema if f.name != "score"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                p = shared.value.forward(*encode(part.column(text)))[-1]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(p)], schema.fieldNames())

    return map_arrow(docs.select([f.name for f in kept]), run, schema)
