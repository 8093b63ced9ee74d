"""The language model: every training document counts, partitioning changes nothing, gradients and scores are right."""

import math

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import gru, lm


def small(words: int, hidden: int = 4, seed: int = 0):
    counts = np.arange(words, 0, -1)
    classes = gru.classes_of(words)
    p = gru.start(counts, classes, 3, hidden, seed)
    return classes, gru.Params(*[a.astype(float) for a in p.arrays()])


def naive(p, classes, text):
    """Log-probability of a text, a word at a time."""
    soft = lambda x: x / (1 + abs(x))
    gate = lambda x: (1 + soft(x)) / 2
    softmax = lambda z: np.exp(z) / np.exp(z).sum()
    n = len(p.wh)
    h, out = np.zeros(n), 0.0
    for w in text:
        k = int(classes.of[w])
        a, b = classes.first[k], classes.first[k + 1]
        out += math.log(softmax(h @ p.wc[:-1] + p.wc[-1])[k])
        out += math.log(softmax(p.wo[a:b, :-1] @ h + p.wo[a:b, -1])[w - a])
        x, g = p.embed[w] @ p.wx + p.b, h @ p.wh
        r, u = gate(x[:n] + g[:n]), gate(x[n : 2 * n] + g[n : 2 * n])
        c = soft(x[2 * n :] + r * g[2 * n :])
        h = u * h + (1 - u) * c
    return out


def test_scores_are_those_of_one_word_at_a_time():
    classes, p = small(11)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 11, n).astype(np.int32) for n in (1, 7, 40, 3, 90, 12)]
    want = [naive(p, classes, t) for t in texts]
    for most, steps in ((2, 5), (6, 64), (1, 1)):
        assert np.allclose(gru.log_probabilities(p, classes, texts, most, steps), want, atol=1e-9)


def test_gradient_is_the_slope_of_the_loss():
    classes, p = small(7)
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 7, n).astype(np.int32) for n in (5, 9, 3)]
    weight = np.array([1.0, 4.0, 2.0])
    lay = gru.Layout(texts, 2)
    [(_, rows)] = list(lay.windows(100))
    got, _ = gru.gradient(p, classes, lay, rows, np.zeros((4, len(lay.n))), weight)
    loss = lambda: -float(weight @ [naive(p, classes, t) for t in texts])
    for array, slope in zip(p.arrays(), got):
        flat, slopes = array.reshape(-1), slope.reshape(-1)
        for at in rng.choice(len(flat), min(12, len(flat)), replace=False):
            old = flat[at]
            flat[at] = old + 1e-6
            up = loss()
            flat[at] = old - 1e-6
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-6 - slopes[at]) < 1e-4


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_every_text_reaches_its_shard_with_its_number(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(10 + i))) for i in range(90)]
    rows += [(100 + i, rows[4][1].upper()) for i in range(30)] + [(None, None), (1, ""), (2, " ")]
    h = np.sort(lm.Words(lm.pa.array([" ".join(f"w{k}" for k in range(50))])).hashes())
    vocab = lm.vocabulary(h, np.full(50, 9), 540, 90)
    shared = spark.sparkContext.broadcast((vocab, None))
    for parts, chunk in ((2, 400), (5, 10**6)):
        old, lm.CHUNK_TOKENS = lm.CHUNK_TOKENS, chunk
        try:
            got = lm.encoded(table(spark, rows, parts), shared, 3).collect()
        finally:
            lm.CHUNK_TOKENS = old
        seen = []
        for s in range(3):
            key, count, texts = lm._unpack([bytes(r.blob) for r in got if r.shard == s])
            assert (key % np.uint64(3) == s).all() and (np.diff(key.astype(object)) > 0).all()
            seen += [(len(t) - 1, int(c)) for t, c in zip(texts, count)]
        want = [(10 + i, 31 if i == 4 else 1) for i in range(90)] + [(0, 1), (0, 2)]
        assert sorted(seen) == sorted(want)


def test_partitioning_changes_no_score_and_copies_no_shard(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "WARM_DOCS", 20)
    rng = np.random.default_rng(1)
    rows = [(None if i % 5 == 0 else i, " ".join(f"w{k}" for k in rng.zipf(1.3, 60) % 300)) for i in range(200)] + [(1000 + i, "the same text") for i in range(60)]
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    scores = []
    for parts in (2, 7):
        got = lm.score(table(spark, rows, parts), held).collect()
        scores.append(sorted((r.doc_id or -1, r.n_tokens, r.base_score, r.score) for r in got))
    a, b = (np.array(x, float) for x in scores)
    assert np.abs(a - b).max() < 1e-3 and np.abs((a - b)[:, 3] / a[:, 3]).max() < 1e-6


def test_null_ids_alone_train(spark):
    docs = spark.createDataFrame([(None, "a b c d e " * 20)] * 30, "doc_id long, text string")
    counts = np.full(5, 600)
    vocab = lm.vocabulary(np.arange(1, 6, dtype=np.uint64), counts, 3030, 30)
    p = gru.start(vocab.counts, vocab.classes, 4, 4, 1)
    assert not np.array_equal(lm._train(docs, vocab, p, 3030, 30).flat(), p.flat())


def test_model_learns_what_follows_what(spark):
    """Words in pairs: the second one is certain given the first, which counts alone cannot know."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"a{k} b{k}" for k in rng.integers(0, 20, 60))) for i in range(400)]
    got = lm.score(table(spark, rows, 3), F.col("doc_id") % 7 == 2).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.3
