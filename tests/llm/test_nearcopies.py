"""The near-duplicate stage of the pipeline against brute force over all pairs."""

import collections
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from plumbline.llm import nearcopies, simhash
from plumbline.llm.text import Words, mix

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def changed(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"z{rng.randrange(10**6)}"
    return words


def test_stage_links_five_word_jaccard(spark):
    rng = random.Random(3)
    texts = []
    for n, edits in [(250, (1, 4, 8, 15)), (100, (1, 2, 4, 8)), (40, (1, 2, 3)), (800, (8, 16, 40)), (4, (1,))] * 8:
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(base), *[" ".join(changed(rng, base, k)) for k in edits]]
    texts += [None, "", " \n ", "one", "ONE", texts[0]]
    rows = [(i if i % 3 else None, t, "s") for i, t in enumerate(texts)]
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    for i, j in pairs:
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), "").collect()
    groups = collections.Counter()
    for r in got:
        groups[next(label[i] for i, x in enumerate(rows) if x == tuple(r))] += 1
    assert set(groups) == set(label)  # nothing clean is lost
    assert sum(groups.values()) <= len(set(label)) + 0.01 * len(pairs)
    for r in got:
        g = next(label[i] for i, x in enumerate(rows) if x == tuple(r))
        if groups[g] == 1:
            ids = [rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None]
            assert r.doc_id == min(ids, default=None)


def test_candidates_that_the_smallest_does_not_link(spark):
    """A band of many texts in two groups: all pairs of different components are compared."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(150)]
    groups = [[*common, *[f"g{g}x{i}" for i in range(120)]] for g in range(6)]
    rows = [(10 * g + i, " ".join(changed(rng, w, i and 1)), "s") for g, w in enumerate(groups) for i in range(10)]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in got.collect()) == [0, 10, 20, 30, 40, 50]
    assert simhash.keep_one(got.limit(0)).count() == 0


def test_two_views_find_what_one_finds(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        texts += [" ".join(changed(rng, base, k)) for k in (0, 1, 3, 5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one, two = (sorted(map(tuple, simhash.groups(docs, per_task=n).collect())) for n in (1 << 20, 50))
    assert one == two and len({k for k, _ in one}) >= 120


def test_fingerprints_in_parts_and_whole(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(n)) for n in (1, 5, 6, 300, 2000)] + ["", None, "x y"]
    x, first = simhash.distinct_shingles(Words(pa.array(texts)))
    got = simhash.wide_fingerprints(x, first)
    for d, t in enumerate(texts):
        own = np.unique(nearcopies.shingles(Words(pa.array([t], pa.string())))[0])
        assert (np.sort(x[first[d] : first[d + 1]]) == own).all()
        for j, salt in enumerate(simhash._SALTS):
            h = [int(v) for v in mix(own ^ salt)]
            tie = int(mix(own.min(keepdims=True) ^ salt)[0])
            swap = lambda v: int.from_bytes(int(v).to_bytes(8, "little"), "little")
            want = sum(1 << b for b in range(64) if 2 * sum(swap(v) >> b & 1 for v in h) + (tie >> b & 1) > len(h))
            assert int(got[d, j]) == want
    old, simhash._PART = simhash._PART, 37
    try:
        assert (simhash.wide_fingerprints(x, first) == got).all()
    finally:
        simhash._PART = old
