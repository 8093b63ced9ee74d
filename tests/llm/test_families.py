"""Families of texts near the threshold: rows in proportion to texts, and the links that all pairs have."""

import random

import numpy as np
import pyarrow as pa

from plumbline.llm import simhash
from plumbline.llm.text import Words


def family(n, edits=8, words=150, seed=5):
    """Texts of one base, most of whose pairs are just below the similarity."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.randrange(1, edits)):
            own[at] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def components(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_rows_grow_with_texts_not_with_pairs(spark, monkeypatch):
    made, matches = [], simhash._matches

    def counted(*args):
        found = matches(*args)
        made.append(found.where("crowd is null").count())
        return found

    monkeypatch.setattr(simhash, "_matches", counted)
    rows = {}
    for n in (150, 600):
        made.clear()
        docs = spark.createDataFrame(list(enumerate(family(n))), "doc_id long, text string")
        simhash.groups(docs).count()
        rows[n] = sum(made)
    print("rows for 150 and 600 texts of one family:", rows)
    assert rows[600] <= simhash.FIRST * 600
    assert rows[600] <= 5 * rows[150]


def test_all_pairs_of_a_family(spark, monkeypatch):
    texts = family(120, 14) + family(90, 14, 40, 6) + family(30, 3, 9, 7)
    want = components(texts)
    x, first = simhash.distinct_shingles(Words(pa.array(texts)))
    fp, n = simhash.wide_fingerprints(x, first), np.diff(first)
    one = simhash.true_links(np.zeros(len(n), np.int64), fp, n, x)
    for i, a in enumerate(one):  # nothing that is not linked, and hardly anything lost
        assert want[i] == want[a]
    assert len(set(one.tolist())) <= len(set(want)) + 3
    monkeypatch.setattr(simhash, "STRIP", 7)
    assert (simhash.true_links(np.zeros(len(n), np.int64), fp, n, x) == one).all()
    side = (np.arange(len(n)) >= 100).astype(np.int64)  # two blocks: links between them alone
    two = simhash.true_links(side, fp, n, x)
    assert all(one[i] == one[a] for i, a in enumerate(two)) and any(side[i] != side[a] for i, a in enumerate(two))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, simhash.groups(docs).collect()))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert sorted(map(tuple, simhash.groups(docs).collect())) == whole
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 3000)
    assert sorted(map(tuple, simhash.groups(docs).collect())) == whole
