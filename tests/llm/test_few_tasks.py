"""What keeps the driver small: few jobs for components, no candidate twice."""

import random

import numpy as np

from plumbline.llm import simhash
from plumbline.plans import components


def plain(edges):
    label = {}
    for a, b in edges:
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return label


def groups_of(label):
    out = {}
    for k, v in label.items():
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_components_take_few_jobs(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(150) if i % 50] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(150)] + [(-7, -7)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    want = groups_of(plain(edges))
    spark.sparkContext.setJobGroup("few", "few")
    got = {r.node: r.label for r in components.connected_components(df).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert groups_of(got) == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 8
    monkeypatch.setattr(components, "PER_TASK", 20)  # rounds over the distributed table before one task is enough
    got = {r.node: r.label for r in components.connected_components(df).collect()}
    assert groups_of(got) == want


def test_a_large_group_gives_each_pair_once():
    rng = np.random.default_rng(9)
    n = 3 * simhash.SMALL
    e = np.zeros(n, simhash._entry(simhash.SKETCH))
    e["value"], e["k"], e["label"], e["n"] = 5, np.arange(n), np.arange(n), 100
    e["sketch"] = rng.integers(0, 1 << 63, simhash.SKETCH, np.uint64)
    pairs = [p for a, b in simhash._look_up(e, [0], simhash.EQUAL, []) for p in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(set(pairs)) == n - 1
