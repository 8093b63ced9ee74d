"""keep_one keeps exactly one row of each component, told apart by id and text."""

import random

from plumbline.llm import simhash


def test_rows_are_kept_not_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    nulls, same = [text() for _ in range(6)], [text() for _ in range(3)]
    a, b = text(), text()
    rows = [(None, t, i) for i, t in enumerate(nulls)] + [(7, t, 10 + i) for i, t in enumerate(same)]
    rows += [(None, nulls[0], 20)]  # a copy without an id
    rows += [(3, a, 30), (9, a, 31), (None, a, 32)]
    rows += [(9, b, 33), (9, b, 33)]  # another row of 9 stays; its copy under 9 above goes
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(3)
    want = sorted([*range(6), 10, 11, 12, 30, 33])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.at for r in kept.collect()) == want
