"""Benchmark items without an id contaminate like any other."""

from plumbline.llm import decontaminate


def test_items_without_an_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    items = spark.createDataFrame([(None, a), (None, b), (4, c), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x y {a} z"), (2, b), (3, f"{c} end"), (5, "nothing of them")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(1, None, 0), (2, None, 0), (3, 4, 0)}
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [5]
