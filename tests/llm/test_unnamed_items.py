"""Benchmark items without an id mark what they match."""

from tidemark.llm import decontaminate


def test_items_with_null_ids(spark):
    passage = "a passage of the benchmark that nobody gave any name to at all"
    bench = spark.createDataFrame([(None, passage), (3, "other")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + passage + " after"), (2, "clean words"), (3, "any other word")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.scan_documents(docs, bench).collect()}
    assert got == {1: (13, []), 2: (0, []), 3: (1, ["3"])}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()] == [2]
