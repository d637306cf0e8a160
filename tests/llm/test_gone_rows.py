"""Texts stay where they are when near duplicates go."""

from __future__ import annotations

import corpus_pipeline


def test_gone_rows_of_many_words(spark):
    """Which rows go is kept in words of 64 bits: groups over several words, highest bits and texts without words."""
    rows = [(k, "t", f"stranger {k} " + " ".join(f"s{k}_{i}" for i in range(12))) for k in range(300)]
    rows = [(k, s, t if k % 64 not in (0, 31, 32, 63) else rows[k % 64][2]) for k, s, t in rows]
    rows += [(400, "t", ""), (400, "t", ""), (401, "t", " \n\x0b"), (402, "t", None), (402, "t", None), (None, "t", rows[0][2]), (None, "t", "")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(2), "").collect()
    first = [k for k, _, _ in rows[:300] if k < 64 or k % 64 not in (0, 31, 32, 63)]
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == first + [400, 401, 402]
    assert sum(r["doc_id"] is None for r in kept) == 2


def test_texts_are_not_dealt(spark):
    """The stage's result joins texts to the rows that go without an exchange of texts that have words."""
    docs = spark.createDataFrame([(k, "t", "one text in very many rows of this table") for k in range(4000)], "doc_id long, source string, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, "")
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert [r["doc_id"] for r in out.collect()] == [0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
