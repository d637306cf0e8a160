"""Sets of holders in the near-duplicate join."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from alphaloom.llm import jaccard
from tests.llm.test_text import brute_components, result, variants

WORDS = [f"w{i}" for i in range(400)]


def near_copies(n):
    return [(k, " ".join([*WORDS[:-1], f"x{k}"])) for k in range(n)]


@pytest.mark.parametrize("tasks", [1, 2])
def test_sets_of_holders_not_cells(spark, tasks):
    """Documents that share a hundred cells are one set of holders in a task, or one in each part of the keys."""
    rows = spark.createDataFrame(near_copies(2), "doc_id long, text string")
    docs = rows.coalesce(1) if tasks == 1 else rows.where("doc_id = 0").coalesce(1).union(rows.where("doc_id = 1").coalesce(1))
    found = jaccard._found(jaccard._packed(docs, 3, 5).repartitionById(3, F.col("part"))).where(F.col("kind") == jaccard.SHARED).collect()
    assert 1 <= len(found) <= (1 if tasks == 1 else 3)
    assert {(r["key"], tuple(r["docs"]), tuple(r["sets"])) for r in found} == {(found[0]["key"], (0, 1), ())}
    assert sum(r["n"] for r in found) > 50


@pytest.mark.parametrize(("flush", "tasks"), [(64, 2), (2000, 5)])
def test_components_by_many_flushes(spark, flush, tasks, monkeypatch):
    """Holders that meet in a task, across its flushes and across tasks: sets of sets, with the same components."""
    monkeypatch.setattr(jaccard, "FLUSH", flush)
    rows = variants()
    rows += [(5000 + k, t) for k, t in near_copies(30)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks))
    assert result(got) == brute_components(rows)
