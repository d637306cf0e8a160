"""Unions whose parts are dealt by the same keys."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators import portfolio as PF


@pytest.fixture
def parts(spark):
    """Two weight tables, each dealt by its portfolio; the setting as Spark has it."""
    old = spark.conf.get("spark.sql.unionOutputPartitioning", None)
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    share = lambda m: spark.range(400).select((F.col("id") % 40).cast("int").alias("k"), (F.col("id") % m).alias("ticker"), (1 + F.col("id") % 3).alias("w")).distinct().withColumn(
        "weight", F.col("w") / F.sum("w").over(W.partitionBy("k"))).groupBy("k", "ticker").agg(F.sum("weight").alias("weight"))
    yield share(9), share(7)
    if old is not None:
        spark.conf.set("spark.sql.unionOutputPartitioning", old)


def test_blend_deals_its_rows_anew(parts):
    """No task may take the rows of a portfolio for complete because each part was dealt by it."""
    got = PF.blend([(p, 0.5) for p in parts], ["k"])
    above = got._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert "Exchange" in above
    rows = [(r["k"], r["ticker"]) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert all(r["s"] == pytest.approx(1.0, abs=1e-6) for r in got.groupBy("k").agg(F.sum("weight").alias("s")).collect())
