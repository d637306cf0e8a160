"""First price on or after a date."""

from pyspark.sql import functions as F

from alphaloom.operators import asof as A


def test_forward_prices_run_in_one_direction(spark):
    bars = spark.createDataFrame([(1, "2024-01-02", 10.0), (1, "2024-01-05", 11.0), (2, "2024-01-03", None), (2, "2024-01-09", 7.0)], "ticker int, d string, close double").withColumn("d", F.col("d").cast("date"))
    ask = spark.createDataFrame([(1, "2024-01-02"), (1, "2024-01-03"), (1, "2024-01-06"), (2, "2024-01-01")], "ticker int, at string").withColumn("at", F.col("at").cast("date"))
    got = A.forward_price(ask, bars, "at", "px", "on")
    assert {(r["ticker"], str(r["at"])): (r["px"], str(r["on"])) for r in got.collect()} == {
        (1, "2024-01-02"): (10.0, "2024-01-02"), (1, "2024-01-03"): (11.0, "2024-01-05"), (1, "2024-01-06"): (None, "None"), (2, "2024-01-01"): (7.0, "2024-01-09")}
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString()
