"""Features over long frames, put together from short ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import features as FE


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2020-01-01", periods=600).date
    rows = [(t, d, float(c), float(1 + i % 7)) for t, n in ((1, 600), (2, 61), (3, 215)) for i, (d, c) in enumerate(zip(days[:n], 1e4 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))))]
    rows += [(4, d, 100.0, 1.0) for d in days[:300]]                                                       # constant
    rows += [(5, d, float("inf") if i == 20 else 50.0 + i % 5, 1.0) for i, d in enumerate(days[:400])]     # a value that running sums would keep
    pdf = pd.DataFrame(rows, columns=["ticker", "d", "close", "volume"])
    return pdf, FE._long_frames(spark.createDataFrame(rows, "ticker long, d date, close double, volume double").select(
        "*", F.row_number().over(FE.wt()).alias("n"), (F.col("close") / F.lag("close").over(FE.wt()) - 1).alias("r")))


def test_frames_equal_pandas(series):
    pdf, df = series
    got = df.toPandas().sort_values(["ticker", "d"])
    for t, g in got.groupby("ticker"):
        c, after = g["close"].reset_index(drop=True), 20 + 252 if t == 5 else 0
        for col, want in (("sma50", c.rolling(50, 1).mean()), ("sma200", c.rolling(200, 1).mean()), ("sma200_prev", c.rolling(200, 1).mean().shift(1)),
                          ("hi252", c.rolling(252, 1).max()), ("s30", c.pct_change().rolling(30, 1).std(ddof=0)), ("s90", c.pct_change().rolling(90, 1).std(ddof=0)),
                          ("m1", c.pct_change().rolling(30, 1).mean()), ("m3", (c.pct_change() ** 3).rolling(30, 1).mean())):
            if t == 5:
                want = pd.Series([(c[max(0, i - 199):i + 1].mean() if col == "sma200" else c[max(0, i - 49):i + 1].mean()) for i in range(len(c))]) if col in ("sma50", "sma200") else want
                if col not in ("sma50", "sma200", "hi252"):
                    continue
            assert np.allclose(g[col].to_numpy()[after:], want.to_numpy()[after:], rtol=1e-9, atol=1e-12, equal_nan=True), (t, col)


def _frames(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [int(x) for x in __import__("re").findall(r"specifiedwindowframe\(RowFrame, -(\d+),", plan)], plan


def test_no_long_frame_is_left(spark, series):
    pdf, _ = series
    widths, _plan = _frames(FE.price_features(spark.createDataFrame(pdf.head(5), "ticker long, d date, close double, volume double")))
    lags = {1, 4, 5, 10, 19, 20, 30, 40, 50, 52, 60, 62, 100, 125, 150, 251}
    assert all(w <= 30 or w in lags for w in widths)
