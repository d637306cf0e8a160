"""All frames of a ticker are taken at once: no chain of windows, and the values of pandas."""

import numpy as np
import pandas as pd
import pytest

from alphaloom.operators import features as FE


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(9)
    days = pd.date_range("2021-01-01", periods=320).date
    rows = [("b", d, None if i % 37 == 5 else float(c), None if i % 41 == 7 else float(1 + i % 9)) for i, (d, c) in enumerate(zip(days, 90 * np.exp(np.cumsum(rng.normal(0, 0.02, 320)))))]
    return pd.DataFrame(rows + [("a", d, 7.3, 2.0) for d in days[:70]], columns=["ticker", "d", "close", "volume"])


def _df(spark, bars):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in bars.sample(frac=1, random_state=1).itertuples(index=False)]
    return spark.createDataFrame(rows, "ticker string, d date, close double, volume double")


def test_no_window_copies_the_rows(spark, bars):
    assert "Window" not in FE.price_features(_df(spark, bars))._jdf.queryExecution().optimizedPlan().toString()


def test_frames_with_missing_values(spark, bars):
    got = FE._long_frames(_df(spark, bars)).toPandas().sort_values(["ticker", "d"])
    assert (got[got.ticker == "a"][["s30", "prior_sd"]].iloc[25:] == 0).all().all()
    g, b = got[got.ticker == "b"].reset_index(drop=True), bars[bars.ticker == "b"].reset_index(drop=True)
    c, v = b.close.astype(float), b.volume.astype(float)
    r = (c - c.shift(1)) / (c.shift(1) + 1e-10)
    obv = (np.sign(c - c.shift(1)).fillna(0) * v).cumsum().ffill()
    ratio = c / (c.rolling(200, 1).mean().shift(1) + 1e-6)

    def slope(i):
        y = ratio[max(0, i - 19):i + 1].dropna()
        return np.polyfit(y.index, y, 1)[0]
    for col, want in (("c21", c.shift(20)), ("s30", r.rolling(30, 1).std(ddof=0)), ("prior_sd", r.shift(6).rolling(19, 1).std(ddof=0)), ("hi252", c.rolling(252, 1).max()),
                      ("obv", obv), ("obv_sd", obv.rolling(20, 1).std(ddof=0)), ("vol21", v.rolling(21, 1).mean()), ("amihud", (r.abs() / (c * v + 1e-6)).rolling(20, 1).mean()),
                      ("up", v.where(c > c.shift(1)).rolling(20, 1).mean())):
        assert np.allclose(g[col].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), col
    assert np.allclose([g["slope"][i] for i in (60, 150, 319)], [slope(i) for i in (60, 150, 319)], rtol=1e-8)
