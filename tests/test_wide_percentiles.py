"""Percentiles of several columns from brackets, against numpy; scores from wide and long z-scores; what is shuffled."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import crosssection as CS
from alphaloom.operators import scale

WANTED = {"v": {"v_lo": 0.025, "v_mid": 0.5, "v_hi": 0.975}, "w": {"w_lo": 0.025, "w_hi": 0.975}}


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    groups = [(1, 30_000), (2, 9_000), (3, 4_097), (4, 4_096), (5, 7), (6, 1)]
    pdf = pd.concat([pd.DataFrame({"k": k, "ticker": np.arange(n), "v": rng.lognormal(0, 3, n), "w": np.where(rng.random(n) < 0.5, 1.0, rng.integers(0, 9, n))}) for k, n in groups])
    pdf.loc[(pdf["k"] == 2) & (pdf["ticker"] % 3 == 0), "v"] = None
    pdf["w"] = pdf["w"].where(pdf["k"] != 3)
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("v", "w")})
    return pdf, df.repartition(7)


def _right(pdf, rows):
    assert len(rows) == pdf["k"].nunique()
    for r in rows:
        g = pdf[pdf["k"] == r["k"]]
        assert r["__rows"] == len(g)
        for c, names in WANTED.items():
            x = g[c].dropna().to_numpy()
            for n, p in names.items():
                assert r[n] is None if not len(x) else r[n] == pytest.approx(np.percentile(x, 100 * p), rel=1e-12), (r["k"], n)


def test_percentiles(made):
    pdf, df = made
    _right(pdf, scale.wide_percentiles(df, ["k"], "ticker", WANTED).collect())


def test_brackets_that_miss(made, monkeypatch):
    """Few or no chosen rows: brackets miss, and the groups are ordered whole."""
    pdf, df = made
    monkeypatch.setattr(scale, "PIVOT_ROWS", 3)
    _right(pdf, scale.wide_percentiles(df, ["k"], "ticker", WANTED).collect())


def test_few_values_are_dealt(made, monkeypatch):
    """Of large groups only the values near a percentile are ordered."""
    _, df = made
    dealt = []
    real = scale.ordered_counts
    monkeypatch.setattr(scale, "ordered_counts", lambda d, *a: dealt.append(d.count()) or real(d, *a))
    big = df.where("k = 1")
    scale.wide_percentiles(big, ["k"], "ticker", {"v": {"lo": 0.025, "hi": 0.975}}).collect()
    assert len(dealt) == 1 and 0 < dealt[0] < 0.15 * big.count()


def test_scores_wide_and_long(spark):
    rng = np.random.default_rng(6)
    n = 40
    z = pd.DataFrame({"k": np.repeat([0, 1], n // 2), "regime": np.repeat(["crisis", "risk_on"], n // 2), "ticker": np.arange(n), "sector": "a", "vol": np.where(np.arange(n) % 7, 25.0, 0.0)}
                     | {f: 2 * rng.normal(size=n) for f in CS.FACTORS})
    wide = spark.createDataFrame(z)
    scales = spark.createDataFrame([(0, "momentum", 0.5), (0, "quality", 2.0), (1, "roic", 0.0)], "k long, factor string, scale double")
    long = CS.stacked_factors(wide, ["k", "regime"])
    for make in (CS.long_term_scores, CS.swing_scores):
        for s in (None, scales):
            a, b = ({(r["k"], r["ticker"]): r["score"] for r in make(x, wide, ["k"], s).collect()} for x in (wide, long))
            assert a.keys() == b.keys() and len(a) == n and all(a[x] == pytest.approx(b[x], abs=1e-12) for x in a)
