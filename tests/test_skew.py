"""Skew-proof building blocks against brute force, with one dominant group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import scale
from alphaloom.operators import execution as EX
from alphaloom.operators.ic import spearman


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    big = pd.DataFrame({"d": 1, "v": np.round(rng.lognormal(0, 2, 60_000), 2)})       # ties and a long tail
    hot = pd.DataFrame({"d": 2, "v": np.where(rng.random(30_000) < 0.4, 5.0, rng.normal(5, 1, 30_000))})
    small = pd.DataFrame({"d": np.repeat(np.arange(3, 40), 7), "v": rng.normal(size=37 * 7)})
    one = pd.DataFrame({"d": [99, 98, 98], "v": [1.5, 2.0, np.nan]})
    pdf = pd.concat([big, hot, small, one], ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    return pdf, df


def test_percentiles_equal_numpy(skewed):
    pdf, df = skewed
    got = scale.grouped_percentiles(df, ["d"], "v", {"a": 0.025, "b": 0.5, "c": 0.975}).toPandas().set_index("d")
    for d, g in pdf.groupby("d"):
        v = g["v"].dropna().to_numpy()
        for c, p in (("a", 2.5), ("b", 50), ("c", 97.5)):
            assert got.loc[d, c] == pytest.approx(np.percentile(v, p), rel=1e-12), (d, c)


def test_clipped_moments_equal_numpy(skewed):
    """Mean and deviation within the cuts, far values outside them; groups that are not clipped."""
    pdf, df = skewed
    df = df.unionByName(df.where("d in (1, 5)").groupBy("d").agg(F.lit(-1e12).alias("v")))
    got = scale.clipped_moments(df, ["d"], "v", 0.1, 0.9, F.col("d") != 2).toPandas().set_index("d")
    for d, g in df.toPandas().groupby("d"):
        v = g["v"].dropna().to_numpy()
        if d != 2:
            v = np.clip(v, np.percentile(v, 10), np.percentile(v, 90))
        assert got.loc[d, "__m"] == pytest.approx(v.mean(), rel=1e-9) and got.loc[d, "__s"] == pytest.approx(v.std(), rel=1e-9, abs=1e-9), d


def test_percentiles_on_unbounded_keys(skewed):
    pdf, df = skewed
    got = scale.grouped_percentiles(df.withColumnRenamed("d", "ticker"), ["ticker"], "v", {"m": 0.5}).toPandas().set_index("ticker")
    assert got.loc[1, "m"] == pytest.approx(np.median(pdf[pdf.d == 1].v))


def test_ranks_equal_pandas(skewed):
    pdf, df = skewed
    got = scale.grouped_ranks(df, ["d"], "v", "rank", "n").groupBy("d", "v").agg(F.max("rank").alias("rank"), F.max("n").alias("n")).toPandas()
    want = pdf.dropna().assign(rank=pdf.groupby("d")["v"].rank()).groupby(["d", "v"])["rank"].max()
    merged = got.dropna().set_index(["d", "v"])["rank"]
    assert np.allclose(merged.sort_index().to_numpy(), want.sort_index().to_numpy())


def test_spearman_equals_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"d": np.repeat([1, 2, 3, 4], [30_000, 40, 5, 4]), "x": np.round(rng.normal(size=30_049), 2)})
    pdf["y"] = np.round(0.4 * pdf.x + rng.normal(size=len(pdf)), 2)
    got = spearman(spark.createDataFrame(pdf), ["d"], "x", "y").toPandas().set_index("d")["ic"]
    for d in (1, 2, 3):
        g = pdf[pdf.d == d]
        assert got[d] == pytest.approx(g.x.rank().corr(g.y.rank()), abs=1e-9)
    assert pd.isna(got[4])


def test_top_n_prunes_before_the_shuffle(spark, skewed):
    _, df = skewed
    top = scale.top_n(df.withColumn("ticker", F.monotonically_increasing_id()), ["d"], [F.desc("v"), "ticker"], 10)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2      # before and after the exchange


def _lots(seed, n=1500):
    rng = np.random.default_rng(seed)
    side = np.where(rng.random(n) < 0.5, "sell", "buy")
    return pd.DataFrame({
        "ticker": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 5, n)), "side": side, "shares": rng.integers(1, 50, n).astype(float),
        "price": np.round(rng.uniform(50, 150, n), 2), "l_orderkey": rng.permutation(n), "l_linenumber": 1, "l_partkey": 1,
        "trade_date": pd.to_datetime("2000-01-01") + pd.to_timedelta(rng.integers(0, 600, n), unit="D")}).assign(trade_date=lambda x: x.trade_date.dt.date)


def _brute(pdf, lifo):
    """Sequential lot matching, one trade after the other."""
    out = []
    for tick, g in pdf.assign(o=(pdf.side == "sell").astype(int)).sort_values(["ticker", "trade_date", "o", "l_orderkey"]).groupby("ticker"):
        lots, seq = [], {}
        for r in g.itertuples():
            seq[r.trade_date] = seq.get(r.trade_date, 0) + 1
            if r.side == "buy":
                lots.append([r.shares, r.price, r.trade_date, seq[r.trade_date]])
                continue
            left, wash = r.shares, False
            for lot in sorted([x for x in lots if x[0] > 0], key=lambda x: x[2], reverse=lifo):
                if left <= 0:
                    break
                q = min(lot[0], left)
                gain, held = q * (r.price - lot[1]), (r.trade_date - lot[2]).days
                wash = wash or (held <= 365 and gain < 0 and held < 30)
                out.append((tick, lot[2], lot[3], r.trade_date, seq[r.trade_date], q, round(gain, 4), held, held > 365, wash))
                lot[0] -= q
                left -= q
    return sorted(out)


@pytest.mark.parametrize("lifo", [False, True])
@pytest.mark.parametrize("seed", [0, 1])
def test_lot_matching_equals_sequential(spark, lifo, seed, monkeypatch):
    monkeypatch.setattr(EX, "CHUNK_ROWS", 64)     # force leftovers across chunks
    monkeypatch.setattr(EX, "BAND", 128.0)
    pdf = _lots(seed)
    m = (EX.lifo_matches if lifo else EX.fifo_matches)(spark.createDataFrame(pdf))
    got = sorted((r.ticker, r.open_date, r.lot_seq, r.sell_date, r.sell_seq, r.shares, round(r.gain, 4), r.held_days, r.is_long_term, r.wash_sale_risk)
                 for r in m.collect())
    want = _brute(pdf, lifo)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:6] == b[:6] and a[7:] == b[7:] and a[6] == pytest.approx(b[6], abs=1e-3)
