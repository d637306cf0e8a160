"""Known values and properties of single operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.functions import expr as X
from alphaloom.operators import asof as A
from alphaloom.operators import crosssection as CS
from alphaloom.operators import execution as EX
from alphaloom.operators import features as FE
from alphaloom.operators import fundamentals as FU
from alphaloom.operators import ic as IC
from alphaloom.operators import portfolio as PF
from alphaloom.operators import resample as RS
from alphaloom.operators import text as TX
from alphaloom.operators import trading_calendar as TC
from alphaloom.params import LONG_TERM_WEIGHTS, SWING_WEIGHTS, horizon_params

D = dt.date


def one(df):
    return df.collect()[0]


def val(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0].x


def test_membership_dates(spark):
    base = spark.createDataFrame([("AAA",), ("OLD",)], "ticker string")
    ev = spark.createDataFrame([("NEW", D(2020, 12, 21), "add"), ("NEW", D(2021, 1, 1), "add"), ("OLD", D(2023, 6, 19), "remove")],
                               "ticker string, d date, action string")
    iv = A.membership_intervals(base, ev)
    probe = spark.createDataFrame([(t, d) for t in ("AAA", "OLD", "NEW") for d in (D(2020, 12, 20), D(2020, 12, 21), D(2023, 6, 18), D(2023, 6, 19))],
                                  "ticker string, d date")
    got = {(r.ticker, r.d) for r in A.members_at(probe, iv, "d").collect()}
    assert ("NEW", D(2020, 12, 20)) not in got and ("NEW", D(2020, 12, 21)) in got
    assert ("OLD", D(2023, 6, 18)) in got and ("OLD", D(2023, 6, 19)) not in got
    assert sum(t == "AAA" for t, _ in got) == 4


def test_asof_before_and_after_availability(spark):
    f = spark.createDataFrame([("A", D(2020, 3, 1), 12.0), ("A", D(2020, 6, 1), 15.0)], "ticker string, available_date date, roe double")
    p = spark.createDataFrame([("A", D(2020, 2, 29)), ("A", D(2020, 3, 1)), ("A", D(2020, 5, 31)), ("A", D(2020, 6, 1)), ("B", D(2021, 1, 1))], "ticker string, d date")
    got = {(r.ticker, r.d): r.roe for r in A.asof_backward(p, f).collect()}
    assert [got[("A", d)] for d in (D(2020, 2, 29), D(2020, 3, 1), D(2020, 5, 31), D(2020, 6, 1))] == [None, 12.0, 12.0, 15.0]
    assert got[("B", D(2021, 1, 1))] is None


def test_due_date_and_picks(spark):
    s = spark.createDataFrame([(D(2024, 1, 15), f"T{i}", float(i), "neutral") for i in range(6)], "d date, ticker string, score double, regime string")
    rows = IC.log_signals(s, 2).collect()
    assert {r.fwd_due_date for r in rows} == {D(2024, 2, 5)}
    assert {r.ticker for r in rows if r.is_pick} == {"T5", "T4"}


def test_split_multiplier_and_dividends(spark):
    ca = spark.createDataFrame([("A", D(2020, 1, 1), "split", 2.0, 0.5), ("A", D(2021, 1, 1), "split", 2.0, 0.5)]
                               + [("A", D(2019, m, 1), "dividend", 0.75, 1.0) for m in (1, 4, 7, 10)] + [("A", D(2018, 1, 1), "dividend", 9.0, 1.0)],
                               "ticker string, d date, type string, ratio double, price_multiplier double")
    p = spark.createDataFrame([("A", D(2019, 1, 1)), ("A", D(2020, 6, 1)), ("A", D(2022, 1, 1))], "ticker string, d date")
    assert {r.d.year: r.multiplier for r in A.split_adjustment(p, ca).collect()} == {2019: 1.0, 2020: 0.5, 2022: 0.25}
    assert one(A.dividend_last4(ca)).dividends == 3.0


def test_slippage_signs(spark):
    a = spark.createDataFrame([(1, "t", "buy", 150.0), (2, "t", "buy", 150.0), (3, "t", "sell", 100.0), (4, "t", "buy", 10.0)],
                              "trade_id int, ticker string, side string, arrival_price double")
    f = spark.createDataFrame([(1, 151.0), (2, 149.5), (3, 99.0)], "trade_id int, fill_price double")
    got = {r.trade_id: r for r in EX.match_fills(a, f).collect()}
    assert got[1].slippage_bps == pytest.approx(66.67, abs=0.01) and got[1].flagged
    assert got[2].slippage_bps < 0 and got[3].slippage_bps == pytest.approx(100) and got[4].status == "pending"


def test_order_slices_sum(spark):
    o = spark.createDataFrame([("A", 100_000.0, 500_000.0), ("B", 400.0, 500_000.0), ("C", 1e7, 1e5), ("Z", 5_000.0, 0.0)], "ticker string, notional double, adv double")
    g = EX.order_slices(o).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("slice_notional").alias("s")).toPandas().set_index("ticker")
    assert g.loc["A", "n"] == 4 and g.loc["A", "s"] == pytest.approx(100_000)
    assert g.loc["B", "n"] == 1 and g.loc["C", "n"] == 5 and g.loc["Z", "n"] == 1


def test_vwap_is_complete(spark):
    o = spark.createDataFrame([("A", 1e6, 1e7), ("B", 5e4, 1e9)], "ticker string, notional double, adv double")
    g = EX.vwap_schedule(o).groupBy("ticker").agg(F.sum("bucket_notional").alias("s"), F.max("notional").alias("t")).collect()
    assert all(abs(r.s - r.t) < 100 for r in g)


def test_blackout_dates(spark):
    days = spark.createDataFrame([(D(2024, 1, 31),), (D(2024, 3, 15),), (D(2024, 3, 22),), (D(2024, 2, 16),), (D(2024, 2, 15),)], "d date")
    got = {r.d: (r.reasons, round(r.scale, 2)) for r in TC.blackout_calendar(days).collect()}
    assert got[D(2024, 1, 31)] == (["fomc_meeting"], 0.5)
    assert got[D(2024, 3, 15)][0] == ["triple_witching", "options_expiration"] and got[D(2024, 3, 15)][1] == 0.7
    assert got[D(2024, 3, 22)] == (["index_rebalance"], 0.75)
    assert got[D(2024, 2, 16)] == (["options_expiration"], 0.85) and got[D(2024, 2, 15)] == ([], 1.0)


def test_scalar_rules(spark):
    assert val(spark, X.pct_of(F.lit(100.0), F.lit(500.0))) == 20.0
    assert val(spark, X.growth_of(F.lit(110.0), F.lit(100.0))) == 10.0
    assert val(spark, FU.price_target_upside(F.lit(200.0), F.lit(160.0))) == 0.25
    assert val(spark, X.regime_rule(F.lit(12.0), F.lit(8.0), F.lit(0.02), F.lit(0.03), F.lit(0.7))) == "risk_on"
    assert val(spark, X.regime_rule(F.lit(40.0), F.lit(-20.0), F.lit(-0.05), F.lit(-0.05), F.lit(2.0))) == "crisis"
    assert val(spark, X.trade_cost(F.lit(0.0), F.lit(1e6), F.lit(1e5))) == 0.0
    small, large = (val(spark, X.trade_cost(F.lit(0.1), F.lit(a), F.lit(1e5))) for a in (1e9, 1e5))
    assert small < large
    lo, mid, hi = (val(spark, X.vol_adjusted_stop(F.lit(100.0), F.lit(v))) for v in (0.1, 0.2, 0.4))
    assert lo > mid > hi and mid == pytest.approx(92.0)


def test_turnover_cap(spark):
    c = spark.createDataFrame([(1, "A", 0.30, 0.80), (1, "B", 0.5, 0.4)], "k int, ticker string, old_weight double, new_weight double")
    assert {r.ticker: round(r.weight, 6) for r in PF.turnover_cap(c, ["k"]).collect()} == {"A": 0.6, "B": 0.4}


def test_benjamini_hochberg_known_set(spark):
    t = spark.createDataFrame([("f1", .001), ("f2", .002), ("f3", .5), ("f4", .8), ("f5", .03)], "factor string, p_value double")
    got = {r.factor: r.bh_significant for r in RS.benjamini_hochberg(t, 0.05).collect()}
    assert got == {"f1": True, "f2": True, "f3": False, "f4": False, "f5": True}


def test_t_distribution_tail():
    # reference points of Student's t: two-sided tail probabilities
    pts = [(2.776445, 4, 0.05), (2.228139, 10, 0.05), (1.959964, 1e7, 0.05), (3.249836, 9, 0.01), (0.0, 5, 1.0), (12.7062, 1, 0.05)]
    p = RS.two_sided_t(np.array([a for a, _, _ in pts]), np.array([b for _, b, _ in pts]))
    assert np.allclose(p, [c for *_, c in pts], atol=2e-5)


def test_ic_gate(spark):
    rows = [("bad", D(2020, 1, i + 1), -0.15) for i in range(12)] + [("new", D(2020, 1, 1), 0.3)] + [("good", D(2020, 1, i + 1), 0.1) for i in range(12)]
    got = {r.factor: r.scale for r in IC.ic_scale(spark.createDataFrame(rows, "factor string, d date, ic double")).collect()}
    assert got == {"bad": 0.0, "new": 1.0, "good": 2.5}


@pytest.mark.parametrize("hold,pnl,gap,want", [(10, .133, 0, "profit_target"), (5, -.056, 0, "stop_loss"), (61, .012, 0, "max_hold"),
                                               (0, -.06, 0, None), (5, -.06, -.04, None), (5, -.08, -.04, "gap_down_exit")])
def test_exit_rules(spark, hold, pnl, gap, want):
    assert val(spark, EX.exit_reason(F.lit(hold), F.lit(float(pnl)), F.lit(float(gap)))) == want


def test_fifo_and_lifo_gains(spark):
    def lots(rows):
        return spark.createDataFrame([(t, D(*d), s, float(q), float(p), i, 1, 1) for i, (t, d, s, q, p) in enumerate(rows)],
                                     "ticker string, trade_date date, side string, shares double, price double, l_orderkey int, l_linenumber int, l_partkey int")
    f = lots([("A", (2024, 1, 1), "buy", 10, 150), ("A", (2024, 2, 1), "buy", 10, 160), ("A", (2024, 3, 1), "sell", 10, 170)])
    assert one(EX.fifo_matches(f)).gain == pytest.approx(200)
    ll = lots([("A", (2024, 1, 1), "buy", 10, 200), ("A", (2024, 2, 1), "buy", 10, 250), ("A", (2024, 3, 1), "sell", 10, 300)])
    assert one(EX.lifo_matches(ll)).gain == pytest.approx(500)
    lt = lots([("A", (2022, 1, 1), "buy", 5, 100), ("A", (2023, 6, 1), "sell", 5, 200)])
    r = one(EX.fifo_matches(lt))
    assert r.is_long_term and r.gain == pytest.approx(500)
    w = lots([("A", (2024, 1, 1), "buy", 5, 200), ("A", (2024, 1, 20), "sell", 5, 150)])
    assert one(EX.fifo_matches(w)).wash_sale_risk


def test_weight_tables_and_presets():
    for i, want in enumerate((1.0, 1.0, 1.0, 1.0)):
        assert sum(w[i] for w in SWING_WEIGHTS.values()) == pytest.approx(want)
    assert all(0 <= x <= 0.3 for w in LONG_TERM_WEIGHTS.values() for x in w)
    assert horizon_params("swing").rebalance_days == 5 and horizon_params("longterm").top_n == 15
    with pytest.raises(ValueError):
        horizon_params("x")


def test_piotroski_bounds_and_direction(spark):
    cols = ["revenue", "net_income", "cfo", "total_assets", "roa_pct", "gross_margin_pct", "de_ratio", "current_ratio"]
    good = (100., 10., 20., 100., 10., 50., .2, 2.) + (90., 5., 5., 110., 5., 40., .5, 1.)
    bad = (80., -5., -9., 120., -4., 30., 2., .5) + (90., 5., 5., 100., 5., 40., .5, 1.)
    none = (None,) * 16
    schema = ", ".join(f"{p}{c} double" for p in ("", "prior_") for c in cols)
    got = [r.piotroski for r in FU.piotroski(spark.createDataFrame([good, bad, none], schema)).collect()]
    assert got == [9, 1, 1]


def test_zscore_is_centred_and_keeps_ranks(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"d": 1, "ticker": np.arange(200), "value": rng.normal(size=200)})
    z = CS.zscore(spark.createDataFrame(pdf), ["d"]).toPandas().sort_values("ticker")
    assert abs(z.z.mean()) < 1e-9 and z.z.std(ddof=0) == pytest.approx(1, abs=1e-4)
    assert (z.z.rank().to_numpy() == pdf.value.rank().to_numpy()).all()


def test_features_equal_numpy_and_do_not_look_ahead(spark):
    rng = np.random.default_rng(42)
    n = 300
    c = 100 * np.cumprod(1 + rng.normal(0, 0.01, n))
    v = rng.integers(1_000, 9_000, n).astype(float)
    pdf = pd.DataFrame({"ticker": "A", "d": pd.bdate_range("2020-01-01", periods=n).date, "close": c, "volume": v})
    full = FE.price_features(spark.createDataFrame(pdf)).toPandas().set_index("n")
    cut = FE.price_features(spark.createDataFrame(pdf.iloc[:200])).toPandas().set_index("n")
    num = full.select_dtypes("number").columns
    assert np.allclose(full.loc[cut.index, num], cut[num], equal_nan=True)       # later bars change nothing
    last = full.loc[n]
    r = np.diff(c[-31:]) / c[-31:-1]
    assert last.ret_3m == pytest.approx((c[-1] / c[-63] - 1) * 100)
    assert last.vol == pytest.approx(np.std(r) * np.sqrt(252) * 100)
    assert last.skewness == pytest.approx(np.mean(((r - r.mean()) / r.std()) ** 3), rel=1e-6)
    ratio = c[-20:] / np.array([c[i - 200:i].mean() for i in range(n - 20, n)])
    x = np.arange(20) - 9.5
    assert last.trend_slope == pytest.approx((x @ (ratio - ratio.mean())) / (x @ x), rel=1e-6)
    obv = np.cumsum(np.sign(np.diff(c[-21:])) * v[-20:])
    assert last.flow_signal == pytest.approx((obv[-1] - obv[0]) / ((obv.std() + 1e-6) * 20), rel=1e-9)
    assert full.index.min() == 60


def test_factor_loadings_equal_least_squares(spark):
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2020-01-01", periods=200).date
    pdf = pd.concat([pd.DataFrame({"ticker": f"T{i}", "d": days, "ret": rng.normal(0, 0.01, 200)}) for i in range(6)])
    df = spark.createDataFrame(pdf)
    fs = PF.factor_series(df)
    f = fs.toPandas().sort_values("d")
    got = PF.factor_loadings(df, fs).toPandas().set_index("ticker")
    xm = np.column_stack([np.ones(200), f.market, f.momentum, f.quality])
    y = pdf[pdf.ticker == "T2"].sort_values("d").ret.to_numpy()
    b = np.linalg.lstsq(xm, y, rcond=None)[0]
    assert np.allclose(got.loc["T2", ["market", "momentum", "quality"]].astype(float), b[1:], atol=1e-9)
    assert got.loc["T2", "specific_var"] == pytest.approx(np.var(y - xm @ b), rel=1e-6)


def _returns(spark, n=5, days=120, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.01, days)
    pdf = pd.concat([pd.DataFrame({"k": 1, "ticker": f"T{i}", "t": np.arange(days), "x": 0.5 * base + rng.normal(0, 0.005 * (i + 1), days)}) for i in range(n)])
    return pdf, spark.createDataFrame(pdf)


def test_shrinkage_and_black_litterman_equal_matrix_form(spark):
    pdf, df = _returns(spark)
    x = pdf.pivot(index="t", columns="ticker", values="x").to_numpy()
    n, p = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min((((c ** 2).T @ (c ** 2)).sum() / n - (s ** 2).sum()) / (p * n), delta)
    want = (1 - beta / delta) * s + beta / delta * mu * np.eye(p)
    cov = PF.ledoit_wolf(df, ["k"])
    got = cov.toPandas().pivot(index="i", columns="j", values="cov").to_numpy()
    assert np.allclose(got, want, rtol=1e-9)
    views = np.linspace(-1, 1, p)
    sc = spark.createDataFrame([(1, f"T{i}", float(v)) for i, v in enumerate(views)], "k int, ticker string, score double")
    w = PF.black_litterman(sc, cov, ["k"]).toPandas().sort_values("ticker").weight.to_numpy()
    tau, om, lam, m = 0.05, 0.1, 2.5, np.full(p, 1 / p)
    omega = om * np.diag(np.diag(tau * want))
    post = np.linalg.solve(np.linalg.inv(tau * want) + np.linalg.inv(omega), np.linalg.inv(tau * want) @ (lam * want @ m) + np.linalg.inv(omega) @ views)
    ref = np.clip(np.linalg.solve(lam * want, post), 0, None)
    assert np.allclose(w, ref / ref.sum(), atol=1e-9)


def test_optimized_portfolio_constraints(spark):
    pdf, df = _returns(spark, n=10, seed=3)
    sc = spark.createDataFrame([(1, f"T{i}", float(i) / 3) for i in range(10)] + [(2, f"T{i}", 1.0) for i in range(4)], "k int, ticker string, score double")
    sec = spark.createDataFrame([(f"T{i}", "tech" if i % 2 else "energy" if i % 3 else "health") for i in range(10)], "ticker string, sector string")
    w = PF.optimize_portfolio(sc, df, sec, ["k"]).toPandas()
    a = w[w.k == 1]
    assert a.weight.sum() <= 1 + 1e-9 and (a.weight >= 0.03 - 1e-9).all()
    assert np.allclose(w[w.k == 2].weight, 0.25)        # no returns: equal weights


def test_caps_hold(spark):
    w = spark.createDataFrame([(1, f"T{i}", x) for i, x in enumerate([0.5, 0.2, 0.1, 0.1, 0.05, 0.05])], "k int, ticker string, weight double")
    got = PF.cap_positions(w, ["k"]).toPandas()
    assert got.weight.max() <= 0.2 + 1e-6 and got.weight.sum() == pytest.approx(1)
    h = PF.hhi_smooth(w, ["k"], ratio=1.2).toPandas()
    assert (h.weight ** 2).sum() <= 1.2 / 6 + 1e-6 and h.weight.sum() == pytest.approx(1)


@pytest.mark.parametrize("q,want", [("Why did the portfolio lose money last week?", "explain_pnl"), ("Which factor worked best this month?", "explain_factor"),
                                    ("What is the current drawdown risk?", "explain_risk"), ("Help me, what can you do?", "meta_help"), ("", "meta_help"),
                                    ("Should I deploy real capital now?", "strategy_health")])
def test_routing(spark, q, want):
    assert one(TX.route_questions(spark.createDataFrame([(q,)], "text string"))).question_type == want


def test_claims_and_confidence(spark):
    a = spark.createDataFrame([(1, "The Sharpe of 1.23 beats; drawdown: -15.4%. Beta = 0.9"), (2, 'x ```json {"confidence": 0.5} ```'), (3, "It might perhaps be unclear")], "id int, text string")
    m = spark.createDataFrame([(1, "sharpe", 1.2), (1, "max_drawdown", -0.30)], "id int, field string, value double")
    got = {r.hint: r for r in TX.check_claims(TX.extract_claims(a), m, "id").collect()}
    assert got["sharpe"].passed and not got["drawdown"].passed and got["beta"].passed and got["beta"].actual is None
    conf = {r.id: (r.confidence, r.disclaimer) for r in TX.answer_confidence(a).collect()}
    assert conf[2] == (0.5, True) and conf[3][0] == pytest.approx(0.65) and conf[1] == (0.8, False)


def test_sentiment_bounds(spark):
    d = spark.createDataFrame([("Profit surge! Record growth, strong rally",), ("Fraud probe; lawsuit.",), ("",), (None,)], "text string")
    got = [(round(r.sentiment, 4), round(r.confidence, 4)) for r in TX.keyword_sentiment(d).collect()]
    assert got == [(1.0, 1.0), (-1.0, 1.0), (0.0, 0.5), (0.0, 0.5)]


def test_readers(spark, tmp_path):
    from alphaloom.sources import metrics_store as MS
    from alphaloom.sources import readers as RD
    days = [d.date() for d in pd.bdate_range("2024-01-01", periods=40)]
    wide = pd.DataFrame({"d": days, "Close_AAA": np.arange(40) + 1.0, "Volume_AAA": 10.0, "Close_BBB": np.nan, "Volume_BBB": 5.0})
    spark.createDataFrame(wide).write.parquet(str(tmp_path / "w"))
    got = RD.load_bars(spark, str(tmp_path / "w"), "field_ticker")
    assert got.count() == 40 and {r.ticker for r in got.select("ticker").distinct().collect()} == {"AAA"}
    flip = wide.rename(columns={"Close_AAA": "AAA_Close", "Volume_AAA": "AAA_Volume", "Close_BBB": "BBB_Close", "Volume_BBB": "BBB_Volume"})
    spark.createDataFrame(flip).write.parquet(str(tmp_path / "f"))
    assert RD.load_bars(spark, str(tmp_path / "f"), "ticker_field").count() == 40
    (tmp_path / "n.json").write_text('{"ticker":"A","title":"x","published_at":"2024-01-01T10:00:00Z"}\n{"ticker":"A","title":"","published_at":"2024-01-01T10:00:00Z"}\n{"ticker":"A","title":"y"}\n')
    assert RD.load_news(spark, str(tmp_path / "n.json")).count() == 1
    RD.write_bars(got, str(tmp_path / "b"))
    fresh = RD.read_fresh_bars(spark, str(tmp_path / "b"))
    assert fresh.count() == 40
    assert one(RD.cache_stats(spark.read.parquet(str(tmp_path / "b")), F.current_timestamp())).fresh == 40
    MS.append_snapshot(got.limit(3), str(tmp_path / "s"), "run1", "v1")
    MS.append_snapshot(got.limit(3), str(tmp_path / "s"), "run2", "v1")
    h = spark.read.parquet(str(tmp_path / "s"))
    assert h.count() == 6 and MS.latest_view(h, ["ticker", "d"]).count() == 3
    pnl = spark.createDataFrame([(days[i], float(i)) for i in range(40)], "d date, ret double")
    icd = spark.createDataFrame([("f", days[0], 0.1), ("f", days[1], 0.2)], "factor string, d date, ic double")
    MS.daily_export(pnl, icd, pnl, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x/pnl")).count() == 30 and spark.read.json(str(tmp_path / "x/factor_ic")).count() == 1
    a, b = (one(MS.data_version(x)).data_version for x in (pnl, pnl.orderBy(F.desc("d"))))
    assert a == b and len(a) == 12 and a != one(MS.data_version(pnl.where("ret > 0"))).data_version


def test_validators(spark):
    from alphaloom.operators import quality as Q
    rows = spark.createDataFrame([(D(2024, 1, 1), 0.01), (None, 0.0), (D(2024, 1, 2), 0.7), (D(2024, 1, 3), float("nan"))], "d date, net_return double")
    good, bad = Q.split_valid(Q.validate_pnl(rows))
    assert good.count() == 1 and bad.count() == 3


def test_wave_of_quality_gates(spark):
    from alphaloom.operators import quality as Q
    days = [d.date() for d in pd.bdate_range("2024-01-01", periods=80)]

    def series(t, f, v=1e6, n=80):
        return [(t, days[i], f(i), v) for i in range(n)]
    rows = (series("ok", lambda i: 100.0 + i) + series("short", lambda i: 100.0, n=30) + series("penny", lambda i: 0.5) + series("spike", lambda i: 100.0 if i != 50 else 200.0)
            + series("neg", lambda i: -1.0 if i == 10 else 100.0) + series("thin", lambda i: 100.0, v=1.0) + series("nan", lambda i: float("nan") if i % 5 == 0 else 100.0))
    rep = {r.ticker: r.reasons for r in Q.quality_report(spark.createDataFrame(rows, "ticker string, d date, close double, volume double")).collect()}
    assert rep["ok"] == [] and rep["short"] == ["insufficient_history"] and rep["penny"][0] == "penny_stock" and rep["spike"] == ["price_spike"]
    assert "zero_or_negative_price" in rep["neg"] and rep["thin"] == ["low_adv"] and rep["nan"] == ["too_many_nans"]
