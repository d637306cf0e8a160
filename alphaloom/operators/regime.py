"""Macro signals, regime labels and trend assessment.

These series hold one row per calendar date, so single-partition windows over
them stay small whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.expr import c, regime_rule
from alphaloom.sources.storage import materialize, stacked

ANN = 252.0 ** 0.5


def macro_signals(series: DataFrame) -> DataFrame:
    """One row per date: vix, vix_5d_change, spy_3m, credit, yc, vol_regime, with defaults."""
    w = W.partitionBy("symbol").orderBy("d")
    fr = lambda n: w.rowsBetween(-(n - 1), 0)
    s = series.select("symbol", "d", "close", F.row_number().over(w).alias("n"),
                      (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))
    s = s.select(
        "symbol", "d", "close", "n", F.lag("close", 4).over(w).alias("c5"), F.lag("close", 62).over(w).alias("c63"),
        F.when(F.col("n") > 21, F.try_divide(F.col("close"), F.lag("close", 21).over(w))).alias("g"),
        (F.stddev_samp("ret").over(fr(30)) * F.lit(ANN)).alias("v30"),
        (F.stddev_samp("ret").over(fr(90)) * F.lit(ANN)).alias("v90"))
    of = lambda sym, x: F.max(F.when(F.col("symbol") == sym, x))
    vix5 = F.when(F.col("n") >= 5, (F.col("close") - F.col("c5")) / (F.col("c5") + 1e-6) * 100)
    spy3 = F.when(F.col("n") > 63, (F.try_divide(F.col("close"), F.col("c63")) - 1) * 100)
    volr = F.when(F.col("n") > 63, F.col("v30") / (F.col("v90") + 1e-6))
    return s.groupBy("d").agg(
        F.coalesce(of("^VIX", F.col("close")), F.lit(20.0)).alias("vix"),
        F.coalesce(of("^VIX", vix5), F.lit(0.0)).alias("vix_5d_change"),
        F.coalesce(of("SPY", spy3), F.lit(0.0)).alias("spy_3m"),
        F.coalesce(of("HYG", F.col("g")) - of("IEF", F.col("g")), F.lit(0.0)).alias("credit"),
        F.coalesce(of("TLT", F.col("g")) - of("SHY", F.col("g")), F.lit(0.0)).alias("yc"),
        F.coalesce(of("SPY", volr), F.lit(1.0)).alias("vol_regime"))


def regime_series(series: DataFrame, market: str = "SPY", fear: str = "^VIX") -> DataFrame:
    """Regime label per trading day from market and volatility-index closes."""
    px = (series.where(F.col("symbol").isin(market, fear)).groupBy("d")
          .agg(F.max(F.when(F.col("symbol") == market, F.col("close"))).alias("spy"),
               F.max(F.when(F.col("symbol") == fear, F.col("close"))).alias("vix"))
          .where("spy is not null and vix is not null"))
    w = W.orderBy("d")
    r = px.select("d", "spy", "vix", F.row_number().over(w).alias("n"),
                  (F.try_divide(F.col("spy"), F.lag("spy").over(w)) - 1).alias("ret"))
    x = r.select("d", "vix", "n", ((F.try_divide(F.col("spy"), F.lag("spy", 63).over(w)) - 1) * 100).alias("spy_ret_3m"),
                 (F.stddev_samp("ret").over(w.rowsBetween(-29, 0)) * F.lit(ANN)).alias("v30"),
                 (F.stddev_samp("ret").over(w.rowsBetween(-89, 0)) * F.lit(ANN)).alias("v90"))
    x = x.where("n > 90").select("d", "vix", "spy_ret_3m", (F.col("v30") / (F.col("v90") + 1e-6)).alias("vol_regime"))
    return x.select("*", regime_rule("vix", "spy_ret_3m", F.lit(0.0), F.lit(0.0), "vol_regime").alias("regime"))


def trend_votes(macro: DataFrame, regime: str = "regime", top_n: int = 12) -> DataFrame:
    """Trend against chop vote counts and the entry limits they imply."""
    one = lambda cond, k=1: F.when(cond, k).otherwise(0)
    v, s, r, g = c("vix"), c("spy_3m"), c("vol_regime"), c(regime)
    trend = one(v < 22.0) + one(s > 2.0) + one(r < 0.8) + one(g == "risk_on")
    chop = (one(v >= 22.0) + one(c("vix_5d_change") > 15.0) + one(s < -3.0) + one(r > 1.3)
            + one(g.isin("crisis", "risk_off"), 2))
    m = macro.withColumn("trend_score", trend).withColumn("chop_score", chop)
    m = m.withColumn("is_trending", F.col("trend_score") > F.col("chop_score"))
    return (m.withColumn("top_n_adj", F.when(F.col("is_trending"), top_n).otherwise(6))
            .withColumn("min_score", F.when(F.col("is_trending"), 0.0).otherwise(0.5)))


def apply_trend_filter(picks: DataFrame, votes: DataFrame) -> DataFrame:
    """Trending dates keep all picks; choppy ones the first few above the floor.

    ``picks`` = (d, ticker, score, rn) with rn the rank of the pick.
    """
    j = picks.join(votes.select("d", "is_trending", "top_n_adj", "min_score"), "d", "left")
    ok = F.coalesce(F.col("is_trending"), F.lit(True)) | (F.col("score") >= F.col("min_score"))
    q = j.where(ok).withColumn("q", F.row_number().over(W.partitionBy("d").orderBy("rn")))
    return q.where(F.coalesce(F.col("is_trending"), F.lit(True)) | (F.col("q") <= F.col("top_n_adj"))).drop(
        "q", "is_trending", "top_n_adj", "min_score")


CENTRE_COLS = ("vix", "spy_3m", "credit", "vol_regime")


def _nearest(points: tuple[str, ...], centres: list[tuple]) -> Column:
    """Struct (squared distance, index) of the nearest centre; the first of equally near ones."""
    # centres are one array value, so that every round runs the same compiled code
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in centres])

    def far(m, j):
        parts = [F.get(m, F.lit(i)) - F.col(c) for i, c in enumerate(points)]
        return F.struct(sum((x * x for x in parts), F.lit(0.0)).alias("dist"), j.alias("centre"))
    return F.array_min(F.transform(rows, far))


def cluster_centres(points: DataFrame, order: str = "d", cols: tuple[str, ...] = CENTRE_COLS, k: int = 4, rounds: int = 30) -> list[tuple]:
    """Centres of ``k`` groups by Lloyd rounds, each one aggregate over the points; only the k centres reach the driver.

    The first centre is the first point by ``order``, each further one the point farthest from all before it (ties: the
    first).  Equally near centres: the first; a centre without points stays; rounds end when no point changes its group,
    or after ``rounds``.  No points give no centres; with fewer distinct points than k, centres repeat.
    """
    at = F.struct(*cols)
    first = points.agg(F.min_by(at, order).alias("m")).first()["m"]
    if first is None:
        return []
    centres = [tuple(first)]
    while len(centres) < k:
        best = points.select(order, at.alias("at"), _nearest(cols, centres)["dist"].alias("dist")).groupBy("dist").agg(
            F.min(F.struct(order, "at")).alias("p")).agg(F.max_by("p", "dist").alias("m")).first()["m"]
        centres.append(tuple(best["at"]))
    before = None
    for _ in range(rounds):
        now = _nearest(cols, centres)["centre"]
        moved = F.lit(True) if before is None else now != before
        got = points.select(now.alias("centre"), moved.alias("moved"), *cols).groupBy("centre").agg(
            F.count_if("moved").alias("moved"), *[F.avg(c).alias(c) for c in cols]).collect()        # k rows
        if not sum(r["moved"] for r in got):
            break
        before = now
        means = {r["centre"]: tuple(r[c] for c in cols) for r in got}
        centres = [means.get(j, m) for j, m in enumerate(centres)]
    return centres


def snapshots(history: DataFrame) -> DataFrame:
    """One row per date without missing values, with its rule label."""
    snap = history.select("d", "yc", *[F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)).alias(x) for x in CENTRE_COLS])
    return snap.withColumn("rule", regime_rule("vix", "spy_3m", "credit", "yc", "vol_regime"))


def regime_groups(snap: DataFrame, k: int = 4) -> DataFrame:
    """One row per centre: (centre, the four values, n members, regime by the rule without a yield curve)."""
    centres = cluster_centres(snap, k=k)
    rows = snap.sparkSession.createDataFrame([(j, *map(float, m)) for j, m in enumerate(centres)],
                                             "centre int, vix double, spy_3m double, credit double, vol_regime double")
    n = snap.select(_nearest(CENTRE_COLS, centres)["centre"].alias("centre")).groupBy("centre").agg(F.count("*").alias("n")) if centres else (
        rows.select("centre", F.lit(0).cast("long").alias("n")))
    return rows.join(n, "centre", "left").select(
        *rows.columns, F.coalesce("n", F.lit(0)).alias("n"), regime_rule("vix", "spy_3m", "credit", F.lit(0.0), "vol_regime").alias("regime"))


def detect_regime(history: DataFrame, k: int = 4, min_history: int = 30) -> DataFrame:
    """Smoothed current regime, one row: rule, rule of the nearest group's centre, and the last-five vote between them.

    ``history`` holds one snapshot per date (vix, spy_3m, credit, yc, vol_regime); with fewer than ``min_history`` the
    rule stands alone.  On ties of the vote the label seen first wins; an empty history gives no row.
    """
    snap = materialize(snapshots(history), "snapshots")
    few = snap.count() < min_history
    centres = [] if few else cluster_centres(snap, k=k)
    ml = F.col("rule")
    if centres:
        label = [regime_rule(*[F.lit(float(v)) for v in m[:3]], F.lit(0.0), F.lit(float(m[3]))) for m in centres]
        ml = F.element_at(F.array(*label), _nearest(CENTRE_COLS, centres)["centre"] + 1)
    last = snap.select("d", "rule", ml.alias("ml")).orderBy(F.desc("d")).limit(5)
    five = last.agg(F.array_sort(F.collect_list(F.struct("d", "rule", "ml"))).alias("h")).where(F.size("h") > 0)
    votes = F.transform("h", lambda e: F.struct(F.size(F.filter("h", lambda o: o["rule"] == e["rule"])).alias("c"),
                                                (-F.array_position(F.transform("h", lambda o: o["rule"]), e["rule"])).alias("first"), e["rule"].alias("rule")))
    cur = five.select(F.element_at("h", -1).alias("e"), F.array_max(votes)["rule"].alias("voted"))
    return cur.select("e.d", F.col("e.rule").alias("rule_regime"), F.col("e.ml").alias("ml_regime"),
                      F.when(F.col("e.ml") == F.col("e.rule"), F.col("e.rule")).otherwise(F.col("voted")).alias("regime"))


def with_regime_asof(dates: DataFrame, regimes: DataFrame, date_col: str = "d") -> DataFrame:
    """Latest label on or before each date, 'neutral' before the first one."""
    tagged = dates.select(F.col(date_col).alias("t"), F.lit(1).alias("probe"), F.lit(None).cast("string").alias("lab"))
    both = stacked(tagged, regimes.select(F.col("d").alias("t"), F.lit(0).alias("probe"), F.col("regime").alias("lab")))
    w = W.orderBy("t", "probe").rowsBetween(W.unboundedPreceding, 0)
    lab: Column = F.coalesce(F.last("lab", True).over(w), F.lit("neutral"))
    hits = both.select("t", "probe", lab.alias("regime")).where("probe = 1").select(F.col("t").alias(date_col), "regime").distinct()
    return dates.join(hits, date_col, "left")
