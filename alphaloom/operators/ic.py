"""Information coefficients: logging, measurement, scaling and monitoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.crosssection import FACTORS, stacked_factors
from alphaloom.operators.scale import grouped_percentiles, handed_out, ordered_counts, top_n
from alphaloom.sources.storage import materialize, stacked

WHOLE_ROWS = 1 << 20        # a cross-section of so many names at most is ranked at once, a column at a time


def log_signals(scores: DataFrame, n_picks: int, fwd_days: int = 21) -> DataFrame:
    """(d, ticker, score, regime) -> signal rows with due date and pick flag."""
    picks = top_n(scores, ["d"], [F.desc("score"), F.asc("ticker")], n_picks).select("d", "ticker", F.lit(True).alias("is_pick"))
    return scores.join(picks, ["d", "ticker"], "left").select(
        F.col("d").alias("signal_date"), F.date_add("d", fwd_days).alias("fwd_due_date"), "regime", "ticker",
        F.bround("score", 5).alias("score"), F.coalesce("is_pick", F.lit(False)).alias("is_pick"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 5) -> DataFrame:
    """Rank correlation with shared ranks per group; NULL for few names or a constant side."""
    both = materialize(df.select(*keys, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(F.col(x).isNotNull() & F.col(y).isNotNull()), "ranked")
    sides = F.array(F.struct(F.lit("x").alias("__side"), F.col(x).alias("__v")), F.struct(F.lit("y").alias("__side"), F.col(y).alias("__v")))
    o = ordered_counts(both.select(*keys, F.explode(sides).alias("__s")).select(*keys, "__s.*"), [*keys, "__side"], "__v")     # both rankings in one pass
    rank = F.col("__before") + (F.col("__c") + 1) / 2.0
    of = lambda side, c, out, *more: o.where(F.col("__side") == side).select(*keys, F.col("__v").alias(c), rank.alias(out), *more)
    r = both.join(of("x", x, "__rx"), [*keys, x]).join(of("y", y, "__ry", "__n"), [*keys, y])
    # tie-shared ranks always average (n + 1) / 2: centred sums are exact for moderate n
    cx, cy = F.col("__rx") - (F.col("__n") + 1) / 2.0, F.col("__ry") - (F.col("__n") + 1) / 2.0
    g = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(cx * cy).alias("__c"), F.sum(cx * cx).alias("__sx"), F.sum(cy * cy).alias("__sy"),
        F.stddev_pop(x).alias("__vx"), F.stddev_pop(y).alias("__vy"))
    ok = (F.col("n") >= min_n) & (F.col("__vx") >= 1e-10) & (F.col("__vy") >= 1e-10)
    return g.select(*keys, "n", F.when(ok, F.try_divide(F.col("__c"), F.sqrt("__sx") * F.sqrt("__sy"))).alias("ic"))


def factor_ic(z: DataFrame, fwd: DataFrame, keys: list[str]) -> DataFrame:
    """Rank correlation of each factor with the forward return, per date and factor.

    ``z`` = (keys, ticker, factor, z), or one row per name with a column for each factor; ``fwd`` = (keys, ticker,
    fwd_return).  Undefined correlations are left out.

    Rows of names are dealt once, by date, and meet their returns there; dates of more than ``WHOLE_ROWS`` names are ranked
    by ranges of values, factor by factor (``spearman``).
    """
    if "factor" in z.columns:
        return spearman(z.join(fwd, keys + ["ticker"]), keys + ["factor"], "z", "fwd_return").where("ic is not null")
    z = z.select(*keys, "ticker", *FACTORS)
    large = handed_out(z.groupBy(*keys).count().where(F.col("count") > WHOLE_ROWS).select(*keys), "large")
    if not large.limit(1).count():
        return _whole_ic(z, fwd, keys)
    rest = stacked_factors(z.join(large, keys, "left_semi"), keys).join(fwd, keys + ["ticker"])
    return stacked(_whole_ic(z.join(large, keys, "left_anti"), fwd, keys), spearman(rest, keys + ["factor"], "z", "fwd_return").where("ic is not null"))


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average (tie-shared) ranks from 1."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2.0)[at]


def _whole_ic(z: DataFrame, fwd: DataFrame, keys: list[str], min_n: int = 5) -> DataFrame:
    """The same, a cross-section in one task: rows (keys, factor, n, ic)."""
    out = ", ".join([f"`{k}` {z.schema[k].dataType.simpleString()}" for k in keys] + ["factor string", "n long", "ic double"])

    def correlated(names: pa.Table, returns: pa.Table) -> pa.Table:
        j = names.join(returns.select(["ticker", "fwd_return"]), "ticker", join_type="inner")
        y, there = j.column("fwd_return").cast(pa.float64()), j.column("fwd_return").is_valid().to_numpy()
        y, rows = y.fill_null(0.0).to_numpy(), []
        whole = _ranks(y[there])
        for f in FACTORS:
            x, ok = j.column(f).fill_null(0.0).to_numpy(), j.column(f).is_valid().to_numpy() & there
            n = int(ok.sum())
            if n < min_n or x[ok].std() < 1e-10 or y[ok].std() < 1e-10:
                continue
            cx, cy = _ranks(x[ok]) - (n + 1) / 2.0, (whole if n == len(whole) else _ranks(y[ok])) - (n + 1) / 2.0
            scale = np.sqrt((cx * cx).sum()) * np.sqrt((cy * cy).sum())
            if scale:
                rows.append((f, n, (cx * cy).sum() / scale))
        own = {k: pa.array([names.column(k)[0].as_py()] * len(rows), names.schema.field(k).type) if len(rows) else pa.array([], names.schema.field(k).type) for k in keys}
        of = list(zip(*rows)) if rows else [(), (), ()]
        return pa.table(own | {"factor": pa.array(of[0], pa.string()), "n": pa.array(of[1], pa.int64()), "ic": pa.array(of[2], pa.float64())})

    return z.groupBy(*keys).cogroup(fwd.select(*keys, "ticker", "fwd_return").groupBy(*keys)).applyInArrow(correlated, out)


def last_rows(ic: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Last ``n`` observations per factor; age 0 is the newest."""
    keys = keys or ["factor"]
    w = W.partitionBy(*keys).orderBy(F.desc("d"))
    return ic.withColumn("age", F.row_number().over(w) - 1).where(F.col("age") < n)


def _scale_from(n: Column, sw: Column, swx: Column, swxx: Column) -> Column:
    mean = swx / sw
    var = F.greatest(swxx / sw - mean * mean, F.lit(0.0))
    ir = mean / (F.sqrt(var) + 1e-6)
    return F.when(n < 4, 1.0).when(ir < -0.3, 0.0).otherwise(F.least(F.greatest(1 + ir, F.lit(0.1)), F.lit(2.5)))


def ic_scale(ic: DataFrame, window: int = 24, half_life: float = 12.0) -> DataFrame:
    """Decay-weighted scale of the weight of each factor, as of its latest date."""
    x = last_rows(ic, window).withColumn("w", F.pow(F.lit(2.0), -F.col("age") / half_life))
    g = x.groupBy("factor").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("ic")).alias("swx"),
                                F.sum(F.col("w") * F.col("ic") * F.col("ic")).alias("swxx"))
    return g.select("factor", "n", _scale_from(F.col("n"), F.col("sw"), F.col("swx"), F.col("swxx")).alias("scale"))


def ic_scale_history(ic: DataFrame, window: int = 24, half_life: float = 12.0) -> DataFrame:
    """Scale after every observation: what a rebalance at that point would use."""
    w = W.partitionBy("factor").orderBy("d")
    fr = w.rowsBetween(-(window - 1), 0)
    x = ic.select("factor", "d", "ic", F.collect_list("ic").over(fr).alias("h"))
    n = F.size("h")
    weights = F.transform(F.col("h"), lambda v, i: F.struct(F.pow(F.lit(2.0), -(n - 1 - i) / half_life).alias("w"), v.alias("v")))
    fold = F.aggregate(weights, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c")),
                       lambda s, e: F.struct((s.a + e.w).alias("a"), (s.b + e.w * e.v).alias("b"), (s.c + e.w * e.v * e.v).alias("c")))
    return x.withColumn("f", fold).select("factor", "d", _scale_from(n, F.col("f.a"), F.col("f.b"), F.col("f.c")).alias("scale"))


def known_scales(ic: DataFrame, probes: DataFrame, window: int = 24, half_life: float = 12.0) -> DataFrame:
    """(k, factor, scale): the scale of each factor's weight from what was known at a rebalance.

    ``ic`` = (factor, k, known_d, ic): the correlation of the exposures of rebalance k, known once its returns have ended.
    ``probes`` = (k, factor, reb_d).  Two times count: an observation is taken if it was known before ``reb_d``, and of
    those the last ``window`` rebalances are taken, in whichever order they became known.  A factor has one observation
    and one probe for each rebalance, so the arrays are bounded by the calendar.
    """
    obs = F.struct("k", "ic")
    none = F.lit(None).cast("int")
    told = ic.select("factor", F.col("known_d").alias("t"), F.lit(1).alias("p"), none.alias("at"), obs.alias("o"))
    ask = probes.select("factor", F.col("reb_d").alias("t"), F.lit(0).alias("p"), F.col("k").cast("int").alias("at"),
                        F.lit(None).cast(ic.select(obs.alias("o")).schema["o"].dataType).alias("o"))
    before = W.partitionBy("factor").orderBy("t", "p").rowsBetween(W.unboundedPreceding, 0)
    x = stacked(told, ask).select("factor", "p", "at", F.collect_list("o").over(before).alias("h")).where("p = 0")
    x = x.withColumn("h", F.slice(F.sort_array("h", asc=False), 1, window))
    weights = F.transform("h", lambda v, age: F.struct(F.pow(F.lit(2.0), -age / half_life).alias("w"), v.ic.alias("v")))
    fold = F.aggregate(weights, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c")),
                       lambda s, e: F.struct((s.a + e.w).alias("a"), (s.b + e.w * e.v).alias("b"), (s.c + e.w * e.v * e.v).alias("c")))
    x = x.withColumn("f", fold)
    return x.select(F.col("at").alias("k"), "factor", _scale_from(F.size("h"), F.col("f.a"), F.col("f.b"), F.col("f.c")).alias("scale"))


def ic_summary(ic: DataFrame, window: int = 24) -> DataFrame:
    """Mean, ratio, hit rate, count and current scale over the last ``window`` rows."""
    g = last_rows(ic, window).groupBy("factor").agg(
        F.avg("ic").alias("mean_ic"), (F.avg("ic") / (F.stddev_pop("ic") + 1e-6)).alias("ic_ir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.count("*").alias("n"))
    return g.join(ic_scale(ic, window).select("factor", F.col("scale").alias("current_scale")), "factor")


def rank_turnover(scores: DataFrame, keys: list[str]) -> DataFrame:
    """1 - rank correlation of each name's score with its previous one, per k.

    ``scores`` = (keys, k, ticker, score); 0.5 where undefined.
    """
    prev = scores.select(*keys, (F.col("k") + 1).alias("k"), "ticker", F.col("score").alias("prev"))
    j = scores.join(prev, keys + ["k", "ticker"])
    rho = spearman(j, keys + ["k"], "score", "prev").select(
        *keys, "k", F.coalesce(F.least(F.greatest(1 - F.col("ic"), F.lit(0.0)), F.lit(1.0)), F.lit(0.5)).alias("turnover"))
    return scores.select(*keys, "k").distinct().join(rho, keys + ["k"], "left").withColumn(
        "turnover", F.coalesce("turnover", F.lit(0.5)))


def factor_health(evals: DataFrame, min_ir: float = 0.10, limit: int = 3) -> DataFrame:
    """Leaky failure counter and disabled flag after every evaluation.

    ``evals`` = (factor, d, ic_ir, n), one row per evaluation date, so the
    ordered fold runs over a calendar-bounded array per factor.
    """
    # evaluations with fewer than six observations do not count
    seq = evals.where("n >= 6").groupBy("factor").agg(F.array_sort(F.collect_list(F.struct("d", "ic_ir"))).alias("h"))
    zero = F.struct(F.lit(0).alias("fails"), F.lit(False).alias("off"),
                    F.array().cast("array<struct<d:date,fails:int,off:boolean>>").alias("log"))

    def step(s, e):
        fails = F.when(e.ic_ir < min_ir, s.fails + 1).otherwise(F.greatest(F.lit(0), s.fails - 1))
        off = F.when(fails >= limit, True).when(e.ic_ir > min_ir * 1.5, False).otherwise(s.off)
        return F.struct(fails.alias("fails"), off.alias("off"), F.concat(s.log, F.array(F.struct(
            e.d.alias("d"), fails.alias("fails"), off.alias("off")))).alias("log"))
    return (seq.select("factor", F.explode(F.aggregate("h", zero, step)["log"]).alias("e"))
            .select("factor", "e.d", "e.fails", F.col("e.off").alias("disabled")))


def redundancy(ic: DataFrame, summary: DataFrame, threshold: float = 0.75, min_n: int = 6) -> DataFrame:
    """Factor pairs whose aligned recent ICs correlate, with the weaker one.

    Factors are a short list of names, so pairing them is bounded; the pairs
    share an equi-join on the age of the observation.
    """
    w = W.partitionBy("factor").orderBy(F.desc("d"))
    x = ic.select("factor", "ic", F.row_number().over(w).alias("age"))
    a = x.select(F.col("factor").alias("f1"), F.col("ic").alias("x"), "age")
    b = x.select(F.col("factor").alias("f2"), F.col("ic").alias("y"), "age")
    g = a.join(b, "age").where("f1 < f2").groupBy("f1", "f2").agg(
        F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    corr = F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))
    p = g.where(F.col("n") >= min_n).select("f1", "f2", corr.alias("corr")).where(F.abs("corr") > threshold)
    ir = summary.select("factor", "ic_ir")
    p = p.join(ir.select(F.col("factor").alias("f1"), F.col("ic_ir").alias("i1")), "f1").join(
        ir.select(F.col("factor").alias("f2"), F.col("ic_ir").alias("i2")), "f2")
    return p.select("f1", "f2", "corr", F.when(F.col("i1") < F.col("i2"), F.col("f1")).otherwise(F.col("f2")).alias("disabled"))


def factor_stability(ic: DataFrame, window: int = 12) -> DataFrame:
    """Consistency score and first-half/second-half trend of the last ICs."""
    x = last_rows(ic, window)
    n = F.count("*").over(W.partitionBy("factor"))
    x = x.withColumn("n", n).withColumn("pos", F.col("n") - 1 - F.col("age"))
    total = ic.groupBy("factor").agg(F.count("*").alias("total"))
    first = F.col("pos") < F.floor(F.col("n") / 2)
    g = x.groupBy("factor").agg(
        F.abs(F.avg("ic")).alias("m"), F.stddev_pop("ic").alias("s"),
        F.avg(F.when(first, F.col("ic"))).alias("early"), F.avg(F.when(~first, F.col("ic"))).alias("late")).join(total, "factor")
    few = F.col("total") < 4
    return g.select(
        "factor", F.when(few, 0.5).otherwise(F.col("m") / (F.col("m") + F.col("s") + 1e-6)).alias("stability"),
        F.when(few, "unknown").when(F.col("late") > F.col("early") + 0.01, "improving")
        .when(F.col("late") < F.col("early") - 0.01, "degrading").otherwise("stable").alias("trend"))


def live_verdict(n, mean_ic, ir, hit) -> Column:
    return (F.when(n < 12, F.format_string("WAIT — need %d more periods before assessment", (12 - n).cast("int")))
            .when((mean_ic > 0.05) & (ir > 0.5) & (hit > 0.55), "DEPLOY — strong signal quality, proceed to live capital")
            .when((mean_ic > 0.02) & (ir > 0.25), "PAPER — signal exists but needs more history before capital")
            .when((mean_ic > 0) & (hit > 0.5), "MONITOR — weak positive IC, watch for 3 more months")
            .when(mean_ic <= 0, "NO ALPHA — signal has negative IC, do not deploy capital")
            .otherwise("UNCERTAIN — insufficient evidence either way"))


def live_ic(filled: DataFrame) -> DataFrame:
    """IC per signal date over rows (signal_date, regime, ticker, score, is_pick, fwd_return)."""
    ic = spearman(filled, ["signal_date"], "score", "fwd_return").select("signal_date", F.bround("ic", 4).alias("ic"))
    med = grouped_percentiles(filled, ["signal_date"], "fwd_return", {"med": 0.5})
    picks = filled.groupBy("signal_date").agg(F.max("regime").alias("regime"),
                                              F.avg(F.when(F.col("is_pick"), F.col("fwd_return"))).alias("pick_return"))
    return ic.join(picks, "signal_date").join(med, "signal_date").withColumn(
        "pick_beats", F.col("pick_return") > F.col("med"))


def live_ic_report(per_date: DataFrame, by: str | None = None) -> DataFrame:
    """Summary of live ICs, overall or per regime, with the verdict."""
    x = per_date.where("ic is not null")
    g = (x.groupBy(by) if by else x.groupBy()).agg(
        F.count("*").alias("n_filled"), F.avg("ic").alias("mean_ic"), (F.stddev_pop("ic") + 1e-9).alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.max_by("ic", "signal_date").alias("latest_ic"),
        F.avg(F.col("pick_beats").cast("double")).alias("top_pick_accuracy"))
    g = g.withColumn("ic_ir", F.col("mean_ic") / F.col("ic_std"))
    return g.withColumn("verdict", live_verdict(F.col("n_filled"), F.col("mean_ic"), F.col("ic_ir"), F.col("hit_rate")))
