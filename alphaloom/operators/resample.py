"""Validation by resampling and significance tests.

Random draws are integer hashes of (seed, simulation, block), so every run and
every engine sees the same ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.scale import attach, ordered_counts
from alphaloom.sources.storage import materialize

ANN = 252.0 ** 0.5
MOD = 2147483647
SIMS_A_PART = 100


def hash_draw(*parts: Column, seed: int = 42) -> Column:
    """Integer in [0, 2^31 - 1) from integer parts, by two multiplicative rounds."""
    primes = (1000003, 7919, 104729, 15485863)
    h = F.lit(seed).cast("bigint") * 611953
    for p, x in zip(primes, parts):
        h = h + x.cast("bigint") * p
    return (((h % MOD) * 48271) % MOD * 69621) % MOD


def block_bootstrap(curves: DataFrame, sims: int = 500, block: int = 21, seed: int = 42, min_n: int = 60) -> DataFrame:
    """Sharpe, growth and drawdown of every simulation: (series_id, sim, ...).

    A curve is one array (bounded by the calendar); simulations are spread over
    the cluster and each is folded in place, without a join or further shuffle.
    """
    arr = (curves.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("d", "ret"))).alias("h"))
           .select("series_id", F.transform("h", lambda e: e["ret"]).alias("r"))
           .withColumn("n", F.size("r")).where(F.col("n") >= min_n))
    x = arr.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).repartition("series_id", "sim")
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int")),
                         lambda b: (hash_draw(F.col("sim"), b, seed=seed) % (F.col("n") - block)).cast("int"))
    path = F.slice(F.flatten(F.transform(starts, lambda s: F.slice("r", s + 1, F.lit(block)))), F.lit(1), F.col("n"))
    x = x.select("series_id", "sim", "n", path.alias("p"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("v"), F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("dd"))

    def step(a, r):
        v = a["v"] * (1 + r)
        peak = F.greatest(a["peak"], v)
        return F.struct((a["s"] + r).alias("s"), v.alias("v"), peak.alias("peak"), F.least(a["dd"], (v - peak) / (peak + 1e-9)).alias("dd"))
    x = x.withColumn("f", F.aggregate("p", zero, step)).withColumn("mu", F.col("f.s") / F.col("n"))
    sq = F.aggregate("p", F.lit(0.0), lambda a, r: a + (r - F.col("mu")) * (r - F.col("mu")))
    return x.select("series_id", "sim", "n", (F.col("mu") / (F.sqrt(sq / F.col("n")) + 1e-9) * ANN).alias("sharpe"),
                    (F.pow(F.col("f.v"), 1.0 / F.greatest(F.col("n") / 252.0, F.lit(0.01))) - 1).alias("cagr"), F.col("f.dd").alias("max_drawdown"))


def bootstrap_verdict(gt0: Column, gt1: Column) -> Column:
    pct = lambda x: F.concat(F.round(x * 100, 0).cast("int").cast("string"), F.lit("%"))
    return (F.when(gt1 > 0.50, F.concat(F.lit("ROBUST: >50% of simulations produce Sharpe>1 ("), pct(gt1), F.lit(")")))
            .when(gt0 > 0.70, F.concat(F.lit("ACCEPTABLE: "), pct(gt0), F.lit(" of simulations positive Sharpe")))
            .otherwise(F.concat(F.lit("FRAGILE: only "), pct(gt0), F.lit(" of simulations positive Sharpe"))))


def bootstrap_summary(sims: DataFrame) -> DataFrame:
    g = sims.groupBy("series_id").agg(
        F.count("*").alias("n_simulations"), F.avg("sharpe").alias("sharpe_mean"), F.stddev_pop("sharpe").alias("sharpe_std"),
        F.percentile("sharpe", 0.05).alias("sharpe_p5"), F.percentile("sharpe", 0.95).alias("sharpe_p95"),
        F.avg("cagr").alias("cagr_mean"), F.percentile("cagr", 0.05).alias("cagr_p5"), F.avg("max_drawdown").alias("maxdd_mean"),
        F.avg((F.col("sharpe") > 0).cast("double")).alias("p_sharpe_gt_0"), F.avg((F.col("sharpe") > 1).cast("double")).alias("p_sharpe_gt_1"))
    return g.withColumn("verdict", bootstrap_verdict(F.col("p_sharpe_gt_0"), F.col("p_sharpe_gt_1")))


def joint_bootstrap(curves: DataFrame, sims: int = 500, block: int = 21, seed: int = 42, min_n: int = 60) -> DataFrame:
    """Each curve's own Sharpe and studentised mean beside those of every simulation, blocks of dates drawn for all curves at once.

    A simulation takes the same dates from every curve, so what curves have in common stays.  Curves share one calendar; a
    date without a return counts as zero, null returns too; curves with fewer than ``min_n`` returns drop, and a calendar
    no longer than a block gives no rows.  A mean's error comes from its blocks: t = (mean - own mean) / error.
    A curve is one array of running sums (bounded by the calendar), so a block costs two look-ups whatever its length.
    Gives (series_id, n_returns, sim, model_sharpe, model_t, sharpe, t).
    """
    x = curves.where("series_id is not null and d is not null").select("series_id", "d", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    dates = x.select("d").distinct()
    pos = materialize(dates.select("d", (F.row_number().over(W.orderBy("d")) - 1).alias("pos"), F.count("*").over(W.partitionBy()).alias("n")), "dates")
    w = W.partitionBy("series_id").orderBy("pos")
    run = x.join(pos, "d").select("series_id", "n", "pos", F.sum("ret").over(w).alias("s"), F.sum(F.col("ret") * F.col("ret")).over(w).alias("q"))
    g = run.groupBy("series_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "s", "q"))).alias("h"))
    g = g.withColumn("n_returns", F.size("h")).where((F.col("n_returns") >= min_n) & (F.col("n") > block))

    def steps(field):
        """Running sum before each date, and the whole sum behind the last."""
        end = lambda i: F.coalesce(F.get("h", i + 1)["pos"], F.col("n").cast("int"))
        held = F.flatten(F.transform("h", lambda e, i: F.array_repeat(e[field], end(i) - e["pos"])))
        return F.concat(F.array_repeat(F.lit(0.0), F.get("h", F.lit(0))["pos"] + 1), held)
    g = g.select("series_id", "n_returns", F.col("n").cast("int").alias("n"), steps("s").alias("s"), steps("q").alias("q"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("s", "q", "bb", "lb", "ll")])
    blocks = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))

    def figures(start):
        """Sums over the blocks that begin where ``start(block number)`` says; the last one is cut to the calendar's length."""
        # step by step: each value of a block is worked out once
        at = F.transform(blocks, lambda b: F.struct(start(b).alias("at"), F.least(F.lit(block), F.col("n") - b * block).alias("size")))
        cut = F.transform(at, lambda e: F.struct((F.get("s", e["at"] + e["size"]) - F.get("s", e["at"])).alias("s"),
                                                 (F.get("q", e["at"] + e["size"]) - F.get("q", e["at"])).alias("q"), e["size"].alias("size")))
        return F.aggregate(cut, zero, lambda a, e: F.struct(
            (a["s"] + e["s"]).alias("s"), (a["q"] + e["q"]).alias("q"), (a["bb"] + e["s"] * e["s"]).alias("bb"),
            (a["lb"] + e["size"] * e["s"]).alias("lb"), (a["ll"] + e["size"] * e["size"]).alias("ll")))

    def mean_sharpe_error(f):
        mu = f["s"] / F.col("n")
        sd = F.sqrt(F.greatest(f["q"] / F.col("n") - mu * mu, F.lit(0.0)))
        err = F.sqrt(F.greatest(f["bb"] - 2 * mu * f["lb"] + mu * mu * f["ll"], F.lit(0.0))) / F.col("n")
        return mu, mu / (sd + 1e-9) * ANN, err
    draw = lambda sim: lambda b: (hash_draw(sim, b, seed=seed) % (F.col("n") - block)).cast("int")
    own, own_sharpe, own_err = mean_sharpe_error(F.col("own"))
    g = g.withColumn("own", figures(lambda b: b * block)).withColumn("mean", own).withColumn("model_sharpe", own_sharpe).withColumn(
        "model_t", F.when(own_err > 1e-12, own / own_err).otherwise(0.0))
    # work, not bytes, decides the tasks: a curve's simulations are dealt in parts, to a number of tasks that stays
    spark = curves.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    g = g.withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(sims - 1), F.lit(SIMS_A_PART)))).repartition(tasks, "series_id", "from")
    part = F.sequence(F.col("from"), F.least(F.col("from") + (SIMS_A_PART - 1), F.lit(sims - 1)))
    drawn = F.transform(part, lambda sim: F.struct(sim.alias("sim"), figures(draw(sim)).alias("f")))
    x = g.select("series_id", "n_returns", "n", "mean", "model_sharpe", "model_t", F.explode(drawn).alias("e"))
    mu, sharpe, err = mean_sharpe_error(F.col("e.f"))
    return x.select("series_id", "n_returns", "e.sim", "model_sharpe", "model_t", sharpe.alias("sharpe"),
                    F.when(err > 1e-12, (mu - F.col("mean")) / err).otherwise(0.0).alias("t"))


def model_against_resampled(joint: DataFrame) -> DataFrame:
    """Where each curve's own Sharpe stands among its simulations, and how likely its t is by chance.

    ``p_value`` is the share of simulations whose t reaches the own one; ``p_family`` the share in which the best curve's
    does, so that the best of many curves is not taken for skill.  ``joint``: rows of :func:`joint_bootstrap`.
    """
    best = materialize(joint.groupBy("sim").agg(F.max("t").alias("best")), "best")      # one row a simulation
    share = lambda cond: F.avg(cond.cast("double"))
    g = joint.join(best, "sim").groupBy("series_id").agg(
        F.max("n_returns").alias("n_returns"), F.count("*").alias("n_simulations"), F.avg("sharpe").alias("sharpe_mean"),
        F.stddev_pop("sharpe").alias("sharpe_std"), F.max("model_sharpe").alias("model_sharpe"),
        share(F.col("sharpe") <= F.col("model_sharpe")).alias("sharpe_rank"), F.max("model_t").alias("model_t"),
        share(F.col("t") >= F.col("model_t")).alias("p_value"), share(F.col("best") >= F.col("model_t")).alias("p_family"),
        share(F.col("sharpe") > 0).alias("p_sharpe_gt_0"), share(F.col("sharpe") > 1).alias("p_sharpe_gt_1"))
    return g.withColumn("verdict", bootstrap_verdict(F.col("p_sharpe_gt_0"), F.col("p_sharpe_gt_1")))


def placebo_scores(panel: DataFrame, trials: int, seed: int = 42, best: int | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Standard normal score per (trial, rebalance, ticker), from two hash draws: the placebo's only difference.

    With ``best``, every name is drawn in every trial as well, but of the rows only those that can be among the so many
    best of their (strategy, k) are returned, and beside them the mean and deviation of all draws (strategy, k, __m, __s):
    a trial then costs a pass over arrays, not a row for each name.
    """
    if best is not None:
        return _best_draws(panel, trials, seed, best)
    x = panel.select("k", "ticker", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    # the parts change places, lest one draw be a shift of the other
    u, v = ((hash_draw(*map(F.col, parts), seed=seed) + 0.5) / MOD for parts in (("trial", "k", "ticker"), ("ticker", "trial", "k")))
    normal = F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * v)
    return x.select(F.concat(F.lit("trial"), F.col("trial")).alias("strategy"), "k", "ticker", normal.alias("score"))


DRAWN_NAMES = 2_000_000     # names that a task holds at once; of a rebalance so many are drawn in all trials together
DRAWN_TOGETHER = 20_000


def _hashes(*parts: np.ndarray, seed: int) -> np.ndarray:
    """``hash_draw`` of arrays; remainders keep their sign, as SQL's do."""
    h = np.int64(seed * 611953) + sum(p * x for p, x in zip((1000003, 7919, 104729), parts))
    return np.fmod(np.fmod(np.fmod(h, MOD) * 48271, MOD) * 69621, MOD)


def _best_draws(panel: DataFrame, trials: int, seed: int, best: int) -> tuple[DataFrame, DataFrame]:
    names = panel.select("k", "ticker", F.col("k").cast("long").alias("__k"), F.col("ticker").cast("long").alias("__t"))
    out = "trial int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema.fields[:2]) + ", score double, n long, s double, q double"
    trial = np.arange(trials, dtype=np.int64)[:, None]

    def draws(k: int, ticker: np.ndarray) -> np.ndarray:
        u, v = ((_hashes(*parts, seed=seed) + 0.5) / MOD for parts in ((trial, np.int64(k), ticker[None, :]), (ticker[None, :], trial, np.int64(k))))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * v)

    def of_rebalance(rows: pa.Table, k: int, ticker: np.ndarray, at: np.ndarray):
        """The best of the rows ``at``, and a row of sums for each trial."""
        z = draws(k, ticker[at])
        none = ~np.isfinite(z)
        low = np.where(none, -np.inf, z)
        # a score within rounding of the last of the best may stand beside it once it is standardised
        cut = np.partition(low, -best, axis=1)[:, -best][:, None] - 1e-9 if len(at) > best else np.full((trials, 1), -np.inf)
        j, i = np.nonzero((low >= cut) | (none & (cut == -np.inf)))
        zero = np.where(none, 0.0, z)
        yield _rows(rows, j, at[i], pa.array(z[j, i], mask=none[j, i]), None)
        yield _rows(rows, np.arange(trials), np.repeat(at[:1], trials), None, ((~none).sum(1), zero.sum(1), (zero * zero).sum(1)))

    def _rows(rows, j, at, score, sums):
        key = rows.select(["k", "ticker"]).take(pa.array(at))
        size = len(j)
        n, s, q = (pa.array(x) for x in sums) if sums else (pa.nulls(size, pa.int64()), pa.nulls(size, pa.float64()), pa.nulls(size, pa.float64()))
        t = pa.table({"trial": pa.array(j.astype(np.int32)), "k": key["k"], "ticker": key["ticker"], "score": score if score is not None else pa.nulls(size, pa.float64()),
                      "n": n.cast(pa.int64()), "s": s, "q": q})
        return t.combine_chunks()

    def flush(batches: list):
        t = pa.Table.from_batches(batches)
        whole = (t["__k"].is_valid().to_numpy() & t["__t"].is_valid().to_numpy())
        for at in np.nonzero(~whole)[0]:      # no number to draw from: no score
            yield _rows(t, np.arange(trials), np.repeat(at, trials), None, None)
        k, ticker = t["__k"].fill_null(0).to_numpy(), t["__t"].fill_null(0).to_numpy()
        order = np.nonzero(whole)[0]
        order = order[np.argsort(k[order], kind="stable")]
        for group in np.split(order, np.nonzero(np.diff(k[order]))[0] + 1):
            for a in range(0, len(group), DRAWN_TOGETHER):
                at = group[a:a + DRAWN_TOGETHER]
                yield from of_rebalance(t, k[at[0]], ticker, at)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= DRAWN_NAMES:
                for t in flush(held):
                    yield from t.to_batches()
                held, size = [], 0
        if size:
            for t in flush(held):
                yield from t.to_batches()

    got = materialize(names.mapInArrow(run, out).withColumn("strategy", F.concat(F.lit("trial"), F.col("trial"))), "draws")
    n = F.sum("n")
    m = F.when(n > 0, F.sum("s") / n)
    stats = got.where("n is not null").groupBy("strategy", "k").agg(m.alias("__m"), F.when(n > 0, F.sqrt(F.greatest(F.sum("q") / n - m * m, F.lit(0.0)))).alias("__s"))
    return got.where("n is null").select("strategy", "k", "ticker", "score"), stats


def placebo_verdict(model: Column, p: Column, mean: Column) -> Column:
    f = lambda x, k: F.format_string(f"%.{k}f", x)
    return (F.when((p < 0.05) & (model > mean), F.concat(F.lit("SIGNIFICANT: model beats random at p="), f(p, 3), F.lit(" — alpha likely real")))
            .when(p < 0.10, F.concat(F.lit("BORDERLINE: p="), f(p, 3), F.lit(" — need more data to confirm alpha")))
            .when(model <= mean, F.concat(F.lit("NO ALPHA: model ("), f(model, 2), F.lit(") does not beat random ("), f(mean, 2), F.lit(")")))
            .otherwise(F.concat(F.lit("NOT SIGNIFICANT: p="), f(p, 3), F.lit(" — cannot distinguish from luck"))))


def placebo_summary(trial_sharpes: DataFrame, model: DataFrame) -> DataFrame:
    """Empirical p-value of each model Sharpe against the trials.

    trial_sharpes: (sharpe); model: (series_id, model_sharpe).
    """
    t = trial_sharpes.agg(F.avg("sharpe").alias("random_mean"), F.stddev_pop("sharpe").alias("random_std"),
                          F.percentile("sharpe", 0.05).alias("random_p5"), F.percentile("sharpe", 0.95).alias("random_p95"),
                          F.count("*").alias("n_trials"))
    pairs = model.crossJoin(F.broadcast(trial_sharpes.select("sharpe")))        # a few models by a fixed number of trials
    beaten = pairs.groupBy("series_id").agg(F.count_if(F.col("sharpe") >= F.col("model_sharpe")).alias("__b"))
    j = model.join(beaten, "series_id").crossJoin(F.broadcast(t))               # one row
    return j.withColumn("p_value", F.col("__b") / F.col("n_trials")).drop("__b").withColumn(
        "verdict", placebo_verdict(F.col("model_sharpe"), F.col("p_value"), F.col("random_mean")))


def sharpe_sample(curves: DataFrame) -> DataFrame:
    """Annualised Sharpe with the sample deviation, per curve of values."""
    w = W.partitionBy("series_id").orderBy("d")
    r = curves.select("series_id", (F.try_divide(F.col("value"), F.lag("value").over(w)) - 1).alias("r"))
    g = r.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return g.select("series_id", F.when(F.col("n") < 10, 0.0).otherwise(F.col("m") / (F.col("s") + 1e-10) * ANN).alias("sharpe"))


# ---- significance ----

def _betainc(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by Lentz's continued fraction, vectorised."""
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    y = np.where(flip, 1.0 - x, x)
    lg = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - (lg(p) + lg(q) - lg(p + q))) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1.0 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    f = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    res = np.where(y <= 0, 0.0, front * f)
    return np.where(flip, 1.0 - res, res)


def two_sided_t(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(over="ignore"):
        x = df / (df + t * t)
    return np.clip(_betainc(df / 2.0, 0.5, x), 0.0, 1.0)


def t_test(ic: DataFrame, by: str = "factor", value: str = "ic") -> DataFrame:
    """One-sample t-test of the mean per group; fewer than four rows give p = 1."""
    @F.pandas_udf("double")
    def pval(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = (t.notna() & (df > 0)).to_numpy()
        out = np.ones(len(t))
        if ok.any():
            out[ok] = two_sided_t(t.to_numpy(float)[ok], df.to_numpy(float)[ok])
        return pd.Series(out)
    v = F.col(value)
    g = ic.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.stddev_pop(v).alias("sp"))
    few = F.col("n") < 4
    g = g.withColumn("t_stat", F.when(few, 0.0).otherwise(F.try_divide(F.col("m"), F.col("s") / F.sqrt("n"))))
    p = F.when(few, 1.0).otherwise(pval("t_stat", (F.col("n") - 1).cast("double")))
    return g.withColumn("p_value", p).select(by, "n", "t_stat", "p_value", (F.col("p_value") < 0.05).alias("significant"),
                                             F.when(few, 0.0).otherwise(F.col("m") / (F.col("sp") + 1e-6)).alias("ic_ir"))


def benjamini_hochberg(tests: DataFrame, fdr: float = 0.05, p: str = "p_value", family: list[str] | None = None) -> DataFrame:
    """Significance under false-discovery control within a family of tests, of any size.

    The cut is the largest p-value within its share of the rank, found over counts of distinct p-values.
    """
    keys = family or ["__all"]
    x = tests if family else tests.withColumn("__all", F.lit(1))
    o = ordered_counts(x.select(*keys, p), keys, p)
    rank = F.col("__before") + F.col("__c")
    cut = o.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(p) <= rank / F.col("__n") * fdr, rank)) / F.max("__n") * fdr, F.lit(0.0)).alias("__cut"))
    return attach(x, cut, keys, "left").withColumn("bh_significant", F.col(p) <= F.col("__cut")).drop("__cut", "__all")


def factor_significance(ic: DataFrame, fdr: float = 0.10, min_n: int = 6) -> DataFrame:
    return benjamini_hochberg(t_test(ic).where(F.col("n") >= min_n), fdr)


def validation_checklist(m: DataFrame) -> DataFrame:
    """Seven pass/fail checks per strategy with count and deployment verdict.

    m: series_id, sharpe, excess_vs_market, excess_vs_ew, max_drawdown, cagr,
    placebo_p, live_n, live_ic.  Missing inputs fail their check.
    """
    live = (F.coalesce("live_n", F.lit(0)) >= 12) & (F.coalesce("live_ic", F.lit(0.0)) > 0)
    checks = {
        "sharpe_ok": F.col("sharpe") > 1.0, "beats_market": F.col("excess_vs_market") > 0, "beats_equal_weight": F.col("excess_vs_ew") > 0,
        "drawdown_ok": F.col("max_drawdown") > -0.20, "cagr_ok": F.col("cagr") > 0.10,
        "placebo_ok": F.coalesce("placebo_p", F.lit(1.0)) < 0.10, "live_ic_ok": live,
    }
    x = m.select("series_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    total = sum((F.col(n).cast("int") for n in checks), F.lit(0))
    return x.withColumn("passed", total).withColumn("verdict", (
        F.when((F.col("passed") >= 6) & F.col("live_ic_ok"), "[DEPLOY] — Start with $500-$1,000 and monitor execution slippage")
        .when(F.col("passed") >= 5, "[PAPER] — Strong backtest but live IC not yet validated")
        .when(F.col("passed") >= 3, "[NOT READY] — Address failing checks before deploying capital")
        .otherwise("[DO NOT DEPLOY] — Multiple critical failures")))
