"""Cross-sectional normalisation, composite scores and selection.

Long form throughout: (keys..., ticker, factor, value).  ``keys`` identify the
cross-section, usually the rebalance number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom import params as P
from alphaloom.functions.expr import clip
from alphaloom.operators.scale import attach, bounded, clipped_moments, grouped_percentiles, top_n, wide_percentiles

SECTOR_NEUTRAL = ("momentum_12_1", "momentum", "quality", "roic", "growth")
UNWINSORIZED = ("value",)


def winsorize(df: DataFrame, keys: list[str], value: str = "value", lower: float = 0.025,
              upper: float = 0.975) -> DataFrame:
    """Clip to the group's exact percentiles."""
    cuts = grouped_percentiles(df, keys, value, {"__lo": lower, "__hi": upper})
    return attach(df, cuts, keys, "left").withColumn(value, bounded(F.col(value))).drop("__lo", "__hi")


def winsorized_zscore(df: DataFrame, keys: list[str], value: str = "value", out: str = "z", clip_if: Column | None = None,
                      lower: float = 0.025, upper: float = 0.975, eps: float = 1e-6) -> DataFrame:
    """Clip to the group's percentiles (in the groups of ``clip_if``, over the keys), then standardise: one ordered pass
    and one join of statistics for all groups."""
    stats = clipped_moments(df, keys, value, lower, upper, clip_if)
    x = attach(df, stats, keys, "left").withColumn(value, bounded(F.col(value).cast("double")))
    return x.withColumn(out, (F.col(value) - F.col("__m")) / (F.col("__s") + eps)).drop("__lo", "__hi", "__m", "__s")


def zscore(df: DataFrame, keys: list[str], value: str = "value", out: str = "z", eps: float = 1e-6, stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (population deviation + eps) per group.  ``stats`` = (keys, __m, __s), where ``df`` has not all rows of its groups."""
    if stats is None:
        stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return attach(df, stats, keys).withColumn(out, (F.col(value) - F.col("__m")) / (F.col("__s") + eps)).drop("__m", "__s")


def sector_adjust(df: DataFrame, keys: list[str], value: str = "value", sector: str = "sector") -> DataFrame:
    """Standardise inside each sector of two or more names; lone names pass through."""
    g = keys + [sector]
    stats = df.groupBy(*g).agg(F.count("*").alias("__n"), F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    adj = F.when(F.col("__n") >= 2, (F.col(value) - F.col("__m")) / (F.col("__s") + 1e-6)).otherwise(F.col(value))
    return df.join(stats, g).withColumn(value, adj).drop("__n", "__m", "__s")


def sector_neutral_zscore(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return winsorized_zscore(sector_adjust(df, keys, value), keys, value)


def _with_medians(base: DataFrame, keys: list[str], own: dict[str, str], by_sector: dict[str, str]) -> DataFrame:
    """Medians of columns (column -> name of its median) over the cross-section and over its sectors."""
    for group, names, how in ((keys, own, "left"), ([*keys, "sector"], by_sector, "inner")):
        of = base.select(*group, "ticker", *names)
        base = attach(base, wide_percentiles(of, group, "ticker", {c: {out: 0.5} for c, out in names.items()}).drop("__rows"), group, how)
    return base


def raw_factors(panel: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """The 23 raw factor values from a wide panel of features and fundamentals; ``carry`` names columns to keep beside them.

    Missing inputs take neutral defaults.  ``panel`` needs ticker, sector and the
    feature-pack names; fundamental and alternative columns are optional.
    """
    have = set(panel.columns)

    def g(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in have else F.lit(default)

    base, own = panel.withColumn("__mom", g("ret_3m")), {"__mom": "__med"}
    value = F.lit(0.0)
    if {"pe_ratio", "ps_ratio"} & have:
        pe = F.col("pe_ratio") if "pe_ratio" in have else F.lit(None).cast("double")
        ps = F.col("ps_ratio") if "ps_ratio" in have else F.lit(None).cast("double")
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        base = base.withColumn("__val", F.when(pe.isNotNull() | ps.isNotNull(), -(0.5 * zero(pe) + 0.5 * zero(ps))))
        own["__val"] = "__vmed"
        value = F.coalesce("__val", "__vmed", F.lit(0.0))
    base = _with_medians(base, keys, own, {"__mom": "__smed"})
    m3 = F.col("__mom")
    quality = (0.30 * g("roe_pct") + 0.25 * g("roic_pct") + 0.20 * g("op_margin_pct")
               + 0.15 * g("fcf_margin_pct") + 0.10 * g("gross_margin_pct"))
    return base.select(
        *keys, "ticker", "sector", *(carry or []),
        g("momentum_12_1").alias("momentum_12_1"), m3.alias("momentum"),
        (m3 - g("ret_6m")).alias("price_accel"), (-g("ret_1m")).alias("reversal"),
        (m3 - F.col("__med")).alias("rel_strength"),
        (m3 - F.coalesce(F.col("__smed"), F.lit(0.0))).alias("sector_momentum"),
        quality.alias("quality"), g("piotroski").alias("piotroski"), g("roic_pct").alias("roic"),
        g("revenue_growth").alias("growth"), value.alias("value"), g("fmp_alpha").alias("fmp_alpha"),
        g("earnings_surprise").alias("earnings_surprise"), g("sentiment").alias("sentiment"),
        g("flow_signal").alias("flow_signal"), g("liquidity").alias("liquidity"),
        g("vol", 20.0).alias("volatility"), g("vol_regime", 1.0).alias("vol_regime"),
        g("high_52w_proximity", 0.5).alias("high_52w"), g("trend_slope").alias("trend_slope"),
        g("skewness").alias("skewness"), g("accruals").alias("accruals"),
        g("mean_reversion").alias("mean_reversion"))


FACTORS = ("momentum_12_1", "momentum", "price_accel", "reversal", "rel_strength", "sector_momentum", "quality",
           "piotroski", "roic", "growth", "value", "fmp_alpha", "earnings_surprise", "sentiment", "flow_signal",
           "liquidity", "volatility", "vol_regime", "high_52w", "trend_slope", "skewness", "accruals",
           "mean_reversion")


def normalized(panel: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """z-scores of all 23 factors, one row per name: keys, ticker, sector, ``carry`` and a column for each factor.

    Only statistics of groups are written, and the values near a cut shuffled; the rows stay where they are, and are worked
    out of the panel again by each reader, since they are as large as the panel itself.
    """
    own = ["ticker", "sector", *(carry or [])]
    raw = raw_factors(panel, keys, carry)
    stats = raw.groupBy(*keys, "sector").agg(F.count("*").alias("__n"), *[f(c).alias(f"__{e}_{c}") for c in SECTOR_NEUTRAL for e, f in (("m", F.avg), ("s", F.stddev_pop))])
    adj = {c: F.when(F.col("__n") >= 2, (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-6)).otherwise(F.col(c)) for c in SECTOR_NEUTRAL}
    x = attach(raw, stats, [*keys, "sector"]).withColumns(adj).select(*keys, *own, *[F.col(c).cast("double").alias(c) for c in FACTORS])
    clipped = [c for c in FACTORS if c not in UNWINSORIZED]
    cuts = wide_percentiles(x.select(*keys, "ticker", *clipped), keys, "ticker", {c: {f"__lo_{c}": 0.025, f"__hi_{c}": 0.975} for c in clipped}).drop("__rows")
    y = attach(x, cuts, keys).select(*keys, *own, *[F.greatest(f"__lo_{c}", F.least(f"__hi_{c}", c)).alias(c) if c in clipped else F.col(c) for c in FACTORS])
    moments = y.groupBy(*keys).agg(*[f(c).alias(f"__{e}_{c}") for c in FACTORS for e, f in (("m", F.avg), ("s", F.stddev_pop))])
    return attach(y, moments, keys).select(*keys, *own, *[((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-6)).alias(c) for c in FACTORS])


def stacked_factors(z: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of ``normalized`` as rows (keys, ticker, factor, z)."""
    return z.unpivot([*keys, "ticker"], list(FACTORS), "factor", "z")


def normalize_features(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Long z-scores (keys, ticker, factor, z) for all 23 factors."""
    return stacked_factors(normalized(panel, keys), keys)


def weight_rows(spark, table: dict[str, tuple]) -> DataFrame:
    rows = [(r, f, float(w[i])) for f, w in table.items() for i, r in enumerate(P.REGIMES)]
    return spark.createDataFrame(rows, "regime string, factor string, weight double")


def score_components(z: DataFrame, keys: list[str], table: dict[str, tuple],
                     scales: DataFrame | None = None) -> DataFrame:
    """Weighted clipped z per factor; ``z`` carries the regime label.

    ``scales`` = (keys..., factor, scale) multiplies weights by their IC scale.
    """
    w = weight_rows(z.sparkSession, table)
    j = z.join(w, ["regime", "factor"])
    if scales is not None:
        join_keys = [c for c in scales.columns if c != "scale"]
        j = j.join(scales, join_keys, "left")
        weight = F.col("weight") * F.coalesce("scale", F.lit(1.0))
    else:
        weight = F.col("weight")
    return j.select(*keys, "ticker", "factor", (weight * clip(F.coalesce("z", F.lit(0.0)), -3, 3)).alias("contribution"))


def build_scores(z: DataFrame, vol: DataFrame, keys: list[str], table: dict[str, tuple], adjust: dict[str, float],
                 crisis: dict[str, float], vol_coef: float, scales: DataFrame | None = None) -> DataFrame:
    """Composite score (keys, ticker, score) in one pass over the z-scores, long or one row per name (``normalized``).

    ``z`` carries the regime; ``vol`` = (keys, ticker, vol) is joined only to the
    aggregated rows of long ones, the others carry it and keep what else they carry.
    The weights are one CASE ladder per regime: no join, no wide pivot.
    """
    wide = "factor" not in z.columns
    names = sorted(set(table) | set(adjust) | set(crisis))

    def coef(f: str) -> Column:
        base = table.get(f, (0.0,) * 4)
        w = reduce(lambda acc, ir: acc.when(F.col("regime") == ir[1], F.lit(float(base[ir[0]]))),
                   list(enumerate(P.REGIMES))[1:], F.when(F.col("regime") == P.REGIMES[0], F.lit(float(base[0]))))
        w = w.otherwise(F.lit(float(base[1])))
        if scales is not None:
            w = w * F.coalesce(F.col("__scales")[f] if wide else F.col("scale"), F.lit(1.0))
        extra = F.lit(float(adjust.get(f, 0.0)))
        if f in crisis:
            extra = extra + F.when(F.col("regime") == "crisis", F.lit(crisis[f])).otherwise(0.0)
        return w + extra

    by = [c for c in scales.columns if c != "scale"] if scales is not None else []
    v = F.when(F.coalesce(F.col("vol"), F.lit(0.0)) == 0, 20.0).otherwise(F.col("vol"))
    if wide:
        src, group = z, [c for c in by if c != "factor"]
        if scales is not None:
            maps = scales.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("factor", "scale"))).alias("__scales"))
            src = attach(z, maps, group, "left")
        total = reduce(lambda a, b: a + b, [coef(f) * clip(F.coalesce(F.col(f), F.lit(0.0)), -3, 3) for f in names])
        kept = [c for c in z.columns if c not in (*keys, "ticker", *FACTORS)]
        return src.select(*keys, "ticker", *kept, (total + vol_coef * v).alias("score"))
    src = z if scales is None else z.join(scales, by, "left")
    ladder = reduce(lambda acc, f: acc.when(F.col("factor") == f, coef(f)), names[1:],
                    F.when(F.col("factor") == names[0], coef(names[0]))).otherwise(0.0)
    contrib = ladder * clip(F.coalesce("z", F.lit(0.0)), -3, 3)
    total = src.groupBy(*keys, "ticker").agg(F.sum(contrib).alias("__s"))
    return total.join(vol.select(*keys, "ticker", "vol"), keys + ["ticker"], "left").select(
        *keys, "ticker", (F.col("__s") + vol_coef * v).alias("score"))


def long_term_scores(z: DataFrame, vol: DataFrame, keys: list[str], scales: DataFrame | None = None) -> DataFrame:
    return build_scores(z, vol, keys, P.LONG_TERM_WEIGHTS, P.LONG_TERM_ADJUST, P.LONG_TERM_CRISIS, P.LONG_TERM_VOL, scales=scales)


def swing_scores(z: DataFrame, vol: DataFrame, keys: list[str], scales: DataFrame | None = None) -> DataFrame:
    return build_scores(z, vol, keys, P.SWING_WEIGHTS, P.SWING_ADJUST, P.SWING_CRISIS, P.SWING_VOL, scales=scales)


def select_top(scores: DataFrame, keys: list[str], n: int, key: str = "score") -> DataFrame:
    """Best ``n`` per cross-section; ties go to the smaller ticker."""
    return top_n(scores, keys, [F.desc(key), F.asc("ticker")], n)


def turnover_penalty(scores: DataFrame, previous: DataFrame, keys: list[str], penalty: float = 0.025) -> DataFrame:
    """Small score deduction for names not held before; none when nothing was held.

    ``previous`` = (keys, ticker, prev_weight).
    """
    held_any = previous.select(*keys).distinct().withColumn("__any", F.lit(True))
    j = scores.join(previous, keys + ["ticker"], "left").join(held_any, keys, "left")
    fresh = F.col("__any").isNotNull() & (F.coalesce("prev_weight", F.lit(0.0)) == 0.0)
    return j.withColumn("score", F.col("score") - F.when(fresh, penalty * 0.10).otherwise(0.0)).drop("__any", "prev_weight")


def crowding_penalty(scores: DataFrame, crowding: DataFrame, keys: list[str]) -> DataFrame:
    from alphaloom.functions.expr import crowding_factor
    j = scores.join(crowding.select("ticker", "crowding_score"), "ticker", "left")
    f = crowding_factor(F.coalesce("crowding_score", F.lit(0.5)))
    return j.select(*keys, "ticker", (F.col("score") * f).alias("score"))
