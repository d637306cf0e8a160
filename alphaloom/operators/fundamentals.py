"""Statement loading, ratios, scores and estimate signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.expr import c, clip, div_of, growth_of, pct_of
from alphaloom.operators.asof import asof_backward, latest_per_key
from alphaloom.sources.storage import stacked


def load_statements(raw: DataFrame, aliases: dict[str, list[str]], publish: str | None = None,
                    report: str = "report_date", lag_days: int = 60) -> DataFrame:
    """Resolve column aliases and derive the availability date; undated rows drop.

    ``aliases`` maps target name -> candidate source names, first non-null wins.
    """
    have = set(raw.columns)
    cols = []
    for target, names in aliases.items():
        found = [F.col(n).cast("double") for n in names if n in have]
        cols.append((F.coalesce(*found) if found else F.lit(None).cast("double")).alias(target))
    lagged = F.date_add(F.col(report), lag_days)
    avail = F.greatest(F.col(publish).cast("date"), lagged) if publish and publish in have else lagged
    return (raw.select("ticker", F.col(report).cast("date").alias("report_date"), avail.alias("available_date"), *cols)
            .where("available_date is not null"))


def merge_annual_quarterly(annual: DataFrame, quarterly: DataFrame) -> DataFrame:
    """Union of both frequencies, one row per availability date; quarterly wins."""
    u = stacked(annual.withColumn("freq", F.lit("A")), quarterly.withColumn("freq", F.lit("Q")), allow_missing=True)
    return latest_per_key(u, ["ticker", "available_date"], [F.desc("freq"), F.desc("report_date")])


def ratios(f: DataFrame) -> DataFrame:
    """Margins, returns, leverage and quality composites from statement columns."""
    fcf = F.col("cfo") - F.abs("capex")
    x = f.select(
        "*", fcf.alias("fcf"),
        pct_of("net_income", "equity").alias("roe_pct"),
        pct_of("net_income", "total_assets").alias("roa_pct"),
        pct_of("ebit", F.col("equity") + F.col("total_debt")).alias("roic_pct"),
        pct_of("net_income", "revenue").alias("net_margin_pct"),
        pct_of("gross_profit", "revenue").alias("gross_margin_pct"),
        pct_of("ebit", "revenue").alias("op_margin_pct"),
        pct_of(fcf, "revenue").alias("fcf_margin_pct"),
        div_of("total_debt", "equity").alias("de_ratio"),
        div_of("current_assets", "current_liab").alias("current_ratio"))
    z = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    return x.withColumn("quality_score", F.bround(
        0.25 * z("roe_pct") + 0.25 * z("roic_pct") + 0.20 * z("op_margin_pct")
        + 0.20 * z("fcf_margin_pct") + 0.10 * z("roa_pct"), 2))


def yoy_quarterly(f: DataFrame, cols: list[str]) -> DataFrame:
    """Change on the row four reports earlier, percent, 0 when undefined."""
    w = W.partitionBy("ticker").orderBy("report_date")
    grow = lambda n: F.coalesce(F.when(F.lag(n, 4).over(w) != 0, (F.col(n) / F.lag(n, 4).over(w) - 1) * 100), F.lit(0.0))
    return f.select("*", *[grow(n).alias(f"{n}_yoy") for n in cols])


def with_prior_year(probes: DataFrame, f: DataFrame, probe_time: str = "d") -> DataFrame:
    """Attach the current statement and the one known 380 days earlier (``prior_*``)."""
    now = asof_backward(probes, f, probe_time=probe_time)
    return asof_backward(now, f, probe_time=probe_time, shift_days=380, prefix="prior_")


def known_from(f: DataFrame) -> DataFrame:
    """(ticker, t, current and ``prior_`` columns): what is known of a ticker's statements from day ``t`` on.

    That changes only when a statement becomes available, and when it becomes the prior one 380 days later: two rows a
    statement stand for all dates.
    """
    t = F.explode(F.array("available_date", F.date_add("available_date", 380)))
    return with_prior_year(f.select("ticker", t.alias("t")).distinct(), f, probe_time="t").drop("available_date", "prior_available_date")


def growth(df: DataFrame) -> DataFrame:
    return df.select("*", growth_of("revenue", "prior_revenue").alias("revenue_growth"),
                     growth_of("net_income", "prior_net_income").alias("ni_growth"))


def piotroski(df: DataFrame) -> DataFrame:
    """Nine-test score from current and ``prior_`` columns.

    A zero or missing input takes its default; the share-count test has no
    input and always passes, so a name without statements scores 1.
    """
    def val(name: str, default: float = 0.0):
        x = F.col(name).cast("double")
        return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)

    def pair(name: str, default: float = 0.0):
        return val(name, default), val(f"prior_{name}", default)

    roa, roa_p = pair("roa_pct")
    gm, gm_p = pair("gross_margin_pct")
    de, de_p = pair("de_ratio", 999.0)
    cr, cr_p = pair("current_ratio")
    rev, rev_p = pair("revenue")
    ta, ta_p = pair("total_assets", 1.0)
    cfo, ni = val("cfo"), val("net_income")
    tests = [roa > 0, cfo > 0, roa > roa_p, cfo > ni, de < de_p, cr > cr_p, gm > gm_p, rev / ta > rev_p / ta_p]
    score = F.lit(1)
    for t in tests:
        score = score + t.cast("int")
    return df.withColumn("piotroski", F.least(score, F.lit(9)))


def accruals(ni="net_income", cfo="cfo", assets="total_assets"):
    a = F.coalesce(c(assets), F.lit(1.0))
    x = (F.coalesce(c(ni), F.lit(0.0)) - F.coalesce(c(cfo), F.lit(0.0))) / a
    return F.when(a > 0, clip(x, -0.5, 0.5)).otherwise(0.0)


def eps_surprises(eps: DataFrame) -> DataFrame:
    """(ticker, d, actual, estimated) -> surprise percent, 2 digits."""
    pct = F.when(F.col("estimated") != 0, (F.col("actual") - F.col("estimated")) / F.abs("estimated") * 100).otherwise(0.0)
    return eps.withColumn("surprise_pct", F.bround(pct, 2))


def eps_score(surprises: DataFrame) -> DataFrame:
    """Magnitude, hit rate and momentum of the last four surprises per ticker.

    Reports after the as-of date must be filtered by the caller.
    """
    w = W.partitionBy("ticker").orderBy(F.desc("d"))
    last = surprises.withColumn("rn", F.row_number().over(w)).where("rn <= 4")
    g = last.groupBy("ticker").agg(
        F.max(F.when(F.col("rn") == 1, F.col("surprise_pct"))).alias("s0"),
        F.max(F.when(F.col("rn") == 2, F.col("surprise_pct"))).alias("s1"),
        F.avg(F.when(F.col("surprise_pct") > 0, 1.0).otherwise(0.0)).alias("hit"))
    mom = F.coalesce(clip(F.col("s0") - F.col("s1"), -30, 30) / 30, F.lit(0.0))
    return g.select("ticker", (0.5 * clip("s0", -50, 50) / 50 + 0.3 * (F.col("hit") - 0.5) * 2 + 0.2 * mom).alias("eps_score"))


def revision_score(estimates: DataFrame) -> DataFrame:
    """Newest estimate against the third newest (or oldest of two), clipped +-3."""
    w = W.partitionBy("ticker").orderBy(F.desc("d"))
    last = estimates.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    g = last.groupBy("ticker").agg(
        F.max(F.when(F.col("rn") == 1, F.col("eps"))).alias("recent"),
        F.max_by("eps", "rn").alias("older"), F.count("*").alias("n"))
    score = F.when((F.col("n") >= 2) & (F.col("older") != 0),
                   clip((F.col("recent") - F.col("older")) / F.abs("older") * 10, -3, 3)).otherwise(0.0)
    return g.select("ticker", score.alias("revision_score"))


def institutional_flow(holders: DataFrame) -> DataFrame:
    """(ticker, holder, shares, change) -> net buyer share in [-1, 1] and shares held."""
    g = holders.groupBy("ticker").agg(
        F.count_if(F.col("change") > 0).alias("buyers"), F.count_if(F.col("change") < 0).alias("sellers"),
        F.count("*").alias("total_holders"), F.sum("shares").alias("shares_held"))
    return g.withColumn("ownership_score", clip((F.col("buyers") - F.col("sellers")) / F.greatest("total_holders", F.lit(1)), -1, 1))


def price_target_upside(target, price):
    return F.when((c(target) > 0) & (c(price) > 0), F.bround((c(target) - c(price)) / c(price), 4)).otherwise(0.0)


def growth_gap(earnings, revenue):
    """(earnings growth - revenue growth) * 100 with missing sides as 0."""
    return (F.coalesce(c(earnings), F.lit(0.0)) - F.coalesce(c(revenue), F.lit(0.0))) * 100


def restatement_flags(v1: DataFrame, v2: DataFrame, keys: list[str], metrics: list[str], threshold: float = 0.10) -> DataFrame:
    """Metrics revised by more than ``threshold`` between two versions."""
    a = v1.unpivot(keys, metrics, "metric", "v1")
    b = v2.unpivot(keys, metrics, "metric", "v2")
    j = a.join(b, keys + ["metric"]).where("v1 is not null and v2 is not null and abs(v1) >= 1e-6")
    rev = F.abs(F.col("v2") - F.col("v1")) / F.abs("v1")
    return j.withColumn("revision", rev).where(F.col("revision") > threshold)


def crowding_score(holders: DataFrame, adv: DataFrame, inst_pct: DataFrame | None = None) -> DataFrame:
    """Ownership, concentration (top 5 of holders) and liquidity risk in [0, 1]."""
    w = W.partitionBy("ticker").orderBy(F.desc("shares"), F.asc("holder"))
    total = holders.groupBy("ticker").agg(F.sum("shares").alias("all_shares"))
    # the rank filter is pruned per task before the shuffle
    top = (holders.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
           .groupBy("ticker").agg(F.sum("shares").alias("top_shares")))
    x = total.join(top, "ticker").join(adv.select("ticker", "adv"), "ticker", "left")
    x = x.join(inst_pct, "ticker", "left") if inst_pct is not None else x.withColumn("inst_pct", F.lit(None).cast("double"))
    conc = F.col("top_shares") / (F.col("all_shares") + 1e-9)
    liq = clip(1.0 - F.coalesce("adv", F.lit(50_000_000.0)) / 100_000_000.0, 0.0, 1.0)
    score = clip(0.50 * F.coalesce("inst_pct", F.lit(0.5)) + 0.30 * conc + 0.20 * liq, 0.0, 1.0)
    return x.select("ticker", conc.alias("concentration"), liq.alias("liquidity_risk"), score.alias("crowding_score")).withColumn(
        "risk_level", F.when(F.col("crowding_score") >= 0.6, "high").when(F.col("crowding_score") >= 0.4, "medium").otherwise("low"))


def coverage_report(facts: DataFrame, source: str = "source") -> DataFrame:
    return facts.groupBy("ticker", source).agg(F.count("*").alias("n_rows"), F.min("available_date").alias("first_date"))
