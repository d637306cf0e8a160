"""Keyword sentiment, question routing, entity and claim extraction on tables.

Everything is Column expressions over whole texts; no UDFs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.expr import clip, time_decay
from alphaloom.params import NEGATIVE_WORDS, POSITIVE_WORDS
from alphaloom.sources.storage import stacked

STRIP = "[.,:;!?()\\[\\]{}\"']+"


def tokens(text: Column) -> Column:
    """Distinct lower-case whitespace tokens without edge punctuation."""
    raw = F.split(F.lower(text), r"\s+")
    return F.array_distinct(F.transform(raw, lambda t: F.regexp_replace(t, f"^{STRIP}|{STRIP}$", "")))


def keyword_sentiment(df: DataFrame, text: str = "text", positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS) -> DataFrame:
    """Adds sentiment in [-1, 1] and confidence in [0.5, 1]."""
    t = df.withColumn("__t", tokens(F.coalesce(F.col(text), F.lit(""))))
    n = lambda words: F.size(F.array_intersect("__t", F.array(*[F.lit(w) for w in words])))
    t = t.withColumn("__p", n(positive)).withColumn("__n", n(negative))
    return t.withColumn("sentiment", clip((F.col("__p") - F.col("__n")) / 3.0, -1.0, 1.0)).withColumn(
        "confidence", 0.5 + F.least(F.lit(0.5), (F.col("__p") + F.col("__n")) / 6.0)).drop("__t", "__p", "__n")


def aggregate_sentiment(items: DataFrame, now: Column, half_life: float = 24.0, model_score: str | None = None, **lexicon) -> DataFrame:
    """Recency- and confidence-weighted sentiment per ticker with volume and strength.

    A supplied model score takes over where present, with confidence 0.85.
    """
    s = keyword_sentiment(items, **lexicon)
    if model_score:
        s = s.withColumn("sentiment", F.coalesce(F.col(model_score), "sentiment")).withColumn(
            "confidence", F.when(F.col(model_score).isNotNull(), 0.85).otherwise(F.col("confidence")))
    w = F.greatest(F.lit(0.01), F.col("confidence") * time_decay("published_at", now, half_life))
    g = s.groupBy("ticker").agg(F.sum(F.col("sentiment") * w).alias("a"), F.sum(w).alias("b"), F.count("*").alias("news_volume"))
    score = F.coalesce(F.try_divide(F.col("a"), F.col("b")), F.lit(0.0))
    return g.select("ticker", score.alias("sentiment"), "news_volume", (score * F.log1p("news_volume")).alias("strength"))


# Routing patterns per question type with the base confidence.
RULES = (
    ("explain_pnl", 0.88, (
        "why.*(?:lost|lose|down|negative|underperform|drop|fell|decline)",
        ".*(?:lose|lost).*money",
        "(?:pnl|p&l|profit|loss|return|performance).*(?:why|explain|what caused)",
        "what.*(?:caused|drove|happened to).*(?:return|performance|portfolio)",
        "how did.*(?:portfolio|fund|strategy).*(?:do|perform)")),
    ("explain_factor", 0.90, (
        "(?:which|what).*factor.*(?:work|best|top|worst|lead|driv|contribut)",
        "factor.*(?:attribution|breakdown|decompos|contribution|explai)",
        "(?:momentum|quality|value|sentiment|flow|liquidity|piotroski).*(?:score|signal|ic|work)",
        "how.*(?:factor|signal).*perform",
        "(?:ic|information coefficient).*(?:factor|signal)")),
    ("explain_risk", 0.87, (
        "(?:drawdown|risk|volatility|var|cvar|exposure)",
        "(?:how much|what is).*(?:risk|loss|drawdown|down from)",
        "stop.?loss|circuit.?breaker|halt",
        "(?:current|today).*(?:risk|exposure|position)",
        "(?:portfolio|strategy).*(?:risk|safe|dangerous)")),
    ("answer_audit", 0.85, (
        "(?:what|why).*(?:rebalanc|trade|buy|sell|decision|chose)",
        "(?:on|at|during).*(?:rebalanc|trade)",
        "audit.*(?:log|trail|record|history)",
        "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|\\d{4}-\\d{2}-\\d{2}).*(?:rebalanc|trade|decision)",
        "(?:last|previous).*(?:rebalanc|trade)")),
    ("strategy_health", 0.88, (
        "(?:should|can|ready).*(?:deploy|invest|trade|live)",
        "(?:is|are).*(?:signal|strategy|factor).*(?:valid|working|good|real|alpha)",
        "(?:ic|information coefficient).*(?:positive|negative|valid|significant)",
        "(?:placebo|monte carlo|backtest).*(?:result|show|say|indicate)",
        "(?:deploy|invest|trade).*(?:capital|money|real)")),
    ("meta_help", 0.95, (
        "(?:what can you|what do you|how do you|help|assist)",
        "(?:what question|what topic|what can i ask)",
        "(?:explain|describe).*(?:yourself|how you work|your capabilities)",
        "hello|hi |hey |help me")),
)

# Names recognised in questions.
TICKERS = (
    "AAPL", "MSFT", "NVDA", "AMZN", "GOOGL", "META", "TSLA", "JPM", "UNH", "XOM", "AVGO", "LLY", "V", "MA", "PG", "COST",
    "HD", "KO", "PEP", "ADBE", "CRM", "CSCO", "ORCL", "AMD", "QCOM", "NFLX", "DIS", "NKE", "BAC", "WMT", "CVX",
    "SPY", "QQQ", "IWM", "VIX", "TLT", "HYG", "IEF",
)
FACTOR_NAMES = (
    "momentum", "momentum_12_1", "quality", "value", "growth", "sentiment", "flow_signal", "earnings_surprise", "liquidity",
    "piotroski", "roic", "volatility", "skewness", "accruals", "fmp_alpha", "rel_strength", "sector_momentum", "high_52w",
    "price_accel", "reversal", "trend_slope",
)
METRIC_NAMES = (
    "sharpe", "sortino", "calmar", "drawdown", "max_dd", "cagr", "return", "alpha", "beta", "information_ratio",
    "tracking_error", "win_rate", "turnover", "cost", "slippage", "ic", "ic_ir", "hit_rate", "pnl", "exposure", "weight",
    "position", "portfolio_value",
)
# Date expressions, claim labels, phrase lists and metric aliases.
DATE_PATTERN = (r"(?i)\b(\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2}(?:,\s*\d{4})?"
                r"|last\s+(?:week|month|quarter|year)|yesterday|today|(?:past|last)\s+\d+\s+(?:days?|weeks?|months?))\b")
CLAIM_PATTERN = (r"(?i)((?:sharpe\s*ratio|sharpe|sortino|calmar|drawdown|cagr|return|ic|ic-ir|alpha|beta|turnover|cost"
                 r"|p-value|hit.?rate|win.?rate)\s*(?:of|=|:)?\s*)(-?\d+\.?\d*%?)")
VAGUE = ("might", "could be", "perhaps", "possibly", "unclear", "not sure", "data not available", "insufficient")
CITED = ("from pnl", "from factor_ic", "from audit", "from metrics", "from regime", "cite", "source")
ALIASES = {
    "sharpe": ("sharpe", "sharpe_ratio"), "sortino": ("sortino", "sortino_ratio"), "drawdown": ("max_drawdown", "drawdown"),
    "calmar": ("calmar", "calmar_ratio"), "cagr": ("cagr", "annual_return"), "return": ("total_return", "cagr", "net_return"),
    "alpha": ("alpha_ann", "alpha"), "beta": ("beta",), "turnover": ("avg_filtered_turnover", "avg_raw_turnover"),
    "ic": ("mean_ic",), "ic_ir": ("ic_ir",), "hit_rate": ("hit_rate", "win_rate"), "p_value": ("p_value",),
}


def route_questions(df: DataFrame, text: str = "text") -> DataFrame:
    """Question type and confidence per row; unclear ones go to meta_help."""
    q = F.lower(F.trim(F.col(text)))
    cands = []
    for i, (name, base, pats) in enumerate(RULES):
        hits = reduce(lambda a, b: a + b, [q.rlike(p).cast("int") for p in pats])
        conf = F.least(F.lit(base) + 0.05 * (hits - 1), F.lit(0.99))
        cands.append(F.struct(F.when(hits > 0, F.round(conf, 3)).otherwise(0.0).alias("conf"), F.lit(-i).alias("prio"), F.lit(name).alias("type")))
    best = df.withColumn("__b", F.array_max(F.array(*cands)))
    empty = q == ""
    conf = F.when(empty, 1.0).otherwise(F.col("__b.conf"))
    kind = F.when(empty | (F.col("__b.conf") < 0.80), "meta_help").otherwise(F.col("__b.type"))
    return best.select(*df.columns, kind.alias("question_type"), conf.alias("confidence"), (~empty & (conf < 0.80)).alias("fallback"))


def extract_entities(df: DataFrame, text: str = "text", today: Column | None = None) -> DataFrame:
    """Tickers, factors, metrics, date expressions and the relative date range."""
    today = F.current_date() if today is None else today
    t = F.col(text)
    low = F.lower(t)
    words = F.split(low, r"[^\p{L}\p{N}_]+")
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    tick = F.filter(F.split(F.upper(t), r"[^\p{L}\p{N}_]+"), lambda x: x.isin(*TICKERS))
    phrase = F.filter(lits(FACTOR_NAMES), lambda f: F.array_contains(words, f) | (F.instr(low, F.replace(f, F.lit("_"), F.lit(" "))) > 0))
    back = F.when(low.rlike(r"last\s+week"), 7).when(low.rlike(r"last\s+month"), 30).when(low.rlike(r"last\s+quarter"), 90)
    return df.select("*", tick.alias("tickers"), phrase.alias("factors"),
                     F.filter(lits(METRIC_NAMES), lambda m: F.array_contains(words, m)).alias("metrics"),
                     F.regexp_extract_all(t, F.lit(DATE_PATTERN), 1).alias("date_refs"),
                     F.date_sub(today, back).alias("date_from"), F.when(back.isNotNull(), today).alias("date_to"))


def _hint(label: Column) -> Column:
    h = F.translate(F.regexp_replace(F.lower(F.trim(label)), r"\s+", "_"), "-", "_")
    for suffix in ("_of", "_is", "_ratio", "_score", "_rate"):
        h = F.regexp_replace(h, f"{suffix}$", "")
    return F.trim(h, F.lit("_"))


def extract_claims(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per stated metric value, percentages as fractions."""
    body = F.trim(F.regexp_replace(F.col(text), r"(?i)```json[\s\S]*?```", ""))
    z = F.arrays_zip(F.regexp_extract_all(body, F.lit(CLAIM_PATTERN), 1).alias("l"), F.regexp_extract_all(body, F.lit(CLAIM_PATTERN), 2).alias("v"))
    x = df.select(*[c for c in df.columns if c != text], F.posexplode(z).alias("pos", "__c"))
    raw = F.col("__c.v")
    val = F.regexp_replace(raw, "%", "").try_cast("double")
    label = F.lower(F.regexp_replace(F.trim(F.col("__c.l")), "[=: ]+$", ""))
    return x.select(*[c for c in df.columns if c != text], "pos", label.alias("label"), _hint(label).alias("hint"),
                    F.when(F.contains(raw, F.lit("%")), val / 100.0).otherwise(val).alias("claimed")).where("claimed is not null")


def alias_rows(spark, hints: list[str] | None = None) -> DataFrame:
    rows = [(h, a, i + 1) for h, names in ALIASES.items() for i, a in enumerate(names)]
    return spark.createDataFrame(rows, "hint string, field string, prio int")


def check_claims(claims: DataFrame, metrics: DataFrame, key: str, tolerance: float = 0.05) -> DataFrame:
    """Compare claims with metric rows (key, field, value); the first alias found wins.

    A claim without a metric is unverifiable and passes.
    """
    own = claims.select(key, "pos", "hint", F.col("hint").alias("field"), F.lit(0).alias("prio"))
    ali = claims.join(alias_rows(claims.sparkSession), "hint").select(key, "pos", "hint", "field", "prio")
    look = (stacked(own, ali).join(metrics, [key, "field"]).groupBy(key, "pos")
            .agg(F.min_by("value", "prio").alias("actual"), F.min_by("field", "prio").alias("source_field")))
    j = claims.join(look, [key, "pos"], "left")
    gap = F.abs(F.col("claimed") - F.col("actual"))
    delta = F.when(F.abs("actual") > 1e-6, F.try_divide(gap, F.abs("actual"))).otherwise(gap)
    return j.withColumn("delta", delta).withColumn("passed", F.coalesce(F.col("delta") <= tolerance, F.lit(True)))


def answer_confidence(df: DataFrame, text: str = "text") -> DataFrame:
    """Stated confidence from a JSON block, else wording-based; flags low ones."""
    t = F.lower(F.col(text))
    count = lambda xs: reduce(lambda a, b: a + b, [F.contains(t, F.lit(x)).cast("int") for x in xs])
    guess = F.round(clip(0.80 - 0.05 * F.least(count(VAGUE), F.lit(4)) + 0.03 * F.least(count(CITED), F.lit(3)), 0.30, 0.95), 3)
    block = F.regexp_extract(F.col(text), r"(?i)```json\s*([\s\S]*?)\s*```", 1)
    stated = F.get_json_object(F.when(block != "", block).otherwise(F.col(text)), "$.confidence").try_cast("double")
    conf = F.coalesce(stated, guess)
    return df.withColumn("confidence", conf).withColumn("disclaimer", conf < 0.70)


def last_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """Last exchanges per conversation, clipped to 300 and 500 characters.

    A user turn is paired with the assistant turn that follows it.  The last user
    turns are found first (pruned per task before the shuffle); only turns from
    there on are ordered, so a conversation of any length costs a few rows.
    """
    d = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    asked = turns.where("role = 'user'").select("conv_id", "turn").withColumn("__rn", F.row_number().over(d)).where(F.col("__rn") <= n)
    cut = asked.groupBy("conv_id").agg(F.min("turn").alias("__cut"))
    turns = turns.join(cut, "conv_id").where(F.col("turn") >= F.col("__cut")).drop("__cut")
    w = W.partitionBy("conv_id").orderBy("turn")
    x = turns.withColumn("answer", F.lead("text").over(w)).withColumn("__r", F.lead("role").over(w))
    return x.where("role = 'user'").select(
        "conv_id", "turn", F.left("text", F.lit(300)).alias("question"),
        F.left(F.when(F.col("__r") == "assistant", F.col("answer")).otherwise(""), F.lit(500)).alias("answer"))


def question_key(qtype: Column, entities: Column, date_from: Column) -> Column:
    """16-hex key of a routed question; equal keys are the same question."""
    return F.left(F.sha2(F.to_json(F.struct(date_from.alias("date_range"), entities.alias("entities"), qtype.alias("type"))), 256), F.lit(16))


def dedupe_questions(routed: DataFrame, order: list[Column]) -> DataFrame:
    """First row per question key; rows must carry type, entity columns and date_from."""
    k = question_key(F.col("question_type"), F.struct("tickers", "factors", "metrics"), F.col("date_from").cast("string"))
    w = W.partitionBy("query_key").orderBy(*order)
    x = routed.withColumn("query_key", k)
    # counts are combined map-side; only the first row of each key is shuffled on
    n = x.groupBy("query_key").agg(F.count("*").alias("n_asked"))
    return x.withColumn("__rn", F.row_number().over(w)).where("__rn <= 1").drop("__rn").join(n, "query_key")
