"""Point-in-time joins: backward and forward as-of, interval membership, ranges.

As-of joins are a union plus one ordered window per key (one shuffle), never a
range join.  A key's rows are daily or quarterly, hence bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.sources.storage import stacked


def asof_backward(probes: DataFrame, facts: DataFrame, key: str = "ticker", probe_time: str = "d",
                  fact_time: str = "available_date", shift_days: int = 0, prefix: str = "") -> DataFrame:
    """Latest fact at or before ``probe_time - shift_days`` for every probe row.

    Probes without an earlier fact keep NULLs.  Duplicate fact times must be
    resolved by the caller (see ``latest_per_key``).
    """
    cols = [x for x in facts.columns if x not in (key,)]
    fact = F.struct(*[F.col(x) for x in cols])
    side = facts.select(F.col(key), F.col(fact_time).alias("__t"), F.lit(0).alias("__p"),
                        F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("__row"),
                        fact.alias("__fact"))
    t = F.date_sub(F.col(probe_time), shift_days) if shift_days else F.col(probe_time)
    ask = probes.select(F.col(key), t.alias("__t"), F.lit(1).alias("__p"), F.struct("*").alias("__row"),
                        F.lit(None).cast(facts.select(fact).schema[0].dataType).alias("__fact"))
    w = W.partitionBy(key).orderBy("__t", "__p").rowsBetween(W.unboundedPreceding, 0)
    got = stacked(side, ask).select("__p", "__row", F.last("__fact", ignorenulls=True).over(w).alias("__fact"))
    return got.where("__p = 1").select("__row.*", *[F.col(f"__fact.{x}").alias(prefix + x) for x in cols])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key in ``order``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def prefer_first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources keeping, per key, the row of the earliest listed source."""
    tagged = [s.withColumn("__src", F.lit(i)) for i, s in enumerate(sources)]
    return latest_per_key(stacked(*tagged, allow_missing=True), keys, [F.asc("__src")]).drop("__src")


def forward_price(probes: DataFrame, bars: DataFrame, at: str, out: str, date_out: str | None = None) -> DataFrame:
    """First close on or after column ``at`` for every probe row of the ticker, and its date.

    Only the distinct (ticker, date) of the probes stand in the ordered window: however many rows ask, a ticker has no
    more of them than there are dates.  The answers are joined back by both.
    """
    ask = probes.select("ticker", F.col(at).cast("date").alias("__t")).where("__t is not null").distinct()
    hit = F.struct(F.col("d").cast("date").alias("d"), F.col("close").cast("double").alias("px"))
    px = bars.where("close is not null").select("ticker", F.col("d").cast("date").alias("__t"), F.lit(1).alias("__p"), hit.alias("__hit"))
    ask = ask.select("ticker", "__t", F.lit(0).alias("__p"), F.lit(None).cast(px.schema["__hit"].dataType).alias("__hit"))
    # backwards in time, as a running frame: one that reaches to the end is gone through anew for every row
    w = W.partitionBy("ticker").orderBy(F.desc("__t"), F.desc("__p")).rowsBetween(W.unboundedPreceding, 0)
    got = stacked(px, ask).select("ticker", "__t", "__p", F.last("__hit", ignorenulls=True).over(w).alias("__hit")).where("__p = 0")
    got = got.select("ticker", F.col("__t").alias("__at"), F.col("__hit.px").alias(out), *([F.col("__hit.d").alias(date_out)] if date_out else []))
    rows = probes.withColumn("__at", F.col(at).cast("date"))
    return rows.join(got, ["ticker", "__at"], "left").select(*probes.columns, *[c for c in got.columns if c not in ("ticker", "__at")])


def fill_returns(signals: DataFrame, bars: DataFrame, today: Column, closed: str | None = None) -> DataFrame:
    """Realised forward return of every due signal, and the date of its last price (``closed``); NULL prices drop out.

    signals: ticker, signal_date, fwd_due_date, ...
    """
    due = signals.where(F.col("fwd_due_date") <= today)
    got = forward_price(forward_price(due, bars, "signal_date", "__p0"), bars, "fwd_due_date", "__p1", closed)
    return (got.where("__p0 is not null and __p1 is not null")
            .withColumn("fwd_return", F.bround(F.col("__p1") / F.col("__p0") - 1, 6)).drop("__p0", "__p1"))


def membership_intervals(baseline: DataFrame, events: DataFrame) -> DataFrame:
    """Change log to validity intervals [valid_from, valid_to) per ticker.

    Repeated adds or removes are harmless; on one date a remove wins over an add.
    """
    base = baseline.select("ticker", F.lit("0001-01-01").cast("date").alias("d"), F.lit("add").alias("action"))
    per_day = (stacked(base, events.select("ticker", "d", "action")).groupBy("ticker", "d")
               .agg(F.max("action").alias("action")))           # 'remove' > 'add'
    w = W.partitionBy("ticker").orderBy("d")
    return (per_day.select("ticker", F.col("d").alias("valid_from"), F.lead("d").over(w).alias("valid_to"), "action")
            .where("action = 'add'").drop("action"))


def members_at(rows: DataFrame, intervals: DataFrame, date_col: str) -> DataFrame:
    """Semi-join rows to their membership interval (equi key plus range)."""
    i = intervals.select(F.col("ticker").alias("__k"), "valid_from", "valid_to")
    cond = ((F.col("ticker") == F.col("__k")) & (F.col(date_col) >= F.col("valid_from"))
            & (F.col("valid_to").isNull() | (F.col(date_col) < F.col("valid_to"))))
    return rows.join(i, cond, "left_semi")


def events_between(rows: DataFrame, actions: DataFrame, lo: str, hi: str) -> DataFrame:
    """Corporate actions of the row's ticker with lo <= date <= hi."""
    a = actions.select(F.col("ticker").alias("__k"), F.col("d").alias("event_date"), "type", "ratio", "price_multiplier")
    return rows.join(a, (F.col("ticker") == F.col("__k")) & F.col("event_date").between(F.col(lo), F.col(hi))).drop("__k")


def has_spinoff(rows: DataFrame, actions: DataFrame, lo: str, hi: str) -> DataFrame:
    a = actions.where("type = 'spinoff'").select(F.col("ticker").alias("__k"), F.col("d").alias("__e"))
    return rows.join(a, (F.col("ticker") == F.col("__k")) & F.col("__e").between(F.col(lo), F.col(hi)), "left_semi")


def split_adjustment(rows: DataFrame, actions: DataFrame, date_col: str = "d") -> DataFrame:
    """Cumulative split multiplier of all splits at or before the row's date.

    The running product is taken over the short split list first and then
    attached as-of, so bars are touched once.
    """
    s = (actions.where("type = 'split'").groupBy("ticker", "d")
         .agg(F.product("price_multiplier").alias("m")))
    w = W.partitionBy("ticker").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    cum = s.select("ticker", F.col("d").alias("event_date"), F.product("m").over(w).alias("__m"))
    got = asof_backward(rows, cum, probe_time=date_col, fact_time="event_date")
    return got.withColumn("multiplier", F.round(F.coalesce("__m", F.lit(1.0)), 8)).drop("__m", "event_date")


def drop_terminated(rows: DataFrame, actions: DataFrame, date_col: str = "d") -> DataFrame:
    """Anti-join rows dated at or after a merger, acquisition or delisting."""
    end = (actions.where(F.col("type").isin("merger", "acquisition", "delisting"))
           .groupBy(F.col("ticker").alias("__k")).agg(F.min("d").alias("__end")))
    return rows.join(end, (F.col("ticker") == F.col("__k")) & (F.col("__end") <= F.col(date_col)), "left_anti")


def dividend_last4(actions: DataFrame) -> DataFrame:
    w = W.partitionBy("ticker").orderBy(F.desc("d"))
    return (actions.where("type = 'dividend'").withColumn("rn", F.row_number().over(w)).where("rn <= 4")
            .groupBy("ticker").agg(F.sum("ratio").alias("dividends"), F.count("*").alias("n")))


def forward_fill(series: DataFrame, onto: DataFrame, value: str = "value") -> DataFrame:
    """Last known value of a dated series on each date of ``onto`` (both by date)."""
    a = series.select("d", F.lit(0).alias("p"), F.col(value).alias("v"))
    b = onto.select("d", F.lit(1).alias("p"), F.lit(None).cast("double").alias("v"))
    w = W.orderBy("d", "p").rowsBetween(W.unboundedPreceding, 0)
    return (stacked(a, b).select("d", "p", F.last("v", True).over(w).alias(value))
            .where("p = 1").drop("p"))


def members_on_calendar(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """All members at each rebalance date: (k, ticker).

    Interval ends are turned into rebalance numbers by an as-of lookup on the
    calendar, then expanded; nothing outside an interval is generated.
    """
    cal = calendar.select(F.col("reb_d").alias("t"), F.lit(0).alias("p"), F.col("k").alias("kk"))
    last_k = calendar.agg(F.max("k").alias("__last"))

    def first_at_or_after(df: DataFrame, col: str, out: str) -> DataFrame:
        dates = df.select(F.col(col).alias("t")).where("t is not null").distinct().select("t", F.lit(1).alias("p"), F.lit(None).cast("int").alias("kk"))
        w = W.orderBy(F.desc("t"), F.asc("p")).rowsBetween(W.unboundedPreceding, 0)
        look = (stacked(cal, dates).select("t", "p", F.last("kk", True).over(w).alias(out))
                .where("p = 1").select(F.col("t").alias(col), out))
        return df.join(look, col, "left")
    x = first_at_or_after(first_at_or_after(intervals, "valid_from", "__a"), "valid_to", "__b")
    x = x.withColumn("__one", F.lit(1)).join(last_k.withColumn("__one", F.lit(1)), "__one")
    end = F.coalesce(F.col("__b") - 1, F.col("__last"))
    return x.where(F.col("__a").isNotNull() & (F.col("__a") <= end)).select(
        "ticker", F.explode(F.sequence("__a", end)).alias("k"))
