"""Orders, fills, trades and tax lots as table jobs (no broker calls)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.expr import liquidity_tier
from alphaloom.params import VWAP_PROFILE
from alphaloom.sources.storage import stacked


def match_fills(arrivals: DataFrame, fills: DataFrame, flag_bps: float = 50.0) -> DataFrame:
    """Slippage of each filled order; unfilled orders stay pending."""
    j = arrivals.join(fills.select("trade_id", "fill_price"), "trade_id", "left")
    a, f = F.col("arrival_price"), F.col("fill_price")
    diff = F.when(F.col("side") == "buy", f - a).otherwise(a - f)
    bps = F.when(f.isNull(), None).when(a > 0, F.try_divide(diff, a) * 10_000).otherwise(0.0)
    return j.withColumn("slippage_bps", bps).withColumn(
        "status", F.when(f.isNull(), "pending").otherwise("filled")).withColumn(
        "flagged", F.coalesce(F.abs("slippage_bps") > flag_bps, F.lit(False)))


def last_orders(orders: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The most recent ``n`` log rows (top-k, no full sort)."""
    return orders.orderBy(*order).limit(n)


def slippage_report(matched: DataFrame) -> DataFrame:
    x = matched.where("status = 'filled'")
    return x.agg(F.count("*").alias("n_trades"), F.avg("slippage_bps").alias("avg_slippage_bps"),
                 F.percentile("slippage_bps", 0.9).alias("p90_slippage_bps"),
                 (F.avg("slippage_bps") > 20).alias("systematic_flag"))


def worst_tickers(matched: DataFrame, n: int = 5) -> DataFrame:
    return (matched.where("status = 'filled'").groupBy("ticker").agg(F.avg("slippage_bps").alias("avg_slippage_bps"))
            .orderBy(F.desc("avg_slippage_bps"), "ticker").limit(n))


def reconcile(expected: DataFrame, actual: DataFrame, portfolio_value: float, tolerance: float = 0.02) -> DataFrame:
    """Names whose actual weight is off by more than the tolerance, with the fix.

    expected: (keys..., ticker, weight); actual: (keys..., ticker, market_value).
    """
    keys = [c for c in expected.columns if c not in ("ticker", "weight")]
    j = expected.join(actual.select(*keys, "ticker", "market_value"), keys + ["ticker"], "full_outer")
    e = F.coalesce("weight", F.lit(0.0))
    a = F.coalesce("market_value", F.lit(0.0)) / (portfolio_value + 1e-6)
    x = j.select(*keys, "ticker", e.alias("expected_weight"), a.alias("actual_weight"), F.abs(e - a).alias("delta"))
    d = F.col("expected_weight") - F.col("actual_weight")
    return x.where(F.col("delta") > tolerance).select("*", F.when(d > 0, "buy").otherwise("sell").alias("action"), (d * portfolio_value).alias("notional"))


def delta_orders(targets: DataFrame, positions: DataFrame, portfolio_value: float, max_order: float = 50_000.0,
                 min_order: float = 100.0) -> DataFrame:
    """Orders that move positions to the (capped) target value; dust is skipped."""
    keys = [c for c in targets.columns if c not in ("ticker", "weight")]
    j = targets.join(positions.select(*keys, "ticker", "market_value"), keys + ["ticker"], "left")
    d = F.least(F.col("weight") * portfolio_value, F.lit(max_order)) - F.coalesce("market_value", F.lit(0.0))
    return j.select(*keys, "ticker", d.alias("delta")).where(F.abs("delta") >= min_order).select(
        *keys, "ticker", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").alias("notional"))


def order_slices(orders: DataFrame, participation: float = 0.05, min_slice: float = 500.0, max_slices: int = 5) -> DataFrame:
    """Split orders (…, notional, adv) into at most five equal staggered slices."""
    cap = F.greatest(F.col("adv") * participation, F.lit(min_slice))
    direct = (F.col("notional") <= 0) | (F.col("adv") <= 0)
    n = F.when(direct | (F.col("notional") <= cap), 1).otherwise(
        F.least(F.ceil(F.col("notional") / F.when(cap > 0, cap)), F.lit(max_slices))).cast("int")
    x = orders.withColumn("n_slices", n)
    x = x.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)))
    size = F.col("notional") / F.col("n_slices")
    return x.withColumn("slice_notional", size).withColumn(
        "pct_of_adv", F.when(direct, 0.0).otherwise(size / (F.col("adv") + 1e-6) * 100)).withColumn("delay_minutes", F.col("slice") * 30)


def vwap_schedule(orders: DataFrame, minimum: float = 100.0) -> DataFrame:
    """Volume-profile schedule over the day, skipping both auctions.

    Buckets are capped by the tier's participation; what they leave is placed at
    mid-day.  The profile is a literal array, so nothing is joined.
    """
    total = sum(VWAP_PROFILE)
    last = len(VWAP_PROFILE) - 1
    buckets = F.array(*[F.struct(F.lit(i * 30 + 15).alias("m"), F.lit(v / total).alias("f"))
                        for i, v in enumerate(VWAP_PROFILE) if i not in (0, last)])
    cap = F.col("adv") * liquidity_tier("adv")["participation_rate"] / 13.0
    sized = F.transform(buckets, lambda b: F.struct(b["m"].alias("m"), F.least(F.col("notional") * b["f"], cap).alias("v")))
    kept = F.filter(sized, lambda b: b["v"] >= minimum)
    x = orders.where("notional > 0").withColumn("__k", kept)
    rest = F.col("notional") - F.aggregate("__k", F.lit(0.0), lambda a, b: a + b["v"])
    tail = F.when(rest >= minimum, F.array(F.struct(F.lit(195).alias("m"), rest.alias("v")))).otherwise(
        F.array().cast("array<struct<m:int,v:double>>"))
    x = x.withColumn("__e", F.explode(F.concat("__k", tail)))
    return x.select(*orders.columns, F.col("__e.m").alias("time_offset_minutes"), F.col("__e.v").alias("bucket_notional"),
                    (F.col("__e.v") / F.greatest(F.col("adv") / 13.0, F.lit(1.0)) * 100).alias("participation_pct"))


def gap_risk(bars: DataFrame, threshold: float = 0.03) -> DataFrame:
    """Gap of each open (or close) against the previous close and the action."""
    w = W.partitionBy("ticker").orderBy("d")
    prev, cur = F.lag("close").over(w), F.coalesce(F.col("open"), F.col("close")) if "open" in bars.columns else F.col("close")
    g = F.when((prev > 0) & (cur > 0), F.try_divide(cur - prev, prev)).otherwise(0.0)
    return bars.select("ticker", "d", g.alias("gap_pct"), (F.abs(g) > threshold).alias("has_gap"),
                       F.when(g < -threshold, "widen_stop").otherwise("none").alias("action"))


# ---- positions and trades ----

def position_marks(positions: DataFrame, bars: DataFrame, horizon: int | None = None) -> DataFrame:
    """Bars of every position from its entry on, with the running peak price.

    positions: (position_id, ticker, entry_date, entry_price).  With a
    ``horizon`` in days the first bar at or beyond it is the last one kept.
    """
    w = W.partitionBy("ticker").orderBy("d")
    b = bars.select("ticker", "d", "close", F.lag("close").over(w).alias("prev_close"), F.lag("d").over(w).alias("prev_d"))
    live = F.col("d") >= F.col("entry_date")
    if horizon is not None:
        live = live & (F.col("prev_d").isNull() | (F.col("prev_d") < F.date_add("entry_date", horizon)))
    j = positions.join(b, "ticker").where(live).drop("prev_d")
    peak = F.max("close").over(W.partitionBy("position_id").orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    return j.withColumn("peak_price", F.greatest(F.col("entry_price"), peak))


def exit_reason(hold: Column, pnl: Column, gap: Column, target: float = 0.12, stop: float = 0.05, wide: float = 0.07,
                gap_limit: float = 0.03, min_hold: int = 3, max_hold: int = 60) -> Column:
    widened = F.coalesce(gap, F.lit(0.0)) < -gap_limit
    eff = F.when(widened, wide).otherwise(stop)
    return (F.when(hold < min_hold, None).when(hold >= max_hold, "max_hold").when(pnl >= target, "profit_target")
            .when(pnl <= -eff, F.when(widened, "gap_down_exit").otherwise("stop_loss")))


def first_exits(positions: DataFrame, bars: DataFrame, **rules) -> DataFrame:
    """Earliest exit of every position with its reason and price."""
    # a bar at or beyond the longest holding period always exits
    m = position_marks(positions, bars, rules.get("max_hold", 60))
    hold = F.datediff("d", "entry_date")
    pnl = (F.col("close") - F.col("entry_price")) / F.col("entry_price")
    gap = F.try_divide(F.col("close") - F.col("prev_close"), F.col("prev_close"))
    m = m.withColumn("reason", exit_reason(hold, pnl, gap, **rules)).where("reason is not null")
    return m.groupBy("position_id", "ticker", "entry_date", "entry_price").agg(
        F.min("d").alias("exit_date"), F.min_by("reason", "d").alias("exit_reason"),
        F.min_by("close", "d").alias("exit_price"), F.min_by("peak_price", "d").alias("peak_price"))


def trade_pnl(exits: DataFrame, cost_bps: float = 15.0) -> DataFrame:
    gross = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")
    x = exits.withColumn("hold_days", F.datediff("exit_date", "entry_date")).withColumn("gross_pnl", gross)
    x = x.withColumn("net_pnl", F.col("gross_pnl") - 2 * cost_bps / 10_000)
    return x.withColumn("win", F.col("net_pnl") > 0)


def trade_verdict(n, win_rate, pf) -> Column:
    return (F.when((win_rate >= 0.55) & (pf >= 1.3) & (n >= 20), "STRONG — signal working, consider scaling capital")
            .when((win_rate >= 0.52) & (pf >= 1.1) & (n >= 10), "POSITIVE — early evidence of edge, continue paper trading")
            .when(n < 10, F.format_string("EARLY — %d trades, need ≥10 to assess", n.cast("int")))
            .otherwise("WEAK — no clear edge yet, review signal weights"))


def trade_metrics(trades: DataFrame, last_n: int | None = 100) -> DataFrame:
    """Summary of the most recent closed trades."""
    x = trades.orderBy(F.desc("exit_date"), F.desc("position_id")).limit(last_n) if last_n else trades
    w = F.col("win")
    g = x.agg(F.count("*").alias("n_trades"), F.avg(w.cast("double")).alias("win_rate"), F.avg("hold_days").alias("avg_hold_days"),
              F.median("hold_days").alias("median_hold_days"),
              (F.coalesce(F.sum(F.when(w, F.col("gross_pnl"))), F.lit(0.0)) / (F.abs(F.coalesce(F.sum(F.when(~w, F.col("gross_pnl"))), F.lit(0.0))) + 1e-9)).alias("profit_factor"),
              (F.avg("net_pnl") * 100).alias("avg_net_pnl_pct"),
              (F.coalesce(F.avg(F.when(w, F.col("net_pnl"))), F.lit(0.0)) * 100).alias("avg_win_pct"),
              (F.coalesce(F.avg(F.when(~w, F.col("net_pnl"))), F.lit(0.0)) * 100).alias("avg_loss_pct"))
    return g.withColumn("verdict", trade_verdict(F.col("n_trades"), F.col("win_rate"), F.col("profit_factor")))


def trade_buckets(trades: DataFrame) -> DataFrame:
    """Win rate by holding bucket."""
    b = F.when(F.col("hold_days") < 7, "<7d").when(F.col("hold_days") < 30, "7-30d").otherwise("30-60d")
    return trades.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("win").cast("double")).alias("win_rate"),
                                                 (F.avg("net_pnl") * 100).alias("avg_pnl"))


def exit_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("exit_reason").agg(F.count("*").alias("n"))


def sync_positions(open_: DataFrame, target: DataFrame, exits: DataFrame, keys: list[str]) -> DataFrame:
    """Actions that bring open positions to the target list.

    Rule exits come first; open names absent from the target are removed; target
    names not open are opened.
    """
    k = keys + ["ticker"]
    rule = open_.join(exits.select(*k, "reason"), k).select(*k, F.lit("close").alias("action"), "reason")
    gone = open_.join(exits, k, "left_anti").join(target, k, "left_anti").select(*k, F.lit("close").alias("action"), F.lit("rebalance_removed").alias("reason"))
    new = target.join(open_, k, "left_anti").select(*k, F.lit("open").alias("action"), F.lit("new_target").alias("reason"))
    return stacked(rule, gone, new)


def entry_prices(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """First price of every position on or after its entry, and that day; positions without one drop out.

    positions: (position_id, ticker, entry_date).  An as-of probe of the bars: no later bar is paired with a position.
    """
    from alphaloom.operators.asof import forward_price
    x = forward_price(positions.select("position_id", "ticker", F.col("entry_date").alias("__from")), bars, "__from", "entry_price", "entry_date")
    return x.where("entry_price is not null").drop("__from")


# ---- tax lots ----

LOT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "shares", "price"]
CHUNK_ROWS = 4096   # trades of one bucket matched in one call
BUCKET = 256.0      # width, in shares, of the pieces of cumulative intervals
BAND = 4096.0       # width, in shares, of the pieces of balance bands


def lot_paths(lots: DataFrame, order: list[str] = LOT_ORDER) -> DataFrame:
    """Per trade: stable id, cumulative bought and effectively sold shares, balance.

    On a date buys come before sells.  A sale beyond the balance is cut to it.
    The balance is a reflected running sum: running sum less its running
    minimum below zero, both taken per date first and then over the dates, so a
    hot ticker is spread over its dates.
    """
    sgn = F.when(F.col("side") == "buy", F.col("shares")).otherwise(-F.col("shares"))
    rank = F.when(F.col("side") == "buy", 0).otherwise(1)
    day = W.partitionBy("ticker", "trade_date").orderBy(rank, *order)
    run = day.rowsBetween(W.unboundedPreceding, 0)
    x = lots.withColumn("__q", sgn).withColumn("__rn", F.row_number().over(day))
    x = x.withColumn("__s", F.sum("__q").over(run))
    # within a date the sum rises then falls: its low is the last value (or the first, when all buys)
    x = x.withColumn("__lo", F.min("__s").over(run)).withColumn(
        "__b", F.sum(F.when(F.col("side") == "buy", F.col("shares")).otherwise(0.0)).over(run))
    days = x.groupBy("ticker", "trade_date").agg(F.sum("__q").alias("dq"), F.min("__s").alias("dlo"),
                                                 F.sum(F.when(F.col("side") == "buy", F.col("shares")).otherwise(0.0)).alias("db"))
    wd = W.partitionBy("ticker").orderBy("trade_date")
    upto = wd.rowsBetween(W.unboundedPreceding, 0)
    before = wd.rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("base", F.sum("dq").over(upto) - F.col("dq")).withColumn("bbase", F.sum("db").over(upto) - F.col("db"))
    days = days.withColumn("low", F.least(F.lit(0.0), F.coalesce(F.min(F.col("base") + F.col("dlo")).over(before), F.lit(0.0))))
    x = x.join(days.select("ticker", "trade_date", "base", "bbase", "low"), ["ticker", "trade_date"])
    s = F.col("base") + F.col("__s")
    low = F.least(F.col("low"), F.col("base") + F.col("__lo"))
    x = x.withColumn("balance", s - low).withColumn("bought", F.col("bbase") + F.col("__b"))
    # effectively sold so far = bought - balance
    x = x.withColumn("sold", F.col("bought") - F.col("balance"))
    return x.select("ticker", "trade_date", "side", "shares", "price", *[c for c in order if c not in ("shares", "price")],
                    F.col("__rn").alias("seq"), "bought", "sold", "balance")


def _pieces(df: DataFrame, lo: str, hi: str, width: float = BUCKET) -> DataFrame:
    """Cut intervals at multiples of the bucket width."""
    b = F.sequence(F.floor(F.col(lo) / width), F.ceil(F.col(hi) / width) - 1)
    return df.where(F.col(hi) > F.col(lo)).withColumn("bucket", F.explode(b))


def fifo_matches(lots: DataFrame) -> DataFrame:
    """First-in-first-out matches by overlap of cumulative share intervals.

    Both interval sets are cut into buckets of fixed width, so each join key
    holds a bounded number of rows however large a ticker is.
    """
    from alphaloom.sources.storage import materialize
    p = materialize(lot_paths(lots), "lots")
    prev_sold = F.col("sold") - F.col("eff")
    sells = p.where("side = 'sell'")
    # effective size of a sale: change of sold; the one before it on the same path
    day = W.partitionBy("ticker", "trade_date").orderBy("seq")
    days = p.groupBy("ticker", "trade_date").agg(F.max_by("sold", "seq").alias("dsold"))
    days = days.withColumn("sold0", F.coalesce(F.lag("dsold").over(W.partitionBy("ticker").orderBy("trade_date")), F.lit(0.0)))
    sells = sells.join(days.select("ticker", "trade_date", "sold0"), ["ticker", "trade_date"])
    sells = sells.withColumn("eff", F.col("sold") - F.coalesce(F.lag("sold").over(day), F.col("sold0")))
    sells = sells.select("ticker", F.col("trade_date").alias("sell_date"), F.col("seq").alias("sell_seq"), F.col("price").alias("sell_price"),
                         prev_sold.alias("s0"), F.col("sold").alias("s1"))
    buys = p.where("side = 'buy'").select("ticker", F.col("trade_date").alias("open_date"), F.col("seq").alias("lot_seq"),
                                          F.col("price").alias("cost"), (F.col("bought") - F.col("shares")).alias("b0"), F.col("bought").alias("b1"))
    j = _pieces(buys, "b0", "b1").join(_pieces(sells, "s0", "s1"), ["ticker", "bucket"])
    lo = F.greatest("b0", "s0", F.col("bucket") * BUCKET)
    hi = F.least("b1", "s1", (F.col("bucket") + 1) * BUCKET)
    j = j.withColumn("q", hi - lo).where("q > 0")
    g = j.groupBy("ticker", "open_date", "lot_seq", "cost", "sell_date", "sell_seq", "sell_price", "b0").agg(F.sum("q").alias("shares"))
    return realized(g, [F.asc("b0")]).drop("b0")


def realized(m: DataFrame, lot_order: list[Column]) -> DataFrame:
    """Gain, holding class and (within a sale, sticky) wash flag of matches."""
    m = m.withColumn("gain", F.col("shares") * (F.col("sell_price") - F.col("cost"))).withColumn("held_days", F.datediff("sell_date", "open_date"))
    m = m.withColumn("is_long_term", F.col("held_days") > 365)
    hit = ~F.col("is_long_term") & (F.col("gain") < 0) & (F.col("held_days") < 30)
    w = W.partitionBy("ticker", "sell_date", "sell_seq").orderBy(*lot_order).rowsBetween(W.unboundedPreceding, 0)
    return m.withColumn("wash_sale_risk", F.max(hit).over(w))


def _stack(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Match one time-ordered piece: matched rows plus what stays open on both sides.

    Open bands are kept bottom to top; a sale takes everything above its floor.
    """
    buy = pdf["side"] == "buy"
    pdf = pdf.assign(_s=~buy, _k=pdf["lo"].where(buy, pdf["seq"])).sort_values(["trade_date", "_s", "_k", "lo"], kind="stable")
    stack: list[tuple] = []
    out: list[tuple] = []
    for day, seq, side, price, lo, hi in pdf[["trade_date", "seq", "side", "price", "lo", "hi"]].itertuples(index=False):
        if side == "buy":
            stack.append((lo, hi, day, seq, price))
            continue
        unmet = hi
        while stack and stack[-1][1] > lo:
            a, b, d0, s0, p0 = stack.pop()
            if b < unmet:
                out.append(("sell", None, None, None, day, seq, price, b, unmet))
            unmet = max(a, lo)
            out.append(("match", d0, s0, p0, day, seq, price, unmet, b))
            if a < lo:
                stack.append((a, lo, d0, s0, p0))
        if unmet > lo:
            out.append(("sell", None, None, None, day, seq, price, lo, unmet))
    out += [("buy", d, s, p, None, None, None, a, b) for a, b, d, s, p in stack]
    res = pd.DataFrame(out, columns=["kind", "open_date", "lot_seq", "cost", "sell_date", "sell_seq", "sell_price", "lo", "hi"])
    for c in ("lot_seq", "sell_seq"):
        res[c] = res[c].astype("Int64")
    for c in ("cost", "sell_price", "lo", "hi"):
        res[c] = res[c].astype(float)
    for k in reversed(keys):
        res.insert(0, k, pdf[k].iloc[0] if len(pdf) else None)
    return res


def lifo_matches(lots: DataFrame) -> DataFrame:
    """Last-in-first-out matches.

    A purchase covers the band of balance it adds, a sale the band it removes;
    at every level of balance the two alternate, so a sale meets the latest
    purchase of that level.  Bands are cut into fixed-width buckets; inside a
    bucket trades are matched per run of dates, then what is left over all of
    them.  Leftovers of a run never cover a level more than twice, which bounds
    every group.  Purchases of one date are consumed in entry order.
    """
    p = lot_paths(lots)
    # same-date purchases are laid down in reverse so that the first is on top
    day_b = W.partitionBy("ticker", "trade_date")
    buys = p.where("side = 'buy'").withColumn("__t", F.max("bought").over(day_b)).withColumn("__f", F.min(F.col("bought") - F.col("shares")).over(day_b))
    # band of a purchase: mirrored inside the date's total rise
    top0 = F.col("balance") - F.col("bought")       # balance less bought is constant over a date's purchases
    hi = top0 + F.col("__f") + F.col("__t") - (F.col("bought") - F.col("shares"))
    b = buys.select("ticker", "trade_date", "seq", "side", "price", (hi - F.col("shares")).alias("lo"), hi.alias("hi"))
    day = W.partitionBy("ticker", "trade_date").orderBy("seq")
    days = p.groupBy("ticker", "trade_date").agg(F.max_by("balance", "seq").alias("db"))
    days = days.withColumn("bal0", F.coalesce(F.lag("db").over(W.partitionBy("ticker").orderBy("trade_date")), F.lit(0.0))).drop("db")
    prev = F.coalesce(F.lag("balance").over(day), F.col("bal0"))
    s = (p.join(days, ["ticker", "trade_date"]).withColumn("__p", prev).where("side = 'sell'")
         .select("ticker", "trade_date", "seq", "side", "price", F.col("balance").alias("lo"), F.col("__p").alias("hi")))
    # cut at bucket edges; keep only the part inside the bucket
    ev = _pieces(stacked(b, s), "lo", "hi", BAND).select(
        "ticker", "bucket", "trade_date", "seq", "side", "price",
        F.greatest(F.col("lo"), F.col("bucket") * BAND).alias("lo"), F.least(F.col("hi"), (F.col("bucket") + 1) * BAND).alias("hi"))
    tick = lots.schema["ticker"].dataType.simpleString()
    schema = (f"ticker {tick}, bucket bigint, chunk bigint, kind string, open_date date, lot_seq int, cost double, "
              "sell_date date, sell_seq int, sell_price double, lo double, hi double")
    from alphaloom.sources.storage import materialize
    keys = ["ticker", "bucket", "chunk"]

    def step(x: DataFrame) -> DataFrame:
        return materialize(x.groupBy(*keys).applyInPandas(lambda pdf: _stack(pdf, keys), schema), "lifo")
    # whole dates are packed into chunks of about CHUNK_ROWS trades of a bucket
    per_day = ev.groupBy("ticker", "bucket", "trade_date").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("ticker", "bucket").orderBy("trade_date"))
    chunk = per_day.select("ticker", "bucket", "trade_date", F.floor((upto - F.col("c")) / CHUNK_ROWS).alias("chunk"))
    first = step(ev.join(chunk, ["ticker", "bucket", "trade_date"]))
    rest = first.where("kind <> 'match'")
    # only buckets with an unmet sale have anything left to match
    rest = rest.join(rest.where("kind = 'sell'").select("ticker", "bucket").distinct(), ["ticker", "bucket"], "left_semi")
    second = step(rest.select("ticker", "bucket", F.lit(0).cast("bigint").alias("chunk"), F.coalesce("open_date", "sell_date").alias("trade_date"),
                              F.coalesce("lot_seq", "sell_seq").alias("seq"), F.col("kind").alias("side"),
                              F.coalesce("cost", "sell_price").alias("price"), "lo", "hi"))
    done = stacked(first.where("kind = 'match'"), second.where("kind = 'match'"))
    g = done.groupBy("ticker", "open_date", "lot_seq", "cost", "sell_date", "sell_seq", "sell_price").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("shares"), F.max("hi").alias("__top"))
    return realized(g, [F.desc("__top")]).drop("__top")


def tax_summary(realized_rows: DataFrame) -> DataFrame:
    """Gains by year: short term, long term, total, wash flags, rows."""
    lt = F.col("is_long_term")
    return realized_rows.groupBy(F.year("sell_date").alias("tax_year")).agg(
        F.coalesce(F.sum(F.when(~lt, F.col("gain"))), F.lit(0.0)).alias("short_term_gain"),
        F.coalesce(F.sum(F.when(lt, F.col("gain"))), F.lit(0.0)).alias("long_term_gain"),
        F.sum("gain").alias("total_realized"), F.count_if("wash_sale_risk").alias("wash_sale_count"), F.count("*").alias("n_transactions"))


def open_lots(lots: DataFrame, realized_rows: DataFrame) -> DataFrame:
    """Remaining shares, cost and average cost per ticker (lots of 0.001 or more)."""
    p = lot_paths(lots).where("side = 'buy'").select("ticker", F.col("trade_date").alias("open_date"), F.col("seq").alias("lot_seq"), "shares", "price")
    used = realized_rows.groupBy("ticker", "open_date", "lot_seq").agg(F.sum("shares").alias("used"))
    x = p.join(used, ["ticker", "open_date", "lot_seq"], "left").withColumn("left", F.col("shares") - F.coalesce("used", F.lit(0.0))).where("left >= 0.001")
    g = x.groupBy("ticker").agg(F.sum("left").alias("shares"), F.sum(F.col("left") * F.col("price")).alias("cost_basis"), F.count("*").alias("lots"))
    return g.withColumn("avg_cost", F.col("cost_basis") / F.greatest("shares", F.lit(1e-6)))
