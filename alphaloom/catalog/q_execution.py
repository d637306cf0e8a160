"""Orders, fills, positions, trades, tax lots, risk and quality queries."""

from pyspark.sql import functions as F

from alphaloom.catalog import shared as S
from alphaloom.catalog.base import query
from alphaloom.catalog.ctes import cte
from alphaloom.functions import expr as X
from alphaloom.operators import execution as EX
from alphaloom.operators import features as FE
from alphaloom.operators import metrics as M
from alphaloom.operators import quality as Q
from alphaloom.operators import risk as RK
from alphaloom.operators import trading_calendar as TC


def r(cols, k=4):
    return [F.round(c, k).alias(c) for c in cols]


cte("matched", """
select *, case when fill_price is null then null when arrival_price>0 then (case when side='buy' then fill_price-arrival_price else arrival_price-fill_price end)/arrival_price*1e4 else 0 end as bps from executions""", "executions")


def _matched(t):
    ex = t.executions
    return EX.match_fills(ex.drop("fill_price"), ex.where("fill_price is not null").select("trade_id", "fill_price"))


@query("fill_slippage", "J12", "select trade_id, ticker, side, round(bps,4) as slippage_bps, case when bps is null then 'pending' else 'filled' end as status, coalesce(abs(bps)>50.5,false) as flagged from matched", "matched")
def _(t):
    ex = t.executions
    return EX.match_fills(ex.drop("fill_price"), ex.where("fill_price is not null").select("trade_id", "fill_price"), 50.5).select(
        "trade_id", "ticker", "side", *r(["slippage_bps"]), "status", "flagged")


@query("slippage_report", "A13 K2", """
select count(*) as n_trades, round(avg(bps),4) as avg_slippage_bps, round(quantile_cont(bps,0.9),4) as p90_slippage_bps, avg(bps)>20 as systematic_flag from (select * from matched order by d desc, trade_id desc limit 100) where bps is not null""", "matched")
def _(t):
    last = EX.last_orders(_matched(t), 100, [F.desc("d"), F.desc("trade_id")])
    return EX.slippage_report(last).select("n_trades", *r(["avg_slippage_bps", "p90_slippage_bps"]), "systematic_flag")


@query("worst_slippage", "A13 K3", "select ticker, round(avg(bps),4) as avg_slippage_bps from matched where bps is not null group by ticker order by avg(bps) desc, ticker limit 5", "matched")
def _(t):
    return EX.worst_tickers(_matched(t)).select("ticker", *r(["avg_slippage_bps"]))


def _chg(t):
    from alphaloom.catalog.q_portfolio import _changes
    return _changes(t)


@query("position_reconciliation", "J19", """
select k, ticker, round(nw,6) as expected_weight, round(aw,6) as actual_weight, case when nw>aw then 'buy' else 'sell' end as action, round((nw-aw)*1e5,2) as notional from (
 select k, ticker, nw, ow*1e5/(1e5+1e-6) as aw from chg) where abs(nw-aw)>0.02""", "chg")
def _(t):
    c = _chg(t)
    e = c.where("new_weight > 0").select("k", "ticker", F.col("new_weight").alias("weight"))
    a = c.where("old_weight > 0").select("k", "ticker", (F.col("old_weight") * 1e5).alias("market_value"))
    return EX.reconcile(e, a, 1e5).select("k", "ticker", *r(["expected_weight", "actual_weight"], 6), "action", *r(["notional"], 2))


@query("delta_orders", "J20 P36", """
select k, ticker, case when d>0 then 'buy' else 'sell' end as side, round(abs(d),2) as notional from (select k, ticker, least(nw*1e6,50000)-ow*3e5 as d from chg where nw>0) where abs(d)>=100""", "chg")
def _(t):
    c = _chg(t).where("new_weight > 0")
    tg = c.select("k", "ticker", F.col("new_weight").alias("weight"))
    return EX.delta_orders(tg, c.select("k", "ticker", (F.col("old_weight") * 3e5).alias("market_value")), 1e6).select("k", "ticker", "side", *r(["notional"], 2))


@query("position_sync", "J18 U5", """
select k, ticker, case when nw>0 then 'open' else 'close' end as action, case when nw>0 then 'new_target' else 'rebalance_removed' end as reason from chg where (ow>0 and nw=0 and ow<=0.1) or (ow=0 and nw>0)
union all select k, ticker, 'close', 'stop_loss' from chg where ow>0.1""", "chg")
def _(t):
    c = _chg(t)
    op = c.where("old_weight > 0").select("k", "ticker")
    ex = c.where("old_weight > 0.1").select("k", "ticker", F.lit("stop_loss").alias("reason"))
    return EX.sync_positions(op, c.where("new_weight > 0").select("k", "ticker"), ex, ["k"])


cte("ords", "select ticker, d, adv, close*volume*(1+ticker%7)*(case when ticker%2=0 then 0.02 else 0.5 end) as notional from calm join adv using (ticker, d)", "calm adv")


def _orders(t):
    adv = FE.average_dollar_volume(t.calm)
    scale = (1 + F.col("ticker") % 7) * F.when(F.col("ticker") % 2 == 0, 0.02).otherwise(0.5)
    return t.calm.join(adv, ["ticker", "d"]).select("ticker", "d", "adv", (F.col("close") * F.col("volume") * scale).alias("notional"))


@query("order_slices", "E1", """
select ticker, d, unnest(range(n)) as slice, round(notional/n,4) as slice_notional, round(notional/n/(adv+1e-6)*100,4) as pct_of_adv, unnest(range(n))*30 as delay_minutes from (
 select *, cast(case when notional<=greatest(adv*0.05,500) then 1 else least(ceil(notional/greatest(adv*0.05,500)),5) end as int) as n from ords)""", "ords")
def _(t):
    return EX.order_slices(_orders(t)).select("ticker", "d", "slice", *r(["slice_notional", "pct_of_adv"]), "delay_minutes")


@query("vwap_schedule", "E2", """
, prof as (select unnest(range(14)) as i, unnest([0.08,0.06,0.05,0.05,0.05,0.05,0.05,0.05,0.05,0.06,0.07,0.10,0.12,0.11]) as f),
 b as (select ticker, d, notional, adv, i*30+15 as time_offset_minutes, least(notional*cast(f as double)/0.95, adv*(case when adv>=5e8 then 0.10 when adv>=5e7 then 0.07 when adv>=1e7 then 0.05 else 0.02 end)/13.0) as v from ords cross join prof where i between 1 and 12)
select ticker, d, time_offset_minutes, round(v,4) as bucket_notional from b where v>=100
union all select ticker, d, 195, round(v,4) from (select o.ticker, o.d, o.adv, o.notional-coalesce(s.v,0) as v from ords o left join (select ticker, d, sum(v) as v from b where v>=100 group by ticker, d) s on s.ticker=o.ticker and s.d=o.d) where v>=100""", "ords")
def _(t):
    return EX.vwap_schedule(_orders(t)).select("ticker", "d", "time_offset_minutes", *r(["bucket_notional"]))


@query("liquidity_tiers", "P5", """
select ticker, d, case when a>=5e8 then 1 when a>=5e7 then 2 when a>=1e7 then 3 else 4 end as tier, case when a>=5e8 then 0.2 when a>=5e7 then 0.15 when a>=1e7 then 0.1 else 0.05 end as max_weight, case when a>=5e8 then 'mega' when a>=5e7 then 'liquid' when a>=1e7 then 'mid' else 'illiquid' end as label from (select ticker, d, adv*20000 as a from adv)""", "adv")
def _(t):
    s = FE.average_dollar_volume(t.calm).withColumn("t", X.liquidity_tier(F.col("adv") * 20000))
    return s.select("ticker", "d", "t.tier", "t.max_weight", "t.label")


@query("slippage_and_stops", "P19 P20", "select k, ticker, round(close*least(0.002+vol/1000,0.01),6) as slippage, round(close*(1-greatest(0.04,least(0.20,0.08*sqrt(vol/100/0.2)))),4) as stop_price from panel", "panel")
def _(t):
    return S.panel(t).select("k", "ticker", F.round(X.slippage_model("close", "vol"), 6).alias("slippage"),
                             F.round(X.vol_adjusted_stop("close", F.col("vol") / 100), 4).alias("stop_price"))


@query("gap_risk", "P26", """
select ticker, d, round(coalesce(g,0),6) as gap_pct, coalesce(abs(g)>0.015,false) as has_gap, case when g<-0.015 then 'widen_stop' else 'none' end as action from (
 select ticker, d, close/lag(close) over (partition by ticker order by d)-1 as g from calm)""", "calm")
def _(t):
    return EX.gap_risk(t.calm, 0.015).select("ticker", "d", *r(["gap_pct"], 6), F.coalesce("has_gap", F.lit(False)).alias("has_gap"), "action")


# ---- positions ----
cte("pos", """
select t.k*100000+t.ticker as position_id, t.ticker, r.reb_d as entry_date, p.close as entry_price from top_long t join reb r using (k) join panel p on p.k=t.k and p.ticker=t.ticker""", "top_long reb panel")
cte("marks", """
select p.*, c.d, c.close, c.prev_close, greatest(p.entry_price, max(c.close) over (partition by position_id order by c.d)) as peak_price from pos p join (select *, lag(close) over (partition by ticker order by d) as prev_close from calm) c
on c.ticker=p.ticker and c.d>=p.entry_date""", "pos calm")
cte("exits", """
select position_id, any_value(ticker) as ticker, any_value(entry_date) as entry_date, any_value(entry_price) as entry_price, min(d) as exit_date, arg_min(reason,d) as exit_reason, arg_min(close,d) as exit_price, arg_min(peak_price,d) as peak_price from (
 select *, case when d-entry_date<3 then null when d-entry_date>=60 then 'max_hold' when (close-entry_price)/entry_price>=0.12 then 'profit_target'
  when (close-entry_price)/entry_price<=-(case when coalesce((close-prev_close)/prev_close,0)<-0.015 then 0.07 else 0.05 end) then case when coalesce((close-prev_close)/prev_close,0)<-0.015 then 'gap_down_exit' else 'stop_loss' end end as reason from marks) where reason is not null group by position_id""", "marks")


def _positions(t):
    from alphaloom.operators import crosssection as CS
    _z, s = S.scored(t)
    top = CS.select_top(s, ["k"], 10, "cs_score").select("k", "ticker", "reb_d")
    px = S.panel(t).select("k", "ticker", "close")
    return top.join(px, ["k", "ticker"]).select((F.col("k").cast("bigint") * 100000 + F.col("ticker")).alias("position_id"), "ticker",
                                                F.col("reb_d").alias("entry_date"), F.col("close").alias("entry_price"))


@query("position_peaks", "W-P1", "select position_id, d, round(peak_price,4) as peak_price from marks", "marks")
def _(t):
    m = EX.position_marks(_positions(t), t.calm)
    return m.select("position_id", "d", *r(["peak_price"]))


def _exits(t):
    return EX.first_exits(_positions(t), t.calm, gap_limit=0.015)


@query("position_exits", "W-P5", "select position_id, ticker, entry_date, exit_date, exit_reason, round(exit_price,4) as exit_price, round(peak_price,4) as peak_price from exits", "exits")
def _(t):
    return _exits(t).select("position_id", "ticker", "entry_date", "exit_date", "exit_reason", *r(["exit_price", "peak_price"]))


cte("trades", "select *, exit_date-entry_date as hold_days, (exit_price-entry_price)/entry_price as gross_pnl, (exit_price-entry_price)/entry_price-0.003 as net_pnl, (exit_price-entry_price)/entry_price-0.003>0 as win from exits", "exits")


@query("trade_pnl", "W-P6", "select position_id, hold_days, round(gross_pnl,6) as gross_pnl, round(net_pnl,6) as net_pnl, win from trades", "trades")
def _(t):
    return EX.trade_pnl(_exits(t)).select("position_id", "hold_days", *r(["gross_pnl", "net_pnl"], 6), "win")


@query("trade_metrics", "A12 P17", """
select *, case when win_rate>=0.55 and profit_factor>=1.3 and n_trades>=20 then 'STRONG — signal working, consider scaling capital' when win_rate>=0.52 and profit_factor>=1.1 and n_trades>=10 then 'POSITIVE — early evidence of edge, continue paper trading'
 when n_trades<10 then format('EARLY — {} trades, need ≥10 to assess', n_trades) else 'WEAK — no clear edge yet, review signal weights' end as verdict from (
 select count(*) as n_trades, round(avg(case when win then 1.0 else 0.0 end),4) as win_rate, round(avg(hold_days),4) as avg_hold_days, round(median(hold_days),4) as median_hold_days,
 round(coalesce(sum(case when win then gross_pnl end),0)/(abs(coalesce(sum(case when not win then gross_pnl end),0))+1e-9),4) as profit_factor, round(avg(net_pnl)*100,4) as avg_net_pnl_pct,
 round(coalesce(avg(case when win then net_pnl end),0)*100,4) as avg_win_pct, round(coalesce(avg(case when not win then net_pnl end),0)*100,4) as avg_loss_pct from (select * from trades order by exit_date desc, position_id desc limit 100))""", "trades")
def _(t):
    return EX.trade_metrics(EX.trade_pnl(_exits(t))).select("n_trades", *r(["win_rate", "avg_hold_days", "median_hold_days", "profit_factor", "avg_net_pnl_pct", "avg_win_pct", "avg_loss_pct"]), "verdict")


@query("trade_buckets", "A12", """
select case when hold_days<7 then '<7d' when hold_days<30 then '7-30d' else '30-60d' end as bucket, count(*) as n, round(avg(case when win then 1.0 else 0.0 end),4) as win_rate, round(avg(net_pnl)*100,4) as avg_pnl from trades group by 1""", "trades")
def _(t):
    return EX.trade_buckets(EX.trade_pnl(_exits(t))).select("bucket", "n", *r(["win_rate", "avg_pnl"]))


@query("exit_reason_counts", "A12", "select exit_reason, count(*) as n from trades group by exit_reason", "trades")
def _(t):
    return EX.exit_counts(_exits(t))


@query("entry_prices", "P35", "select position_id, any_value(ticker) as ticker, round(arg_min(close,d),4) as entry_price, min(d) as entry_date from marks group by position_id", "marks")
def _(t):
    return EX.entry_prices(_positions(t), t.calm).select("position_id", "ticker", *r(["entry_price"]), "entry_date")


@query("stop_loss_breaches", "P18", """
select p.position_id, p.ticker, round((l.close-e.close)/e.close,6) as drawdown from pos p asof join bars e on e.ticker=p.ticker and e.d>=p.entry_date
join (select ticker, arg_max(close,d) as close from bars group by ticker) l on l.ticker=p.ticker where (l.close-e.close)/e.close<-0.08""", "pos bars")
def _(t):
    """Against the unsmoothed bars, at whose first price the positions are taken in."""
    last = t.bars.groupBy("ticker").agg(F.max_by("close", "d").alias("close"))
    return RK.stop_loss_breaches(EX.entry_prices(_positions(t), t.bars), last).select("position_id", "ticker", *r(["drawdown"], 6))


# ---- tax lots ----
cte("lotrun", """
select *, sum(q) over w as s, sum(case when side='buy' then shares else 0 end) over w as bought from (select *, case when side='buy' then shares else -shares end as q, case when side='buy' then 0 else 1 end as o from lots)
window w as (partition by ticker order by trade_date, o, l_orderkey, l_linenumber, l_partkey, shares, price rows unbounded preceding)""", "lots")
cte("lotbal", """
select *, row_number() over (partition by ticker, trade_date order by o, l_orderkey, l_linenumber, l_partkey, shares, price) as seq,
 bought-(s-least(0,min(s) over (partition by ticker order by trade_date, o, l_orderkey, l_linenumber, l_partkey, shares, price rows unbounded preceding))) as sold from lotrun""", "lotrun")
cte("fifo", """
select b.ticker, b.trade_date as open_date, b.seq as lot_seq, b.price as cost, s.trade_date as sell_date, s.seq as sell_seq, s.price as sell_price, b.bought-b.shares as b0, least(b.bought,s.s1)-greatest(b.bought-b.shares,s.s0) as shares
from lotbal b join (select ticker, trade_date, seq, price, s0, s1 from (select *, coalesce(lag(sold) over (partition by ticker order by trade_date, o, l_orderkey, l_linenumber, l_partkey, shares, price),0) as s0, sold as s1 from lotbal) where side='sell') s
 on b.ticker=s.ticker and b.side='buy' and least(b.bought,s.s1)>greatest(b.bought-b.shares,s.s0)""", "lotbal")
cte("fifog", """
select *, shares*(sell_price-cost) as gain, sell_date-open_date as held_days, sell_date-open_date>365 as is_long_term,
 bool_or(sell_date-open_date<30 and shares*(sell_price-cost)<0) over (partition by ticker, sell_date, sell_seq order by b0 rows unbounded preceding) as wash_sale_risk from fifo""", "fifo")


def _fifo(t):
    from alphaloom.sources.storage import materialize
    return S.memo(t, "fifo", lambda: materialize(EX.fifo_matches(t.lots), "fifo"))


def _lifo(t):
    from alphaloom.sources.storage import materialize
    return S.memo(t, "lifo", lambda: materialize(EX.lifo_matches(t.lots), "lifo"))


@query("tax_lots_fifo", "J17 E3", "select ticker, open_date, lot_seq, sell_date, sell_seq, shares, round(gain/(shares*cost),6) as gain_pct, held_days, is_long_term, wash_sale_risk from fifog", "fifog")
def _(t):
    return _fifo(t).select("ticker", "open_date", "lot_seq", "sell_date", "sell_seq", "shares", F.round(F.col("gain") / (F.col("shares") * F.col("cost")), 6).alias("gain_pct"), "held_days", "is_long_term", "wash_sale_risk")


# every unit of balance alternates purchase and sale: a sale meets the event before it
cte("lifou", """
select ticker, trade_date, o, seq, side, price, unnest(range(cast(lo as bigint), cast(hi as bigint))) as h from (
 select *, case when side='buy' then hi0-shares else bought-sold end as lo, case when side='buy' then hi0 else pb end as hi from (
  select *, -sold + min(case when side='buy' then bought-shares end) over (partition by ticker, trade_date) + max(case when side='buy' then bought end) over (partition by ticker, trade_date) - (bought-shares) as hi0,
   coalesce(lag(bought-sold) over (partition by ticker order by trade_date, o, seq),0) as pb from lotbal)) where hi>lo""", "lotbal")
cte("lifog", """
select *, shares*(sell_price-cost) as gain, sell_date-open_date as held_days, sell_date-open_date>365 as is_long_term,
 bool_or(sell_date-open_date<30 and sell_price<cost) over (partition by ticker, sell_date, sell_seq order by top desc rows unbounded preceding) as wash_sale_risk from (
 select ticker, open_date, lot_seq, cost, trade_date as sell_date, seq as sell_seq, price as sell_price, count(*) as shares, max(h) as top from (
  select *, lag(trade_date) over w as open_date, lag(seq) over w as lot_seq, lag(price) over w as cost from lifou window w as (partition by ticker, h order by trade_date, o, seq)) where side='sell' group by all)""", "lifou")


@query("tax_lots_lifo", "J17 UD2", "select ticker, open_date, lot_seq, sell_date, sell_seq, shares, round(gain/(shares*cost),6) as gain_pct, held_days, is_long_term, wash_sale_risk from lifog", "lifog")
def _(t):
    return _lifo(t).select("ticker", "open_date", "lot_seq", "sell_date", "sell_seq", "shares", F.round(F.col("gain") / (F.col("shares") * F.col("cost")), 6).alias("gain_pct"), "held_days", "is_long_term", "wash_sale_risk")


@query("tax_summary", "A14", """
select year(sell_date) as tax_year, round(coalesce(sum(case when not is_long_term then gain end),0),0) as short_term_gain, round(coalesce(sum(case when is_long_term then gain end),0),0) as long_term_gain, count(case when wash_sale_risk then 1 end) as wash_sale_count, count(*) as n_transactions from fifog group by 1""", "fifog")
def _(t):
    return EX.tax_summary(_fifo(t)).select("tax_year", *r(["short_term_gain", "long_term_gain"], 0), "wash_sale_count", "n_transactions")


@query("open_lots", "A14", """
select ticker, sum(l) as shares, round(sum(l*price),0) as cost_basis, count(*) as lots, round(sum(l*price)/greatest(sum(l),1e-6),3) as avg_cost from (
 select b.ticker, b.price, b.shares-coalesce(u.used,0) as l from lotbal b left join (select ticker, open_date, lot_seq, sum(shares) as used from fifo group by 1,2,3) u on u.ticker=b.ticker and u.open_date=b.trade_date and u.lot_seq=b.seq where b.side='buy') where l>=0.001 group by ticker""", "lotbal fifo")
def _(t):
    return EX.open_lots(t.lots, _fifo(t)).select("ticker", "shares", *r(["cost_basis"], 0), "lots", *r(["avg_cost"], 3))


# ---- risk ----
def _eq(t):
    return M.equity_curve(t.curves).select("series_id", "d", "value")


cte("gatein", """
select series_id, d, row_number() over w as j, coalesce(value/lag(value) over w-1<-0.018,false) as loss, row_number() over w>=2 and drawdown<-0.10 as dd from ddc window w as (partition by series_id order by d)""", "ddc")


@query("daily_loss_breaker", "W-P2", "select series_id, d, loss as breach from gatein", "gatein")
def _(t):
    return RK.daily_loss(_eq(t), 0.018).select("series_id", "d", "breach")


@query("drawdown_breaker", "W-P3 W-E6", """
select series_id, d, dd as breach, case when j<2 then 1.0 when drawdown<-0.25 then 0.40 when drawdown<-0.15 then 0.65 when drawdown<-0.08 then 0.85 else 1.0 end as dd_scale from gatein join ddc using (series_id, d)""", "gatein ddc")
def _(t):
    return RK.drawdown_halt(_eq(t), 0.10).select("series_id", "d", "breach", "dd_scale")


@query("halted_dates", "W-P4", """
select c.series_id, c.d from curves c where exists (select 1 from gatein g where g.series_id=c.series_id and g.dd and c.d>g.d and c.d<g.d+30)""", "gatein")
def _(t):
    h = RK.halt_intervals(RK.drawdown_halt(_eq(t), 0.10), 30)
    return RK.halted_at(t.curves.select("series_id", "d"), h)


@query("trade_gate", "W-P4", """
select series_id, d, decision from (with recursive st as (
 select series_id, d, j, case when loss then d+1 when dd then d+30 else date '1900-01-01' end as until, case when loss then 'daily_loss' when dd then 'max_drawdown' else 'ok' end as decision from gatein where j=1
 union all select g.series_id, g.d, g.j, case when g.d<st.until then st.until when g.loss then g.d+1 when g.dd then g.d+30 else st.until end, case when g.d<st.until then 'halted' when g.loss then 'daily_loss' when g.dd then 'max_drawdown' else 'ok' end
 from st join gatein g on g.series_id=st.series_id and g.j=st.j+1) select * from st)""", "gatein")
def _(t):
    return RK.trade_gate(_eq(t), 0.018, 0.10)


@query("dynamic_vol_scale", "W-E7", """
select series_id, d, round(case when n<22 then 1 else greatest(0.2,least(1,least(0.12/greatest(vs,case when n>=63 then vl else vs end,1e-4),1)*(case regime when 'crisis' then 0.70 when 'risk_off' then 0.88 else 1 end))) end,6) as vol_scale from (
 select c.series_id, c.d, row_number() over w as n, coalesce(g.regime,'neutral') as regime, stddev_samp(ret) over (w rows between 20 preceding and current row)*sqrt(252) as vs, stddev_samp(ret) over (w rows between 62 preceding and current row)*sqrt(252) as vl
 from curves c left join regimes g on g.d=c.d window w as (partition by c.series_id order by c.d))""", "curves regimes")
def _(t):
    x = t.curves.join(S.regimes(t).select("d", "regime"), "d", "left").withColumn("regime", F.coalesce("regime", F.lit("neutral")))
    return RK.dynamic_vol_scale(x).select("series_id", "d", *r(["vol_scale"], 6))


@query("vol_target_leverage", "W-E8", "select series_id, round(least(0.12/(stddev_samp(ret)*sqrt(252)+1e-8),2),6) as leverage from curves group by series_id", "curves")
def _(t):
    return RK.vol_target_leverage(t.curves).select("series_id", *r(["leverage"], 6))


@query("sized_positions", "P36 J13", """
select k, ticker, round(w*s,6) as weight, round(w*s*1e5,2) as notional from (select b.k, b.ticker, b.w, case when least(dd,vs)<0.99 then least(dd,vs) else 1 end as s from blend2 b join (select k, case when k%5=0 then 0.85 else 1.0 end as dd, 0.9+(k%3)*0.045 as vs from reb) using (k))""", "blend2 reb")
def _(t):
    from alphaloom.catalog.q_portfolio import _blend2
    reb = TC.rebalance_calendar(TC.trading_days(t.calm), 21)
    sc = reb.select("k", F.when(F.col("k") % 5 == 0, 0.85).otherwise(1.0).alias("dd_scale"), (0.9 + (F.col("k") % 3) * 0.045).alias("vol_scale"))
    return RK.size_positions(_blend2(t), S.panel(t).select("k", "ticker", "close"), sc, ["k"]).select("k", "ticker", *r(["weight"], 6), "notional")


@query("enriched_positions", "J13", """
select b.k, b.ticker, round(b.w,6) as weight, round(p.ret_3m,4) as ret_3m, round(p.vol,4) as vol, p.roe_pct, round(s.score,4) as score from blend2 b left join panel p using (k, ticker) left join score_long s using (k, ticker)""", "blend2 panel score_long")
def _(t):
    from alphaloom.catalog.q_portfolio import _blend2
    _z, s = S.scored(t)
    p = S.panel(t).select("k", "ticker", "ret_3m", "vol", "roe_pct")
    return _blend2(t).join(p, ["k", "ticker"], "left").join(s.select("k", "ticker", "score"), ["k", "ticker"], "left").select(
        "k", "ticker", *r(["weight"], 6), *r(["ret_3m", "vol"]), "roe_pct", *r(["score"]))


# ---- quality ----
cte("qr", """
select ticker, n, list_filter([case when n<525 then 'insufficient_history' end, case when missing>0.05 then 'too_many_nans' end, case when low<=0 then 'zero_or_negative_price' end, case when last<60 then 'penny_stock' end, case when mj>0.0201 then 'price_spike' end, case when n>=20 and adv<6000 then 'low_adv' end], lambda x: x is not null) as reasons from (
 select ticker, count(*) as n, 0.0 as missing, min(close) as low, arg_max(close,d) as last, max(j) as mj, avg(case when rn<=20 then close*volume end) as adv from (
  select *, abs((close-lag(close) over (partition by ticker order by d))/(lag(close) over (partition by ticker order by d)+1e-10)) as j, row_number() over (partition by ticker order by d desc) as rn from calm) group by ticker)""", "calm")


def _qr(t):
    b = t.calm
    return b, Q.quality_report(b, min_bars=525, min_price=60.0, spike=0.0201, min_adv=6000.0)


@query("quality_report", "P1", "select ticker, n, array_to_string(reasons, ',') as reasons, len(reasons)=0 as passed from qr", "qr")
def _(t):
    return _qr(t)[1].select("ticker", "n", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("quality_passed_bars", "P1", "select c.ticker, count(*) as n from calm c join qr on qr.ticker=c.ticker and len(qr.reasons)=0 group by c.ticker", "qr calm")
def _(t):
    b, rep = _qr(t)
    return Q.apply_quality_gates(b, rep).groupBy("ticker").agg(F.count("*").alias("n"))


@query("rejection_report", "A34", "select reason, count(*) as n from (select unnest(reasons) as reason from qr) group by reason union all select 'total', count(*) from qr union all select case when len(reasons)=0 then 'passed' else 'rejected' end, count(*) from qr group by 1", "qr")
def _(t):
    return Q.rejection_report(_qr(t)[1])


@query("data_freshness", "P2", "select ticker, max(d) as last_date, round(date_diff('second', cast(max(d) as timestamp), timestamp '2001-11-05 09:30:00')/3600.0,1) as age_hours, date_diff('second', cast(max(d) as timestamp), timestamp '2001-11-05 09:30:00')/3600.0>72 as stale from bars group by ticker", "bars")
def _(t):
    return Q.freshness(t.bars, F.lit("2001-11-05 09:30:00").cast("timestamp"))


@query("universe_screen", "P3", """
select ticker from (select ticker, count(case when ok then 1 end) over () as n, ok from (select s.ticker, (coalesce(market_cap,0)=0 and coalesce(v,0)=0) or (market_cap>5e9 and v*p>30000 and p>3) as ok from sectors s left join (select ticker, avg(volume) as v, arg_max(close,d) as p from bars group by ticker) b using (ticker))) where ok or n<15""", "sectors bars")
def _(t):
    b = t.bars.groupBy("ticker").agg(F.avg("volume").alias("avg_volume"), F.max_by("close", "d").alias("price"))
    return Q.screen_universe(t.sectors.join(b, "ticker", "left"), min_dollar=30000.0).select("ticker")


@query("row_validation", "S11", """
select series_id, count(*) as n, count(case when abs(r)>0.5 then 1 end) as bad from (select ticker as series_id, close/lag(close) over (partition by ticker order by d)-1 as r from bars) group by series_id""", "bars")
def _(t):
    rows = FE.daily_returns(t.bars).select(F.col("ticker").alias("series_id"), "d", F.col("ret").alias("net_return"))
    return Q.validate_pnl(rows).groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.size("errors") > 0).alias("bad"))


@query("blackout_calendar", "P6", """
, x as (select d, date_trunc('month',d) as m from (select distinct cast(o_orderdate as date) + 9862 as d from orders)),
 y as (select *, cast(m as date) + cast((12-dayofweek(m))%7 as int) + 14 as tf, cast(m as date) + 27 - cast((dayofweek(cast(m as date)+27)+2)%7 as int) as lf from x)
select d, array_to_string(list_filter([case when strftime(d,'%Y-%m-%d') in ('2024-01-31','2024-03-20','2024-05-01','2024-06-12','2024-07-31','2024-09-18','2024-11-07','2024-12-18','2025-01-29','2025-03-19','2025-05-07','2025-06-18','2025-07-30','2025-09-17','2025-11-05','2025-12-17') then 'fomc_meeting' end,
 case when year(d) between 2022 and 2026 and month(d)%3=0 and d=tf then 'triple_witching' end, case when year(d) between 2022 and 2026 and month(d)%3=0 and d=lf then 'index_rebalance' end, case when year(d) between 2022 and 2026 and d=tf then 'options_expiration' end], lambda v: v is not null),',') as reasons from y""", "")
def _(t):
    days = t.raw("orders").select(F.date_add(F.col("o_orderdate").cast("date"), 9862).alias("d")).distinct()
    return TC.blackout_calendar(days).select("d", F.array_join("reasons", ",").alias("reasons"))


@query("upcoming_blackouts", "P6", """
, x as (select distinct cast(o_orderdate as date) + 9862 as anchor from orders), s as (select anchor, anchor + cast(unnest(range(10)) as int) as d from x),
 y as (select *, cast(m as date) + cast((12-dayofweek(m))%7 as int) + 14 as tf, cast(m as date) + 27 - cast((dayofweek(cast(m as date)+27)+2)%7 as int) as lf from (select *, date_trunc('month',d) as m from s)),
 f as (select anchor, d, strftime(d,'%Y-%m-%d') in ('2024-01-31','2024-03-20','2024-05-01','2024-06-12','2024-07-31','2024-09-18','2024-11-07','2024-12-18','2025-01-29','2025-03-19','2025-05-07','2025-06-18','2025-07-30','2025-09-17','2025-11-05','2025-12-17') as a,
  year(d) between 2022 and 2026 and month(d)%3=0 and d=tf as b, year(d) between 2022 and 2026 and month(d)%3=0 and d=lf as c from y)
select anchor, d, array_to_string(list_filter([case when a then 'fomc_meeting' end, case when b then 'triple_witching' end, case when c then 'index_rebalance' end], lambda v: v is not null),',') as reasons, least(case when a then 0.5 else 1 end, case when b then 0.7 else 1 end, case when c then 0.75 else 1 end) as scale from f where a or b or c""", "")
def _(t):
    days = t.raw("orders").select(F.date_add(F.col("o_orderdate").cast("date"), 9862).alias("d")).distinct()
    return TC.upcoming_blackouts(days).select("anchor", "d", F.array_join("reasons", ",").alias("reasons"), F.round("scale", 2).alias("scale"))


@query("auction_windows", "P7", """
select event_id, (hour(l)*60+minute(l) between 570 and 580) or (hour(l)*60+minute(l) between 950 and 960) as near_auction from (select event_id, timezone('America/New_York', timezone('UTC', ts)) as l from events)""", "")
def _(t):
    return t.raw("events").select("event_id", X.auction_window(F.col("ts").cast("timestamp")).alias("near_auction"))


@query("horizon_presets", "P33", """
select p.k, p.ticker, h.horizon, h.rebalance_days, h.top_n from panel p cross join (select * from (values ('swing',5,12),('longterm',63,15)) v(horizon, rebalance_days, top_n)) h""", "panel")
def _(t):
    from alphaloom.params import horizon_params
    hs = [(h, horizon_params(h)) for h in ("swing", "longterm")]
    arr = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(p.rebalance_days).alias("rebalance_days"), F.lit(p.top_n).alias("top_n")) for h, p in hs])
    return S.panel(t).select("k", "ticker", F.explode(arr).alias("h")).select("k", "ticker", "h.*")
