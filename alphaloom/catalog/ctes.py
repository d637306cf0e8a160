"""Shared SQL fragments (ANSI SQL with window frames) for the query twins."""

from __future__ import annotations

import re

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, deps: str = "") -> None:
    CTES[name] = (tuple(deps.split()), body.strip())


def with_ctes(body: str, names: list[str], recursive: bool = False) -> str:
    """Prefix ``body`` with the named fragments and all they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)
    for n in names:
        visit(n)
    body = body.strip()
    if not order:
        return "with" + body[1:] if body.startswith(",") else body
    head = ",\n".join(f"{n} as ({CTES[n][1]})" for n in order)
    if body.lower().startswith("with "):
        raise ValueError("give CTEs by name")
    if body.startswith(","):
        return f"with {head}\n{body}"
    return f"with {head}\n{body}"


def variants(root: str, suffix: str, edit):
    """Copies, under names with a suffix, of a fragment and all that build on it, with ``edit(name, body)`` applied.

    Gives the function that turns a query over the old names into one over the new ones (by a further edit named "").
    """
    uses = {root}
    while more := {n for n, (deps, _) in CTES.items() if n not in uses and uses & set(deps)}:
        uses |= more
    renamed = lambda sql: re.sub(r"\b(" + "|".join(sorted(uses, key=len, reverse=True)) + r")\b", rf"\1{suffix}", sql)
    for n in sorted(uses):
        deps, body = CTES[n]
        cte(n + suffix, renamed(edit(n, body)), " ".join(d + suffix if d in uses else d for d in deps))
    return lambda sql: renamed(edit("", sql))


cte("bars", """
select l_suppkey as ticker, cast(l_shipdate as date) as d,
       sum(l_extendedprice)/sum(l_quantity) as close, sum(l_quantity) as volume
from lineitem group by l_suppkey, cast(l_shipdate as date)""")
cte("bars_brand", """
select p_brand as ticker, cast(l_shipdate as date) as d,
       sum(l_extendedprice)/sum(l_quantity) as close, sum(l_quantity) as volume
from lineitem join part on l_partkey = p_partkey group by p_brand, cast(l_shipdate as date)""")
cte("sectors", """
select s_suppkey as ticker, r_name as sector, s_acctbal*1000000.0 as market_cap
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
cte("macro_series", """
select 'SPY' as symbol, cast(l_shipdate as date) as d, sum(l_extendedprice)/sum(l_quantity) as close from lineitem group by cast(l_shipdate as date)
union all select '^VIX', cast(l_shipdate as date), 400.0*avg(l_discount) from lineitem group by cast(l_shipdate as date)
union all select case when l_returnflag='A' then 'HYG' else 'IEF' end, cast(l_shipdate as date), sum(l_extendedprice)/sum(l_quantity)
  from lineitem where l_returnflag in ('A','N') group by case when l_returnflag='A' then 'HYG' else 'IEF' end, cast(l_shipdate as date)
union all select case when l_linenumber%2=0 then 'TLT' else 'SHY' end, cast(l_shipdate as date), sum(l_extendedprice)/sum(l_quantity)
  from lineitem group by case when l_linenumber%2=0 then 'TLT' else 'SHY' end, cast(l_shipdate as date)""")
cte("fund_q", """
select l_suppkey as ticker,
       cast(cast(date_trunc('quarter', l_shipdate) as date) + interval '3' month - interval '1' day as date) as report_date,
       sum(l_extendedprice) as revenue,
       sum(l_extendedprice*(0.6-l_discount)) as gross_profit,
       sum(l_extendedprice*(0.2-l_discount-l_tax)) as net_income,
       sum(case when l_linestatus='F' then l_extendedprice*0.2 else 0.0 end) as cfo,
       sum(l_quantity)*10.0 as capex
from lineitem group by 1, 2""")
cte("fundamentals", """
select ticker, report_date, cast(report_date + interval '60' day as date) as available_date,
       revenue, gross_profit, net_income, cfo, capex,
       sum(revenue) over (partition by ticker order by report_date rows between unbounded preceding and current row) as total_assets,
       revenue*0.5 as total_debt,
       sum(revenue) over (partition by ticker order by report_date rows between unbounded preceding and current row) - revenue*0.5 as equity,
       gross_profit*0.5 as ebit, revenue*0.8 as current_assets, revenue*0.4 + capex as current_liab
from fund_q""", "fund_q")
cte("membership_events", """
select s_suppkey as ticker, cast(date '1996-01-01' + cast((s_suppkey*37)%900 as int) as date) as d, 'add' as action from supplier where s_suppkey%3=0
union all
select s_suppkey, cast(date '1999-01-01' + cast((s_suppkey*53)%700 as int) as date), 'remove' from supplier where s_suppkey%5=0""")
cte("corporate_actions", """
select s_suppkey as ticker, cast(date '1997-01-01' + cast((s_suppkey*11)%365 as int) as date) as d, 'split' as type, cast(2.0 as double) as ratio, cast(0.5 as double) as price_multiplier from supplier where s_suppkey%4=0
union all select s_suppkey, cast(date '1998-03-15' + cast((s_suppkey*7)%365 as int) as date), 'dividend', cast(0.75 as double), cast(1.0 as double) from supplier where s_suppkey%2=1
union all select s_suppkey, date '1999-05-04', 'spinoff', cast(1.0 as double), cast(1.0 as double) from supplier where s_suppkey%9=0
union all select s_suppkey, date '2000-06-01', 'merger', cast(1.0 as double), cast(0.0 as double) from supplier where s_suppkey%10=3""")
cte("holders", """
select l_suppkey as ticker, o_custkey as holder, sum(l_quantity) as shares
from lineitem join orders on l_orderkey = o_orderkey group by l_suppkey, o_custkey""")
cte("news", """
select doc_id%10 as ticker, text, timestamp '2024-01-01 00:00:00' + cast(doc_id%72 as int) * interval '1' hour as published_at from documents""")
cte("executions", """
select o_orderkey as trade_id, o_custkey%10 as ticker, case when o_custkey%2=0 then 'buy' else 'sell' end as side,
       o_totalprice as arrival_price,
       case when o_orderstatus='P' then null else o_totalprice*(1.0 + (o_orderkey%21-10)/1000.0) end as fill_price,
       cast(o_orderdate as date) as d
from orders""")
cte("lots", """
select l_suppkey as ticker, cast(l_shipdate as date) as trade_date,
       case when l_returnflag='R' then 'sell' else 'buy' end as side,
       l_quantity as shares, l_extendedprice/l_quantity as price, l_orderkey, l_linenumber, l_partkey
from lineitem""")
cte("curves", """
select ticker as series_id, d, greatest(-0.02, least(0.02, r/50.0)) as ret from (
  select ticker, d, close/lag(close) over (partition by ticker order by d) - 1 as r from bars) x where r is not null""", "bars")
cte("calm", """
select b.ticker, b.d, 100*exp(sum(coalesce(ln(1+ret), 0)) over (partition by b.ticker order by b.d)) as close, b.volume
from bars b left join curves c on b.ticker = c.series_id and b.d = c.d""", "bars curves")
cte("ic", """
select event_type as factor, cast(ts as date) as d, cast((sum(event_id)%201-100)/100.0 as double) as ic from events group by event_type, cast(ts as date)""")
cte("ticks", "select user_id as ticker, ts, value as price, event_id from events")

# ---- feature pack over the brand bars and over the supplier bars ----
_FEAT_BASE = """
select ticker, d, close, volume, row_number() over w as n,
  (close - lag(close) over w)/(lag(close) over w + 1e-10) as r,
  close/lag(close) over w - 1 as ret,
  sign(close - lag(close) over w) as sg,
  avg(close) over (w rows between 200 preceding and 1 preceding) as sma200_prev
from {src} window w as (partition by ticker order by d)"""
_FEAT = """
select ticker, d, close, volume, n,
  case when n>=252 then (c21/c252-1)*100 when n>=84 then (c21/c_first-1)*100 else 0 end as momentum_12_1,
  case when n>=126 then (close/c126-1)*100 else 0 end as ret_6m,
  case when n>=63 then (close/c63-1)*100 else 0 end as ret_3m,
  case when n>=21 then (close/c21-1)*100 else 0 end as ret_1m,
  (close/c5-1)*100 as ret_1w,
  s30*sqrt(252)*100 as vol,
  case when n>=91 then s30*sqrt(252)*100/(s90*sqrt(252)*100+1e-6) else 1 end as vol_regime,
  (m3-3*m1*m2+2*m1*m1*m1)/((s30+1e-10)*(s30+1e-10)*(s30+1e-10)) as skewness,
  (close-sma50)/(s30*sqrt(252)*sma50+1e-6) as mean_reversion,
  case when n<200 then 0 when close>sma200 then 1 else -1 end as trend_strength,
  case when n>=200 then close/hi252 else 0.5 end as high_52w_proximity,
  case when n>=220 then slope else 0 end as trend_slope,
  (obv-obv19)/((obv_sd+1e-6)*20) as flow_signal,
  -ln(1+amihud*1e6) as liquidity,
  up/(down+1e-6) as volume_trend,
  (close/c6-1)/(prior_sd+1e-6) as earnings_surprise
from (select ticker, d, close, volume, n,
  lag(close,4) over w as c5, lag(close,5) over w as c6, lag(close,20) over w as c21, lag(close,62) over w as c63,
  lag(close,125) over w as c126, lag(close,251) over w as c252, first_value(close) over w as c_first,
  stddev_pop(r) over w30 as s30, stddev_pop(r) over (w rows between 89 preceding and current row) as s90,
  avg(r) over w30 as m1, avg(r*r) over w30 as m2, avg(r*r*r) over w30 as m3,
  avg(close) over (w rows between 49 preceding and current row) as sma50,
  avg(close) over (w rows between 199 preceding and current row) as sma200,
  max(close) over (w rows between 251 preceding and current row) as hi252,
  regr_slope(close/(sma200_prev+1e-6), n) over w20 as slope,
  obv, lag(obv,19) over w as obv19, stddev_pop(obv) over w20 as obv_sd,
  avg(abs(r)/(close*volume+1e-6)) over w20 as amihud,
  coalesce(avg(case when sg>0 then volume end) over w20,0) as up,
  coalesce(avg(case when sg<0 then volume end) over w20,0) as down,
  stddev_pop(r) over (w rows between 24 preceding and 6 preceding) as prior_sd
from (select *, sum(coalesce(sg,0)*volume) over (partition by ticker order by d) as obv from {base})
window w as (partition by ticker order by d),
  w20 as (partition by ticker order by d rows between 19 preceding and current row),
  w30 as (partition by ticker order by d rows between 29 preceding and current row))
where n>=60"""
cte("fb_brand", _FEAT_BASE.format(src="bars_brand"), "bars_brand")
cte("feat_brand", _FEAT.format(base="fb_brand"), "fb_brand")
cte("fb_calm", _FEAT_BASE.format(src="calm"), "calm")
cte("feat_calm", _FEAT.format(base="fb_calm"), "fb_calm")

# ---- macro snapshot per date and regime label ----
cte("macro", """
select d, coalesce(vix, 20) as vix, coalesce(vix5, 0) as vix_5d_change, coalesce(spy_3m, 0) as spy_3m,
  coalesce(credit, 0) as credit, coalesce(yc, 0) as yc, coalesce(vol_regime, 1) as vol_regime
from (select d,
  max(case when symbol='^VIX' then close end) as vix,
  max(case when symbol='^VIX' then case when n>=5 then (close-c5)/(c5+1e-6)*100 end end) as vix5,
  max(case when symbol='SPY' then case when n>63 then (close/c63-1)*100 end end) as spy_3m,
  max(case when symbol='SPY' then case when n>63 then s30*sqrt(252)/(s90*sqrt(252)+1e-6) end end) as vol_regime,
  max(case when symbol='HYG' then g end) - max(case when symbol='IEF' then g end) as credit,
  max(case when symbol='TLT' then g end) - max(case when symbol='SHY' then g end) as yc
 from (select symbol, d, close, n, lag(close,4) over w as c5, lag(close,62) over w as c63,
   case when n>21 then close/lag(close,21) over w end as g,
   stddev_samp(ret) over (w rows between 29 preceding and current row) as s30,
   stddev_samp(ret) over (w rows between 89 preceding and current row) as s90
  from (select symbol, d, close, row_number() over v as n, close/lag(close) over v - 1 as ret
        from macro_series window v as (partition by symbol order by d))
  window w as (partition by symbol order by d)) group by d)""", "macro_series")
REGIME_SQL = """(case when {vix}<15 then 2 when {vix}<20 then 1 when {vix}<25 then -0.5 when {vix}<30 then -1.5 else -3 end
 + case when {spy}>5 then 2 when {spy}>0 then 0.5 when {spy}>-5 then -1 else -2.5 end
 + case when {cr}>0.01 then 1.5 when {cr}>0 then 0.5 when {cr}>-0.01 then -0.5 else -1.5 end
 + case when {yc}>0.02 then 1 when {yc}<-0.02 then -1 else 0 end
 + case when {vr}<0.8 then 1 when {vr}>1.3 then -1.5 else 0 end)"""


def regime_label(points: str) -> str:
    return f"case when {points}>=3.5 then 'risk_on' when {points}>=0.5 then 'neutral' when {points}>=-2 then 'risk_off' else 'crisis' end"


cte("regimes", f"""
select d, vix, spy_ret_3m, vol_regime, {regime_label('pts')} as regime from (
 select *, {REGIME_SQL.format(vix='vix', spy='spy_ret_3m', cr='0.0', yc='0.0', vr='vol_regime')} as pts from (
  select d, vix, (spy/lag(spy,63) over w - 1)*100 as spy_ret_3m, n,
   stddev_samp(ret) over (w rows between 29 preceding and current row)*sqrt(252)
    /(stddev_samp(ret) over (w rows between 89 preceding and current row)*sqrt(252)+1e-6) as vol_regime
  from (select s.d, s.close as spy, v.close as vix, row_number() over (order by s.d) as n,
          s.close/lag(s.close) over (order by s.d) - 1 as ret
        from macro_series s join macro_series v on s.d = v.d and s.symbol='SPY' and v.symbol='^VIX')
  window w as (order by d)) where n > 90)""", "macro_series")

# ---- rebalance calendar over the calm panel: every 21st date ----
cte("cal", "select d, row_number() over (order by d) - 1 as idx from (select distinct d from calm)", "calm")
cte("reb", """
select idx, d as reb_d, (idx-100)//21 as k from cal
where idx >= 100 and idx < (select count(*) from cal) - 21 and (idx-100)%21 = 0""", "cal")

# ---- point-in-time panel over the calm bars ----
cte("fratio", """
select *, cfo-abs(capex) as fcf, round(net_income/equity*100,2) as roe_pct, round(net_income/total_assets*100,2) as roa_pct,
 round(ebit/(equity+total_debt)*100,2) as roic_pct, round(ebit/revenue*100,2) as op_margin_pct,
 round(net_income/revenue*100,2) as net_margin_pct, round(gross_profit/revenue*100,2) as gross_margin_pct,
 round((cfo-abs(capex))/revenue*100,2) as fcf_margin_pct, round(total_debt/equity,4) as de_ratio,
 round(current_assets/current_liab,4) as current_ratio from fundamentals""", "fundamentals")
cte("adv", "select ticker, d, close*avg(volume) over (partition by ticker order by d rows between 20 preceding and current row) as adv from calm", "calm")
cte("probe", """
select p.k, p.reb_d, f.*, a.adv from (select k, reb_d, ticker from reb cross join (select distinct ticker from calm)) p
asof join feat_calm f on p.ticker = f.ticker and p.reb_d > f.d
join adv a on a.ticker = f.ticker and a.d = f.d""", "reb feat_calm adv")
cte("eligible", "select * from probe where n>=100 and adv>=1000", "probe")
cte("members", """
select ticker, d as valid_from, nd as valid_to from (
 select *, lead(d) over (partition by ticker order by d) as nd from (
  select ticker, d, max(action) as action from (
   select s_suppkey as ticker, date '0001-01-01' as d, 'add' as action from supplier where s_suppkey%3<>0
   union all select * from membership_events) group by ticker, d)) where action='add'""", "membership_events")
cte("panel", """
select e.* exclude (d), e.d as bar_d, coalesce(s.sector,'Unknown') as sector, coalesce(g.regime,'neutral') as regime,
 f.roe_pct, f.roic_pct, f.op_margin_pct, f.fcf_margin_pct, f.gross_margin_pct,
 round((f.revenue-h.revenue)/abs(h.revenue)*100,2) as revenue_growth, round((f.net_income-h.net_income)/abs(h.net_income)*100,2) as ni_growth,
 1 + (case when coalesce(f.roa_pct,0)>0 then 1 else 0 end) + (case when coalesce(f.cfo,0)>0 then 1 else 0 end)
  + (case when coalesce(f.roa_pct,0)>coalesce(h.roa_pct,0) then 1 else 0 end)
  + (case when coalesce(f.cfo,0)>coalesce(f.net_income,0) then 1 else 0 end)
  + (case when coalesce(nullif(f.de_ratio,0),999)<coalesce(nullif(h.de_ratio,0),999) then 1 else 0 end)
  + (case when coalesce(f.current_ratio,0)>coalesce(h.current_ratio,0) then 1 else 0 end)
  + (case when coalesce(f.gross_margin_pct,0)>coalesce(h.gross_margin_pct,0) then 1 else 0 end)
  + (case when coalesce(f.revenue,0)/coalesce(nullif(f.total_assets,0),1)>coalesce(h.revenue,0)/coalesce(nullif(h.total_assets,0),1) then 1 else 0 end) as piotroski,
 case when coalesce(f.total_assets,1)>0 then greatest(-0.5,least(0.5,(coalesce(f.net_income,0)-coalesce(f.cfo,0))/coalesce(f.total_assets,1))) else 0 end as accruals
from (select e.* from eligible e join members m on e.ticker=m.ticker and e.reb_d>=m.valid_from and (m.valid_to is null or e.reb_d<m.valid_to)) e
left join sectors s on e.ticker=s.ticker
asof left join fratio f on e.ticker=f.ticker and e.reb_d>=f.available_date
asof left join fratio h on e.ticker=h.ticker and e.reb_d - interval '380' day >= h.available_date
asof left join regimes g on e.reb_d>=g.d""", "eligible members sectors fratio regimes")
cte("rawf", """
select k, ticker, sector, momentum_12_1, ret_3m as momentum, ret_3m-ret_6m as price_accel, -ret_1m as reversal,
 ret_3m-median(ret_3m) over (partition by k) as rel_strength, ret_3m-median(ret_3m) over (partition by k, sector) as sector_momentum,
 0.30*coalesce(roe_pct,0)+0.25*coalesce(roic_pct,0)+0.20*coalesce(op_margin_pct,0)+0.15*coalesce(fcf_margin_pct,0)+0.10*coalesce(gross_margin_pct,0) as quality,
 cast(piotroski as double) as piotroski, coalesce(roic_pct,0) as roic, coalesce(revenue_growth,0) as growth, cast(0 as double) as value,
 cast(0 as double) as fmp_alpha, coalesce(earnings_surprise,0) as earnings_surprise, cast(0 as double) as sentiment, coalesce(flow_signal,0) as flow_signal,
 coalesce(liquidity,0) as liquidity, coalesce(vol,20) as volatility, coalesce(vol_regime,1) as vol_regime, coalesce(high_52w_proximity,0.5) as high_52w,
 coalesce(trend_slope,0) as trend_slope, coalesce(skewness,0) as skewness, accruals, coalesce(mean_reversion,0) as mean_reversion
from panel where k in (select k from panel group by k having count(*)>=5)""", "panel")
cte("longf", """
select k, ticker, sector, factor, cast(value as double) as value from (
 select k, ticker, sector, momentum_12_1, momentum, price_accel, reversal, rel_strength, sector_momentum, quality, piotroski, roic, growth,
  value as value_, fmp_alpha, earnings_surprise, sentiment, flow_signal, liquidity, volatility, vol_regime, high_52w, trend_slope, skewness, accruals, mean_reversion from rawf)
unpivot (value for factor in (momentum_12_1, momentum, price_accel, reversal, rel_strength, sector_momentum, quality, piotroski, roic, growth,
  value_, fmp_alpha, earnings_surprise, sentiment, flow_signal, liquidity, volatility, vol_regime, high_52w, trend_slope, skewness, accruals, mean_reversion))""", "rawf")
cte("adjf", """
select k, ticker, case factor when 'value_' then 'value' else factor end as factor,
 case when factor in ('momentum_12_1','momentum','quality','roic','growth') and count(*) over w >= 2
      then (value-avg(value) over w)/(stddev_pop(value) over w+1e-6) else value end as value
from longf window w as (partition by k, factor, sector)""", "longf")
cte("winf", """
select k, ticker, factor, case when factor='value' then value else greatest(lo, least(hi, value)) end as value from (
 select *, quantile_cont(value,0.025) over (partition by k, factor) as lo, quantile_cont(value,0.975) over (partition by k, factor) as hi from adjf)""", "adjf")
cte("zf", "select k, ticker, factor, (value-avg(value) over w)/(stddev_pop(value) over w+1e-6) as z from winf window w as (partition by k, factor)", "winf")


def _weights_sql(table):
    rows = [f"('{r}','{f}',cast({w[i]} as double))" for f, w in table.items()
            for i, r in enumerate(("risk_on", "neutral", "risk_off", "crisis"))]
    return "select * from (values " + ", ".join(rows) + ") w(regime, factor, weight)"


from alphaloom import params as _P  # noqa: E402

cte("w_long", _weights_sql(_P.LONG_TERM_WEIGHTS))
cte("w_swing", _weights_sql(_P.SWING_WEIGHTS))


def score_sql(wname, adjust, crisis, volc, scales=None):
    adj = " ".join(f"when '{f}' then {v}" for f, v in adjust.items())
    cri = " ".join(f"when '{f}' then {v}" for f, v in crisis.items())
    scale, join = ("*coalesce(s.scale,1)", f" left join {scales} s on s.k=z.k and s.factor=z.factor") if scales else ("", "")
    return f"""
select z.k, z.ticker, sum((coalesce(w.weight,0){scale} + case z.factor {adj} else 0 end
  + case when p.regime='crisis' then case z.factor {cri} else 0 end else 0 end) * greatest(-3,least(3,z.z))) + ({volc})*max(coalesce(nullif(p.vol,0),20)) as score
from zf z join panel p on z.k=p.k and z.ticker=p.ticker left join {wname} w on w.regime=p.regime and w.factor=z.factor{join} group by z.k, z.ticker"""


cte("score_long", score_sql("w_long", _P.LONG_TERM_ADJUST, _P.LONG_TERM_CRISIS, _P.LONG_TERM_VOL), "zf panel w_long")
cte("score_swing", score_sql("w_swing", _P.SWING_ADJUST, _P.SWING_CRISIS, _P.SWING_VOL), "zf panel w_swing")
cte("cs_long", "select k, ticker, score, (score-avg(score) over (partition by k))/(stddev_pop(score) over (partition by k)+1e-9) as cs_score from score_long", "score_long")
cte("top_long", "select * from (select *, row_number() over (partition by k order by cs_score desc, ticker) as rn from cs_long) where rn<=10", "cs_long")
