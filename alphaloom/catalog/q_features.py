"""Price features, macro and regime queries."""

from pyspark.sql import functions as F

from alphaloom.catalog.base import query
from alphaloom.catalog.ctes import REGIME_SQL, regime_label
from alphaloom.functions import expr as X
from alphaloom.operators import features as FE
from alphaloom.operators import regime as RG
from alphaloom.sources.storage import materialize


def r4(*names, k=4):
    return [F.round(n, k).alias(n) for n in names]


def sr(names, k=4):
    return ", ".join(f"round({n},{k}) as {n}" for n in names)


def _pack(name, ids, cols, doc, ctes="feat_brand"):
    @query(name, ids, f"select ticker, d, {sr(cols)} from feat_brand", ctes)
    def run(t, cols=cols):
        return FE.price_features(t.bars_brand).select("ticker", "d", *r4(*cols))
    run.__doc__ = doc


_pack("feature_momentum", "W1", ["momentum_12_1"], "12-1 momentum")
_pack("feature_returns", "W2", ["ret_6m", "ret_3m", "ret_1m", "ret_1w"], "horizon returns")
_pack("feature_volatility", "W4 W5", ["vol", "vol_regime"], "30-day volatility and its ratio to 90 days")
_pack("feature_skewness", "W6", ["skewness"], "population skewness of 30 returns")
_pack("feature_mean_reversion", "W7", ["mean_reversion"], "distance from the 50-day mean")
_pack("feature_trend", "W8 W9 W10", ["trend_strength", "high_52w_proximity", "trend_slope"], "trend pack")
_pack("feature_flow", "W11", ["flow_signal"], "OBV trend")
_pack("feature_liquidity", "W12 W13", ["liquidity", "volume_trend"], "Amihud and up/down volume")
_pack("feature_surprise_proxy", "W14", ["earnings_surprise"], "5-day move in prior deviations")


@query("feature_derived", "W3 W15", """
select ticker, d, round(-ret_1w,4) as reversal, round(ret_3m-ret_6m,4) as price_accel,
       round(vol/15.0,4) as beta_proxy, round(ret_3m,4) as rel_strength from feat_brand""", "feat_brand")
def _(t):
    return FE.price_features(t.bars_brand).select("ticker", "d", *r4("reversal", "price_accel", "beta_proxy", "rel_strength"))


@query("feature_flow_price_only", "W11", """
select ticker, d, flow_signal from (select ticker, d, n, sum(sg) over (partition by ticker order by d rows between 18 preceding and current row) as flow_signal from fb_brand) where n>=60""", "fb_brand")
def _(t):
    return FE.price_only_flow(t.bars_brand).select("ticker", "d", "flow_signal")


@query("live_tech_pack", "W16", """
select ticker, d, round(ret_1m,4) as ret_1m, round(ret_3m,4) as ret_3m, round(ret_6m,4) as ret_6m, round(m12,4) as ret_12m_skip1m,
  round(sma50,4) as sma50, round(sma200,4) as sma200, round(v30,4) as ann_vol_30d, round(v90,4) as ann_vol_90d,
  round(close/hi,4) as high_52w_proximity, round(v30/(v90+1e-6),4) as vol_regime,
  round((close-sma50)/(v30/100*sma50+1e-6),4) as z_score
from (select ticker, d, close, n,
  case when n>22 then (close/lag(close,21) over w-1)*100 else 0 end as ret_1m,
  case when n>63 then (close/lag(close,62) over w-1)*100 else 0 end as ret_3m,
  case when n>126 then (close/lag(close,125) over w-1)*100 else 0 end as ret_6m,
  case when n>=252 then (lag(close,21) over w/lag(close,251) over w-1)*100
       when n>=100 then (lag(close,21) over w/first_value(close) over w-1)*100 else 0 end as m12,
  case when n>=50 then avg(close) over (w rows between 49 preceding and current row) else close end as sma50,
  case when n>=200 then avg(close) over (w rows between 199 preceding and current row) else close end as sma200,
  stddev_samp(ret) over (w rows between 29 preceding and current row)*sqrt(252)*100 as v30,
  case when n>=91 then stddev_samp(ret) over (w rows between 89 preceding and current row) else stddev_samp(ret) over (w rows between 29 preceding and current row) end*sqrt(252)*100 as v90,
  case when n>=50 then max(close) over (w rows between 251 preceding and current row) else close end as hi
 from fb_calm window w as (partition by ticker order by d)) where n>=30""", "fb_calm")
def _(t):
    return FE.live_tech(t.calm).select("ticker", "d", *r4(
        "ret_1m", "ret_3m", "ret_6m", "ret_12m_skip1m", "sma50", "sma200", "ann_vol_30d", "ann_vol_90d",
        "high_52w_proximity", "vol_regime", "z_score"))


@query("pead_proxy", "W17", """
select ticker, d, round(case when abs(r5)>=0.03 and volume>1.5*av then r5/(sd+1e-6) when abs(r5)>=0.05 then r5/(sd+1e-6)*0.5 else 0 end,4) as earnings_surprise
from (select ticker, d, n, volume, close/lag(close,5) over w-1 as r5,
  stddev_samp(ret) over (w rows between 25 preceding and 6 preceding) as sd,
  avg(volume) over (w rows between 19 preceding and current row) as av
  from fb_brand window w as (partition by ticker order by d)) where n>=26""", "fb_brand")
def _(t):
    return FE.pead_proxy(t.bars_brand).select("ticker", "d", *r4("earnings_surprise"))


@query("fast_surprise_proxy", "W18", """
select ticker, d, case when n<30 then 0 else round((m5-m20)/(sd+1e-6),3) end as surprise from (
 select ticker, d, n, avg(close) over (w rows between 4 preceding and current row) as m5,
  avg(close) over (w rows between 24 preceding and 5 preceding) as m20,
  stddev_pop(close) over (w rows between 24 preceding and 5 preceding) as sd
 from fb_brand window w as (partition by ticker order by d))""", "fb_brand")
def _(t):
    return FE.fast_surprise(t.bars_brand)


@query("volume_flow", "W19", """
select ticker, d, round(case when n<20 then 0 else f/(v+1e-6) end,4) as flow from (
 select ticker, d, n, sum(dv) over (w rows between 18 preceding and current row) as f,
  sum(volume) over (w rows between 19 preceding and current row) as v
 from (select *, (close-lag(close) over (partition by ticker order by d))*volume as dv from fb_brand)
 window w as (partition by ticker order by d))""", "fb_brand")
def _(t):
    return FE.volume_flow(t.bars_brand).select("ticker", "d", *r4("flow"))


@query("average_dollar_volume", "W20", """
select ticker, d, round(close*avg(volume) over (partition by ticker order by d rows between 20 preceding and current row),2) as adv from calm""", "calm")
def _(t):
    return FE.average_dollar_volume(t.calm).select("ticker", "d", *r4("adv", k=2))


@query("relative_strength", "P24", """
select b.ticker, b.d, round(coalesce(b.own,0)-coalesce(m.mkt,0),4) as rel_strength
from (select ticker, d, (close/lag(close,62) over (partition by ticker order by d)-1)*100 as own from bars_brand) b
left join (select d, (close/lag(close,62) over (order by d)-1)*100 as mkt from macro_series where symbol='SPY') m using (d)""", "bars_brand macro_series")
def _(t):
    return FE.relative_strength(t.bars_brand, t.macro_series.where("symbol = 'SPY'")).select("ticker", "d", *r4("rel_strength"))


@query("beta_60d", "A20 J9", """
select ticker, count(*) as n, round(case when count(*)<20 then 1 else covar_samp(ret,mkt)/(var_pop(mkt)+1e-10) end,4) as beta from (
 select b.ticker, b.ret, m.mkt, row_number() over (partition by b.ticker order by b.d desc) as k
 from (select ticker, d, close/lag(close) over (partition by ticker order by d)-1 as ret from bars) b
 join (select d, close/lag(close) over (order by d)-1 as mkt from macro_series where symbol='SPY') m on b.d=m.d
 where b.ret is not null and m.mkt is not null) where k<=60 group by ticker""", "bars macro_series")
def _(t):
    return FE.beta_60d(t.bars, t.macro_series.where("symbol = 'SPY'")).select("ticker", "n", *r4("beta"))


MAC = ["vix", "vix_5d_change", "spy_3m", "credit", "yc", "vol_regime"]


@query("macro_signals", "S3 W-M1", f"select d, {sr(MAC)} from macro", "macro")
def _(t):
    return RG.macro_signals(t.macro_series).select("d", *r4(*MAC))


_PTS = REGIME_SQL.format(vix="vix", spy="spy_3m", cr="credit", yc="yc", vr="vol_regime")


@query("regime_rule", "P9", f"select d, cast(pts as double) as points, {regime_label('pts')} as regime from (select d, {_PTS} as pts from macro)", "macro")
def _(t):
    a = ("vix", "spy_3m", "credit", "yc", "vol_regime")
    return RG.macro_signals(t.macro_series).select("d", X.regime_points(*a).alias("points"), X.regime_rule(*a).alias("regime"))


@query("macro_score", "P11", """
select d, (case when spy_3m>0 and vix<20 then 1 else -1 end)+(case when credit>0 then 1 else -1 end) as macro_score,
 case when spy_3m>0 and vix<20 and credit>0 then 'risk_on' when not (spy_3m>0 and vix<20) then 'risk_off' else 'neutral' end as regime from macro""", "macro")
def _(t):
    return RG.macro_signals(t.macro_series).select(
        "d", X.macro_score("spy_3m", "vix", "credit").alias("macro_score"), X.regime3("spy_3m", "vix", "credit").alias("regime"))


@query("regime_series", "W-M2", "select d, round(vix,4) as vix, round(spy_ret_3m,4) as spy_ret_3m, round(vol_regime,4) as vol_regime, regime from regimes", "regimes")
def _(t):
    return RG.regime_series(t.macro_series).select("d", *r4("vix", "spy_ret_3m", "vol_regime"), "regime")


@query("trend_votes", "P10", f"""
select d, trend_score, chop_score, trend_score>chop_score as is_trending,
 case when trend_score>chop_score then 12 else 6 end as top_n_adj, case when trend_score>chop_score then 0.0 else 0.5 end as min_score
from (select d, (case when vix<22 then 1 else 0 end)+(case when spy_3m>2 then 1 else 0 end)+(case when vol_regime<0.8 then 1 else 0 end)+(case when regime='risk_on' then 1 else 0 end) as trend_score,
 (case when vix>=22 then 1 else 0 end)+(case when vix_5d_change>15 then 1 else 0 end)+(case when spy_3m<-3 then 1 else 0 end)+(case when vol_regime>1.3 then 1 else 0 end)+(case when regime in ('crisis','risk_off') then 2 else 0 end) as chop_score
 from (select *, {regime_label(_PTS)} as regime from macro))""", "macro")
def _(t):
    m = RG.macro_signals(t.macro_series)
    m = m.withColumn("regime", X.regime_rule("vix", "spy_3m", "credit", "yc", "vol_regime"))
    return RG.trend_votes(m).select("d", "trend_score", "chop_score", "is_trending", "top_n_adj", "min_score")


# centres of four groups: the farthest date four times, then thirty rounds, in which settled centres stay
_FAR = "list_min(list_transform({0}, lambda m: pow(p.vix-m[1],2)+pow(p.spy_3m-m[2],2)+pow(p.credit-m[3],2)+pow(p.vol_regime-m[4],2)))"
_CENTRES = f"""
centres as (with recursive c as (
 select 1 as k, [[vix, spy_3m, credit, vol_regime]] as ms from macro where d=(select min(d) from macro)
 union all select c.k+1, list_append(c.ms, p.m) from c cross join lateral (
  select [p.vix, p.spy_3m, p.credit, p.vol_regime] as m from macro p order by {_FAR.format('c.ms')} desc, p.d limit 1) p where c.k<4),
 start as (select ms from c where k=4),
 r as (select 0 as it, j as centre, (select ms from start)[j+1] as m from (select unnest(range(4)) as j)
 union all select r.it+1, r.centre, coalesce(g.m, r.m) from r left join (
  select centre, [avg(vix), avg(spy_3m), avg(credit), avg(vol_regime)] as m from (
   select p.d, p.vix, p.spy_3m, p.credit, p.vol_regime, arg_min(q.centre, [pow(p.vix-q.m[1],2)+pow(p.spy_3m-q.m[2],2)+pow(p.credit-q.m[3],2)+pow(p.vol_regime-q.m[4],2), q.centre]) as centre
   from macro p cross join r q group by all) group by centre) g on g.centre=r.centre where r.it<30)
 select centre, m[1] as vix, m[2] as spy_3m, m[3] as credit, m[4] as vol_regime from r where it=30),
near as (select p.d, arg_min(q.centre, [pow(p.vix-q.vix,2)+pow(p.spy_3m-q.spy_3m,2)+pow(p.credit-q.credit,2)+pow(p.vol_regime-q.vol_regime,2), q.centre]) as centre from macro p cross join centres q group by p.d),
labelled as (select *, {regime_label(REGIME_SQL.format(vix='vix', spy='spy_3m', cr='credit', yc='0.0', vr='vol_regime'))} as regime from centres)"""


@query("regime_centres", "W-M3", f", {_CENTRES} select l.centre, {sr(['vix', 'spy_3m', 'credit', 'vol_regime'])}, (select count(*) from near n where n.centre=l.centre) as n, regime from labelled l", "macro")
def _(t):
    g = RG.regime_groups(materialize(RG.snapshots(RG.macro_signals(t.macro_series)), "snapshots"))
    return g.select("centre", *r4("vix", "spy_3m", "credit", "vol_regime"), "n", "regime")


@query("detect_regime", "W-M3", f""", {_CENTRES},
 rules as (select d, {regime_label(_PTS)} as rule from macro),
 five as (select * from rules order by d desc limit 5),
 vote as (select rule from five group by rule order by count(*) desc, min(d) limit 1)
select d, rule as rule_regime, regime as ml_regime, case when rule=regime then rule else (select rule from vote) end as regime
from rules join near using (d) join labelled using (centre) where d=(select max(d) from macro)""", "macro")
def _(t):
    return RG.detect_regime(RG.macro_signals(t.macro_series))


@query("cash_buffer", "P22", """
select d, round(greatest(0.0, least(0.30, (case regime when 'crisis' then 0.20 when 'risk_off' then 0.10 when 'risk_on' then 0.02 else 0.05 end)+greatest(0,(vol_regime-1)*0.10))),6) as cash from regimes""", "regimes")
def _(t):
    return RG.regime_series(t.macro_series).select("d", F.round(X.cash_buffer("vol_regime", "regime"), 6).alias("cash"))
