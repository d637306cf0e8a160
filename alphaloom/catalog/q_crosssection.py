"""Panel, normalisation, score and selection queries."""

from pyspark.sql import functions as F

from alphaloom import params as P
from alphaloom.catalog import shared as S
from alphaloom.catalog.base import query
from alphaloom.operators import crosssection as CS
from alphaloom.operators import regime as RG
from alphaloom.operators import trading_calendar as TC
from alphaloom.operators.features import daily_returns
from alphaloom.operators.scale import grouped_percentiles
from alphaloom.plans import panel as PN


@query("rebalance_calendar", "K5 P8", "select k, reb_d, idx from reb", "reb")
def _(t):
    return TC.rebalance_calendar(TC.trading_days(t.calm), 21).select("k", "reb_d", "idx")


@query("pit_universe", "P4", """
select e.k, e.reb_d, e.ticker, e.n, round(e.adv,4) as adv from eligible e""", "eligible")
def _(t):
    return PN.pit_universe(t.calm, S.TEST_PARAMS).select("k", "reb_d", "ticker", "n", F.round("adv", 4).alias("adv"))


@query("winsorized_zscore", "W-X1 W-X2", """
select d, ticker, round(v,4) as winsorized, round((v-avg(v) over (partition by d))/(stddev_pop(v) over (partition by d)+1e-6),4) as z from (
 select d, ticker, greatest(lo,least(hi,close)) as v from (
  select *, quantile_cont(close,0.025) over (partition by d) as lo, quantile_cont(close,0.975) over (partition by d) as hi from calm))""", "calm")
def _(t):
    return CS.winsorized_zscore(t.calm.select("d", "ticker", "close"), ["d"], "close").select("d", "ticker", F.round("close", 4).alias("winsorized"), F.round("z", 4).alias("z"))


@query("cross_section_percentiles", "W-X1", """
select d, round(quantile_cont(close,0.025),4) as p025, round(median(close),4) as p50, round(quantile_cont(close,0.975),4) as p975 from calm group by d""", "calm")
def _(t):
    p = grouped_percentiles(t.calm, ["d"], "close", {"p025": 0.025, "p50": 0.5, "p975": 0.975})
    return p.select("d", *[F.round(c, 4).alias(c) for c in ("p025", "p50", "p975")])


@query("line_price_percentiles", "W-X1", """
select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice,0.025),6) as p025, round(quantile_cont(l_extendedprice,0.5),6) as p50, round(quantile_cont(l_extendedprice,0.975),6) as p975 from lineitem group by l_returnflag""")
def _(t):
    """Exact quantiles of groups that hold a third of all rows each."""
    li = t.spark.read.parquet(f"{t.root}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    p = grouped_percentiles(li, ["l_returnflag"], "v", {"p025": 0.025, "p50": 0.5, "p975": 0.975})
    n = li.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return p.join(n, "l_returnflag").select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("p025", "p50", "p975")])


@query("sector_neutral_zscore", "W-X3", """
select k, ticker, round((v-avg(v) over (partition by k))/(stddev_pop(v) over (partition by k)+1e-6),4) as z from (
 select k, ticker, greatest(quantile_cont(a,0.025) over (partition by k), least(quantile_cont(a,0.975) over (partition by k), a)) as v from (
  select k, ticker, case when count(*) over w>=2 then (ret_3m-avg(ret_3m) over w)/(stddev_pop(ret_3m) over w+1e-6) else ret_3m end as a
  from panel window w as (partition by k, sector)))""", "panel")
def _(t):
    p = S.panel(t).select("k", "ticker", "sector", F.col("ret_3m").alias("value"))
    return CS.sector_neutral_zscore(p, ["k"]).select("k", "ticker", F.round("z", 4).alias("z"))


@query("normalized_features", "W-X4 P13", "select k, ticker, factor, round(z,4) as z from zf", "zf")
def _(t):
    return S.zscores(t).select("k", "ticker", "factor", F.round("z", 4).alias("z"))


@query("score_components", "P13", """
select z.k, z.ticker, z.factor, round(w.weight*greatest(-3,least(3,z.z)),4) as contribution
from zf z join panel p on z.k=p.k and z.ticker=p.ticker join w_long w on w.regime=p.regime and w.factor=z.factor""", "zf panel w_long")
def _(t):
    z, _s = S.scored(t)
    return CS.score_components(z, ["k"], P.LONG_TERM_WEIGHTS).select("k", "ticker", "factor", F.round("contribution", 4).alias("contribution"))


@query("long_term_signal", "P14 W-X5", "select k, ticker, round(score,4) as score, round(cs_score,4) as cs_score from cs_long", "cs_long")
def _(t):
    _z, s = S.scored(t)
    return s.select("k", "ticker", F.round("score", 4).alias("score"), F.round("cs_score", 4).alias("cs_score"))


@query("swing_signal", "P15", "select k, ticker, round(score,4) as score from score_swing", "score_swing")
def _(t):
    return CS.swing_scores(S.normalized(t), S.panel(t), ["k"]).select("k", "ticker", F.round("score", 4).alias("score"))


@query("top_picks", "K1", "select k, ticker, rn, round(cs_score,4) as cs_score from top_long", "top_long")
def _(t):
    _z, s = S.scored(t)
    return CS.select_top(s, ["k"], 10, "cs_score").select("k", "ticker", "rn", F.round("cs_score", 4).alias("cs_score"))


@query("turnover_penalty", "P16", """
select s.k, s.ticker, round(s.score - case when p.k is not null and h.ticker is null then 0.0025 else 0 end,4) as score
from score_long s left join (select distinct k+1 as k from top_long) p on p.k=s.k
left join (select k+1 as k, ticker from top_long) h on h.k=s.k and h.ticker=s.ticker""", "top_long")
def _(t):
    _z, s = S.scored(t)
    prev = CS.select_top(s, ["k"], 10, "cs_score").select((F.col("k") + 1).alias("k"), "ticker", F.lit(0.1).alias("prev_weight"))
    return CS.turnover_penalty(s.select("k", "ticker", "score"), prev, ["k"]).select("k", "ticker", F.round("score", 4).alias("score"))


@query("trend_filtered_picks", "P10", f"""
select k, ticker, rn from (select p.*, coalesce(v.tr, true) as tr, row_number() over (partition by p.k order by rn) as q from (
  select t.k, t.ticker, t.rn, t.cs_score, r.reb_d from top_long t join reb r on t.k=r.k) p
 left join (select d, trend>chop as tr from (select d,
  (case when vix<22 then 1 else 0 end)+(case when spy_ret_3m>2 then 1 else 0 end)+(case when vol_regime<0.8 then 1 else 0 end)+(case when regime='risk_on' then 1 else 0 end) as trend,
  (case when vix>=22 then 1 else 0 end)+(case when spy_ret_3m<-3 then 1 else 0 end)+(case when vol_regime>1.3 then 1 else 0 end)+(case when regime in ('crisis','risk_off') then 2 else 0 end) as chop from regimes)) v
 on v.d=p.reb_d where coalesce(v.tr,true) or p.cs_score>=0.5) where tr or q<=6""", "top_long reb regimes")
def _(t):
    _z, s = S.scored(t)
    picks = CS.select_top(s, ["k"], 10, "cs_score").select("k", F.col("reb_d").alias("d"), "ticker", F.col("cs_score").alias("score"), "rn")
    m = S.regimes(t).select("d", "vix", F.lit(0.0).alias("vix_5d_change"), F.col("spy_ret_3m").alias("spy_3m"), "vol_regime", "regime")
    return RG.apply_trend_filter(picks, RG.trend_votes(m)).select("k", "ticker", "rn")


@query("momentum_strategy_performance", "K1 A1 W-E1", """
select count(*) as n_days, round(avg(ret)/(stddev_pop(ret)+1e-10)*sqrt(252),4) as sharpe, round(exp(sum(ln(1+ret)))-1,4) as total_return from (
 select c.d, avg(c.ret) as ret from (select ticker, d, close/lag(close) over (partition by ticker order by d)-1 as ret from calm) c
 join cal x on x.d=c.d
 join (select k, ticker from (select p.k, p.ticker, row_number() over (partition by p.k order by z desc, p.ticker) as rn from (
   select k, ticker, (ret_3m-avg(ret_3m) over (partition by k))/(stddev_pop(ret_3m) over (partition by k)+1e-6)
    - 0.5*(vol-avg(vol) over (partition by k))/(stddev_pop(vol) over (partition by k)+1e-6) as z from eligible) p) where rn<=10) t
 on t.ticker=c.ticker and t.k=(x.idx-100)//21 where x.idx>=100 and c.ret is not null group by c.d)""", "eligible cal calm")
def _(t):
    """3-month momentum less volatility, top ten, equal weight: the flagship."""
    u = PN.pit_universe(t.calm, S.TEST_PARAMS).select("k", "ticker", "ret_3m", "vol")
    u = CS.zscore(CS.zscore(u, ["k"], "ret_3m", "zm"), ["k"], "vol", "zv")
    picks = CS.select_top(u.withColumn("score", F.col("zm") - 0.5 * F.col("zv")), ["k"], 10).select("k", "ticker")
    days = TC.trading_days(t.calm).where("idx >= 100").select("d", F.floor((F.col("idx") - 100) / 21).cast("int").alias("k"))
    r = daily_returns(t.calm).where("ret is not null").select("ticker", "d", "ret").join(days, "d")
    daily = r.join(picks, ["k", "ticker"]).groupBy("d").agg(F.avg("ret").alias("ret"))
    return daily.agg(F.count("*").alias("n_days"),
                     F.round(F.avg("ret") / (F.stddev_pop("ret") + 1e-10) * (252 ** 0.5), 4).alias("sharpe"),
                     F.round(F.exp(F.sum(F.log1p("ret"))) - 1, 4).alias("total_return"))
