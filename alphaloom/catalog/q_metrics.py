"""Curves, performance statistics and IC monitoring queries."""

from pyspark.sql import functions as F

from alphaloom import params as P
from alphaloom.catalog import shared as S
from alphaloom.catalog.base import query
from alphaloom.catalog.ctes import cte, score_sql
from alphaloom.operators import asof as A
from alphaloom.operators import ic as IC
from alphaloom.operators import metrics as M
from alphaloom.plans import panel as PN

cte("eqc", "select series_id, d, ret, exp(sum(ln(1+ret)) over (partition by series_id order by d)) as value from curves", "curves")
cte("ddc", "select *, (value-max(value) over w)/(max(value) over w+1e-10) as drawdown, value/lag(value) over w-1 as r from eqc window w as (partition by series_id order by d)", "eqc")


def r(cols, k=4):
    return [F.round(c, k).alias(c) for c in cols]


@query("equity_curves", "W-E1", "select series_id, d, round(value,4) as value from eqc", "eqc")
def _(t):
    return M.equity_curve(t.curves).select("series_id", "d", *r(["value"]))


@query("drawdown_series", "W-E2", "select series_id, d, round(drawdown,4) as drawdown from ddc", "ddc")
def _(t):
    return M.drawdowns(M.equity_curve(t.curves)).select("series_id", "d", *r(["drawdown"]))


@query("rolling_sharpe", "W-E3", """
select series_id, d, round(case when count(ret) over w>=20 then avg(ret) over w/stddev_samp(ret) over w*sqrt(252) end,4) as rolling_sharpe
from curves window w as (partition by series_id order by d rows between 19 preceding and current row)""", "curves")
def _(t):
    return M.rolling_sharpe(t.curves).select("series_id", "d", *r(["rolling_sharpe"]))


@query("drawdown_duration", "W-E4", """
select series_id, max(n) as max_dd_duration from (select series_id, g, sum(case when drawdown<0 then 1 else 0 end) as n from (
 select *, sum(case when drawdown<0 then 0 else 1 end) over (partition by series_id order by d) as g from ddc) group by series_id, g) group by series_id""", "ddc")
def _(t):
    x = M.drawdowns(M.equity_curve(t.curves))
    return M.longest_run(x, "series_id", "d", F.col("drawdown") < 0, "max_dd_duration")


@query("max_consecutive_losses", "W-E5", """
select series_id, max(n) as losses from (select series_id, g, sum(case when ret<=0 then 1 else 0 end) as n from (
 select *, sum(case when ret<=0 then 0 else 1 end) over (partition by series_id order by d) as g from curves) group by series_id, g) group by series_id""", "curves")
def _(t):
    return M.longest_run(t.curves, "series_id", "d", F.col("ret") <= 0, "losses")


PM = ["sharpe", "sortino", "calmar", "max_drawdown", "total_return", "cagr", "ann_vol", "win_rate", "avg_win", "avg_loss", "profit_factor"]


@query("performance_metrics", "A1", f"""
select series_id, n, {', '.join(f'round({c},4) as {c}' for c in PM)}, max_dd_duration from (
 select *, mu/sig*sqrt(252) as sharpe, mu/down*sqrt(252) as sortino, cagr/(abs(max_drawdown)+1e-10) as calmar, sig*sqrt(252) as ann_vol, abs(avg_win)/(abs(avg_loss)+1e-10) as profit_factor from (
 select *, pow(1+total_return, 1.0/greatest(n/252.0,0.01))-1 as cagr from (
 select series_id, count(*) as n, avg(r) as mu, stddev_pop(r)+1e-10 as sig, coalesce(stddev_samp(case when r<0 then r end),0)+1e-10 as down,
  min(drawdown) as max_drawdown, arg_max(value,d)/arg_min(value,d)-1 as total_return, avg(case when r>0 then 1.0 when r is not null then 0.0 end) as win_rate,
  coalesce(avg(case when r>0 then r end),0) as avg_win, coalesce(avg(case when r<0 then r end),0) as avg_loss from ddc group by series_id having count(*)>=10)))
join (select series_id, max(n) as max_dd_duration from (select series_id, g, sum(case when drawdown<0 then 1 else 0 end) as n from (
 select *, sum(case when drawdown<0 then 0 else 1 end) over (partition by series_id order by d) as g from ddc) group by series_id, g) group by series_id) using (series_id)""", "ddc")
def _(t):
    return M.perf_metrics(M.equity_curve(t.curves)).select("series_id", "n", *r(PM), "max_dd_duration")


BM = ["beta", "alpha_ann", "tracking_error", "info_ratio"]


@query("benchmark_metrics", "A2 J9 U4", f"""
select series_id, n_common, {', '.join(f'round({c},4) as {c}' for c in BM)} from (select series_id, n_common, beta, (p-beta*m)*252 as alpha_ann, s*sqrt(252) as tracking_error, (p-m)/(s+1e-10)*sqrt(252) as info_ratio from (
 select c.series_id, count(*) as n_common, covar_samp(c.ret,b.ret)/(var_pop(b.ret)+1e-10) as beta, avg(c.ret) as p, avg(b.ret) as m, stddev_pop(c.ret-b.ret) as s
 from curves c join (select d, avg(ret) as ret from curves group by d) b using (d) group by c.series_id having count(*)>20))""", "curves")
def _(t):
    bench = t.curves.groupBy("d").agg(F.avg("ret").alias("ret"))
    return M.benchmark_metrics(t.curves, bench).select("series_id", "n_common", *r(BM))


@query("equal_weight_index", "A3 W-E1", """
select d, round(ret,6) as ret, round(exp(sum(ln(1+ret)) over (order by d)),4) as value from (
 select d, avg(r) as ret from (select d, close/lag(close) over (partition by ticker order by d)-1 as r from calm) where r is not null group by d)""", "calm")
def _(t):
    x = M.equal_weight_returns(t.calm).withColumn("series_id", F.lit("ew"))
    return M.equity_curve(x).select("d", F.round("ret", 6).alias("ret"), *r(["value"]))


@query("equal_weight_backtest", "C15", """
select d, round(exp(sum(ln(1+ret)) over (order by d)),4) as value from (select d, ret - case when i%21=0 and i>0 then 0.001 else 0 end as ret from (
 select d, ret, row_number() over (order by d)-1 as i from (
 select d, avg(r) as ret from (select d, close/lag(close) over (partition by ticker order by d)-1 as r from calm) where r is not null group by d)))""", "calm")
def _(t):
    return M.equal_weight_backtest(t.calm).select("d", *r(["value"]))


SW = ["avg_period_return", "median_period_return", "profit_factor", "signal_to_noise", "win_rate"]


@query("swing_metrics", "A11 P17", f"""
select series_id, n_periods, {', '.join(f'round({c},4) as {c}' for c in SW)}, losses as max_consecutive_losses,
 case when n_periods<20 then format('EARLY — {{}} periods, need ≥20 swing periods to assess', n_periods)
  when round(win_rate,3)>=0.55 and round(profit_factor,3)>=1.3 then 'STRONG SWING EDGE — consider live capital at $500-$1,000'
  when round(win_rate,3)>=0.52 and round(profit_factor,3)>=1.1 then 'MODERATE EDGE — paper trade 4 more weeks before capital'
  when round(win_rate,3)>=0.50 and round(profit_factor,3)>=1.0 then 'BREAKEVEN — signal weak, review factor weights'
  else 'NO EDGE — win rate or profit factor below threshold' end as verdict
from (select series_id, count(*) as n_periods, avg(ret)*100 as avg_period_return, median(ret)*100 as median_period_return,
  coalesce(sum(case when ret>0 then ret end),0)/(abs(coalesce(sum(case when ret<0 then ret end),0))+1e-9) as profit_factor,
  avg(ret)/(stddev_pop(ret)+1e-9)*sqrt(252/5.0) as signal_to_noise, avg(case when ret>0 then 1.0 else 0.0 end) as win_rate from curves group by series_id)
join (select series_id, max(n) as losses from (select series_id, g, sum(case when ret<=0 then 1 else 0 end) as n from (
 select *, sum(case when ret<=0 then 0 else 1 end) over (partition by series_id order by d) as g from curves) group by series_id, g) group by series_id) using (series_id)""", "curves")
def _(t):
    return M.swing_metrics(t.curves).select("series_id", "n_periods", *r(SW), "max_consecutive_losses", "verdict")


cte("periods", """
select r.reb_d as d, coalesce(g.regime,'neutral') as regime, p.period_return from reb r join (
 select k, exp(sum(ln(1+ret)))-1 as period_return from (select d, avg(ret) as ret from curves group by d) c
 join (select d, (idx-100)//21 as k from cal where idx>=100) x using (d) group by k) p using (k)
asof left join regimes g on r.reb_d>=g.d""", "reb curves cal regimes")


def _periods(t):
    """Equal-weight return of every rebalance period with its regime."""
    from alphaloom.operators import trading_calendar as TC
    from alphaloom.operators.regime import with_regime_asof
    days = TC.trading_days(t.calm)
    reb = TC.rebalance_calendar(days, 21).select("k", F.col("reb_d").alias("d"))
    ks = days.where("idx >= 100").select("d", F.floor((F.col("idx") - 100) / 21).cast("int").alias("k"))
    pr = (t.curves.groupBy("d").agg(F.avg("ret").alias("ret")).join(ks, "d")
          .groupBy("k").agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("period_return")))
    return with_regime_asof(reb, S.regimes(t)).join(pr, "k")


@query("regime_breakdown", "A5", """
select coalesce(regime,'all') as regime, count(*) as n, round(avg(period_return),6) as avg_return, round(avg(case when period_return>0 then 1.0 else 0.0 end),4) as hit_rate
from periods group by rollup(regime)""", "periods")
def _(t):
    return M.by_regime(_periods(t)).select("regime", "n", F.round("avg_return", 6).alias("avg_return"), *r(["hit_rate"]))


@query("stability_thirds", "A6", """
select period, count(*) as n, round(avg(period_return),6) as avg_return, round(avg(case when period_return>0 then 1.0 else 0.0 end),4) as hit_rate, min(d) as start_date, max(d) as end_date from (
 select *, case when i<n//3 then 'early' when i<2*n//3 then 'mid' else 'late' end as period from (select *, row_number() over (order by d)-1 as i, count(*) over () as n from periods)) group by period""", "periods")
def _(t):
    return M.stability_thirds(_periods(t)).select("period", "n", F.round("avg_return", 6).alias("avg_return"), *r(["hit_rate"]), "start_date", "end_date")


@query("nav_log", "A31", """
select p.series_id, p.d, round(sum(p.shares*coalesce(c.close,0)),4) as value from (select ticker%5 as series_id, ticker, d, volume as shares from bars) p
left join calm c on c.ticker=p.ticker and c.d=p.d group by p.series_id, p.d""", "bars calm")
def _(t):
    pos = t.bars.select((F.col("ticker") % 5).alias("series_id"), "ticker", "d", F.col("volume").alias("shares"))
    return M.nav_log(pos, t.calm).select("series_id", "d", *r(["value"]))


@query("capacity_curve", "A36 J21", f"""
select series_id, aum, round(cost*100,4) as cost_frac_pct, round((a-cost/252)*252,4) as net_alpha_ann, round((a-cost/252)/(s+1e-9)*sqrt(252),4) as adj_sharpe, a-cost/252>0 as viable
from (select *, c*sqrt(aum/1e5) as cost from (select series_id, avg(ret) as a, stddev_samp(ret) as s, 0.001+(series_id%10)*0.0137 as c from curves group by series_id)
 cross join (select unnest([{', '.join(f'cast({a} as double)' for a in P.AUM_LEVELS)}]) as aum))""", "curves")
def _(t):
    return _capacity(t).select("series_id", "aum", *r(["cost_frac_pct", "net_alpha_ann", "adj_sharpe"]), "viable")


def _capacity(t):
    a = t.curves.groupBy("series_id").agg(F.avg("ret").alias("alpha_daily"), F.stddev_samp("ret").alias("ret_std"))
    a = a.withColumn("cost_frac", 0.001 + (F.col("series_id") % 10) * 0.0137)
    return M.capacity_curve(a, list(P.AUM_LEVELS))


@query("capacity_limit", "A36", f"""
select series_id, coalesce(max(case when a-c*sqrt(aum/1e5)/252>0 then aum end),0) as capacity_limit
from (select series_id, avg(ret) as a, 0.001+(series_id%10)*0.0137 as c from curves group by series_id)
 cross join (select unnest([{', '.join(f'cast({a} as double)' for a in P.AUM_LEVELS)}]) as aum) group by series_id""", "curves")
def _(t):
    return M.capacity_limit(_capacity(t))


# ---- information coefficients ----
cte("ic24", "select factor, d, ic, age from (select *, row_number() over (partition by factor order by d desc)-1 as age from ic) where age<24", "ic")
SCALE = "case when {n}<4 then 1 when {m}/({s}+1e-6)<-0.3 then 0 else greatest(0.1,least(2.5,1+{m}/({s}+1e-6))) end"
cte("icscale", f"""
select factor, n, {SCALE.format(n='n', m='m', s='sqrt(greatest(v-m*m,0))')} as scale from (
 select factor, count(*) as n, sum(w*ic)/sum(w) as m, sum(w*ic*ic)/sum(w) as v from (select *, pow(2.0,-age/12.0) as w from ic24) group by factor)""", "ic24")
cte("icsum", "select factor, avg(ic) as mean_ic, avg(ic)/(stddev_pop(ic)+1e-6) as ic_ir, avg(case when ic>0 then 1.0 else 0.0 end) as hit_rate, count(*) as n from ic24 group by factor", "ic24")


@query("ic_scale", "W-I2", "select factor, n, round(scale,6) as scale from icscale", "icscale")
def _(t):
    return IC.ic_scale(t.ic).select("factor", "n", F.round("scale", 6).alias("scale"))


@query("ic_scale_history", "W-I2", f"""
select factor, d, round({SCALE.format(n='n', m='m', s='sqrt(greatest(v-m*m,0))')},6) as scale from (
 select a.factor, a.d, count(*) as n, sum(pow(2.0,-(a.i-b.i)/12.0)*b.ic)/sum(pow(2.0,-(a.i-b.i)/12.0)) as m, sum(pow(2.0,-(a.i-b.i)/12.0)*b.ic*b.ic)/sum(pow(2.0,-(a.i-b.i)/12.0)) as v
 from (select *, row_number() over (partition by factor order by d) as i from ic) a join (select *, row_number() over (partition by factor order by d) as i from ic) b on a.factor=b.factor and b.i between a.i-23 and a.i group by a.factor, a.d)""", "ic")
def _(t):
    return IC.ic_scale_history(t.ic).select("factor", "d", F.round("scale", 6).alias("scale"))


@query("ic_summary", "A9 K3", "select factor, round(mean_ic,4) as mean_ic, round(ic_ir,4) as ic_ir, round(hit_rate,4) as hit_rate, n, round(scale,4) as current_scale from icsum join (select factor, scale from icscale) using (factor)", "icsum icscale")
def _(t):
    return IC.ic_summary(t.ic).select("factor", *r(["mean_ic", "ic_ir", "hit_rate"]), "n", *r(["current_scale"]))


@query("factor_stability", "A28", """
select factor, round(m/(m+s+1e-6),4) as stability, case when late>early+0.01 then 'improving' when late<early-0.01 then 'degrading' else 'stable' end as trend from (
 select factor, abs(avg(ic)) as m, stddev_pop(ic) as s, avg(case when 11-age<6 then ic end) as early, avg(case when 11-age>=6 then ic end) as late from ic24 where age<12 group by factor)""", "ic24")
def _(t):
    return IC.factor_stability(t.ic).select("factor", *r(["stability"]), "trend")


@query("factor_redundancy", "J15", """
select f1, f2, round(c,4) as corr, case when i1.ic_ir<i2.ic_ir then f1 else f2 end as disabled from (
 select a.factor as f1, b.factor as f2, corr(a.ic,b.ic) as c, count(*) as n from (select *, row_number() over (partition by factor order by d desc) as age from ic) a
 join (select *, row_number() over (partition by factor order by d desc) as age from ic) b on a.age=b.age and a.factor<b.factor group by 1,2) p
join icsum i1 on i1.factor=f1 join icsum i2 on i2.factor=f2 where p.n>=6 and abs(c)>0.15""", "ic icsum")
def _(t):
    return IC.redundancy(t.ic, IC.ic_summary(t.ic), threshold=0.15).select("f1", "f2", *r(["corr"]), "disabled")


@query("factor_health", "W-I4 UD3", """
, ev as (select factor, d, row_number() over (partition by factor order by d) as i, avg(ic) over w/(stddev_pop(ic) over w+1e-6) as ir, count(*) over w as n from ic
 window w as (partition by factor order by d rows between 5 preceding and current row)),
 q as (select *, row_number() over (partition by factor order by d) as j from ev where n>=6)
select factor, d, fails, off as disabled from (
 with recursive st as (
  select factor, d, j, case when ir<0.1 then 1 else 0 end as fails, false as off from q where j=1
  union all
  select q.factor, q.d, q.j, case when q.ir<0.1 then st.fails+1 else greatest(0,st.fails-1) end,
   case when (case when q.ir<0.1 then st.fails+1 else greatest(0,st.fails-1) end)>=3 then true when q.ir>0.15 then false else st.off end
  from st join q on q.factor=st.factor and q.j=st.j+1)
 select * from st)""", "ic")
def _(t):
    from pyspark.sql import Window as W
    fr = W.partitionBy("factor").orderBy("d").rowsBetween(-5, 0)
    ev = t.ic.select("factor", "d", (F.avg("ic").over(fr) / (F.stddev_pop("ic").over(fr) + 1e-6)).alias("ic_ir"), F.count("*").over(fr).alias("n"))
    return IC.factor_health(ev)


cte("fwd", """
select s.k, s.ticker, round(b.close/a.close-1,6) as fwd_return from (select k, ticker, reb_d from score_long join reb using (k) where reb_d + 21 <= date '2001-11-04') s
asof join calm a on a.ticker=s.ticker and a.d>=s.reb_d asof join calm b on b.ticker=s.ticker and b.d>=s.reb_d + 21""", "score_long reb calm")


def _fwd(t):
    def make():
        from alphaloom.sources.storage import materialize
        _z, s = S.scored(t)
        sig = IC.log_signals(s.select(F.col("reb_d").alias("d"), "ticker", "score", "regime"), 10)
        return materialize(A.fill_returns(sig, t.calm, F.lit("2001-11-04").cast("date"))
                           .join(s.select("k", "ticker", F.col("reb_d").alias("signal_date")), ["ticker", "signal_date"]), "fwd")
    return S.memo(t, "fwd", make)


def forward(t):
    """(k, ticker, fwd_return, closed) of all names with z-scores."""
    def make():
        from alphaloom.sources.storage import materialize
        names = S.normalized(t).select("k", "ticker", "reb_d")
        sig = names.select("k", "ticker", F.col("reb_d").alias("signal_date"), F.date_add("reb_d", 21).alias("fwd_due_date"))
        return materialize(A.fill_returns(sig, t.calm, F.lit("2001-11-04").cast("date"), "closed").select("k", "ticker", "fwd_return", "closed"), "forward")
    return S.memo(t, "forward", make)


cte("icf", """
select k, factor, round(corr(rx,ry),12) as ic from (select k, factor, rank() over (partition by k, factor order by z) + (count(*) over (partition by k, factor, z)-1)/2.0 as rx,
  rank() over (partition by k, factor order by fwd_return) + (count(*) over (partition by k, factor, fwd_return)-1)/2.0 as ry, z, fwd_return from zf join fwd using (k, ticker))
group by k, factor having count(*)>=5 and stddev_pop(z)>=1e-10 and stddev_pop(fwd_return)>=1e-10""", "zf fwd")


@query("factor_ic", "W-I1", "select k, factor, round(ic,4) as ic from icf", "icf")
def _(t):
    return IC.factor_ic(S.normalized(t), forward(t), ["k"]).select("k", "factor", *r(["ic"]))


# scales known at a rebalance: of the rebalances whose last forward price is older, the last 24
cte("icknown", """
select factor, k, ic, known from icf join (select s.k, max(b.d) as known from (select k, ticker, reb_d from score_long join reb using (k) where reb_d + 21 <= date '2001-11-04') s
 asof join calm b on b.ticker=s.ticker and b.d>=s.reb_d + 21 group by s.k) using (k)""", "icf score_long reb calm")
cte("kscale", f"""
select p.k, p.factor, {SCALE.format(n='coalesce(n,0)', m='m', s='sqrt(greatest(v-m*m,0))')} as scale from (select distinct k, factor from zf) p left join (
 select k, factor, count(*) as n, sum(w*ic)/sum(w) as m, sum(w*ic*ic)/sum(w) as v from (select *, pow(2.0,-age/12.0) as w from (
  select r.k, o.factor, o.ic, row_number() over (partition by r.k, o.factor order by o.k desc)-1 as age from reb r join icknown o on o.known<r.reb_d) where age<24) group by k, factor) h using (k, factor)""", "zf icknown reb")
cte("score_scaled", score_sql("w_long", P.LONG_TERM_ADJUST, P.LONG_TERM_CRISIS, P.LONG_TERM_VOL, "kscale"), "zf panel w_long kscale")


def _scales(t):
    def make():
        return PN.ic_scales(S.normalized(t), S.panel(t), forward(t), S.TEST_PARAMS)
    return S.memo(t, "scales", make)


def scaled_scores(t):
    def make():
        from alphaloom.sources.storage import materialize
        return materialize(PN.scores(S.normalized(t), S.panel(t), "longterm", _scales(t)), "scores")
    return S.memo(t, "scores_scaled", make)


@query("ic_scale_known", "W-I2 C14", "select k, factor, round(scale,4) as scale from kscale", "kscale")
def _(t):
    return _scales(t).select("k", "factor", *r(["scale"]))


@query("long_term_signal_ic_scaled", "P14 W-I2", "select k, ticker, round(score,4) as score from score_scaled", "score_scaled")
def _(t):
    return scaled_scores(t).select("k", "ticker", *r(["score"]))


@query("factor_rank_turnover", "W-I3", """
select k, round(case when rho is null then 0.5 else greatest(0,least(1,1-rho)) end,4) as turnover from (select distinct k from score_long) left join (
 select k, case when count(*)>=5 then corr(rx,ry) end as rho from (select k, rank() over (partition by k order by score) as rx, rank() over (partition by k order by prev) as ry from (
  select s.k, s.score, p.score as prev from score_long s join score_long p on p.k+1=s.k and p.ticker=s.ticker)) group by k) using (k)""", "score_long")
def _(t):
    _z, s = S.scored(t)
    return IC.rank_turnover(s.select(F.lit("m").alias("strategy"), "k", "ticker", "score"), ["strategy"]).select("k", *r(["turnover"]))


_LIVE = """
, sc as (select k, ticker, round(score,5) as score, row_number() over (partition by k order by score desc, ticker)<=10 as pick from score_long),
 per as (select k, case when count(*)>=5 then round(corr(rx,ry),4) end as ic, avg(case when pick then fwd_return end)>median(fwd_return) as beats, max(regime) as regime from (
  select s.k, s.pick, f.fwd_return, p.regime, rank() over (partition by s.k order by s.score) + (count(*) over (partition by s.k, s.score)-1)/2.0 as rx,
   rank() over (partition by s.k order by f.fwd_return) + (count(*) over (partition by s.k, f.fwd_return)-1)/2.0 as ry from sc s join fwd f using (k, ticker) join panel p using (k, ticker)) group by k)"""
_LIVE_AGG = """count(*) as n_filled, round(avg(ic),4) as mean_ic, round(stddev_pop(ic)+1e-9,4) as ic_std, round(avg(case when ic>0 then 1.0 else 0.0 end),4) as hit_rate, arg_max(ic,k) as latest_ic, round(avg(case when beats then 1.0 else 0.0 end),4) as top_pick_accuracy"""
_LR = ["mean_ic", "ic_std", "hit_rate", "latest_ic", "top_pick_accuracy"]


@query("live_ic_report", "A10 P17", _LIVE + f"""
select *, case when n_filled<12 then format('WAIT — need {{}} more periods before assessment', 12-n_filled)
 when mean_ic>0.05 and mean_ic/ic_std>0.5 and hit_rate>0.55 then 'DEPLOY — strong signal quality, proceed to live capital'
 when mean_ic>0.02 and mean_ic/ic_std>0.25 then 'PAPER — signal exists but needs more history before capital'
 when mean_ic>0 and hit_rate>0.5 then 'MONITOR — weak positive IC, watch for 3 more months'
 when mean_ic<=0 then 'NO ALPHA — signal has negative IC, do not deploy capital' else 'UNCERTAIN — insufficient evidence either way' end as verdict
from (select {_LIVE_AGG} from per where ic is not null)""", "score_long fwd panel")
def _(t):
    return IC.live_ic_report(IC.live_ic(_fwd(t))).select("n_filled", *r(_LR), "verdict")


@query("live_ic_by_regime", "A10 A5", _LIVE + f" select regime, {_LIVE_AGG} from per where ic is not null group by regime", "score_long fwd panel")
def _(t):
    return IC.live_ic_report(IC.live_ic(_fwd(t)), "regime").select("regime", "n_filled", *r(_LR))


@query("ic_hurdle", "P23", """
select factor, round(t*10/10000*12*2,6) as hurdle, round(ic_ir-t*10/10000*12*2,6) as net_ic_ir, ic_ir-t*10/10000*12*2>0 as passes from (select *, 1-hit_rate as t from icsum)""", "icsum")
def _(t):
    from alphaloom.functions.expr import ic_hurdle
    h, net = ic_hurdle("ic_ir", 1 - F.col("hit_rate"))
    return IC.ic_summary(t.ic).select("factor", F.round(h, 6).alias("hurdle"), F.round(net, 6).alias("net_ic_ir"), (net > 0).alias("passes"))
