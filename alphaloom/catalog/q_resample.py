"""Bootstrap, placebo and significance queries."""

from pyspark.sql import functions as F

from alphaloom.catalog import shared as S
from alphaloom.catalog.base import query
from alphaloom.catalog.ctes import cte
from alphaloom.operators import metrics as M
from alphaloom.operators import resample as RS
from alphaloom.sources.storage import materialize


def r(cols, k=4):
    return [F.round(c, k).alias(c) for c in cols]


SIMS = 500
cte("ewr", "select d, ret, row_number() over (order by d)-1 as i, count(*) over () as n from (select d, avg(r) as ret from (select d, close/lag(close) over (partition by ticker order by d)-1 as r from calm) where r is not null group by d)", "calm")
cte("boot", f"""
select sim, p, n, e.ret from (select *, (((((42*611953+sim*1000003+(p//21)*7919)%2147483647)*48271)%2147483647)*69621)%2147483647%(n-21)+p%21 as src from (
 select sim, n, unnest(range(n)) as p from (select distinct n from ewr) cross join (select unnest(range({SIMS})) as sim))) b join (select i, ret from ewr) e on e.i=b.src""", "ewr")
cte("bootm", """
select sim, any_value(n) as n, avg(ret)/(stddev_pop(ret)+1e-9)*sqrt(252) as sharpe, pow(exp(sum(ln(1+ret))),1.0/greatest(any_value(n)/252.0,0.01))-1 as cagr, least(0,min(dd)) as max_drawdown from (
 select *, (v-max(v) over w)/(max(v) over w+1e-9) as dd from (select *, exp(sum(ln(1+ret)) over (partition by sim order by p)) as v from boot) window w as (partition by sim order by p)) group by sim""", "boot")


def _boot(t):
    def make():
        ew = M.equal_weight_returns(t.calm).withColumn("series_id", F.lit("ew"))
        return materialize(RS.block_bootstrap(ew, SIMS), "boot")
    return S.memo(t, "boot", make)


@query("block_bootstrap", "V1 J21", "select sim, n, round(sharpe,4) as sharpe, round(cagr,4) as cagr, round(max_drawdown,4) as max_drawdown from bootm", "bootm")
def _(t):
    return _boot(t).select("sim", "n", *r(["sharpe", "cagr", "max_drawdown"]))


BS = ["sharpe_mean", "sharpe_std", "sharpe_p5", "sharpe_p95", "cagr_mean", "cagr_p5", "maxdd_mean", "p_sharpe_gt_0", "p_sharpe_gt_1"]


@query("bootstrap_summary", "V1 P17", """
select count(*) as n_simulations, round(avg(sharpe),4) as sharpe_mean, round(stddev_pop(sharpe),4) as sharpe_std, round(quantile_cont(sharpe,0.05),4) as sharpe_p5, round(quantile_cont(sharpe,0.95),4) as sharpe_p95,
 round(avg(cagr),4) as cagr_mean, round(quantile_cont(cagr,0.05),4) as cagr_p5, round(avg(max_drawdown),4) as maxdd_mean, round(avg(case when sharpe>0 then 1.0 else 0.0 end),4) as p_sharpe_gt_0, round(avg(case when sharpe>1 then 1.0 else 0.0 end),4) as p_sharpe_gt_1,
 case when avg(case when sharpe>1 then 1.0 else 0.0 end)>0.5 then 'ROBUST: >50% of simulations produce Sharpe>1 ('||cast(round(avg(case when sharpe>1 then 1.0 else 0.0 end)*100) as int)||'%)' else 'other' end as verdict from bootm""", "bootm")
def _(t):
    x = RS.bootstrap_summary(_boot(t))
    return x.select("n_simulations", *r(BS), "verdict")


# own blocks count as simulation -1
_JOINT = f"""
, cal as (select d, row_number() over (order by d)-1 as pos from (select distinct d from curves)), size as (select count(*) as n from cal),
 used as (select series_id, count(*) as n_returns from curves group by series_id having count(*)>=60),
 grid as (select u.series_id, c.pos, coalesce(v.ret,0) as ret from used u cross join cal c left join curves v on v.series_id=u.series_id and v.d=c.d),
 run as (select series_id, pos, ret, sum(ret) over w as s, sum(ret*ret) over w as q from grid window w as (partition by series_id order by pos)),
 draws as (select sim, b, least(21, n-b*21) as len, case when sim<0 then b*21 else (((((42*611953+sim*1000003+b*7919)%2147483647)*48271)%2147483647)*69621)%2147483647%(n-21) end as start
  from (select n, sim, unnest(range((n-1)//21+1)) as b from size cross join (select unnest(range(-1,{SIMS})) as sim))),
 cuts as (select a.series_id, a.pos as start, c.len, z.s-a.s+a.ret as s, z.q-a.q+a.ret*a.ret as q
  from (select distinct start, len from draws) c join run a on a.pos=c.start join run z on z.series_id=a.series_id and z.pos=c.start+c.len-1),
 sums as (select series_id, sim, sum(s) as s, sum(q) as q, sum(s*s) as bb, sum(len*s) as lb, sum(len*len) as ll from draws join cuts using (start, len) group by series_id, sim),
 f as (select series_id, sim, s/n as mu, s/n/(sqrt(greatest(q/n-s/n*s/n,0))+1e-9)*sqrt(252) as sharpe, sqrt(greatest(bb-2*s/n*lb+s/n*s/n*ll,0))/n as err from sums cross join size),
 jt as (select f.series_id, f.sim, f.sharpe, o.sharpe as model_sharpe, case when f.err>1e-12 then (f.mu-o.mu)/f.err else 0 end as t, case when o.err>1e-12 then o.mu/o.err else 0 end as model_t
  from f join f o on o.series_id=f.series_id and o.sim=-1 where f.sim>=0),
 ranked as (select *, max(t) over (partition by sim) as best from jt),
 shares as (select series_id, count(*) as n_simulations, avg(sharpe) as sharpe_mean, stddev_pop(sharpe) as sharpe_std, max(model_sharpe) as model_sharpe, max(model_t) as model_t,
  avg(case when sharpe<=model_sharpe then 1.0 else 0.0 end) as sharpe_rank, avg(case when t>=model_t then 1.0 else 0.0 end) as p_value, avg(case when best>=model_t then 1.0 else 0.0 end) as p_family,
  avg(case when sharpe>0 then 1.0 else 0.0 end) as p_sharpe_gt_0, avg(case when sharpe>1 then 1.0 else 0.0 end) as p_sharpe_gt_1 from ranked group by series_id)
select series_id, n_returns, n_simulations, {{cols}}, case when p_sharpe_gt_1>0.5 then 'ROBUST: >50% of simulations produce Sharpe>1 ('||cast(round(p_sharpe_gt_1*100) as int)||'%)'
 when p_sharpe_gt_0>0.7 then 'ACCEPTABLE: '||cast(round(p_sharpe_gt_0*100) as int)||'% of simulations positive Sharpe' else 'FRAGILE: only '||cast(round(p_sharpe_gt_0*100) as int)||'% of simulations positive Sharpe' end as verdict
from shares join used using (series_id)"""
MODEL = ["sharpe_mean", "sharpe_std", "model_sharpe", "sharpe_rank", "model_t", "p_value", "p_family", "p_sharpe_gt_0", "p_sharpe_gt_1"]


@query("bootstrap_model_sharpe", "V1 P17", _JOINT.format(cols=", ".join(f"round({c},4) as {c}" for c in MODEL)), "curves")
def _(t):
    x = RS.model_against_resampled(materialize(RS.joint_bootstrap(t.curves, SIMS), "joint"))
    return x.select("series_id", "n_returns", "n_simulations", *r(MODEL), "verdict")


TRIALS = 50


def _placebo(t):
    def make():
        from alphaloom.operators import crosssection as CS
        from alphaloom.plans import walk_forward as WF
        p = S.panel(t)
        sc, of_all = RS.placebo_scores(p, TRIALS, best=S.TEST_PARAMS.top_n)
        z = CS.zscore(sc, ["strategy", "k"], "score", "cs_score", eps=1e-9, stats=of_all)
        bt = WF.run(z, t.calm, p.select("k", "ticker", "adv"), S.TEST_PARAMS, smooth=False, cal=S.calendar(t, S.TEST_PARAMS), of=t.calm_of)
        return materialize(RS.sharpe_sample(bt.equity), "placebo")
    return S.memo(t, "placebo", make)


_DRAW = "(((((42*611953+{0}*1000003+{1}*7919+{2}*104729)%2147483647)*48271)%2147483647)*69621%2147483647+0.5)/2147483647"


@query("placebo_draws", "V2", f"""
select 'trial'||trial as strategy, k, ticker, round(sqrt(-2*ln({_DRAW.format('trial','k','ticker')}))*cos(2*pi()*({_DRAW.format('ticker','trial','k')})),8) as score from (select k, ticker, unnest(range({TRIALS})) as trial from panel)""", "panel")
def _(t):
    return RS.placebo_scores(S.panel(t), TRIALS).select("strategy", "k", "ticker", F.round("score", 8).alias("score"))


@query("placebo_test", "V2 P17")
def _(t):
    from alphaloom.catalog.q_portfolio import _backtest
    model = RS.sharpe_sample(_backtest(t).equity).withColumnRenamed("sharpe", "model_sharpe")
    x = RS.placebo_summary(_placebo(t).select("sharpe"), model)
    return x.select("series_id", *r(["model_sharpe", "random_mean", "random_std", "random_p5", "random_p95", "p_value"]), "n_trials", "verdict")


@query("ic_t_statistics", "A26", "select factor, count(*) as n, round(avg(ic)/(stddev_samp(ic)/sqrt(count(*))),4) as t_stat, round(avg(ic)/(stddev_pop(ic)+1e-6),4) as ic_ir from ic group by factor", "ic")
def _(t):
    return RS.t_test(t.ic).select("factor", "n", *r(["t_stat", "ic_ir"]))


# Student's t with a whole number of degrees of freedom is a finite sum in the cosine of atan(t / sqrt(df))
@query("ic_significance", "A26 V3 UD4", """
, g as (select factor, count(*) as n, avg(ic)/(stddev_samp(ic)/sqrt(count(*))) as t, avg(ic)/(stddev_pop(ic)+1e-6) as ir from ic group by factor having count(*)>=6),
 a as (select *, n-1 as df, atan(abs(t)/sqrt(n-1)) as th from g),
 terms as (select factor, df, th, k, case when df%2=1 then sum(case when k<=1 then 0 else ln(2.0*(k-1)/(2*k-1)) end) over w else sum(case when k=0 then 0 else ln((2.0*k-1)/(2*k)) end) over w end as lc
  from (select *, unnest(case when df%2=1 then range(1,(df-1)//2+1) else range(0,(df-2)//2+1) end) as k from a) window w as (partition by factor order by k)),
 s as (select factor, sum(exp(lc)*pow(cos(th), case when df%2=1 then 2*k-1 else 2*k end)) as s from terms group by factor),
 p as (select a.*, 1-case when df%2=1 then 2/pi()*(th+sin(th)*coalesce(s,0)) else sin(th)*s end as p from a left join s using (factor)),
 q as (select *, row_number() over (order by p) as rk, count(*) over () as m from p)
select factor, n, round(t,4) as t_stat, round(p,4) as p_value, round(ir,4) as ic_ir, p<=coalesce((select max(rk)*1.0/max(m)*0.10 from q where p<=rk*1.0/m*0.10),0) as bh_significant from q""", "ic")
def _(t):
    return RS.factor_significance(t.ic).select("factor", "n", *r(["t_stat", "p_value", "ic_ir"]), "bh_significant")


@query("benjamini_hochberg", "A27", """
, p as (select series_id, exp(-3*abs(avg(ret)/(stddev_samp(ret)/sqrt(count(*))))) as p from curves group by series_id),
 q as (select *, row_number() over (order by p) as rk, count(*) over () as n from p)
select series_id, round(p,8) as p_value, p<=coalesce((select max(rk)*1.0/max(n)*0.05 from q where p<=rk*1.0/n*0.05),0) as bh_significant from q""", "curves")
def _(t):
    g = t.curves.groupBy("series_id").agg(F.exp(-3 * F.abs(F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("*"))))).alias("p_value"))
    return RS.benjamini_hochberg(g).select("series_id", F.round("p_value", 8).alias("p_value"), "bh_significant")


@query("validation_checklist", "A39 P17", """
select *, case when passed>=6 and live_ic_ok then '[DEPLOY] — Start with $500-$1,000 and monitor execution slippage' when passed>=5 then '[PAPER] — Strong backtest but live IC not yet validated' when passed>=3 then '[NOT READY] — Address failing checks before deploying capital' else '[DO NOT DEPLOY] — Multiple critical failures' end as verdict from (
 select *, cast(sharpe_ok as int)+cast(beats_market as int)+cast(beats_equal_weight as int)+cast(drawdown_ok as int)+cast(cagr_ok as int)+cast(placebo_ok as int)+cast(live_ic_ok as int) as passed from (
 select series_id, sharpe>1 as sharpe_ok, tr>0.5 as beats_market, tr>1 as beats_equal_weight, dd>-0.2 as drawdown_ok, pow(1+tr,1.0/greatest(n/252.0,0.01))-1>0.1 as cagr_ok, (series_id%20)/100.0<0.10 as placebo_ok, n>=12 and series_id%3<>0 as live_ic_ok from (
  select series_id, count(*) as n, avg(r)/(stddev_pop(r)+1e-10)*sqrt(252) as sharpe, arg_max(value,d)/arg_min(value,d)-1 as tr, min(drawdown) as dd from ddc group by series_id)))""", "ddc")
def _(t):
    m = M.perf_metrics(M.equity_curve(t.curves)).select(
        "series_id", "sharpe", (F.col("total_return") - 0.5).alias("excess_vs_market"), (F.col("total_return") - 1).alias("excess_vs_ew"), "max_drawdown", "cagr",
        ((F.col("series_id") % 20) / 100.0).alias("placebo_p"), F.col("n").alias("live_n"), F.when(F.col("series_id") % 3 != 0, 0.01).otherwise(-0.01).alias("live_ic"))
    return RS.validation_checklist(m)
