"""Covariances, weights, constraints, costs, backtests and attribution."""

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.catalog import shared as S
from alphaloom.catalog.base import query
from alphaloom.catalog.ctes import CTES, cte, variants
from alphaloom.operators import attribution as AT
from alphaloom.operators import crosssection as CS
from alphaloom.operators import metrics as M
from alphaloom.operators import portfolio as PF
from alphaloom.operators import trading_calendar as TC
from alphaloom.operators.asof import membership_intervals
from alphaloom.operators.features import daily_returns
from alphaloom.operators.scale import handed_out
from alphaloom.params import horizon_params
from alphaloom.plans import panel as PN
from alphaloom.plans import walk_forward as WF
from alphaloom.sources.storage import materialize


def r(cols, k=6):
    return [F.round(c, k).alias(c) for c in cols]


# ---- aligned returns and covariances of the picks ----
cte("calmret", "select c.ticker, c.d, x.idx as t, c.close/lag(c.close) over (partition by c.ticker order by c.d)-1 as x from calm c join cal x on x.d=c.d", "calm cal")
cte("win", """
select k, ticker, t, coalesce(x,0) as x from (select k, ticker, unnest(range(s, idx)) as t from (select k, ticker, idx, max(f) over (partition by k)+1 as s from (
 select p.k, p.ticker, r.idx, min(c.t) as f from top_long p join reb r using (k) join calmret c on c.ticker=p.ticker and c.t>=r.idx-126 and c.t<r.idx group by p.k, p.ticker, r.idx)))
left join calmret using (ticker, t)""", "top_long reb calmret")
cte("cen", "select k, ticker, t, x, x-avg(x) over (partition by k, ticker) as c, count(*) over (partition by k, ticker) as n from win", "win")
cte("scov", "select a.k, a.ticker as i, b.ticker as j, max(a.n) as n, sum(a.c*b.c)/max(a.n) as cov from cen a join cen b on a.k=b.k and a.t=b.t group by 1,2,3", "cen")
cte("lwp", """
select k, mu, case when least(beta,delta)=0 then 0 else coalesce(least(beta,delta)/delta,0) end as shrinkage from (
 select k, tr/p as mu, (b_/n-d_)/(p*n) as beta, (d_-2*tr/p*tr+p*(tr/p)*(tr/p))/p as delta from (
  select k, sum(case when i=j then 1 else 0 end) as p, sum(case when i=j then cov end) as tr, sum(cov*cov) as d_, max(n) as n from scov group by k)
 join (select k, sum(q*q) as b_ from (select k, t, sum(c*c) as q from cen group by k, t) group by k) using (k))""", "scov cen")
cte("lw", "select s.k, s.i, s.j, s.n, s.cov*(1-p.shrinkage)+case when s.i=s.j then p.mu*p.shrinkage else 0 end as cov, p.shrinkage from scov s join lwp p using (k)", "scov lwp")
cte("tilt", """
select k, ticker, fb, case when fb then 1.0/count(*) over (partition by k) else raw/(sum(raw) over (partition by k)+1e-9) end as w from (
 select *, 0.6*inv/sum(inv) over (partition by k)+0.4*pos/(sum(pos) over (partition by k)+1e-9) as raw from (
  select t.k, t.ticker, count(l.cov) over (partition by t.k)<2 or coalesce(max(l.n) over (partition by t.k),0)<30 as fb, 1/(sqrt(l.cov)+1e-8) as inv, case when l.cov is not null then greatest(t.cs_score,0) end as pos
  from top_long t left join lw l on l.k=t.k and l.i=t.ticker and l.j=t.ticker))""", "top_long lw")
cte("hhi", """
select k, ticker, pow(0.8,s)*w+(1-pow(0.8,s))/n as w from (select *, case when h-1.0/n<=1.5/n+1e-8 then 0 else least(50,ceil(ln((1.5/n+1e-8)/(h-1.0/n))/ln(0.64))) end as s from (
 select *, count(*) over (partition by k) as n, sum(w*w) over (partition by k) as h from tilt where not fb))""", "tilt")


def _top(t):
    def make():
        _z, s = S.scored(t)
        return materialize(CS.select_top(s.select("k", "ticker", "cs_score"), ["k"], 10, "cs_score").select("k", "ticker", "cs_score"), "top")
    return S.memo(t, "top", make)


def _vectors(t):
    def make():
        days = TC.trading_days(t.dates)
        reb = TC.rebalance_calendar(days, 21)
        top = _top(t)
        held = t.calm_of(handed_out(top.select("ticker").distinct(), "names"))
        return materialize(PF.window_vectors(top.join(reb.select("k", "idx"), "k").select("k", "ticker", "idx"), held, days), "vectors")
    return S.memo(t, "vectors", make)


def _ret(t):
    return PF.long_returns(_vectors(t))


def _lw(t):
    return S.memo(t, "lw", lambda: materialize(PF.ledoit_wolf_of(_vectors(t), ["k"]), "lw"))


@query("window_returns", "A22", "select k, ticker, t, round(x,6) as x from win", "win")
def _(t):
    return _ret(t).select("k", "ticker", "t", *r(["x"]))


@query("covariance", "A22 J21", "select k, i, j, n, round(cov*1e4,6) as cov from scov", "scov")
def _(t):
    return PF.covariance_long(_ret(t), ["k"]).select("k", "i", "j", "n", F.round(F.col("cov") * 1e4, 6).alias("cov"))


@query("shrunk_covariance", "A22", "select k, i, j, round(cov*1e4,6) as cov, round(shrinkage,6) as shrinkage from lw", "lw")
def _(t):
    return _lw(t).select("k", "i", "j", F.round(F.col("cov") * 1e4, 6).alias("cov"), *r(["shrinkage"]))


@query("signal_tilt_weights", "C1", "select k, ticker, fb as fallback, round(w,6) as weight from tilt where w is not null", "tilt")
def _(t):
    return PF.signal_tilt(_top(t), _lw(t), ["k"]).select("k", "ticker", "fallback", *r(["weight"]))


def _tilted(t):
    return PF.signal_tilt(_top(t), _lw(t), ["k"]).where("not fallback").select("k", "ticker", "weight")


def _held_z(t, weights):
    """z-scores, as rows, of the names that are held: few, so that those of the market stay where they are."""
    held = handed_out(weights.select("k", "ticker").distinct(), "held")
    return CS.stacked_factors(S.normalized(t).join(held, ["k", "ticker"], "left_semi"), ["k"])


@query("hhi_smoothed_weights", "C5", "select k, ticker, round(w,6) as weight from hhi", "hhi")
def _(t):
    return PF.hhi_smooth(_tilted(t), ["k"]).select("k", "ticker", *r(["weight"]))


_CAP = """
, base as ({src}), rec as (with recursive c as (select k, ticker, w, 0 as it, false as done from base
 union all select k, ticker, case when done then w else lw/(sum(lw) over (partition by k)+{eps}) end, it+1, done or max(lw/(1.0)) over (partition by k)/(sum(lw) over (partition by k)+{eps})<={cap}+{tol}
 from (select *, least(w,{cap}) as lw from c where it<{steps})) select k, ticker, w from c where it={steps})"""
CAP20 = _CAP.format(src="select k, ticker, w from hhi", eps="1e-9", cap="0.20", tol="1e-6", steps=20)


@query("capped_weights", "C6", CAP20 + " select k, ticker, round(w,6) as weight from rec", "hhi")
def _(t):
    w = PF.hhi_smooth(_tilted(t), ["k"])
    return PF.cap_positions(w, ["k"], steps=20, tol=1e-6, eps=1e-9).select("k", "ticker", *r(["weight"]))


@query("capped_weights_tight", "C6", _CAP.format(src="select k, ticker, w from tilt where not fb", eps="0", cap="0.12", tol="1e-8", steps=50) + " select k, ticker, round(w,6) as weight from rec", "tilt")
def _(t):
    return PF.cap_positions(_tilted(t), ["k"], cap=0.12).select("k", "ticker", *r(["weight"]))


@query("portfolio_variance", "J16", "select a.k, round(sum(a.w*b.w*l.cov)*1e4,6) as variance from lw l join tilt a on a.k=l.k and a.ticker=l.i join tilt b on b.k=l.k and b.ticker=l.j where not a.fb group by a.k", "lw tilt")
def _(t):
    return PF.portfolio_variance(_tilted(t), _lw(t), ["k"]).select("k", F.round(F.col("variance") * 1e4, 6).alias("variance"))


_TGT = CAP20 + """, tgt as (select c.k, c.ticker, c.w*least(0.12/sqrt(greatest(v.v*252,1e-10)),1) as w from rec c join (
  select a.k, sum(a.w*b.w*l.cov) as v from lw l join rec a on a.k=l.k and a.ticker=l.i join rec b on b.k=l.k and b.ticker=l.j group by a.k) v using (k)
 union all select k, ticker, w from tilt where fb)"""


def _targets(t):
    def make():
        _z, s = S.scored(t)
        return materialize(WF.target_weights(s, t.calm, S.TEST_PARAMS, cal=S.calendar(t, S.TEST_PARAMS), of=t.calm_of), "targets")
    return S.memo(t, "targets", make)


@query("target_weights", "C1 C9", _TGT + " select k, ticker, round(w,6) as weight from tgt", "hhi lw tilt")
def _(t):
    return _targets(t).select("k", "ticker", *r(["weight"]))


@query("herfindahl", "A35", "select k, round(sum(w*w),6) as hhi from tilt where not fb group by k", "tilt")
def _(t):
    return AT.herfindahl(_tilted(t), ["k"]).select("k", *r(["hhi"]))


@query("risk_parity_weights", "A25", """
select k, ticker, round((1/(s+1e-6))/sum(1/(s+1e-6)) over (partition by k),6) as weight from (select k, ticker, stddev_samp(x) as s from win group by k, ticker)""", "win")
def _(t):
    v = _ret(t).groupBy("k", "ticker").agg(F.stddev_samp("x").alias("vol"))
    return PF.risk_parity(v, ["k"]).select("k", "ticker", *r(["weight"]))


cte("kel", """
select k, ticker, case when tot<1e-9 then 1.0/n else raw/tot*0.25+0.75/n end as w from (select *, count(*) over (partition by k) as n, sum(raw) over (partition by k) as tot from (
 select k, ticker, greatest(cs_score,0)/((s+1e-8)*(s+1e-8)+1e-8) as raw from top_long join (select k, ticker, stddev_samp(x) as s from win group by k, ticker) using (k, ticker)))""", "top_long win")
cte("cva", "select k, ticker, count(*) as n, abs(avg(case when x<=cut then x end)) as cvar from (select *, quantile_cont(x,0.05) over (partition by k, ticker) as cut from win) group by k, ticker", "win")
cte("cvw", "select k, ticker, (1/v)/sum(1/v) over (partition by k) as w from (select *, case when n<20 then 0.02 else greatest(cvar,1e-4) end as v from cva)", "cva")


def _scored_sigma(t):
    sig = _ret(t).groupBy("k", "ticker").agg(F.stddev_samp("x").alias("sigma"))
    return _top(t).withColumnRenamed("cs_score", "score").join(sig, ["k", "ticker"])


@query("kelly_weights", "C2", "select k, ticker, round(w,6) as weight from kel", "kel")
def _(t):
    return PF.kelly(_scored_sigma(t), ["k"]).select("k", "ticker", *r(["weight"]))


@query("cvar_weights", "A21", "select k, ticker, round(cvar,6) as cvar, round(w,6) as weight, round(case when n<20 then 0.2 else greatest(0.03,least(0.2,0.025/(cvar+1e-6))) end,6) as max_weight from cva join cvw using (k, ticker)", "cva cvw")
def _(t):
    c = PF.cvar(_ret(t), ["k"])
    w = PF.cvar_weights(c, ["k"])
    return c.join(w, ["k", "ticker"]).select("k", "ticker", *r(["cvar", "weight"]), F.round(PF.cvar_cap(F.col("n"), F.col("cvar")), 6).alias("max_weight"))


cte("blend2", "select k, ticker, w/(sum(w) over (partition by k)+1e-9) as w from (select k, ticker, 0.5*a.w+0.5*b.w as w from kel a join cvw b using (k, ticker))", "kel cvw")


@query("blended_weights", "C4", "select k, ticker, round(w,6) as weight from blend2", "blend2")
def _(t):
    return _blend2(t).select("k", "ticker", *r(["weight"]))


def _blend2(t):
    return PF.blend([(PF.kelly(_scored_sigma(t), ["k"]), 0.5), (PF.cvar_weights(PF.cvar(_ret(t), ["k"]), ["k"]), 0.5)], ["k"])


@query("minimum_position", "P27", "select k, ticker, round(w/sum(w) over (partition by k),6) as weight from blend2 where w>=0.095", "blend2")
def _(t):
    return PF.min_position(_blend2(t), ["k"], 0.095).select("k", "ticker", *r(["weight"]))


@query("sector_cap_greedy", "C8", """
select k, ticker, round(w/sum(w) over (partition by k),6) as weight from (select k, ticker, least(w,greatest(0,0.25-coalesce(sum(w) over (partition by k, sector order by w desc, ticker rows between unbounded preceding and 1 preceding),0))) as w
 from blend2 join sectors using (ticker)) where w>0""", "blend2 sectors")
def _(t):
    return PF.sector_cap_greedy(_blend2(t).join(t.sectors.select("ticker", "sector"), "ticker"), ["k"]).select("k", "ticker", *r(["weight"]))


@query("sector_constraints", "C7 UD2", """
, base as (select k, ticker, sector, w from blend2 join sectors using (ticker)), rec as (with recursive c as (select k, ticker, sector, w, 0 as it from base
 union all select k, ticker, sector, case when bool_or(o) over (partition by k) then v/sum(v) over (partition by k) else w end, it+1 from (
  select *, case when tot>0.35+1e-5 then w*0.35/tot else w end as v, tot>0.35+1e-5 as o from (select *, sum(w) over (partition by k, sector) as tot from c where it<20)))
 select * from c where it=20) select k, ticker, round(w,6) as weight from rec""", "blend2 sectors")
def _(t):
    w = _blend2(t).join(t.sectors.select("ticker", "sector"), "ticker").select("k", "ticker", "sector", "weight")
    return PF.sector_constraints(w, ["k"]).select("k", "ticker", *r(["weight"]))


# elimination as a recursion over the pivots of each portfolio's augmented rows
cte("blm", """
select k, list(i order by i) as names, list(row order by i) as rows from (
 select l.k, l.i, list_append(list(0.05*l.cov*(case when l.i=l.j then 1.1 else 1.0 end) order by l.j), any_value(coalesce(s.cs_score,0))-2.5*avg(l.cov)) as row
 from lw l join top_long s on s.k=l.k and s.ticker=l.i group by l.k, l.i) group by k""", "lw top_long")
cte("blw", """
select k, ticker, case when tot>=1e-9 then w/tot else 1.0/n end as w from (select *, sum(w) over (partition by k) as tot from (
 select k, n, unnest(names) as ticker, unnest(list_transform(rows, lambda r: greatest(1.0/n+0.02*r[n+1],0))) as w from (with recursive g as (
  select k, names, len(rows) as n, 1 as p, rows from blm
  union all select k, names, n, p+1, list_transform(rows, lambda r, i: case when i=p then list_transform(r, lambda v: v/r[p]) else list_transform(r, lambda v, j: v-r[p]*rows[p][j]/rows[p][p]) end) from g where p<=n)
  select * from g where p=n+1)))""", "blm")


@query("black_litterman_weights", "C3", "select k, ticker, round(w,6) as weight from blw", "blw")
def _(t):
    return PF.black_litterman(_top(t).withColumnRenamed("cs_score", "score"), _lw(t), ["k"]).select("k", "ticker", *r(["weight"]))


_OPTIMIZED = """
, b3 as (select k, ticker, w/(sum(w) over (partition by k)+1e-9) as w from (select k, ticker, greatest(0.4*coalesce(a.w,0)+0.3*coalesce(b.w,0)+0.3*coalesce(c.w,0),0) as w
 from blw a full outer join cvw b using (k, ticker) full outer join kel c using (k, ticker)) where k in (select k from lw where n>=20)),
h3 as (select k, ticker, pow(0.8,s)*w+(1-pow(0.8,s))/n as w from (select *, case when h-1.0/n<=1.5/n+1e-8 then 0 else least(50,ceil(ln((1.5/n+1e-8)/(h-1.0/n))/ln(0.64))) end as s from (
 select *, count(*) over (partition by k) as n, sum(w*w) over (partition by k) as h from b3)))""" + _CAP.format(src="select k, ticker, w from h3", eps="0", cap="0.20", tol="1e-8", steps=50) + """,
f3 as (select k, ticker, coalesce(sector,'Unknown') as sector, w/sum(w) over (partition by k) as w from rec left join sectors using (ticker) where w>=0.03),
s3 as (with recursive c as (select k, ticker, sector, w, 0 as it from f3
 union all select k, ticker, sector, case when bool_or(o) over (partition by k) then v/sum(v) over (partition by k) else w end, it+1 from (
  select *, case when tot>0.35+1e-5 then w*0.35/tot else w end as v, tot>0.35+1e-5 as o from (select *, sum(w) over (partition by k, sector) as tot from c where it<20)))
 select k, ticker, sector, w from c where it=20),
v3 as (select a.k, sum(a.w*b.w*l.cov) as v from lw l join s3 a on a.k=l.k and a.ticker=l.i join s3 b on b.k=l.k and b.ticker=l.j group by a.k),
o3 as (select k, ticker, sector, w from (select k, ticker, sector, w*least(0.12/sqrt(greatest(v*252,1e-10)),1) as w from s3 join v3 using (k)) where w>=0.03),
a3 as (select * from o3 union all select k, ticker, coalesce(sector,'Unknown'), 1.0/count(*) over (partition by k) from top_long left join sectors using (ticker) where k not in (select k from o3))
select k, ticker, sector, row_number() over (partition by k order by w desc, ticker) as rank, round(w,6) as weight from a3"""


@query("optimized_portfolio", "C10 K6", _OPTIMIZED, "blw cvw kel lw sectors top_long")
def _(t):
    top = _top(t).withColumnRenamed("cs_score", "score")
    return PF.optimize_portfolio(top, _ret(t), t.sectors, ["k"]).select("k", "ticker", "sector", "rank", *r(["weight"]))


# ---- consecutive portfolios ----
cte("chg", """
select k, ticker, coalesce(a.w,0) as ow, coalesce(b.w,0) as nw from (select k+1 as k, ticker, w from blend2 where k<(select max(k) from blend2)) a full outer join blend2 b using (k, ticker)""", "blend2")


def _changes(t):
    w = _blend2(t)
    last = w.agg(F.max("k").alias("m"))
    old = w.join(last, F.col("k") < F.col("m")).select((F.col("k") + 1).alias("k"), "ticker", "weight")
    return PF.weight_changes(old, w, ["k"])


@query("portfolio_turnover", "J10 U1", "select k, round(sum(abs(nw-ow)),6) as turnover, round(sum(abs(nw-ow))/2,6) as one_way from chg group by k", "chg")
def _(t):
    return PF.turnover(_changes(t), ["k"]).select("k", *r(["turnover", "one_way"]))


@query("turnover_filter", "C11", "select k, ticker, round(w/sum(w) over (partition by k),6) as weight from (select k, ticker, case when abs(nw-ow)>0.02 then nw else ow end as w from chg) where w>1e-6", "chg")
def _(t):
    return PF.turnover_filter(_changes(t), ["k"]).select("k", "ticker", *r(["weight"]))


@query("turnover_cap", "C13", "select k, ticker, round(case when abs(nw-ow)>0.05 then ow+sign(nw-ow)*0.05 else nw end,6) as weight from chg", "chg")
def _(t):
    return PF.turnover_cap(_changes(t), ["k"], 0.05).select("k", "ticker", *r(["weight"]))


cte("rcost", """
select k, ticker, delta, adv, (0.0008 + case when adv>0 then least(0.1*sqrt(delta*1e5/adv),0.005) else 0.001 end)*delta as cost from (
 select c.k, c.ticker, abs(nw-ow) as delta, coalesce(p.adv,0) as adv from chg c left join panel p on p.k=c.k and p.ticker=c.ticker) where delta>=1e-6""", "chg panel")


@query("rebalance_costs", "C12 P21", "select k, ticker, round(delta,6) as delta, round(cost*1e4,6) as cost, round(cost*1e5/(delta*1e5+1e-6)*1e4,4) as cost_bps from rcost", "rcost")
def _(t):
    c = PF.rebalance_costs(_changes(t), S.panel(t), ["k"])
    return c.select("k", "ticker", *r(["delta"]), F.round(F.col("cost") * 1e4, 6).alias("cost"), *r(["cost_bps"], 4))


@query("rebalance_cost_total", "C12 A4", "select k, round(sum(cost)*1e4,6) as cost_bps, count(*) as n_trades from rcost group by k", "rcost")
def _(t):
    return PF.rebalance_costs(_changes(t), S.panel(t), ["k"]).groupBy("k").agg(
        F.round(F.sum("cost") * 1e4, 6).alias("cost_bps"), F.count("*").alias("n_trades"))


# ---- factor covariance model ----
cte("fcs", """
select d, (market-avg(market) over ())/(stddev_pop(market) over ()+1e-8) as market, (momentum-avg(momentum) over ())/(stddev_pop(momentum) over ()+1e-8) as momentum, (quality-avg(quality) over ())/(stddev_pop(quality) over ()+1e-8) as quality from (
 select d, avg(ret) as market, coalesce(avg(pr)-0.5,0) as momentum, coalesce(sum(inv*ret)/sum(inv),0) as quality from (
  select *, case when mom is not null then (rank() over (partition by d, mom is null order by mom)+(count(*) over (partition by d, mom)-1)/2.0)/count(mom) over (partition by d) end as pr from (
   select ticker, d, ret, case when count(ret) over p63=63 then sum(ret) over p63 end as mom, case when count(ret) over p21=21 then 1/(stddev_samp(ret) over p21+1e-8) end as inv
   from (select ticker, d, x as ret from calmret where x is not null) window p63 as (partition by ticker order by d rows between 63 preceding and 1 preceding), p21 as (partition by ticker order by d rows between 21 preceding and 1 preceding))) group by d)""", "calmret")


def _calm_returns(t):
    return daily_returns(t.calm).where("ret is not null").select("ticker", "d", "ret")


@query("factor_series", "W-F1 W-F2", "select d, round(market,6) as market, round(momentum,6) as momentum, round(quality,6) as quality from fcs", "fcs")
def _(t):
    return PF.factor_series(_calm_returns(t)).select("d", *r(["market", "momentum", "quality"]))


@query("factor_covariance", "A23", """
select 'market' as a, 'market' as b, round(covar_samp(market,market),6) as fcov from fcs union all select 'market','momentum',round(covar_samp(market,momentum),6) from fcs union all select 'market','quality',round(covar_samp(market,quality),6) from fcs
union all select 'momentum','market',round(covar_samp(market,momentum),6) from fcs union all select 'momentum','momentum',round(covar_samp(momentum,momentum),6) from fcs union all select 'momentum','quality',round(covar_samp(momentum,quality),6) from fcs
union all select 'quality','market',round(covar_samp(market,quality),6) from fcs union all select 'quality','momentum',round(covar_samp(momentum,quality),6) from fcs union all select 'quality','quality',round(covar_samp(quality,quality),6) from fcs""", "fcs")
def _(t):
    return PF.factor_cov(PF.factor_series(_calm_returns(t))).select("a", "b", *r(["fcov"]))


def _loadings(t):
    def make():
        x = _calm_returns(t)
        return materialize(PF.factor_loadings(x, PF.factor_series(x)), "loadings")
    return S.memo(t, "loadings", make)


# least squares by successive orthogonalisation, one factor after the other
cte("fy", "select c.ticker, c.d, c.x as y, f.market as x1, f.momentum as x2, f.quality as x3 from calmret c join fcs f using (d) where c.x is not null", "calmret fcs")
cte("fl1", "select ticker, count(*) as n, regr_slope(y,x1) as sy1, regr_slope(x2,x1) as s21, regr_slope(x3,x1) as s31 from fy group by ticker", "fy")
cte("fl2", "select fy.ticker, max(n) as n, max(sy1) as sy1, max(s21) as s21, max(s31) as s31, regr_slope(y,x2-s21*x1) as sy2, regr_slope(x3,x2-s21*x1) as s32 from fy join fl1 using (ticker) group by fy.ticker", "fy fl1")
cte("fl3", "select fy.ticker, max(n) as n, max(sy1) as sy1, max(s21) as s21, max(s31) as s31, max(sy2) as sy2, max(s32) as s32, regr_slope(y,x3-s31*x1-s32*(x2-s21*x1)) as b3 from fy join fl2 using (ticker) group by fy.ticker", "fy fl2")
cte("fl4", "select ticker, n, b3 as quality, sy2-b3*s32 as momentum, sy1-(sy2-b3*s32)*s21-b3*s31 as market from fl3", "fl3")
cte("fload", "select fy.ticker, max(n) as n, max(market) as market, max(momentum) as momentum, max(quality) as quality, var_pop(y-market*x1-momentum*x2-quality*x3) as specific_var, greatest(0,least(1,1-var_pop(y-market*x1-momentum*x2-quality*x3)/(var_pop(y)+1e-10))) as r_squared from fy join fl4 using (ticker) group by fy.ticker", "fy fl4")
cte("fcv", """
select a, b, covar_samp(xa, xb) as fcov from (select d, unnest(['market','momentum','quality']) as a, unnest([market,momentum,quality]) as xa from fcs) join (select d, unnest(['market','momentum','quality']) as b, unnest([market,momentum,quality]) as xb from fcs) using (d) group by a, b""", "fcs")
cte("flong", "select ticker, specific_var, unnest(['market','momentum','quality']) as f, unnest([market,momentum,quality]) as b from fload", "fload")


@query("factor_loadings", "A23 UD4", "select ticker, n, round(market,6) as market, round(momentum,6) as momentum, round(quality,6) as quality, round(specific_var*1e4,6) as specific_var, round(r_squared,6) as r_squared from fload", "fload")
def _(t):
    return _loadings(t).select("ticker", "n", *r(["market", "momentum", "quality"]), F.round(F.col("specific_var") * 1e4, 6).alias("specific_var"), *r(["r_squared"]))


@query("factor_model_covariance", "A23", """
select m.k, m.i, m.j, round((0.7*m.cov+0.3*l.cov)*1e4,6) as cov from (select p.k, p.ticker as i, q.ticker as j, sum(x.b*v.fcov*y.b)+case when p.ticker=q.ticker then max(x.specific_var) else 0 end as cov
 from top_long p join top_long q on p.k=q.k join flong x on x.ticker=p.ticker join fcv v on v.a=x.f join flong y on y.ticker=q.ticker and y.f=v.b group by p.k, p.ticker, q.ticker) m join lw l using (k, i, j)""", "top_long flong fcv lw")
def _(t):
    fc = PF.factor_cov(PF.factor_series(_calm_returns(t)))
    return PF.factor_model_cov(_loadings(t), fc, _top(t).select("k", "ticker"), _lw(t)).select("k", "i", "j", F.round(F.col("cov") * 1e4, 6).alias("cov"))


@query("risk_attribution", "A24", """
, e as (select k, f, sum(w*b) as e from tw join flong using (ticker) group by k, f), s as (select k, sum(w*w*specific_var) as sv from tw join fload using (ticker) group by k),
 q as (select x.k, sum(x.e*v.fcov*y.e) as fv, sum(case when v.a='market' and v.b='market' then x.e*v.fcov*y.e end) as m, sum(case when v.a='momentum' and v.b='momentum' then x.e*v.fcov*y.e end) as o, sum(case when v.a='quality' and v.b='quality' then x.e*v.fcov*y.e end) as u from e x join fcv v on v.a=x.f join e y on y.k=x.k and y.f=v.b group by x.k)
select k, round((fv+sv+1e-12)*1e4,6) as total_variance, round(fv/(fv+sv+1e-12)*100,4) as factor_pct, round(sv/(fv+sv+1e-12)*100,4) as specific_pct, round(m/(fv+sv+1e-12)*100,4) as market_pct, round(o/(fv+sv+1e-12)*100,4) as momentum_pct, round(u/(fv+sv+1e-12)*100,4) as quality_pct from q join s using (k)""", "tw flong fload fcv")
def _(t):
    fc = PF.factor_cov(PF.factor_series(_calm_returns(t)))
    return PF.risk_attribution(_tilted(t), _loadings(t), fc, ["k"]).select(
        "k", F.round(F.col("total_variance") * 1e4, 6).alias("total_variance"), *r(["factor_pct", "specific_pct", "market_pct", "momentum_pct", "quality_pct"], 4))


# ---- backtests ----
def _backtest(t):
    def make():
        _z, s = S.scored(t)
        _z, w = S.scored(t, "swing")
        both = s.select(F.lit("longterm").alias("strategy"), "k", "ticker", "cs_score").unionByName(
            w.select(F.lit("swing").alias("strategy"), "k", "ticker", "cs_score"))
        return WF.run(both, t.calm, S.panel(t).select("k", "ticker", "adv"), S.TEST_PARAMS, cal=S.calendar(t, S.TEST_PARAMS), of=t.calm_of)
    return S.memo(t, "backtest", make)


# the path as a recursion: one step per rebalance, one row per name of that step
_PATH = _TGT + """,
ks as (select k, idx, row_number() over (order by k) as q from (select distinct k from tgt) join (select k, idx from reb) using (k)),
tq as (select ks.q, ks.k, ks.idx, t.ticker, t.w from tgt t join ks using (k)),
path as (with recursive st as (
 select 0::bigint as q, -1::bigint as k, -1::bigint as ticker, 0.0::double as w, 0.0::double as target, 0.0::double as prev, 1.0::double as value, 1.0::double as peak, 1.0::double as dd_scale, 0.0::double as raw_turn, 0.0::double as filt_turn, 0.0::double as cost, 0.0::double as total
 union all (
 with cur as (select max(q) as q, max(value) as value, max(peak) as peak, case when max(q)=0 then 1.0 when (max(value)-max(peak))/(max(peak)+1e-10)<-0.25 then 0.40 when (max(value)-max(peak))/(max(peak)+1e-10)<-0.15 then 0.65 when (max(value)-max(peak))/(max(peak)+1e-10)<-0.08 then 0.85 else 1.0 end as sc from st),
  nx as (select cur.q+1 as q, ks.k, ks.idx, cur.value, cur.peak, cur.sc from cur join ks on ks.q=cur.q+1),
  tg as (select tq.ticker, tq.w*nx.sc as w from tq join nx on tq.q=nx.q),
  u as (select coalesce(tg.ticker,o.ticker) as ticker, coalesce(tg.w,0) as nw, coalesce(o.w,0) as ow from tg full outer join (select ticker, w from st where w>0) o on o.ticker=tg.ticker),
  f as (select *, case when abs(nw-ow)>0.02 then case when nw>1e-6 then nw else 0 end else case when ow>1e-6 then ow else 0 end end as x from u),
  g as (select ticker, nw, ow, x/sum(x) over () as w from f),
  c as (select g.*, case when abs(g.w-g.ow)<1e-6 then 0 else (0.0008+case when coalesce(p.adv,0)>0 then least(0.1*sqrt(abs(g.w-g.ow)*1e5/p.adv),0.005) else 0.001 end)*abs(g.w-g.ow) end as cost from g cross join nx left join panel p on p.k=nx.k and p.ticker=g.ticker),
  dr as (select r.t, sum(g.w*r.x) as r from g cross join nx join calmret r on r.ticker=g.ticker and r.t>=nx.idx and r.t<nx.idx+21 and r.x is not null group by r.t),
  vp as (select r, nx.value*(1-(select sum(cost) from c))*exp(sum(ln(1+r)) over (order by t)) as v, t from dr cross join nx),
  fin as (select (select sum(cost) from c) as cost, nx.value*(1-(select sum(cost) from c))*exp(coalesce((select sum(ln(1+r)) from dr),0)) as value,
    greatest(nx.peak, coalesce((select max(v) from vp),0)) as pk, coalesce((select sum(r) from dr),0) as total, (select min(t) from dr) as t0, nx.value*(1-(select sum(cost) from c)) as v0, nx.* exclude (value) from nx)
 select fin.q, fin.k, c.ticker, c.w, c.nw, c.ow, fin.value, case when fin.t0=fin.idx then fin.pk else greatest(fin.pk, fin.v0) end, fin.sc, (select sum(abs(nw-ow)) from c), (select sum(abs(w-ow)) from c), fin.cost, fin.total from c cross join fin))
 select * from st where q>0)"""
PATH_CTES = "hhi lw tilt reb calmret panel"


@query("walk_forward_audit", "C14 C11 UD3", _PATH + """
select k, max(dd_scale) as dd_scale, round(max(raw_turn),6) as raw_turnover, round(max(filt_turn),6) as filtered_turnover, round(max(cost)*1e4,4) as cost_bps, round(max(total),6) as period_return, round(max(value),6) as value from path group by k""", PATH_CTES)
def _(t):
    return _backtest(t).audit.where("strategy = 'longterm'").select(
        "k", "dd_scale", *r(["raw_turnover", "filtered_turnover"]), F.round(F.col("total_cost") * 1e4, 4).alias("cost_bps"), *r(["period_return", "value"]))


@query("walk_forward_weights", "C14 C11", _PATH + " select k, ticker, round(w,6) as weight, round(target,6) as target, round(prev,6) as prev from path", PATH_CTES)
def _(t):
    return _backtest(t).weights.where("strategy = 'longterm'").select("k", F.col("ticker").cast("bigint").alias("ticker"), *r(["weight", "target", "prev"]))


@query("turnover_cost_summary", "A4", _PATH + """
select count(*) as n_rebalances, round(avg(raw_turn),6) as avg_raw_turnover, round(avg(filt_turn),6) as avg_filtered_turnover, round(avg(cost)*1e4,6) as avg_cost_bps from (select k, max(raw_turn) as raw_turn, max(filt_turn) as filt_turn, max(cost) as cost from path group by k)""", PATH_CTES)
def _(t):
    return M.turnover_summary(_backtest(t).audit.where("strategy = 'longterm'")).select("n_rebalances", *r(["avg_raw_turnover", "avg_filtered_turnover", "avg_cost_bps"]))


_DAILY = """,
hd as (select k, max(value) as value, max(cost) as cost from path group by k), hp as (select *, coalesce(lag(value) over (order by k),1)*(1-cost) as v0 from hd),
dd0 as (select k, t, idx, v0 from (select h.k, h.v0, r.idx, unnest(range(r.idx, r.idx+21)) as t from hp h join reb r using (k))),
dret as (select p.k, c.t, sum(p.w*c.x) as r from path p join reb b using (k) join calmret c on c.ticker=p.ticker and c.t>=b.idx and c.t<b.idx+21 and c.x is not null group by p.k, c.t),
deq as (select cal.d, a.t, a.v0*exp(sum(ln(1+coalesce(r,0))) over (partition by a.k order by a.t)) as value from dd0 a left join dret using (k, t) join cal on cal.idx=a.t)"""


@query("walk_forward_equity", "C14 W-E1", _PATH + _DAILY + " select d, round(value,6) as value from deq", PATH_CTES + " cal")
def _(t):
    return _backtest(t).equity.where("series_id = 'longterm'").select("d", *r(["value"]))


@query("walk_forward_performance", "C14 A1", _PATH + _DAILY + """
select count(*) as n, round(avg(r)/(stddev_pop(r)+1e-10)*sqrt(252),4) as sharpe, round(avg(r)/(coalesce(stddev_samp(case when r<0 then r end),0)+1e-10)*sqrt(252),4) as sortino, round(min(dd),6) as max_drawdown, round(arg_max(value,d)/arg_min(value,d)-1,6) as total_return
from (select d, value, value/lag(value) over (order by d)-1 as r, (value-max(value) over (order by d))/(max(value) over (order by d)+1e-10) as dd from deq)""", PATH_CTES + " cal")
def _(t):
    x = M.perf_metrics(_backtest(t).equity.where("series_id = 'longterm'"))
    return x.select("n", *r(["sharpe", "sortino"], 4), *r(["max_drawdown", "total_return"]))


# the same path on scores whose weights are scaled by what was known of their factors
_scaled = variants("cs_long", "_sc", lambda n, sql: re.sub(r"\bscore_long\b", "score_scaled", sql) if n == "cs_long" else sql)
cte("cs_long_sc", CTES["cs_long_sc"][1], "score_scaled")


@query("walk_forward_ic_scaled", "C14 P14 W-I2", _scaled(_PATH + """
select k, max(dd_scale) as dd_scale, round(max(filt_turn),6) as filtered_turnover, round(max(cost)*1e4,4) as cost_bps, round(max(total),6) as period_return, round(max(value),6) as value from path group by k"""),
       "hhi_sc lw_sc tilt_sc reb calmret panel")
def _(t):
    def make():
        from alphaloom.catalog.q_metrics import scaled_scores
        s = scaled_scores(t).select(F.lit("scaled").alias("strategy"), "k", "ticker", "cs_score")
        return WF.run(s, t.calm, S.panel(t).select("k", "ticker", "adv"), S.TEST_PARAMS, cal=S.calendar(t, S.TEST_PARAMS), of=t.calm_of)
    a = S.memo(t, "backtest_scaled", make).audit
    return a.select("k", "dd_scale", *r(["filtered_turnover"]), F.round(F.col("total_cost") * 1e4, 4).alias("cost_bps"), *r(["period_return", "value"]))


# ---- the swing preset: weekly rebalances, twelve names, its own limits ----
SWING = horizon_params("swing").with_(min_adv=S.TEST_PARAMS.min_adv, min_universe=S.TEST_PARAMS.min_universe)


def _swing_sql(name, sql):
    if name in ("reb", ""):
        sql = re.sub(r"\b21\b", str(SWING.rebalance_days), sql)
    if name == "cs_long":
        sql = re.sub(r"\bscore_long\b", "score_swing", sql)
    if name == "top_long":
        sql = sql.replace("rn<=10", f"rn<={SWING.top_n}")
    if name == "":
        sql = sql.replace("least(0.12/sqrt", f"least({SWING.target_vol}/sqrt").replace("least(w,0.20)", f"least(w,{SWING.max_position})").replace("<=0.20+", f"<={SWING.max_position}+")
    return sql


_swing = variants("reb", "_sw", _swing_sql)
cte("cs_long_sw", CTES["cs_long_sw"][1], "score_swing_sw")
SWING_CTES = "hhi_sw lw_sw tilt_sw reb_sw calmret panel_sw cal"


def _swing_backtest(t):
    def make():
        cal = S.calendar(t, SWING)
        p = PN.research_panel(t.calm, t.sectors, S.regimes(t), SWING, t.fundamentals, membership_intervals(t.baseline, t.membership_events), cal)
        s = materialize(PN.scores(PN.normalized_panel(p), p, "swing"), "scores")
        return WF.run(s.select(F.lit("swing").alias("strategy"), "k", "ticker", "cs_score"), t.calm, p.select("k", "ticker", "adv"), SWING, cal=cal, of=t.calm_of)
    return S.memo(t, "backtest_swing", make)


@query("walk_forward_swing_audit", "C14 P15", _swing(_PATH + """
select k, max(dd_scale) as dd_scale, round(max(filt_turn),6) as filtered_turnover, round(max(total),6) as period_return, round(max(value),6) as value from path group by k"""), SWING_CTES)
def _(t):
    return _swing_backtest(t).audit.select("k", "dd_scale", *r(["filtered_turnover", "period_return", "value"]))


@query("walk_forward_swing", "C14 A1 P15", _swing(_PATH + _DAILY + """
select count(*) as n, round(avg(r)/(stddev_pop(r)+1e-10)*sqrt(252),4) as sharpe, round(avg(r)/(coalesce(stddev_samp(case when r<0 then r end),0)+1e-10)*sqrt(252),4) as sortino, round(min(dd),6) as max_drawdown, round(arg_max(value,d)/arg_min(value,d)-1,6) as total_return
from (select d, value, value/lag(value) over (order by d)-1 as r, (value-max(value) over (order by d))/(max(value) over (order by d)+1e-10) as dd from deq)"""), SWING_CTES)
def _(t):
    x = M.perf_metrics(_swing_backtest(t).equity)
    return x.select("n", *r(["sharpe", "sortino"], 4), *r(["max_drawdown", "total_return"]))


@query("universe_benchmark_curve", "A3 C14", """
select d, round(exp(sum(ln(1+ret)) over (order by d)),4) as value from (select c.d, avg(c.x) as ret from calmret c join panel p on p.ticker=c.ticker and p.k=(c.t-100)//21 where c.t>=100 and c.x is not null group by c.d)""", "calmret panel")
def _(t):
    return WF.equal_weight_curve(t.calm, S.panel(t), S.TEST_PARAMS).select("d", *r(["value"], 4))


# ---- attribution over the tilted portfolios ----
cte("per", "select k, ticker, exp(sum(ln(1+x)))-1 as ret from (select *, (t-100)//21 as k from calmret where t>=100 and x is not null) group by k, ticker", "calmret")


def _period_returns(t):
    days = TC.trading_days(t.calm).where("idx >= 100").select("d", F.floor((F.col("idx") - 100) / 21).cast("int").alias("k"))
    return daily_returns(t.calm).where("ret is not null").join(days, "d").groupBy("k", "ticker").agg(
        (F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"))


def _bench(t):
    return S.panel(t).select("k", "ticker", (1.0 / F.count("*").over(W.partitionBy("k"))).alias("weight"))


cte("tw", "select k, ticker, w from tilt where not fb", "tilt")
cte("bw", "select k, ticker, 1.0/count(*) over (partition by k) as w from panel where k in (select k from tw)", "panel tw")


@query("brinson_by_name", "A15", """
select k, round(0.0,6) as allocation, round(sum(wb*(r-rb)),6) as selection, round(sum((wp-wb)*(r-rb)),6) as interaction, round(sum(wp*r)-max(rb),6) as active_return from (
 select k, ticker, coalesce(a.w,0) as wp, coalesce(b.w,0) as wb, coalesce(p.ret,0) as r, q.rb from tw a full outer join bw b using (k, ticker) left join per p using (k, ticker)
 join (select k, sum(w*coalesce(ret,0)) as rb from bw left join per using (k, ticker) group by k) q using (k)) group by k""", "tw bw per")
def _(t):
    ret, w = _period_returns(t), _tilted(t)
    b = _bench(t).join(w.select("k").distinct(), "k")
    br = b.join(ret, ["k", "ticker"], "left").groupBy("k").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    return AT.brinson_ticker(w, b, ret, br, ["k"]).select("k", *r(["allocation", "selection", "interaction", "active_return"]))


@query("brinson_by_sector", "A15", """
, sp as (select k, sector, sum(w) as wp, coalesce(sum(w*coalesce(ret,0))/sum(w),0) as rp from tw left join per using (k, ticker) join sectors using (ticker) group by k, sector),
 sb as (select k, sector, sum(w) as wb, coalesce(sum(w*coalesce(ret,0))/sum(w),0) as rb from bw left join per using (k, ticker) join sectors using (ticker) group by k, sector)
select k, sector, round((wp-wb)*(rb-tot),6) as allocation, round(wb*(rp-rb),6) as selection, round((wp-wb)*(rp-rb),6) as interaction from (
 select *, sum(wb*rb) over (partition by k) as tot from (select k, sector, coalesce(wp,0) as wp, coalesce(rp,0) as rp, coalesce(wb,0) as wb, coalesce(rb,0) as rb from sp full outer join sb using (k, sector)))""", "tw bw per sectors")
def _(t):
    w = _tilted(t)
    b = _bench(t).join(w.select("k").distinct(), "k")
    return AT.brinson_sector(w, b, _period_returns(t), t.sectors, ["k"]).select("k", "sector", *r(["allocation", "selection", "interaction"]))


@query("factor_return_attribution", "A16", """
, fr as (select k, factor, avg(ret*z) as fret from zf join per using (k, ticker) group by k, factor),
 ld as (select k, factor, sum(w*z) as loading from tw join zf using (k, ticker) group by k, factor),
 pr as (select k, sum(w*coalesce(ret,0)) as ret from tw left join per using (k, ticker) group by k)
select k, factor, round(loading,6) as loading, round(loading*fret,6) as contribution, round(ret-ex,6) as alpha from (
 select *, sum(loading*fret) over (partition by k) as ex from ld join fr using (k, factor)) join pr using (k)""", "tw zf per")
def _(t):
    z, _s = S.scored(t)
    z = z.select("k", "ticker", "factor", "z")
    ret, w = _period_returns(t), _tilted(t)
    fr = z.join(ret, ["k", "ticker"]).groupBy("k", "factor").agg(F.avg(F.col("ret") * F.col("z")).alias("factor_return"))
    pr = w.join(ret, ["k", "ticker"], "left").groupBy("k").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    return AT.factor_return_attribution(w, z, fr, pr, ["k"]).select("k", "factor", *r(["loading", "contribution", "alpha"]))


@query("portfolio_exposure", "A19", "select k, factor, round(sum(w*z)/max(tot),6) as exposure from tw join zf using (k, ticker) join (select k, sum(w) as tot from tw group by k) using (k) group by k, factor", "tw zf")
def _(t):
    w = materialize(_tilted(t), "tilted")
    return AT.portfolio_exposure(w, _held_z(t, w), ["k"]).select("k", "factor", *r(["exposure"]))


@query("factor_contribution", "A8", """
select z.k, z.factor, round(sum(w.weight*greatest(-3,least(3,z.z))),4) as contribution from zf z join panel p on z.k=p.k and z.ticker=p.ticker
join w_long w on w.regime=p.regime and w.factor=z.factor group by z.k, z.factor""", "zf panel w_long")
def _(t):
    from alphaloom import params as P
    z, _s = S.scored(t)
    return AT.factor_contribution(CS.score_components(z, ["k"], P.LONG_TERM_WEIGHTS), ["k"]).select("k", "factor", *r(["contribution"], 4))


@query("factor_attribution", "A7", """
select factor, round(coalesce(m,0),4) as mean_ic, round(coalesce(m,0)/(coalesce(s,1)+1e-6),4) as ic_ir, round(coalesce(h,0.5),4) as hit_rate, round(coalesce(x,0),4) as avg_exposure, round(coalesce(m,0)*coalesce(x,0)*1e6,1) as est_contrib_bps, coalesce(n,0) as n_observations
from (select factor, avg(ic) as m, stddev_pop(ic) as s, avg(case when ic>0 then 1.0 else 0.0 end) as h, count(*) as n from icf group by factor)
full outer join (select factor, avg(z*w/tot) as x from tw join zf using (k, ticker) join (select k, sum(w) as tot from tw group by k) using (k) group by factor) using (factor)""", "icf tw zf")
def _(t):
    from alphaloom.catalog.q_metrics import forward
    from alphaloom.operators import ic as IC
    ic = IC.factor_ic(S.normalized(t), forward(t), ["k"])
    w = materialize(_tilted(t), "tilted")
    e = w.withColumn("strategy", F.lit("m")).join(_held_z(t, w), ["k", "ticker"])
    return AT.factor_attribution(ic, e).select("factor", *r(["mean_ic", "ic_ir", "hit_rate", "avg_exposure"], 4), F.round("est_contrib_bps", 1).alias("est_contrib_bps"), "n_observations")


@query("timing_contribution", "A17", """
select series_id, round(a,6) as strategy_return, round(b,6) as buy_hold_return, round(a-b,6) as timing from (select series_id, exp(sum(ln(1+ret)))-1 as a, exp(sum(ln(1+0.5*ret)))-1 as b from curves group by series_id)""", "curves")
def _(t):
    return AT.timing_contribution(t.curves, t.curves.withColumn("ret", F.col("ret") * 0.5)).select(
        "series_id", *r(["strategy_return", "buy_hold_return", "timing"]))


def _period_sql(end):
    return f"""
, dl as (select d, avg(ret) as ret, avg(0.8*ret+0.0001) as bench from curves group by d),
 p as (select {end} as period, exp(sum(ln(1+ret)))-1 as ret, exp(sum(ln(1+coalesce(bench,0))))-1 as bench, count(*) as n_days from dl group by 1),
 q as (select {end} as period, count(*) as n, sum(0.001*(k%3)) as c, sum(case when k%4=0 then 0.85 else 1 end) as s from (select k, reb_d as d from reb) group by 1)
select period, n_days, round(ret,6) as ret, round(bench,6) as bench, round(ret-bench,6) as active, ret>bench as outperformed, coalesce(n,0) as n_rebalances, round(coalesce(c/n,0),6) as avg_cost, round(coalesce(s/n,1),6) as avg_dd_scale,
 coalesce(sum(n) over w,0) as n_rebalances_cum, round(coalesce(sum(c) over w/sum(n) over w,0),6) as avg_cost_cum, round(coalesce(sum(s) over w/sum(n) over w,1),6) as avg_dd_scale_cum
from p left join q using (period) window w as (order by period)"""


def _period_query(freq):
    def run(t):
        daily = t.curves.groupBy("d").agg(F.avg("ret").alias("ret"), F.avg(0.8 * F.col("ret") + 0.0001).alias("bench"))
        reb = TC.rebalance_calendar(TC.trading_days(t.calm), 21).select(
            F.col("reb_d").alias("d"), (0.001 * (F.col("k") % 3)).alias("total_cost"), F.when(F.col("k") % 4 == 0, 0.85).otherwise(1.0).alias("dd_scale"))
        x = AT.period_report(daily, reb, freq)
        return x.select("period", "n_days", *r(["ret", "bench", "active"]), "outperformed", "n_rebalances", *r(["avg_cost", "avg_dd_scale"]), "n_rebalances_cum", *r(["avg_cost_cum", "avg_dd_scale_cum"]))
    return run


query("monthly_report", "A18", _period_sql("last_day(d)"), "curves reb")(_period_query("month"))
query("quarterly_report", "A18", _period_sql("cast(date_trunc('quarter',d) + interval '3' month - interval '1' day as date)"), "curves reb")(_period_query("quarter"))


@query("sector_rollup", "A33", """
select k, coalesce(sector,'all') as sector, round(sum(w),6) as weight, count(*) as positions, count(distinct sector) as sectors from tw join sectors using (ticker) group by grouping sets ((k, sector),(k))""", "tw sectors")
def _(t):
    return AT.sector_rollup(_tilted(t).join(t.sectors.select("ticker", "sector"), "ticker"), ["k"]).select("k", "sector", *r(["weight"]), "positions", "sectors")
