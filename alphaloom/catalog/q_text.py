"""Text and metric-store queries."""

from pyspark.sql import functions as F

from alphaloom.catalog.base import query
from alphaloom.catalog.ctes import cte
from alphaloom.operators import text as TX
from alphaloom.params import NEGATIVE_WORDS, POSITIVE_WORDS
from alphaloom.sources import metrics_store as MS

POS = POSITIVE_WORDS + ("the", "le", "la", "and")
NEG = NEGATIVE_WORDS + ("that", "que", "de", "of")
NOW = "2024-01-04 00:00:00"


def _list(xs):
    return "[" + ",".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


cte("sent", f"""
select *, case when p-n>3 then 1.0 when p-n<-3 then -1.0 else (p-n)/3.0 end as sentiment, 0.5+least(0.5,(p+n)/6.0) as confidence from (
 select *, len(list_intersect(tk,{_list(POS)})) as p, len(list_intersect(tk,{_list(NEG)})) as n from (
  select *, list_distinct(list_transform(string_split_regex(lower(text),'\\s+'), lambda x: regexp_replace(x,'^[.,:;!?()\\[\\]{{}}"'']+|[.,:;!?()\\[\\]{{}}"'']+$','','g'))) as tk from (select doc_id, doc_id%10 as ticker, text, timestamp '2024-01-01 00:00:00' + cast(doc_id%72 as int) * interval '1' hour as published_at from documents)))""")


@query("keyword_sentiment", "T1 S7", "select doc_id, round(sentiment,6) as sentiment, round(confidence,6) as confidence from sent", "sent")
def _(t):
    d = t.raw("documents").select("doc_id", "text")
    return TX.keyword_sentiment(d, positive=POS, negative=NEG).select("doc_id", F.round("sentiment", 6).alias("sentiment"), F.round("confidence", 6).alias("confidence"))


cte("wsent", f"select *, greatest(0.01, confidence*greatest(0.1,least(1,exp(-date_diff('hour',published_at,timestamp '{NOW}')/24.0)))) as w from sent", "sent")


@query("aggregate_sentiment", "T3 T2 A37", "select ticker, round(sum(sentiment*w)/sum(w),6) as sentiment, count(*) as news_volume, round(sum(sentiment*w)/sum(w)*ln(1+count(*)),6) as strength from wsent group by ticker", "wsent")
def _(t):
    return TX.aggregate_sentiment(t.news, F.lit(NOW).cast("timestamp"), positive=POS, negative=NEG).select(
        "ticker", F.round("sentiment", 6).alias("sentiment"), "news_volume", F.round("strength", 6).alias("strength"))


@query("time_decay", "T2", f"select doc_id, round(greatest(0.1,least(1,exp(-date_diff('hour',published_at,timestamp '{NOW}')/24.0))),6) as decay from sent", "sent")
def _(t):
    from alphaloom.functions.expr import time_decay
    n = t.raw("documents").select("doc_id", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 72).cast("int"))).alias("ts"))
    return n.select("doc_id", F.round(time_decay("ts", F.lit(NOW).cast("timestamp")), 6).alias("decay"))


# question texts: user turns, with a question about the data appended to each by its number
ASKS = (
    "Why did the portfolio lose money last week?", "Which factor worked best in 2024-03-15?", "What is the current drawdown risk?",
    "Why did we buy NVDA at the last rebalance?", "Should we deploy capital, is the signal valid?", "Help me, what can you do?",
    "How did momentum and earnings_surprise perform last month for AAPL and MSFT?", "Tell me a story",
)
_ASK = "text || case (conv_id+turn)%9 " + " ".join(f"when {i} then ' {q}'" for i, q in enumerate(ASKS)) + " else '' end"
cte("asked", f"select conv_id, turn, {_ASK} as text from conversations where role='user'")


def _asked(t):
    pick = F.lit("")
    for i, q in enumerate(ASKS):
        pick = F.when((F.col("conv_id") + F.col("turn")) % 9 == i, F.lit(" " + q)).otherwise(pick)
    return t.raw("conversations").where("role = 'user'").select("conv_id", "turn", F.concat("text", pick).alias("text"))


def _route_sql():
    cols = []
    for i, (name, base, pats) in enumerate(TX.RULES):
        hits = "+".join(f"cast(regexp_matches(q,'{p}') as int)" for p in pats)
        cols.append(f"case when {hits}>0 then round(least(0.99,{base}+0.05*({hits}-1)),3) else 0 end as c{i}")
    best = "greatest(" + ",".join(f"c{i}" for i in range(len(TX.RULES))) + ")"
    kind = "case " + " ".join(f"when c{i}={best} then '{n}'" for i, (n, _b, _p) in enumerate(TX.RULES)) + " end"
    return f"""select conv_id, turn, case when q='' or {best}<0.8 then 'meta_help' else {kind} end as question_type, case when q='' then 1.0 else {best} end as confidence, q<>'' and {best}<0.8 as fallback
from (select conv_id, turn, q, {', '.join(cols)} from (select *, lower(trim(text)) as q from asked))"""


cte("routed", _route_sql(), "asked")


@query("question_routing", "T4", "select * from routed", "routed")
def _(t):
    return TX.route_questions(_asked(t)).drop("text")


_DATE = TX.DATE_PATTERN
cte("ents", f"""
select conv_id, turn, array_to_string(list_filter(string_split_regex(upper(text),'[^\\p{{L}}\\p{{N}}_]+'), lambda x: list_contains({_list(TX.TICKERS)},x)),',') as tickers,
 array_to_string(list_filter({_list(TX.FACTOR_NAMES)}, lambda f: list_contains(w,f) or instr(lower(text),replace(f,'_',' '))>0),',') as factors,
 array_to_string(list_filter({_list(TX.METRIC_NAMES)}, lambda m: list_contains(w,m)),',') as metrics,
 array_to_string(regexp_extract_all(text,'{_DATE}',1),',') as date_refs,
 case when regexp_matches(lower(text),'last\\s+week') then date '2024-01-31'-7 when regexp_matches(lower(text),'last\\s+month') then date '2024-01-31'-30 when regexp_matches(lower(text),'last\\s+quarter') then date '2024-01-31'-90 end as date_from
from (select *, string_split_regex(lower(text),'[^\\p{{L}}\\p{{N}}_]+') as w from asked)""", "asked")


def _entities(t):
    return TX.extract_entities(_asked(t), today=F.lit("2024-01-31").cast("date"))


@query("question_entities", "T5", "select * from ents", "ents")
def _(t):
    j = lambda c: F.array_join(c, ",").alias(c)
    return _entities(t).select("conv_id", "turn", j("tickers"), j("factors"), j("metrics"), j("date_refs"), "date_from")


@query("deduped_questions", "T9", """
select conv_id, turn, question_type, n as n_asked from (select r.conv_id, r.turn, r.question_type, count(*) over w as n, row_number() over (partition by r.question_type, e.tickers, e.factors, e.metrics, e.date_from order by r.conv_id, r.turn) as rn
 from routed r join ents e using (conv_id, turn) window w as (partition by r.question_type, e.tickers, e.factors, e.metrics, e.date_from)) where rn=1""", "routed ents")
def _(t):
    x = TX.route_questions(_entities(t))
    return TX.dedupe_questions(x, [F.asc("conv_id"), F.asc("turn")]).select("conv_id", "turn", "question_type", "n_asked")


cte("answers", """
select s_suppkey as answer_id, 'Sharpe ratio of '||(s_suppkey%4)||'.'||(s_suppkey%10)||', max drawdown: -'||(s_suppkey%30)||'% and alpha = 0.0'||(s_suppkey%9)||'. Hit rate = '||(s_suppkey%90)||'%, turnover of 0.'||(10+s_suppkey%80)
 ||case when s_suppkey%3=0 then '. This might be unclear, perhaps; data not available.' when s_suppkey%3=1 then ' (from pnl, source: audit)' else '' end || case when s_suppkey%7=0 then ' ```json {"confidence": 0.6'||(s_suppkey%10)||'} ```' else '' end as text from supplier""")
cte("facts", """
select s_suppkey as answer_id, 'sharpe_ratio' as field, (s_suppkey%4)+(s_suppkey%10)/10.0+case when s_suppkey%5=0 then 0.5 else 0 end as value from supplier union all select s_suppkey, 'max_drawdown', -(s_suppkey%30)/100.0 from supplier union all select s_suppkey, 'alpha', 0.05 from supplier
union all select s_suppkey, 'avg_raw_turnover', 0.3 from supplier where s_suppkey%2=0 union all select s_suppkey, 'avg_filtered_turnover', 0.25 from supplier where s_suppkey%4=0""")


def _answers(t):
    k = F.col("s_suppkey")
    s = lambda c: c.cast("string")
    tail = F.when(k % 3 == 0, ". This might be unclear, perhaps; data not available.").when(k % 3 == 1, " (from pnl, source: audit)").otherwise("")
    js = F.when(k % 7 == 0, F.concat(F.lit(' ```json {"confidence": 0.6'), s(k % 10), F.lit("} ```"))).otherwise("")
    return t.raw("supplier").select(k.alias("answer_id"), F.concat(
        F.lit("Sharpe ratio of "), s(k % 4), F.lit("."), s(k % 10), F.lit(", max drawdown: -"), s(k % 30), F.lit("% and alpha = 0.0"), s(k % 9),
        F.lit(". Hit rate = "), s(k % 90), F.lit("%, turnover of 0."), s(10 + k % 80), tail, js).alias("text"))


def _facts(t):
    k, sp = F.col("s_suppkey"), t.raw("supplier")
    f = lambda name, v, cond=F.lit(True): sp.where(cond).select(k.alias("answer_id"), F.lit(name).alias("field"), v.cast("double").alias("value"))
    return (f("sharpe_ratio", (k % 4) + (k % 10) / 10.0 + F.when(k % 5 == 0, 0.5).otherwise(0.0)).unionByName(f("max_drawdown", -(k % 30) / 100.0))
            .unionByName(f("alpha", F.lit(0.05))).unionByName(f("avg_raw_turnover", F.lit(0.3), k % 2 == 0))
            .unionByName(f("avg_filtered_turnover", F.lit(0.25), k % 4 == 0)))


cte("claims", f"""
select answer_id, pos, label, hint, claimed from (select answer_id, pos, label, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(label,'\\s+','_','g'),'-','_'),'_of$',''),'_is$',''),'_ratio$',''),'_score$',''),'_rate$',''),'_') as hint, v as claimed from (
 select answer_id, pos, lower(regexp_replace(trim(l),'[=: ]+$','')) as label, case when contains(v,'%') then cast(replace(v,'%','') as double)/100 else cast(v as double) end as v from (
 select answer_id, unnest(range(len(ls))) as pos, unnest(ls) as l, unnest(vs) as v from (select answer_id, regexp_extract_all(b,'{TX.CLAIM_PATTERN}',1) as ls, regexp_extract_all(b,'{TX.CLAIM_PATTERN}',2) as vs from (
  select answer_id, trim(regexp_replace(text,'```json[\\s\\S]*?```','','i')) as b from answers)))))""", "answers")


@query("extracted_claims", "T6", "select answer_id, pos, label, hint, round(claimed,6) as claimed from claims", "claims")
def _(t):
    return TX.extract_claims(_answers(t)).select("answer_id", "pos", "label", "hint", F.round("claimed", 6).alias("claimed"))


@query("checked_claims", "T6 J22", """
, al as (select * from (values """ + ", ".join(f"('{h}','{a}',{i + 1})" for h, ns in TX.ALIASES.items() for i, a in enumerate(ns)) + """) v(hint, field, prio)),
 look as (select answer_id, pos, arg_min(value,prio) as actual from (select answer_id, pos, hint as field, 0 as prio from claims union all select answer_id, pos, field, prio from claims join al using (hint)) join facts using (answer_id, field) group by 1,2)
select answer_id, pos, hint, round(actual,6) as actual, coalesce(case when abs(actual)>1e-6 then abs(claimed-actual)/abs(actual) else abs(claimed-actual) end<=0.0512,true) as passed from claims left join look using (answer_id, pos)""", "claims facts")
def _(t):
    c = TX.check_claims(TX.extract_claims(_answers(t)), _facts(t), "answer_id", 0.0512)
    return c.select("answer_id", "pos", "hint", F.round("actual", 6).alias("actual"), "passed")


@query("answer_confidence", "T7", f"""
select answer_id, confidence, confidence<0.70 as disclaimer from (select answer_id, coalesce(case when contains(text,'```json') then cast(regexp_extract(text,'"confidence": ([0-9.]+)',1) as double) end,
 round(greatest(0.3,least(0.95,0.8-0.05*least(4,{'+'.join(f"cast(contains(lower(text),'{v}') as int)" for v in TX.VAGUE)})+0.03*least(3,{'+'.join(f"cast(contains(lower(text),'{v}') as int)" for v in TX.CITED)}))),3)) as confidence from answers)""", "answers")
def _(t):
    return TX.answer_confidence(_answers(t)).select("answer_id", "confidence", "disclaimer")


@query("last_turns", "T8 K4", """
select conv_id, turn, question, answer from (select *, row_number() over (partition by conv_id order by turn desc) as rn from (select conv_id, turn, role, left(text,300) as question, left(case when lead(role) over w='assistant' then lead(text) over w else '' end,500) as answer
 from conversations window w as (partition by conv_id order by turn)) where role='user') where rn<=5""", "")
def _(t):
    return TX.last_turns(t.raw("conversations"))


# ---- metric store ----
@query("metrics_latest_rows", "S9", "select factor, d, ic from (select factor, d, ic, row_number() over (partition by factor, d order by run desc) as rn from (select *, 1 as run from ic union all select factor, d, ic/2, 2 from ic where d>=date '2024-01-16')) where rn=1", "ic")
def _(t):
    h = t.ic.withColumn("run", F.lit(1)).unionByName(t.ic.where("d >= date '2024-01-16'").select("factor", "d", (F.col("ic") / 2).alias("ic"), F.lit(2).alias("run")))
    return MS.latest_view(h, ["factor", "d"], "run").drop("run")


@query("factor_ic_snapshot", "S9", "select factor, round(ic_ir*sqrt(n),4) as t_stat, n from icsum", "icsum")
def _(t):
    from alphaloom.operators.ic import ic_summary
    return MS.factor_ic_snapshot(ic_summary(t.ic)).select("factor", F.round("t_stat", 4).alias("t_stat"), "n")


@query("latest_per_factor", "J14 S10", "select factor, d, ic from ic where (factor, d) in (select factor, max(d) from ic group by factor)", "ic")
def _(t):
    return MS.latest_per_factor(t.ic)


@query("recent_pnl", "K2 S8", "select d, round(ret,8) as ret from (select d, avg(ret) as ret from curves group by d) order by d desc limit 30", "curves")
def _(t):
    return MS.keep_last(t.curves.groupBy("d").agg(F.avg("ret").alias("ret")), 30, "d").select("d", F.round("ret", 8).alias("ret"))


@query("bounded_history", "S8", "select factor, d, ic from (select *, row_number() over (partition by factor order by d desc) as rn from ic) where rn<=24", "ic")
def _(t):
    return MS.keep_last(t.ic, 24, "d", ["factor"])


@query("audit_month", "K7", "select k, reb_d from reb where strftime(reb_d,'%Y-%m')='1998-06' order by reb_d limit 5", "reb")
def _(t):
    from alphaloom.operators import trading_calendar as TC
    a = TC.rebalance_calendar(TC.trading_days(t.calm), 21).select("k", F.col("reb_d"))
    return MS.month_rows(a, "1998-06", "reb_d")


@query("audit_backfill", "S13", """
select k, reb_d, coalesce(p.period_return, case when k%2=0 then 0.5 end) as v from (select r.k, r.reb_d from reb r) left join (select k, round(0.001*k,6) as period_return from reb where reb_d>=date '1998-01-01') p using (k)""", "reb")
def _(t):
    from alphaloom.operators import trading_calendar as TC
    a = TC.rebalance_calendar(TC.trading_days(t.calm), 21).select("k", "reb_d", F.when(F.col("k") % 2 == 0, 0.5).alias("v"))
    new = a.where("reb_d >= date '1998-01-01'").select("k", F.round(0.001 * F.col("k"), 6).alias("v"))
    return MS.fill_audit(a, new, ["k"])


@query("table_version", "S12", """
select o_orderstatus, left(sha256(concat_ws('|', sum(a)::varchar, sum(b)::varchar, count(*)::varchar)),12) as data_version from (
 select o_orderstatus, ('0x'||substr(h,1,12))::hugeint as a, ('0x'||substr(h,13,12))::hugeint as b from (select o_orderstatus, sha256(concat_ws('|', coalesce('='||o_custkey, 'null'), coalesce('='||strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'null'),
  coalesce('='||o_orderkey, 'null'), coalesce('='||o_orderpriority, 'null'), coalesce('='||o_orderstatus, 'null'), coalesce('='||cast(o_totalprice as decimal(38,6)), 'null'))) as h from orders)) group by o_orderstatus""")
def _(t):
    return MS.data_version(t.raw("orders"), "o_orderstatus")


@query("load_bars_report", "S1 S2 U6", "select upper(cast(ticker as varchar)) as ticker, count(*) as n from bars_brand where close is not null group by ticker having count(*)>=30", "bars_brand")
def _(t):
    from alphaloom.sources.readers import tidy_bars
    return tidy_bars(t.bars_brand).groupBy("ticker").agg(F.count("*").alias("n"))
