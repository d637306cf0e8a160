"""Streaming operators drained over the given tables, with batch twins in SQL."""

from pyspark.sql import functions as F

from alphaloom.catalog.base import query
from alphaloom.catalog.ctes import cte
from alphaloom.streaming import io
from alphaloom.streaming import stateful as ST
from alphaloom.streaming import windows as WN


def _ticks(t):
    return WN.ticks(io.file_stream(t.spark, f"{t.root}/events.parquet"))


def _ordered(t):
    return _ticks(t).withColumnRenamed("event_id", "seq")


cte("wm", "select max(ts) - interval '1' hour as w from events")
# the state machines run to the last event, in milliseconds
cte("stop", "select max(epoch_ms(ts)) as ms from events")


@query("stream_bars", "ST1", """
select user_id as ticker, cast(cast(ts as date) as timestamp) as start, arg_min(value,ts) as open, max(value) as high, min(value) as low, arg_max(value,ts) as close, count(*) as volume from events
group by user_id, cast(ts as date) having cast(ts as date) + interval '1' day <= (select w from wm)""", "wm")
def _(t):
    return io.drain(WN.bars(_ticks(t)), "bars")


@query("stream_rolling_monitor", "ST2", """
select user_id as ticker, s as start, round(avg(value)*count(*),2) as total, round(stddev_pop(value),4) as vol, count(*) as n from (select user_id, value, unnest(range(cast(ts as date) - interval '4' day, cast(ts as date) + interval '1' day, interval '1' day)) as s from events)
group by user_id, s having s + interval '5' day <= (select w from wm)""", "wm")
def _(t):
    x = io.drain(WN.rolling_monitor(_ticks(t)), "monitor")
    return x.select("ticker", "start", F.round(F.col("avg_price") * F.col("n"), 2).alias("total"), F.round("vol", 4).alias("vol"), "n")


@query("stream_sessions", "ST3", """
select ticker, min(ts) as start, max(ts) + interval '30' minute as "end", count(*) as n from (select user_id as ticker, ts, sum(b) over (partition by user_id order by ts, event_id) as g from (
 select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30' minute then 0 else 1 end as b from events)) group by ticker, g having max(ts) + interval '30' minute <= (select w from wm)""", "wm")
def _(t):
    return io.drain(WN.sessions(_ticks(t)), "sessions")


@query("stream_fill_match", "ST4", """
, wm2 as (select least(max(d), max(case when fill_price is not null then d end) + interval '30' minute) - interval '1' hour as w from executions)
select trade_id, side, round(case when side='buy' then fill_price-arrival_price else arrival_price-fill_price end/arrival_price*1e4,4) as slippage_bps, fill_price is not null as filled
from executions where fill_price is not null or d + interval '2' hour < (select w from wm2)""", "executions")
def _(t):
    ex = io.file_stream(t.spark, f"{t.root}/orders.parquet")
    k, px = F.col("o_orderkey"), F.col("o_totalprice")
    a = ex.select(k.alias("trade_id"), F.when(F.col("o_custkey") % 2 == 0, "buy").otherwise("sell").alias("side"), px.alias("arrival_price"),
                  F.col("o_orderdate").cast("timestamp").alias("ts"))
    f = io.file_stream(t.spark, f"{t.root}/orders.parquet").where("o_orderstatus <> 'P'").select(
        k.alias("trade_id"), (px * (1.0 + (k % 21 - 10) / 1000.0)).alias("fill_price"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 minutes")).alias("ts"))
    return io.drain(WN.match_fills(a, f), "fills").select("trade_id", "side", F.round("slippage_bps", 4).alias("slippage_bps"), "filled")


@query("stream_position_exits", "ST5 UD5", """
, q as (select user_id as ticker, ts, value as price, row_number() over (partition by user_id order by ts, event_id) as j from events where value>0)
select ticker, entry_ts, exit_ts, round(entry_price,4) as entry_price, round(exit_price,4) as exit_price, round(peak_price,4) as peak_price, reason from (
 with recursive st as (
  select ticker, j, price as entry, price as peak, ts as opened, price as last, cast(null as timestamp) as entry_ts, cast(null as timestamp) as exit_ts, cast(null as double) as entry_price, cast(null as double) as exit_price, cast(null as double) as peak_price, cast(null as varchar) as reason from q where j=1
  union all
  select ticker, j, case when timer or entry is null then price when why is null then entry end, case when timer or entry is null then price when why is null then pk end, case when timer or entry is null then ts when why is null then opened end, price,
   case when timer or why is not null then opened end, case when timer then opened + interval '1440' hour when why is not null then ts end, case when timer or why is not null then entry end,
   case when timer then last when why is not null then price end, case when timer then peak when why is not null then pk end, case when timer then 'max_hold' else why end
  from (select *, case when not timer and entry is not null and epoch_us(ts)-epoch_us(opened)>=72*3600000000 then case when epoch_us(ts)-epoch_us(opened)>=1440*3600000000 then 'max_hold' when (price-entry)/entry>=0.12 then 'profit_target' when (price-entry)/entry<=-0.05 then 'stop_loss' end end as why
   from (select q.ticker, q.j, q.ts, q.price, st.entry, st.opened, st.last, st.peak, greatest(st.peak, q.price) as pk, coalesce(epoch_us(q.ts)-epoch_us(st.opened)>1440*3600000000, false) as timer from st join q on q.ticker=st.ticker and q.j=st.j+1)))
 select ticker, entry_ts, exit_ts, entry_price, exit_price, peak_price, reason from st where reason is not null
 union all select ticker, opened, opened + interval '1440' hour, entry, last, peak, 'max_hold' from (select * from st qualify row_number() over (partition by ticker order by j desc)=1)
  where entry is not null and epoch_ms(opened + interval '1440' hour)<=(select ms from stop))""", "stop")
def _(t):
    x = ST.settled(_ordered(t), ST.position_exits, "exits")
    return x.select("ticker", "entry_ts", "exit_ts", *[F.round(c, 4).alias(c) for c in ("entry_price", "exit_price", "peak_price")], "reason")


@query("stream_circuit_breaker", "ST6 UD5", """
, q as (select user_id as series_id, ts, 100+value as value, row_number() over (partition by user_id order by ts, event_id) as j from events)
select series_id, ts, value, decision from (with recursive st as (
 select series_id, ts, j, value, value as peak, timestamp '1970-01-01' as until, 'ok' as decision from q where j=1
 union all select series_id, ts, j, value, pk, case when ts<until then until when loss then ts + interval '24' hour when dd then ts + interval '720' hour else until end,
  case when ts<until then 'halted' when loss then 'daily_loss' when dd then 'max_drawdown' else 'ok' end
 from (select q.series_id, q.ts, q.j, q.value, greatest(st.peak,q.value) as pk, st.until, (q.value-st.value)/st.value<-0.10 as loss, (q.value-greatest(st.peak,q.value))/(greatest(st.peak,q.value)+1e-10)<-0.20 as dd
  from st join q on q.series_id=st.series_id and q.j=st.j+1)) select * from st)""", "")
def _(t):
    v = _ordered(t).select(F.col("ticker").alias("series_id"), "ts", "seq", (100 + F.col("price")).alias("value"))
    return ST.settled(v, lambda x: ST.circuit_breaker(x, 0.10, 0.20), "breaker")


@query("stream_factor_health", "ST7 UD5", """
, q as (select event_type as factor, ts, value/100.0-0.3 as ir, row_number() over (partition by event_type order by ts, event_id) as j from events)
select factor, ts, fails, off as disabled from (with recursive st as (
  select factor, ts, j, case when ir<0.1 then 1 else 0 end as fails, false as off from q where j=1
  union all select q.factor, q.ts, q.j, case when q.ir<0.1 then st.fails+1 else greatest(0,st.fails-1) end,
   case when (case when q.ir<0.1 then st.fails+1 else greatest(0,st.fails-1) end)>=3 then true when q.ir>0.15 then false else st.off end
  from st join q on q.factor=st.factor and q.j=st.j+1) select * from st)""", "")
def _(t):
    e = io.file_stream(t.spark, f"{t.root}/events.parquet").select(
        F.col("event_type").alias("factor"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 100.0 - 0.3).alias("ic_ir"), F.lit(6).alias("n"), F.col("event_id").alias("seq"))
    return ST.settled(e, ST.factor_health, "health")


@query("stream_live_ic", "ST8", """
, sg as (select o_orderkey, o_custkey%10 as ticker, cast(o_orderdate as date) as sd, o_totalprice as score from orders where cast(o_orderdate as date)+21<=date '2001-11-04'),
 f as (select s.o_orderkey, s.sd, s.score, round(b.close/a.close-1,6) as ret from sg s asof join bars a on a.ticker=s.ticker and a.d>=s.sd asof join bars b on b.ticker=s.ticker and b.d>=s.sd+21)
select sd as signal_date, count(*) as n, round(case when count(*)>=5 then corr(rx,ry) end,4) as ic from (select *, rank() over (partition by sd order by score)+(count(*) over (partition by sd, score)-1)/2.0 as rx,
 rank() over (partition by sd order by ret)+(count(*) over (partition by sd, ret)-1)/2.0 as ry from f) group by sd""", "bars")
def _(t):
    from alphaloom.sources.storage import scratch_path
    bars = t.bars
    s = io.file_stream(t.spark, f"{t.root}/orders.parquet").select(
        (F.col("o_custkey") % 10).alias("ticker"), F.col("o_orderdate").cast("date").alias("signal_date"), F.col("o_totalprice").alias("score")
    ).withColumn("fwd_due_date", F.date_add("signal_date", 21))
    out = scratch_path(t.spark, "live-ic")
    ST.fill_due_signals(s, bars, F.lit("2001-11-04").cast("date"), out)
    return ST.live_ic(t.spark.read.parquet(out)).select("signal_date", "n", F.round("ic", 4).alias("ic"))


@query("stream_staleness", "ST9 UD5", """
, g as (select user_id as ticker, ts, lead(ts) over (partition by user_id order by ts, event_id) as nxt, ts + case when dayofweek(ts + interval '12' hour)=1 then 24 else 12 end * interval '1' hour as due from events)
select ticker, ts as last_ts, due as alert_ts from g where nxt > due or nxt is null and epoch_ms(due) <= (select ms from stop)""", "stop")
def _(t):
    return ST.settled(_ordered(t), lambda x: ST.staleness_alerts(x, 12.0, 24.0), "stale")


@query("stream_dedupe", "ST10", "select event_id, user_id as ticker, value as price from events", "")
def _(t):
    both = _ticks(t).unionByName(_ticks(t))
    return io.drain(WN.dedupe(both, ["event_id"]), "dedupe").select("event_id", "ticker", "price")
