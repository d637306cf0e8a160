"""Readers and sinks: given tables are written in each layout to the run's folder, read back and compared."""

from pyspark.sql import functions as F

from alphaloom.catalog.base import query
from alphaloom.catalog.ctes import cte
from alphaloom.operators import quality as Q
from alphaloom.sources import metrics_store as MS
from alphaloom.sources import readers as R
from alphaloom.sources.storage import scratch_path

cte("tidy", "select upper(cast(ticker as varchar)) as ticker, d, round(close,6) as close, cast(volume as double) as volume, count(*) over (partition by ticker) as n, arg_max(close,d) over (partition by ticker) as last from bars_brand where close is not null", "bars_brand")
_TIDY = "select ticker, d, close, volume from tidy where n>=30 and last>0"


def _rounded(df):
    return df.select("ticker", "d", F.round("close", 6).alias("close"), "volume")


def _brands(t):
    """Brand names as single words, so that they can be parts of column names."""
    return t.bars_brand.select("ticker", "d", F.col("close").alias("Close"), F.col("volume").cast("double").alias("Volume"))


def _wide(t, field_first: bool):
    b = _brands(t)
    names = [r["ticker"] for r in b.select("ticker").distinct().orderBy("ticker").collect()]       # brands: a fixed list
    cols = [(f"{f}_{n}" if field_first else f"{n}_{f}", f, n) for f in ("Close", "Volume") for n in names]
    return b.groupBy("d").agg(*[F.max(F.when(F.col("ticker") == n, F.col(f))).alias(c) for c, f, n in cols])


@query("load_field_ticker_bars", "S1", _TIDY, "tidy")
def _(t):
    path = scratch_path(t.spark, "bars-wide")
    _wide(t, True).write.parquet(path)
    return _rounded(R.load_bars(t.spark, path, "field_ticker"))


@query("load_ticker_field_bars", "S1", _TIDY, "tidy")
def _(t):
    path = scratch_path(t.spark, "bars-wide")
    _wide(t, False).write.parquet(path)
    return _rounded(R.load_bars(t.spark, path, "ticker_field"))


@query("load_flat_bars", "S1", _TIDY + " and ticker='BRAND#11'", "tidy")
def _(t):
    path = scratch_path(t.spark, "bars-flat")
    _brands(t).where("upper(ticker) = 'BRAND#11'").select("d", "Close", "Volume").write.option("header", "true").csv(path)
    return _rounded(R.load_bars(t.spark, path, "flat", "csv", ticker="Brand#11"))


@query("write_and_read_bars", "S2", "select ticker, d, round(close,6) as close, volume, year(d) as year from bars where close is not null", "bars")
def _(t):
    path = scratch_path(t.spark, "bars-store")
    R.write_bars(t.bars, path)
    return R.read_fresh_bars(t.spark, path).select("ticker", "d", F.round("close", 6).alias("close"), "volume", "year")


@query("bar_store_stats", "S2", "select count(*) as entries, count(*) as fresh, 0 as stale from bars", "bars")
def _(t):
    path = scratch_path(t.spark, "bars-store")
    R.write_bars(t.bars, path)
    return R.cache_stats(t.spark.read.parquet(path), F.current_timestamp())


@query("compacted_bars", "S2", """
select ticker, d, round(case when ticker%3=0 then close*2 else close end,6) as close, volume, year(d) as year, case when ticker%3=0 then 1 else 6 end as age_hours
from bars where close is not null and (ticker%3=0 or year(d)>=1998)""", "bars")
def _(t):
    """A store with entries of three days ago, of six hours ago, and for some tickers a later load with other prices."""
    old, new = scratch_path(t.spark, "bars-store"), scratch_path(t.spark, "bars-compacted")
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    ago = lambda h: now - F.make_dt_interval(hours=h if hasattr(h, "cast") else F.lit(h))
    bars = t.bars.where("close is not null")
    R.write_bars(bars, old, ago(F.when(F.year("d") < 1998, 72).otherwise(6)))
    R.write_bars(bars.where("ticker % 3 = 0").withColumn("close", F.col("close") * 2), old, ago(1))
    live = R.compact_bars(t.spark, old, new, now)
    age = ((F.unix_micros(now) - F.unix_micros("loaded_at")) / 3.6e9).cast("int")
    return live.select("ticker", "d", F.round("close", 6).alias("close"), "volume", "year", age.alias("age_hours"))


@query("load_news_items", "S7", """
select cast(ticker as varchar) as ticker, md5(text) as text_md5, published_at from news where trim(text)<>'' and ticker<>3""", "news")
def _(t):
    """Written as JSON lines; items of ticker 3 lack a date and drop out."""
    path = scratch_path(t.spark, "news")
    stamp = F.when(F.col("ticker") != 3, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    t.news.select(F.col("ticker").cast("string").alias("ticker"), F.col("text").alias("title"), stamp.alias("published_at")).write.json(path)
    return R.load_news(t.spark, path).select("ticker", F.md5("text").alias("text_md5"), "published_at")


@query("metric_snapshots", "S9", """
select factor, d, case when d>=date '2024-01-16' then ic/2 else ic end as ic, case when d>=date '2024-01-16' then 'b' else 'a' end as run_id from ic""", "ic")
def _(t):
    """Two runs are appended; the later one replaces rows with the same key."""
    path = scratch_path(t.spark, "factor-ic")
    MS.append_snapshot(t.ic, path, "a", "v1")
    MS.append_snapshot(t.ic.where("d >= date '2024-01-16'").withColumn("ic", F.col("ic") / 2), path, "b", "v2")
    return MS.latest_view(t.spark.read.parquet(path), ["factor", "d"]).select("factor", "d", "ic", "run_id")


@query("daily_json_export", "S10", """
select 'pnl' as item, cast(d as varchar) as name, round(ret,8) as value from (select d, avg(ret) as ret from curves group by d order by d desc limit 30)
union all select 'factor_ic', factor, round(ic,8) from ic where (factor, d) in (select factor, max(d) from ic group by factor)
union all select 'regime', cast(d as varchar), cast(k as double) from (select k, reb_d as d from reb order by reb_d desc limit 1)""", "curves ic reb")
def _(t):
    from alphaloom.operators import trading_calendar as TC
    root = scratch_path(t.spark, "export")
    pnl = t.curves.groupBy("d").agg(F.avg("ret").alias("ret"))
    regime = TC.rebalance_calendar(TC.trading_days(t.calm), 21).select(F.col("reb_d").alias("d"), "k")
    MS.daily_export(pnl, t.ic, regime, root)
    read = lambda name, key, value: t.spark.read.json(f"{root}/{name}").select(
        F.lit(name).alias("item"), F.col(key).cast("string").alias("name"), F.round(F.col(value).cast("double"), 8).alias("value"))
    return read("pnl", "d", "ret").unionByName(read("factor_ic", "factor", "ic")).unionByName(read("regime", "d", "k"))


@query("ic_row_validation", "S11", """
select case when factor is null then 'missing field: factor' when ic is null then 'missing field: mean_ic' when abs(ic)>1 then 'mean_ic out of [-1,1]' else 'good' end as verdict, count(*) as n
from (select case when day(d)=1 then null else factor end as factor, case when day(d)=2 then null when day(d)=3 and factor is not null then 2+ic else ic end as ic from ic) group by 1""", "ic")
def _(t):
    """Good rows and rows with errors, split as before they are stored."""
    day = F.dayofmonth("d")
    rows = t.ic.select(F.when(day != 1, F.col("factor")).alias("factor"), F.when(day == 3, 2 + F.col("ic")).when(day != 2, F.col("ic")).alias("mean_ic"))
    good, bad = Q.split_valid(Q.validate_ic(rows))
    both = good.select(F.lit("good").alias("verdict")).unionAll(bad.select(F.col("errors")[0]))
    return both.groupBy("verdict").agg(F.count("*").alias("n"))
