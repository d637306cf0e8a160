"""Readers that normalise external layouts to the long research tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.expr import nan_to_null


def tidy_bars(bars: DataFrame, min_bars: int = 30) -> DataFrame:
    """Drop missing prices, keep tickers with enough bars and a positive last price."""
    clean = (bars.select(F.upper(F.trim(F.col("ticker").cast("string"))).alias("ticker"), F.col("d").cast("date").alias("d"),
                         nan_to_null(F.col("close").cast("double")).alias("close"),
                         nan_to_null(F.col("volume").cast("double")).alias("volume"))
             .where("close is not null").dropDuplicates(["ticker", "d"]))
    ok = (clean.groupBy("ticker").agg(F.count("*").alias("n"), F.max_by("close", "d").alias("last"))
          .where((F.col("n") >= min_bars) & (F.col("last") > 0)).select("ticker"))
    return clean.join(ok, "ticker", "left_semi")


def wide_to_long(wide: DataFrame, date_col: str, sep: str = "_", field_first: bool = True) -> DataFrame:
    """Two-level wide columns (Close_AAA / AAA_Close) to long bars; one scan."""
    cols = [c for c in wide.columns if c != date_col]

    def split(c: str) -> tuple[str, str]:
        a, b = c.split(sep, 1) if field_first else c.rsplit(sep, 1)
        return (a, b) if field_first else (b, a)
    wanted = [c for c in cols if split(c)[0].lower() in ("close", "volume")]
    long = wide.unpivot([date_col], wanted, "__c", "__v")
    kv = [F.when(F.col("__c") == c, F.struct(F.lit(split(c)[0].lower()).alias("f"), F.lit(split(c)[1]).alias("t"))) for c in wanted]
    tagged = long.select(F.col(date_col).alias("d"), F.coalesce(*kv).alias("__k"), "__v")
    return tagged.groupBy(F.col("__k.t").alias("ticker"), "d").agg(
        F.max(F.when(F.col("__k.f") == "close", F.col("__v"))).alias("close"),
        F.max(F.when(F.col("__k.f") == "volume", F.col("__v"))).alias("volume"))


def load_bars(spark: SparkSession, path: str, layout: str = "long", fmt: str = "parquet",
              date_col: str = "d", ticker: str | None = None, min_bars: int = 30) -> DataFrame:
    """Bars from any of the layouts: long, field_ticker, ticker_field or flat (one ticker)."""
    raw = spark.read.format(fmt).option("header", "true").load(path)
    if layout == "field_ticker":
        raw = wide_to_long(raw, date_col, field_first=True)
    elif layout == "ticker_field":
        raw = wide_to_long(raw, date_col, field_first=False)
    elif layout == "flat":
        raw = raw.select(F.lit(ticker).alias("ticker"), F.col(date_col).alias("d"),
                         F.col("Close").alias("close"), F.col("Volume").alias("volume"))
    elif layout != "long":
        raise ValueError(f"unknown layout {layout!r}")
    return tidy_bars(raw, min_bars)


def load_corporate_actions(splits: DataFrame, dividends: DataFrame, curated: DataFrame, overrides: DataFrame) -> DataFrame:
    """Four event sources to one table; the earlier source wins a (ticker, date, type).

    Only the last twenty dividends per ticker are kept.
    """
    recent = W.partitionBy("ticker").orderBy(F.desc("d"))
    div = dividends.withColumn("__rn", F.row_number().over(recent)).where("__rn <= 20").drop("__rn")
    parts = [s.withColumn("src", F.lit(i)) for i, s in enumerate((splits, div, curated, overrides))]
    u = parts[0]
    for s in parts[1:]:
        u = u.unionByName(s)
    first = W.partitionBy("ticker", "d", "type").orderBy("src")
    return u.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def load_news(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {ticker, title, published_at}; items without both fields drop."""
    raw = spark.read.schema("ticker string, title string, published_at string").json(path)
    ts = F.try_to_timestamp(F.regexp_replace("published_at", "Z$", "+00:00"))
    return raw.select("ticker", F.col("title").alias("text"), ts.alias("published_at")).where(
        "trim(text) <> '' and published_at is not null")


def read_fresh_bars(spark: SparkSession, path: str, ttl_hours: float = 24.0) -> DataFrame:
    """Only entries loaded within the time-to-live (filter reaches the scan)."""
    limit = F.current_timestamp() - F.make_dt_interval(mins=F.lit(int(ttl_hours * 60)))
    return spark.read.parquet(path).where(F.col("loaded_at") > limit)


def write_bars(bars: DataFrame, path: str, loaded_at: Column | None = None) -> None:
    """Append bars partitioned by year, stamped with the load time (now, unless given).

    Ranges of (year, ticker), not whole years, are dealt to tasks, so a year with many bars has several files.
    """
    stamp = F.current_timestamp() if loaded_at is None else loaded_at
    (bars.withColumn("year", F.year("d")).withColumn("loaded_at", stamp)
     .repartitionByRange("year", "ticker").sortWithinPartitions("year", "ticker", "d")
     .write.mode("append").partitionBy("year").parquet(path))


def compact_bars(spark: SparkSession, path: str, target: str, now: Column, ttl_hours: float = 24.0) -> DataFrame:
    """Write the live entries of a store to a new one and return it: neither stale nor superseded by a later load.

    The old store is left as it is, so jobs that read it meanwhile end undisturbed; delete it when they are done.  A new
    folder is required, so a run that was interrupted is repeated under another name.  Of entries of a (ticker, d) loaded at
    the same time, the one with the greater close and then volume stays; entries without a load time are stale.
    """
    entries = spark.read.parquet(path)
    live = entries.where(F.unix_micros("loaded_at") >= F.unix_micros(now) - F.lit(int(ttl_hours * 3.6e9)))
    rest = [c for c in entries.columns if c not in ("ticker", "d", "year", "loaded_at", "close", "volume")]
    # a maximum has partial sums, so reloaded bars shrink before the shuffle
    newest = live.groupBy("year", "ticker", "d").agg(F.max(F.struct("loaded_at", "close", "volume", *rest)).alias("e"))
    out = newest.select("ticker", "d", *[F.col(f"e.{c}").alias(c) for c in ("close", "volume", *rest, "loaded_at")], "year")
    out.repartitionByRange("year", "ticker").sortWithinPartitions("year", "ticker", "d").write.mode("errorifexists").partitionBy("year").parquet(target)
    return spark.read.schema(out.schema).parquet(target)


def cache_stats(entries: DataFrame, now, ttl_hours: float = 24.0) -> DataFrame:
    """Entry, fresh and stale counts of a stamped table."""
    age = (F.unix_micros(now) - F.unix_micros("loaded_at")) / 3.6e9
    return entries.agg(F.count("*").alias("entries"), F.count_if(age <= ttl_hours).alias("fresh"),
                       F.count_if(age > ttl_hours).alias("stale"))
