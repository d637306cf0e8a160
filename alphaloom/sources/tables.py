"""Adapters from the generic star schema to the research tables.

``Tables(spark, dir)`` exposes every table as a lazy DataFrame.  Daily bars are
aggregated from line items with map-side combine, which also bounds every
per-ticker series by the number of calendar days.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.sources.storage import plain_unions


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        plain_unions(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.raw("lineitem").withColumn("d", F.col("l_shipdate").cast("date"))

    @cached_property
    def dates(self) -> DataFrame:
        """The dates of the bars, from the line items: no series is put together for them."""
        return self.lineitem.select("d").distinct()

    @cached_property
    def bars(self) -> DataFrame:
        return self._bars(self.lineitem)

    @staticmethod
    def _bars(lineitem: DataFrame) -> DataFrame:
        return (lineitem.groupBy(F.col("l_suppkey").alias("ticker"), "d")
                .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
                     F.sum("l_quantity").alias("volume")))

    @cached_property
    def bars_brand(self) -> DataFrame:
        part = self.raw("part").select("p_partkey", "p_brand")
        # sums per part and day first: a part of any size shrinks to one row a day
        daily = self.lineitem.groupBy("l_partkey", "d").agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("qty"))
        return (daily.join(part, F.col("l_partkey") == F.col("p_partkey"))
                .groupBy(F.col("p_brand").alias("ticker"), "d")
                .agg((F.sum("amount") / F.sum("qty")).alias("close"), F.sum("qty").alias("volume")))

    @cached_property
    def sectors(self) -> DataFrame:
        return (self.raw("supplier")
                .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
                .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"),
                        (F.col("s_acctbal") * 1_000_000.0).alias("market_cap")))

    @cached_property
    def brand_sectors(self) -> DataFrame:
        """Three sectors over the brands, from the last digit of the name."""
        n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 3
        return (self.raw("part").select("p_brand").distinct()
                .select(F.col("p_brand").alias("ticker"), F.concat(F.lit("S"), n).alias("sector")))

    @cached_property
    def macro_series(self) -> DataFrame:
        """Six reference symbols, from one scan and one shuffle."""
        px = F.sum("l_extendedprice") / F.sum("l_quantity")
        li = self.lineitem
        tags = F.array_compact(F.array(
            F.lit("SPY"), F.lit("^VIX"),
            F.when(F.col("l_returnflag") == "A", F.lit("HYG")).when(F.col("l_returnflag") == "N", F.lit("IEF")),
            F.when(F.col("l_linenumber") % 2 == 0, F.lit("TLT")).otherwise(F.lit("SHY"))))
        return (li.select(F.explode(tags).alias("symbol"), "d", "l_extendedprice", "l_quantity", "l_discount")
                .groupBy("symbol", "d")
                .agg(px.alias("px"), (F.lit(400.0) * F.avg("l_discount")).alias("vix"))
                .select("symbol", "d", F.when(F.col("symbol") == "^VIX", F.col("vix")).otherwise(F.col("px")).alias("close")))

    @cached_property
    def fundamentals(self) -> DataFrame:
        rep = F.last_day(F.add_months(F.trunc(F.col("d"), "quarter"), 2))
        p, q = F.col("l_extendedprice"), F.col("l_quantity")
        g = (self.lineitem.groupBy(F.col("l_suppkey").alias("ticker"), rep.alias("report_date"))
             .agg(F.sum(p).alias("revenue"),
                  F.sum(p * (0.6 - F.col("l_discount"))).alias("gross_profit"),
                  F.sum(p * (0.2 - F.col("l_discount") - F.col("l_tax"))).alias("net_income"),
                  F.sum(F.when(F.col("l_linestatus") == "F", p * 0.2).otherwise(0.0)).alias("cfo"),
                  (F.sum(q) * 10.0).alias("capex")))
        assets = F.sum("revenue").over(W.partitionBy("ticker").orderBy("report_date")
                                       .rowsBetween(W.unboundedPreceding, 0))
        return (g.withColumn("available_date", F.date_add("report_date", 60))
                .withColumn("total_assets", assets)
                .withColumn("total_debt", F.col("revenue") * 0.5)
                .withColumn("equity", F.col("total_assets") - F.col("revenue") * 0.5)
                .withColumn("ebit", F.col("gross_profit") * 0.5)
                .withColumn("current_assets", F.col("revenue") * 0.8)
                .withColumn("current_liab", F.col("revenue") * 0.4 + F.col("capex")))

    @cached_property
    def membership_events(self) -> DataFrame:
        s, k = self.raw("supplier"), F.col("s_suppkey")
        add = s.where(k % 3 == 0).select(
            k.alias("ticker"), F.date_add(F.lit("1996-01-01").cast("date"), ((k * 37) % 900).cast("int")).alias("d"),
            F.lit("add").alias("action"))
        rem = s.where(k % 5 == 0).select(
            k.alias("ticker"), F.date_add(F.lit("1999-01-01").cast("date"), ((k * 53) % 700).cast("int")).alias("d"),
            F.lit("remove").alias("action"))
        return add.unionByName(rem)

    @cached_property
    def baseline(self) -> DataFrame:
        return self.raw("supplier").where(F.col("s_suppkey") % 3 != 0).select(F.col("s_suppkey").alias("ticker"))

    @cached_property
    def corporate_actions(self) -> DataFrame:
        s, k = self.raw("supplier"), F.col("s_suppkey")

        def ev(cond, start, step, kind, ratio, mult):
            day = F.lit(start).cast("date")
            d = F.date_add(day, ((k * step) % 365).cast("int")) if step else day
            return s.where(cond).select(k.alias("ticker"), d.alias("d"), F.lit(kind).alias("type"),
                                        F.lit(ratio).alias("ratio"), F.lit(mult).alias("price_multiplier"))
        return (ev(k % 4 == 0, "1997-01-01", 11, "split", 2.0, 0.5)
                .unionByName(ev(k % 2 == 1, "1998-03-15", 7, "dividend", 0.75, 1.0))
                .unionByName(ev(k % 9 == 0, "1999-05-04", 0, "spinoff", 1.0, 1.0))
                .unionByName(ev(k % 10 == 3, "2000-06-01", 0, "merger", 1.0, 0.0)))

    @cached_property
    def holders(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        per_order = self.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
        return (per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .groupBy(F.col("l_suppkey").alias("ticker"), F.col("o_custkey").alias("holder"))
                .agg(F.sum("q").alias("shares")))

    @cached_property
    def news(self) -> DataFrame:
        hrs = F.make_dt_interval(hours=(F.col("doc_id") % 72).cast("int"))
        return self.raw("documents").select(
            (F.col("doc_id") % 10).alias("ticker"), "text",
            (F.lit("2024-01-01 00:00:00").cast("timestamp") + hrs).alias("published_at"))

    @cached_property
    def executions(self) -> DataFrame:
        k, px = F.col("o_orderkey"), F.col("o_totalprice")
        return self.raw("orders").select(
            k.alias("trade_id"), (F.col("o_custkey") % 10).alias("ticker"),
            F.when(F.col("o_custkey") % 2 == 0, "buy").otherwise("sell").alias("side"),
            px.alias("arrival_price"),
            F.when(F.col("o_orderstatus") == "P", None)
            .otherwise(px * (1.0 + (k % 21 - 10) / 1000.0)).alias("fill_price"),
            F.col("o_orderdate").cast("date").alias("d"))

    @cached_property
    def lots(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_suppkey").alias("ticker"), F.col("d").alias("trade_date"),
            F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
            F.col("l_quantity").alias("shares"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            "l_orderkey", "l_linenumber", "l_partkey")

    @cached_property
    def curves(self) -> DataFrame:
        w = W.partitionBy("ticker").orderBy("d")
        r = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
        return (self.bars.select(F.col("ticker").alias("series_id"), "d", r.alias("r")).where("r is not null")
                .select("series_id", "d",
                        F.greatest(F.lit(-0.02), F.least(F.lit(0.02), F.col("r") / 50.0)).alias("ret")))

    @cached_property
    def calm(self) -> DataFrame:
        """Bars on a damped price path: 100 compounded by the clipped returns."""
        return self._calm(self.bars)

    def calm_of(self, names: DataFrame) -> DataFrame:
        """The same of some tickers: left out before bars are made, as Spark takes no join through the windows."""
        return self._calm(self._bars(self.lineitem.join(names.select(F.col("ticker").alias("l_suppkey")), "l_suppkey", "left_semi")))

    @staticmethod
    def _calm(bars: DataFrame) -> DataFrame:
        w = W.partitionBy("ticker").orderBy("d")
        r = bars.select("*", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("r"))
        # greatest/least skip NULLs, so the first bar is handled apart
        step = F.log(1 + F.greatest(F.lit(-0.02), F.least(F.lit(0.02), F.col("r") / 50.0)))
        path = F.sum(F.when(F.col("r").isNull(), 0.0).otherwise(step)).over(w.rowsBetween(W.unboundedPreceding, 0))
        return r.select("ticker", "d", (F.lit(100.0) * F.exp(path)).alias("close"), "volume")

    @cached_property
    def ic(self) -> DataFrame:
        return (self.raw("events").groupBy(F.col("event_type").alias("factor"), F.col("ts").cast("date").alias("d"))
                .agg(((F.sum("event_id") % 201 - 100) / 100.0).alias("ic")))

    @cached_property
    def ticks(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"),
                                         F.col("value").alias("price"), "event_id")
