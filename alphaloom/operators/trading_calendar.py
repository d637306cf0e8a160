"""Trading dates, rebalance grid and point-in-time probes of daily tables.

The calendar has one row per date and is the only thing windowed globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.expr import blackout


def trading_days(bars: DataFrame) -> DataFrame:
    """Distinct dates with a 0-based index."""
    days = bars.select("d").distinct()
    return days.select("d", (F.row_number().over(W.orderBy("d")) - 1).alias("idx"))


def weekday_calendar(bounds: DataFrame) -> DataFrame:
    """Weekdays between ``lo`` and ``hi`` (one-row input), when no bars exist."""
    return bounds.select(F.explode(F.sequence("lo", "hi")).alias("d")).where(F.weekday("d") < 5)


def rebalance_calendar(days: DataFrame, step: int, warmup: int = 100) -> DataFrame:
    """Every ``step``-th date from max(warmup, step), stopping ``step`` before the end.

    Columns reb_d, idx (calendar index) and k (0-based rebalance number).
    """
    start = max(warmup, step)
    n = F.max("idx").over(W.partitionBy()) + 1
    return (days.withColumn("__n", n)
            .where((F.col("idx") >= start) & (F.col("idx") < F.col("__n") - step)
                   & ((F.col("idx") - start) % step == 0))
            .select(F.col("d").alias("reb_d"), "idx", ((F.col("idx") - start) / step).cast("int").alias("k")))


def served_rebalances(rows: DataFrame, days: DataFrame, reb: DataFrame, step: int, warmup: int = 100) -> DataFrame:
    """rows + ``__from``, ``__to``: the rebalances for which a row is its ticker's latest one strictly before (none if from > to).

    A row is current from its own date until the ticker's next row, so the
    rebalance numbers it serves follow from calendar indices by arithmetic;
    there is no range join and nothing is paired that is not in the result.
    """
    start = max(warmup, step)
    w = W.partitionBy("ticker").orderBy("d")
    # calendar tables hold one row per date: broadcasting them is bounded
    at = rows.join(F.broadcast(days), "d").withColumn("__next", F.lead("idx").over(w))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") + 1 - start) / F.lit(step))).cast("int")
    last = F.floor((F.col("__next") - start) / F.lit(step)).cast("int")
    kmax = reb.agg(F.max("k").alias("__kmax"))
    at = (at.withColumn("__one", F.lit(1)).join(F.broadcast(kmax.withColumn("__one", F.lit(1))), "__one").drop("__one")
          .withColumn("__from", first)
          .withColumn("__to", F.least(F.coalesce(last, F.col("__kmax")), F.col("__kmax"))))
    return at.drop("__next", "__kmax", "idx")


def at_rebalances(served: DataFrame, reb: DataFrame) -> DataFrame:
    """A row for each rebalance that a row serves, with its number and date."""
    hit = served.where("__from <= __to").withColumn("k", F.explode(F.sequence("__from", "__to")))
    return hit.drop("__from", "__to").join(F.broadcast(reb.select("k", "reb_d")), "k")


def probe_at_rebalance(rows: DataFrame, days: DataFrame, reb: DataFrame, step: int, warmup: int = 100) -> DataFrame:
    """Latest row per ticker strictly before each rebalance date."""
    return at_rebalances(served_rebalances(rows, days, reb, step, warmup), reb)


def blackout_calendar(dates: DataFrame, types=("fomc", "triple_witching", "index_rebalance", "opex")) -> DataFrame:
    reasons, scale = blackout("d", types)
    return dates.select("d", reasons.alias("reasons"), scale.alias("scale")).withColumn(
        "is_blackout", F.size("reasons") > 0)


def upcoming_blackouts(anchors: DataFrame, days_ahead: int = 10, types=("fomc", "triple_witching", "index_rebalance")) -> DataFrame:
    """Blackout dates within the next N days of each anchor date."""
    span = anchors.select(F.col("d").alias("anchor"), F.explode(F.sequence("d", F.date_add("d", days_ahead - 1))).alias("d"))
    reasons, scale = blackout("d", types)
    return span.select("anchor", "d", reasons.alias("reasons"), scale.alias("scale")).where(F.size("reasons") > 0)
