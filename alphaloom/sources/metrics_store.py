"""Metric tables with keyed upserts, history views and exports.

Writes append; the current state is a view taking the newest row per key, so
concurrent writers never rewrite each other's files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_view(history: DataFrame, keys: list[str], stamp: str = "calc_timestamp", tie: list[str] | None = None) -> DataFrame:
    """Newest row per unique key (insert-or-replace semantics)."""
    w = W.partitionBy(*keys).orderBy(F.desc(stamp), *[F.desc(t) for t in (tie or [])])
    return history.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def append_snapshot(rows: DataFrame, path: str, run_id: str, version: Column | str, partition: str | None = None) -> None:
    """Stamp rows with run, data version and time, and append them."""
    v = F.lit(version) if isinstance(version, str) else version
    out = rows.withColumn("run_id", F.lit(run_id)).withColumn("data_version", v).withColumn("calc_timestamp", F.current_timestamp())
    w = out.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def factor_ic_snapshot(summary: DataFrame) -> DataFrame:
    """IC summary rows with the t-statistic ir * sqrt(n)."""
    return summary.withColumn("t_stat", F.col("ic_ir") * F.sqrt("n"))


def data_version(df: DataFrame, key: str | None = None) -> DataFrame:
    """12-hex content version of a table (per ``key`` when given).

    Rows are hashed where they are; the version is the hash of the sum and count of the row hashes, so nothing is sorted
    or gathered.  A row is spelled out column by column in order of name: numbers with a fraction to six digits, others as
    Spark casts them, nulls as a mark of their own.
    """
    def spelled(c: str, kind: str):
        x = F.col(c).cast("decimal(38,6)") if kind in ("double", "float") else F.col(c)
        return F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("null"))
    row = F.sha2(F.concat_ws("|", *[spelled(c, k) for c, k in sorted(df.dtypes)]), 256)
    part = lambda i: F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    g = (df.groupBy(key) if key else df.groupBy()).agg(F.sum(part(0)).alias("a"), F.sum(part(1)).alias("b"), F.count("*").alias("c"))
    v = F.left(F.sha2(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), F.col("c").cast("string")), 256), F.lit(12))
    return g.select(*([key] if key else []), v.alias("data_version"))


def keep_last(history: DataFrame, n: int, order: str, keys: list[str] | None = None) -> DataFrame:
    """Last ``n`` rows, overall or per key (the bounded state files)."""
    if not keys:
        return history.orderBy(F.desc(order)).limit(n)
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return history.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def latest_per_factor(ic: DataFrame) -> DataFrame:
    """Rows of each factor's newest date (semi-join on the grouped maximum)."""
    top = ic.groupBy("factor").agg(F.max("d").alias("d"))
    return ic.join(top, ["factor", "d"], "left_semi")


def month_rows(audit: DataFrame, month: str, order: str = "d", n: int = 5) -> DataFrame:
    """First rows of a month; the last rows overall when the month has none."""
    hit = audit.where(F.date_format(order, "yyyy-MM") == month).orderBy(order).limit(n)
    none = audit.where(F.date_format(order, "yyyy-MM") == month).limit(1).select(F.lit(1).alias("__x"))
    last = audit.orderBy(F.desc(order)).limit(n).withColumn("__one", F.lit(1))
    gate = none.groupBy().agg(F.count("*").alias("__c")).withColumn("__one", F.lit(1))
    return hit.unionByName(last.join(gate, "__one").where("__c = 0").drop("__one", "__c"))


def fill_audit(audit: DataFrame, realised: DataFrame, keys: list[str]) -> DataFrame:
    """Back-fill realised columns on existing records; known values are replaced only by non-null ones."""
    extra = [c for c in realised.columns if c not in keys]
    r = realised.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in extra])
    j = audit.join(r, keys, "left")
    for c in extra:
        j = j.withColumn(c, F.coalesce(F.col(f"__n_{c}"), F.col(c)) if c in audit.columns else F.col(f"__n_{c}"))
    return j.drop(*[f"__n_{c}" for c in extra])


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def daily_export(pnl: DataFrame, ic: DataFrame, regime: DataFrame, root: str, n: int = 30) -> None:
    """Latest P&L rows, newest IC per factor and current regime as JSON tables."""
    export_json(pnl.orderBy(F.desc("d")).limit(n), f"{root}/pnl")
    export_json(latest_per_factor(ic), f"{root}/factor_ic")
    export_json(regime.orderBy(F.desc("d")).limit(1), f"{root}/regime")
