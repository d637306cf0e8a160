"""Shared-folder materialisation: cuts lineage and survives executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh temporary one only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own folder."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that the application has written to its folder; call it when no result is to be read any more."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plain_unions(spark: SparkSession) -> None:
    """Have unions deal their rows anew where they must be dealt.

    Spark 4.1 takes a union of parts that are dealt by the same keys to be dealt by them as well.  Adaptive execution may
    then merge the partitions of each part by its own sizes, and rows with equal keys meet in different tasks: an aggregate
    or a window over the union gives a group twice.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def stacked(first: DataFrame, *more: DataFrame, allow_missing: bool = False) -> DataFrame:
    """The rows of all parts, by name, whatever the parts are dealt by (see ``plain_unions``)."""
    plain_unions(first.sparkSession)
    for df in more:
        first = first.unionByName(df, allowMissingColumns=allow_missing)
    return first


def materialize(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write once as parquet in the shared folder and continue from the files."""
    path = scratch_path(df.sparkSession, label)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
