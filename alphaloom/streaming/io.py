"""Stream sources and sinks used by the live operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from alphaloom.sources.storage import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet folder or single file as a stream with the schema of its files.

    The path is given as a pattern matching only itself: the file source takes
    a plain path for a folder and would refuse a file.
    """
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    path = path.rstrip("/")
    return r.parquet(f"{path[:-1]}[{path[-1]}]")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives off-heap and spills; needed by transformWithState."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> int | None:
    """Append all available input to a parquet table; the watermark reached, in milliseconds."""
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    try:
        q.awaitTermination()
        mark = (q.lastProgress or {}).get("eventTime", {}).get("watermark")
    finally:
        q.stop()
    return round(datetime.fromisoformat(mark).timestamp() * 1000) or None if mark else None


def drain(stream: DataFrame, label: str = "stream") -> DataFrame:
    """Process all available input into a parquet table and read it back."""
    out = scratch_path(stream.sparkSession, label)
    run_available(stream, out, scratch_path(stream.sparkSession, f"{label}-ck"))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, handle, checkpoint: str) -> None:
    """Run ``handle(batch_df, batch_id)`` over all available input."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
