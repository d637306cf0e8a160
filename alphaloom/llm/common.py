"""Small helpers shared by the operators: tables, scratch tables, broadcasts of bounded files."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.sources.storage import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write once to the shared folder and go on from the files; cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    arrays = [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_resident: dict = {}


def vacate() -> None:
    """Give up what earlier tasks have kept in this worker, back to the system where the C library can."""
    if _resident:
        _resident.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def resident(key: tuple, make):
    """A worker's large object, kept from task to task; only the last one asked for stays in memory."""
    if key not in _resident:
        vacate()
        _resident[key] = make()
    return _resident[key]


def text_once(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, int]:
    """(doc_id, carried columns, text) with the text sent once, and the place of the text column."""
    twice = "text" in carry and dict(docs.dtypes)["text"] == "string"
    cols = [F.col("doc_id").cast("long").alias("__id"), *[F.col(c) for c in carry]]
    if not twice:
        cols.append(F.col("text").cast("string").alias("__text"))
    return docs.select(*cols), 1 + (carry.index("text") if twice else len(carry))
