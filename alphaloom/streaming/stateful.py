"""Keyed state machines that give the same rows whatever the order of files and micro-batches.

The functions here return a stream of changes: rows of the machine with ``op`` (``+`` added, ``-`` taken back because an
earlier row came late, ``late`` too late to be told apart) and ``late_ts``.  ``net`` adds the changes up; ``settled`` runs
a finite stream to its end, tail included.

Late rows are not dropped: the watermark only says how far a key's rows are applied by now and when deadlines pass.  A row
behind it starts a replay from the state that its bucket of event time began with.  ``keep`` bounds how far back that may
be, and so the state; rows beyond it are handed on with ``op`` late, to be corrected in a batch.  Without ``keep`` nothing
is too late, and a key keeps all its rows (packed, in the state store).  Rows without key or time are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

from alphaloom.sources.storage import materialize, scratch_path
from alphaloom.streaming import machines
from alphaloom.streaming.io import drain_batches, run_available, use_rocksdb
from alphaloom.streaming.machines import ADD, HOUR_US, LATE, TAKE_BACK, fields

# the processors travel with the query: the worker that asks a processor for its state has no archive on its path
cloudpickle.register_pickle_by_value(machines)


def _microseconds(span: str | None) -> int | None:
    """Microseconds of a span such as ``36 hours``."""
    if span is None:
        return None
    n, unit = span.split()
    return int(float(n) * {"minute": HOUR_US / 60, "hour": HOUR_US, "day": 24 * HOUR_US, "week": 168 * HOUR_US}[unit.rstrip("s")])


def _run(stream: DataFrame, key: str, machine: type, rules: tuple, out: StructType, delay: str, keep: str | None, bucket: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    out = StructType([*out.fields, StructField("op", StringType()), StructField("late_ts", TimestampType())])
    # the operator is not to see the column of the watermark: it would drop late rows
    timed = stream.where("ts is not null").withColumn("event_time", F.col("ts")).withWatermark("event_time", delay).drop("event_time")
    made = machine(rules, bucket_us=_microseconds(bucket), keep_us=_microseconds(keep))
    return timed.groupBy(key).transformWithStateInPandas(made, out, "Append", "EventTime")


def net(changes: DataFrame) -> DataFrame:
    """Rows that were added and not taken back."""
    cols = [c for c in changes.columns if c not in ("op", "late_ts")]
    n = F.sum(F.when(F.col("op") == ADD, 1).when(F.col("op") == TAKE_BACK, -1)).alias("n")
    return changes.where(F.col("op") != LATE).groupBy(*cols).agg(n).where("n > 0").select(*cols, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")


def too_late(changes: DataFrame) -> DataFrame:
    """Key and time of the rows that came too late."""
    return changes.where(F.col("op") == LATE).select(changes.columns[0], "late_ts")


def run_to_end(events: DataFrame, machine: Callable[[DataFrame], DataFrame], label: str = "machine", delay: str = "1 hour") -> DataFrame:
    """All changes of a finite stream.  After the last file a mark moves the watermark behind the last event, so that the
    tail is applied and deadlines pass up to there, and none beyond.  ``delay`` is the machine's."""
    spark = events.sparkSession
    end, out, ck = (scratch_path(spark, f"{label}-{x}") for x in ("end", "out", "ck"))
    spark.createDataFrame([], events.schema).write.parquet(end)
    changes = machine(events.unionByName(spark.readStream.schema(events.schema).parquet(end)))
    reached = run_available(changes, out, ck)
    if reached is not None:
        last = F.expr(f"timestamp_millis({reached + 1}L) + 2 * interval '{delay}'")
        cols = [(last if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
        spark.range(1).select(*cols).write.mode("append").parquet(end)
        run_available(changes, out, ck)
    return spark.read.schema(changes.schema).parquet(out)


def settled(events: DataFrame, machine: Callable[[DataFrame], DataFrame], label: str = "machine", delay: str = "1 hour") -> DataFrame:
    return net(run_to_end(events, machine, label, delay))


def position_exits(ticks: DataFrame, target: float = 0.12, stop: float = 0.05, min_hold_hours: float = 72.0,
                   max_hold_hours: float = 1440.0, delay: str = "1 hour", keep: str | None = None, bucket: str = "1 day") -> DataFrame:
    """ticks: (ticker, ts, price, and seq to order equal times).  A position that has been held for the longest time is
    left then, at the last price, whether or not a tick follows."""
    t, d = TimestampType(), DoubleType()
    out = fields(ticker=ticks.schema["ticker"].dataType, entry_ts=t, exit_ts=t, entry_price=d, exit_price=d, peak_price=d, reason=StringType())
    return _run(ticks, "ticker", machines.ExitTracker, (target, stop, min_hold_hours, max_hold_hours), out, delay, keep, bucket)


def circuit_breaker(values: DataFrame, loss: float = 0.03, drawdown: float = 0.20, loss_hours: float = 24.0, dd_hours: float = 720.0,
                    delay: str = "1 hour", keep: str | None = None, bucket: str = "1 day") -> DataFrame:
    """values: (series_id, ts, value, and seq to order equal times) -> a decision for every row."""
    out = fields(series_id=values.schema["series_id"].dataType, ts=TimestampType(), value=DoubleType(), decision=StringType())
    return _run(values, "series_id", machines.Breaker, (loss, drawdown, loss_hours, dd_hours), out, delay, keep, bucket)


def factor_health(evals: DataFrame, min_ir: float = 0.10, limit: int = 3, delay: str = "1 hour", keep: str | None = None, bucket: str = "1 hour") -> DataFrame:
    """evals: (factor, ts, ic_ir, n, and seq to order equal times)."""
    out = fields(factor=StringType(), ts=TimestampType(), fails=IntegerType(), disabled=BooleanType())
    return _run(evals, "factor", machines.Health, (min_ir, limit), out, delay, keep, bucket)


def staleness_alerts(ticks: DataFrame, hours: float = 36.0, monday_hours: float = 72.0, delay: str = "1 hour", keep: str | None = None, bucket: str = "1 day") -> DataFrame:
    """ticks: (ticker, ts, and seq) -> an alert for every silence, once it is long enough."""
    out = fields(ticker=ticks.schema["ticker"].dataType, last_ts=TimestampType(), alert_ts=TimestampType())
    return _run(ticks, "ticker", machines.Staleness, (hours, monday_hours), out, delay, keep, bucket)


def due_signals(signals: DataFrame, clock: str = "signal_date") -> DataFrame:
    """Signals (ticker, signal_date, fwd_due_date, ...) once the stream's clock has passed their due date.

    They wait in keyed state under (ticker, due date) with a timer, so a micro-batch touches what it brings and what falls
    due.  The clock is the latest ``clock`` date seen; nothing is late, a signal that is due already goes on at once.
    Signals without ticker or due date never fall due and are left out.
    """
    use_rocksdb(signals.sparkSession)
    timed = signals.withColumn("event_time", F.col(clock).cast("timestamp")).withWatermark("event_time", "0 seconds").drop("event_time")
    keyed = timed.withColumn("__due", F.unix_millis(F.col("fwd_due_date").cast("timestamp")))
    return keyed.groupBy("ticker", "__due").transformWithStateInPandas(machines.DueDates(signals.schema), signals.schema, "Append", "EventTime")


def fill_due_signals(signals: DataFrame, bars: DataFrame, today, out: str) -> None:
    """Append the forward return of each signal to the table ``out`` once it is due, up to and on ``today``.

    Each micro-batch fills the signals that fall due in it from the static bars; a repeated batch replaces its own rows.
    After the last file the clock is moved to ``today``, so signals fall due without new ones.
    """
    from alphaloom.operators.asof import fill_returns

    spark = signals.sparkSession
    end, ck = scratch_path(spark, "signals-end"), scratch_path(spark, "signals-ck")
    spark.createDataFrame([], signals.schema).write.parquet(end)
    due = due_signals(signals.unionByName(spark.readStream.schema(signals.schema).parquet(end)))

    def handle(batch: DataFrame, number: int) -> None:
        due_now = materialize(batch, "due")         # read twice below; the state is to be run once
        fill_returns(due_now, bars, today).write.mode("overwrite").parquet(f"{out}/batch={number}")
    drain_batches(due, handle, ck)
    mark = [(F.date_add(today, 1) if f.name == "signal_date" else F.lit(None)).cast(f.dataType).alias(f.name) for f in signals.schema]
    spark.range(1).select(*mark).write.mode("append").parquet(end)
    drain_batches(due, handle, ck)


def live_ic(filled: DataFrame) -> DataFrame:
    """IC of all filled signals of a date, whichever batches they came in."""
    from alphaloom.operators.ic import spearman

    return spearman(filled, ["signal_date"], "score", "fwd_return")
