"""Keyed state machines over event time that take rows in any order.

Imports nothing of this package: processors travel to the workers by value (see ``stateful``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

HOUR_US = 3_600_000_000
ADD, TAKE_BACK, LATE = "+", "-", "late"
HELD = 1 << 14              # changed rows of a run that are held to cancel out


def fields(**kinds) -> StructType:
    return StructType([StructField(n, k) for n, k in kinds.items()])


def at_time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class Machine(StatefulProcessor):
    """Keeps the output of ``step`` and ``expire`` over a key's rows in order of time, as far as the watermark has come.

    Rows wait in buckets of event time, packed, in the state store.  Each applied bucket keeps the state that it began
    with.  A row that comes late goes to its bucket; from there the buckets are run twice, without and with the new rows,
    and what differs is put out: ``-`` takes a row back, ``+`` adds one.  A replay skips buckets where both runs agree.
    A late row is just the general case: on time, the run without new rows ends where the watermark stood before.

    A deadline is an event of its own: it is passed before the first row behind it, or once the watermark is there.

    Only one bucket of a key is in memory.  Buckets older than ``keep`` behind the watermark are dropped; rows that come
    for them are handed on as ``late`` and change nothing here.
    """

    VALUES: tuple[str, ...] = ()
    STATE: StructType
    OUT: tuple[str, ...]

    def __init__(self, bucket_us: int, keep_us: int | None):
        self.bucket_us, self.keep_us = bucket_us, keep_us
        self.layout = np.dtype([("us", "<i8"), ("seq", "<i8"), *((v, "<f8") for v in self.VALUES), ("fresh", "?")])

    # what a machine does

    def start(self) -> tuple | None:
        """State of a key before its first row."""
        return None

    def step(self, key, state, us: int, values: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def deadline(self, state) -> int | None:
        """Time after which, without a row, ``expire`` is due."""
        return None

    def expire(self, key, state, us: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    # how it is run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        bucket = fields(bucket=LongType())
        self.rows = handle.getMapState("rows", bucket, fields(data=BinaryType()))
        self.begun = handle.getMapState("begun", bucket, StructType([StructField("known", BooleanType()), *self.STATE.fields]))
        self.clock = handle.getValueState("clock", fields(us=LongType(), oldest=LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        oldest = self._clock()[1]
        late: list = []
        if pd.isna(key[0]):     # the mark of the end, and rows of no key
            for _ in rows:
                pass
            return
        for pdf in rows:
            new = np.zeros(len(pdf), self.layout)
            new["us"] = pdf["ts"].astype("datetime64[us]").astype("int64")
            new["seq"] = pdf["seq"] if "seq" in pdf else 0
            for v in self.VALUES:
                new[v] = pdf[v].astype(float)
            new["fresh"] = True
            of = new["us"] // self.bucket_us
            for b in np.unique(of).tolist():
                own = new[of == b]
                if oldest is not None and b < oldest:
                    late += own["us"].tolist()
                else:
                    self._put(b, np.concatenate([self._get(b), own]))
        yield from self._run(key, timerValues.getCurrentWatermarkInMs(), late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, timerValues.getCurrentWatermarkInMs(), [])

    def close(self) -> None:
        pass

    def _clock(self) -> tuple:
        return tuple(self.clock.get()) if self.clock.exists() else (None, None)

    def _get(self, b: int) -> np.ndarray:
        v = self.rows.getValue((b,)) if self.rows.exists() else None
        return np.frombuffer(bytes(v[0]), self.layout) if v is not None else np.zeros(0, self.layout)

    def _put(self, b: int, rows: np.ndarray) -> None:
        self.rows.updateValue((b,), (rows.tobytes(),))

    def _begin(self, b: int, state) -> None:
        self.begun.updateValue((b,), (state is not None, *(state if state is not None else [None] * len(self.STATE.fields))))

    def _state_at(self, b: int):
        v = tuple(self.begun.getValue((b,)))
        return v[1:] if v[0] else None

    def _expired(self, key, state, upto: int, out: list, inclusive: bool):
        while (due := self.deadline(state)) is not None and (due < upto or inclusive and due == upto):
            state, rows = self.expire(key, state, due)
            out += rows
        return state

    def _fold(self, key, state, rows: np.ndarray) -> tuple[tuple | None, list[tuple]]:
        out: list[tuple] = []
        for us, _seq, *values, _fresh in np.sort(rows, order=list(self.layout.names[:-1])).tolist():
            state = self._expired(key, state, us, out, False)
            state, made = self.step(key, state, us, tuple(values))
            out += made
        return state, out

    def _changes(self, net: Counter, before: list[tuple], after: list[tuple], most: int = 0) -> Iterator[pd.DataFrame]:
        """Add to what has changed in this run; put it out once there is more than ``most``."""
        net.update(after)
        net.subtract(before)
        if len(net) > most:
            rows = [(*r, ADD if n > 0 else TAKE_BACK, None) for r, n in net.items() for _ in range(abs(n))]
            net.clear()
            yield pd.DataFrame(rows, columns=[*self.OUT, "op", "late_ts"])

    def _run(self, key, watermark_ms: int, late: list[int]) -> Iterator[pd.DataFrame]:
        k, now, net = key[0], watermark_ms * 1000 - 1, Counter()        # the watermark itself is not passed yet
        if late:
            yield pd.DataFrame([(k, *[None] * (len(self.OUT) - 1), LATE, at_time(us)) for us in late], columns=[*self.OUT, "op", "late_ts"])
        was, oldest = self._clock()
        buckets = sorted(b for (b,) in self.rows.keys()) if self.rows.exists() else []
        ripe = [b for b in buckets if b * self.bucket_us <= now]
        known = {b for (b,) in self.begun.keys()} if self.begun.exists() else set()
        ended = max((b for b in ripe if was is not None and b * self.bucket_us <= was), default=None)
        dirty = {b for b in ripe if (a := self._get(b))[(a["fresh"]) & (a["us"] <= now)].size}
        first = min([*dirty, *([ended] if ended is not None else [])], default=None)
        state = old = self.start()
        if first is not None:
            # the state before a bucket without one of its own is that of the next bucket: there are no rows between
            base = min((b for b in known if b >= first), default=max((b for b in known), default=None))
            if base is not None:
                first, state = min(first, base), self._state_at(base)
                old = state
            todo = [b for b in ripe if b >= first]
            for i, b in enumerate(todo):
                nxt = todo[i + 1] if i + 1 < len(todo) else None
                if b not in dirty and b != ended and old == state and nxt in known:
                    state = old = self._state_at(nxt)
                    continue
                rows = self._get(b)
                self._begin(b, state)
                before: list[tuple] = []
                if was is not None:
                    old, before = self._fold(k, old, rows[~rows["fresh"] & (rows["us"] <= was)])
                state, after = self._fold(k, state, rows[rows["us"] <= now])
                yield from self._changes(net, before, after, HELD)
                if b in dirty:
                    rows = rows.copy()
                    rows["fresh"][rows["us"] <= now] = False
                    self._put(b, rows)
        elif known:
            state = old = self._state_at(max(known))
        # deadlines passed since; the states that are kept don't take them in, so that late rows may still come before
        before, after = [], []
        if was is not None:
            self._expired(k, old, was, before, True)
        end = self._expired(k, state, now, after, True)
        yield from self._changes(net, before, after)
        oldest = self._dropped(k, now, ripe, state) if self.keep_us is not None else oldest
        self.clock.update((max(now, was) if was is not None else now, oldest))
        self._set_timer(end, buckets, now)

    def _dropped(self, key, now: int, ripe: list[int], state) -> int:
        """Forget what lies too far back; the oldest bucket that rows may still come for."""
        limit = (now - self.keep_us) // self.bucket_us
        gone = [b for b in ripe if b < limit]
        if gone:
            rest = [b for b in ripe if b >= limit]
            if not rest:        # the last state goes on from the limit
                self._begin(limit, state)
            elif min(rest) != limit:
                self._begin(limit, self._state_at(min(rest)))
            for b in gone:
                self.rows.removeKey((b,))
            for (b,) in list(self.begun.keys()):
                if b < limit:
                    self.begun.removeKey((b,))
        return limit

    def _set_timer(self, state, buckets: list[int], now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [d] if (d := self.deadline(state)) is not None else []
        for b in buckets:
            if (b + 1) * self.bucket_us > now:
                us = self._get(b)["us"]
                if (us > now).any():
                    due.append(int(us[us > now].min()))
                    break
        if due:
            self.handle.registerTimer(min(due) // 1000)         # fires once the watermark is greater


class ExitTracker(Machine):
    """One position per ticker, opened at the first tick after an exit; the longest holding time ends it without a tick."""

    VALUES = ("price",)
    STATE = fields(entry=DoubleType(), peak=DoubleType(), opened=LongType(), last=DoubleType())
    OUT = ("ticker", "entry_ts", "exit_ts", "entry_price", "exit_price", "peak_price", "reason")

    def __init__(self, rules: tuple, **kw):
        super().__init__(**kw)
        self.rules = rules

    def step(self, key, state, us, values):
        target, stop, lo, hi = self.rules
        price = values[0]
        if not price > 0:
            return state, []
        if state is None:
            return (price, price, us, price), []
        entry, peak, opened, _ = state
        peak = max(peak, price)
        held, pnl = (us - opened) / HOUR_US, (price - entry) / entry
        why = None
        if held >= lo:
            why = "max_hold" if held >= hi else "profit_target" if pnl >= target else "stop_loss" if pnl <= -stop else None
        if why is None:
            return (entry, peak, opened, price), []
        return None, [(key, at_time(opened), at_time(us), entry, price, peak, why)]

    def deadline(self, state):
        return None if state is None else state[2] + int(self.rules[3] * HOUR_US)

    def expire(self, key, state, us):
        entry, peak, opened, last = state
        return None, [(key, at_time(opened), at_time(us), entry, last, peak, "max_hold")]


class Breaker(Machine):
    """Trading halts on a daily loss or on drawdown from the peak."""

    VALUES = ("value",)
    STATE = fields(last=DoubleType(), peak=DoubleType(), until=LongType())
    OUT = ("series_id", "ts", "value", "decision")

    def __init__(self, rules: tuple, **kw):
        super().__init__(**kw)
        self.rules = rules

    def start(self):
        return None, 0.0, 0

    def step(self, key, state, us, values):
        loss, dd, loss_h, dd_h = self.rules
        last, peak, until = state
        value = values[0]
        peak = max(peak, value)
        what, hours = "ok", 0.0
        if us < until:
            what = "halted"
        elif last is not None and last > 0 and (value - last) / last < -loss:
            what, hours = "daily_loss", loss_h
        elif last is not None and (value - peak) / (peak + 1e-10) < -dd:
            what, hours = "max_drawdown", dd_h
        if hours:
            until = us + int(hours * HOUR_US)
        return (value, peak, until), [(key, at_time(us), value, what)]


class Health(Machine):
    """Leaky failure counter per factor."""

    VALUES = ("ic_ir", "n")
    STATE = fields(fails=IntegerType(), off=BooleanType())
    OUT = ("factor", "ts", "fails", "disabled")

    def __init__(self, rules: tuple, **kw):
        super().__init__(**kw)
        self.rules = rules

    def start(self):
        return 0, False

    def step(self, key, state, us, values):
        min_ir, limit = self.rules
        (fails, off), (ir, n) = state, values
        if n < 6:
            return state, []
        fails = fails + 1 if ir < min_ir else max(0, fails - 1)
        off = True if fails >= limit else False if ir > min_ir * 1.5 else off
        return (fails, off), [(key, at_time(us), fails, off)]


class Staleness(Machine):
    """Alerts for every silence of a key; Mondays tolerate the weekend."""

    STATE = fields(last=LongType(), told=BooleanType())
    OUT = ("ticker", "last_ts", "alert_ts")

    def __init__(self, rules: tuple, **kw):
        super().__init__(**kw)
        self.hours, self.monday = rules

    def step(self, key, state, us, values):
        return (us, False), []

    def deadline(self, state):
        if state is None or state[1]:
            return None
        at = at_time(state[0]) + timedelta(hours=self.hours)
        return state[0] + int((self.monday if at.weekday() == 0 else self.hours) * HOUR_US)

    def expire(self, key, state, us):
        return (state[0], True), [(key, at_time(state[0]), at_time(us))]


class DueDates(StatefulProcessor):
    """Holds the rows of a key and due date until the watermark has passed the date, then lets them go.

    The date is part of the key: a group holds what falls due together, and costs nothing until its timer fires.
    """

    def __init__(self, columns: StructType):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if any(pd.isna(k) for k in key):        # the mark of the end
            for _ in rows:
                pass
            return
        due = int(key[-1])      # in milliseconds
        for pdf in rows:
            pdf = pdf[self.columns.names]
            if due < timerValues.getCurrentWatermarkInMs():
                yield pdf
            else:
                self.held.appendList([tuple(r) for r in pdf.itertuples(index=False)])
        if due >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield pd.DataFrame([tuple(r) for r in self.held.get()], columns=self.columns.names)
            self.held.clear()

    def close(self) -> None:
        pass
