"""Backward-looking price and volume features per ticker.

All windows share (ticker ordered by d): one shuffle, one sort.  A ticker has
at most one bar per calendar day, so a partition is bounded by the calendar.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.expr import safe_div

ANN = 252.0 ** 0.5


def _w(a: int, b: int):
    return W.partitionBy("ticker").orderBy("d").rowsBetween(a, b)


def wt():
    return W.partitionBy("ticker").orderBy("d")


def daily_returns(bars: DataFrame) -> DataFrame:
    """bars + ret (simple return to the previous bar) + n (1-based bar number)."""
    return bars.select("*", (F.try_divide(F.col("close"), F.lag("close").over(wt())) - 1).alias("ret"),
                       F.row_number().over(wt()).alias("n"))


FRAMES = ("c5", "c6", "c21", "c63", "c126", "c252", "c_first", "sma50", "sma200", "sma200_prev", "hi252", "m1", "m2", "m3", "s30", "s90",
          "prior_sd", "slope", "obv", "obv19", "obv_sd", "amihud", "up", "down", "vol21")


def _ago(x: np.ndarray, k: int, fill) -> np.ndarray:
    """The values ``k`` rows earlier."""
    return np.concatenate([np.full(min(k, len(x)), fill, x.dtype), x[:max(len(x) - k, 0)]])


class _Series:
    """Values in order of d, with the rows that hold one; statistics over the last rows leave the others out, as SQL does."""

    def __init__(self, x: np.ndarray, ok: np.ndarray):
        self.x, self.ok = np.where(ok, x, 0.0), ok

    def ago(self, k: int) -> _Series:
        return _Series(_ago(self.x, k, 0.0), _ago(self.ok, k, False))

    def _rows(self, x: np.ndarray, size: int, fill) -> np.ndarray:
        return sliding_window_view(np.concatenate([np.full(size - 1, fill, x.dtype), x]), size)

    def count(self, size: int) -> np.ndarray:
        n = np.cumsum(self.ok)
        return n - _ago(n, size, 0)

    def mean(self, size: int) -> _Series:
        n = self.count(size)
        return _Series(self._rows(self.x, size, 0.0).sum(1) / n, n > 0)

    def deviation(self, size: int) -> _Series:
        """Population deviation; taken around the last value first, so that it is zero where the values are equal."""
        x, ok, n = self._rows(self.x, size, 0.0), self._rows(self.ok, size, False), self.count(size)
        off = np.where(ok, x - self.x[:, None], 0.0)
        off = np.where(ok, off - (off.sum(1) / n)[:, None], 0.0)
        return _Series(np.sqrt((off * off).sum(1) / n), n > 0)

    def largest(self, size: int) -> _Series:
        return _Series(self._rows(np.where(self.ok, self.x, -np.inf), size, -np.inf).max(1), self.count(size) > 0)

    def slope(self, size: int) -> _Series:
        """Least squares over the row number."""
        y, ok, n = self._rows(self.x, size, 0.0), self._rows(self.ok, size, False), self.count(size)
        at = np.arange(size, dtype=float)
        dt = np.where(ok, at - ((ok * at).sum(1) / n)[:, None], 0.0)
        return _Series((dt * np.where(ok, y - (y.sum(1) / n)[:, None], 0.0)).sum(1) / (dt * dt).sum(1), n > 1)


def _frames_of(bars: pa.Table) -> dict[str, _Series]:
    """The frames of one ticker, whose bars stand in order of d."""
    def col(name):
        v = bars.column(name)
        return _Series(v.cast(pa.float64()).fill_null(0.0).to_numpy(), v.is_valid().to_numpy())

    close, volume = col("close"), col("volume")
    prev = close.ago(1)
    r = _Series((close.x - prev.x) / (prev.x + 1e-10), close.ok & prev.ok)
    move = np.sign(close.x - prev.x) * r.ok
    obv = _Series(np.cumsum(move * volume.x), np.logical_or.accumulate(volume.ok))
    sma200, m1 = close.mean(200), r.mean(30)
    sma200_prev = sma200.ago(1)
    return {
        **{f"c{k}": close.ago(k - 1) for k in (5, 6, 21, 63, 126, 252)}, "c_first": _Series(np.full_like(close.x, close.x[0]), np.full_like(close.ok, close.ok[0])),
        "sma50": close.mean(50), "sma200": sma200, "sma200_prev": sma200_prev, "hi252": close.largest(252),
        "m1": m1, "m2": _Series(r.x ** 2, r.ok).mean(30), "m3": _Series(r.x ** 3, r.ok).mean(30), "s30": r.deviation(30), "s90": r.deviation(90),
        "prior_sd": r.ago(6).deviation(19), "slope": _Series(close.x / (sma200_prev.x + 1e-6), close.ok & sma200_prev.ok).slope(20),
        "obv": obv, "obv19": obv.ago(19), "obv_sd": obv.deviation(20),
        "amihud": _Series(np.abs(r.x) / (close.x * volume.x + 1e-6), r.ok & volume.ok).mean(20),
        "up": _Series(volume.x, volume.ok & (move > 0)).mean(20), "down": _Series(volume.x, volume.ok & (move < 0)).mean(20), "vol21": volume.mean(21)}


def _days(x: pa.ChunkedArray) -> np.ndarray:
    """Days since 1970, the least number where there is none."""
    return x.cast(pa.int32()).fill_null(-2 ** 31).to_numpy()


def _long_frames(bars: DataFrame, only: str | None = None, known: DataFrame | None = None, dates: dict | None = None) -> DataFrame:
    """bars + n (1-based bar number, unless there) + ``FRAMES``, the lags and statistics of the last rows of a ticker;
    rows where the column ``only`` does not hold take part in the frames of others but are not returned.

    ``known`` = (ticker, t, ...): a row then comes once for each rebalance from its ``__from`` to its ``__to``, with the
    number ``k`` and the columns of the ticker's last row of ``known`` at or before the date (``dates``: by number); null
    where there is none.  An empty t is before all dates.  A list ``__members`` of (valid_from, valid_to) leaves out the
    rebalances outside, and for a list ``__sectors`` a row comes once for each entry.

    A window evaluates a sliding frame anew for each row, a step for each of its rows, and a chain of windows copies the rows
    once each.  A ticker's bars are few (the calendar bounds them): one task has them at once, and numpy takes each
    frame of all rows together.
    """
    num = [] if "n" in bars.columns else [("n", "int")]
    facts = [f for f in known.schema if f.name not in ("ticker", "t", "__members", "__sectors")] if known is not None else []
    listed = {f.name for f in known.schema} & {"__members", "__sectors"} if known is not None else set()
    more = [("k", "int")] * (known is not None) + [("sector", "string")] * ("__sectors" in listed) + [(f.name, f.dataType.simpleString()) for f in facts]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"{c} {t}" for c, t in num] + [f"{c} double" for c in FRAMES] + [f"`{c}` {t}" for c, t in more])
    when = np.full(max(dates or [-1]) + 1, -2 ** 31)
    for k, day in (dates or {}).items():
        when[k] = (day - date(1970, 1, 1)).days

    def frames(t: pa.Table) -> pa.Table:
        return framed(*ordered(t))

    def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        t = t.take(pc.sort_indices(t, sort_keys=[("d", "ascending")], null_placement="at_start"))
        at = np.arange(t.num_rows)
        return t, at if only is None else at[t.column(only).fill_null(False).to_numpy()]

    def framed(t: pa.Table, at: np.ndarray) -> pa.Table:
        got = {c: _Series(np.zeros(0), np.zeros(0, bool)) for c in FRAMES}
        if len(at):
            with np.errstate(all="ignore"):
                got = _frames_of(t)
        t = t.take(pa.array(at))
        for c, _ in num:
            t = t.append_column(c, pa.array((at + 1).astype(np.int32)))
        for c in FRAMES:
            t = t.append_column(c, pa.array(got[c].x[at], mask=~got[c].ok[at]))
        return t

    def with_known(t: pa.Table, of: pa.Table) -> pa.Table:
        t, at = ordered(t)
        first, last = (t.column(c).to_numpy()[at].astype(np.int64) for c in ("__from", "__to"))
        n = last - first + 1
        k = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, on = np.repeat(at, n), when[k]
        if "__members" in listed:
            member = np.zeros(len(k), bool)
            for m in (of.column("__members")[0].as_py() or []) if of.num_rows else []:
                since, until = ((m[c] - date(1970, 1, 1)).days if m[c] else None for c in ("valid_from", "valid_to"))
                member |= (on >= since) & (until is None or on < until) if since is not None else False
            k, at, on = k[member], at[member], on[member]
        names = ((of.column("__sectors")[0].as_py() if of.num_rows and "__sectors" in listed else None) or [None])
        k, at, on = (np.repeat(x, len(names)) for x in (k, at, on))
        of = of.take(pc.sort_indices(of, sort_keys=[("t", "ascending")], null_placement="at_start"))
        i = np.searchsorted(_days(of.column("t")), on, side="right") - 1
        t = framed(t, at).append_column("k", pa.array(k.astype(np.int32)))
        if "__sectors" in listed:
            t = t.append_column("sector", pa.array(names * (len(k) // len(names)), pa.string()))
        for f in facts:
            t = t.append_column(f.name, of.column(f.name).take(pa.array(i, mask=i < 0)))
        return t

    if known is not None:
        return bars.groupBy("ticker").cogroup(known.groupBy("ticker")).applyInArrow(with_known, out)
    return bars.groupBy("ticker").applyInArrow(frames, out)


def price_features(bars: DataFrame, min_bars: int = 60, only: str | None = None, carry: tuple[str, ...] = (),
                   known: DataFrame | None = None, dates: dict | None = None) -> DataFrame:
    """The historical feature pack; rows with fewer than ``min_bars`` bars are dropped.

    Row (ticker, d) uses bars up to and including d.  ``only`` names a condition (a column of the bars) on the rows that are
    returned, ``carry`` columns to keep.  ``known`` and ``dates``: rows of rebalances, see ``_long_frames``.
    """
    kept = list(carry)
    base = bars.select("ticker", "d", "close", "volume", *kept, *([only] if only else []), *(["__from", "__to"] if known is not None else []))
    if known is not None:
        kept += ["k", *(["sector"] if "__sectors" in known.columns else []), *[c for c in known.columns if c not in ("ticker", "t", "__members", "__sectors")]]
    ago = lambda k: F.col(f"c{k}") if k > 1 else F.col("close")  # noqa: E731  (element [-k])
    ret = lambda k: F.when(F.col("n") >= k, (safe_div(F.col("close"), ago(k)) - 1) * 100).otherwise(0.0)
    up, down = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("up", "down"))
    raw = _long_frames(base, only, known, dates).where(F.col("n") >= min_bars).select(
        "ticker", "d", "close", "volume", "n", *kept,
        F.when(F.col("n") >= 252, (safe_div(ago(21), ago(252)) - 1) * 100)
        .when(F.col("n") >= 84, (safe_div(ago(21), F.col("c_first")) - 1) * 100)
        .otherwise(0.0).alias("momentum_12_1"),
        ret(126).alias("ret_6m"), ret(63).alias("ret_3m"), ret(21).alias("ret_1m"), ret(5).alias("ret_1w"),
        "s30", "s90", "m1", "m2", "m3", "sma50", "sma200", "hi252", "slope",
        (F.col("obv") - F.col("obv19")).alias("obv_chg"), "obv_sd", "amihud",
        safe_div(up, down + 1e-6).alias("volume_trend"),
        (safe_div(F.col("close"), ago(6)) - 1).alias("ret5"), "prior_sd",
        (F.col("close") * F.col("vol21")).alias("adv"))
    vol = F.col("s30") * F.lit(ANN) * 100
    sig = F.col("s30") + 1e-10
    return raw.select(
        "ticker", "d", "close", "volume", "n", *kept,
        "momentum_12_1", "ret_6m", "ret_3m", "ret_1m", "ret_1w",
        (-F.col("ret_1w")).alias("reversal"),
        (F.col("ret_3m") - F.col("ret_6m")).alias("price_accel"),
        vol.alias("vol"),
        F.when(F.col("n") >= 91, vol / (F.col("s90") * F.lit(ANN) * 100 + 1e-6)).otherwise(1.0).alias("vol_regime"),
        ((F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.pow("m1", F.lit(3.0)))
         / (sig * sig * sig)).alias("skewness"),
        safe_div(F.col("close") - F.col("sma50"), vol / 100 * F.col("sma50") + 1e-6).alias("mean_reversion"),
        F.when(F.col("n") < 200, 0.0).when(F.col("close") > F.col("sma200"), 1.0).otherwise(-1.0).alias("trend_strength"),
        F.when(F.col("n") >= 200, safe_div("close", "hi252")).otherwise(0.5).alias("high_52w_proximity"),
        F.when(F.col("n") >= 220, F.col("slope")).otherwise(0.0).alias("trend_slope"),
        safe_div(F.col("obv_chg"), (F.col("obv_sd") + 1e-6) * 20).alias("flow_signal"),
        (-F.log1p(F.col("amihud") * 1e6)).alias("liquidity"),
        "volume_trend",
        (F.col("ret5") / (F.col("prior_sd") + 1e-6)).alias("earnings_surprise"),
        (vol / 15.0).alias("beta_proxy"),
        F.col("ret_3m").alias("rel_strength"), "adv")


def price_only_flow(bars: DataFrame) -> DataFrame:
    """Flow fallback without volume: net count of up moves over 19 changes."""
    sg = F.signum(F.col("close") - F.lag("close").over(wt()))
    b = bars.select("ticker", "d", sg.alias("sg"), F.row_number().over(wt()).alias("n"))
    return b.select("ticker", "d", "n", F.sum("sg").over(_w(-18, 0)).alias("flow_signal")).where("n >= 60")


def live_tech(bars: DataFrame, min_bars: int = 30) -> DataFrame:
    """The live technical pack (sample deviations, strict look-back gates)."""
    b = daily_returns(bars)
    ago = lambda k: F.lag("close", k - 1).over(wt())
    ret = lambda k: F.when(F.col("n") > k, (F.try_divide(F.col("close"), ago(k)) - 1) * 100).otherwise(0.0)
    x = b.select(
        "ticker", "d", "close", "n", ret(22).alias("ret_1m"), ret(63).alias("ret_3m"), ret(126).alias("ret_6m"),
        F.when(F.col("n") >= 252, (F.try_divide(ago(22), ago(252)) - 1) * 100)
        .when(F.col("n") >= 100, (ago(22) / F.first("close").over(_w(W.unboundedPreceding, 0)) - 1) * 100)
        .otherwise(0.0).alias("ret_12m_skip1m"),
        F.when(F.col("n") >= 50, F.avg("close").over(_w(-49, 0))).otherwise(F.col("close")).alias("sma50"),
        F.when(F.col("n") >= 200, F.avg("close").over(_w(-199, 0))).otherwise(F.col("close")).alias("sma200"),
        (F.stddev_samp("ret").over(_w(-29, 0)) * F.lit(ANN) * 100).alias("ann_vol_30d"),
        (F.stddev_samp("ret").over(_w(-89, 0)) * F.lit(ANN) * 100).alias("v90"),
        F.when(F.col("n") >= 50, F.max("close").over(_w(-251, 0))).otherwise(F.col("close")).alias("high_52w"))
    return x.where((F.col("n") >= min_bars) & (F.col("close") > 0)).select(
        "ticker", "d", "close", "n", "ret_1m", "ret_3m", "ret_6m", "ret_12m_skip1m", "sma50", "sma200", "ann_vol_30d",
        F.when(F.col("n") >= 91, F.col("v90")).otherwise(F.col("ann_vol_30d")).alias("ann_vol_90d"),
        F.when(F.col("high_52w") > 0, F.col("close") / F.col("high_52w")).otherwise(0.5).alias("high_52w_proximity")
    ).select("*", (F.col("ann_vol_30d") / (F.col("ann_vol_90d") + 1e-6)).alias("vol_regime"),
             ((F.col("close") - F.col("sma50")) / (F.col("ann_vol_30d") / 100 * F.col("sma50") + 1e-6)).alias("z_score"))


def pead_proxy(bars: DataFrame) -> DataFrame:
    """Post-announcement drift proxy with volume confirmation (>= 25 bars)."""
    b = daily_returns(bars).select(
        "ticker", "d", "n", (F.try_divide(F.col("close"), F.lag("close", 5).over(wt())) - 1).alias("r5"),
        F.stddev_samp("ret").over(_w(-25, -6)).alias("sd"),
        (F.col("volume") > 1.5 * F.avg("volume").over(_w(-19, 0))).alias("confirm"))
    raw = F.col("r5") / (F.col("sd") + 1e-6)
    return b.where("n >= 26").select(
        "ticker", "d",
        F.when((F.abs("r5") >= 0.03) & F.col("confirm"), raw)
        .when(F.abs("r5") >= 0.05, raw * 0.5).otherwise(0.0).alias("earnings_surprise"))


def fast_surprise(bars: DataFrame) -> DataFrame:
    """Mean of 5 closes against the 20 before, in their deviations (>= 30 bars)."""
    b = bars.select("ticker", "d", F.row_number().over(wt()).alias("n"),
                    F.avg("close").over(_w(-4, 0)).alias("recent"),
                    F.avg("close").over(_w(-24, -5)).alias("prev"),
                    F.stddev_pop("close").over(_w(-24, -5)).alias("sd"))
    return b.select("ticker", "d", F.when(F.col("n") < 30, 0.0).otherwise(
        F.bround((F.col("recent") - F.col("prev")) / (F.col("sd") + 1e-6), 3)).alias("surprise"))


def volume_flow(bars: DataFrame) -> DataFrame:
    """Volume-weighted price change over 20 bars (0 below 20 bars)."""
    b = bars.select("ticker", "d", "volume", F.row_number().over(wt()).alias("n"),
                    ((F.col("close") - F.lag("close").over(wt())) * F.col("volume")).alias("dv"))
    return b.select("ticker", "d", F.when(F.col("n") < 20, 0.0).otherwise(
        F.sum("dv").over(_w(-18, 0)) / (F.sum("volume").over(_w(-19, 0)) + 1e-6)).alias("flow"))


def average_dollar_volume(bars: DataFrame, days: int = 21) -> DataFrame:
    return bars.select("ticker", "d", (F.col("close") * F.avg("volume").over(_w(-(days - 1), 0))).alias("adv"))


def relative_strength(bars: DataFrame, market: DataFrame) -> DataFrame:
    """63-bar return of the ticker minus that of the market on the same date."""
    own = bars.select("ticker", "d", ((F.try_divide(F.col("close"), F.lag("close", 62).over(wt())) - 1) * 100).alias("own"))
    mw = W.partitionBy("symbol").orderBy("d")
    mkt = market.select("symbol", "d", ((F.try_divide(F.col("close"), F.lag("close", 62).over(mw)) - 1) * 100).alias("mkt")).drop("symbol")
    return own.join(mkt, "d", "left").select(
        "ticker", "d", (F.coalesce("own", F.lit(0.0)) - F.coalesce("mkt", F.lit(0.0))).alias("rel_strength"))


def beta_60d(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Beta over the last 60 common days; 1.0 with fewer than 20."""
    own = daily_returns(bars).where("ret is not null").select("ticker", "d", "ret")
    mw = W.partitionBy("symbol").orderBy("d")
    mkt = market.select("d", (F.try_divide(F.col("close"), F.lag("close").over(mw)) - 1).alias("mkt")).where("mkt is not null")
    last = W.partitionBy("ticker").orderBy(F.desc("d"))
    j = own.join(mkt, "d").withColumn("k", F.row_number().over(last)).where("k <= 60")
    return j.groupBy("ticker").agg(
        F.count("*").alias("n"),
        (F.covar_samp("ret", "mkt") / (F.var_pop("mkt") + 1e-10)).alias("b")
    ).select("ticker", "n", F.when(F.col("n") < 20, 1.0).otherwise(F.col("b")).alias("beta"))
