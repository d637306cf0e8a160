"""Scalar Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from alphaloom.params import FOMC_DATES

ColOrName = Column | str


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def c(x: ColOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: ColOrName, lo: float, hi: float) -> Column:
    """Bound ``x`` to [lo, hi]; NULL stays NULL."""
    x = c(x)
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def safe_div(a: ColOrName, b: ColOrName, default: float = 0.0) -> Column:
    """Division that yields ``default`` on a (near) zero denominator."""
    a, b = c(a), c(b)
    return F.when(F.abs(b) > 1e-12, F.try_divide(a, b)).otherwise(F.lit(default))


def nan_to_null(x: ColOrName) -> Column:
    x = c(x)
    return F.when(F.isnan(x), None).otherwise(x)


def ladder(x: ColOrName, steps: list[tuple[float, object]], other: object) -> Column:
    """First (bound, value) with x < bound, else ``other``."""
    x = c(x)
    out = None
    for bound, value in steps:
        out = F.when(x < bound, F.lit(value)) if out is None else out.when(x < bound, F.lit(value))
    return out.otherwise(F.lit(other))


def regime_points(vix, spy_3m, credit, yc, vol_regime) -> Column:
    """Additive regime score out of five step functions."""
    spy_3m, credit, yc, vr = c(spy_3m), c(credit), c(yc), c(vol_regime)
    v = ladder(vix, [(15, 2.0), (20, 1.0), (25, -0.5), (30, -1.5)], -3.0)
    s = (F.when(spy_3m > 5, 2.0).when(spy_3m > 0, 0.5).when(spy_3m > -5, -1.0).otherwise(-2.5))
    k = (F.when(credit > 0.01, 1.5).when(credit > 0, 0.5).when(credit > -0.01, -0.5).otherwise(-1.5))
    y = F.when(yc > 0.02, 1.0).when(yc < -0.02, -1.0).otherwise(0.0)
    r = F.when(vr < 0.8, 1.0).when(vr > 1.3, -1.5).otherwise(0.0)
    return v + s + k + y + r


def regime_rule(vix, spy_3m, credit, yc, vol_regime) -> Column:
    """Four-state label of the additive score."""
    p = regime_points(vix, spy_3m, credit, yc, vol_regime)
    return F.when(p >= 3.5, "risk_on").when(p >= 0.5, "neutral").when(p >= -2.0, "risk_off").otherwise("crisis")


def macro_score(spy_3m, vix, credit) -> Column:
    risk_on = (c(spy_3m) > 0) & (c(vix) < 20)
    return F.when(risk_on, 1).otherwise(-1) + F.when(c(credit) > 0, 1).otherwise(-1)


def regime3(spy_3m, vix, credit) -> Column:
    risk_on = (c(spy_3m) > 0) & (c(vix) < 20)
    return F.when(risk_on & (c(credit) > 0), "risk_on").when(~risk_on, "risk_off").otherwise("neutral")


def trade_cost(delta, adv, notional) -> Column:
    """Cost of one weight change as a fraction of the portfolio."""
    delta, adv, notional = c(delta), c(adv), c(notional)
    dollars = F.abs(delta) * notional
    impact = F.when(adv > 0, F.least(F.lit(0.1) * F.sqrt(F.try_divide(dollars, adv)), F.lit(0.005))).otherwise(0.001)
    return F.when(delta < 1e-6, 0.0).otherwise((F.lit(8.0 / 10_000) + impact) * dollars / notional)


def slippage_model(price, vol) -> Column:
    return c(price) * F.least(F.lit(0.002) + c(vol) / 1000.0, F.lit(0.01))


def vol_adjusted_stop(entry, vol) -> Column:
    """Stop price: base 8 % scaled by sqrt of volatility relative to 20 %."""
    pct = clip(F.lit(0.08) * F.pow(c(vol) / 0.20, F.lit(0.5)), 0.04, 0.20)
    return c(entry) * (1 - pct)


def cash_buffer(vol_regime, regime) -> Column:
    base = (F.when(c(regime) == "crisis", 0.20).when(c(regime) == "risk_off", 0.10)
            .when(c(regime) == "risk_on", 0.02).otherwise(0.05))
    return clip(base + F.greatest(F.lit(0.0), (c(vol_regime) - 1.0) * 0.10), 0.0, 0.30)


def drawdown_scale(dd) -> Column:
    return ladder(dd, [(-0.25, 0.40), (-0.15, 0.65), (-0.08, 0.85)], 1.0)


def regime_vol_multiplier(regime) -> Column:
    return F.when(c(regime) == "crisis", 0.70).when(c(regime) == "risk_off", 0.88).otherwise(1.0)


def crowding_factor(score) -> Column:
    """Multiplier applied to a signal at a given crowding score."""
    s = c(score)
    return F.when(s >= 0.6, 1 - clip(F.lit(0.30) * (s - 0.60) / 0.40, 0.0, 0.50)).otherwise(1.0)


def liquidity_tier(adv) -> Column:
    """Struct of tier number, caps, participation and label for an ADV."""
    def row(tier, w, t, p, label):
        return F.struct(F.lit(tier).alias("tier"), F.lit(w).alias("max_weight"),
                        F.lit(t).alias("max_turnover"), F.lit(p).alias("participation_rate"),
                        F.lit(label).alias("label"))
    adv = c(adv)
    return (F.when(adv >= 5e8, row(1, 0.20, 0.10, 0.10, "mega"))
            .when(adv >= 5e7, row(2, 0.15, 0.07, 0.07, "liquid"))
            .when(adv >= 1e7, row(3, 0.10, 0.05, 0.05, "mid"))
            .otherwise(row(4, 0.05, 0.02, 0.02, "illiquid")))


def third_friday(d) -> Column:
    first = F.trunc(c(d), "month")
    return F.date_add(F.next_day(F.date_sub(first, 1), "FR"), 14)


def last_rebalance_friday(d) -> Column:
    """Last Friday on or before the 28th of the month of ``d``."""
    day28 = F.date_add(F.trunc(c(d), "month"), 27)
    return F.date_sub(F.next_day(day28, "FR"), 7)


def blackout(d, types=("fomc", "triple_witching", "index_rebalance")) -> tuple[Column, Column]:
    """(reasons array, execution scale) for a calendar date."""
    d = c(d)
    quarter_end = F.month(d).isin(3, 6, 9, 12)
    in_span = F.year(d).between(2022, 2026)
    tests = {
        "fomc": (F.date_format(d, "yyyy-MM-dd").isin(*FOMC_DATES), "fomc_meeting", 0.50),
        "triple_witching": (in_span & quarter_end & (d == third_friday(d)), "triple_witching", 0.70),
        "index_rebalance": (in_span & quarter_end & (d == last_rebalance_friday(d)), "index_rebalance", 0.75),
        "opex": (in_span & (d == third_friday(d)), "options_expiration", 0.85),
    }
    on = [tests[t] for t in tests if t in types]
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r, _ in on]))
    scale = F.least(F.lit(1.0), *[F.when(t, F.lit(s)).otherwise(1.0) for t, _, s in on])
    return reasons, scale


def auction_window(ts_utc) -> Column:
    """True close to the New York opening or closing auction."""
    local = F.from_utc_timestamp(c(ts_utc), "America/New_York")
    m = F.hour(local) * 60 + F.minute(local)
    return m.between(570, 580) | m.between(950, 960)


def pct_of(num, den) -> Column:
    """num/den in percent, NULL for a zero or missing side, 2 digits half-even."""
    return F.bround(F.when(c(den) != 0, F.try_divide(c(num), c(den))) * 100, 2)


def div_of(num, den) -> Column:
    return F.bround(F.when(c(den) != 0, F.try_divide(c(num), c(den))), 4)


def growth_of(cur, prior) -> Column:
    """Percent change on the absolute prior value, 2 digits."""
    return F.bround(F.when(c(prior) != 0, F.try_divide(c(cur) - c(prior), F.abs(c(prior)))) * 100, 2)


def time_decay(ts, now, hours: float = 24.0) -> Column:
    age = (F.unix_micros(c(now)) - F.unix_micros(c(ts))) / 3.6e9
    return F.when(c(ts).isNull(), 0.5).otherwise(clip(F.exp(-age / hours), 0.1, 1.0))


def ic_hurdle(ic_ir, turnover, bps: float = 10.0, periods: int = 12) -> tuple[Column, Column]:
    hurdle = c(turnover) * (bps / 10_000) * periods * 2.0
    return hurdle, c(ic_ir) - hurdle


def alpha_blend(eps, rev, inst, upside) -> Column:
    """Weighted blend of the four estimate-based signals."""
    return (0.40 * clip(eps, -2, 2) + 0.25 * clip(rev, -2, 2)
            + 0.20 * clip(inst, -1, 1) + 0.15 * clip(c(upside) * 5, -2, 2))
