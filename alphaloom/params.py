"""Parameters, horizon presets and the fixed weight tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

REGIMES = ("risk_on", "neutral", "risk_off", "crisis")


@dataclass(frozen=True)
class Params:
    """One bundle of thresholds handed to operators; all fields overridable."""

    rebalance_days: int = 21
    min_history: int = 100
    min_universe: int = 15
    min_adv: float = 5_000_000.0
    top_n: int = 10
    cov_days: int = 126
    turnover_threshold: float = 0.02
    notional: float = 100_000.0
    target_vol: float = 0.12
    max_position: float = 0.20
    min_position: float = 0.03
    max_sector: float = 0.35
    kelly_fraction: float = 0.25
    cvar_confidence: float = 0.95
    ic_window: int = 24
    ic_half_life: float = 12.0
    profit_target: float = 0.12
    stop_loss: float = 0.05
    min_hold: int = 3
    max_hold: int = 60
    fwd_days: int = 21
    history_years: int = 10
    cost_bps: float = 10.0

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


def horizon_params(horizon: str) -> Params:
    """The two presets: weekly rotation with tight exits, or quarterly rebalancing."""
    if horizon == "swing":
        return Params(rebalance_days=5, top_n=12, target_vol=0.18, max_position=0.12, stop_loss=0.05, profit_target=0.12,
                      min_hold=3, max_hold=60, fwd_days=21, history_years=3, cost_bps=15.0)
    if horizon == "longterm":
        return Params(rebalance_days=63, top_n=15, target_vol=0.12, max_position=0.20, stop_loss=0.15, profit_target=0.50,
                      min_hold=126, max_hold=1825, fwd_days=21, history_years=10, cost_bps=8.0)
    raise ValueError(f"unknown horizon {horizon!r}")


# Regime weight per factor, ordered as REGIMES.
LONG_TERM_WEIGHTS = {
    "momentum_12_1": (0.16, 0.10, 0.03, 0.00),
    "momentum": (0.06, 0.05, 0.02, 0.00),
    "price_accel": (0.04, 0.03, 0.02, 0.01),
    "rel_strength": (0.08, 0.06, 0.04, 0.03),
    "sector_momentum": (0.05, 0.04, 0.03, 0.02),
    "quality": (0.04, 0.09, 0.18, 0.22),
    "piotroski": (0.04, 0.06, 0.10, 0.12),
    "growth": (0.08, 0.07, 0.05, 0.04),
    "roic": (0.03, 0.05, 0.08, 0.08),
    "value": (0.02, 0.07, 0.12, 0.14),
    "fmp_alpha": (0.10, 0.08, 0.06, 0.04),
    "earnings_surprise": (0.07, 0.06, 0.04, 0.03),
    "sentiment": (0.07, 0.06, 0.04, 0.02),
    "flow_signal": (0.07, 0.06, 0.04, 0.03),
    "liquidity": (0.04, 0.07, 0.12, 0.18),
    "high_52w": (0.05, 0.05, 0.03, 0.02),
}
SWING_WEIGHTS = {
    "momentum": (0.18, 0.14, 0.05, 0.02),
    "price_accel": (0.12, 0.10, 0.04, 0.02),
    "rel_strength": (0.10, 0.08, 0.04, 0.02),
    "sector_momentum": (0.08, 0.06, 0.03, 0.01),
    "flow_signal": (0.14, 0.12, 0.10, 0.05),
    "mean_reversion": (0.08, 0.10, 0.20, 0.10),
    "earnings_surprise": (0.12, 0.10, 0.08, 0.03),
    "sentiment": (0.06, 0.08, 0.06, 0.02),
    "high_52w": (0.06, 0.06, 0.02, 0.01),
    "liquidity": (0.04, 0.08, 0.16, 0.30),
    "quality": (0.02, 0.04, 0.12, 0.20),
    "value": (0.00, 0.04, 0.10, 0.22),
}

# Always-on score adjustments (factor -> coefficient).
LONG_TERM_ADJUST = {
    "volatility": -0.08, "skewness": -0.03, "mean_reversion": -0.03, "accruals": -0.04,
}
LONG_TERM_CRISIS = {"momentum_12_1": -0.15, "piotroski": 0.10}
LONG_TERM_VOL = -0.005
SWING_ADJUST = {"volatility": -0.10, "skewness": -0.04, "accruals": -0.04}
SWING_CRISIS = {"momentum": -0.20}
SWING_VOL = -0.006

# Intraday volume profile, one entry per half hour.
VWAP_PROFILE = (0.08, 0.06, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05, 0.06, 0.07, 0.10, 0.12, 0.11)

# Rate decision dates.
FOMC_DATES = (
    "2024-01-31", "2024-03-20", "2024-05-01", "2024-06-12",
    "2024-07-31", "2024-09-18", "2024-11-07", "2024-12-18",
    "2025-01-29", "2025-03-19", "2025-05-07", "2025-06-18",
    "2025-07-30", "2025-09-17", "2025-11-05", "2025-12-17",
)

# Sentiment lexicon.
POSITIVE_WORDS = (
    "beat", "beats", "surge", "surges", "rally", "rallies", "upgrade", "upgraded", "strong",
    "growth", "record", "profit", "profits", "bullish", "raised", "guidance", "buyback",
    "dividend", "outperform", "overweight", "partnership", "acquisition", "launch", "approved",
)
NEGATIVE_WORDS = (
    "miss", "misses", "plunge", "plunges", "selloff", "downgrade", "downgraded", "weak",
    "decline", "loss", "losses", "bearish", "lawsuit", "probe", "fraud", "recall",
    "investigation", "cut", "lowered", "warning", "default", "layoff", "restructuring",
    "fine", "penalty",
)

AUM_LEVELS = (100_000.0, 500_000.0, 1_000_000.0, 5_000_000.0, 10_000_000.0, 50_000_000.0, 100_000_000.0)
