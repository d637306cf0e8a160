"""Inputs shared by several registered queries, memoised per (session, folder).

Only handles to materialised files are kept, so a panel used by a dozen queries
is computed once per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from alphaloom.operators import crosssection as CS
from alphaloom.operators.asof import membership_intervals
from alphaloom.operators.regime import regime_series
from alphaloom.params import Params
from alphaloom.plans import panel as PN
from alphaloom.sources.storage import materialize
from alphaloom.sources.tables import Tables

# thresholds fitted to the synthetic tables' volumes
TEST_PARAMS = Params(min_adv=1000.0, min_universe=5)

_memo: dict = {}


def memo(t: Tables, name: str, make):
    key = (t.spark.sparkContext.applicationId, t.root, name)
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


def regimes(t: Tables) -> DataFrame:
    return regime_series(t.macro_series)


def calendar(t: Tables, p: Params) -> tuple[DataFrame, DataFrame]:
    return memo(t, f"calendar_{p.rebalance_days}", lambda: PN.calendar(t.dates, p))


def panel(t: Tables) -> DataFrame:
    return memo(t, "panel", lambda: PN.research_panel(
        t.calm, t.sectors, regimes(t), TEST_PARAMS, t.fundamentals,
        membership_intervals(t.baseline, t.membership_events), calendar(t, TEST_PARAMS)))


def normalized(t: Tables) -> DataFrame:
    """The z-scores of the shared panel, one row per name."""
    return memo(t, "z", lambda: PN.normalized_panel(panel(t)))


def zscores(t: Tables) -> DataFrame:
    return CS.stacked_factors(normalized(t), ["k", "regime"])


def scored(t: Tables, kind: str = "longterm"):
    """(z-scores with regime, scores) of the shared panel."""
    return zscores(t), memo(t, f"scores_{kind}", lambda: materialize(PN.scores(normalized(t), panel(t), kind), "scores"))
