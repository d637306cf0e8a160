"""Placebo draws: every name in every trial, of which only the best leave their task."""

import numpy as np
import pytest

from alphaloom.operators import crosssection as CS
from alphaloom.operators import resample as RS


def test_best_draws(spark, monkeypatch):
    """The best of all draws and their moments, however the names lie in tasks."""
    monkeypatch.setattr(RS, "DRAWN_NAMES", 50)
    monkeypatch.setattr(RS, "DRAWN_TOGETHER", 17)
    names = spark.createDataFrame([(k, 3 * t) for k in range(4) for t in range(60 if k else 2)] + [(1, 9), (2, None)], "k int, ticker long").repartition(3)
    every = CS.zscore(RS.placebo_scores(names, 6), ["strategy", "k"], "score", "z", eps=1e-9)
    some, stats = RS.placebo_scores(names, 6, best=5)
    assert some.count() < every.count() / 2
    some = CS.zscore(some, ["strategy", "k"], "score", "z", eps=1e-9, stats=stats)
    top = lambda df: {(r["strategy"], r["k"], r["rn"]): (r["ticker"], r["z"]) for r in CS.select_top(df, ["strategy", "k"], 5, "z").collect()}
    got, want = top(some), top(every)
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1e-9) for x in want)
    assert np.isfinite([r["__s"] for r in stats.collect()]).all()
