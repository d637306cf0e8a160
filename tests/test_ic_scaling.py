"""Scales known at a rebalance: brute force over two times, and no look-ahead."""

import random
from datetime import date, timedelta

import pytest

from alphaloom.operators import ic as IC

DAY = date(2024, 1, 1)


def _brute(obs, probes, window, half):
    out = {}
    for k, factor, reb in probes:
        known = sorted(((j, v) for f, j, d, v in obs if f == factor and d < reb), reverse=True)[:window]
        if len(known) < 4:
            out[k, factor] = 1.0
            continue
        w = [2.0 ** (-age / half) for age in range(len(known))]
        mean = sum(a * v for a, (_, v) in zip(w, known)) / sum(w)
        var = sum(a * v * v for a, (_, v) in zip(w, known)) / sum(w) - mean * mean
        ir = mean / (max(var, 0.0) ** 0.5 + 1e-6)
        out[k, factor] = 0.0 if ir < -0.3 else min(max(1 + ir, 0.1), 2.5)
    return out


def _made(seed):
    """Observations that become known out of order, some on the day of a rebalance, some late."""
    rng = random.Random(seed)
    probes = [(k, f, DAY + timedelta(days=21 * k)) for k in range(30) for f in ("a", "b")]
    obs = [(f, k, reb + timedelta(days=rng.choice([20, 21, 22, 60, 5])), rng.uniform(-0.5, 0.6)) for k, f, reb in probes if rng.random() < 0.9]
    return obs, probes


def _scales(spark, obs, probes, window=6):
    o = spark.createDataFrame(obs, "factor string, k int, known_d date, ic double").repartition(3)
    p = spark.createDataFrame(probes, "k int, factor string, reb_d date")
    return {(r["k"], r["factor"]): r["scale"] for r in IC.known_scales(o, p, window, 4.0).collect()}


def test_brute_force(spark):
    obs, probes = _made(1)
    got, want = _scales(spark, obs, probes), _brute(obs, probes, 6, 4.0)
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_no_look_ahead(spark):
    """What becomes known on or after a rebalance changes nothing there; taking it by its own date instead would."""
    obs, probes = _made(2)
    cut = DAY + timedelta(days=21 * 15)
    changed = [(f, k, d, v if d < cut else -v) for f, k, d, v in obs]
    before, after = _scales(spark, obs, probes), _scales(spark, changed, probes)
    assert all(before[k, f] == after[k, f] for k, f, reb in probes if reb <= cut)
    assert any(before[k, f] != after[k, f] for k, f, reb in probes if reb > cut)
    no_lag = lambda rows: [(f, k, DAY + timedelta(days=21 * k - 1), v) for f, k, _, v in rows]
    before, after = _scales(spark, no_lag(obs), probes), _scales(spark, no_lag(changed), probes)
    assert any(before[k, f] != after[k, f] for k, f, reb in probes if reb <= cut)
