"""Clusters with a fixed definition, and blocks drawn for several curves at once."""

import datetime as dt
import math

from alphaloom.operators import regime as RG
from alphaloom.operators import resample as RS

HISTORY = "d date, vix double, spy_3m double, credit double, yc double, vol_regime double"


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(k)


def test_centres_by_brute_force(spark):
    pts = [(12.0 + k % 7, 3.0 - k % 5, 0.01 * (k % 3), 0.0, 1.0 + 0.1 * (k % 4)) for k in range(40)] + [(60.0, -20.0, -0.1, 0.0, 2.0)] * 5 + [(35.0, 9.0, 0.0, 0.0, 0.5)] * 5
    p4 = [(a, b, c, e) for a, b, c, _, e in pts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    centres = [p4[0]]
    while len(centres) < 4:
        centres.append(max(p4, key=lambda p: min(dist(p, m) for m in centres)))
    for _ in range(30):
        at = [min(range(4), key=lambda j: (dist(p, centres[j]), j)) for p in p4]
        groups = [[p for p, a in zip(p4, at) if a == j] for j in range(4)]
        centres = [tuple(sum(x) / len(g) for x in zip(*g)) if g else m for g, m in zip(groups, centres)]
    snap = RG.snapshots(spark.createDataFrame([(day(k), *p) for k, p in enumerate(pts)], HISTORY))
    got = RG.cluster_centres(snap)
    assert all(math.isclose(x, y, abs_tol=1e-9) for m, w in zip(got, centres) for x, y in zip(m, w)) and len(got) == 4
    rows = RG.regime_groups(snap).collect()
    assert sorted(r["n"] for r in rows) == sorted(map(len, groups))


def test_centres_of_few_points(spark):
    none = spark.createDataFrame([], HISTORY)
    assert RG.cluster_centres(RG.snapshots(none)) == [] and RG.detect_regime(none).count() == 0 and RG.regime_groups(RG.snapshots(none)).count() == 0
    same = spark.createDataFrame([(day(k), 20.0, None, float("nan"), 0.0, 1.0) for k in range(31)], HISTORY)
    snap = RG.snapshots(same)
    assert RG.cluster_centres(snap) == [(20.0, 0.0, 0.0, 1.0)] * 4
    assert sorted(r["n"] for r in RG.regime_groups(snap).collect()) == [0, 0, 0, 31]
    one = RG.detect_regime(same).collect()
    assert len(one) == 1 and one[0]["d"] == day(30) and one[0]["regime"] == one[0]["rule_regime"] == one[0]["ml_regime"]
    short = RG.detect_regime(same.where("d < '2020-01-05'")).collect()
    assert len(short) == 1 and short[0]["ml_regime"] == short[0]["rule_regime"]


def test_vote_between_rule_and_group(spark):
    """The last snapshot leaves its group's label; the last five decide, the first seen on a tie."""
    calm, storm, mild = (14.0, 6.0, 0.02, 0.0, 0.7), (40.0, -10.0, -0.05, 0.0, 1.5), (18.0, 2.0, 0.005, 0.0, 1.0)
    last = (24.0, -1.0, 0.0, -0.03, 1.0)                            # -3 points by the rule, -2 without the yield curve
    for end, want in (([calm, calm, storm, mild], "risk_on"), ([calm, storm, storm, mild], "crisis"), ([calm, storm, calm, calm], "risk_on")):
        rows = [calm] * 20 + [storm] * 15 + end + [last]
        got = RG.detect_regime(spark.createDataFrame([(day(k), *r) for k, r in enumerate(rows)], HISTORY)).first()
        assert tuple(got) == (day(len(rows) - 1), "crisis", "risk_off", want)


def curves(spark, rows):
    return spark.createDataFrame(rows, "series_id long, d date, ret double")


def test_joint_draws_by_brute_force(spark):
    n, block, sims = 70, 8, 7
    ret = {1: [math.sin(k) / 50 + 0.001 for k in range(n)], 2: [math.cos(3 * k) / 40 for k in range(n)]}
    gaps = {k for k in range(n) if k % 6 == 5}                     # the second curve lacks dates
    rows = [(s, day(k), r) for s, x in ret.items() for k, r in enumerate(x) if s == 1 or k not in gaps]
    ret[2] = [0.0 if k in gaps else r for k, r in enumerate(ret[2])]

    def figures(x, starts):
        size = [min(block, n - block * b) for b in range(len(starts))]
        path = [v for s, z in zip(starts, size) for v in x[s: s + z]]
        mu = sum(path) / n
        sd = math.sqrt(sum((v - mu) ** 2 for v in path) / n)
        err = math.sqrt(sum((sum(x[s: s + z]) - z * mu) ** 2 for s, z in zip(starts, size))) / n
        return mu, mu / (sd + 1e-9) * math.sqrt(252), err
    blocks = range(-(-n // block))
    got = {(r["series_id"], r["sim"]): r for r in RS.joint_bootstrap(curves(spark, rows), sims, block, 42, 50).collect()}
    assert len(got) == 2 * sims
    for (s, sim), r in got.items():
        own, own_sharpe, own_err = figures(ret[s], [b * block for b in blocks])
        draws = [(((42 * 611953 + sim * 1000003 + b * 7919) % RS.MOD * 48271) % RS.MOD * 69621) % RS.MOD % (n - block) for b in blocks]
        mu, sharpe, err = figures(ret[s], draws)
        want = (own_sharpe, own / own_err, sharpe, (mu - own) / err)
        assert all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9) for a, b in zip((r["model_sharpe"], r["model_t"], r["sharpe"], r["t"]), want))


def test_copies_move_together(spark):
    """A curve and its copy have equal draws; the best of many is judged more strictly than one alone."""
    rows = [(s, day(k), math.sin(k * k) / 50 + 0.002 * (s > 2)) for s in (1, 2, 3) for k in range(90)]
    j = RS.joint_bootstrap(curves(spark, rows), 50, 10)
    per = {}
    for r in j.collect():
        per.setdefault(r["series_id"], {})[r["sim"]] = (r["sharpe"], r["t"])
    assert per[1] == per[2]
    s = {r["series_id"]: r for r in RS.model_against_resampled(j).collect()}
    assert all(r["p_family"] >= r["p_value"] for r in s.values()) and s[1]["p_value"] == s[2]["p_value"]
    assert s[3]["model_sharpe"] > s[1]["model_sharpe"] and s[3]["p_family"] <= s[1]["p_family"]


def test_curves_that_cannot_be_drawn(spark):
    assert RS.joint_bootstrap(curves(spark, [])).count() == 0
    assert RS.joint_bootstrap(curves(spark, [(1, day(k), 0.01) for k in range(20)]), 5, 21, min_n=1).count() == 0
    odd = [(1, day(k), None if k % 2 else 0.01) for k in range(80)] + [(None, day(1), 0.1), (2, None, 0.1), (3, day(3), 0.1)] + [(4, day(k), 0.0) for k in range(80)]
    rows = RS.joint_bootstrap(curves(spark, odd), 5, 21, min_n=60).collect()
    assert {r["series_id"] for r in rows} == {1, 4} and all(r["t"] == 0 for r in rows if r["series_id"] == 4)
