"""The wide rows of the panel stay where they are: what is known of a ticker comes to its bars, ranks are taken in arrays."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import crosssection as CS
from alphaloom.operators import fundamentals as FU
from alphaloom.operators import ic as IC
from alphaloom.operators import scale
from alphaloom.params import Params
from alphaloom.plans import panel as PN

DAY = date(2020, 1, 1)
P = Params(rebalance_days=20, min_history=60, min_adv=0.0)


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(4)
    days = [DAY + timedelta(days=i) for i in range(420)]
    bars = [(t, d, 50 + 10 * rng.random(), float(rng.randint(1, 9))) for t in range(6) for d in days if t != 5 or d.day % 9 == 0 or d < days[150]]
    facts = [(t, d, *(rng.choice([None, 0.0, rng.uniform(-5, 9)]) for _ in range(7))) for t in (0, 1, 2, 4) for d in [*rng.sample(days, 3), DAY - timedelta(days=300), *([None] if t == 2 else [])]]
    names = "cfo double, capex double, revenue double, net_income double, total_assets double, total_debt double, equity double"
    f = spark.createDataFrame(facts, f"ticker long, available_date date, {names}")
    for c in ("ebit", "gross_profit", "current_assets", "current_liab"):
        f = f.withColumn(c, F.col("revenue") * 0.3 + F.col("equity"))
    members = [(0, date(1, 1, 1), None), (1, days[150], days[200]), (1, days[300], None), (2, date(1, 1, 1), days[260]), (4, date(1, 1, 1), None), (5, date(1, 1, 1), None)]
    return (spark.createDataFrame(bars, "ticker long, d date, close double, volume double"), f,
            spark.createDataFrame(members, "ticker long, valid_from date, valid_to date"),
            spark.createDataFrame([(0, "A"), (1, "B"), (2, None), (4, "A"), (4, "C")], "ticker long, sector string"),
            spark.createDataFrame([(days[130], "crisis")], "d date, regime string"))


def test_panel_is_that_of_joins(spark, market):
    """Statements, memberships and sectors as if joined to the rows: late, missing, undated and several ones."""
    bars, f, members, sectors, regimes = market
    got = PN.research_panel(bars, sectors, regimes, P, f, members)
    at = PN.pit_universe(bars, P)
    at = at.join(members.withColumnRenamed("ticker", "m"), (F.col("ticker") == F.col("m")) & (F.col("reb_d") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("reb_d") < F.col("valid_to"))), "left_semi")
    at = FU.piotroski(FU.growth(FU.with_prior_year(at, FU.ratios(f), probe_time="reb_d"))).withColumn("accruals", FU.accruals())
    at = at.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    cols = [c for c in got.columns if c != "regime"]
    want = sorted(map(str, at.select(*cols).collect()))
    assert sorted(map(str, got.select(*cols).collect())) == want and len(want) > 40
    assert {r["regime"] for r in got.where(F.col("reb_d") > DAY + timedelta(days=140)).collect()} == {"crisis"}


def test_rows_of_rebalances_are_not_dealt(spark, market):
    bars, f, members, sectors, _ = market
    plan = PN.pit_universe(bars, P, None, PN._known(sectors, f, members))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("FlatMapCoGroupsInArrow")]
    assert "SortMergeJoin" not in above and "Exchange hashpartitioning" not in above


def test_few_rows_are_handed_out(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = spark.range(1000).withColumn("k", F.col("id") % 3)
        plan = scale.attach(x, x.groupBy("k").count(), ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan


def _names(spark):
    rng = random.Random(8)
    rows = [(k, t, *(None if rng.random() < 0.05 else float(rng.randint(0, 6)) if i % 2 else (1.0 if i == 4 else rng.random()) for i in range(len(CS.FACTORS)))) for k in range(3) for t in range(40 if k else 4)]
    z = spark.createDataFrame(rows + rows[50:53], "k int, ticker long, " + ", ".join(f"{c} double" for c in CS.FACTORS))
    fwd = [(k, t, None if t == 7 else round(rng.uniform(-1, 1), 1)) for k in range(3) for t in range(45)]
    return z, spark.createDataFrame(fwd + fwd[60:62], "k int, ticker long, fwd_return double")


@pytest.mark.parametrize("whole", [1 << 20, 20])
def test_ranks_of_whole_dates(spark, monkeypatch, whole):
    """One row per name gives what rows of factors give, with ties, gaps, constant factors and repeated names; large dates too."""
    monkeypatch.setattr(IC, "WHOLE_ROWS", whole)
    z, fwd = _names(spark)
    want = {(r["k"], r["factor"]): (r["n"], r["ic"]) for r in IC.factor_ic(CS.stacked_factors(z, ["k"]), fwd, ["k"]).collect()}
    rows = IC.factor_ic(z, fwd, ["k"]).collect()
    got = {(r["k"], r["factor"]): (r["n"], r["ic"]) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(want) > 40
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1e-12) for x in want)
