"""Planning, relations, entry plans and forensics on fixtures of a few rows."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tests.test_operators import bars
from tidemark.operators import entries as N
from tidemark.operators import experiments as Y

GRID = {"a": [1.0, 2.0, 3.0], "b": [0.1, 0.2], "c": [5.0, 6.0, 7.0, 8.0]}


def test_content_hash_ignores_order_volatile_fields_and_nan(spark):
    one = spark.sql("SELECT 1 AS a, named_struct('y', CAST('NaN' AS DOUBLE), 'x', 's') AS n, map('k', 1, 'j', 2) AS m, 'now' AS created_at")
    two = spark.sql("SELECT map('j', 2, 'k', 1) AS m, named_struct('x', 's', 'y', CAST(NULL AS DOUBLE), 'path', '/tmp') AS n, 1 AS a, 'later' AS created_at")
    three = two.withColumn("a", F.lit(2))
    a, b, c = (df.select(Y.content_hash(df)).first()[0] for df in (one, two, three))
    assert a == b != c


def test_whole_grid_when_the_budget_allows(spark):
    rows = {tuple(r)[1:] for r in Y.parameter_grid(spark, GRID, 24).collect()}
    assert rows == set(itertools.product(*GRID.values()))


@pytest.mark.parametrize("budget", [4, 9, 23])
def test_sampled_grid_covers_each_axis(spark, budget):
    rows = [tuple(r) for r in Y.parameter_grid(spark, GRID, budget, seed=3).collect()]
    assert len(rows) == len(set(rows)) == budget
    for i, values in enumerate(GRID.values()):
        assert {r[i + 1] for r in rows} == set(values)
    assert sorted(rows) == sorted(tuple(r) for r in Y.parameter_grid(spark, GRID, budget, seed=3).collect())


def shares(scores: list[float], low: float, high: float) -> list[float]:
    """Bisection for the common factor."""
    s = [x if x and x > 0 else 0.0 for x in scores]
    if not sum(s):
        return [1 / len(s)] * len(s)
    at, to = 0.0, 1e9
    for _ in range(200):
        mid = (at + to) / 2
        at, to = (mid, to) if sum(min(high, low + mid * x) for x in s) < 1 else (at, mid)
    out = [min(high, low + at * x) for x in s]
    spare, idle = 1 - sum(out), [i for i, x in enumerate(s) if not x]
    return [p + (spare / len(idle) if spare > 1e-9 and i in idle else 0) for i, p in enumerate(out)]


@pytest.mark.parametrize(("scores", "low", "high"), [([0.9, 0.5, 0.1, 0.1], 0.02, 0.4), ([5.0, 0.0, 0.0], 0.02, 0.7), ([0.0, None, -1.0], 0.02, 0.7), ([1.0, 1.0], 0.1, 0.5), ([0.2, 0.3, 0.5], 0.0, 1.0)])
def test_shares_keep_their_bounds(spark, scores, low, high):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(scores)], "g string, i int, s double")
    got = [r["share"] for r in Y.bounded_shares(df, "g", "i", "s", low, high).orderBy("i").collect()]
    assert got == pytest.approx(shares(scores, low, high), abs=1e-6) and sum(got) == pytest.approx(1)


def test_thompson_picks_one_and_prefers_winners(spark):
    arms = spark.createDataFrame([(e, a, 90 if a == "x" else 10, 10 if a == "x" else 90) for e in range(200) for a in "xyz"], "e int, a string, w int, l int")
    out = Y.thompson(arms, "e", "a", "w", "l", seed=1).collect()
    picked = [r["a"] for r in out if r["picked"]]
    assert len(picked) == 200 and 110 < picked.count("x") < 170
    assert all(0.02 - 1e-12 <= r["share"] <= 0.7 + 1e-12 and 0 < r["draw"] < 1 for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, Y.thompson(arms.repartition(3), "e", "a", "w", "l", seed=1).collect()))


def test_relations_match_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(f"k{i:02}", f"f{rng.randrange(12)}", rng.choice(["long", "short"]), [rng.gauss(3 * (i % 3), 0.12) for _ in range(4)]) for i in range(40)] + [("z1", "q", "long", [float("nan")] * 4), ("z2", "q", "long", []), ("z3", "p", "long", [])]
    want = {}
    for (a, fa, sa, va), (b, fb, sb, vb) in itertools.combinations(rows, 2):
        fine = va and len(va) == len(vb) and all(map(math.isfinite, va + vb))
        sim = 1 / (1 + math.dist(va, vb) / 2) if fine else 0.0
        if fa == fb:
            want[a, b] = ("family_variant", max(sim, 0.75))
        elif sim >= 0.92:
            want[a, b] = ("near_duplicate" if sa == sb else "opposite_side_placebo", sim)
    df = spark.createDataFrame(rows, "key string, family string, side string, centroid array<double>")
    got = {(r[0], r[1]): (r[2], r[3]) for r in Y.pattern_relations(df).collect()}
    assert got.keys() == want.keys() and {v[0] for v in want.values()} == {"family_variant", "near_duplicate", "opposite_side_placebo"}
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    known = Y.pattern_relations(df, keep=5)
    assert {(r[0], r[1]) for r in known.collect()} == set(sorted(want)[-5:])
    assert Y.pattern_relations(df, known).count() == len(want) - 5


def test_cup_backtest_trades_one_at_a_time(spark):
    cup = [100 - 20 * math.sin(math.pi * i / 29) for i in range(30)]
    closes = (cup + [100.0] * 12) * 4
    out = Y.cup_backtest(bars(spark, [(c, c * 1.01, c * 0.99, c, 1e6) for c in closes]), 30, 10).orderBy("date").collect()
    days = [r["date"].toordinal() for r in out if not r["skipped"]]
    assert days and all(b - a >= 10 for a, b in itertools.pairwise(days))
    grown = Y.compounded(Y.cup_backtest(bars(spark, [(c, c * 1.01, c * 0.99, c, 1e6) for c in closes]), 30, 10)).orderBy("date").collect()
    equity = 3000.0
    for r in grown:
        equity *= 1 + 0.01 * r["r"]
        assert r["equity"] == pytest.approx(equity)


GOOD = {"side": "long", "accepted": True, "entry": 10.0, "stop": 9.0, "target": 15.0, "price": 10.1, "score": 0.9, "effective_events": 60.0, "symbols": 9.0, "sessions": 9.0, "buckets": 3.0, "net_ev_r": 0.3, "spread_bps": 5.0, "spread_cost_r": 0.01, "dollar_volume": 5e6, "rvol": 2.5, "rvol_acceleration": 0.5, "vwap_slope": 0.01, "phase": 1.0, "range_position": 0.95, "age_seconds": 10.0, "minutes_to_flat": 60.0}


@pytest.mark.parametrize(
    ("change", "action", "code"),
    [({}, "ENTER_PAPER", None), ({"accepted": False, "spread_bps": 90.0}, "SHADOW_ONLY", "spread_too_wide"), ({"stop": 10.0}, "REJECT", "invalid_entry_stop_target"), ({"spread_bps": None}, "REJECT", "missing_spread"), ({"rvol": 1.0}, "WAIT", "weak_rvol"), ({"side": "short", "stop": 11.0, "target": 5.0, "price": 10.0}, "WAIT", "adverse_vwap_slope"), ({"age_seconds": 181.0}, "REJECT", "candidate_stale")],
)
def test_lab_entry_plan(spark, change, action, code):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {N.FIELDS[k]}" for k in row))
    r = N.lab_entry_plan(df).first()
    assert r["action"] == action and (code in r["reason_codes"] if code else r["reason_codes"] == [])


def test_forensics_of_unknown_measures(spark):
    kind = "reasons string, cost_passed boolean, oos_expectancy double, oos_profit_factor double, drawdown double, samples int, symbols int, years int"
    rows = [(None, None, None, None, None, 60, 8, 2), (None, None, None, None, None, None, None, None), ("WRC and cost", False, 0.1, 1.1, 13.0, 60, 8, 2)]
    got = [r["failures"] for r in N.forensics(spark.createDataFrame(rows, kind)).collect()]
    assert got == [[], ["insufficient_data"], ["cost_dominated", "oos_unstable", "statistical_datamined", "drawdown_excessive"]]
