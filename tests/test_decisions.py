"""Scores, setups, exits and verdicts on small cases."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions as D

PATH = "trade string, bar int, high double, low double, close double, side string, entry double, stop double, target double, minutes_to_flat double, max_bars int, cost_r double, vwap_distance double"


def exits(spark, bars, side="long", entry=100.0, stop=90.0, target=140.0, flat=60.0, most=20, vwap=None):
    rows = [("t", i, *b, side, entry, stop, target, flat, most, 0.0, vwap) for i, b in enumerate(bars)]
    return D.paper_exit(spark.createDataFrame(rows, PATH), "trade", "bar").first()


@pytest.mark.parametrize(
    ("bars", "more", "action", "reason"),
    [
        ([(141.0, 89.0, 100.0)], {}, "EXIT_NOW", "stop_hit"),
        ([(141.0, 99.0, 120.0), (120.0, 80.0, 85.0)], {}, "EXIT_NOW", "target_hit"),
        ([(102.0, 99.0, 101.0)], {"flat": 5.0}, "EXIT_NOW", "force_flat_window"),
        ([(102.0, 99.0, 101.0)], {"most": 1}, "EXIT_NOW", "max_holding_bars"),
        ([(109.0, 99.0, 108.0), (108.0, 102.0, 103.0)], {}, "EXIT_NOW", "profit_giveback"),
        ([(101.0, 97.0, 98.0), (98.0, 93.0, 94.0)], {}, "EXIT_NOW", "loss_reduction_signal"),
        ([(95.0, 93.0, 94.0)], {}, "HOLD", ""),
        ([(95.0, 93.0, 94.0)], {"vwap": -1.0}, "EXIT_NOW", "loss_reduction_signal"),
        ([(101.0, 99.0, 100.0)] * 2, {"most": 3}, "EXIT_NOW", "time_decay_no_progress"),
        ([(110.0, 99.0, 109.0)], {}, "TIGHTEN_STOP", "protect_open_profit"),
        ([(110.0, 80.0, 90.0)], {"stop": 100.0}, "HOLD", ""),
        ([(101.0, 92.0, 93.0)], {"side": "short", "stop": 110.0, "target": 60.0}, "EXIT_NOW", None),
    ],
)
def test_paper_exit(spark, bars, more, action, reason):
    got = exits(spark, bars, **more)
    if reason is None:
        # A short one that is 0.8 R ahead at its low and 0.7 R at its close keeps its profit by a tighter stop.
        assert (got.action, round(got.mfe_r, 6), round(got.current_r, 6), round(got.suggested_stop, 6)) == ("TIGHTEN_STOP", 0.8, 0.7, 95.5)
    else:
        assert (got.action, got.reason) == (action, reason)


def day(n):
    return datetime(2024, 1, n)


def test_setups_end_at_the_first_failure(spark):
    setups = spark.createDataFrame([(i, day(1), s) for i, s in enumerate(["watching", "watching", "watching", "detected", "invalidated", "armed", "watching"])], "setup_id long, detected_at timestamp, status string")
    told = [
        (0, day(2), 4.0, 0.5, True, False, None), (1, day(2), 4.0, 0.5, True, False, False), (1, day(3), 1.0, 0.9, True, False, False), (1, day(4), 4.0, 0.1, True, False, False), (2, day(6), 4.0, 0.3, True, False, False),
        (3, day(2), 4.0, 0.4, True, False, False), (4, day(2), 4.0, 0.4, True, False, False), (5, day(3), None, 0.2, True, None, None), (5, day(2), 4.0, 0.7, None, None, None),
    ]
    evaluations = spark.createDataFrame(told, "setup_id long, at timestamp, reward_risk double, entry_score double, gate_passed boolean, broken boolean, blocked boolean")
    out = D.setup_states(setups, evaluations, ["at"])
    got = {r.setup_id: (r.status, r.reason, r.evaluated, r.entry_score) for r in out.collect()}
    assert got == {
        0: ("entry_ready", "entry_gate_passed", 1, 0.5), 1: ("invalidated", "non_recoverable_or_reward_risk_failed", 2, 0.9), 2: ("expired", "max_age_days_exceeded", 1, 0.3), 3: ("detected", None, 1, 0.4),
        4: ("invalidated", None, 0, None), 5: ("invalidated", "non_recoverable_or_reward_risk_failed", 2, 0.2), 6: ("watching", None, 0, None),
    }
    capped = {r.setup_id: (r.status, r.reason) for r in D.cap_active(out, 2).collect()}
    assert capped[6] == ("expired", "daily_setup_max_active_exceeded") and capped[0][0] == "entry_ready" and capped[3][0] == "detected"
    assert {r.status for r in D.cap_active(out, 0).collect()} == {"expired", "invalidated"}


MATCH = "id int, symbol string, pattern string, score double, similarity double, entry_score double, expectancy double, profit_factor double, stability double, reward_risk double, volume_ratio double, dollar_volume double, extension double, regime_fit double, risk_approved boolean, gate_passed boolean, regime_ok boolean, ambiguity double"


def test_scores_take_nulls_and_infinities(spark):
    full = (1, "a", "p", 1.0, 1.0, 1.0, 9.0, 9.0, 1.0, 9.0, 9.0, 1e9, 0.0, 1.0, True, True, True, 0.0)
    bare = (2, None, "p", *[None] * 15)
    wild = (3, "A", "p", float("nan"), float("inf"), None, float("-inf"), None, None, None, None, None, 3.0, None, False, True, False, None)
    got = {r.id: r for r in D.entry_quality(spark.createDataFrame([full, bare, wild], MATCH)).collect()}
    assert round(got[1].quality, 9) == 1.0 and got[1].actionable and got[1].quality_label == "high"
    assert got[2].quality_flags == ["entry_gate_failed", "thin_liquidity"] and round(got[2].quality, 9) == 0.1
    assert got[3].quality_flags == ["risk_rejected", "regime_filter_failed", "thin_liquidity", "overextended"] and round(got[3].quality, 9) == 0.04


def test_the_best_of_an_exposure_and_levels_of_history(spark):
    rows = [(1, "a", "p", 0.5), (2, "a", "p", 0.9), (3, "b", "p", 0.5), (4, None, "q", 0.5), (5, None, "q", 0.5)]
    matches = spark.createDataFrame([(*r, *[None] * 14) for r in rows], MATCH)
    history = spark.createDataFrame([("p", "a", 1.0, 20), ("p", "*", 0.0, 30)], "pattern string, symbol string, score double, count long")
    scored = D.opportunity_score(D.with_history(matches, history, ["pattern", "symbol"], [["pattern", "symbol"], ["pattern"]]))
    assert {r.id: r.history_count for r in scored.collect()} == {1: 20, 2: 20, 3: 30, 4: None, 5: None}
    out = D.rank_opportunities(scored, ["symbol", "pattern", "id"], ["symbol", "pattern"])
    assert [(r.id, r.opportunity_rank) for r in out.orderBy("opportunity_rank").collect()] == [(2, 1), (4, 2), (3, 3)]
    assert D.rank_opportunities(scored, ["symbol", "pattern", "id"]).count() == 5
    assert D.rank_opportunities(scored.limit(0), ["id"]).count() == 0


def test_verdicts(spark):
    tests = spark.createDataFrame(
        [("a", True, 0.1, False, 2.0, False, False), ("a", False, -1.0, True, 0.0, True, True), ("b", True, 0.1, True, 1.0, None, None), ("c", True, None, None, 1.1, None, True), ("d", False, -1.0, None, None, None, None)],
        "k string, is_target boolean, slipped_expectancy double, operability_fail boolean, profit_factor double, concentration_fail boolean, sample_fail boolean",
    )
    got = {r.k: r.decision for r in D.gap_decision(tests, ["k"], F.col("k") != "d").collect()}
    assert got == {"a": "GAP_CONFIRMATION_SURVIVES_RESEARCH", "b": "GAP_CONFIRMATION_FAIL_OPERABILITY", "c": "GAP_CONFIRMATION_INCONCLUSIVE", "d": "GAP_CONFIRMATION_FAIL_FDR_WRC_SPA"}
