"""The discovery gate on single candidates: each case changes one thing of a candidate that passes."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import validation as D

GOOD = {
    "id": 0, "timeframe": "1d", "samples": 150.0, "effective_samples": 90.0, "train_samples": 120.0, "symbols": 12.0, "years": 3.0, "event_applied": True, "event_min_gain": 0.08, "event_side_gain": 0.07,
    "best_expectancy": 0.6, "expectancy": 0.5, "best_profit_factor": 2.4, "profit_factor": 2.2, "best_drawdown": 5.0, "stability": 0.7, "adjusted_p": 0.01, "wrc_p": 0.05, "spa_p": 0.05, "lift": 0.3, "ci_low": 0.1, "overfit": 0.2, "purged_folds": 5.0, "purged_positive": 0.8,
    "deflated_sharpe": 0.9, "probabilistic_sharpe": 0.9, "fill_probability": 0.8, "size_p25": 500.0, "folds": 4.0, "positive_folds": 0.75, "oos_expectancy": 0.3, "oos_profit_factor": 1.6, "hit_rate": 0.2, "trigger_rate": 0.5, "replay_expectancy": 0.2, "replay_fills": 0.8, "invariance": 0.7,
    "failing_buckets": 0.0, "challenge_score": 0.8, "challenge_failures": 0.0, "dsr": 0.97, "stationary_low": 0.05, "fdr_passed": True, "concentration_passed": True, "edge_passed": True, "decay_passed": True, "stress_passed": True, "depends_on_three": False, "survivorship_biased": False, "point_in_time": True,
    "levels": [(3.0, 0.9, 5.0), (4.0, 0.4, 2.1), (5.0, 0.3, 2.0)],
}
#: What is changed, the status, and the codes that appear besides those of GOOD.
CASES = [
    ({}, "lab_candidate", []), ({"samples": 99.0}, "rejected", ["SAMPLES_TOO_FEW", "CONFIRMATION_ADVISED"]), ({"samples": 99.0, "timeframe": "30m", "train_samples": 60.0, "symbols": 6.0, "years": 1.0}, "lab_candidate", ["ONE_YEAR"]),
    ({"samples": 49.0, "timeframe": "30m"}, "rejected", ["SAMPLES_TOO_FEW"]), ({"effective_samples": 20.0}, "rejected", ["SAMPLES_EFFECTIVE_TOO_FEW", "CONFIRMATION_ADVISED"]), ({"effective_samples": 20.0, "timeframe": "1h"}, "lab_candidate", []), ({"effective_samples": None}, "lab_candidate", []),
    ({"timeframe": " Daily ", "event_applied": None}, "rejected", ["EVENT_FILTER_NOT_SHOWN"]), ({"event_min_gain": 0.069}, "rejected", ["EVENT_GAIN_TOO_SMALL"]), ({"event_side_gain": None}, "rejected", ["EVENT_GAIN_OF_SIDE_TOO_SMALL"]), ({"timeframe": "", "event_applied": None}, "lab_candidate", []),
    ({"timeframe": "30m", "event_applied": False}, "lab_candidate", []), ({"symbols": 7.0}, "rejected", ["SYMBOLS_TOO_FEW"]), ({"symbols": 3.0}, "rejected", ["SYMBOLS_TOO_FEW", "FEW_SYMBOLS"]), ({"years": 1.0}, "rejected", ["YEARS_TOO_FEW", "ONE_YEAR"]),
    ({"fdr_passed": False}, "rejected", ["FDR_FAILED"]), ({"fdr_passed": None}, "lab_candidate", []), ({"adjusted_p": 0.25}, "lab_candidate", []), ({"adjusted_p": 0.26}, "rejected", ["NOT_SIGNIFICANT"]), ({"adjusted_p": None}, "lab_candidate", []), ({"ci_low": math.nan}, "rejected", ["NOT_FINITE_CI_LOW", "INTERVAL_WEAK"]),
    ({"best_drawdown": math.inf}, "rejected", ["NOT_FINITE_BEST_DRAWDOWN", "DRAWDOWN_TOO_LARGE"]), ({"samples": math.nan}, "rejected", ["NOT_FINITE_SAMPLES"]), ({"levels": [(3.0, 0.9, 5.0)]}, "rejected", ["NO_EDGE_AT_REWARD_RISK", "NO_EVIDENCE_AT_REWARD_RISK", "-PROMOTION_BEYOND_LAB_BLOCKED"]),
    ({"levels": None}, "rejected", ["NO_EDGE_AT_REWARD_RISK", "NO_EVIDENCE_AT_REWARD_RISK", "-PROMOTION_BEYOND_LAB_BLOCKED"]), ({"levels": [(4.0, 0.2, 1.5)]}, "rejected", ["EDGE_TOO_SMALL_AT_REWARD_RISK", "-PROMOTION_BEYOND_LAB_BLOCKED"]), ({"levels": [(4.0, math.nan, 9.0), (6.0, 0.4, 2.0)]}, "lab_candidate", []),
    ({"oos_expectancy": 0.0}, "lab_watchlist", ["OUT_OF_SAMPLE_NOT_POSITIVE"]), ({"dsr": 0.94}, "lab_watchlist", ["FAMILY_SHARPE_TOO_LOW"]), ({"dsr": None, "stationary_low": 0.0}, "lab_watchlist", ["FAMILY_SHARPE_TOO_LOW", "STATIONARY_INTERVAL_NOT_POSITIVE"]), ({"stationary_low": math.nan}, "lab_watchlist", ["STATIONARY_INTERVAL_NOT_POSITIVE"]),
    ({"stationary_low": None}, "lab_candidate", []), ({"point_in_time": False}, "lab_watchlist", ["UNIVERSE_NOT_POINT_IN_TIME"]), ({"survivorship_biased": True, "dsr": 0.1}, "lab_watchlist", ["FAMILY_SHARPE_TOO_LOW"]), ({"point_in_time": None}, "lab_candidate", []), ({"replay_fills": 0.3}, "lab_candidate", ["REPLAY_FILLS_WEAK"]),
    ({"challenge_score": 0.5, "challenge_failures": 1.0}, "rejected", ["CHALLENGE_FAILED", "CHALLENGE_SCORE_NEAR"]), ({"folds": 0.0}, "lab_candidate", ["NO_FOLDS"]), ({"folds": None, "positive_folds": None}, "lab_candidate", ["NO_FOLDS"]), ({"positive_folds": 0.4}, "rejected", ["FOLDS_UNSTABLE"]), ({"size_p25": 100.0}, "lab_candidate", ["SIZE_SMALL"]), ({"size_p25": None}, "lab_candidate", []),
    ({"best_expectancy": None, "expectancy": None}, "rejected", ["NO_POSITIVE_EXPECTANCY"]), ({"train_samples": None}, "lab_candidate", []), ({"train_samples": 60.0, "adjusted_p": 0.9}, "rejected", ["SAMPLES_TRAIN_TOO_FEW", "NOT_SIGNIFICANT"]), ({"depends_on_three": True, "invariance": 0.2}, "rejected", ["DEPENDS_ON_THREE_SYMBOLS", "INVARIANCE_VERY_WEAK"]),
]


@pytest.fixture(scope="module")
def judged(spark):
    kind = lambda v: "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "string" if isinstance(v, str) else "array<struct<level: double, expectancy: double, profit_factor: double>>" if isinstance(v, list) else "double"
    rows = [tuple((GOOD | change | {"id": i}).values()) for i, (change, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {kind(v)}" for k, v in GOOD.items()))
    return {r.id: r for r in D.validate(df).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_one_change(judged, case):
    _, status, codes = CASES[case]
    r = judged[case]
    base = {"PROMOTION_BEYOND_LAB_BLOCKED"}
    for code in codes:
        base = base - {code[1:]} if code.startswith("-") else base | {code}
    assert (r.status, set(r.rejections) | set(r.warnings)) == (status, base)
    assert r.passed == (status != "rejected") and r.confirm == ("CONFIRMATION_ADVISED" in codes)
    if case == 1:
        assert r.confirm_priority == pytest.approx(0.6 * 0.45 + 0.6 * 0.25 + 0.3 * 0.2 + 0.99 * 0.1)


def test_missing_columns_and_one_pass(spark):
    df = spark.createDataFrame([(1, "1d", 3.0, "x")], "id int, timeframe string, samples double, status string")
    out = D.validate(df)
    r = out.first()
    assert r.status == "rejected" and r.rejections[0] == "EVENT_FILTER_NOT_SHOWN" and "NO_FOLDS" in r.warnings and r.id == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    limits = D.LIMITS | {"min_samples": 2, "daily_gain": 0.0}
    assert not {"SAMPLES_TOO_FEW", "EVENT_FILTER_NOT_SHOWN"} & set(D.validate(df, limits).first().rejections)


def test_best_at_or_above(spark):
    df = spark.createDataFrame([([(3.0, 9.0, 1.0), (4.0, 0.5, 2.0), (5.0, 0.5, 3.0), (6.0, None, 4.0)],), ([(1.0, 1.0, 1.0)],), ([],)], "levels array<struct<level: double, expectancy: double, profit_factor: double>>")
    assert [r.b and tuple(r.b) for r in df.select(D.best_at_or_above(F.col("levels"), 4.0).alias("b")).collect()] == [(4.0, 0.5, 2.0), None, None]
