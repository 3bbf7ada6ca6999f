"""Queries of the discovery gate and of features that are known at the open."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookahead as K
from ..operators import validation as D
from ..operators import windows as W
from ..registry import SQL, query
from .inputs import BENCHMARK, daily_bars, table

#: Candidates of parts: metrics made of sums over their line items, as SQL for both engines.
_METRICS = {
    "samples": "n * 4e0", "effective_samples": "n * 2e0", "train_samples": "CASE WHEN k % 5 <> 0 THEN n * 3e0 END", "symbols": "k % 40 + 2e0", "years": "k % 6 + 1e0", "event_min_gain": "CASE WHEN k % 13 <> 0 THEN 7e-2 + (k % 4) * 1e-2 END", "event_side_gain": "7e-2 + (k % 3) * 1e-2",
    "best_expectancy": "q / 1e2 + 1e-1", "expectancy": "q / 1e2", "best_profit_factor": "1e0 + q / 2e1", "profit_factor": "CASE WHEN k % 17 <> 0 THEN 9e-1 + q / 2e1 END", "best_drawdown": "CASE WHEN k % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE (k % 15) * 9e-1 END", "stability": "4e-1 + (k % 50) * 1e-2",
    "adjusted_p": "CASE WHEN k % 3 <> 0 THEN (k % 31) / 1e2 END", "wrc_p": "(k % 29) / 1e2", "spa_p": "(k % 27) / 1e2", "lift": "(k % 10) / 2e1", "ci_low": "(k % 23 - 1e0) / 1e1", "overfit": "(k % 70) / 1e2", "purged_folds": "k % 3 * 1e0", "purged_positive": "(k % 11) / 1e1", "deflated_sharpe": "4e-1 + (k % 61) / 1e2", "probabilistic_sharpe": "5e-1 + (k % 43) / 1e2",
    "fill_probability": "3e-1 + (k % 67) / 1e2", "size_p25": "(k % 19) * 3e1", "folds": "k % 4 * 1e0", "positive_folds": "3e-1 + (k % 8) / 1e1", "oos_expectancy": "q / 1e2 - 2e-1", "oos_profit_factor": "5e-1 + q / 2e1", "hit_rate": "(k % 30) / 1e2", "trigger_rate": "(k % 90) / 1e2",
    "replay_expectancy": "(k % 25 - 1e0) / 1e1", "replay_fills": "2e-1 + (k % 47) / 1e2", "invariance": "2e-1 + (k % 53) / 1e2", "failing_buckets": "k % 2 * 1e0", "challenge_score": "4e-1 + (k % 59) / 1e2", "challenge_failures": "CASE WHEN k % 41 = 0 THEN 1e0 ELSE 0e0 END", "dsr": "CASE WHEN k % 7 <> 0 THEN 9e-1 + (k % 10) / 1e2 END", "stationary_low": "CASE WHEN k % 2 = 0 THEN (k % 9 - 1e0) / 1e1 END",
    "fdr_passed": "CASE WHEN k % 10 <> 0 THEN k % 21 <> 0 END", "concentration_passed": "k % 33 <> 0", "edge_passed": "k % 4 <> 0", "decay_passed": "k % 45 <> 0", "stress_passed": "k % 35 <> 0", "depends_on_three": "k % 51 = 0", "survivorship_biased": "k % 8 = 0", "point_in_time": "CASE WHEN k % 9 <> 0 THEN k % 18 <> 1 END", "event_applied": "CASE WHEN k % 43 <> 0 THEN true END",
    "timeframe": "CASE k % 4 WHEN 0 THEN ' 1D' WHEN 1 THEN '30m' WHEN 2 THEN '' END", "e3": "q / 5e1 + 1e-1", "e4": "q / 6e1", "e5": "q / 7e1 + (k % 2) / 5e1",
}


def _candidates(spark, sf_dir):
    c = F.col
    parts = table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("k")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    rows = parts.select("k", *[F.expr(x).alias(name) for name, x in _METRICS.items()])
    pairs = [F.struct(F.lit(float(x)).alias("level"), c(f"e{x}").alias("expectancy"), (c(f"e{x}") * 4 + 1).alias("profit_factor")) for x in (3, 4, 5)]
    return rows.withColumn("levels", F.array(*pairs)).drop("e3", "e4", "e5")


def _sql() -> str:
    limits = D._shown(D.LIMITS)
    bad = lambda n: f"isnan({n}) OR isinf({n})"
    clean = ", ".join(f"CASE WHEN {bad(n)} THEN {D.DEFAULTS[n].format(**limits)} ELSE {n} END AS {n}" for n in D.DEFAULTS)
    wrong = ", ".join(f"CASE WHEN {bad(n)} THEN 'NOT_FINITE_{n.upper()}' END" for n in D.DEFAULTS)
    listed = {s: ", ".join(f"CASE WHEN {test} THEN '{r.code}' END" for r, test in D.conditions() if r.severity == s) for s in (D.REJECT, D.WARN)}
    pf = "coalesce(best_profit_factor, profit_factor, 0)"
    expectancy = "coalesce(best_expectancy, expectancy, 0)"
    return f"""WITH p AS (SELECT l_partkey AS k, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1), m AS (SELECT k, {", ".join(f"{x} AS {n}" for n, x in _METRICS.items())} FROM p),
c AS (SELECT * REPLACE ({clean}), concat_ws(',', {wrong}) AS wrong, greatest(e4, e5) AS level_expectancy, true AS has_level, greatest(e4, e5) >= {limits["min_expectancy"]} AND greatest(e4, e5) * 4 + 1 >= {limits["min_profit_factor"]} AS level_passed FROM m),
r AS (SELECT *, concat_ws(',', CASE WHEN wrong <> '' THEN wrong END, {listed[D.REJECT]}) AS rejections, concat_ws(',', {listed[D.WARN]}) AS warned, coalesce(oos_expectancy > 0, false) AS oos FROM c),
b AS (SELECT *, CASE WHEN rejections <> '' THEN 'rejected' WHEN level_passed AND oos AND coalesce(stability, 0) >= {limits["min_stability"]} THEN 'lab_candidate' WHEN level_passed OR level_expectancy > 0 THEN 'lab_watchlist' WHEN {expectancy} > 0 THEN 'lab' ELSE 'rejected' END AS base FROM r),
w AS (SELECT *, CASE WHEN base = 'lab_candidate' THEN concat_ws(',', CASE WHEN NOT coalesce(dsr >= {limits["min_dsr"]}, false) THEN 'FAMILY_SHARPE_TOO_LOW' END, CASE WHEN stationary_low <= 0 THEN 'STATIONARY_INTERVAL_NOT_POSITIVE' END) ELSE '' END AS why,
  (',' || rejections) LIKE '%,SAMPLES\\_%' ESCAPE '\\' AND {expectancy} >= {limits["confirm_expectancy"]} AND {pf} >= {limits["confirm_profit_factor"]} AND coalesce(best_drawdown, 0) <= {limits["max_drawdown"]} AND oos AND (adjusted_p IS NULL OR adjusted_p <= {limits["max_p"]}) AND samples >= 50 AND coalesce(train_samples, samples) >= 25 AS confirm FROM b),
x AS (SELECT *, base = 'lab_candidate' AND why = '' AND (coalesce(survivorship_biased, false) OR NOT coalesce(point_in_time, true)) AS capped FROM w)
SELECT k, rejections, concat_ws(',', nullif(warned, ''), CASE WHEN confirm THEN 'CONFIRMATION_ADVISED' END, nullif(why, ''), CASE WHEN capped THEN 'UNIVERSE_NOT_POINT_IN_TIME' END) AS warnings, CASE WHEN why <> '' OR capped THEN 'lab_watchlist' ELSE base END AS status, confirm,
  CASE WHEN confirm THEN greatest({expectancy}, 0) * 0.45::DOUBLE + least({pf} / 4, 1) * 0.25::DOUBLE + greatest(coalesce(lift, 0), 0) * 0.20::DOUBLE + least(samples / 100, 1) * 0.10::DOUBLE ELSE 0 END AS confirm_priority FROM x"""


@query("discovery_gate", _sql(), ("confirm_priority",))
def discovery_gate(spark, sf_dir):
    out = D.validate(_candidates(spark, sf_dir))
    return out.select("k", F.array_join("rejections", ",").alias("rejections"), F.array_join("warnings", ",").alias("warnings"), "status", "confirm", "confirm_priority")


@query(
    "open_features",
    f"SELECT symbol, date, abs(gap_pct) / nullif(prior_atr_pct, 0) AS gap_in_atr, gap_pct - prior_return_5d AS gap_over_trend, benchmark_return_20d FROM ({SQL['gap_event_ledger'].split('FROM (', 1)[1].rsplit(')', 1)[0]}) g WHERE data_quality_status = 'DATA_OK'",
    ("gap_in_atr", "gap_over_trend", "benchmark_return_20d"),
)
def open_features(spark, sf_dir):
    """Features of the ledger, made only of what is known at the open: the plan is checked."""
    ledger = W.gap_ledger(daily_bars(spark, sf_dir), BENCHMARK)
    marked = K.classify(ledger.select(*[c for cs in K.LEDGER.values() for c in cs if c in ledger.columns]), K.LEDGER)
    return K.known_by(marked.filter("data_quality_status = 'DATA_OK'").select("symbol", "date", (F.abs("gap_pct") / F.nullif(F.col("prior_atr_pct"), F.lit(0.0))).alias("gap_in_atr"), (F.col("gap_pct") - F.col("prior_return_5d")).alias("gap_over_trend"), "benchmark_return_20d"))
