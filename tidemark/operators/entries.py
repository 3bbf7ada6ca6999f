"""Entry plans of the paper lab and forensics of candidates: reasons, scores, actions, failure classes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .gates import reasons

#: The lab's thresholds.
LAB = {
    "net_ev_r": 0.05, "effective_events": 25.0, "symbols": 5, "sessions": 5, "buckets": 2, "score": 0.55, "opportunity": 0.60, "timing": 0.55, "liquidity": 0.60, "spread_bps": 50.0,
    "spread_cost_r": 0.08, "dollar_volume": 1_000_000.0, "reward_risk": 4.0, "extension_r": 0.80, "minutes_to_flat": 5.0, "age_seconds": 180, "phase": -0.25, "rvol": 1.05, "rvol_acceleration": -0.35, "vwap_slope": -0.003,
}
#: Reasons that reject; others wait.
HARD = ("invalid_", "reward_risk_", "spread_", "low_dollar_volume", "missing_", "flat_window_", "candidate_stale", "entry_extension_")
#: The candidate's columns and their types; absent ones are null.
FIELDS = {
    "side": "string", "accepted": "boolean", **dict.fromkeys(["entry", "stop", "target", "price", "score", "effective_events", "symbols", "sessions", "buckets", "net_ev_r", "spread_bps", "spread_cost_r",
    "dollar_volume", "rvol", "rvol_acceleration", "vwap_slope", "phase", "range_position", "age_seconds", "minutes_to_flat"], "double"),
}


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(or_, tests)


def _unit(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def lab_entry_plan(candidates: DataFrame, limits: dict = LAB) -> DataFrame:
    """Adds reward_risk, research_score, timing_score, liquidity_score, opportunity_score, reason_codes and action.

    A candidate that research did not accept is shadowed; hard reasons reject, others wait, none enters. Nulls: an unknown spread or
    dollar volume is a reason of its own, other unknown features give none, unknown research counts as zero.
    """
    df = candidates.withColumns({c: F.lit(None).cast(t) for c, t in FIELDS.items() if c not in candidates.columns})
    c, t = F.col, limits
    nil = lambda name, value: F.coalesce(c(name), F.lit(value))
    risk = F.abs(c("entry") - c("stop"))
    df = df.withColumn("reward_risk", F.when(risk > 0, F.abs(c("target") - c("entry")) / risk))
    sign = F.when(c("side") == "short", -1.0).otherwise(1.0)
    df = df.withColumn("extension_r", F.when(c("reward_risk").isNotNull(), F.when(c("price").isNotNull(), F.greatest(F.lit(0.0), sign * (c("price") - c("entry")) / risk))))
    slope = sign * c("vwap_slope")
    research = (
        0.35 * _unit(nil("net_ev_r", 0.0) / (4 * t["net_ev_r"])) + 0.25 * _unit(nil("effective_events", 0.0) / (2 * t["effective_events"])) + 0.15 * _unit(nil("symbols", 0.0) / (1.5 * t["symbols"]))
        + 0.15 * _unit(nil("sessions", 0.0) / (1.5 * t["sessions"])) + 0.10 * _unit(nil("buckets", 0.0) / (1.5 * t["buckets"]))
    )
    timing = (
        0.25 * _unit(nil("score", 0.0)) + 0.20 * _unit((nil("rvol", 1.0) - 1) / 1.5) + 0.20 * _unit(nil("rvol_acceleration", 0.0) + 0.35) + 0.15 * _unit((F.coalesce(slope, F.lit(0.0)) + 0.003) / 0.012)
        + 0.10 * _unit(1 - F.least(F.lit(1.0), F.abs(nil("range_position", 0.5) - 0.95) / 1.25)) + 0.10 * (1 - F.coalesce(_unit(c("extension_r") / t["extension_r"]), F.lit(0.0)))
    )
    liquidity = (
        0.30 * F.coalesce(1 - _unit(c("spread_bps") / t["spread_bps"]), F.lit(0.5)) + 0.20 * F.coalesce(1 - _unit(c("spread_cost_r") / t["spread_cost_r"]), F.lit(0.7))
        + 0.30 * F.coalesce(_unit(F.log1p(c("dollar_volume") / t["dollar_volume"]) / F.log1p(F.lit(4.0))), F.lit(0.0)) + 0.20 * F.coalesce(_unit((c("phase") + 0.25) / 2.25), F.lit(0.5))
    )
    df = df.withColumns({"research_score": research, "timing_score": timing, "liquidity_score": liquidity})
    df = df.withColumn("opportunity_score", 0.40 * c("research_score") + 0.30 * c("timing_score") + 0.30 * c("liquidity_score"))
    why = reasons([
        (c("reward_risk").isNull(), "invalid_entry_stop_target"), (c("reward_risk") < t["reward_risk"], "reward_risk_below_lab_min"), (c("extension_r") > t["extension_r"], "entry_extension_too_large"),
        (~F.coalesce(c("accepted"), F.lit(False)), "research_validation_not_accepted"), (nil("effective_events", 0.0) < t["effective_events"], "research_effective_events_below_lab_min"),
        (nil("symbols", 0.0) < t["symbols"], "research_symbols_below_lab_min"), (nil("sessions", 0.0) < t["sessions"], "research_sessions_below_lab_min"), (nil("buckets", 0.0) < t["buckets"], "research_buckets_below_lab_min"),
        (nil("net_ev_r", 0.0) < t["net_ev_r"], "research_net_ev_below_lab_min"), (c("spread_bps").isNull(), "missing_spread"), (c("spread_bps") > t["spread_bps"], "spread_too_wide"),
        (c("spread_cost_r") > t["spread_cost_r"], "spread_cost_r_too_high"), (c("dollar_volume").isNull(), "missing_dollar_volume"), (c("dollar_volume") < t["dollar_volume"], "low_dollar_volume"),
        (c("rvol") < t["rvol"], "weak_rvol"), (c("rvol_acceleration") < t["rvol_acceleration"], "weak_rvol_acceleration"), (slope < t["vwap_slope"], "adverse_vwap_slope"), (c("phase") < t["phase"], "weak_liquidity_phase"),
        (nil("score", 0.0) < t["score"], "candidate_score_below_lab_min"), (c("age_seconds") > t["age_seconds"], "candidate_stale"), (c("minutes_to_flat") < t["minutes_to_flat"], "flat_window_too_short"),
        (c("timing_score") < t["timing"], "timing_score_below_lab_min"), (c("liquidity_score") < t["liquidity"], "liquidity_score_below_lab_min"), (c("opportunity_score") < t["opportunity"], "opportunity_score_below_lab_min"),
    ])
    hard = F.exists("reason_codes", lambda r: any_of(r.startswith(h) for h in HARD))
    action = F.when(F.array_contains("reason_codes", "research_validation_not_accepted"), "SHADOW_ONLY").when(hard, "REJECT").when(F.size("reason_codes") > 0, "WAIT").otherwise("ENTER_PAPER")
    return df.withColumn("reason_codes", why).withColumn("action", action)


#: Words in rejection reasons that name a class of failure.
FAILURE_WORDS = {
    "cost_dominated": ("cost", "coste"), "oos_unstable": ("oos", "out-of-sample", "market replay"), "statistical_datamined": ("fdr", "wrc", "spa", "p_adj", "significancia", "bootstrap reality"), "drawdown_excessive": ("drawdown",),
    "regime_sensitive_candidate": ("date_shock", "universe_shock", "walk-forward", "regime", "replay"), "concentration_risk": ("concentracion", "concentration", "symbol_concentration"), "operationally_unavailable": ("fill", "operational"),
}


def forensics(candidates: DataFrame) -> DataFrame:
    """candidates (reasons string, cost_passed, oos_expectancy, oos_profit_factor, drawdown, samples, symbols, years) plus failures and dominant.

    Unknown measures give no failure; unknown counts are zero.
    """
    c = F.col
    measured = {
        "cost_dominated": c("cost_passed") == F.lit(False), "oos_unstable": F.coalesce(c("oos_expectancy") <= 0, F.lit(False)) | F.coalesce(c("oos_profit_factor") < 1.2, F.lit(False)), "drawdown_excessive": c("drawdown") > 12.0,
    }
    text = F.lower(F.coalesce(c("reasons"), F.lit("")))
    rules = [(any_of(text.contains(w) for w in words) | F.coalesce(measured.get(name, F.lit(False)), F.lit(False)), name) for name, words in FAILURE_WORDS.items()]
    few = (F.coalesce(c("samples"), F.lit(0)) < 50) | (F.coalesce(c("symbols"), F.lit(0)) < 6) | (F.coalesce(c("years"), F.lit(0)) < 1)
    out = candidates.withColumn("failures", reasons([*rules, (few, "insufficient_data")]))
    return out.withColumn("dominant", F.coalesce(F.get("failures", F.lit(0)), F.lit("unclassified")))


def forensics_report(found: DataFrame, by: str) -> DataFrame:
    """(by, failure, candidates, as_dominant, mean_oos): each class of failure by group, `unclassified` for those without one."""
    listed = F.when(F.size("failures") > 0, F.col("failures")).otherwise(F.array(F.lit("unclassified")))
    rows = found.select(by, "dominant", "oos_expectancy", F.explode(listed).alias("failure"))
    return rows.groupBy(by, "failure").agg(F.count("*").alias("candidates"), F.count_if(F.col("dominant") == F.col("failure")).alias("as_dominant"), F.avg("oos_expectancy").alias("mean_oos"))
