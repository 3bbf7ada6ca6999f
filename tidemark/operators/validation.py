"""The discovery gate: rules as a table, evaluated in one pass to reasons that reject, warnings, and a status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default limits.
LIMITS = {
    "min_samples": 100, "min_effective": 60.0, "min_symbols": 8, "min_years": 2, "intraday_min_samples": 50, "intraday_min_effective": 10.0, "intraday_min_symbols": 6, "intraday_min_years": 1,
    "reward_risk": 4.0, "max_drawdown": 12.0, "min_profit_factor": 1.8, "min_expectancy": 0.25, "min_stability": 0.45, "max_p": 0.25, "min_ci_low": 0.0, "max_overfit": 0.65, "min_positive_folds": 0.50, "min_dsr": 0.95,
    "daily_gain": 0.07, "small_size": 150.0, "confirm_samples": 50, "confirm_profit_factor": 1.6, "confirm_expectancy": 0.20,
}
# What a number that is not finite counts as; most rejects anyway by this.
DEFAULTS = {
    "train_samples": "0", "effective_samples": "0", "best_expectancy": "0", "best_profit_factor": "0", "best_drawdown": "{max_drawdown} + 1", "profit_factor": "0", "expectancy": "0", "stability": "0", "adjusted_p": "1", "wrc_p": "1", "spa_p": "1", "lift": "0", "ci_low": "{min_ci_low} - 1", "overfit": "{max_overfit} + 1",
    "purged_folds": "0", "purged_positive": "0", "deflated_sharpe": "0", "probabilistic_sharpe": "0", "fill_probability": "0", "size_p25": "0", "folds": "0", "positive_folds": "0", "oos_expectancy": "0", "oos_profit_factor": "0", "hit_rate": "0",
}
REJECT, WARN = "reject", "warn"


@dataclass(frozen=True)
class Rule:
    """code, severity, scope (of SCOPES) and the condition as SQL over the candidate's columns; {names} are limits."""

    code: str
    severity: str
    condition: str
    scope: str = "all"


#: In order; a condition that is null doesn't hold, so a missing metric speaks only where a rule says so.
RULES = (
    Rule("EVENT_FILTER_NOT_SHOWN", REJECT, "{daily_gain} > 0 AND NOT coalesce(event_applied, false)", "daily_named"),
    Rule("EVENT_GAIN_TOO_SMALL", REJECT, "{daily_gain} > 0 AND event_applied AND coalesce(event_min_gain + 1e-12 < {daily_gain}, true)", "daily_named"),
    Rule("EVENT_GAIN_OF_SIDE_TOO_SMALL", REJECT, "{daily_gain} > 0 AND event_applied AND coalesce(event_side_gain + 1e-12 < {daily_gain}, true)", "daily_named"),
    Rule("SAMPLES_TOO_FEW", REJECT, "samples < {min_samples}", "daily"), Rule("SAMPLES_TOO_FEW", REJECT, "samples < {intraday_min_samples}", "intraday"),
    Rule("SAMPLES_EFFECTIVE_TOO_FEW", REJECT, "effective_samples < {min_effective}", "daily"), Rule("SAMPLES_EFFECTIVE_TOO_FEW", REJECT, "effective_samples < {intraday_min_effective}", "intraday"),
    Rule("FDR_FAILED", REJECT, "NOT fdr_passed"),
    Rule("SAMPLES_TRAIN_TOO_FEW", REJECT, "coalesce(train_samples, samples) < {min_samples}", "daily"), Rule("SAMPLES_TRAIN_TOO_FEW", REJECT, "coalesce(train_samples, samples) < {intraday_min_samples}", "intraday"),
    Rule("SYMBOLS_TOO_FEW", REJECT, "symbols < {min_symbols}", "daily"), Rule("SYMBOLS_TOO_FEW", REJECT, "symbols < {intraday_min_symbols}", "intraday"),
    Rule("YEARS_TOO_FEW", REJECT, "years < {min_years}", "daily"), Rule("YEARS_TOO_FEW", REJECT, "years < {intraday_min_years}", "intraday"),
    Rule("CONCENTRATED", REJECT, "NOT concentration_passed"),
    Rule("NO_POSITIVE_EXPECTANCY", REJECT, "coalesce(best_expectancy, expectancy, 0) <= 0"), Rule("WEAK_PROFIT_FACTOR_EVERYWHERE", REJECT, "coalesce(best_profit_factor, profit_factor, 0) <= 1"), Rule("DRAWDOWN_TOO_LARGE", REJECT, "coalesce(best_drawdown, 0) > {max_drawdown}"),
    Rule("NO_EDGE_AT_REWARD_RISK", REJECT, "coalesce(level_expectancy, 0) <= 0"), Rule("NO_EVIDENCE_AT_REWARD_RISK", REJECT, "NOT has_level"),
    Rule("EDGE_TOO_SMALL_AT_REWARD_RISK", REJECT, "has_level AND NOT level_passed"),
    Rule("PROFIT_FACTOR_LOW", WARN, "coalesce(profit_factor, best_profit_factor, 0) < {min_profit_factor} AND NOT level_passed"), Rule("EXPECTANCY_LOW", WARN, "coalesce(expectancy, best_expectancy, 0) < {min_expectancy} AND NOT level_passed"),
    Rule("UNSTABLE", REJECT, "coalesce(stability, 0) < {min_stability}"), Rule("NOT_SIGNIFICANT", REJECT, "adjusted_p > {max_p}"), Rule("REALITY_CHECK_FAILED", REJECT, "wrc_p > {max_p}"), Rule("SUPERIOR_ABILITY_FAILED", REJECT, "spa_p > {max_p}"),
    Rule("WEAK_AGAINST_BASELINE", WARN, "NOT edge_passed"), Rule("INTERVAL_WEAK", REJECT, "ci_low < {min_ci_low}"), Rule("OVERFIT", REJECT, "overfit > {max_overfit}"),
    Rule("PURGED_FOLDS_UNSTABLE", REJECT, "coalesce(purged_folds, 0) <> 0 AND coalesce(purged_positive, 0) < {min_positive_folds}"), Rule("DEFLATED_SHARPE_WEAK", REJECT, "deflated_sharpe < 0.5"), Rule("PROBABILISTIC_SHARPE_LOW", WARN, "probabilistic_sharpe < 0.55"),
    Rule("EDGE_DECAYS", REJECT, "NOT decay_passed"), Rule("COST_STRESS_FAILED", REJECT, "NOT stress_passed"),
    Rule("REPLAY_WITHOUT_EXPECTANCY", REJECT, "replay_expectancy <= 0"), Rule("REPLAY_FILLS_TOO_LOW", REJECT, "replay_fills < 0.25"), Rule("REPLAY_FILLS_WEAK", WARN, "replay_fills >= 0.25 AND replay_fills < 0.45"),
    Rule("DEPENDS_ON_THREE_SYMBOLS", REJECT, "depends_on_three"), Rule("INVARIANCE_VERY_WEAK", REJECT, "invariance < 0.25"), Rule("INVARIANCE_WEAK", WARN, "invariance >= 0.25 AND invariance < 0.45"), Rule("BUCKETS_EXPECTED_TO_FAIL", WARN, "failing_buckets > 0"),
    Rule("CHALLENGE_FAILED", REJECT, "challenge_failures > 0"), Rule("CHALLENGE_SCORE_LOW", REJECT, "challenge_score < 0.45"), Rule("CHALLENGE_SCORE_NEAR", WARN, "challenge_score >= 0.45 AND challenge_score < 0.55"),
    Rule("FILLS_UNLIKELY", REJECT, "fill_probability < 0.35"), Rule("SIZE_SMALL", WARN, "size_p25 > 0 AND size_p25 < {small_size}"),
    Rule("FOLDS_UNSTABLE", REJECT, "coalesce(folds, 0) <> 0 AND coalesce(positive_folds, 0) < {min_positive_folds}"), Rule("NO_FOLDS", WARN, "coalesce(folds, 0) = 0"),
    Rule("OUT_OF_SAMPLE_NOT_POSITIVE", WARN, "coalesce(oos_expectancy, 0) <= 0"), Rule("OUT_OF_SAMPLE_PROFIT_FACTOR_WEAK", WARN, "coalesce(oos_profit_factor, 0) < 1.2"), Rule("HITS_RARE", WARN, "coalesce(hit_rate, 0) < 0.08"), Rule("TRIGGERS_RARE", WARN, "coalesce(trigger_rate, 0) < 0.25"),
    Rule("FEW_SYMBOLS", WARN, "symbols <= 3"), Rule("ONE_YEAR", WARN, "years <= 1"), Rule("PROMOTION_BEYOND_LAB_BLOCKED", WARN, "level_passed"),
)

#: Texts and flags that a candidate may have besides the numbers of DEFAULTS.
NUMBERS = ("samples", "symbols", "years", "event_min_gain", "event_side_gain", "replay_expectancy", "replay_fills", "invariance", "failing_buckets", "challenge_score", "challenge_failures", "trigger_rate", "dsr", "stationary_low", *DEFAULTS)
FLAGS = ("event_applied", "fdr_passed", "concentration_passed", "edge_passed", "decay_passed", "stress_passed", "depends_on_three", "survivorship_biased", "point_in_time")
IS_DAILY = "coalesce(lower(trim(timeframe)), '') IN ('1d', '1day', '1 day', 'daily')"
#: Thresholds treat no time frame as daily, which daily_named does not.
SCOPES = {"all": "true", "daily_named": IS_DAILY, "daily": f"({IS_DAILY} OR coalesce(trim(timeframe), '') = '')", "intraday": f"NOT ({IS_DAILY} OR coalesce(trim(timeframe), '') = '')"}


def _shown(limits: dict) -> dict[str, str]:
    """Limits as double literals."""
    return {k: t if "e" in (t := repr(float(v))) else f"{t}e0" for k, v in limits.items()}


def conditions(limits: dict = LIMITS, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, str]]:
    """Each rule with its whole condition: scope, and limits as doubles."""
    return [(r, f"({SCOPES[r.scope]}) AND ({r.condition.format(**_shown(limits))})") for r in rules]


def best_at_or_above(levels: Column, level: float) -> Column:
    """Of (level, expectancy, profit_factor) the one of most expectancy at or above a level, the first of equals; null if there is none."""
    at = F.filter(levels, lambda x: x["level"] >= level)
    value = lambda x: F.coalesce(F.when(~F.isnan(x["expectancy"]) & (F.abs(x["expectancy"]) < float("inf")), x["expectancy"]), F.lit(0.0))
    most = F.array_max(F.transform(at, value))
    return F.get(F.filter(at, lambda x: value(x) == most), F.lit(0))


def validate(candidates: DataFrame, limits: dict = LIMITS, rules: tuple[Rule, ...] = RULES, cap: str = "lab_watchlist") -> DataFrame:
    """Candidates plus rejections, warnings (codes in order), not_finite (names), status, passed, confirm and confirm_priority.

    Columns of NUMBERS and FLAGS that candidates lack are null, that is, not known; `levels` is an array of (level, expectancy,
    profit_factor). A number of DEFAULTS that is not finite counts as its default and rejects. status: rejected with any rejection, else
    lab_candidate (edge at the reward to risk asked for, out of sample too, and stable), lab_watchlist or lab; a candidate without a
    family's deflated Sharpe of min_dsr, or whose stationary interval is known not to be positive, is watched only, and one of a
    biased universe is held at `cap`. confirm: rejected for too few samples among others, but otherwise strong enough to be tried on more.
    """
    c = F.col
    known = lambda name, kind: (c(name) if name in candidates.columns else F.lit(None)).cast(kind)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    shown = _shown(limits)
    numbers = {n: known(n, "double") for n in dict.fromkeys(NUMBERS)}
    wrong = F.array_compact(F.array(*[F.when(numbers[n].isNotNull() & ~finite(numbers[n]), F.lit(n)) for n in ("samples", *DEFAULTS)]))
    own = {n: F.when(finite(x), x).when(x.isNotNull(), F.expr(DEFAULTS[n].format(**shown)).cast("double") if n in DEFAULTS else F.lit(None)) for n, x in numbers.items()}
    levels = (c("levels") if "levels" in candidates.columns else F.lit(None)).cast("array<struct<level: double, expectancy: double, profit_factor: double>>")
    best = best_at_or_above(levels, limits["reward_risk"])
    low = numbers["stationary_low"]
    row = F.struct(F.struct(*[c(f"`{x}`") for x in candidates.columns]).alias("candidate"), wrong.alias("not_finite"))
    view = candidates.select(row.alias("_row"), (low.isNotNull() & (~finite(low) | (low <= 0))).alias("_low"), known("timeframe", "string").alias("timeframe"), *[x.alias(n) for n, x in own.items()], *[known(n, "boolean").alias(n) for n in FLAGS], best.alias("_best"))
    zero = lambda x: F.coalesce(F.when(finite(c(x)), c(x)), F.lit(0.0))
    view = view.withColumns({"has_level": c("_best").isNotNull(), "level_expectancy": zero("_best.expectancy"), "level_passed": c("_best").isNotNull() & (zero("_best.expectancy") >= limits["min_expectancy"]) & (zero("_best.profit_factor") >= limits["min_profit_factor"])})
    listed = {s: F.array_compact(F.array(*[F.when(F.expr(test), F.lit(r.code)) for r, test in conditions(limits, rules) if r.severity == s])) for s in (REJECT, WARN)}
    view = view.withColumns({"rejections": F.concat(F.transform("_row.not_finite", lambda n: F.concat(F.lit("NOT_FINITE_"), F.upper(n))), listed[REJECT]), "warnings": listed[WARN]})
    oos = F.coalesce(c("oos_expectancy") > 0, F.lit(False))
    best_expectancy, best_pf = (F.coalesce(c(f"best_{x}"), c(x), F.lit(0.0)) for x in ("expectancy", "profit_factor"))
    base = F.when(F.size("rejections") > 0, "rejected").when(c("level_passed") & oos & (F.coalesce("stability", F.lit(0.0)) >= limits["min_stability"]), "lab_candidate")
    base = base.when(c("level_passed") | (c("has_level") & (c("level_expectancy") > 0)), "lab_watchlist").when(best_expectancy > 0, "lab").otherwise("rejected")
    held = [(~F.coalesce(c("dsr") >= limits["min_dsr"], F.lit(False)), "FAMILY_SHARPE_TOO_LOW"), (c("_low"), "STATIONARY_INTERVAL_NOT_POSITIVE")]
    biased = F.coalesce(c("survivorship_biased"), F.lit(False)) | ~F.coalesce(c("point_in_time"), F.lit(True))
    view = view.withColumn("_base", base)
    candidate = c("_base") == "lab_candidate"
    why = F.array_compact(F.array(*[F.when(candidate & t, F.lit(n)) for t, n in held]))
    view = view.withColumn("_why", why)
    capped = candidate & (F.size("_why") == 0) & biased
    status = F.when(candidate & (F.size("_why") > 0), "lab_watchlist").when(capped, cap).otherwise(c("_base"))
    drawdown, p = F.coalesce(c("best_drawdown"), F.lit(0.0)), c("adjusted_p")
    strong = (best_expectancy >= limits["confirm_expectancy"]) & (best_pf >= limits["confirm_profit_factor"]) & (drawdown <= limits["max_drawdown"]) & oos & (p.isNull() | (p <= limits["max_p"]))
    seeded = (c("samples") >= limits["confirm_samples"]) & (F.coalesce("train_samples", "samples") >= max(20, limits["confirm_samples"] // 2))
    confirm = F.exists("rejections", lambda r: r.startswith("SAMPLES_")) & F.coalesce(strong & seeded, F.lit(False))
    priority = F.greatest(best_expectancy, F.lit(0.0)) * 0.45 + F.least(best_pf / 4, F.lit(1.0)) * 0.25 + F.greatest(F.coalesce("lift", F.lit(0.0)), F.lit(0.0)) * 0.20 + F.least(c("samples") / max(limits["min_samples"], 1), F.lit(1.0)) * 0.10
    warnings = F.concat("warnings", F.when(confirm, F.array(F.lit("CONFIRMATION_ADVISED"))).otherwise(F.array().cast("array<string>")), "_why", F.when(capped, F.array(F.lit("UNIVERSE_NOT_POINT_IN_TIME"))).otherwise(F.array().cast("array<string>")))
    out = {"not_finite": c("_row.not_finite"), "status": status, "confirm": confirm, "confirm_priority": F.when(confirm, priority).otherwise(0.0), "warnings": warnings}
    names = [x for x in candidates.columns if x not in (*out, "rejections", "passed")]
    told = view.select("_row", "rejections", *[x.alias(n) for n, x in out.items()])
    return told.select(*[c("_row.candidate")[x].alias(x) for x in names], "rejections", *out, (c("status") != "rejected").alias("passed"))
