"""Decisions on matches, setups, trades and tests: quality and opportunity scores, state of setups, exits, ordered verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import ladder, reasons
from .ranking import first_per, indexed

# Default thresholds of the scores.
LIMITS = {"min_expectancy": 0.25, "min_profit_factor": 1.8, "min_reward_risk": 4.0, "min_volume_ratio": 1.05, "min_dollar_volume": 5_000_000.0, "max_extension": 2.75, "exploration": 0.15}
# Weights of the scores, and of expectancy, profit factor and stability within the research edge.
EDGE = {"expectancy": 0.55, "profit_factor": 0.30, "stability": 0.15}
QUALITY = {"entry": 0.25, "match": 0.16, "research_edge": 0.17, "reward_risk": 0.11, "liquidity": 0.09, "volume": 0.08, "extension": 0.06, "regime_fit": 0.08}
WITH_HISTORY = {"history": 0.34, "entry": 0.18, "match": 0.10, "research_edge": 0.10, "reward_risk": 0.08, "liquidity": 0.06, "regime_fit": 0.08, "similarity": 0.03, "exploration": 0.03}
WITHOUT_HISTORY = {"entry": 0.22, "match": 0.14, "research_edge": 0.18, "reward_risk": 0.10, "liquidity": 0.08, "regime_fit": 0.10, "history": 0.12, "similarity": 0.04, "exploration": 0.02}
# Statuses that a setup can leave, and those from which a passed gate leads to the entry.
ACTIVE = ["detected", "watching", "waiting_for_confirmation", "armed", "entry_ready"]
ADVANCING = ["watching", "waiting_for_confirmation", "armed"]
# The policy of paper exits, in multiples of the risk.
EXITS = {"protect_start": 0.80, "giveback": 0.35, "min_locked": 0.20, "soft_loss": -0.55, "hard_loss": -1.00, "decay": 0.65, "min_progress": 0.10, "force_minutes": 5.0, "vwap_buffer": 0.05}


def finite(x: str | Column, default: Column | float) -> Column:
    """A number as a double; the default where it is null or not finite."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(default)


def unit(x: str | Column, default: Column | float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite(x, default)))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + parts[name] * w
    return total


def _parts(limits: dict, liquidity_factor: float) -> dict[str, Column]:
    """Components both scores share, each within 0..1."""
    match = unit("score")
    edge = {"expectancy": unit(finite("expectancy", 0.0) / max(limits["min_expectancy"] * 2, 0.01)), "profit_factor": unit(finite("profit_factor", 0.0) / max(limits["min_profit_factor"] * 1.5, 0.01)), "stability": unit("stability")}
    return {
        "match": match, "similarity": unit("similarity"), "entry": unit("entry_score", match), "research_edge": weighted(edge, EDGE), "reward_risk": unit(finite("reward_risk", 0.0) / max(limits["min_reward_risk"], 1.0)),
        "liquidity": unit(finite("dollar_volume", 0.0) / max(limits["min_dollar_volume"] * liquidity_factor, 1.0)), "regime_fit": unit("regime_fit", 0.5),
    }


def entry_quality(matches: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Adds quality (0..1), quality_flags, quality_label and actionable (0.6 or more, no flag).

    Reads score, similarity, entry_score, expectancy, profit_factor, stability, reward_risk, volume_ratio, dollar_volume,
    extension, regime_fit and the booleans risk_approved (null: approved), gate_passed (null: failed), regime_ok (null: not
    known). Null or infinite numbers count as 0, a missing entry score as the match's, a missing fit as 0.5.
    Components are not rounded on the way.
    """
    volume, extension = finite("volume_ratio", 0.0), finite("extension", 0.0)
    parts = _parts(limits, 3.0) | {"volume": unit(volume / max(limits["min_volume_ratio"] * 1.8, 0.01)), "extension": unit(1 - extension / max(limits["max_extension"], 0.01), 1.0)}
    flags = reasons([
        (~F.coalesce("risk_approved", F.lit(True)), "risk_rejected"), (~F.coalesce("gate_passed", F.lit(False)), "entry_gate_failed"), (~F.coalesce("regime_ok", F.lit(True)), "regime_filter_failed"),
        (finite("dollar_volume", 0.0) < limits["min_dollar_volume"], "thin_liquidity"), ((volume != 0) & (volume < limits["min_volume_ratio"]), "weak_volume_confirmation"), (extension > limits["max_extension"], "overextended"),
    ])
    out = matches.withColumns({"quality": weighted(parts, QUALITY), "quality_flags": flags})
    q, blocked = F.col("quality"), F.size("quality_flags") > 0
    label = ladder([(blocked, "blocked"), (q >= 0.78, "high"), (q >= 0.60, "actionable"), (q >= 0.45, "watch")], "weak")
    return out.withColumns({"quality_label": label, "actionable": (q >= 0.60) & ~blocked})


def with_history(matches: DataFrame, history: DataFrame, keys: list[str], levels: list[list[str]]) -> DataFrame:
    """Adds history_score and history_count of the first level that has the match's keys; levels left out of a key are '*' there."""
    out = matches
    for i, level in enumerate(levels):
        at = history.filter(" AND ".join(f"{k} {'<>' if k in level else '='} '*'" for k in keys)).select(*level, F.col("score").alias(f"_s{i}"), F.col("count").alias(f"_c{i}"))
        out = out.join(at, level, "left")
    found = [F.when(F.col(f"_c{i}").isNotNull(), F.struct(F.col(f"_s{i}").alias("s"), F.col(f"_c{i}").alias("c"))) for i in range(len(levels))]
    best = F.coalesce(*found)
    return out.withColumns({"history_score": best["s"], "history_count": best["c"]}).drop(*[f"_{x}{i}" for i in range(len(levels)) for x in "sc"])


def opportunity_score(matches: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Adds opportunity and opportunity_reason: weights differ by whether the match has a history (history_score, history_count)."""
    count = finite("history_count", 0.0)
    share = max(0.0, min(0.30, limits["exploration"]))
    parts = _parts(limits, 5.0) | {"history": F.coalesce("history_score", F.lit(0.5)), "exploration": F.greatest(F.lit(0.0), 1 - F.least(count, F.lit(10.0)) / 10) * share}
    known = count > 0
    return matches.withColumns({
        "opportunity": F.when(known, weighted(parts, WITH_HISTORY)).otherwise(weighted(parts, WITHOUT_HISTORY)),
        "opportunity_reason": F.when(known, "paper_history_weighted").otherwise("research_score_fallback_no_paper_history"),
    })


def match_order(first: list[str], ties: list[str]) -> list[Column]:
    """Numbers descending with null as 0, then a lesser ambiguity, then texts without regard to case."""
    return [*[finite(c, 0.0).desc() for c in first], finite("ambiguity", 0.0), *[F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ties]]


def rank_opportunities(matches: DataFrame, ties: list[str], exposure: list[str] | None = None) -> DataFrame:
    """Adds opportunity_rank (from 1) over all matches, or over the best of each exposure; `ties` must tell rows apart.

    The score's thousandths are counted first, so that no task orders all rows.
    """
    order = match_order(["opportunity", "entry_score", "score", "similarity"], ties)
    best = matches if exposure is None else first_per(matches.withColumns({f"_x{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(exposure)}), [f"_x{i}" for i in range(len(exposure))], order)
    placed = indexed(best.withColumn("_bucket", -F.floor(F.col("opportunity") * 1000)), [], "_bucket", order, "_at", few=True)
    return placed.withColumn("opportunity_rank", F.col("_at") + 1).select(*matches.columns, "opportunity_rank")


def rank_matches(matches: DataFrame, ties: list[str], limit: int) -> DataFrame:
    """The first `limit` by score, entry score, similarity, ambiguity and ties."""
    return matches.orderBy(*match_order(["score", "entry_score", "similarity"], ties)).limit(limit)


def rotation_hash(salt: str, symbol: Column) -> Column:
    """Eight hex digits of salt|symbol by SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), symbol), 256), 1, 8)


def setup_states(setups: DataFrame, evaluations: DataFrame, order: list[str], max_age_days: int = 5, min_reward_risk: float = 3.0, now: Column | None = None) -> DataFrame:
    """Each setup's status after its evaluations in order: status, reason, evaluated (how many counted), entry_score (the last one's).

    setups: setup_id, detected_at, status; evaluations: setup_id, at, reward_risk, entry_score, and the booleans gate_passed,
    broken, blocked (null: false) and, if known, the text invalidation_reason, which breaks the context by itself. The first evaluation that breaks the context, is blocked or lacks reward, or comes too late ends
    the setup, and later ones don't count; short of that a passed gate leads from any waiting status to entry_ready at once, so no
    state is folded row by row. Setups that are not active, and those without evaluations, stay as they are.
    now: a clock; evaluations after it or after a setup's deadline don't count, and setups whose deadline it has reached expire.
    """
    active = setups.filter(F.col("status").isin(ACTIVE)).select("setup_id", "detected_at")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    age = F.floor((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("detected_at").cast("timestamp"))) / 86_400_000_000)
    poor = flag("blocked") | ~F.coalesce(F.col("reward_risk") >= min_reward_risk, F.lit(False))
    own = F.nullif(F.col("invalidation_reason"), F.lit("")) if "invalidation_reason" in evaluations.columns else F.lit(None).cast("string")
    deadline = F.col("detected_at").cast("timestamp") + F.expr(f"INTERVAL {max_age_days} DAYS")
    reason = F.when(flag("broken") | own.isNotNull(), F.coalesce(own, F.lit("setup_context_broken"))).when(poor, "non_recoverable_or_reward_risk_failed").when(age >= max_age_days, "max_age_days_exceeded")
    joined = evaluations.join(active, "setup_id")
    if now is not None:
        joined = joined.filter(F.col("at").cast("timestamp").between(F.col("detected_at").cast("timestamp"), F.least(now, deadline)))
    told = joined.select("setup_id", F.struct(*order).alias("_at"), reason.alias("_reason"), flag("gate_passed").alias("_passed"), F.col("entry_score").alias("_score"))
    ends = told.filter("_reason IS NOT NULL").groupBy("setup_id").agg(F.min("_at").alias("_stop"), F.min_by("_reason", "_at").alias("_ended"))
    seen = told.join(ends, "setup_id", "left").filter(F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop")))
    last = seen.groupBy("setup_id").agg(F.max("_ended").alias("_ended"), F.bool_or("_passed").alias("_passed"), F.max_by("_score", "_at").alias("entry_score"), F.count("*").alias("_n"))
    out = setups.drop("entry_score").join(last, "setup_id", "left")
    ended = F.col("_ended").isNotNull()
    ready = F.coalesce("_passed", F.lit(False)) & F.col("status").isin(ADVANCING)
    after = F.when(ended, F.when(F.col("_ended") == "max_age_days_exceeded", "expired").otherwise("invalidated")).when(ready, "entry_ready").otherwise(F.col("status"))
    why = F.when(ended, F.col("_ended")).when(ready, "entry_gate_passed")
    if now is not None:
        late = ~ended & F.col("status").isin(ACTIVE) & (deadline <= now)
        after, why = F.when(late, "expired").otherwise(after), F.when(late, "max_age_days_exceeded").otherwise(why)
    return out.withColumns({"status": after, "reason": why, "evaluated": F.coalesce("_n", F.lit(0))}).drop("_ended", "_passed", "_n")


def cap_active(states: DataFrame, most: int) -> DataFrame:
    """Active setups beyond the first `most` by entry score, detection and id, all descending, expire. Setup ids are unique."""
    active = F.col("status").isin(ACTIVE)
    order = [finite("entry_score", 0.0).desc(), F.col("detected_at").desc_nulls_last(), F.col("setup_id").desc_nulls_last()]
    kept = states.filter(active).orderBy(*order).limit(max(most, 0)).select("setup_id", F.lit(True).alias("_kept"))
    over = active & F.col("_kept").isNull()
    out = states.join(kept, "setup_id", "left")
    return out.withColumns({"reason": F.when(over, "daily_setup_max_active_exceeded").otherwise(F.col("reason")), "status": F.when(over, "expired").otherwise(F.col("status"))}).drop("_kept")


def paper_exit(paths: DataFrame, key: str, order: str, policy: dict = EXITS) -> DataFrame:
    """One row for each trade: action (EXIT_NOW, TIGHTEN_STOP, HOLD), reason, result, best and worst in R, bars, exit price, stop.

    paths: one row for each closed bar of a trade (key, order unique within it, high, low, close) with the trade's side, entry,
    stop, target, minutes_to_flat, max_bars, cost_r and vwap_distance (null: not known). The stop wins where both are reached in one
    bar. Trades without risk get nulls and HOLD.
    """
    w = Window.partitionBy(key).orderBy(order)
    sign = F.when(F.lower("side") == "short", -1.0).otherwise(1.0)
    risk = F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0))
    in_r = lambda c: (F.col(c) - F.col("entry")) * sign / risk
    rows = paths.withColumns({"_before": F.lag("close").over(w), "_best": F.greatest(in_r("high"), in_r("low")), "_worst": F.least(in_r("high"), in_r("low")), "_close_r": in_r("close"), "_goal": F.abs(F.col("target") - F.col("entry")) / risk, "_sign": sign, "_risk": risk})
    last = F.struct("close", "_before", "_close_r", "entry", "stop", "target", "minutes_to_flat", "max_bars", F.coalesce("cost_r", F.lit(0.0)).alias("cost_r"), "vwap_distance", "_sign", "_risk")
    got = rows.groupBy(key).agg(
        F.max_by(last, order).alias("t"), F.count("*").alias("_n"), F.max("_best").alias("_mfe"), F.min("_worst").alias("_mae"),
        F.min(F.when(F.col("_best") >= F.col("_goal"), F.col(order))).alias("_hit"), F.min(F.when(F.col("_worst") <= policy["hard_loss"], F.col(order))).alias("_stopped"),
    ).select(key, "t.*", *[F.col(c) for c in ("_n", "_hit", "_stopped")], (F.col("_mfe") - F.col("t.cost_r")).alias("mfe_r"), (F.col("_mae") - F.col("t.cost_r")).alias("mae_r"), (F.col("t._close_r") - F.col("t.cost_r")).alias("current_r"))
    c = F.col
    locked = F.greatest(F.lit(policy["min_locked"]), c("mfe_r") - policy["giveback"])
    held = F.least(c("_n"), c("max_bars"))
    failing = F.coalesce(c("_sign") * (c("close") - c("_before")) < 0, F.lit(False)) | F.coalesce(c("_sign") * c("vwap_distance") < -policy["vwap_buffer"] / c("_risk"), F.lit(False))
    reason = ladder([
        (c("_stopped").isNotNull() & (c("_hit").isNull() | (c("_stopped") <= c("_hit"))), "stop_hit"), (c("_hit").isNotNull(), "target_hit"), (c("minutes_to_flat") <= policy["force_minutes"], "force_flat_window"),
        (held >= c("max_bars"), "max_holding_bars"), (c("current_r") <= policy["hard_loss"], "hard_loss_r"), ((c("mfe_r") >= policy["protect_start"]) & (c("current_r") <= locked), "profit_giveback"),
        ((c("current_r") <= policy["soft_loss"]) & failing, "loss_reduction_signal"), ((held / F.greatest(c("max_bars"), F.lit(1)) >= policy["decay"]) & (c("current_r") < policy["min_progress"]), "time_decay_no_progress"),
        (c("mfe_r") >= policy["protect_start"], "protect_open_profit"),
    ], "")
    out = got.withColumns({"bars_held": held, "reason": F.when(c("_risk").isNull(), "").otherwise(reason), "_locked": locked})
    action = F.when(c("reason") == "", "HOLD").when(c("reason") == "protect_open_profit", "TIGHTEN_STOP").otherwise("EXIT_NOW")
    price = F.when(c("reason") == "stop_hit", c("stop")).when(c("reason") == "target_hit", c("target")).otherwise(c("close"))
    out = out.withColumn("action", action)
    return out.select(
        key, "action", "reason", "current_r", "mfe_r", "mae_r", "bars_held", F.when(c("action") == "EXIT_NOW", price).alias("exit_price"),
        F.when(c("action") == "TIGHTEN_STOP", c("entry") + c("_sign") * c("_locked") * c("_risk")).alias("suggested_stop"),
    )


def gap_decision(tests: DataFrame, keys: list[str], family_passed: Column) -> DataFrame:
    """Verdict over the tests that are targets (is_target): the first check that any of them fails names it.

    Reads slipped_expectancy, operability_fail, profit_factor, concentration_fail, sample_fail; nulls fail nothing.
    """
    any_target = lambda test: F.coalesce(F.bool_or(F.col("is_target") & test), F.lit(False))
    checks = {
        "GAP_CONFIRMATION_FAIL_OPEN_SLIPPAGE": F.col("slipped_expectancy") < 0, "GAP_CONFIRMATION_FAIL_OPERABILITY": F.col("operability_fail"), "GAP_CONFIRMATION_INCONCLUSIVE": F.col("profit_factor") < 1.2,
        "GAP_CONFIRMATION_FAIL_CONCENTRATION": F.col("concentration_fail"), "GAP_CONFIRMATION_FAIL_EFFECTIVE_SAMPLE": F.col("sample_fail"),
    }
    out = tests.groupBy(*keys).agg(*[any_target(t).alias(name) for name, t in checks.items()], F.coalesce(F.bool_and(family_passed), F.lit(False)).alias("_family"))
    verdict = ladder([*[(F.col(name), name) for name in checks], (~F.col("_family"), "GAP_CONFIRMATION_FAIL_FDR_WRC_SPA")], "GAP_CONFIRMATION_SURVIVES_RESEARCH")
    realism = F.when(F.col("GAP_CONFIRMATION_FAIL_OPEN_SLIPPAGE"), "OPEN_REALISM_FAIL").otherwise("OPEN_REALISM_PASS")
    return out.select(*keys, verdict.alias("decision"), realism.alias("open_realism"))


def pullback_decision() -> Column:
    """Verdict from trades, oos_trades, oos_symbols, expectancy, profit_factor (null: no losses), top3_share (null: none), duplicates."""
    c = F.col
    return ladder([
        ((c("trades") == 0) | (c("oos_trades") < 25) | (c("oos_symbols") < 6), "DSS_PB_001_INSUFFICIENT_TRADES"), ((c("expectancy") <= 0) | c("profit_factor").isNull(), "DSS_PB_001_RESEARCH_FAIL"),
        ((c("profit_factor") < 1.15) | F.coalesce(c("top3_share") > 0.7, F.lit(False)), "DSS_PB_001_RESEARCH_WARNING"), (c("duplicates") > 0, "DSS_PB_001_LOOKAHEAD_FAIL"),
    ], "DSS_PB_001_RESEARCH_PASS")
