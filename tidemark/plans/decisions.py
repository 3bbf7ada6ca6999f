"""Queries of scores, setups, exits and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import joins as J
from ..registry import query
from .inputs import table

_MATCHES = """m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'P' || (l_partkey % 20) AS symbol, l_returnflag || l_linestatus AS pattern, 'V' || (l_suppkey % 3) AS variant, l_discount * 10 AS score, l_tax * 12 AS similarity,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity / 50 END AS entry_score, l_discount * 5 AS expectancy, l_quantity / 15 AS profit_factor, l_tax * 10 AS stability, l_quantity / 8 AS reward_risk, l_linenumber / 2 AS volume_ratio,
  l_extendedprice * 200 AS dollar_volume, (l_suppkey % 10) / 3 AS extension, CASE WHEN l_linenumber <> 2 THEN l_discount * 8 END AS regime_fit, l_suppkey % 7 <> 0 AS risk_approved,
  CASE WHEN l_linenumber <> 5 THEN l_linenumber <> 4 END AS gate_passed, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 5 <> 0 END AS regime_ok, l_suppkey % 3 AS ambiguity FROM lineitem)"""


def _unit(x: str, default: str = "0") -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, coalesce({x}, {default})))"


def _volume(factor: float) -> str:
    return _unit(f"dollar_volume / {D.LIMITS['min_dollar_volume'] * factor}")


_MATCH = _unit("score")
_EDGE = f"(0 + {_unit('expectancy / 0.5')} * 0.55 + {_unit("profit_factor / '2.7'::DOUBLE")} * 0.30 + {_unit('stability')} * 0.15)"
_PARTS = {
    "match": _MATCH, "similarity": _unit("similarity"), "entry": _unit("entry_score", _MATCH), "research_edge": _EDGE, "reward_risk": _unit("reward_risk / 4"), "regime_fit": _unit("regime_fit", "0.5"),
    "volume": _unit(f"volume_ratio / '{1.05 * 1.8!r}'::DOUBLE"), "extension": _unit("1 - extension / 2.75", "1"),
}


def _sum(weights: dict[str, float], parts: dict[str, str]) -> str:
    return "(0 + " + " + ".join(f"{parts[name]} * {w}" for name, w in weights.items()) + ")"


def _matches(spark, sf_dir):
    """Matches made of line items."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("P"), (c("l_partkey") % 20).cast("string")).alias("symbol"), F.concat("l_returnflag", "l_linestatus").alias("pattern"),
        F.concat(F.lit("V"), (c("l_suppkey") % 3).cast("string")).alias("variant"), (c("l_discount") * 10).alias("score"), (c("l_tax") * 12).alias("similarity"), F.when(c("l_linenumber") % 3 != 0, c("l_quantity") / 50).alias("entry_score"),
        (c("l_discount") * 5).alias("expectancy"), (c("l_quantity") / 15).alias("profit_factor"), (c("l_tax") * 10).alias("stability"), (c("l_quantity") / 8).alias("reward_risk"), (c("l_linenumber") / 2).alias("volume_ratio"),
        (c("l_extendedprice") * 200).alias("dollar_volume"), (c("l_suppkey") % 10 / 3).alias("extension"), F.when(c("l_linenumber") != 2, c("l_discount") * 8).alias("regime_fit"), (c("l_suppkey") % 7 != 0).alias("risk_approved"),
        F.when(c("l_linenumber") != 5, c("l_linenumber") != 4).alias("gate_passed"), F.when(c("l_suppkey") % 2 == 0, c("l_partkey") % 5 != 0).alias("regime_ok"), (c("l_suppkey") % 3).alias("ambiguity"),
    )


@query(
    "entry_quality",
    f"""WITH {_MATCHES}, s AS (SELECT *, {_sum(D.QUALITY, _PARTS | {"liquidity": _volume(3)})} AS quality, list_filter([CASE WHEN NOT risk_approved THEN 'risk_rejected' END, CASE WHEN NOT coalesce(gate_passed, false) THEN 'entry_gate_failed' END,
  CASE WHEN NOT regime_ok THEN 'regime_filter_failed' END, CASE WHEN dollar_volume < 5000000 THEN 'thin_liquidity' END, CASE WHEN volume_ratio < 1.05 THEN 'weak_volume_confirmation' END, CASE WHEN extension > 2.75 THEN 'overextended' END], lambda x: x IS NOT NULL) AS flags FROM m)
SELECT l_orderkey, l_linenumber, quality, array_to_string(flags, ',') AS flags, CASE WHEN len(flags) > 0 THEN 'blocked' WHEN quality >= 0.78 THEN 'high' WHEN quality >= 0.6 THEN 'actionable' WHEN quality >= 0.45 THEN 'watch' ELSE 'weak' END AS label, quality >= 0.6 AND len(flags) = 0 AS actionable FROM s""",
    ("quality",),
)
def entry_quality(spark, sf_dir):
    return D.entry_quality(_matches(spark, sf_dir)).select("l_orderkey", "l_linenumber", "quality", F.array_join("quality_flags", ",").alias("flags"), F.col("quality_label").alias("label"), "actionable")


_HISTORY = "h AS (SELECT coalesce(pattern, '*') AS pattern, coalesce(symbol, '*') AS symbol, coalesce(variant, '*') AS variant, (count(*) % 101) / 100 AS s, count(*) AS c FROM m WHERE l_orderkey % 8 = 0 AND l_partkey % 20 < 6 GROUP BY GROUPING SETS ((pattern, symbol, variant), (pattern, variant)) HAVING count(*) % 3 <> 0)"
_TIES = ["symbol", "pattern", "variant", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_TIE_SQL = ", ".join(f"upper({c}::VARCHAR)" for c in _TIES)
_SCORED = f"""{_MATCHES}, {_HISTORY}, w AS (SELECT m.*, coalesce(a.s, b.s, 0.5) AS hs, coalesce(a.c, b.c, 0) AS hc FROM m LEFT JOIN h a USING (pattern, symbol, variant) LEFT JOIN h b ON b.pattern = m.pattern AND b.symbol = '*' AND b.variant = m.variant),
p AS (SELECT *, {", ".join(f"{x} AS p_{n}" for n, x in (_PARTS | {"liquidity": _volume(5), "history": "hs", "exploration": "(greatest(0, 1 - least(hc::DOUBLE, 10) / 10) * 0.15)"}).items())} FROM w),
o AS (SELECT *, CASE WHEN hc > 0 THEN {_sum(D.WITH_HISTORY, {n: "p_" + n for n in D.WITH_HISTORY})} ELSE {_sum(D.WITHOUT_HISTORY, {n: "p_" + n for n in D.WITHOUT_HISTORY})} END AS opportunity,
  CASE WHEN hc > 0 THEN 'paper_history_weighted' ELSE 'research_score_fallback_no_paper_history' END AS reason FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY opportunity DESC, coalesce(entry_score, 0) DESC, score DESC, similarity DESC, ambiguity, {_TIE_SQL}) AS place FROM o)"""


def _scored(spark, sf_dir):
    matches = _matches(spark, sf_dir)
    past = matches.filter((F.col("l_orderkey") % 8 == 0) & (F.col("l_partkey") % 20 < 6)).withColumn("one", F.lit(1.0))
    levels = [["pattern", "symbol", "variant"], ["pattern", "variant"]]
    history = J.history_levels(past, levels[0], levels, "one").filter("n % 3 <> 0").select(*levels[0], (F.col("n") % 101 / 100).alias("score"), F.col("n").alias("count"))
    # At most 20 symbols, 6 patterns and 3 variants.
    return D.opportunity_score(D.with_history(matches, F.broadcast(history), levels[0], levels))


@query("opportunity_ranking", f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, opportunity, reason, place AS opportunity_rank FROM r", ("opportunity",))
def opportunity_ranking(spark, sf_dir):
    return D.rank_opportunities(_scored(spark, sf_dir), _TIES).select("l_orderkey", "l_linenumber", "opportunity", F.col("opportunity_reason").alias("reason"), "opportunity_rank")


@query(
    "best_variant_per_exposure",
    f"WITH {_SCORED}, b AS (SELECT symbol, pattern, min(place) AS place FROM r GROUP BY ALL) SELECT symbol, pattern, variant, opportunity, row_number() OVER (ORDER BY place) AS opportunity_rank FROM r JOIN b USING (symbol, pattern, place)",
    ("opportunity",),
)
def best_variant_per_exposure(spark, sf_dir):
    return D.rank_opportunities(_scored(spark, sf_dir), _TIES, ["symbol", "pattern"]).select("symbol", "pattern", "variant", "opportunity", "opportunity_rank")


@query("match_ranking", f"WITH {_MATCHES} SELECT l_orderkey, l_linenumber, score FROM m ORDER BY score DESC, coalesce(entry_score, 0) DESC, similarity DESC, ambiguity, {_TIE_SQL} LIMIT 50", ("score",))
def match_ranking(spark, sf_dir):
    return D.rank_matches(_matches(spark, sf_dir), _TIES, 50).select("l_orderkey", "l_linenumber", "score")


@query("rotation_hash", "SELECT o_orderkey, substr(sha256('week|C' || o_custkey), 1, 8) AS rotation FROM orders")
def rotation_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.rotation_hash("week", F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("rotation"))


@query(
    "setup_states",
    """WITH s AS (SELECT o_orderkey AS setup_id, o_orderdate AS detected_at, ['detected', 'watching', 'armed', 'entry_ready', 'invalidated'][o_orderkey % 5 + 1] AS status FROM orders),
e AS (SELECT l_orderkey AS setup_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_extendedprice) AS n, l_extendedprice AS score, l_discount >= 0.05 AS passed,
  CASE WHEN l_partkey % 9 = 0 THEN 'setup_context_broken' WHEN l_suppkey % 11 = 0 OR l_quantity < 8 THEN 'non_recoverable_or_reward_risk_failed' WHEN floor((epoch_us(l_shipdate) - epoch_us(detected_at)) / 86400000000) >= 90 THEN 'max_age_days_exceeded' END AS why
  FROM lineitem JOIN s ON l_orderkey = setup_id WHERE status <> 'invalidated'),
x AS (SELECT setup_id, min(n) FILTER (WHERE why IS NOT NULL) AS stop FROM e GROUP BY 1),
l AS (SELECT setup_id, any_value(why) FILTER (WHERE n = stop) AS ended, bool_or(passed) AS passed, arg_max(score, n) AS entry_score, count(*) AS n FROM e JOIN x USING (setup_id) WHERE stop IS NULL OR n <= stop GROUP BY 1),
a AS (SELECT s.setup_id, detected_at, entry_score, coalesce(n, 0) AS evaluated, CASE WHEN ended = 'max_age_days_exceeded' THEN 'expired' WHEN ended IS NOT NULL THEN 'invalidated' WHEN passed AND status IN ('watching', 'armed') THEN 'entry_ready' ELSE status END AS status,
  CASE WHEN ended IS NOT NULL THEN ended WHEN passed AND status IN ('watching', 'armed') THEN 'entry_gate_passed' END AS reason FROM s LEFT JOIN l USING (setup_id)),
k AS (SELECT *, status NOT IN ('expired', 'invalidated') AND row_number() OVER (PARTITION BY status IN ('expired', 'invalidated') ORDER BY coalesce(entry_score, 0) DESC, detected_at DESC, setup_id DESC) > 100 AS over FROM a)
SELECT setup_id, evaluated, entry_score, CASE WHEN over THEN 'expired' ELSE status END AS status, CASE WHEN over THEN 'daily_setup_max_active_exceeded' ELSE reason END AS reason FROM k""",
    ("entry_score",),
)
def setup_states(spark, sf_dir):
    c = F.col
    statuses = F.array(*[F.lit(x) for x in ("detected", "watching", "armed", "entry_ready", "invalidated")])
    setups = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("setup_id"), c("o_orderdate").alias("detected_at"), F.get(statuses, (c("o_orderkey") % 5).cast("int")).alias("status"))
    evaluations = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("setup_id"), c("l_shipdate").alias("at"), "l_linenumber", (c("l_quantity") / 8).alias("reward_risk"), c("l_extendedprice").alias("entry_score"), (c("l_discount") >= 0.05).alias("gate_passed"), (c("l_partkey") % 9 == 0).alias("broken"), (c("l_suppkey") % 11 == 0).alias("blocked"),
    )
    states = D.setup_states(setups, evaluations, ["at", "l_linenumber", "entry_score"], 90, 1.0)
    return D.cap_active(states, 100).select("setup_id", "evaluated", "entry_score", "status", "reason")


@query(
    "paper_exit",
    """WITH b AS (SELECT l_orderkey AS trade, l_linenumber AS bar, 95 + l_discount * 100 AS close, l_tax * 50 AS spread, CASE WHEN l_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, l_orderkey % 40 AS flat, 3 + l_orderkey % 5 AS most, CASE WHEN l_orderkey % 3 <> 0 THEN l_discount - 0.05 END AS vwap FROM (SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY ALL)),
r AS (SELECT *, lag(close) OVER (PARTITION BY trade ORDER BY bar) AS before, (close - 100) * sign / 5 AS cr, (close + spread - 100) * sign / 5 AS h, (close - spread - 100) * sign / 5 AS l FROM b),
g AS (SELECT trade, count(*) AS n, max(greatest(h, l)) - 0.02 AS mfe_r, min(least(h, l)) - 0.02 AS mae_r, arg_max(cr, bar) - 0.02 AS current_r, arg_max(close, bar) AS close, arg_max(struct_pack(x := before), bar).x AS before, arg_max(struct_pack(x := vwap), bar).x AS vwap,
  any_value(sign) AS sign, any_value(flat) AS flat, any_value(most) AS most, min(bar) FILTER (WHERE greatest(h, l) >= 1.6) AS hit, min(bar) FILTER (WHERE least(h, l) <= -1) AS stopped FROM r GROUP BY trade),
d AS (SELECT *, least(n, most) AS bars_held, greatest(0.2, mfe_r - 0.35) AS locked FROM g),
q AS (SELECT *, CASE WHEN stopped IS NOT NULL AND (hit IS NULL OR stopped <= hit) THEN 'stop_hit' WHEN hit IS NOT NULL THEN 'target_hit' WHEN flat <= 5 THEN 'force_flat_window' WHEN bars_held >= most THEN 'max_holding_bars' WHEN current_r <= -1 THEN 'hard_loss_r'
  WHEN mfe_r >= 0.8 AND current_r <= locked THEN 'profit_giveback' WHEN current_r <= -0.55 AND (coalesce(sign * (close - before) < 0, false) OR coalesce(sign * vwap < -0.05 / 5::DOUBLE, false)) THEN 'loss_reduction_signal'
  WHEN bars_held / most >= 0.65 AND current_r < 0.1 THEN 'time_decay_no_progress' WHEN mfe_r >= 0.8 THEN 'protect_open_profit' ELSE '' END AS reason FROM d)
SELECT trade, reason, CASE reason WHEN '' THEN 'HOLD' WHEN 'protect_open_profit' THEN 'TIGHTEN_STOP' ELSE 'EXIT_NOW' END AS action, current_r, mfe_r, mae_r, bars_held,
  CASE reason WHEN '' THEN NULL WHEN 'protect_open_profit' THEN NULL WHEN 'stop_hit' THEN 100 - sign * 5 WHEN 'target_hit' THEN 100 + sign * 8 ELSE close END AS exit_price, CASE WHEN reason = 'protect_open_profit' THEN 100 + sign * locked * 5 END AS suggested_stop FROM q""",
    ("current_r", "mfe_r", "mae_r", "exit_price", "suggested_stop"),
)
def paper_exit(spark, sf_dir):
    c = F.col
    long = c("l_orderkey") % 2 == 0
    close, spread = c("l_discount") * 100 + 95, c("l_tax") * 50
    bars = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("l_discount"), F.max("l_tax").alias("l_tax"))
    paths = bars.select(
        c("l_orderkey").alias("trade"), c("l_linenumber").alias("bar"), close.alias("close"), (close + spread).alias("high"), (close - spread).alias("low"), F.when(long, "long").otherwise("short").alias("side"), F.lit(100.0).alias("entry"),
        F.when(long, 95.0).otherwise(105.0).alias("stop"), F.when(long, 108.0).otherwise(92.0).alias("target"), (c("l_orderkey") % 40).alias("minutes_to_flat"), (c("l_orderkey") % 5 + 3).alias("max_bars"), F.lit(0.02).alias("cost_r"),
        F.when(c("l_orderkey") % 3 != 0, c("l_discount") - 0.05).alias("vwap_distance"),
    )
    return D.paper_exit(paths, "trade", "bar")


@query(
    "gap_decision",
    """WITH t AS (SELECT l_suppkey % 40 AS family, l_linenumber AS test, sum(round((l_discount - l_tax) * 100)::BIGINT) AS s, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL),
f AS (SELECT family, bool_and(n % 17 <> 0) AS passed, bool_or(s % 11 < 0) FILTER (WHERE test <= 3) AS a, bool_or(n % 13 = 0) FILTER (WHERE test <= 3) AS b, bool_or(1 + (n % 10) / 10 < 1.2) FILTER (WHERE test <= 3) AS c, bool_or(parts % 9 = 0) FILTER (WHERE test <= 3) AS d, bool_or(parts % 7 = 0) FILTER (WHERE test <= 3) AS e FROM t GROUP BY family)
SELECT family, CASE WHEN a THEN 'GAP_CONFIRMATION_FAIL_OPEN_SLIPPAGE' WHEN b THEN 'GAP_CONFIRMATION_FAIL_OPERABILITY' WHEN c THEN 'GAP_CONFIRMATION_INCONCLUSIVE' WHEN d THEN 'GAP_CONFIRMATION_FAIL_CONCENTRATION' WHEN e THEN 'GAP_CONFIRMATION_FAIL_EFFECTIVE_SAMPLE' WHEN NOT passed THEN 'GAP_CONFIRMATION_FAIL_FDR_WRC_SPA' ELSE 'GAP_CONFIRMATION_SURVIVES_RESEARCH' END AS decision,
  CASE WHEN a THEN 'OPEN_REALISM_FAIL' ELSE 'OPEN_REALISM_PASS' END AS open_realism FROM f""",
)
def gap_decision(spark, sf_dir):
    c = F.col
    by_test = table(spark, sf_dir, "lineitem").groupBy((c("l_suppkey") % 40).alias("family"), c("l_linenumber").alias("test")).agg(F.sum(F.round((c("l_discount") - c("l_tax")) * 100).cast("long")).alias("s"), F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))
    tests = by_test.select(
        "family", "n", (c("test") <= 3).alias("is_target"), (c("s") % 11).alias("slipped_expectancy"), (c("n") % 13 == 0).alias("operability_fail"), (1 + c("n") % 10 / 10).alias("profit_factor"), (c("parts") % 9 == 0).alias("concentration_fail"), (c("parts") % 7 == 0).alias("sample_fail"),
    )
    return D.gap_decision(tests, ["family"], c("n") % 17 != 0)


@query(
    "pullback_decision",
    """WITH m AS (SELECT l_suppkey AS setup, count(*) AS trades, count(*) FILTER (WHERE l_quantity > 10) AS oos_trades, count(DISTINCT CASE WHEN l_quantity > 10 THEN l_partkey % 20 END) AS oos_symbols, sum(round((l_discount - l_tax) * 100)::BIGINT) AS expectancy,
  sum(CASE WHEN l_discount > l_tax THEN round((l_discount - l_tax) * 100)::BIGINT ELSE 0 END) / nullif(sum(CASE WHEN l_discount < l_tax THEN round((l_tax - l_discount) * 100)::BIGINT ELSE 0 END), 0) AS profit_factor, nullif(count(*) % 10, 0) / 10 AS top3_share, sum(l_quantity)::BIGINT % 3 AS duplicates FROM lineitem GROUP BY 1)
SELECT setup, trades, CASE WHEN trades = 0 OR oos_trades < 25 OR oos_symbols < 6 THEN 'DSS_PB_001_INSUFFICIENT_TRADES' WHEN expectancy <= 0 OR profit_factor IS NULL THEN 'DSS_PB_001_RESEARCH_FAIL' WHEN profit_factor < 1.15 OR coalesce(top3_share > 0.7, false) THEN 'DSS_PB_001_RESEARCH_WARNING' WHEN duplicates > 0 THEN 'DSS_PB_001_LOOKAHEAD_FAIL' ELSE 'DSS_PB_001_RESEARCH_PASS' END AS decision FROM m""",
)
def pullback_decision(spark, sf_dir):
    c = F.col
    points = lambda a, b: F.round((c(a) - c(b)) * 100).cast("long")
    gains, losses = F.sum(F.when(c("l_discount") > c("l_tax"), points("l_discount", "l_tax")).otherwise(0)), F.sum(F.when(c("l_discount") < c("l_tax"), points("l_tax", "l_discount")).otherwise(0))
    metrics = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("setup")).agg(
        F.count("*").alias("trades"), F.count_if(c("l_quantity") > 10).alias("oos_trades"), F.count_distinct(F.when(c("l_quantity") > 10, c("l_partkey") % 20)).alias("oos_symbols"), F.sum(points("l_discount", "l_tax")).alias("expectancy"),
        (gains / F.nullif(losses, F.lit(0))).alias("profit_factor"), (F.nullif(F.count("*") % 10, F.lit(0)) / 10).alias("top3_share"), (F.sum("l_quantity").cast("long") % 3).alias("duplicates"),
    )
    return metrics.select("setup", "trades", D.pullback_decision().alias("decision"))
