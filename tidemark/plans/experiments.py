"""Queries of experiment planning, entry plans and forensics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entries as N
from ..operators import experiments as Y
from ..operators import windows as W
from ..registry import query
from .inputs import TRADES, daily_bars, table, trades


@query(
    "content_hash",
    """SELECT l_orderkey, l_linenumber, sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_quantity":' || l_quantity || ',"tags":{"flag":"' || l_returnflag || '","none":null}}') AS hash FROM lineitem""",
)
def content_hash(spark, sf_dir):
    tags = F.struct(F.lit(None).cast("double").alias("none"), F.col("l_returnflag").alias("flag"), F.current_timestamp().alias("created_at"))
    t = table(spark, sf_dir, "lineitem").select("l_quantity", "l_orderkey", "l_linenumber", tags.alias("tags"), F.monotonically_increasing_id().alias("run_id"))
    return t.select("l_orderkey", "l_linenumber", Y.content_hash(t).alias("hash"))


GRID = {"min_depth": [0.10, 0.12, 0.16], "max_depth": [0.34, 0.42], "rim": [0.08, 0.12], "volume": [1.10, 1.20, 1.35]}


@query(
    "parameter_grid",
    "SELECT ((i * 2 + j) * 2 + k) * 3 + m AS trial, [0.10, 0.12, 0.16][i + 1]::DOUBLE AS min_depth, [0.34, 0.42][j + 1]::DOUBLE AS max_depth, [0.08, 0.12][k + 1]::DOUBLE AS rim, [1.10, 1.20, 1.35][m + 1]::DOUBLE AS volume FROM range(3) a(i), range(2) b(j), range(2) c(k), range(3) d(m)",
)
def parameter_grid(spark, sf_dir):
    return Y.parameter_grid(spark, GRID, 1000)


@query("parameter_grid_sampled")
def parameter_grid_sampled(spark, sf_dir):
    return Y.parameter_grid(spark, GRID, 12, seed=7)


_ARMS = f"{TRADES}, arms AS (SELECT pattern, symbol, count(*) FILTER (WHERE ret > 0) AS wins, count(*) FILTER (WHERE ret <= 0) AS losses FROM trades GROUP BY ALL)"


def _arms(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("pattern", "symbol").agg(F.count_if(F.col("ret") > 0).alias("wins"), F.count_if(F.col("ret") <= 0).alias("losses"))


@query(
    "bounded_shares",
    f"""WITH {_ARMS}, o AS (SELECT *, count(*) OVER (PARTITION BY pattern) AS n, row_number() OVER w - 1 AS k, sum(wins) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM arms WINDOW w AS (PARTITION BY pattern ORDER BY wins DESC, symbol)),
s AS (SELECT *, CASE WHEN rest > 0 THEN (1 - 0.01::DOUBLE * n - k * 0.05::DOUBLE) / rest END AS step FROM o), f AS (SELECT pattern, arg_min(step, k) AS step, min(k) AS k0 FROM s WHERE coalesce(step * wins <= 0.05::DOUBLE + 1e-12, TRUE) GROUP BY pattern)
SELECT s.pattern, symbol, 0.01::DOUBLE + CASE WHEN k < k0 THEN 0.05::DOUBLE ELSE f.step * wins END AS share FROM s JOIN f USING (pattern)""",
    ("share",),
)
def bounded_shares(spark, sf_dir):
    return Y.bounded_shares(_arms(spark, sf_dir), "pattern", "symbol", "wins", 0.01, 0.06).select("pattern", "symbol", "share")


@query("thompson_sampling")
def thompson_sampling(spark, sf_dir):
    return Y.thompson(_arms(spark, sf_dir), "pattern", "symbol", "wins", "losses", seed=7)


@query(
    "pattern_relations",
    """WITH l AS (SELECT 'P' || label || '_' || (vec_id % 4) AS key, 'F' || (label % 5) || '_' || (vec_id % 4 // 2) AS family, CASE WHEN vec_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
c AS (SELECT key, family, side, d, avg(x) AS m FROM l GROUP BY ALL), p AS (SELECT key, family, side, list(m ORDER BY d) AS v FROM c GROUP BY ALL),
r AS (SELECT a.key AS source, b.key AS target, a.family = b.family AS same, a.side <> b.side AS opposite, 1 / (1 + list_distance(a.v, b.v) / greatest(1.0, sqrt(len(a.v)))) AS sim FROM p a JOIN p b ON a.key < b.key)
SELECT source, target, CASE WHEN same THEN 'family_variant' WHEN opposite THEN 'opposite_side_placebo' ELSE 'near_duplicate' END AS type, CASE WHEN same THEN greatest(sim, 0.75) ELSE sim END AS weight FROM r WHERE same OR sim >= 0.92 ORDER BY source DESC, target DESC LIMIT 1000""",
    ("weight",),
)
def pattern_relations(spark, sf_dir):
    v, g = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 4
    key, family = F.concat_ws("_", F.concat(F.lit("P"), F.col("label").cast("string")), g.cast("string")), F.concat_ws("_", F.concat(F.lit("F"), (F.col("label") % 5).cast("string")), F.floor(g / 2).cast("string"))
    parts = v.select(key.alias("key"), family.alias("family"), F.when(g % 2 == 0, "long").otherwise("short").alias("side"), F.posexplode("embedding").alias("d", "x")).groupBy("key", "family", "side", "d").agg(F.avg("x").alias("m"))
    centres = parts.groupBy("key", "family", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda e: e["m"]).alias("centroid"))
    return Y.pattern_relations(centres)


@query("cup_backtest", None, ("r", "equity"))
def cup_backtest(spark, sf_dir):
    # Orders' prices jump from day to day; their running means have bases.
    w = W.by().rowsBetween(-39, 0)
    smooth = daily_bars(spark, sf_dir).withColumns({c: F.avg(c).over(w) for c in ("open", "high", "low", "close")})
    return Y.compounded(Y.cup_backtest(smooth, 60, 20))


_CANDIDATES = """t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS side, l_returnflag <> 'R' AS accepted, l_extendedprice / l_quantity AS entry, l_discount, l_tax, l_quantity, l_suppkey, l_partkey, l_extendedprice FROM lineitem),
c AS (SELECT *, CASE WHEN side = 'short' THEN -1.0::DOUBLE ELSE 1.0 END AS sg, l_quantity / 50.0::DOUBLE AS score, l_quantity * 2.0::DOUBLE AS effective_events, (l_suppkey % 12)::DOUBLE AS symbols, (l_partkey % 10)::DOUBLE AS sessions, l_linenumber::DOUBLE AS buckets, l_discount - 0.02::DOUBLE AS net_ev_r,
  CASE WHEN l_linenumber <> 7 THEN l_tax * 800.0::DOUBLE END AS spread_bps, l_tax AS spread_cost_r, l_extendedprice * 50.0::DOUBLE AS dollar_volume, 0.8::DOUBLE + l_quantity / 50.0::DOUBLE AS rvol, l_discount * 10.0::DOUBLE - 0.5::DOUBLE AS rvol_acceleration, (l_discount - l_tax) / 10.0::DOUBLE AS vwap_slope,
  l_tax * 10.0::DOUBLE - 0.4::DOUBLE AS phase, l_quantity / 50.0::DOUBLE AS range_position, (l_orderkey % 200)::DOUBLE AS age_seconds, (l_partkey % 60)::DOUBLE AS minutes_to_flat, l_discount * 15.0::DOUBLE AS extension_r, (l_linenumber + 1)::DOUBLE AS reward_risk FROM t)"""


def _unit(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


@query(
    "lab_entry_plan",
    f"""WITH {_CANDIDATES}, s AS (SELECT *, 0.35::DOUBLE * {_unit("net_ev_r / 0.2::DOUBLE")} + 0.25::DOUBLE * {_unit("effective_events / 50")} + 0.15::DOUBLE * {_unit("symbols / 7.5::DOUBLE")} + 0.15::DOUBLE * {_unit("sessions / 7.5::DOUBLE")} + 0.10::DOUBLE * {_unit("buckets / 3.0::DOUBLE")} AS research_score,
  0.25::DOUBLE * {_unit("score")} + 0.20::DOUBLE * {_unit("(rvol - 1) / 1.5::DOUBLE")} + 0.20::DOUBLE * {_unit("rvol_acceleration + 0.35::DOUBLE")} + 0.15::DOUBLE * {_unit("(sg * vwap_slope + 0.003::DOUBLE) / 0.012::DOUBLE")} + 0.10::DOUBLE * {_unit("1 - least(1.0::DOUBLE, abs(range_position - 0.95::DOUBLE) / 1.25::DOUBLE)")} + 0.10::DOUBLE * (1 - {_unit("extension_r / 0.8::DOUBLE")}) AS timing_score,
  0.30::DOUBLE * coalesce(1 - {_unit("spread_bps / 50.0::DOUBLE")}, 0.5::DOUBLE) + 0.20::DOUBLE * (1 - {_unit("spread_cost_r / 0.08::DOUBLE")}) + 0.30::DOUBLE * {_unit("ln(1 + dollar_volume / 1000000.0::DOUBLE) / ln(5.0::DOUBLE)")} + 0.20::DOUBLE * {_unit("(phase + 0.25::DOUBLE) / 2.25::DOUBLE")} AS liquidity_score FROM c),
o AS (SELECT *, 0.40::DOUBLE * research_score + 0.30::DOUBLE * timing_score + 0.30::DOUBLE * liquidity_score AS opportunity_score FROM s),
r AS (SELECT *, list_filter([CASE WHEN reward_risk < 4 THEN 'reward_risk_below_lab_min' END, CASE WHEN extension_r > 0.8::DOUBLE THEN 'entry_extension_too_large' END, CASE WHEN NOT accepted THEN 'research_validation_not_accepted' END, CASE WHEN effective_events < 25 THEN 'research_effective_events_below_lab_min' END,
  CASE WHEN symbols < 5 THEN 'research_symbols_below_lab_min' END, CASE WHEN sessions < 5 THEN 'research_sessions_below_lab_min' END, CASE WHEN buckets < 2 THEN 'research_buckets_below_lab_min' END, CASE WHEN net_ev_r < 0.05::DOUBLE THEN 'research_net_ev_below_lab_min' END, CASE WHEN spread_bps IS NULL THEN 'missing_spread' END, CASE WHEN spread_bps > 50 THEN 'spread_too_wide' END,
  CASE WHEN spread_cost_r > 0.08::DOUBLE THEN 'spread_cost_r_too_high' END, CASE WHEN dollar_volume < 1000000 THEN 'low_dollar_volume' END, CASE WHEN rvol < 1.05::DOUBLE THEN 'weak_rvol' END, CASE WHEN rvol_acceleration < -0.35::DOUBLE THEN 'weak_rvol_acceleration' END, CASE WHEN sg * vwap_slope < -0.003::DOUBLE THEN 'adverse_vwap_slope' END, CASE WHEN phase < -0.25::DOUBLE THEN 'weak_liquidity_phase' END,
  CASE WHEN score < 0.55::DOUBLE THEN 'candidate_score_below_lab_min' END, CASE WHEN age_seconds > 180 THEN 'candidate_stale' END, CASE WHEN minutes_to_flat < 5 THEN 'flat_window_too_short' END, CASE WHEN timing_score < 0.55::DOUBLE THEN 'timing_score_below_lab_min' END, CASE WHEN liquidity_score < 0.6::DOUBLE THEN 'liquidity_score_below_lab_min' END,
  CASE WHEN opportunity_score < 0.6::DOUBLE THEN 'opportunity_score_below_lab_min' END], lambda x: x IS NOT NULL) AS codes FROM o)
SELECT l_orderkey, l_linenumber, array_to_string(codes, ',') AS reason_codes, research_score, timing_score, liquidity_score, opportunity_score,
  CASE WHEN list_contains(codes, 'research_validation_not_accepted') THEN 'SHADOW_ONLY' WHEN len(list_filter(codes, lambda x: regexp_matches(x, '^(invalid_|reward_risk_|spread_|low_dollar_volume|missing_|flat_window_|candidate_stale|entry_extension_)'))) > 0 THEN 'REJECT' WHEN len(codes) > 0 THEN 'WAIT' ELSE 'ENTER_PAPER' END AS action FROM r""",
    ("research_score", "timing_score", "liquidity_score", "opportunity_score"),
)
def lab_entry_plan(spark, sf_dir):
    c, d = F.col, lambda x: x.cast("double")
    short = c("l_linestatus") != "O"
    sign = F.when(short, -1.0).otherwise(1.0)
    # Whole numbers keep reward and extension exact: risk 1, target l_linenumber + 1 away.
    t = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(short, "short").otherwise("long").alias("side"), (c("l_returnflag") != "R").alias("accepted"), F.lit(0.0).alias("entry"), (-sign).alias("stop"), (sign * (c("l_linenumber") + 1)).alias("target"),
        (sign * c("l_discount") * 15.0).alias("price"), (c("l_quantity") / 50.0).alias("score"), (c("l_quantity") * 2.0).alias("effective_events"), d(c("l_suppkey") % 12).alias("symbols"), d(c("l_partkey") % 10).alias("sessions"),
        d(c("l_linenumber")).alias("buckets"), (c("l_discount") - 0.02).alias("net_ev_r"), F.when(c("l_linenumber") != 7, c("l_tax") * 800.0).alias("spread_bps"), c("l_tax").alias("spread_cost_r"), (c("l_extendedprice") * 50.0).alias("dollar_volume"),
        (0.8 + c("l_quantity") / 50.0).alias("rvol"), (c("l_discount") * 10.0 - 0.5).alias("rvol_acceleration"), ((c("l_discount") - c("l_tax")) / 10.0).alias("vwap_slope"), (c("l_tax") * 10.0 - 0.4).alias("phase"),
        (c("l_quantity") / 50.0).alias("range_position"), d(c("l_orderkey") % 200).alias("age_seconds"), d(c("l_partkey") % 60).alias("minutes_to_flat"),
    )
    return N.lab_entry_plan(t).select("l_orderkey", "l_linenumber", F.array_join("reason_codes", ",").alias("reason_codes"), "research_score", "timing_score", "liquidity_score", "opportunity_score", "action")


_PATTERNS = """m AS (SELECT l_partkey AS k, min(l_shipmode_) AS reasons, count(*) AS samples, count(DISTINCT l_suppkey) AS symbols, count(DISTINCT year(l_shipdate)) AS years, avg(l_discount - l_tax) FILTER (WHERE l_shipdate >= DATE '1996-01-01') AS oos_expectancy, max(l_quantity) / 4 AS drawdown, min(l_tax) > 0 AS cost_passed
  FROM (SELECT *, ['none', 'Drawdown high', 'fdr; replay', 'Partial FILL'][l_linenumber % 4 + 1] AS l_shipmode_ FROM lineitem) GROUP BY 1),
f AS (SELECT *, lower(reasons) AS t FROM m),
x AS (SELECT *, list_filter([CASE WHEN NOT cost_passed THEN 'cost_dominated' END, CASE WHEN oos_expectancy <= 0 THEN 'oos_unstable' END, CASE WHEN contains(t, 'fdr') THEN 'statistical_datamined' END, CASE WHEN contains(t, 'drawdown') OR drawdown > 12 THEN 'drawdown_excessive' END, CASE WHEN contains(t, 'replay') THEN 'regime_sensitive_candidate' END,
  CASE WHEN contains(t, 'fill') THEN 'operationally_unavailable' END, CASE WHEN samples < 50 OR symbols < 6 THEN 'insufficient_data' END], lambda z: z IS NOT NULL) AS failures FROM f)"""


def _patterns(spark, sf_dir):
    c = F.col
    t = table(spark, sf_dir, "lineitem").withColumn("why", F.element_at(F.array(*[F.lit(x) for x in ("none", "Drawdown high", "fdr; replay", "Partial FILL")]), c("l_linenumber") % 4 + 1))
    return t.groupBy(c("l_partkey").alias("k")).agg(
        F.min("why").alias("reasons"), F.count("*").alias("samples"), F.count_distinct("l_suppkey").alias("symbols"), F.count_distinct(F.year("l_shipdate")).alias("years"),
        F.avg(F.when(c("l_shipdate") >= F.lit("1996-01-01").cast("date"), c("l_discount") - c("l_tax"))).alias("oos_expectancy"), (F.max("l_quantity") / 4).alias("drawdown"), (F.min("l_tax") > 0).alias("cost_passed"),
        F.lit(None).cast("double").alias("oos_profit_factor"),
    )


@query("candidate_forensics", f"WITH {_PATTERNS} SELECT k, array_to_string(failures, ',') AS failures, coalesce(failures[1], 'unclassified') AS dominant FROM x")
def candidate_forensics(spark, sf_dir):
    return N.forensics(_patterns(spark, sf_dir)).select("k", F.array_join("failures", ",").alias("failures"), "dominant")


@query(
    "forensics_report",
    f"""WITH {_PATTERNS}, e AS (SELECT k % 5 AS wave, coalesce(failures[1], 'unclassified') AS dominant, oos_expectancy, unnest(CASE WHEN len(failures) > 0 THEN failures ELSE ['unclassified'] END) AS failure FROM x)
SELECT wave, failure, count(*) AS candidates, count(*) FILTER (WHERE dominant = failure) AS as_dominant, avg(oos_expectancy) AS mean_oos FROM e GROUP BY ALL""",
    ("mean_oos",),
)
def forensics_report(spark, sf_dir):
    return N.forensics_report(N.forensics(_patterns(spark, sf_dir)).withColumn("wave", F.col("k") % 5), "wave")
