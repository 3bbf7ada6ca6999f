"""Query of evidence types: orders whose metadata are made of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance as P
from ..operators.provenance import evidence
from ..registry import query
from .inputs import table

_MADE = {
    "evidence_type": "CASE WHEN k % 19 = 0 THEN ' live_order' WHEN k % 23 = 0 THEN 'other' END", "near_miss": "CASE WHEN k % 6 = 0 THEN true WHEN k % 6 = 1 THEN false END", "near_miss_shadow": "k % 29 = 0", "no_ibkr_order": "k % 10 = 0", "observation_only": "CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END",
    "execution_mode": "CASE k % 5 WHEN 0 THEN 'ibkr' WHEN 1 THEN 'paper' WHEN 2 THEN 'lab_shadow_observation' WHEN 3 THEN 'ibkr' END", "ibkr_mode": "CASE WHEN k % 4 = 0 THEN 'paper' WHEN k % 4 = 1 THEN '' END", "trading_mode": "CASE WHEN k % 7 < 4 THEN 'live' ELSE 'paper' END", "broker_order_id": "CASE WHEN k % 3 = 0 THEN 'B1' ELSE '' END",
    "fill_provenance": "CASE k % 8 WHEN 0 THEN 'broker_execution' WHEN 1 THEN 'simulated_close' WHEN 2 THEN 'broker_statement_import' WHEN 3 THEN 'guess' END", "evidence_quality": "CASE k % 12 WHEN 0 THEN 'degraded' WHEN 1 THEN ' normal ' END",
}


@query(
    "evidence_types",
    f"""WITH o AS (SELECT o_orderkey, o_custkey + o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status FROM orders), m AS (SELECT o_orderkey, k, status, {", ".join(f"{x} AS {n}" for n, x in _MADE.items())} FROM o),
f AS (SELECT *, near_miss_shadow OR (coalesce(near_miss, false) AND no_ibkr_order) AS near, no_ibkr_order OR observation_only = 1 OR coalesce(execution_mode = 'lab_shadow_observation', false) AS unordered, coalesce(nullif(ibkr_mode, ''), trading_mode) AS venue FROM m),
p AS (SELECT *, CASE WHEN fill_provenance IN ('broker_execution', 'broker_statement_import', 'simulated_close', 'shadow_close') THEN fill_provenance WHEN near OR unordered THEN 'shadow_close' END AS source FROM f),
t AS (SELECT *, coalesce(status = 'closed' AND source IN ('broker_execution', 'broker_statement_import'), false) AS filled, CASE WHEN trim(evidence_type) = 'live_order' THEN 'live_order' WHEN near THEN 'near_miss_shadow' WHEN unordered THEN 'shadow_no_order' WHEN execution_mode = 'ibkr' AND venue = 'paper' THEN 'ibkr_paper_order'
  WHEN execution_mode = 'ibkr' AND venue = 'live' THEN 'live_order' WHEN execution_mode = 'paper' OR broker_order_id <> '' THEN 'ibkr_paper_order' END AS kind FROM p)
SELECT o_orderkey, CASE WHEN filled AND kind = 'ibkr_paper_order' THEN 'ibkr_paper_fill' WHEN filled AND kind = 'live_order' THEN 'live_fill' ELSE kind END AS evidence_type, CASE WHEN k % 12 = 0 THEN 'degraded' ELSE 'standard' END AS evidence_quality, source AS fill_provenance FROM t""",
)
def evidence_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey")).alias("k"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"))
    made = o.select("o_orderkey", "status", F.to_json(F.struct(*[F.expr(x).alias(n) for n, x in _MADE.items()])).alias("metadata"))
    return evidence(made).select("o_orderkey", "evidence_type", "evidence_quality", "fill_provenance")


@query(
    "unique_signals",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, 'P' || (l_partkey % 5) AS symbol, l_returnflag AS pattern, CASE WHEN l_suppkey % 2 = 0 THEN '5m' ELSE '15m' END AS timeframe, CASE WHEN l_partkey % 3 = 0 THEN 'v' || (l_suppkey % 3) WHEN l_partkey % 3 = 1 THEN 'i' || (l_suppkey % 3) END AS variant,
  strftime(l_shipdate, '%Y-%m') AS window_end, CASE WHEN l_linenumber < 6 THEN (l_linenumber % 2)::VARCHAR END AS session FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, pattern, timeframe, variant, window_end, session ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS k FROM s)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM r WHERE k = 1 OR variant IS NULL OR session IS NULL""",
)
def unique_signals(spark, sf_dir):
    c = F.col
    inner = F.struct(
        F.when(c("l_partkey") % 3 == 0, F.concat(F.lit("v"), (c("l_suppkey") % 3).cast("string"))).alias("entry_variant"), F.when(c("l_partkey") % 3 == 1, F.concat(F.lit("i"), (c("l_suppkey") % 3).cast("string"))).alias("entry_variant_id"),
        F.date_format("l_shipdate", "yyyy-MM").alias("window_end"), F.when(c("l_linenumber") < 6, c("l_linenumber") % 2).alias("session_id"),
    )
    signals = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.concat(F.lit("P"), (c("l_partkey") % 5).cast("string")).alias("symbol"), c("l_returnflag").alias("pattern"), F.when(c("l_suppkey") % 2 == 0, "5m").otherwise("15m").alias("timeframe"), F.to_json(F.struct(inner.alias("intraday"))).alias("metadata"),
    )
    return P.unique_signals(signals, [c("l_orderkey"), c("l_linenumber"), c("l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_extendedprice")
