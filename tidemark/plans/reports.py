"""Queries of reports and control-plane reads."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reports as P
from ..operators import windows as W
from ..registry import query
from .inputs import INTRADAY, TRADES, intraday_bars, table, trades
from .intraday import _inner
from .research import cdf_sql


@query(
    "vwap_stats",
    f"""WITH v AS ({_inner("vwap_session")}), b AS (SELECT *, CASE WHEN m < 570 OR m >= 960 THEN 'out_of_session' WHEN m < 630 THEN 'open' WHEN m >= 900 THEN 'close' ELSE 'mid' END AS bucket FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM v))
SELECT coalesce(symbol, '*') AS symbol, coalesce(bucket, '*') AS bucket, count(*) AS bars, avg(above::INTEGER) AS above_share, avg(crossed::INTEGER) AS chop, quantile_cont(distance_bps, 0.5) AS median_bps, quantile_cont(abs(distance_bps), 0.9) AS p90_bps FROM b GROUP BY GROUPING SETS ((symbol), (bucket), ())""",
    ("above_share", "chop", "median_bps", "p90_bps"),
)
def vwap_stats(spark, sf_dir):
    return P.vwap_stats(W.vwap(intraday_bars(spark, sf_dir)), S.vwap_session_bucket(S.day_minute(F.col("ts"))))


@query(
    "overlay_metrics",
    f"""WITH {TRADES} SELECT symbol, count(*) AS n, avg(ret) AS mean, CASE WHEN coalesce(sum(-ret) FILTER (WHERE ret < 0), 0) > 0 THEN coalesce(sum(ret) FILTER (WHERE ret > 0), 0) / sum(-ret) FILTER (WHERE ret < 0) END AS pf, quantile_cont(ret, 0.1) AS p10, quantile_cont(ret, 0.5) AS median, quantile_cont(ret, 0.9) AS p90,
  avg(ret) FILTER (WHERE exit_date >= DATE '1998-01-01') AS oos_mean, avg(ret) FILTER (WHERE exit_date < DATE '1998-01-01') AS is_mean FROM trades GROUP BY symbol""",
    ("mean", "pf", "p10", "median", "p90", "oos_mean", "is_mean"),
)
def overlay_metrics(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("symbol").agg(*P.overlay_metrics(F.col("ret"), F.col("exit_date") >= F.lit("1998-01-01").cast("date")))


@query("signal_funnel", "SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 10000) AS seen, count(*) FILTER (WHERE o_totalprice > 10000 AND o_orderstatus <> 'P') AS valid, count(*) FILTER (WHERE o_totalprice > 10000 AND o_orderstatus <> 'P' AND o_orderkey % 3 = 0) AS filled FROM orders GROUP BY 1")
def signal_funnel(spark, sf_dir):
    stages = {"seen": F.col("o_totalprice") > 10000, "valid": F.col("o_orderstatus") != "P", "filled": F.col("o_orderkey") % 3 == 0}
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*P.funnel(stages))


@query("data_contract", f"WITH {INTRADAY} SELECT symbol, session, count(*) AS bars, count(*) >= 50 AS enough FROM ibars GROUP BY ALL")
def data_contract(spark, sf_dir):
    return P.data_contract(intraday_bars(spark, sf_dir), ["symbol", "session"], 50).drop("content_hash")


_QUEUE = """q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'leased' ELSE 'done' END AS status, o_orderpriority AS scope, o_totalprice AS priority, o_orderdate AS created_at, o_orderdate + INTERVAL '900 days' AS expires_at, o_orderdate + INTERVAL '30 days' AS lease_until, o_orderkey % 5 AS attempts FROM orders)"""


def _queue(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "leased").otherwise("done")
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("scope"), F.col("o_totalprice").alias("priority"), day.alias("created_at"),
        (day + F.expr("interval 900 days")).alias("expires_at"), (day + F.expr("interval 30 days")).alias("lease_until"), (F.col("o_orderkey") % 5).alias("attempts"),
    )


def _now():
    return F.to_timestamp_ntz(F.lit("1998-06-01 00:00:00"))


@query("lease_reaping", f"WITH {_QUEUE} SELECT id, CASE WHEN status = 'queued' AND expires_at <= TIMESTAMP '1998-06-01' THEN 'expire' WHEN status = 'leased' AND lease_until <= TIMESTAMP '1998-06-01' AND attempts >= 3 THEN 'fail' WHEN status = 'leased' AND lease_until <= TIMESTAMP '1998-06-01' THEN 'requeue' ELSE 'keep' END AS action FROM q")
def lease_reaping(spark, sf_dir):
    return P.leases(_queue(spark, sf_dir), _now(), 3).select("id", "action")


@query("queue_claim", f"WITH {_QUEUE}, k AS (SELECT id, scope, row_number() OVER (PARTITION BY scope ORDER BY priority DESC, created_at, id) AS k FROM q WHERE status = 'queued' AND expires_at > TIMESTAMP '1998-06-01') SELECT id, scope FROM k WHERE k <= 7")
def queue_claim(spark, sf_dir):
    return P.claim(_queue(spark, sf_dir), _now(), "scope", 7).select("id", "scope")


@query(
    "rediscovery_readiness",
    "SELECT event_id, array_to_string(list_filter([CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'k' END, CASE WHEN json_extract_string(props, '$.m') IS NULL THEN 'm' END], lambda x: x IS NOT NULL), ',') AS missing, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'old' ELSE '' END AS stale FROM events",
)
def rediscovery_readiness(spark, sf_dir):
    stale = [(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")), "old")]
    return table(spark, sf_dir, "events").select("event_id", *P.readiness(F.col("props"), {"k": "$.k", "m": "$.m"}, stale))


@query(
    "next_experiments",
    "WITH b AS (SELECT event_type AS reason FROM events WHERE value < 10), c(reason, experiment) AS (VALUES ('view', 'widen'), ('view', 'slow'), ('click', 'narrow'), ('error', 'retry')), n AS (SELECT reason, count(*) AS n FROM b GROUP BY reason) SELECT reason, experiment, n FROM n JOIN c USING (reason) WHERE experiment <> 'slow'",
)
def next_experiments(spark, sf_dir):
    catalog = spark.createDataFrame([("view", "widen"), ("view", "slow"), ("click", "narrow"), ("error", "retry")], "reason string, experiment string")
    blockers = table(spark, sf_dir, "events").filter("value < 10").select(F.col("event_type").alias("reason"))
    return P.next_experiments(blockers, catalog, catalog.filter("experiment = 'slow'"))


@query(
    "nested_optimization",
    f"""WITH {TRADES}, s AS (SELECT year(exit_date)::INTEGER % 5 AS fold, symbol AS variant, sum(ret) AS s, count(*) AS c FROM trades GROUP BY ALL), m AS (SELECT *, (sum(s) OVER (PARTITION BY variant) - s) / nullif(sum(c) OVER (PARTITION BY variant) - c, 0) AS i, s / c AS "outer" FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(i, 9) DESC NULLS LAST, variant) AS k, rank() OVER (PARTITION BY fold ORDER BY round("outer", 9)) AS rk, count(*) OVER (PARTITION BY fold) AS n FROM m) SELECT fold, variant, "outer" AS outer_mean, rk / (n + 1) AS relative_rank FROM r WHERE k = 1""",
    ("outer_mean", "relative_rank"),
)
def nested_optimization(spark, sf_dir):
    return P.nested_optimization(trades(spark, sf_dir), F.year("exit_date") % 5, "symbol", "ret").withColumnRenamed("outer", "outer_mean")


@query(
    "top_evidence",
    """WITH g AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), b AS (SELECT user_id, row_number() OVER (ORDER BY round(m, 9) DESC, user_id) AS gr FROM g), r AS (SELECT event_id, e.user_id, gr, row_number() OVER (PARTITION BY e.user_id ORDER BY value DESC, event_id) AS k FROM events e JOIN b ON b.user_id = e.user_id WHERE gr <= 10)
SELECT event_id, user_id, gr::INTEGER AS group_rank, k::INTEGER AS rank FROM r WHERE k <= 3""",
)
def top_evidence(spark, sf_dir):
    return P.top_evidence(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 10, 3).select("event_id", "user_id", "group_rank", "rank")


@query(
    "clustering_agreement",
    """WITH b AS (SELECT vec_id, label AS a, vec_id % 7 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT sum(n)::BIGINT AS n, sum(n * (n - 1) / 2) AS ab FROM c)
SELECT n, (n * (n - 1) / 2 + 2 * ab - (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM c GROUP BY a)) - (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM c GROUP BY b))) / (n * (n - 1) / 2) AS agreement FROM t""",
    ("agreement",),
)
def clustering_agreement(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return P.agreement(v.select("vec_id", "label"), v.select("vec_id", (F.col("vec_id") % 7).alias("label")), "vec_id", "label")


@query("obrien_fleming", f"SELECT c_custkey, 2 - 2 * {cdf_sql('z')} AS spent FROM (SELECT c_custkey, {NormalDist().inv_cdf(0.975)!r} / sqrt((c_custkey % 100 + 1) / 100) AS z FROM customer)", ("spent",))
def obrien_fleming(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", P.obrien_fleming((F.col("c_custkey") % 100 + 1) / 100).alias("spent"))
