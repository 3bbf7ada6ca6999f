"""Queries of streaming jobs and of set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import files
from ..streaming import jobs, requests, setups
from .inputs import BARS, daily_bars, table

_LAST = "(SELECT max(ts) - INTERVAL '10 minutes' FROM events)"


@query(
    "stream_bars",
    f"""WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL '5 minutes', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2)
SELECT symbol, ts, open, high, low, close, ticks FROM b WHERE ts + INTERVAL '5 minutes' <= {_LAST}""",
)
def stream_bars(spark, sf_dir):
    return jobs.run_available(jobs.bars(jobs.read_events(spark, sf_dir))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_intake", "SELECT DISTINCT event_id FROM events")
def stream_intake(spark, sf_dir):
    return jobs.run_available(jobs.intake(jobs.read_events(spark, sf_dir), ["event_id"]).select("event_id"))


@query("stream_drift_monitor")
def stream_drift_monitor(spark, sf_dir):
    return jobs.run_available(jobs.drift_monitor(jobs.read_events(spark, sf_dir), "event_type", "value", 50.0, 5.0, 200.0))


@query("stream_admission")
def stream_admission(spark, sf_dir):
    return jobs.run_available(jobs.admission(jobs.read_events(spark, sf_dir), "user_id", 3600, 2))


@query("upsert_by_key", f"WITH {BARS}, n AS (SELECT symbol, date, close + 1 AS close FROM bars WHERE symbol = 'S2' UNION ALL SELECT 'NEW', DATE '2000-01-01', 1.0) SELECT symbol, date, close FROM n UNION ALL SELECT symbol, date, close FROM bars WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM n)", ("close",))
def upsert_by_key(spark, sf_dir):
    old = daily_bars(spark, sf_dir).select("symbol", "date", "close")
    new = old.filter("symbol = 'S2'").withColumn("close", F.col("close") + 1).unionByName(spark.sql("SELECT 'NEW' AS symbol, DATE '2000-01-01' AS date, 1.0D AS close"))
    return files.upsert(old, new, ["symbol", "date"])


@query("append_tail", "SELECT o_orderkey FROM orders")
def append_tail(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return files.append_tail(o.filter("o_orderkey % 3 = 0"), o, ["o_orderkey"])


@query("symbol_set_operations", "(SELECT l_partkey % 500 AS k, 'both' AS side FROM lineitem INTERSECT SELECT l_suppkey % 700, 'both' FROM lineitem) UNION ALL (SELECT l_suppkey % 700, 'second_only' FROM lineitem EXCEPT SELECT l_partkey % 500, 'second_only' FROM lineitem)")
def symbol_set_operations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = li.select((F.col("l_partkey") % 500).alias("k")), li.select((F.col("l_suppkey") % 700).alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(b.subtract(a).withColumn("side", F.lit("second_only")))


_CLOCK = "(SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL '36 hours')"


def _files(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


@query(
    "stream_setup_states",
    f"""WITH s AS (SELECT o_orderkey AS setup_id, o_orderdate AS detected_at, ['detected', 'watching', 'armed', 'entry_ready', 'invalidated'][o_orderkey % 5 + 1] AS status FROM orders WHERE o_orderdate <= {_CLOCK}),
t AS (SELECT s.*, l_shipdate AS told_at, l_linenumber AS tie, l_extendedprice AS score, l_discount >= 0.05 AS passed, CASE WHEN l_partkey % 9 = 0 THEN 'setup_context_broken' WHEN l_partkey % 31 = 0 THEN 'own_reason' WHEN l_suppkey % 11 = 0 OR l_quantity / 8 < 1 THEN 'non_recoverable_or_reward_risk_failed'
  WHEN l_shipdate >= detected_at + INTERVAL '90 days' THEN 'max_age_days_exceeded' END AS why FROM s JOIN lineitem ON l_orderkey = setup_id WHERE status <> 'invalidated' AND l_shipdate BETWEEN detected_at AND least({_CLOCK}, detected_at + INTERVAL '90 days')),
n AS (SELECT *, row_number() OVER (PARTITION BY setup_id ORDER BY told_at, tie, score) AS k FROM t),
f AS (SELECT setup_id, min(k) FILTER (WHERE why IS NOT NULL) AS stop FROM n GROUP BY 1),
l AS (SELECT setup_id, any_value(why) FILTER (WHERE k = stop) AS ended, bool_or(passed) AS passed, arg_max(score, k) AS entry_score, count(*) AS evaluated FROM n JOIN f USING (setup_id) WHERE stop IS NULL OR k <= stop GROUP BY 1),
a AS (SELECT s.*, ended, coalesce(passed, false) AND status IN ('watching', 'armed') AS ready, entry_score, coalesce(evaluated, 0) AS evaluated, ended IS NULL AND status <> 'invalidated' AND detected_at + INTERVAL '90 days' <= {_CLOCK} AS late FROM s LEFT JOIN l USING (setup_id))
SELECT setup_id, evaluated, entry_score, CASE WHEN ended = 'max_age_days_exceeded' OR late THEN 'expired' WHEN ended IS NOT NULL THEN 'invalidated' WHEN ready THEN 'entry_ready' ELSE status END AS status,
  CASE WHEN ended IS NOT NULL THEN ended WHEN late THEN 'max_age_days_exceeded' WHEN ready THEN 'entry_gate_passed' END AS reason FROM a""",
    ("entry_score",),
)
def stream_setup_states(spark, sf_dir):
    c = F.col
    statuses = F.array(*[F.lit(x) for x in ("detected", "watching", "armed", "entry_ready", "invalidated")])
    found = _files(spark, sf_dir, "orders").select(c("o_orderkey").alias("setup_id"), c("o_orderdate").cast("timestamp").alias("detected_at"), F.get(statuses, (c("o_orderkey") % 5).cast("int")).alias("status"))
    told = _files(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("setup_id"), c("l_shipdate").cast("timestamp").alias("at"), c("l_linenumber").alias("tie"), (c("l_quantity") / 8).alias("reward_risk"), c("l_extendedprice").alias("entry_score"), (c("l_discount") >= 0.05).alias("gate_passed"),
        (c("l_partkey") % 9 == 0).alias("broken"), F.when(c("l_partkey") % 9 != 0, F.when(c("l_partkey") % 31 == 0, "own_reason")).alias("invalidation_reason"), (c("l_suppkey") % 11 == 0).alias("blocked"),
    )
    events = setups.detections(found).unionByName(setups.evaluations(told))
    return setups.latest(jobs.run_available(setups.setup_stream(events, max_age_days=90, min_reward_risk=1.0)))


@query("planned_requests")
def planned_requests(spark, sf_dir):
    """Events as requests of an account (its user), those of a minute as one plan."""
    c = F.col
    e = table(spark, sf_dir, "events")
    told = e.select(
        c("user_id").alias("account"), c("event_id").alias("request_id"), F.date_trunc("minute", "ts").alias("at"), F.concat(F.lit("S"), (c("event_id") % 9).cast("string")).alias("symbol"), c("event_type").alias("timeframe"), F.lit("").alias("role"),
        F.when(c("event_id") % 5 == 0, "daily").otherwise("intraday").alias("scope"), (c("event_id") % 3).cast("int").alias("priority"), (c("event_id") % 7 == 0).alias("portfolio_open"), F.when(c("event_id") % 4 == 0, c("ts") - F.expr("INTERVAL 20 MINUTES")).alias("last_updated_at"),
    )
    budgets = (requests.Budget(3600, 2, alike=("symbol",)), requests.Budget(86_400, 12, 3))
    return requests.plan_requests(told, ["account"], budgets, 1500)
