"""Queries of calibration, controls, forward gains, quotas and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import similarity as V
from ..operators.windows import by
from ..registry import query
from .inputs import BARS, TRADES, daily_bars, table, trades
from .research import _PROTO


@query("cost_filter", f"WITH {TRADES} SELECT trade_id, qty, price FROM trades WHERE price / 1000 <= 1.2")
def cost_filter(spark, sf_dir):
    costs = trades(spark, sf_dir).withColumn("cost_r", F.col("price") / 1000)
    return E.cost_filter(costs, "cost_r", 1.2).select("trade_id", "qty", "price")


@query(
    "window_quotas",
    f"WITH {BARS}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), q AS (SELECT unnest([20, 40, 60])::INTEGER AS size, unnest([34, 33, 33]) AS quota) SELECT symbol, size, greatest(n - size + 1, 0) AS possible, least(greatest(n - size + 1, 0), quota) AS taken FROM n, q",
)
def window_quotas(spark, sf_dir):
    return E.windows_by_quota(daily_bars(spark, sf_dir), [20, 40, 60], 100)


@query(
    "event_gain",
    f"""WITH {BARS}, a AS (SELECT symbol, date, close, max(high) OVER w AS h, min(low) OVER w AS l FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
g AS (SELECT symbol, date, h, CASE WHEN h IS NULL THEN 0 ELSE greatest(h / close - 1, 0) END AS long_gain, CASE WHEN h IS NULL THEN 0 ELSE greatest(1 - l / close, 0) END AS short_gain FROM a)
SELECT symbol, date, long_gain, short_gain, greatest(long_gain, short_gain) AS gain, CASE WHEN h IS NULL THEN '' WHEN long_gain >= short_gain THEN 'long' ELSE 'short' END AS direction, h IS NOT NULL AND greatest(long_gain, short_gain) >= 0.05 AS passed FROM g""",
    ("long_gain", "short_gain", "gain"),
)
def event_gain(spark, sf_dir):
    return E.event_gain(daily_bars(spark, sf_dir), by(), 5, 0.05).select("symbol", "date", "long_gain", "short_gain", "gain", "direction", "passed")


@query(
    "control_against_target",
    f"""WITH {TRADES}, e AS (SELECT pattern, symbol, substr(symbol, 2)::INTEGER < 10 AS target, avg(ret) AS e FROM trades GROUP BY ALL), b AS (SELECT pattern, coalesce(max(e) FILTER (WHERE target), 0) AS target_best, coalesce(max(e) FILTER (WHERE NOT target), 0) AS control_best, min(e) > -1 AS f FROM e GROUP BY pattern)
SELECT pattern, target_best, control_best, CASE WHEN control_best >= target_best OR NOT f THEN 'STAT_BASELINE_FAIL' ELSE 'STAT_BASELINE_PASS' END AS decision FROM b""",
    ("target_best", "control_best"),
)
def control_against_target(spark, sf_dir):
    edge = trades(spark, sf_dir).groupBy("pattern", "symbol").agg(F.avg("ret").alias("e"))
    target = F.substring("symbol", 2, 9).cast("int") < 10
    return E.control_against_target(edge, ["pattern"], "e", target, ~target, F.col("e") > -1)


@query(
    "calibration_report",
    """WITH r AS (SELECT (l_returnflag = 'R')::INTEGER AS y, l_quantity / 50 AS p, l_orderkey AS k, l_linenumber AS i FROM lineitem), t AS (SELECT count(*) AS n, avg((p - y) ** 2) AS brier, avg(y) AS base FROM r),
e AS (SELECT sum(abs(p - y)) / sum(c) AS ece FROM (SELECT least(floor(p * 10), 9) AS b, sum(p) AS p, sum(y) AS y, count(*) AS c FROM r GROUP BY 1)), o AS (SELECT y, row_number() OVER (ORDER BY p DESC, k, i, y DESC) AS place FROM r),
u AS (SELECT count(*) AS top_count, avg(y) AS top_rate FROM o WHERE place <= ceil((SELECT count(*) FROM r) * 0.1::DOUBLE)), s AS (SELECT count(*) AS selected, avg(y) AS sr FROM r WHERE p >= 0.2)
SELECT n AS samples, NULL::VARCHAR AS reason, brier, ece, base AS base_rate, top_count, top_rate, selected, sr AS selected_rate, top_rate - base AS uplift, sr * 4 - (1 - sr) AS selected_expectancy, brier <= 0.2 AND ece <= 0.06 AND top_count >= 5 AND top_rate - base >= 0.08 AS passed FROM t, e, u, s""",
    ("brier", "ece", "base_rate", "top_rate", "selected_rate", "uplift", "selected_expectancy"),
)
def calibration_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p"), "l_orderkey", "l_linenumber")
    return E.calibration_report(rows, "y", "p", ["l_orderkey", "l_linenumber"])


@query(
    "scaled_vectors",
    f"WITH {_PROTO}, e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings) SELECT vec_id, sum(abs((x - m) / CASE WHEN v = 0 THEN 1 ELSE sqrt(v) END)) AS size FROM e JOIN c USING (label, d) GROUP BY vec_id",
    ("size",),
)
def scaled_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    scaled = E.scaled_for(F.col("embedding"), F.col("centroid"), F.col("centroid"), F.transform("variance", F.sqrt))
    return v.join(V.prototypes(v, "label", "embedding"), "label").select("vec_id", F.aggregate(F.transform(scaled, F.abs), F.lit(0.0), lambda s, x: s + x).alias("size"))
