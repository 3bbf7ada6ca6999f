"""Queries of portfolio policies, audits and shapes."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import portfolio as B
from ..operators import shapes as H
from ..operators import similarity as V
from ..operators import windows as W
from ..registry import query
from .inputs import BARS, TRADES, daily_bars, table, trades
from .research import _PROTO, cdf_sql, moments_sql


@query(
    "execution_proxy",
    f"""WITH {BARS}, a AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p, close * volume AS dv FROM bars)
SELECT symbol, date, least(greatest((high - low) / close * 10000 * 0.05, 1), 100) AS spread_bps, 10 * sqrt(least(1e7 / dv, 1) * 100) AS impact_bps, CASE WHEN p IS NOT NULL THEN least(greatest(abs(open / p - 1) * 10000 * 0.1, 0), 50) ELSE 0.0 END AS gap_bps, 1 - least(1e7 / dv, 1) * 0.5 AS fill_probability, dv * 0.01 AS max_order FROM a""",
    ("spread_bps", "impact_bps", "gap_bps", "fill_probability", "max_order"),
)
def execution_proxy(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).withColumn("p", F.lag("close").over(W.by()))
    made = B.execution_proxy(F.col("close"), F.col("high"), F.col("low"), F.col("p"), F.col("open"), F.col("close") * F.col("volume"), 1e7)
    return bars.select("symbol", "date", *[v.alias(k) for k, v in made.items()])


@query("median_split", f"WITH {TRADES}, m AS (SELECT pattern, quantile_cont(price, 0.5) AS m FROM trades GROUP BY pattern) SELECT pattern, count(*) AS n, avg(ret) AS mean FROM trades JOIN m USING (pattern) WHERE price <= m GROUP BY pattern", ("mean",))
def median_split(spark, sf_dir):
    return B.median_split(trades(spark, sf_dir), "pattern", "price").groupBy("pattern").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))


@query(
    "timing_audit",
    f"""WITH {BARS}, a AS (SELECT symbol, date, row_number() OVER w - 1 AS idx, row_number() OVER w AS n, close < lag(close) OVER w AS down, lead(close, 3) OVER w / open - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT *, coalesce(idx - lag(idx) OVER (PARTITION BY symbol ORDER BY idx), 999999) AS gap FROM a WHERE down), e AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY idx) AS episode FROM g), f AS (SELECT symbol, min(idx) AS i FROM e GROUP BY symbol, episode),
m AS (SELECT f.symbol, i + 2 + o AS n, o FROM f, (VALUES (0), (1), (2), (5)) v(o)), r AS (SELECT o, date >= DATE '1998-01-01' AS oos, count(ret) AS n, avg(ret) AS mean FROM m JOIN a USING (symbol, n) GROUP BY ALL)
SELECT r.oos, o::INTEGER AS "offset", n, mean, mean >= b.m AS at_least_base FROM r JOIN (SELECT oos, mean AS m FROM r WHERE o = 0) b ON b.oos = r.oos""",
    ("mean",),
)
def timing_audit(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    signals = bars.withColumns({"idx": F.row_number().over(W.by()) - 1, "down": F.col("close") < F.lag("close").over(W.by())}).filter("down")
    return B.timing_audit(W.episodes(signals, "idx", 3), bars, [0, 1, 2, 5], 3, "1998-01-01")


@query(
    "latency_replay",
    f"""WITH {BARS}, a AS (SELECT symbol, lead(close, 5) OVER w / lead(open, 1) OVER w - 1 AS r0, lead(close, 6) OVER w / lead(open, 2) OVER w - 1 - 0.001 AS r1, lead(close, 8) OVER w / lead(open, 4) OVER w - 1 - 0.003 AS r3 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
l AS (SELECT symbol, 0 AS delay, r0 AS r FROM a UNION ALL SELECT symbol, 1, r1 FROM a UNION ALL SELECT symbol, 3, r3 FROM a) SELECT symbol, delay, count(r) AS n, avg(r) AS mean FROM l GROUP BY ALL""",
    ("mean",),
)
def latency_replay(spark, sf_dir):
    return B.latency(daily_bars(spark, sf_dir), [0, 1, 3], 5, 0.001)


@query(
    "adverse_variants",
    f"""WITH {BARS}, a AS (SELECT lead(close, 4) OVER w AS x, lead(open, 1) OVER w AS e, lead(close, 1) OVER w AS c FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)), l AS (SELECT 'base' AS variant, x / e - 1 AS r FROM a UNION ALL SELECT 'next_close', x / c - 1 FROM a UNION ALL SELECT 'adverse', x * 0.999 / (e * 1.001) - 1 FROM a)
SELECT variant, count(r) AS n, avg(r) AS mean FROM l GROUP BY variant""",
    ("mean",),
)
def adverse_variants(spark, sf_dir):
    return B.adverse_variants(daily_bars(spark, sf_dir), 3)


@query("edge_decay", f"WITH {TRADES}, l AS (SELECT (qty % 10)::DOUBLE AS lv, avg(ret) AS e FROM trades GROUP BY 1) SELECT (SELECT e FROM l WHERE lv = 4) AS own_edge, (SELECT avg(e) FROM l WHERE lv IN (3, 5)) AS near_edge, (SELECT e FROM l WHERE lv = 4) - (SELECT avg(e) FROM l WHERE lv IN (3, 5)) AS decay", ("own_edge", "near_edge", "decay"))
def edge_decay(spark, sf_dir):
    return B.edge_decay(trades(spark, sf_dir).groupBy((F.col("qty") % 10).alias("lv")).agg(F.avg("ret").alias("e")), "lv", "e", 4.0)


@query("portfolio_two_new_a_day")
def portfolio_two_new_a_day(spark, sf_dir):
    return B.two_new_a_day(trades(spark, sf_dir).withColumn("portfolio", F.col("pattern")))


@query(
    "regime_flag",
    f"""WITH {BARS}, a AS (SELECT symbol, date, CASE WHEN count(close) OVER f >= 200 THEN close > avg(close) OVER f END AS t, close / lag(close, 20) OVER w - 1 > 0 AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), f AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING)),
k AS (SELECT symbol, date, coalesce(t OR r, r, FALSE) AS ok FROM a WHERE symbol IN ('S0', 'S1')) SELECT date, coalesce(bool_or(ok) FILTER (WHERE symbol = 'S0'), bool_or(ok) FILTER (WHERE symbol = 'S1')) AS regime_ok FROM k GROUP BY date""",
)
def regime_flag(spark, sf_dir):
    return B.regime_flag(daily_bars(spark, sf_dir), "S0", "S1")


@query(
    "committee_review",
    f"WITH {TRADES}, m AS (SELECT symbol, count(*) AS n, avg(ret) AS e, avg((ret > 0)::INTEGER) AS w FROM trades GROUP BY symbol) SELECT symbol, ((n >= 100)::INTEGER + (e > 0.01)::INTEGER + (w > 0.5)::INTEGER) AS votes, (n >= 100)::INTEGER + (e > 0.01)::INTEGER + (w > 0.5)::INTEGER >= 2 AS promoted, array_to_string(list_filter([CASE WHEN NOT n >= 100 THEN 'sample' END, CASE WHEN NOT e > 0.01 THEN 'edge' END, CASE WHEN NOT w > 0.5 THEN 'hit_rate' END], lambda x: x IS NOT NULL), ',') AS dissent FROM m",
)
def committee_review(spark, sf_dir):
    m = trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("ret").alias("e"), F.avg((F.col("ret") > 0).cast("double")).alias("w"))
    return m.select("symbol", *B.committee({"sample": F.col("n") >= 100, "edge": F.col("e") > 0.01, "hit_rate": F.col("w") > 0.5}, 2))


@query("factor_score", "SELECT c_custkey, least(greatest(0.1 + 0.5 * least(greatest(c_acctbal / 10000, 0), 1) + 0.6 * least(greatest(c_nationkey / 24, 0), 1), 0), 1) AS score FROM customer", ("score",), 9)
def factor_score(spark, sf_dir):
    score = B.factor_score({"a": (F.col("c_acctbal") / 10_000, 0.5), "b": (F.col("c_nationkey") / 24, 0.6)}, 0.1)
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))


@query(
    "scaled_similarity",
    f"WITH {_PROTO}, e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS d FROM embeddings) SELECT vec_id, 1 / (1 + sqrt(sum(power((x - m) * power(0.97, 63 - d), 2))) / sqrt((SELECT sum(power(0.97, 2 * i)) FROM range(64) r(i)))) AS similarity FROM e JOIN c USING (label, d) GROUP BY vec_id",
    ("similarity",),
)
def scaled_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.join(V.prototypes(v, "label", "embedding"), "label").select("vec_id", H.scaled_similarity(F.col("embedding"), F.col("centroid"), 0.97, 64).alias("similarity"))


@query(
    "shapelet_scores",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, 2 * unnest(range(64)) / 63 - 1 AS t FROM embeddings) SELECT vec_id, corr(x, abs(t)) AS v, corr(x, -abs(t)) AS peak, corr(x, t) AS rise FROM e GROUP BY vec_id""",
    ("v", "peak", "rise"),
)
def shapelet_scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *[s.alias(k) for k, s in H.shapelet_scores(F.col("embedding"), 64).items()])


@query(
    "false_match_rates",
    f"""WITH {_PROTO}, s AS (SELECT label, 1 / (1 + list_distance(embedding::DOUBLE[], (SELECT centroid FROM p WHERE label = 0))) AS sim FROM embeddings), t AS (SELECT quantile_cont(sim, 1 - 0.9::DOUBLE) AS th FROM s WHERE label = 0)
SELECT label, count(*) AS n, avg((sim >= th)::INTEGER) AS fpr, any_value(th) AS threshold FROM s, t WHERE label <> 0 GROUP BY label""",
    ("fpr", "threshold"),
)
def false_match_rates(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    centre = V.prototypes(v.filter("label = 0"), "label", "embedding").select("centroid").first()[0]
    scores = v.select("label", (1 / (1 + V.distance(F.col("embedding"), F.lit(centre)))).alias("sim"), (F.col("label") == 0).alias("own"))
    return H.false_matches(scores, "label", "sim", "own", 0.9)


@query("soft_dtw_divergence")
def soft_dtw_divergence(spark, sf_dir):
    return H.soft_dtw_divergence(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", [i / 64 for i in range(64)])


_EULER, _Q = 0.5772156649015329, NormalDist().inv_cdf
_BEST = (1 - _EULER) * _Q(1 - 1 / 20) + _EULER * _Q(1 - 1 / (20 * math.e))


@query(
    "deflated_sharpe",
    f"""WITH {moments_sql("symbol")}, b AS (SELECT {_BEST!r} * stddev_samp(sr) AS best FROM s), d AS (SELECT symbol, sr, best, (sr - best) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM s, b)
SELECT symbol, sr, best AS expected_best, {cdf_sql("z")} AS dsr FROM d""",
    ("sr", "expected_best", "dsr"),
)
def deflated_sharpe(spark, sf_dir):
    return H.deflated_sharpe(I.sharpe(trades(spark, sf_dir), ["symbol"], "ret").select("symbol", "n", "sr", "skew", "kurt"), 20).select("symbol", "sr", "expected_best", "dsr")


@query("family_reality_check")
def family_reality_check(spark, sf_dir):
    return H.family_max(trades(spark, sf_dir), "symbol", "exit_date", "ret")


@query("romano_wolf")
def romano_wolf(spark, sf_dir):
    return H.romano_wolf(trades(spark, sf_dir), "symbol", "exit_date", "ret")


@query("cup_detector")
def cup_detector(spark, sf_dir):
    return H.cups(daily_bars(spark, sf_dir), 60)


@query(
    "geometry_score",
    f"""WITH {BARS}, r AS (SELECT symbol, year(date) AS year, date, close, row_number() OVER (PARTITION BY symbol, year(date) ORDER BY date DESC) AS r FROM bars),
k AS (SELECT *, (close - min(close) OVER p) / greatest(max(close) OVER p - min(close) OVER p, 1e-9) AS y, count(*) OVER p AS n FROM r WHERE r <= 180 WINDOW p AS (PARTITION BY symbol, year)),
x AS (SELECT *, -1 + 2 * (n - r) / greatest(n - 1, 1) AS x, abs(y - 2 * lag(y) OVER w + lag(y, 2) OVER w) AS bend FROM k WINDOW w AS (PARTITION BY symbol, year ORDER BY date)),
g AS (SELECT symbol, year, count(*) AS points, coalesce(CASE WHEN stddev_pop(y) > 1e-9 THEN corr(y, x * x) ELSE 0 END, 0) AS correlation, least(greatest(coalesce(1 - avg(bend) * 8, 0), 0), 1) AS smooth,
  least(greatest(1 - (max(y) FILTER (WHERE r <= CASE WHEN n > 12 THEN 12 ELSE 5 END) - min(y) FILTER (WHERE r <= CASE WHEN n > 12 THEN 12 ELSE 5 END)) * 2.5, 0), 1) AS handle FROM x GROUP BY ALL)
SELECT *, CASE WHEN points >= 35 THEN least(greatest(correlation, 0), 1) * 0.5 + smooth * 0.3::DOUBLE + handle * 0.2::DOUBLE ELSE 0 END AS score FROM g""",
    ("correlation", "smooth", "handle", "score"),
)
def geometry_score(spark, sf_dir):
    return H.geometry_score(daily_bars(spark, sf_dir).withColumn("year", F.year("date")), ["symbol", "year"], "date")
