"""Queries of selection under many trials."""

from __future__ import annotations

from math import e

from pyspark.sql import functions as F

from ..functions.scalars import quantile_sql
from ..operators import selection as L
from ..registry import query
from .inputs import TRADES, table, trades
from .research import cdf_sql


def _candidates(spark, sf_dir):
    """A candidate a part and pattern of line items, of runs by returns flag: moments of its returns, a p-value of its t, trials by window."""
    c = F.col
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", c("l_partkey").alias("key"), (c("l_discount") - c("l_tax") + c("l_quantity") / 5000).alias("r"), "l_suppkey")
    s = li.groupBy(c("l_returnflag").alias("run"), "key").agg(F.count("*").alias("n_eff"), (F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("sr"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"), F.countDistinct("l_suppkey").alias("variants"))
    p = F.when(c("key") % 11 != 0, F.exp(-F.abs(F.coalesce("sr", F.lit(0.0))) * F.sqrt("n_eff")))
    return s.filter("n_eff > 2").withColumns({"window": c("key") % 5, "p_value": p})


_CANDIDATES = """li AS (SELECT l_returnflag AS run, l_partkey AS key, l_discount - l_tax + l_quantity / 5000 AS r, l_suppkey FROM lineitem),
g AS (SELECT run, key, count(*) AS n_eff, avg(r) AS m, stddev_samp(r) AS sd, var_pop(r) AS v, avg(r * r * r) AS r3, avg(r * r * r * r) AS r4, avg(r * r) AS r2, count(DISTINCT l_suppkey) AS variants FROM li GROUP BY ALL HAVING count(*) > 2),
c AS (SELECT *, m / nullif(sd, 0) AS sr, (r3 - 3 * m * r2 + 2 * m * m * m) / pow(v, 1.5) AS skew, (r4 - 4 * m * r3 + 6 * m * m * r2 - 3 * m * m * m * m) / (v * v) AS kurt, key % 5 AS win FROM g),
p AS (SELECT *, CASE WHEN key % 11 <> 0 THEN exp(-abs(coalesce(sr, 0)) * sqrt(n_eff)) END AS p_value FROM c)"""


@query(
    "run_inference",
    f"""WITH {_CANDIDATES}, t AS (SELECT run, greatest(1, sum(t) + 10)::BIGINT AS n_trials FROM (SELECT run, win, max(variants) AS t FROM p GROUP BY ALL) GROUP BY run),
s AS (SELECT run, CASE WHEN count(*) >= 3 THEN stddev_samp(coalesce(sr, 0)) ELSE 0 END AS sr_std FROM p GROUP BY run),
k AS (SELECT run, key, p_value, row_number() OVER (PARTITION BY run ORDER BY p_value, key) AS k, count(*) OVER (PARTITION BY run) AS m FROM p WHERE p_value IS NOT NULL),
f AS (SELECT run, max(CASE WHEN p_value <= 0.2::DOUBLE * k / m THEN p_value END) AS fdr_cutoff, count(*) AS fdr_tests FROM k GROUP BY run),
x AS (SELECT p.*, n_trials, sr_std, fdr_cutoff, coalesce(fdr_tests, 0) AS fdr_tests, coalesce(p_value <= fdr_cutoff, false) AS fdr_passed, 1 - 1 / n_trials::DOUBLE AS p1, 1 - 1 / (n_trials::DOUBLE * {e!r}) AS p2 FROM p JOIN t USING (run) JOIN s USING (run) LEFT JOIN f USING (run)),
y AS (SELECT *, CASE WHEN n_trials > 1 AND sr_std > 0 AND n_eff > 1 THEN sr_std * ((1 - {L.EULER!r}::DOUBLE) * ({quantile_sql('p1')}) + {L.EULER!r}::DOUBLE * ({quantile_sql('p2')})) ELSE 0 END AS sr_star, coalesce(sr, 0) AS q FROM x),
z AS (SELECT *, 1 - coalesce(skew, 0) * q + (coalesce(nullif(kurt, 0), 3) - 1) / 4 * q * q AS width FROM y), u AS (SELECT *, CASE WHEN width > 0 THEN (q - sr_star) * sqrt(n_eff - 1) / sqrt(width) END AS zz FROM z)
SELECT run, key, n_trials, sr_std, fdr_cutoff, fdr_tests, fdr_passed, sr_star, CASE WHEN zz IS NOT NULL THEN {cdf_sql('zz')} END AS dsr FROM u""",
    ("sr_std", "fdr_cutoff", "sr_star", "dsr"),
)
def run_inference(spark, sf_dir):
    return L.run_inference(_candidates(spark, sf_dir), "run", "key", q=0.2, prior=10).select("run", "key", "n_trials", "sr_std", "fdr_cutoff", "fdr_tests", "fdr_passed", "sr_star", "dsr")


@query("superior_ability")
def superior_ability(spark, sf_dir):
    t = trades(spark, sf_dir).select(F.substring("pattern", 1, 1).alias("family"), "symbol", "entry_date", (F.col("ret") - 0.01).alias("excess"))
    return L.superior_ability(t, "family", "symbol", "entry_date", "excess", draws=300)


@query(
    "novelty_against_better",
    """WITH c AS (SELECT vec_id, vec_id % 2 AS side, embedding, (vec_id * 37 % 1000) / 1000 AS score, label FROM embeddings),
d AS (SELECT a.vec_id, min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS near FROM c a JOIN c b ON a.side = b.side AND (b.score > a.score OR b.score = a.score AND b.vec_id < a.vec_id) GROUP BY a.vec_id),
n AS (SELECT c.*, coalesce(1 / (1 + near / 8), 0) AS similarity, row_number() OVER (PARTITION BY side, label ORDER BY score DESC, vec_id) AS bucket_rank, 0.05 * (label % 3) AS bonus, 1 + vec_id % 400 AS samples FROM c LEFT JOIN d USING (vec_id)),
g AS (SELECT *, 1 - similarity AS novelty, (1 - similarity) * (score / 2 + bonus) * least(1, 10 / sqrt(samples)) AS gain FROM n)
SELECT vec_id, similarity, novelty, gain, bucket_rank, round(greatest(0, score * (0.78::DOUBLE + 0.22::DOUBLE * novelty) * (1 - least(0.45::DOUBLE, greatest(0, bucket_rank - 3) * 0.12::DOUBLE)) + gain * 0.06::DOUBLE + bonus * 0.03::DOUBLE), 5) AS adjusted_score FROM g""",
    ("similarity", "novelty", "gain"),
)
def novelty_against_better(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "embeddings").select("vec_id", (c("vec_id") % 2).alias("side"), "embedding", (c("vec_id") * 37 % 1000 / 1000).alias("score"), "label")
    out = L.novelty(v, ["side"], "vec_id", "score", "embedding", c("score") / 2, (c("label") % 3) * 0.05, c("vec_id") % 400 + 1, ["side", "label"])
    return out.select("vec_id", "similarity", "novelty", "gain", "bucket_rank", "adjusted_score")


@query(
    "adversarial_probes",
    f"""WITH {TRADES}, t AS (SELECT pattern || substr(symbol, 2, 1) AS pattern, symbol, entry_date, ret + 0.005 AS ret, qty / 5000 AS cost, -ret AS opposite FROM trades),
d AS (SELECT pattern, entry_date, count(*) AS n, sum(ret) AS s, sum(cost) AS c, sum(opposite) AS o FROM t GROUP BY ALL),
h AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pattern ORDER BY entry_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, ceil(sum(n) OVER (PARTITION BY pattern) / 2) AS half FROM d),
a AS (SELECT pattern, sum(n)::BIGINT AS n, sum(s) AS s, sum(c) AS c, sum(o) AS o, max(half) AS half, sum(s * least(greatest(half - before, 0), n) / n) AS first FROM h GROUP BY pattern),
y AS (SELECT pattern, symbol, count(*) AS k, sum(ret) AS s, row_number() OVER (PARTITION BY pattern ORDER BY count(*) DESC, symbol) AS r, count(*) OVER (PARTITION BY pattern) AS symbols FROM t GROUP BY pattern, symbol),
b AS (SELECT a.*, symbols, symbol AS top_symbol, n - k AS kept, CASE WHEN symbols > 1 AND n - k >= 3 THEN (a.s - y.s) / (n - k) END AS without_top FROM a JOIN y ON a.pattern = y.pattern AND r = 1),
e AS (SELECT *, s / n AS expectancy, first / half AS first_half, CASE WHEN n > half THEN (s - first) / (n - half) END AS second_half, (s - c) / n AS replayed, (s - 2 * c) / n AS stressed FROM b),
f AS (SELECT *, least(first_half, second_half) AS worst, o / n / greatest(abs(expectancy), 0.1) AS ratio FROM e),
g AS (SELECT *, round(CASE WHEN symbols <= 1 THEN 0 WHEN kept < 3 THEN 0.1 WHEN without_top > 0 THEN 1 ELSE greatest(0, 1 + without_top / 0.5) END, 5) AS universe_score,
  round(CASE WHEN n < 8 THEN 0.55 ELSE (CASE WHEN worst > 0 THEN 1 ELSE greatest(0, 1 + worst / 0.5) END) * (1 - least(0.5, abs(first_half - second_half) / 2)) END, 5) AS date_score,
  round((CASE WHEN stressed > 0 THEN 0.5 ELSE 0 END) + (CASE WHEN replayed > 0 THEN 0.5 ELSE 0 END), 5) AS cost_score, round(1 - least(greatest(ratio, 0), 1), 5) AS opposite_score FROM f),
i AS (SELECT *, concat_ws(',', CASE WHEN symbols <= 1 OR kept < 3 OR (without_top <= 0 AND expectancy > 0) THEN 'universe' END, CASE WHEN n >= 8 AND worst <= -0.1 THEN 'date' END, CASE WHEN cost_score <= 0 THEN 'cost' END, CASE WHEN ratio >= 1 AND o > 0 THEN 'opposite' END) AS failed,
  round((universe_score + date_score + cost_score + opposite_score) / 4, 8) AS challenge_score FROM g)
SELECT pattern, n, expectancy, top_symbol, without_top, first_half, second_half, stressed, universe_score::DOUBLE AS universe_score, date_score::DOUBLE AS date_score, cost_score::DOUBLE AS cost_score, opposite_score::DOUBLE AS opposite_score, challenge_score::DOUBLE AS challenge_score,
  challenge_score >= 0.55 AND failed = '' AS challenge_passed, failed AS failures FROM i""",
    ("expectancy", "without_top", "first_half", "second_half", "stressed", "universe_score", "date_score", "cost_score", "opposite_score"),
)
def adversarial_probes(spark, sf_dir):
    t = trades(spark, sf_dir).select(F.concat("pattern", F.substring("symbol", 2, 1)).alias("pattern"), "symbol", "entry_date", (F.col("ret") + 0.005).alias("ret"), (F.col("qty") / 5000).alias("cost"), (-F.col("ret")).alias("opposite"))
    return L.probes(t, "pattern", "symbol", "entry_date", "ret", "cost", "opposite").withColumns({"failures": F.array_join("failures", ","), "challenge_score": F.round("challenge_score", 8)})


@query(
    "leakage_probe",
    """WITH s AS (SELECT label, (vec_id % 7) / 7 + embedding[1] AS y, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
r AS (SELECT label, d, count(*) AS n, CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN abs(corr(x, y)) END AS r FROM s GROUP BY ALL), m AS (SELECT label, max(n) AS n, coalesce(max(r), 0) AS most FROM r GROUP BY label)
SELECT label, n, most, round(CASE WHEN n < 8 THEN 0.65 ELSE 1 - least(greatest((most - 0.55) / 0.4, 0), 1) END, 5)::DOUBLE AS score, most >= 0.92 AND n >= 20 AS hard_fail FROM m""",
    ("most", "score"),
)
def leakage_probe(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("y", F.col("vec_id") % 7 / 7 + F.col("embedding")[0])
    return L.leakage_probe(v, "label", "embedding", "y")
