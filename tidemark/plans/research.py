"""Queries of simulation, inference and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import inference as I
from ..operators import similarity as V
from ..operators import simulation as X
from ..operators import windows as W
from ..registry import SQL, query
from .inputs import BARS, BENCHMARK, TRADES, daily_bars, table, trades


@query(
    "triple_barrier",
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars), s AS (SELECT symbol, date, k, close * 0.8 AS st, close * 1.5 AS tg, lead(open) OVER (PARTITION BY symbol ORDER BY date) AS entry FROM n),
f AS (SELECT s.symbol, s.date, s.k, st, tg, entry, f.k - s.k AS i, f.open, f.high, f.low, f.close FROM s JOIN n f ON f.symbol = s.symbol AND f.k BETWEEN s.k + 1 AND s.k + 5),
h AS (SELECT *, CASE WHEN i > 1 AND open <= st THEN 'stop_gap' WHEN i > 1 AND open >= tg THEN 'target_gap' WHEN low <= st THEN 'stop' WHEN high >= tg THEN 'target' WHEN i >= 5 THEN 'time' END AS how FROM f),
x AS (SELECT *, min(CASE WHEN how IS NOT NULL THEN i END) OVER (PARTITION BY symbol, k) AS at_i, max(i) OVER (PARTITION BY symbol, k) AS last_i FROM h),
a AS (SELECT symbol, date, any_value(st) AS st, any_value(tg) AS tg, any_value(entry) AS entry, coalesce(any_value(at_i), any_value(last_i)) AS held, any_value(how) FILTER (WHERE i = at_i) AS how,
  any_value(CASE WHEN how IN ('stop_gap', 'target_gap') THEN open WHEN how = 'stop' THEN st WHEN how = 'target' THEN tg WHEN how = 'time' THEN close END) FILTER (WHERE i = at_i) AS ex, max(high) FILTER (WHERE i <= coalesce(at_i, 99)) AS hi, min(low) FILTER (WHERE i <= coalesce(at_i, 99)) AS lo FROM x GROUP BY symbol, date, k),
b AS (SELECT *, entry <= st OR entry >= tg AS skip FROM a)
SELECT symbol, date, CASE WHEN skip THEN 'skip_gap' ELSE coalesce(how, 'open') END AS outcome, (CASE WHEN NOT skip THEN held END)::INTEGER AS bars_held, CASE WHEN NOT skip THEN (ex - entry) / (entry - st) END AS r,
  CASE WHEN NOT skip THEN (hi - entry) / (entry - st) END AS mfe, CASE WHEN NOT skip THEN (lo - entry) / (entry - st) END AS mae FROM b""",
    ("r", "mfe", "mae"),
)
def triple_barrier(spark, sf_dir):
    path = X.forward_path(daily_bars(spark, sf_dir), 5)
    return X.triple_barrier(path, "path", F.col("close") * 0.8, F.col("close") * 1.5, 5).select("symbol", "date", "outcome", "bars_held", "r", "mfe", "mae")


def _hold_sql(exit_date: str, exit_: str) -> str:
    return f"""WITH RECURSIVE {BARS}, a AS (SELECT *, close < lag(close) OVER w AND lag(close) OVER w < lag(close, 2) OVER w AS sig, lead(date) OVER w AS entry_date, lead(open) OVER w AS entry, {exit_date} AS exit_date, {exit_} AS exit FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_date) AS i FROM a WHERE sig AND entry_date IS NOT NULL AND exit_date IS NOT NULL),
r AS (SELECT symbol, entry_date, exit_date, exit / entry - 1 AS ret, i, TRUE AS taken, exit_date AS last FROM o WHERE i = 1
  UNION ALL SELECT o.symbol, o.entry_date, o.exit_date, o.exit / o.entry - 1, o.i, o.entry_date > r.last, CASE WHEN o.entry_date > r.last THEN o.exit_date ELSE r.last END FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1)
SELECT symbol, entry_date, exit_date, ret FROM r WHERE taken"""


def _two_down():
    w = W.by()
    return F.coalesce((F.col("close") < F.lag("close").over(w)) & (F.lag("close").over(w) < F.lag("close", 2).over(w)), F.lit(False))


@query("pullback_trades_full_hold", _hold_sql("lead(date, 6) OVER w", "lead(close, 6) OVER w"), ("ret",))
def pullback_trades_full_hold(spark, sf_dir):
    return X.fixed_hold(daily_bars(spark, sf_dir), _two_down(), 5)


@query("breakout_trades_truncated", _hold_sql("coalesce(lead(date, 41) OVER w, max(date) OVER (PARTITION BY symbol))", "coalesce(lead(close, 41) OVER w, last_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"), ("ret",))
def breakout_trades_truncated(spark, sf_dir):
    return X.fixed_hold(daily_bars(spark, sf_dir), _two_down(), 40, truncate=True)


@query(
    "placebo_shifts",
    f"""WITH {BARS}, a AS (SELECT symbol, row_number() OVER w AS n, close < lag(close) OVER w AND lag(close) OVER w < lag(close, 2) OVER w AS sig, lead(close, 4) OVER w / lead(open) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
m AS (SELECT symbol, n + s AS n, s FROM a, (VALUES (0), (1), (2), (3), (5), (10)) v(s) WHERE sig) SELECT s::INTEGER AS shift, count(ret) AS n, avg(ret) AS mean FROM m JOIN a USING (symbol, n) GROUP BY s""",
    ("mean",),
)
def placebo_shifts(spark, sf_dir):
    return X.shifted_signals(daily_bars(spark, sf_dir), _two_down(), [0, 1, 2, 3, 5, 10], 3)


MATRIX = [("A", 0.005, 0.5, "any", "any"), ("B", 0.5, 9.9, "any", "down"), ("C", 0.02, 9.9, "up", "up"), ("D", 0.0, 0.002, "any", "any")]


@query(
    "gap_matrix",
    f"""WITH l AS ({SQL["gap_event_ledger"].split("FROM (", 1)[1][:-1]}), m(test_id, min_gap, max_gap, direction, regime) AS (VALUES {", ".join(map(str, MATRIX))}),
h AS (SELECT test_id, symbol, date >= DATE '1998-01-01' AS oos, CASE WHEN gap_direction = 'up' THEN -open_to_close ELSE open_to_close END AS ret FROM l JOIN m ON abs(gap_pct) >= min_gap AND abs(gap_pct) < max_gap AND (direction = 'any' OR direction = gap_direction)
  WHERE regime = 'any' OR (regime = 'down' AND coalesce(benchmark_return_20d, 0) <= 0) OR (regime = 'up' AND coalesce(benchmark_return_20d, 0) > 0)),
g AS (SELECT test_id, oos, count(*) AS n, count(DISTINCT symbol) AS symbols, avg(ret) AS mean_x1, coalesce(sum(ret) FILTER (WHERE ret > 0), 0) AS g1, coalesce(sum(-ret) FILTER (WHERE ret < 0), 0) AS l1, avg(ret - 0.002) AS mean_x2, coalesce(sum(ret - 0.002) FILTER (WHERE ret - 0.002 > 0), 0) AS g2, coalesce(sum(0.002 - ret) FILTER (WHERE ret - 0.002 < 0), 0) AS l2 FROM h GROUP BY ALL)
SELECT test_id, oos, n, symbols, mean_x1, CASE WHEN l1 > 0 THEN g1 / l1 ELSE g1 END AS pf_x1, mean_x2, CASE WHEN l2 > 0 THEN g2 / l2 ELSE g2 END AS pf_x2 FROM g""",
    ("mean_x1", "pf_x1", "mean_x2", "pf_x2"),
)
def gap_matrix(spark, sf_dir):
    matrix = spark.createDataFrame(MATRIX, "test_id string, min_gap double, max_gap double, direction string, regime string")
    return X.run_matrix(W.gap_ledger(daily_bars(spark, sf_dir), BENCHMARK), matrix, "1998-01-01", {"x1": 0.0, "x2": 0.002})


@query(
    "benjamini_hochberg",
    """WITH p AS (SELECT c_nationkey AS family, c_custkey AS k, power((c_custkey % 997 + 1) / 1000.0::DOUBLE, 3) AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, k) AS rk, count(*) OVER (PARTITION BY family) AS m FROM p),
c AS (SELECT *, max(CASE WHEN p <= 0.05::DOUBLE * rk / m THEN p END) OVER (PARTITION BY family) AS cut FROM r)
SELECT family, k, p, coalesce(p <= cut, FALSE) AS rejected, least(p * m / rk, 1.0) AS q_light, least(min(p * m / rk) OVER (PARTITION BY family ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q_value FROM c""",
    ("p", "q_light", "q_value"),
)
def benjamini_hochberg(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("k"), F.pow((F.col("c_custkey") % 997 + 1) / 1000.0, F.lit(3)).alias("p"))
    return I.benjamini_hochberg(c, ["family"], "p", "k")


def moments_sql(key: str) -> str:
    return f"""{TRADES}, m AS (SELECT {key}, avg(ret) AS mu FROM trades GROUP BY {key}), s AS (SELECT {key}, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(power(ret - mu, 3)) / power(avg(power(ret - mu, 2)), 1.5) AS skew,
avg(power(ret - mu, 4)) / power(avg(power(ret - mu, 2)), 2) AS kurt FROM trades JOIN m USING ({key}) GROUP BY {key})"""


def cdf_sql(z: str) -> str:
    """The normal distribution function of a column by a series for the middle and a continued fraction for the tails (error below 1e-12)."""
    terms, tail = "1.0::DOUBLE", f"abs({z})"
    for k in range(120, 0, -1):
        terms = f"1 + {z} * {z} / {2 * k + 1} * ({terms})"
    for k in range(60, 0, -1):
        tail = f"abs({z}) + {k} / ({tail})"
    density = f"exp(-{z} * {z} / 2) / sqrt(2 * pi())"
    return f"CASE WHEN abs({z}) < 4 THEN 0.5 + {density} * {z} * ({terms}) WHEN {z} > 0 THEN 1 - {density} / ({tail}) ELSE {density} / ({tail}) END"


_ORDERED = f"{TRADES}, o AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY entry_date, trade_id, qty, price) AS i FROM trades)"
_ORDER = ["entry_date", "trade_id", "qty", "price"]


@query(
    "newey_west",
    f"""WITH {_ORDERED}, d AS (SELECT *, ret - avg(ret) OVER (PARTITION BY pattern) AS d FROM o), l AS (SELECT *, d * d AS g0, d * lag(d, 1) OVER w AS g1, d * lag(d, 2) OVER w AS g2, d * lag(d, 3) OVER w AS g3 FROM d WINDOW w AS (PARTITION BY pattern ORDER BY i)),
s AS (SELECT pattern, count(*) AS n, avg(ret) AS mean, sum(g0) / count(*) + 2 * 0.75 * coalesce(sum(g1), 0) / count(*) + 2 * 0.5 * coalesce(sum(g2), 0) / count(*) + 2 * 0.25 * coalesce(sum(g3), 0) / count(*) AS v FROM l GROUP BY pattern)
SELECT pattern, n, mean, CASE WHEN v > 0 THEN mean / sqrt(v / n) END AS t FROM s""",
    ("mean", "t"),
)
def newey_west(spark, sf_dir):
    return I.newey_west(trades(spark, sf_dir), ["pattern"], _ORDER, "ret", 3)


@query(
    "sharpe_moments",
    f"""WITH {moments_sql("pattern")}
SELECT *, sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM s""",
    ("sr", "skew", "kurt", "z"),
)
def sharpe_moments(spark, sf_dir):
    return I.sharpe(trades(spark, sf_dir), ["pattern"], "ret").drop("psr")


@query("probabilistic_sharpe", f"WITH {moments_sql('pattern')} SELECT pattern, {cdf_sql('z')} AS psr FROM (SELECT *, sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM s)", ("psr",))
def probabilistic_sharpe(spark, sf_dir):
    return I.sharpe(trades(spark, sf_dir), ["pattern"], "ret").select("pattern", "psr")


@query(
    "sprt",
    f"""WITH {_ORDERED}, c AS (SELECT pattern, i, sum((ret - 0.01) * (0.02 / 0.0025)) OVER (PARTITION BY pattern ORDER BY i) AS llr FROM o), f AS (SELECT pattern, count(*) AS n, min(CASE WHEN llr >= ln(0.8 / 0.05) OR llr <= ln(0.2 / 0.95) THEN i END) AS s FROM c GROUP BY pattern)
SELECT f.pattern, f.n, f.s::INTEGER AS stopped_at, CASE WHEN s IS NULL THEN 'continue' WHEN llr >= ln(0.8 / 0.05) THEN 'accept_h1' ELSE 'accept_h0' END AS decision FROM f LEFT JOIN c ON c.pattern = f.pattern AND c.i = f.s""",
)
def sprt(spark, sf_dir):
    return I.sprt(trades(spark, sf_dir), ["pattern"], _ORDER, "ret", 0.0, 0.02, 0.05)


@query(
    "kolmogorov_smirnov",
    """WITH c AS (SELECT l_linestatus AS k, l_quantity AS v, count(*) FILTER (WHERE l_returnflag <> 'R') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL),
g AS (SELECT k, a, b, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY k) - sum(b) OVER w / sum(b) OVER (PARTITION BY k)) AS g FROM c WINDOW w AS (PARTITION BY k ORDER BY v)) SELECT k, max(g) AS ks, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM g GROUP BY k""",
    ("ks",),
)
def kolmogorov_smirnov(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("k"), "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("s"))
    return I.kolmogorov_smirnov(t, ["k"], "l_quantity", "s")


@query(
    "purged_walk_forward",
    f"""WITH {TRADES}, f AS (SELECT *, ntile(5) OVER (PARTITION BY pattern ORDER BY entry_date, trade_id, qty, price) AS fold FROM trades), t AS (SELECT pattern, fold, min(entry_date) AS s, count(*) AS n_test FROM f WHERE fold > 1 GROUP BY ALL)
SELECT pattern, fold::INTEGER AS fold, (SELECT count(*) FROM trades x WHERE x.pattern = t.pattern AND x.exit_date < t.s - 5) AS n_train, n_test FROM t""",
)
def purged_walk_forward(spark, sf_dir):
    return I.walk_forward(trades(spark, sf_dir), ["pattern"], _ORDER, "entry_date", "exit_date", 5, 5)


@query(
    "pbo_cscv",
    f"""WITH {TRADES}, b AS (SELECT (month(exit_date) - 1) // 2 AS b, symbol AS variant, sum(ret) AS s, count(*) AS c FROM trades GROUP BY ALL), x AS (SELECT a, d, e, row_number() OVER (ORDER BY a, d, e) - 1 AS split FROM range(6) p(a), range(6) q(d), range(6) r(e) WHERE a < d AND d < e),
m AS (SELECT split, variant, sum(s) FILTER (WHERE b IN (a, d, e)) / sum(c) FILTER (WHERE b IN (a, d, e)) AS i, sum(s) FILTER (WHERE b NOT IN (a, d, e)) / sum(c) FILTER (WHERE b NOT IN (a, d, e)) AS o FROM b, x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(i, 9) DESC, variant) AS k, rank() OVER (PARTITION BY split ORDER BY round(o, 9)) AS rk, count(*) OVER (PARTITION BY split) AS n FROM m) SELECT split::INTEGER AS split, variant, rk / (n + 1) AS omega FROM r WHERE k = 1""",
    ("omega",),
)
def pbo_cscv(spark, sf_dir):
    return I.pbo(trades(spark, sf_dir), F.floor((F.month("exit_date") - 1) / 2).cast("int"), "symbol", "ret", 6)


@query("permutation_p", "SELECT (1 + count(*) FILTER (WHERE l_discount >= 0.09)) / (count(*) + 1) AS p FROM lineitem", ("p",))
def permutation_p(spark, sf_dir):
    return I.permutation_p(table(spark, sf_dir, "lineitem"), 0.09, "l_discount")


@query("stationary_bootstrap")
def stationary_bootstrap(spark, sf_dir):
    return I.stationary_bootstrap(trades(spark, sf_dir).select("pattern", "ret", *_ORDER), ["pattern"], _ORDER, "ret", draws=100)


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf_dir):
    return I.cluster_bootstrap(trades(spark, sf_dir), ["symbol", "entry_date"], "ret")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


_PROTO = """l AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings), c AS (SELECT label, d, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY ALL),
p AS (SELECT label, list(m ORDER BY d) AS centroid, list(v ORDER BY d) AS variance FROM c GROUP BY label)"""


#: The same over the rows that don't calibrate.
_FITTED = _PROTO.replace("FROM embeddings)", "FROM embeddings WHERE substr(md5(vec_id::VARCHAR), 1, 1) >= '4')")


@query("prototype_bank", f"WITH {_PROTO} SELECT label, round(list_sum(centroid), 6) + 0.0 AS centroid_sum, round(list_sum(variance), 6) + 0.0 AS variance_sum FROM p")
def prototype_bank(spark, sf_dir):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)
    return V.prototypes(_vectors(spark, sf_dir), "label", "embedding").select("label", total("centroid").alias("centroid_sum"), total("variance").alias("variance_sum"))


@query(
    "radius_assignment",
    f"""WITH {_PROTO}, d AS (SELECT vec_id, p.label AS l, list_distance(embedding::DOUBLE[], centroid) AS dist FROM embeddings, p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, l) AS k FROM d)
SELECT a.vec_id, a.l AS nearest, a.dist AS distance, a.dist / nullif(b.dist, 0) AS ambiguity, radius, CASE WHEN a.dist <= 1.25 * radius THEN a.l ELSE -1 END AS assigned FROM r a LEFT JOIN r b ON b.vec_id = a.vec_id AND b.k = 2
JOIN (SELECT label, quantile_cont(list_distance(embedding::DOUBLE[], centroid), 0.9) AS radius FROM embeddings JOIN p USING (label) GROUP BY label) q ON q.label = a.l WHERE a.k = 1""",
    ("distance", "ambiguity", "radius"),
)
def radius_assignment(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return V.assign_within(v, V.prototypes(v, "label", "embedding"), "vec_id", "label", "embedding")


@query(
    "mahalanobis_own_prototype",
    f"WITH {_PROTO}, e AS (SELECT vec_id, e.label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings e) SELECT vec_id, sqrt(avg((x - m) * (x - m) / greatest(v, 1e-6))) AS distance FROM e JOIN c USING (label, d) GROUP BY vec_id",
    ("distance",),
)
def mahalanobis_own_prototype(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.join(V.prototypes(v, "label", "embedding"), "label").select("vec_id", V.mahalanobis(F.col("embedding"), F.col("centroid"), F.col("variance")).alias("distance"))


@query(
    "conformal_threshold",
    f"WITH {_FITTED}, d AS (SELECT e.label, list_distance(embedding::DOUBLE[], centroid) AS dist FROM embeddings e JOIN p USING (label) WHERE substr(md5(vec_id::VARCHAR), 1, 1) < '4'), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist) AS k, count(*) OVER (PARTITION BY label) AS n FROM d) SELECT label, n, dist AS threshold FROM r WHERE k = least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n)",
    ("threshold",),
)
def conformal_threshold(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    held = V.held_for_calibration("vec_id")
    own = v.filter(held).join(V.prototypes(v.filter(~held), "label", "embedding"), "label").select("label", V.distance(F.col("embedding"), F.col("centroid")).alias("d"))
    return V.conformal_threshold(own, ["label"], "d", 0.1)


@query(
    "knn_distance",
    "WITH d AS (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS k FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT vec_id, avg(d) AS knn FROM d WHERE k <= 5 GROUP BY vec_id",
    ("knn",),
)
def knn_distance(spark, sf_dir):
    return V.knn_distance(_vectors(spark, sf_dir), "vec_id", "label", "embedding", 5)


@query("dtw_distance")
def dtw_distance(spark, sf_dir):
    return V.dtw_to(_vectors(spark, sf_dir), "vec_id", "embedding", [i / 64 for i in range(32)] + [1 - i / 64 for i in range(32)], 6)


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    return V.kmeans(_vectors(spark, sf_dir), "vec_id", "embedding", 8).groupBy("cluster").count()


@query("normal_cdf_tiers", f"SELECT vec_id, {cdf_sql('z')} AS phi FROM (SELECT vec_id, (vec_id % 100 - 50) / 10 AS z FROM embeddings)", ("phi",))
def normal_cdf_tiers(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", S.normal_cdf((F.col("vec_id") % 100 - 50) / 10).alias("phi"))
