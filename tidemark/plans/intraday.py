"""Queries of intraday context, sampling and sequential evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import intraday as D
from ..operators import sampling as P
from ..operators import simulation as X
from ..operators import windows as W
from ..registry import SQL, query
from .inputs import BARS, INTRADAY, TRADES, daily_bars, intraday_bars, table, trades
from .windows import _TR


def _inner(name: str) -> str:
    """The SQL of another query before its doubles are rounded."""
    text = SQL[name]
    return text.split("FROM (", 1)[1][:-1] if text.startswith("SELECT * REPLACE") else text


@query(
    "vwap_conditions",
    f"""WITH v AS ({_inner("vwap_session")}) SELECT symbol, ts, reclaim AS reclaim_long, reject AS reject_short, coalesce(above AND abs(distance_bps) <= 150 AND slope = 'up', FALSE) AS pullback_long, coalesce(NOT above AND abs(distance_bps) <= 150 AND slope = 'down', FALSE) AS pullback_short,
  above AND slope = 'up' AS above_rising, NOT above AND slope = 'down' AS below_falling, NOT above AND extended AS reversion_long, above AND extended AS reversion_short FROM v""",
)
def vwap_conditions(spark, sf_dir):
    return W.vwap(intraday_bars(spark, sf_dir)).select("symbol", "ts", *[v.alias(k) for k, v in D.vwap_conditions().items()])


@query(
    "relative_volume",
    f"""WITH {INTRADAY}, m AS (SELECT *, (hour(ts) * 60 + minute(ts))::INTEGER AS minute FROM ibars), b AS (SELECT symbol, minute, avg(volume) AS baseline FROM m WHERE session < DATE '2024-01-11' GROUP BY ALL)
SELECT m.symbol, m.ts, b.minute AS matched_at, volume / baseline AS rvol FROM (SELECT * FROM m WHERE session >= DATE '2024-01-11') m ASOF LEFT JOIN b ON m.symbol = b.symbol AND m.minute >= b.minute""",
    ("rvol",),
)
def relative_volume(spark, sf_dir):
    bars = intraday_bars(spark, sf_dir)
    return D.relative_volume(bars.filter("session >= DATE'2024-01-11'"), D.volume_baseline(bars.filter("session < DATE'2024-01-11'"))).select("symbol", "ts", "matched_at", "rvol")


@query(
    "last_bars_asof",
    f"""WITH {INTRADAY}, c AS (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) AS closes FROM ibars), e AS (SELECT event_id, event_type AS symbol, ts FROM events WHERE value > 80)
SELECT event_id, list_sum(closes) AS total, closes[1] AS oldest FROM e ASOF JOIN c ON e.symbol = c.symbol AND e.ts >= c.ts WHERE len(closes) = 5""",
    ("total", "oldest"),
)
def last_bars_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value > 80").select("event_id", F.col("event_type").alias("symbol"), "ts")
    out = D.last_bars(e, intraday_bars(spark, sf_dir), ["symbol"], 5)
    return out.select("event_id", F.aggregate("closes", F.lit(0.0), lambda s, x: s + x).alias("total"), F.col("closes")[0].alias("oldest"))


@query(
    "session_calendar",
    """WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL '1 day'))::DATE AS date), r AS (SELECT date, CASE WHEN isodow(date) > 5 THEN 'weekend' WHEN date IN (DATE '2024-01-01', DATE '2024-12-25') THEN 'holiday' END AS closed_because, CASE WHEN date = DATE '2024-11-29' THEN 780 ELSE 960 END AS e FROM d)
SELECT date, closed_because, (CASE WHEN closed_because IS NULL THEN 570 END)::INTEGER AS open_minute, (CASE WHEN closed_because IS NULL THEN e END)::INTEGER AS close_minute, (CASE WHEN closed_because IS NULL THEN e - 30 END)::INTEGER AS last_entry_minute FROM r""",
)
def session_calendar(spark, sf_dir):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-12-31')) AS date")
    return D.session_calendar(days, ["2024-01-01", "2024-12-25"], ["2024-11-29"])


@query(
    "intraday_universe",
    """WITH r AS (SELECT c_name AS symbol, c_acctbal, c_nationkey, c_mktsegment = 'BUILDING' AS manual, CASE WHEN c_acctbal < 0 THEN 'price' WHEN c_nationkey > 15 THEN 'exchange' ELSE '' END AS reason FROM customer), k AS (SELECT *, CASE WHEN reason = '' THEN row_number() OVER (PARTITION BY reason = '' ORDER BY manual DESC, c_acctbal DESC, symbol) END::INTEGER AS rank FROM r)
SELECT symbol, rank, CASE WHEN rank > 40 THEN 'max_symbols' ELSE reason END AS reason FROM k""",
)
def intraday_universe(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("symbol"), "c_custkey", "c_acctbal", "c_nationkey", (F.col("c_mktsegment") == "BUILDING").alias("manual"))
    return D.universe(c, "symbol", "c_custkey", [(F.col("c_acctbal") < 0, "price"), (F.col("c_nationkey") > 15, "exchange")], "c_acctbal", "manual", 40).select("symbol", "rank", "reason")


@query(
    "intraday_risk_checks",
    f"""WITH {TRADES}, s AS (SELECT trade_id, entry_date, qty, price, count(*) OVER (PARTITION BY pattern, entry_date ORDER BY trade_id, qty, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tb,
  count(*) OVER (PARTITION BY pattern, entry_date, symbol ORDER BY trade_id, qty, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb, coalesce(sum(ret) OVER (PARTITION BY pattern, entry_date ORDER BY trade_id, qty, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM trades)
SELECT trade_id, array_to_string(list_filter([CASE WHEN tb >= 5 THEN 'MAX_TRADES' END, CASE WHEN sb >= 1 THEN 'MAX_PER_SYMBOL' END, CASE WHEN pb <= -0.0501 THEN 'MAX_LOSS' END], lambda x: x IS NOT NULL), ',') AS blockers FROM s""",
)
def intraday_risk_checks(spark, sf_dir):
    out = D.risk_checks(trades(spark, sf_dir), ["pattern", "entry_date"], ["trade_id", "qty", "price"], "symbol", "ret", 5, 1, 0.0501)
    return out.select("trade_id", F.array_join("blockers", ",").alias("blockers"))


@query(
    "entry_variants",
    f"""WITH {BARS}, {_TR}, h AS (SELECT *, CASE WHEN count(high) OVER f >= 20 THEN max(high) OVER f END AS ph FROM atr WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
v AS (SELECT symbol, date, 'base_limit' AS variant, close AS entry, atr * 1.5 AS risk FROM h UNION ALL SELECT symbol, date, 'stop_confirmation', high * 1.001, atr * 1.5 FROM h UNION ALL SELECT symbol, date, 'retest_limit', ph, atr * 1.5 FROM h WHERE close > ph)
SELECT symbol, date, variant, entry, entry - risk AS stop, entry + 4 * risk AS target FROM v WHERE risk > 0""",
    ("entry", "stop", "target"),
)
def entry_variants(spark, sf_dir):
    return D.entry_variants(W.swing_indicators(daily_bars(spark, sf_dir)))


@query(
    "failure_classes",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_type LIKE '%error%' THEN 'DATA' END, CASE WHEN event_type LIKE '%click%' THEN 'ENTRY' END, CASE WHEN value < 5 THEN 'LOW_VALUE' END, CASE WHEN user_id % 7 = 0 THEN 'CONCENTRATED' END], lambda x: x IS NOT NULL), ',') AS classes FROM events""",
)
def failure_classes(spark, sf_dir):
    classes = D.failure_classes(F.col("event_type"), [(F.col("value") < 5, "LOW_VALUE"), (F.col("user_id") % 7 == 0, "CONCENTRATED")], {"error": "DATA", "click": "ENTRY"})
    return table(spark, sf_dir, "events").select("event_id", F.array_join(classes, ",").alias("classes"))


@query("position_size", f"WITH {TRADES} SELECT trade_id, entry_date, qty, CASE WHEN price * 0.03 > 0 THEN floor(least(1000000 * 0.005 / (price - price * 0.97), qty * 1000 * 0.01, 1000000 * 0.1 / price)) ELSE 0 END::BIGINT AS shares FROM trades")
def position_size(spark, sf_dir):
    price = F.col("price")
    return trades(spark, sf_dir).select("trade_id", "entry_date", "qty", D.position_size(1_000_000, 0.005, price, price * 0.97, F.col("qty") * 1000, 0.01, 0.1).alias("shares"))


@query(
    "setup_cap",
    "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS k FROM customer) SELECT c_custkey, CASE WHEN k <= 10 THEN 'active' ELSE 'expired' END AS status FROM r",
)
def setup_cap(spark, sf_dir):
    w = W.by("c_nationkey", [F.col("c_acctbal").desc(), F.col("c_custkey").desc()])
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.row_number().over(w) <= 10, "active").otherwise("expired").alias("status"))


@query(
    "window_sampling",
    f"""WITH {BARS}, a AS (SELECT symbol, date, row_number() OVER w AS n, count(close) OVER f AS future, max(high) OVER f / close - 1 AS mfe, min(low) OVER f / close - 1 AS mae, lead(close, 10) OVER w / close - 1 AS horizon_return, lag(date, 19) OVER w AS window_start
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)) SELECT symbol, window_start, date, mfe, mae, horizon_return FROM a WHERE n >= 20 AND (n - 20) % 3 = 0 AND future = 10""",
    ("mfe", "mae", "horizon_return"),
)
def window_sampling(spark, sf_dir):
    return P.windows(daily_bars(spark, sf_dir), 20, 3, 10).select("symbol", "window_start", "date", "mfe", "mae", "horizon_return")


@query(
    "first_touch",
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars), f AS (SELECT a.symbol, a.date, min(CASE WHEN b.low <= a.close * (1 - 0.6) THEN b.k END) AS s, min(CASE WHEN b.high >= a.close * (1 + 0.8) THEN b.k END) AS t FROM n a LEFT JOIN n b ON b.symbol = a.symbol AND b.k BETWEEN a.k + 1 AND a.k + 5 GROUP BY ALL)
SELECT symbol, date, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'stop' WHEN t IS NOT NULL THEN 'target' ELSE 'none' END AS touch FROM f""",
)
def first_touch(spark, sf_dir):
    return P.first_touch(daily_bars(spark, sf_dir), 0.6, 0.8, 5).select("symbol", "date", "touch")


@query(
    "linear_resample",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), i AS (SELECT vec_id, v, unnest(range(8)) AS i FROM e), x AS (SELECT vec_id, v, i * (len(v) - 1) / 7 AS x FROM i)
SELECT vec_id, sum(v[floor(x)::INTEGER + 1] + (v[least(floor(x)::INTEGER + 2, len(v))] - v[floor(x)::INTEGER + 1]) * (x - floor(x))) AS total FROM x GROUP BY vec_id""",
    ("total",),
)
def linear_resample(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(P.resample_linear(v, 8), F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(
    "winsorized_scores",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS l, quantile_cont(value, 0.99) AS h FROM events GROUP BY 1), c AS (SELECT event_id, event_type, least(greatest(value, l), h) AS clipped FROM events JOIN q USING (event_type))
SELECT event_id, clipped, (clipped - avg(clipped) OVER w) / stddev_pop(clipped) OVER w AS z FROM c WINDOW w AS (PARTITION BY event_type)""",
    ("clipped", "z"),
)
def winsorized_scores(spark, sf_dir):
    return P.winsorize(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_id", "clipped", "z")


@query(
    "matched_sample",
    """WITH t AS (SELECT l_partkey % 20 AS s, year(l_shipdate) AS y, l_orderkey, l_linenumber, l_quantity, l_suppkey, l_returnflag AS f FROM lineitem), b AS (SELECT s, y, count(*) AS want FROM t WHERE f = 'R' GROUP BY ALL),
p AS (SELECT t.*, want, row_number() OVER (PARTITION BY s, y ORDER BY l_orderkey, l_linenumber, l_quantity, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s, y) AS n FROM t JOIN b USING (s, y) WHERE f <> 'R'), k AS (SELECT *, least(want, n) AS take FROM p)
SELECT s, y::INTEGER AS y, l_orderkey, l_linenumber FROM k WHERE i IN (SELECT unnest(list_transform(range(take), lambda j: j * n // take)))""",
)
def matched_sample(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("s"), F.year("l_shipdate").alias("y"), "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_returnflag")
    return P.evenly_matched(t.filter("l_returnflag = 'R'"), t.filter("l_returnflag <> 'R'"), ["s", "y"], ["l_orderkey", "l_linenumber", "l_quantity", "l_suppkey"]).select("s", "y", "l_orderkey", "l_linenumber")


@query(
    "cpcv_splits",
    f"""WITH {BARS}, r AS (SELECT date AS s, (date + 7)::DATE AS e, ntile(6) OVER (ORDER BY date, symbol) - 1 AS g FROM bars), sp AS (SELECT g, min(s) AS s, max(e) AS e, count(*) AS n FROM r GROUP BY g),
c AS (SELECT a.g AS a, b.g AS b, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, a.n + b.n AS n_test, row_number() OVER (ORDER BY a.g, b.g) - 1 AS split FROM sp a JOIN sp b ON a.g < b.g)
SELECT split::INTEGER AS split, (SELECT count(*) FROM r WHERE g <> a AND g <> b AND NOT (r.s <= e1 AND r.e >= s1) AND NOT (r.s <= e2 AND r.e >= s2)) AS n_train, n_test FROM c""",
)
def cpcv_splits(spark, sf_dir):
    rows = daily_bars(spark, sf_dir).select("symbol", F.col("date").alias("s"), F.date_add("date", 7).alias("e"))
    return P.cpcv(rows, ["s", "symbol"], "s", "e", 6, 2)


_O = f"{TRADES}, o AS (SELECT pattern, ret, row_number() OVER (PARTITION BY pattern ORDER BY entry_date, trade_id, qty, price) AS n FROM trades)"


@query(
    "mixture_sprt",
    f"""WITH {_O}, c AS (SELECT pattern, n, sum(ret) OVER (PARTITION BY pattern ORDER BY n) AS s FROM o), b AS (SELECT pattern, n, 0.5 * ln(0.0025 / (0.0025 + n * 0.0004)) + 0.0004 * s * s / (2 * 0.0025 * (0.0025 + n * 0.0004)) AS bf FROM c) SELECT pattern, max(bf) AS max_log_bf, arg_max(bf, n) AS last_log_bf FROM b GROUP BY pattern""",
    ("max_log_bf", "last_log_bf"),
)
def mixture_sprt(spark, sf_dir):
    return P.mixture_sprt(trades(spark, sf_dir), ["pattern"], ["entry_date", "trade_id", "qty", "price"], "ret", 0.05, 0.02)


@query("posterior_edge", f"WITH {TRADES}, s AS (SELECT pattern, count(*) AS n, avg(ret) AS m, var_samp(ret) AS v FROM trades GROUP BY pattern) SELECT pattern, n, (n * m / v) / (1 / 0.0001 + n / v) AS posterior_mean, sqrt(1 / (1 / 0.0001 + n / v)) AS posterior_sd FROM s", ("posterior_mean", "posterior_sd"))
def posterior_edge(spark, sf_dir):
    return P.posterior_edge(trades(spark, sf_dir), ["pattern"], "ret", 0.0, 0.01)


@query("alpha_spending", "SELECT o_orderkey, 0.05 * t AS linear, 0.05 * ln(1 + (exp(1) - 1) * t) AS pocock FROM (SELECT o_orderkey, (o_orderkey % 100 + 1) / 100 AS t FROM orders)", ("linear", "pocock"))
def alpha_spending(spark, sf_dir):
    t = (F.col("o_orderkey") % 100 + 1) / 100
    return table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(k) for k, v in P.spend(t).items()])


@query(
    "return_decomposition",
    f"""WITH {BARS}, a AS (SELECT symbol, date, lead(open) OVER w AS e, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5, lead(close, 10) OVER w AS c10 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
l AS (SELECT symbol, date, 1 AS k, c1 / e - 1 AS ret FROM a UNION ALL SELECT symbol, date, 3, c3 / e - 1 FROM a UNION ALL SELECT symbol, date, 5, c5 / e - 1 FROM a UNION ALL SELECT symbol, date, 10, c10 / e - 1 FROM a) SELECT symbol, k::INTEGER AS "offset", count(ret) AS n, avg(ret) AS mean FROM l GROUP BY symbol, k""",
    ("mean",),
)
def return_decomposition(spark, sf_dir):
    return P.segment_returns(daily_bars(spark, sf_dir), [1, 3, 5, 10]).groupBy("symbol", "offset").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"))


@query(
    "vwap_loss_exits",
    f"""WITH v AS ({_inner("vwap_session")}), {INTRADAY}, n AS (SELECT i.*, v.vwap, row_number() OVER (PARTITION BY i.symbol, i.session ORDER BY i.ts) AS n FROM ibars i JOIN v ON v.symbol = i.symbol AND v.ts = i.ts),
x AS (SELECT symbol, session, min(CASE WHEN n = 2 THEN open END) AS entry, arg_min(close, n) FILTER (WHERE n >= 2 AND close < vwap) AS c, arg_max(close, n) AS l FROM n GROUP BY ALL) SELECT symbol, session, coalesce(c, l) / entry - 1 AS ret, CASE WHEN c IS NOT NULL THEN 'vwap_loss' ELSE 'session_end' END AS exit_reason FROM x WHERE entry IS NOT NULL""",
    ("ret",),
)
def vwap_loss_exits(spark, sf_dir):
    return P.vwap_loss_exit(W.vwap(intraday_bars(spark, sf_dir)))


@query(
    "experiment_registry",
    "WITH f AS (SELECT o_orderdate::DATE AS day FROM orders WHERE o_custkey NOT IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R')), d AS (SELECT day, count(*) AS new FROM f GROUP BY day) SELECT day, new, sum(new) OVER (ORDER BY day)::BIGINT AS cumulative FROM d",
)
def experiment_registry(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("o_custkey"))
    return P.running_registry(table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), known, "o_custkey", "day")


@query(
    "reward_risk_levels",
    f"""WITH t AS ({_inner("triple_barrier")}), l AS (SELECT *, unnest([0.5, 1.0, 2.0])::DOUBLE AS rr FROM t) SELECT rr, count(*) AS n, count(*) FILTER (WHERE outcome = 'skip_gap') AS skipped, count(*) FILTER (WHERE outcome <> 'skip_gap' AND mfe >= rr) AS hits, avg(CASE WHEN mfe >= rr THEN rr ELSE least(r, rr) END) FILTER (WHERE outcome <> 'skip_gap') AS edge FROM l GROUP BY rr""",
    ("edge",),
)
def reward_risk_levels(spark, sf_dir):
    path = X.forward_path(daily_bars(spark, sf_dir), 5)
    t = X.triple_barrier(path, "path", F.col("close") * 0.8, F.col("close") * 1.5, 5).withColumn("rr", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    traded, hit = F.col("outcome") != "skip_gap", F.col("mfe") >= F.col("rr")
    edge = F.avg(F.when(traded, F.when(hit, F.col("rr")).otherwise(F.least("r", "rr")))).alias("edge")
    return t.groupBy("rr").agg(F.count("*").alias("n"), F.count_if(~traded).alias("skipped"), F.count_if(traded & hit).alias("hits"), edge)


@query(
    "invariance_buckets",
    f"WITH {TRADES}, t AS (SELECT ret, year(exit_date)::VARCHAR AS yr, symbol, CASE WHEN qty < 25 THEN 'thin' ELSE 'deep' END AS liquidity, CASE WHEN adv >= 10e6 THEN 'large' WHEN adv >= 1e6 THEN 'mid' ELSE 'small' END AS tier FROM trades) SELECT coalesce(yr, symbol, liquidity, tier) AS bucket, grouping(yr, symbol, liquidity, tier)::BIGINT AS kind, count(*) AS n, avg(ret) AS mean, avg((ret > 0)::INTEGER) AS positive FROM t GROUP BY GROUPING SETS ((yr), (symbol), (liquidity), (tier))",
    ("mean", "positive"),
)
def invariance_buckets(spark, sf_dir):
    t = trades(spark, sf_dir).select("ret", F.year("exit_date").cast("string").alias("yr"), "symbol", F.when(F.col("qty") < 25, "thin").otherwise("deep").alias("liquidity"), G.ladder([(F.col("adv") >= 10e6, "large"), (F.col("adv") >= 1e6, "mid")], "small").alias("tier"))
    keys = ["yr", "symbol", "liquidity", "tier"]
    out = t.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().cast("long").alias("kind"), F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"))
    return out.select(F.coalesce(*keys).alias("bucket"), "kind", "n", "mean", "positive")


@query("product_classes", "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'FUND' WHEN p_type = 'ECONOMY' THEN 'WARRANT' WHEN p_name LIKE 'small%' THEN 'ETF' ELSE 'STK' END AS product_class FROM part")
def product_classes(spark, sf_dir):
    rules = [(F.col("p_name").contains("ring"), "FUND"), (F.col("p_type") == "ECONOMY", "WARRANT"), (F.col("p_name").startswith("small"), "ETF")]
    return table(spark, sf_dir, "part").select("p_partkey", G.ladder(rules, "STK").alias("product_class"))


@query(
    "implementation_shortfall",
    f"WITH {TRADES}, s AS (SELECT symbol, CASE WHEN qty > 10 THEN abs(ret) * 10000 END AS bps, ret FROM trades) SELECT symbol, count(*) AS n, count(bps) AS covered, quantile_cont(bps, 0.5) AS median_bps, avg(bps) AS mean_bps, quantile_cont(bps, 0.75) AS p75_bps, max(bps) AS worst_bps, avg(ret - bps / 10000) FILTER (WHERE bps IS NOT NULL) AS adjusted FROM s GROUP BY symbol",
    ("median_bps", "mean_bps", "p75_bps", "worst_bps", "adjusted"),
)
def implementation_shortfall(spark, sf_dir):
    s = trades(spark, sf_dir).select("symbol", "ret", F.when(F.col("qty") > 10, F.abs("ret") * 10_000).alias("bps"))
    q = lambda p: F.percentile("bps", F.lit(p))
    return s.groupBy("symbol").agg(F.count("*").alias("n"), F.count("bps").alias("covered"), q(0.5).alias("median_bps"), F.avg("bps").alias("mean_bps"), q(0.75).alias("p75_bps"), F.max("bps").alias("worst_bps"), F.avg(F.col("ret") - F.col("bps") / 10_000).alias("adjusted"))


@query("reason_histogram", "WITH r AS (SELECT unnest(string_split(blockers, ',')) AS reason FROM (" + _inner("promotion_gate") + ") UNION ALL SELECT event_type FROM events WHERE value < 1) SELECT reason, count(*) AS n FROM r WHERE reason <> '' GROUP BY reason")
def reason_histogram(spark, sf_dir):
    from .aggregates import promotion_gate

    gates = promotion_gate(spark, sf_dir).select(F.explode(F.split("blockers", ",")).alias("reason"))
    events = table(spark, sf_dir, "events").filter("value < 1").select(F.col("event_type").alias("reason"))
    return gates.unionByName(events).filter("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))
