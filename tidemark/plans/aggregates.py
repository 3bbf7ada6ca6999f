"""Queries of aggregates, rankings, quality reports and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import gates as G
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import windows as W
from ..registry import query
from .inputs import BARS, INTRADAY, TRADES, daily_bars, intraday_bars, table, trades

def _ret():
    return F.col("ret")

_GAIN, _LOSS = "coalesce(sum(ret) FILTER (WHERE ret > 0), 0)", "coalesce(sum(-ret) FILTER (WHERE ret < 0), 0)"


@query("trade_metrics", f"WITH {TRADES} SELECT pattern, count(*) AS n, count(DISTINCT symbol) AS symbols, avg(ret) AS expectancy, CASE WHEN {_LOSS} > 0 THEN {_GAIN} / {_LOSS} END AS profit_factor, avg((ret > 0)::INTEGER) AS winrate, avg(ret) FILTER (WHERE ret > 0) AS avg_win, avg(ret) FILTER (WHERE ret < 0) AS avg_loss FROM trades GROUP BY pattern", ("expectancy", "profit_factor", "winrate", "avg_win", "avg_loss"))
def trade_metrics(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("pattern").agg(*A.trade_metrics(_ret(), F.col("symbol")))


@query(
    "profit_factor_conventions",
    f"""WITH {TRADES}, g AS (SELECT symbol, exit_date, {_GAIN} AS g, {_LOSS} AS l, coalesce(sum(ret * qty) FILTER (WHERE ret > 0), 0) AS wg, coalesce(sum(-ret * qty) FILTER (WHERE ret < 0), 0) AS wl FROM trades GROUP BY ALL)
SELECT symbol, exit_date, CASE WHEN l > 0 THEN g / l END AS pf_null, CASE WHEN l > 0 THEN g / l ELSE g END AS pf_gross, l = 0 AND g > 0 AS pf_infinite, CASE WHEN wl > 0 THEN wg / wl END AS pf_weighted FROM g""",
    ("pf_null", "pf_gross", "pf_weighted"),
)
def profit_factor_conventions(spark, sf_dir):
    out = trades(spark, sf_dir).groupBy("symbol", "exit_date").agg(A.profit_factor(_ret()).alias("pf_null"), A.profit_factor(_ret(), "gross").alias("pf_gross"), A.profit_factor(_ret(), "inf").alias("i"), A.profit_factor(_ret(), weight=F.col("qty")).alias("pf_weighted"))
    return out.withColumn("pf_infinite", F.coalesce(F.col("i") == float("inf"), F.lit(False))).drop("i")


@query(
    "period_rollups",
    f"""WITH {TRADES}, t AS (SELECT *, year(exit_date)::VARCHAR AS y, year(exit_date) || 'Q' || quarter(exit_date) AS q FROM trades)
SELECT CASE WHEN grouping(symbol) = 0 THEN 'symbol' WHEN grouping(y) = 0 THEN 'y' ELSE 'q' END AS kind, coalesce(symbol, y, q) AS key, count(*) AS n, avg(ret) AS mean, sum(ret) AS total FROM t GROUP BY GROUPING SETS ((symbol), (y), (q))""",
    ("mean", "total"),
)
def period_rollups(spark, sf_dir):
    t = trades(spark, sf_dir).withColumns({"y": F.year("exit_date").cast("string"), "q": F.concat(F.year("exit_date").cast("string"), F.lit("Q"), F.quarter("exit_date").cast("string"))})
    return A.rollups(t, ["symbol", "y", "q"], [F.count("*").alias("n"), F.avg("ret").alias("mean"), F.sum("ret").alias("total")])


@query("distribution_summary", f"WITH {TRADES} SELECT pattern, min(price) AS min, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS p75, max(price) AS max FROM trades GROUP BY pattern", ("min", "p25", "median", "p75", "max"))
def distribution_summary(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("pattern").agg(*A.distribution(F.col("price")))


@query("threshold_counts", f"WITH {BARS}, g AS (SELECT symbol, abs(open / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) AS g FROM bars) SELECT symbol, count(*) FILTER (WHERE g >= 0.01) AS ge1, count(*) FILTER (WHERE g >= 0.05) AS ge5, count(*) FILTER (WHERE g >= 0.25) AS ge25, count(*) FILTER (WHERE g < 0.002) AS non_gap FROM g GROUP BY symbol")
def threshold_counts(spark, sf_dir):
    g = daily_bars(spark, sf_dir).withColumn("g", F.abs(F.col("open") / F.lag("close").over(W.by()) - 1))
    return g.groupBy("symbol").agg(F.count_if(F.col("g") >= 0.01).alias("ge1"), F.count_if(F.col("g") >= 0.05).alias("ge5"), F.count_if(F.col("g") >= 0.25).alias("ge25"), F.count_if(F.col("g") < 0.002).alias("non_gap"))


_CONTRIB = f"""WITH {TRADES}, s AS (SELECT symbol, sum(ret) AS total, count(*) AS n FROM trades GROUP BY symbol), c AS (SELECT *, row_number() OVER (ORDER BY abs(round(total, 9)) DESC, symbol)::INTEGER AS rank FROM s)"""


@query("top_contributions", f"{_CONTRIB} SELECT * FROM c WHERE rank <= 5", ("total",))
def top_contributions(spark, sf_dir):
    return A.contributions(trades(spark, sf_dir), "symbol", "ret").filter("rank <= 5")


@query("concentration_share", f"{_CONTRIB} SELECT sum(abs(total)) FILTER (WHERE rank <= 3) / sum(abs(total)) AS top_share FROM c", ("top_share",))
def concentration_share(spark, sf_dir):
    return A.top_share(trades(spark, sf_dir), "symbol", "ret", 3)


@query("leave_top_symbols_out", f"{_CONTRIB} SELECT sum(total) / sum(n) AS mean, sum(n)::BIGINT AS n FROM c WHERE rank > 3", ("mean",))
def leave_top_symbols_out(spark, sf_dir):
    return A.without_top(trades(spark, sf_dir), "symbol", "ret", 3)


@query("leave_top_events_out", f"WITH {TRADES}, r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY abs(ret) DESC, trade_id, entry_date, qty, price) AS k FROM trades) SELECT pattern, avg(ret) AS mean, count(*) AS n FROM r WHERE k > 5 GROUP BY pattern", ("mean",))
def leave_top_events_out(spark, sf_dir):
    return A.without_top_rows(trades(spark, sf_dir), "pattern", "ret", [F.abs("ret").desc(), "trade_id", "entry_date", "qty", "price"], 5)


@query(
    "cluster_herfindahl",
    f"WITH {TRADES}, c AS (SELECT pattern, symbol, count(*) AS n FROM trades GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY pattern) AS share FROM c) SELECT pattern, sum(share * share) AS hhi, max(share) AS max_share, arg_max(symbol, (n, symbol)) AS largest FROM s GROUP BY pattern",
    ("hhi", "max_share"),
)
def cluster_herfindahl(spark, sf_dir):
    return A.herfindahl(trades(spark, sf_dir), "pattern", "symbol")


@query("effective_sample", f"WITH {TRADES}, c AS (SELECT count(*) AS c FROM trades GROUP BY symbol, entry_date) SELECT sum(c)::BIGINT AS n, count(*)::DOUBLE AS n_eff, count(*) * count(*) / sum(1.0::DOUBLE / c) AS kish FROM c", ("n_eff", "kish"))
def effective_sample(spark, sf_dir):
    return A.effective_sample(trades(spark, sf_dir), ["symbol", "entry_date"])


@query(
    "calibration_error",
    """WITH p AS (SELECT (l_quantity - 1) / 49 AS p, (l_returnflag = 'N')::INTEGER AS y FROM lineitem), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS obs, sum((p - y) * (p - y)) AS sq FROM p GROUP BY 1)
SELECT sum(n * abs(conf - obs)) / sum(n) AS ece, sum(sq) / sum(n) AS brier, sum(n)::BIGINT AS n FROM b""",
    ("ece", "brier"),
)
def calibration_error(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 1) / 49).alias("p"), (F.col("l_returnflag") == "N").cast("int").alias("y"))
    return A.calibration(t, "p", "y")


@query("missingness", "SELECT 'lang' AS column_name, count(*) FILTER (WHERE o_orderstatus IS NULL) AS nulls, count(DISTINCT o_orderstatus) AS distincts FROM orders UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS NULL), count(DISTINCT o_orderpriority) FROM orders".replace("'lang'", "'o_orderstatus'"))
def missingness(spark, sf_dir):
    return A.missingness(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "feature_summary",
    "WITH l AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE v) SELECT feature, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, count(v) AS n FROM l GROUP BY feature",
    ("mean", "median", "p25", "p75"),
)
def feature_summary(spark, sf_dir):
    return A.feature_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("bucket_summary", "WITH b(bucket) AS (VALUES ('view'), ('click'), ('halt')), c AS (SELECT event_type AS bucket, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1) SELECT bucket, mean, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)", ("mean",))
def bucket_summary(spark, sf_dir):
    required = spark.createDataFrame([("view",), ("click",), ("halt",)], "bucket string")
    return A.bucket_table(table(spark, sf_dir, "events").withColumnRenamed("event_type", "bucket"), required, "bucket", [F.avg("value").alias("mean")])


@query(
    "pattern_outcomes_full_outer",
    """WITH s AS (SELECT o_custkey % 200 AS pattern, count(*) AS signals FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), t AS (SELECT l_suppkey % 300 AS pattern, count(*) AS trades, sum(l_discount) AS total FROM lineitem GROUP BY 1)
SELECT coalesce(s.pattern, t.pattern) AS pattern, coalesce(signals, 0) AS signals, coalesce(trades, 0) AS trades, total FROM s FULL JOIN t ON s.pattern = t.pattern""",
    ("total",),
)
def pattern_outcomes_full_outer(spark, sf_dir):
    s = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy((F.col("o_custkey") % 200).alias("pattern")).agg(F.count("*").alias("signals"))
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 300).alias("pattern")).agg(F.count("*").alias("trades"), F.sum("l_discount").alias("total"))
    return s.join(t, "pattern", "full").fillna(0, ["signals", "trades"])


@query("window_expectancy", f"WITH {TRADES} SELECT pattern, avg(ret) AS mean, count(*) AS n FROM trades WHERE exit_date >= (SELECT max(exit_date) FROM trades) - 365 GROUP BY pattern", ("mean",))
def window_expectancy(spark, sf_dir):
    t = trades(spark, sf_dir)
    last = t.agg(F.max("exit_date")).first()[0]
    return t.filter(F.col("exit_date") >= F.date_sub(F.lit(last), 365)).groupBy("pattern").agg(F.avg("ret").alias("mean"), F.count("*").alias("n"))


@query("cost_recalibration", f"WITH {TRADES}, b AS (SELECT CASE WHEN adv >= 50e6 THEN 'mega' WHEN adv >= 10e6 THEN 'large' WHEN adv >= 1e6 THEN 'mid' ELSE 'small' END AS bucket, abs(ret) * 10000 AS bps FROM trades) SELECT bucket, count(*) AS n, CASE WHEN count(*) >= 30 THEN greatest(quantile_cont(bps, 0.75), 8.0) END AS cost_bps FROM b GROUP BY bucket", ("cost_bps",))
def cost_recalibration(spark, sf_dir):
    t = trades(spark, sf_dir).select(S.adv_bucket(F.col("adv")).alias("bucket"), (F.abs("ret") * 10_000).alias("bps"))
    return t.groupBy("bucket").agg(F.count("*").alias("n"), F.when(F.count("*") >= 30, F.greatest(F.percentile("bps", F.lit(0.75)), F.lit(8.0))).alias("cost_bps"))


@query("universe_metrics", f"WITH {INTRADAY} SELECT symbol, quantile_cont(close, 0.5) AS median_close, avg((volume = 0)::INTEGER) AS zero_volume, quantile_cont(high - low, 0.9) AS p90_range, count(DISTINCT session) AS sessions FROM ibars GROUP BY symbol", ("median_close", "zero_volume", "p90_range"))
def universe_metrics(spark, sf_dir):
    return intraday_bars(spark, sf_dir).groupBy("symbol").agg(F.percentile("close", F.lit(0.5)).alias("median_close"), F.avg((F.col("volume") == 0).cast("double")).alias("zero_volume"), F.percentile(F.col("high") - F.col("low"), F.lit(0.9)).alias("p90_range"), F.countDistinct("session").alias("sessions"))


@query("max_two_per_day", f"WITH {BARS}, r AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY symbol) AS k FROM bars) SELECT symbol, date FROM r WHERE k <= 2")
def max_two_per_day(spark, sf_dir):
    return R.max_per_day(daily_bars(spark, sf_dir), "date", "symbol", 2).select("symbol", "date")


@query("dedup_keep_last", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id FROM r WHERE k = 1")
def dedup_keep_last(spark, sf_dir):
    return R.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@query("dedup_drop_all_copies", "SELECT l_partkey, l_suppkey, any_value(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) = 1")
def dedup_drop_all_copies(spark, sf_dir):
    return R.drop_all_copies(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"])


@query("duplicate_marking", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) > 1 THEN 'duplicate' END AS reject_reason FROM orders")
def duplicate_marking(spark, sf_dir):
    return R.mark_duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"], [F.col("o_orderkey")]).select("o_orderkey", "reject_reason")


@query(
    "bucket_capped_top_k",
    "WITH r AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS b FROM customer) SELECT c_custkey, c_nationkey, c_acctbal FROM r ORDER BY (b > 3)::INTEGER, c_acctbal DESC, c_custkey LIMIT 100",
)
def bucket_capped_top_k(spark, sf_dir):
    return R.capped_top_k(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey", 100, 0.03)


@query("systematic_control", "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE i % greatest(1, n // 50) = 0")
def systematic_control(spark, sf_dir):
    return R.systematic(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderpriority"], 50).drop("o_orderdate")


@query(
    "bar_violations",
    f"""WITH {BARS} SELECT symbol, date, array_to_string(list_filter([CASE WHEN least(open, high, low, close) <= 0 THEN 'NONPOSITIVE_PRICE' END, CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END, CASE WHEN high < low THEN 'HIGH_BELOW_LOW' END,
  CASE WHEN high < greatest(open, close) THEN 'HIGH_BELOW_BODY' END, CASE WHEN low > least(open, close) THEN 'LOW_ABOVE_BODY' END], lambda x: x IS NOT NULL), ',') AS violations FROM (SELECT symbol, date, open, high - 50000 AS high, low, close, volume - 1010 AS volume FROM bars)""",
)
def bar_violations(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).withColumns({"high": F.col("high") - 50000, "volume": F.col("volume") - 1010})
    return Q.check(bars).select("symbol", "date", F.array_join("violations", ",").alias("violations"))


@query(
    "bar_quality_report",
    f"""WITH {BARS}, s AS (SELECT symbol, close / lag(close) OVER w AS r, lag(date) OVER w AS p, date, volume, row_number() OVER w - row_number() OVER (PARTITION BY symbol, close ORDER BY date) AS island, close FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(len(list_filter(generate_series(p::TIMESTAMP, (date - 1)::TIMESTAMP, INTERVAL '1 day'), lambda d: isodow(d) < 6)) - 1, 0) END AS gap FROM s),
i AS (SELECT symbol, max(c) AS longest_run FROM (SELECT symbol, close, island, count(*) AS c FROM s GROUP BY ALL) GROUP BY symbol)
SELECT symbol, count(*) AS bars, avg((volume = 0)::INTEGER) AS zero_volume, max(gap)::INTEGER AS max_gap, max(greatest(r, 1 / r)) AS max_ratio, any_value(longest_run) AS longest_run,
  array_to_string(list_filter([CASE WHEN count(*) < 60 THEN 'TOO_SHORT' END, CASE WHEN avg((volume = 0)::INTEGER) > 0.15 THEN 'ZERO_VOLUME' END, CASE WHEN any_value(longest_run) > 8 THEN 'STALE' END, CASE WHEN max(gap) > 5 THEN 'GAP' END, CASE WHEN max(greatest(r, 1 / r)) > 4 THEN 'JUMP' END], lambda x: x IS NOT NULL), ',') AS issues
FROM g JOIN i USING (symbol) GROUP BY symbol""",
    ("zero_volume", "max_ratio"),
)
def bar_quality_report(spark, sf_dir):
    return Q.report(daily_bars(spark, sf_dir)).withColumn("issues", F.array_join("issues", ","))


@query(
    "split_detector",
    f"""WITH {BARS}, a AS (SELECT symbol, date, volume, abs(open / lag(close) OVER w - 1) AS jump, CASE WHEN count(volume) OVER f >= 5 THEN quantile_cont(volume, 0.5) OVER f END AS typical_volume FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date), f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT symbol, date, jump, typical_volume FROM a WHERE jump > 0.35 AND volume <= 3 * typical_volume""",
    ("jump", "typical_volume"),
)
def split_detector(spark, sf_dir):
    return Q.splits(daily_bars(spark, sf_dir)).select("symbol", "date", "jump", "typical_volume")


@query("cadence_gaps", f"WITH {INTRADAY}, g AS (SELECT symbol, session, ts - lag(ts) OVER (PARTITION BY symbol, session ORDER BY ts) > INTERVAL '450 seconds' AS gap FROM ibars) SELECT symbol, session, count(*) FILTER (WHERE gap) AS gaps FROM g GROUP BY ALL")
def cadence_gaps(spark, sf_dir):
    return Q.gap_count(intraday_bars(spark, sf_dir), ["symbol", "session"], "ts", 300)


@query("complete_bars", f"WITH {INTRADAY} SELECT symbol, ts FROM ibars WHERE ts + INTERVAL '5 minutes' <= TIMESTAMP '2024-01-15 12:00:00'")
def complete_bars(spark, sf_dir):
    return Q.complete(intraday_bars(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00")), 5).select("symbol", "ts")


@query(
    "overlap_consistency",
    f"""WITH {BARS}, t AS (SELECT symbol, date, open, close * (1 + CASE WHEN symbol = 'S1' THEN 0.001 ELSE 0 END) AS close FROM bars), d AS (SELECT symbol, date, greatest(abs(a.open - t.open) / greatest(abs(a.open), 1e-9), abs(a.close - t.close) / greatest(abs(a.close), 1e-9)) AS d FROM bars a JOIN t USING (symbol, date)),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM d) SELECT symbol, count(*) AS common, max(d) AS worst, max(d) <= 1e-4 AS matches FROM r WHERE k <= 5 GROUP BY symbol""",
    ("worst",),
)
def overlap_consistency(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    tail = bars.withColumn("close", F.col("close") * (1 + F.when(F.col("symbol") == "S1", 0.001).otherwise(0)))
    return Q.overlap_matches(bars, tail, ["symbol"], "date", 5)


@query(
    "promotion_gate",
    f"""WITH {TRADES}, m AS (SELECT pattern, count(*) AS n, count(DISTINCT (symbol, entry_date)) AS n_eff, count(DISTINCT symbol) AS symbols, CASE WHEN {_LOSS} > 0 THEN {_GAIN} / {_LOSS} END AS pf, avg(ret) AS e FROM trades GROUP BY pattern),
d AS (SELECT pattern, exit_date, sum(ret) AS pnl FROM trades GROUP BY ALL), q AS (SELECT *, sum(pnl) OVER (PARTITION BY pattern ORDER BY exit_date) AS eq FROM d), k AS (SELECT pattern, eq - greatest(max(eq) OVER (PARTITION BY pattern ORDER BY exit_date), 0) AS dd FROM q), x AS (SELECT pattern, min(dd) AS dd FROM k GROUP BY pattern)
SELECT pattern, array_to_string(list_filter([CASE WHEN n < 100 THEN 'SAMPLE_TOO_SMALL' END, CASE WHEN n_eff < 60 THEN 'EFFECTIVE_SAMPLE_TOO_SMALL' END, CASE WHEN symbols < 8 THEN 'TOO_FEW_SYMBOLS' END, CASE WHEN coalesce(pf, 0) < 1.8 THEN 'PROFIT_FACTOR_LOW' END, CASE WHEN e < 0.25 THEN 'EXPECTANCY_LOW' END, CASE WHEN -dd > 12 THEN 'DRAWDOWN_TOO_LARGE' END], lambda x: x IS NOT NULL), ',') AS blockers
FROM m JOIN x USING (pattern)""",
)
def promotion_gate(spark, sf_dir):
    t = trades(spark, sf_dir)
    m = t.groupBy("pattern").agg(*A.trade_metrics(_ret(), F.col("symbol")), F.countDistinct("symbol", "entry_date").alias("n_eff"))
    dd = W.equity_curve(t).groupBy("pattern").agg(F.min("drawdown").alias("drawdown"))
    return m.join(dd, "pattern").select("pattern", F.array_join(G.promotion_blockers(), ",").alias("blockers"))


@query("round_trip_cost", f"WITH {TRADES} SELECT trade_id, entry_date, 2 * ((CASE WHEN adv >= 50e6 THEN 3.0 WHEN adv >= 10e6 THEN 8.0 WHEN adv >= 1e6 THEN 20.0 ELSE 45.0 END) + 10 * 0.01 * 100 + 0.5) / 10000 * price / (price * 0.02) AS cost_r FROM trades", ("cost_r",))
def round_trip_cost(spark, sf_dir):
    return trades(spark, sf_dir).select("trade_id", "entry_date", S.round_trip_cost_r(F.col("price"), F.col("price") * 0.02, F.col("adv")).alias("cost_r"))


@query("session_buckets", "SELECT event_id, CASE WHEN m < 570 THEN 'premarket' WHEN m < 600 THEN 'open' WHEN m >= 960 THEN 'after_hours' WHEN m >= 900 THEN 'power_hour' ELSE 'midday' END AS bucket, CASE WHEN m < 570 OR m >= 960 THEN 'out_of_session' WHEN m < 630 THEN 'open' WHEN m >= 900 THEN 'close' ELSE 'mid' END AS vwap_bucket FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events)")
def session_buckets(spark, sf_dir):
    m = S.day_minute(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", S.session_bucket(m).alias("bucket"), S.vwap_session_bucket(m).alias("vwap_bucket"))


@query("work_fingerprint", "SELECT o_orderkey, sha256(o_custkey::VARCHAR || '|' || o_orderpriority || '|' || o_orderstatus) AS fingerprint FROM orders")
def work_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.fingerprint(F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("fingerprint"))


@query("json_first_positive", "SELECT event_id, coalesce(CASE WHEN (props->>'$.k')::DOUBLE > 0 THEN (props->>'$.k')::DOUBLE END, CASE WHEN (props->>'$.n')::DOUBLE > 0 THEN (props->>'$.n')::DOUBLE END) AS adv FROM events")
def json_first_positive(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.first_positive(F.col("props"), ["$.k", "$.n"]).alias("adv"))


@query("queue_metrics", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS lane, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def queue_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("lane"), "n")
