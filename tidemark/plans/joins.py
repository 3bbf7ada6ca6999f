"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import windows as W
from ..registry import query
from .inputs import BARS, BENCHMARK, TRADES, daily_bars, table, trades
from .windows import _REGIME


@query("asof_regime", f"{_REGIME} SELECT t.trade_id, r.date AS matched_at, r.trend || '_' || r.vol_regime AS regime_key FROM (WITH {TRADES} SELECT * FROM trades) t ASOF LEFT JOIN (SELECT * FROM reg WHERE symbol = '{BENCHMARK}') r ON t.entry_date >= r.date")
def asof_regime(spark, sf_dir):
    regimes = W.regime_table(daily_bars(spark, sf_dir).filter(F.col("symbol") == BENCHMARK)).select(F.lit(0).alias("all"), F.col("date").alias("entry_date"), "regime_key")
    left = trades(spark, sf_dir).select("trade_id", "entry_date", F.lit(0).alias("all"))
    return J.asof_small(left, regimes, "entry_date", ["regime_key"]).select("trade_id", "matched_at", "regime_key")


@query("asof_last_purchase", "SELECT e.event_id, p.ts AS matched_at, p.value FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts", ("value",))
def asof_last_purchase(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return J.asof(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["value"]).select("event_id", "matched_at", "value")


@query(
    "asof_nearest",
    """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
b AS (SELECT e.*, p.ts AS bt, p.value AS bv FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts), a AS (SELECT b.*, p.ts AS at_, p.value AS av FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.ts <= p.ts)
SELECT event_id, CASE WHEN bt IS NULL OR at_ - ts < ts - bt THEN at_ ELSE bt END AS matched_at, CASE WHEN bt IS NULL OR at_ - ts < ts - bt THEN av ELSE bv END AS value FROM a""",
    ("value",),
)
def asof_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return J.nearest(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "value").select("event_id", "matched_at", "value")


@query(
    "range_join_paths",
    f"""WITH {BARS}, e AS (SELECT o_orderkey AS event_id, 'S' || (o_custkey % 5) AS symbol, o_orderdate::DATE AS s, (o_orderdate::DATE + 10)::DATE AS t FROM orders)
SELECT event_id, count(*) AS bars, max(high) AS max_high, min(low) AS min_low FROM e JOIN bars b ON b.symbol = e.symbol AND b.date BETWEEN s AND t GROUP BY event_id""",
    ("max_high", "min_low"),
)
def range_join_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("event_id"), F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), 10).alias("t"))
    return J.range_join(e, daily_bars(spark, sf_dir), ["symbol"], "s", "t", "date").groupBy("event_id").agg(F.count("*").alias("bars"), F.max("high").alias("max_high"), F.min("low").alias("min_low"))


@query(
    "label_concurrency",
    f"""WITH {TRADES}, d AS (SELECT trade_id, symbol, unnest(generate_series(entry_date::TIMESTAMP, exit_date::TIMESTAMP, INTERVAL '1 day'))::DATE AS day FROM trades), c AS (SELECT symbol, day, count(*) AS c FROM d GROUP BY ALL)
SELECT trade_id, avg(1.0::DOUBLE / c) AS uniqueness FROM d JOIN c USING (symbol, day) GROUP BY trade_id""",
    ("uniqueness",),
    10,
)
def label_concurrency(spark, sf_dir):
    return J.concurrency(trades(spark, sf_dir), "trade_id", ["symbol"], "entry_date", "exit_date")


@query(
    "non_overlapping_trades",
    f"""WITH RECURSIVE {TRADES}, o AS (SELECT l.*, row_number() OVER (PARTITION BY symbol ORDER BY entry_date, exit_date, trade_id) AS i FROM trades l),
r AS (SELECT symbol, trade_id, entry_date, exit_date, i, TRUE AS taken, exit_date AS last FROM o WHERE i = 1
  UNION ALL SELECT o.symbol, o.trade_id, o.entry_date, o.exit_date, o.i, o.entry_date > r.last, CASE WHEN o.entry_date > r.last THEN o.exit_date ELSE r.last END FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1)
SELECT symbol, entry_date, exit_date, trade_id FROM r WHERE taken""",
)
def non_overlapping_trades(spark, sf_dir):
    return J.non_overlapping(trades(spark, sf_dir), ["symbol"], "entry_date", "exit_date", "trade_id")


@query(
    "overlap_clusters",
    f"""WITH {TRADES}, a AS (SELECT *, coalesce(entry_date <= max(exit_date) OVER (PARTITION BY symbol ORDER BY entry_date, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS is_overlap FROM trades)
SELECT trade_id, is_overlap, sum(CASE WHEN is_overlap THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY entry_date, trade_id)::BIGINT AS cluster FROM a""",
)
def overlap_clusters(spark, sf_dir):
    return J.overlap_clusters(trades(spark, sf_dir), ["symbol"], "entry_date", "exit_date", "trade_id").select("trade_id", "is_overlap", "cluster")


@query(
    "cyclic_baseline_pairs",
    """WITH r AS (SELECT o_orderpriority AS bucket, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT o_orderpriority AS bucket, o_orderkey AS matched, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS slot, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_orderstatus = 'P')
SELECT r.bucket, r.k, p.matched FROM r LEFT JOIN p ON p.bucket = r.bucket AND p.slot = r.i % p.n""",
)
def cyclic_baseline_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("bucket"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    return J.cyclic_pairs(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "bucket", "k")


@query(
    "stratified_null_edge",
    f"""WITH {TRADES}, c AS (SELECT symbol, count(*) AS n, sum(ret) AS s FROM trades WHERE pattern = 'NO' GROUP BY symbol), m AS (SELECT symbol, avg(ret) AS m FROM trades WHERE pattern <> 'NO' GROUP BY symbol),
t AS (SELECT sum(n)::BIGINT AS n, sum(s) AS s, sum(n * m) AS e, count(*) FILTER (WHERE m IS NULL) AS missing FROM c LEFT JOIN m USING (symbol)) SELECT n, missing, CASE WHEN missing = 0 THEN s / n - e / n END AS edge FROM t""",
    ("edge",),
)
def stratified_null_edge(spark, sf_dir):
    t = trades(spark, sf_dir)
    return J.stratified_null(t.filter("pattern = 'NO'"), t.filter("pattern <> 'NO'"), "symbol", "ret")


@query(
    "fill_trade_match",
    """WITH f AS (SELECT event_id, user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'), t AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders),
e AS (SELECT event_id, any_value(o_orderkey) AS exact FROM f JOIN t ON o_orderkey = event_id * 4 GROUP BY event_id HAVING count(*) = 1),
s AS (SELECT event_id, any_value(o_orderkey) AS only_open FROM f JOIN (SELECT * FROM t WHERE o_orderstatus = 'O') t ON o_custkey = user_id GROUP BY event_id HAVING count(*) = 1)
SELECT f.event_id, coalesce(exact, only_open) AS trade, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN only_open IS NOT NULL THEN 'single_open' ELSE 'unmatched' END AS how FROM f LEFT JOIN e USING (event_id) LEFT JOIN s USING (event_id)""",
)
def fill_trade_match(spark, sf_dir):
    f = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "user_id")
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    exact = J.unique_match(f, t, "event_id", "o_orderkey", [F.col("o_orderkey") == F.col("event_id") * 4], "exact")
    single = J.unique_match(f, t.filter("o_orderstatus = 'O'"), "event_id", "o_orderkey", [F.col("o_custkey") == F.col("user_id")], "only_open")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("only_open").isNotNull(), "single_open").otherwise("unmatched")
    return f.join(exact, "event_id", "left").join(single, "event_id", "left").select("event_id", F.coalesce("exact", "only_open").alias("trade"), how.alias("how"))


@query(
    "history_levels",
    """SELECT coalesce(l_returnflag, '*') AS l_returnflag, coalesce(l_linestatus, '*') AS l_linestatus, coalesce(brand, '*') AS brand, count(*) AS n, avg(l_discount - l_tax) AS mean, grouping(l_returnflag, l_linestatus, brand)::BIGINT AS level
FROM (SELECT *, 'B' || (l_suppkey % 5) AS brand FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, brand), (l_returnflag, l_linestatus), (l_returnflag, brand), (l_returnflag), (brand), ())""",
    ("mean",),
)
def history_levels(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumns({"brand": F.concat(F.lit("B"), (F.col("l_suppkey") % 5).cast("string")), "r": F.col("l_discount") - F.col("l_tax")})
    a, b, c = "l_returnflag", "l_linestatus", "brand"
    return J.history_levels(t, [a, b, c], [[a, b, c], [a, b], [a, c], [a], [c], []], "r")


@query("unseen_windows", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unseen_windows(spark, sf_dir):
    ledger = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.unseen(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ledger, ["o_orderkey"])


@query("benchmark_map_join", f"WITH {BARS}, r AS (SELECT date, close / lag(close, 20) OVER (ORDER BY date) - 1 AS b FROM bars WHERE symbol = '{BENCHMARK}') SELECT symbol, date, b AS benchmark_ret20 FROM bars LEFT JOIN r USING (date)", ("benchmark_ret20",))
def benchmark_map_join(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    bench = bars.filter(F.col("symbol") == BENCHMARK).withColumn("benchmark_ret20", F.col("close") / F.lag("close", 20).over(W.by()) - 1).select("date", "benchmark_ret20")
    return bars.select("symbol", "date").join(bench, "date", "left").select("symbol", "date", "benchmark_ret20")
