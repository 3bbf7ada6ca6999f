"""Queries of sources and sinks, as round trips through files of the shared folder, and of scalars and cleaning steps that have no other query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import gates as G
from ..operators import quality as Q
from ..operators import windows as W
from ..registry import SQL, query
from ..session import shared_dir
from ..sources import files
from .inputs import BARS, BENCHMARK, INTRADAY, daily_bars, intraday_bars, table


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tidemark/files-{uuid.uuid4().hex}"


def _bars_as_csv(spark, sf_dir) -> str:
    """Daily bars as CSV files in a folder a symbol; every fifth day's line is there twice, and every seventh's close can't be read."""
    bars = daily_bars(spark, sf_dir)
    number = F.datediff("date", F.lit("1970-01-01"))
    close = F.when(number % 7 == 0, "n/a").otherwise(F.col("close").cast("string"))
    twice = F.array_repeat(F.lit(1), F.when(number % 5 == 0, 2).otherwise(1))
    lines = bars.withColumn("close", close).withColumn("copy", F.explode(twice)).select("symbol", "volume", "date", "low", "high", "open", "close")
    path = _folder(spark)
    lines.write.partitionBy("symbol").option("header", True).csv(path)
    return path


_NAMED = r"/symbol=([^/]+)/"
_READ = "symbol, date, open, high, low, CASE WHEN (date - DATE '1970-01-01') % 7 <> 0 THEN close END AS close, volume"


@query("csv_bars_last_line", f"WITH {BARS} SELECT {_READ} FROM bars")
def csv_bars_last_line(spark, sf_dir):
    return files.scan_bars(spark, _bars_as_csv(spark, sf_dir), named=_NAMED)


@query("csv_bars_without_repeated", f"WITH {BARS} SELECT {_READ} FROM bars WHERE (date - DATE '1970-01-01') % 5 <> 0")
def csv_bars_without_repeated(spark, sf_dir):
    return files.scan_bars(spark, _bars_as_csv(spark, sf_dir), "drop", forbidden=["1900-01-01"], named=_NAMED)


@query(
    "csv_universe",
    """SELECT DISTINCT 'C' || (c_custkey % 400) AS symbol, upper(CASE c_custkey % 400 % 3 WHEN 0 THEN 'etf' WHEN 1 THEN 'FUND' ELSE 'STK' END) AS product_class FROM customer WHERE c_custkey % 400 % 4 <> 3 AND c_custkey % 400 <> 9""",
)
def csv_universe(spark, sf_dir):
    k = F.col("c_custkey") % 400
    lines = table(spark, sf_dir, "customer").select(
        F.when(k == 9, F.lit("  ")).otherwise(F.concat(F.lit(" c"), k.cast("string"), F.lit(" "))).alias("symbol"), F.get(F.array(*[F.lit(x) for x in ("1", "True", " yes ", "no")]), (k % 4).cast("int")).alias("selected"),
        F.when(k % 3 == 0, "etf").otherwise("").alias("product_type"), F.when(k % 3 == 1, "FUND").when(k % 3 == 0, "stock").otherwise(" ").alias("secType"),
    )
    path = _folder(spark)
    files.write_csv(lines, path, ["symbol", "selected", "product_type", "secType"])
    return files.scan_universe(spark, path).select("symbol", "product_class")


def _ledger(spark, sf_dir):
    return W.gap_ledger(daily_bars(spark, sf_dir), BENCHMARK).select("symbol", "date", "gap_pct", "gap_direction", "prior_return_5d", "gap_filled", "data_quality_status")


_LEDGER_SQL = SQL["gap_event_ledger"].split("FROM (", 1)[1].rsplit(")", 1)[0]


@query("csv_ledger", f"SELECT symbol, date, gap_pct, gap_direction, prior_return_5d, gap_filled, data_quality_status FROM ({_LEDGER_SQL})", ("gap_pct", "prior_return_5d"))
def csv_ledger(spark, sf_dir):
    ledger, path = _ledger(spark, sf_dir), _folder(spark)
    files.write_csv(ledger, path, ledger.columns)
    return files.scan_ledger(spark, path, ledger.schema)


@query("partitioned_ledger", f"SELECT symbol, date, gap_pct FROM ({_LEDGER_SQL}) WHERE gap_direction = 'up' UNION ALL SELECT symbol, date, gap_pct FROM ({_LEDGER_SQL}) WHERE gap_direction = 'down' AND gap_pct < -0.1", ("gap_pct",))
def partitioned_ledger(spark, sf_dir):
    """A rerun of one partition replaces it and leaves the others."""
    ledger, path = _ledger(spark, sf_dir).filter("gap_direction <> 'flat'"), _folder(spark)
    files.write_table(ledger, path, ["gap_direction"])
    files.write_table(ledger.filter("gap_direction = 'down' AND gap_pct < -0.1"), path, ["gap_direction"])
    return spark.read.schema(ledger.schema).parquet(path).select("symbol", "date", "gap_pct")


@query(
    "ledger_summaries",
    f"""WITH g AS ({_LEDGER_SQL}), u AS (SELECT 'distribution' AS summary, data_quality_status AS of, gap_pct FROM g UNION ALL SELECT 'by_symbol', symbol, gap_pct FROM g UNION ALL SELECT 'by_quarter', year(date) || 'Q' || quarter(date), gap_pct FROM g)
SELECT summary, of, count(*) AS n, quantile_cont(abs(gap_pct), 0.5) AS median, max(abs(gap_pct)) AS most FROM u GROUP BY ALL""",
    ("median", "most"),
)
def ledger_summaries(spark, sf_dir):
    path, out = _folder(spark), None
    files.summaries(W.gap_ledger(daily_bars(spark, sf_dir), BENCHMARK), path)
    for name, key in (("distribution", "data_quality_status"), ("by_symbol", "symbol"), ("by_quarter", "quarter")):
        read = spark.read.option("header", True).csv(f"{path}/{name}").select(F.lit(name).alias("summary"), F.col(key).alias("of"), F.col("n").cast("long").alias("n"), F.col("gap_median").cast("double").alias("median"), F.col("gap_max").cast("double").alias("most"))
        out = read if out is None else out.unionByName(read)
    return out


_MATRIX = T.StructType([T.StructField("key", T.LongType()), T.StructField("brand", T.StringType()), T.StructField("size", T.IntegerType())])


@query("json_matrix", "SELECT p_partkey AS key, p_brand AS brand, p_size::INTEGER AS size FROM part WHERE p_brand <> 'Brand#11'")
def json_matrix(spark, sf_dir):
    """A JSON list a brand, one file each; one of them is cut off and gives no rows."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"), F.col("p_brand").alias("brand"), F.col("p_size").cast("int").alias("size"))
    lists = parts.groupBy("brand").agg(F.to_json(F.collect_list(F.struct("key", "brand", "size"))).alias("value"))
    path = _folder(spark)
    lists.select(F.when(F.col("brand") == "Brand#11", F.expr("substring(value, 1, 20)")).otherwise(F.col("value")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.scan_json_rows(spark, path, _MATRIX, tolerant=True)


@query(
    "scalar_buckets",
    """SELECT event_id, trunc((epoch_us(ts) - epoch_us(date_trunc('day', ts) + INTERVAL '13 hours 30 minutes')) / 60000000)::BIGINT AS minute, CASE WHEN value * 1e6 >= 50e6 THEN 'mega' WHEN value * 1e6 >= 10e6 THEN 'large' WHEN value * 1e6 >= 1e6 THEN 'mid' ELSE 'small' END AS adv,
  CASE WHEN value * 1e5 >= 5e6 AND event_id % 40 <= 5 THEN 'high' WHEN value * 1e5 >= 1e6 AND event_id % 40 <= 25 THEN 'medium' ELSE 'low' END AS liquidity,
  CASE event_id % 5 WHEN 0 THEN (event_id % 90) * 12 WHEN 1 THEN event_id % 90 WHEN 2 THEN ceil((event_id % 90) * 7 / 30) WHEN 3 THEN ceil((event_id % 90) / 30) END::INTEGER AS months, CASE event_id % 3 WHEN 0 THEN event_id % 60 WHEN 1 THEN event_id % 60 * 60 ELSE 5 END::INTEGER AS minutes FROM events""",
)
def scalar_buckets(spark, sf_dir):
    c = F.col
    i = c("event_id").cast("int")
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    period = F.when(i % 5 == 0, text(i % 90, "y")).when(i % 5 == 1, text(i % 90, "mo")).when(i % 5 == 2, text(i % 90, "wk")).when(i % 5 == 3, text(i % 90, "d")).otherwise("max")
    frame = F.when(i % 3 == 0, text(i % 60, "m")).when(i % 3 == 1, text(i % 60, "h")).otherwise("tick")
    opened = F.date_trunc("day", c("ts").cast("timestamp")) + F.expr("INTERVAL '13:30' HOUR TO MINUTE")
    return table(spark, sf_dir, "events").select(
        "event_id", S.session_minute(c("ts"), opened).alias("minute"), S.adv_bucket(c("value") * 1e6).alias("adv"), S.liquidity_bucket(c("value") * 1e5, c("event_id") % 40).alias("liquidity"), S.period_months(period).alias("months"), S.timeframe_minutes(frame).alias("minutes"),
    )


@query(
    "intraday_atr",
    f"WITH {INTRADAY}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM ibars WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)) SELECT symbol, ts, avg(tr) OVER (PARTITION BY symbol, session ORDER BY ts ROWS 13 PRECEDING) AS atr FROM t",
    ("atr",),
)
def intraday_atr(spark, sf_dir):
    return W.atr(intraday_bars(spark, sf_dir), 14, 1, W.by(["symbol", "session"], "ts")).select("symbol", "ts", "atr")


@query("backward_fill", f"WITH {BARS}, v AS (SELECT symbol, date, CASE WHEN (date - DATE '1970-01-01') % 4 = 0 THEN close END AS close FROM bars) SELECT symbol, date, coalesce(first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS close FROM v", ("close",))
def backward_fill(spark, sf_dir):
    known = F.when(F.datediff("date", F.lit("1970-01-01")) % 4 == 0, F.col("close"))
    return W.back_fill(daily_bars(spark, sf_dir).withColumn("close", known), "close", W.by()).select("symbol", "date", "close")


_SEEN = "avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)"


@query(
    "feature_leakage",
    f"""WITH {BARS}, f AS (SELECT symbol, date, {_SEEN} AS mean5, CASE WHEN volume % 7 = 0 THEN NULL ELSE close END AS last FROM bars), s AS (SELECT symbol, date, CASE WHEN (date - DATE '1970-01-01') % 11 = 0 THEN mean5 + 1 ELSE mean5 END AS mean5, CASE WHEN (date - DATE '1970-01-01') % 13 = 0 THEN NULL ELSE last END AS last FROM f),
u AS (SELECT symbol, date, 'mean5' AS feature, s.mean5 AS stored, f.mean5 AS recomputed FROM s JOIN f USING (symbol, date) UNION ALL SELECT symbol, date, 'last', s.last, f.last FROM s JOIN f USING (symbol, date))
SELECT * FROM u WHERE (stored IS NULL) <> (recomputed IS NULL) OR abs(stored - recomputed) > 1e-6""",
    ("stored", "recomputed"),
)
def feature_leakage(spark, sf_dir):
    c, number = F.col, F.datediff("date", F.lit("1970-01-01"))
    f = daily_bars(spark, sf_dir).select("symbol", "date", F.avg("close").over(W.by().rowsBetween(-4, 0)).alias("mean5"), F.when(c("volume") % 7 != 0, c("close")).alias("last"))
    stored = f.select("symbol", "date", F.when(number % 11 == 0, c("mean5") + 1).otherwise(c("mean5")).alias("mean5"), F.when(number % 13 != 0, c("last")).alias("last"))
    return Q.leakage(stored, f, ["symbol", "date"], ["mean5", "last"], 1e-6)


@query("normalized_bars", f"WITH {BARS} SELECT symbol, date, open, high, low, close, volume FROM bars WHERE volume % 6 <> 0 AND volume % 10 <> 3")
def normalized_bars(spark, sf_dir):
    c = F.col
    raw = daily_bars(spark, sf_dir).select("symbol", "date", c("open").alias(" Open"), c("high").cast("string").alias("HIGH"), c("low").alias("Low"), F.when(c("volume") % 6 != 0, c("close")).alias("Adj Close"), F.when(c("volume") % 10 == 3, float("nan")).otherwise(c("volume")).alias("Volume"))
    return Q.normalize(raw, ["symbol", "date"])


@query(
    "symbol_quality_classes",
    f"""WITH {BARS}, s AS (SELECT symbol, year(date) AS year, count(*) AS bars, avg(volume) AS volume, max(high) / min(low) AS span, min(date) AS first FROM bars GROUP BY ALL)
SELECT symbol, year, CASE WHEN bars < 200 THEN 'insufficient_history' WHEN span > 400 THEN 'broken_prices' WHEN volume < 3000 THEN 'illiquid' WHEN span > 300 THEN 'volatile' ELSE 'ok' END AS quality,
  concat_ws(',', CASE WHEN bars < 200 THEN 'SHORT' END, CASE WHEN span > 300 THEN 'WIDE' END, CASE WHEN volume < 3000 THEN 'THIN' END) AS reasons FROM s""",
)
def symbol_quality_classes(spark, sf_dir):
    c = F.col
    s = daily_bars(spark, sf_dir).groupBy("symbol", F.year("date").alias("year")).agg(F.count("*").alias("bars"), F.avg("volume").alias("volume"), (F.max("high") / F.min("low")).alias("span"))
    kind = G.ladder([(c("bars") < 200, "insufficient_history"), (c("span") > 400, "broken_prices"), (c("volume") < 3000, "illiquid"), (c("span") > 300, "volatile")], "ok")
    why = G.reasons([(c("bars") < 200, "SHORT"), (c("span") > 300, "WIDE"), (c("volume") < 3000, "THIN")])
    return s.select("symbol", "year", kind.alias("quality"), F.array_join(why, ",").alias("reasons"))
