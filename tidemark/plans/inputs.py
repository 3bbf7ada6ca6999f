"""The operators' inputs, made of the tables at hand, as DataFrames and as SQL.

daily bars: orders of a customer group and day; intraday bars: events of a type in 5 minutes; trades: line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS, BENCHMARK = 5, "S0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % SYMBOLS).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("p"), "o_orderkey"
    )
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("p", "o_orderkey").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o_orderkey").alias("close"),
        (F.count("*") * 1000 + F.sum(F.col("o_orderkey") % 100)).cast("double").alias("volume"),
    )


BARS = f"""bars AS (SELECT 'S' || (o_custkey % {SYMBOLS}) AS symbol, o_orderdate::DATE AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, (count(*) * 1000 + sum(o_orderkey % 100))::DOUBLE AS volume FROM orders GROUP BY 1, 2)"""


def intraday_bars(spark: SparkSession, sf_dir: str, minutes: int = 5) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    bars = e.groupBy(F.col("event_type").alias("symbol"), F.window("ts", f"{minutes} minutes")["start"].alias("ts")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), (F.count("*") * 100).cast("double").alias("volume")
    )
    return bars.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("session", F.to_date("ts"))


INTRADAY = """ibars AS (SELECT event_type AS symbol, time_bucket(INTERVAL '5 minutes', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, (count(*) * 100)::DOUBLE AS volume, time_bucket(INTERVAL '5 minutes', ts)::DATE AS session FROM events GROUP BY 1, 2, 8)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, symbol, pattern, entry_date, exit_date, ret (signed), qty, price, adv."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 20).cast("string")).alias("symbol"),
        F.concat("l_returnflag", "l_linestatus").alias("pattern"), F.to_date("l_shipdate").alias("entry_date"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") + 1).alias("exit_date"),
        (F.col("l_discount") - F.col("l_tax")).alias("ret"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_extendedprice") * 100).alias("adv"),
    )


TRADES = """trades AS (SELECT l_orderkey * 10 + l_linenumber AS trade_id, 'P' || (l_partkey % 20) AS symbol, l_returnflag || l_linestatus AS pattern, l_shipdate::DATE AS entry_date,
  (l_shipdate::DATE + (l_linenumber + 1)::INTEGER)::DATE AS exit_date, l_discount - l_tax AS ret, l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice * 100 AS adv FROM lineitem)"""
