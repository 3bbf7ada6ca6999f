"""Scans with explicit schemas and checks, and sinks; one DataFrame over a whole directory, never a loop over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import drop_all_copies, first_per

BAR_FIELDS = ["date", "open", "high", "low", "close", "volume"]
TRUTHY = ["1", "true", "yes", "y"]
PRODUCT_FIELDS = ["product_type", "secType", "asset_class", "instrument_type", "type"]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def scan_bars(spark: SparkSession, directory: str, copies: str = "last", forbidden: list[str] | None = None, named: str = r"([^/]+)\.csv$") -> DataFrame:
    """Bars from {SYMBOL}.csv files, or others whose path holds the symbol as `named` tells: date, open, high, low, close, volume in any order of columns; what doesn't parse is null.

    copies: what becomes of repeated dates: 'last' keeps the last line's, 'drop' drops all, 'error' raises.
    forbidden: dates that must not occur.
    """
    raw = require(spark.read.option("header", True).csv(directory), BAR_FIELDS)
    # Lines keep their order within a file, and a file is read by one task up to its splits: this id ascends in it.
    rows = raw.select(
        F.regexp_extract(F.input_file_name(), named, 1).alias("symbol"), F.try_to_date("date").alias("date"),
        *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in BAR_FIELDS[1:]], F.monotonically_increasing_id().alias("_line"),
    ).filter("date is not null")
    if forbidden:
        bad = rows.filter(F.col("date").isin([F.lit(d).cast("date") for d in forbidden]))
        if not bad.isEmpty():
            raise ValueError("forbidden dates present")
    if copies == "drop":
        return drop_all_copies(rows, ["symbol", "date"]).drop("_line")
    if copies == "error":
        if not rows.groupBy("symbol", "date").count().filter("count > 1").isEmpty():
            raise ValueError("repeated dates")
        return rows.drop("_line")
    return first_per(rows, ["symbol", "date"], [F.col("_line").desc()]).drop("_line")


def scan_universe(spark: SparkSession, path: str) -> DataFrame:
    """symbol upper-cased and trimmed, first line of each kept, truthy `selected` only; product_class from the first known column, else STK."""
    raw = require(spark.read.option("header", True).csv(path), ["symbol"]).withColumn("_line", F.monotonically_increasing_id())
    rows = raw.withColumn("symbol", F.upper(F.trim("symbol"))).filter("symbol <> ''")
    present = [F.nullif(F.trim(c), F.lit("")) for c in PRODUCT_FIELDS if c in raw.columns]
    rows = first_per(rows.withColumn("product_class", F.upper(F.coalesce(*present, F.lit("STK")))), ["symbol"], [F.col("_line")])
    if "selected" in raw.columns:
        rows = rows.filter(F.lower(F.trim("selected")).isin(TRUTHY))
    return rows.drop("_line")


def scan_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A typed CSV ledger; empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").csv(path)


def scan_json_rows(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """A JSON list of rows; tolerant: what can't be decoded gives no rows."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    return rows


def manifest(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """path, length and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(directory)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def manifest_hash(files: DataFrame) -> DataFrame:
    """One hash over the sorted manifest; a manifest has one short row a file."""
    rows = F.array_sort(F.collect_list(F.struct("name", "length", "sha256")))
    return files.agg(F.sha2(F.to_json(rows), 256).alias("manifest_sha256"), F.count("*").alias("files"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites the partitions that df has; the committer makes each job's output appear at once."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new replaces rows of its keys, the rest of old stays."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def append_tail(cached: DataFrame, tail: DataFrame, key: list[str]) -> DataFrame:
    """Incremental refresh: rows of the tail whose keys the cache lacks are added."""
    return cached.unionByName(tail.join(cached.select(*key), key, "left_anti"))


def summaries(ledger: DataFrame, path: str) -> None:
    """The three research summaries: distribution by status, by symbol, by quarter."""
    from ..operators.aggregates import distribution

    quarter = F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string")).alias("quarter")
    for name, keys in (("distribution", [F.col("data_quality_status")]), ("by_symbol", [F.col("symbol")]), ("by_quarter", [quarter])):
        ledger.groupBy(*keys).agg(F.count("*").alias("n"), *distribution(F.abs("gap_pct"), "gap_")).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
