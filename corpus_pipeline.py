"""The corpus pipeline: documents are filtered, cleaned, thinned, mixed and packed, a stage at a time.

Each stage is (name, function); a function takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns
the columns of documents, the last stage the packed pieces. `run` writes each stage's result as Parquet and rereads it.
What a stage wrote on its way goes when it is done, and so does its result when its successor is done.
Stages take nulls in any column, empty tables, repeated rows and very long texts as their operators do: documents without text are
judged, linked (all texts without words are one group), mixed zero times, and without an id linked and packed like any other.
Text that a stage changed has its n_chars counted anew. A mix takes some documents more than once: they are repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import importance, line_dedup, mixing, packing, simhash
from tidemark.llm.runtime import delete_table, scratch
from tidemark.session import shared_dir, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that importance resampling rejects go."""
    ship(spark)
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("qc_kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: repeated lines go from all but the last document that holds them."""
    ship(spark)
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("dl_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, linked by five-word shingles (Jaccard similarity of 0.8 or more): one document of each group of near copies stays."""
    ship(spark)
    return simhash.keep_one(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it."""
    ship(spark)
    mixed = mixing.mix(docs, keep=docs.columns)
    return mixed.withColumn("mix_row", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the pieces of all documents and their places in sequences."""
    ship(spark)
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("pack", pack)]
#: Gumbel keys over hashed n-grams, fingerprints and tokens can't be expressed in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    former = None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/tidemark/pipeline-{uuid.uuid4().hex}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if former:
            delete_table(spark, former)
        docs, former = spark.read.parquet(path), path
    return docs
