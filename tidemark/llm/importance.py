"""Quality classifier by importance resampling over hashed n-grams.

Two generative models over hashed n-grams, one of target texts (those labelled good) and one of all raw texts, give each
document the log ratio of its likelihoods; Gumbel noise is added and the k largest stay, which samples k documents without
replacement in proportion to their importance weights. k is the share of good ones among labels times the number of documents.

N-grams: words, pairs of words, and triples of word shapes (case, ends, repetition of the word before), each hashed to BUCKETS.
The raw model counts all documents; the target model counts at most TARGET_DOCS labelled documents (those with the smallest
hashes) and is smoothed towards the raw model.

Null or empty text: log ratio 0. Null doc_id: never a target. The noise is drawn by id, text and number of the repetition, so rows
that share an id, or have none, draw apart. Without target documents every ratio is 0 and all stay. An empty table gives an empty result. Other
columns pass through; columns of the input that start with `qc_` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import HASH_BITS, hash_place, places
from .runtime import gives_back, materialize
from .textbytes import Texts, mix, slices

BUCKETS, CHANNELS = 1 << 14, 3
TARGET_DOCS = 20_000
#: Weight of the raw model in the smoothed target model, against 1 for the target's own counts.
SMOOTHING = 0.1

_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b".,;:?'\"()-")] = 3
_CLASS[list(b"!")] = 4
_CLASS[list(b"#*$%&|<>@^~_=+/\\{}[]")] = 5
_CLASS[128:] = 7


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, their rows) of a slice; a feature's channel is id // BUCKETS."""
    starts, ends, first = t.words()
    n = np.diff(first)
    rows = np.repeat(np.arange(t.n, dtype=np.int64), n)
    h = t.span_hashes(starts, ends)
    kind = _CLASS[t.data]
    if not len(h):
        return np.zeros(0, np.int64), rows

    def within(which: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind == which)])
        return sums[ends] - sums[starts]

    upper, lower = within(1), within(0)
    before = np.zeros(len(h), bool)
    before[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    shape = kind[starts].astype(np.uint64) | kind[ends - 1].astype(np.uint64) << np.uint64(3) | ((upper > 1) & (lower == 0)).astype(np.uint64) << np.uint64(6) | before.astype(np.uint64) << np.uint64(7) | (ends - starts == 1).astype(np.uint64) << np.uint64(8)
    bucket = np.uint64(BUCKETS)
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    triples = np.flatnonzero(rows[2:] == rows[:-2])
    two = mix(h[pairs] * np.uint64(3) + mix(h[pairs + 1]))
    three = mix(shape[triples] | shape[triples + 1] << np.uint64(9) | shape[triples + 2] << np.uint64(18))
    ids = np.concatenate([h % bucket, two % bucket + bucket, three % bucket + bucket * np.uint64(2)]).astype(np.int64)
    return ids, np.concatenate([rows, rows[pairs], rows[triples]])


def count_features(docs: DataFrame, targets: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(qc_feature, qc_raw, qc_target), one row a partition and feature; targets: ids of the target documents."""
    wanted = np.array(sorted(targets), np.int64)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS * CHANNELS, np.int64), np.zeros(BUCKETS * CHANNELS, np.int64)
        for b in batches:
            ids = b.column(0)
            good = np.isin(ids.fill_null(0).to_numpy(), wanted) & ids.is_valid().to_numpy(zero_copy_only=False)
            for t in slices(b.column(1)):
                f, rows = features(t)
                raw += np.bincount(f, minlength=len(raw))
                mine = good[t.row : t.row + t.n]
                if mine.any():
                    target += np.bincount(f[mine[rows]], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["qc_feature", "qc_raw", "qc_target"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "qc_feature long, qc_raw long, qc_target long")


def log_ratios(counted: DataFrame) -> np.ndarray:
    """The log ratio of each of BUCKETS * CHANNELS features; the table is that large whatever the corpus."""
    raw, target = np.zeros(BUCKETS * CHANNELS), np.zeros(BUCKETS * CHANNELS)
    for r in counted.groupBy("qc_feature").agg(F.sum("qc_raw").alias("r"), F.sum("qc_target").alias("t")).collect():
        raw[r["qc_feature"]], target[r["qc_feature"]] = r["r"], r["t"]
    out = np.zeros((CHANNELS, BUCKETS))
    for c in range(CHANNELS):
        r, t = raw[c * BUCKETS : (c + 1) * BUCKETS], target[c * BUCKETS : (c + 1) * BUCKETS]
        if t.sum():
            p = np.maximum(r, 0.5) / np.maximum(r, 0.5).sum()
            out[c] = np.log((t / t.sum() + SMOOTHING * p) / (1 + SMOOTHING) / p)
    return out.ravel().astype(np.float32)


def score(docs: DataFrame, ratios: np.ndarray, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = 0) -> DataFrame:
    """docs (or its columns in keep) plus qc_log_ratio and qc_id, a hash of id and text."""
    names = [c for c in (docs.columns if keep is None else keep) if not c.startswith("qc_")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for t in slices(b.column(b.num_columns - 1)):
                f, rows = features(t)
                sums.append(np.bincount(rows, weights=ratios[f], minlength=t.n))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(sums) if sums else np.zeros(0))], [*names, "qc_id", "qc_log_ratio"])

    ident = hash_place(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "qc_id bigint, qc_log_ratio double"])
    return docs.select(*[F.col(f"`{c}`") for c in names], ident.alias("qc_id"), F.col(text).alias("qc_text")).mapInArrow(run, schema)


def with_noise(scored: DataFrame) -> DataFrame:
    """scored (a written table) with qc_key, the ratio with Gumbel noise of the row's own: repeated rows draw apart."""
    # Without a source: rows are told apart by id and text alone.
    placed = places(scored.withColumn("qc_source", F.lit("")), "qc_id", "qc_source", "qc_place")
    u = (F.col("qc_place").cast("double") + 0.5) / float(1 << HASH_BITS)
    return placed.withColumn("qc_key", F.col("qc_log_ratio") - F.log(-F.log(F.least(u, F.lit(1 - 1e-16))))).drop("qc_place", "qc_source")


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, by histograms of `bins` buckets over ever narrower ranges; at most bins rows reach the driver."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return low
    above = 0
    while low < high:
        width = (high - low) / bins
        inside = df.filter(F.col(col).between(low, high))
        hist = {r["b"]: r for r in inside.groupBy(F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for b in sorted(hist, reverse=True):
            if above + hist[b]["n"] >= k:
                break
            above += hist[b]["n"]
        low, high = hist[b]["lo"], hist[b]["hi"]
    return low


def target_sample(labels: DataFrame, most: int = TARGET_DOCS) -> tuple[list[int], float]:
    """At most about `most` ids of documents labelled good, chosen by hash, and the share of good ones among labelled documents."""
    seen = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = seen.agg(F.count("*"), F.coalesce(F.sum(F.col("quality").cast("long")), F.lit(0))).first()
    limit = int(2**HASH_BITS * min(1.0, most / max(good, 1)))
    ids = [r[0] for r in seen.filter((F.col("quality") == 1) & (hash_place(F.col("doc_id")) < F.lit(limit))).select("doc_id").collect()]
    return ids, good / n if n else 1.0


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """docs (or its columns in keep) plus qc_log_ratio, qc_key and qc_kept. `share`: of documents to keep, default that of good labels."""
    ids, good = target_sample(labels)
    ratios = log_ratios(count_features(docs, ids, key, text))
    scored = with_noise(materialize(score(docs, ratios, key, text, keep, seed)))
    n = scored.count()
    k = round(n * (good if share is None else share)) if ids else n
    return scored.withColumn("qc_kept", F.col("qc_key") >= F.lit(kth_largest(scored, "qc_key", k)))


def op1_importance(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return out.select("doc_id", F.col("qc_log_ratio").alias("log_ratio"), F.col("qc_key").alias("key"), F.col("qc_kept").alias("kept"))
