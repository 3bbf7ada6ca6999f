"""Statistical inference: multiple testing, sequential tests, resampling, cross-validation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf
from .ranking import indexed, running, tile
from .windows import by


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, key: str, q: float = 0.05) -> DataFrame:
    """Rejections (all p at or below the cutoff, ties too), monotone q-values, and the light ones without the monotone step."""
    w = Window.partitionBy(*family)
    ranked = df.withColumns({"_k": F.row_number().over(w.orderBy(p, key)), "_m": F.count("*").over(w)})
    raw = F.col(p) * F.col("_m") / F.col("_k")
    cutoff = F.max(F.when(F.col(p) <= q * F.col("_k") / F.col("_m"), F.col(p))).over(w)
    out = ranked.withColumns({"rejected": F.coalesce(F.col(p) <= cutoff, F.lit(False)), "q_light": F.least(raw, F.lit(1.0)), "_raw": raw})
    # Backwards, since a frame up to the last row is gone through anew for each row.
    following = w.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("q_value", F.least(F.min("_raw").over(following), F.lit(1.0))).drop("_k", "_m", "_raw")


def newey_west(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int, chunk: int = 65_536) -> DataFrame:
    """t of the mean with Bartlett weights; the lagged products are sums over lag columns.

    Rows are placed without a window over a whole key and lagged in chunks, each with the last `lags` rows of the chunk before it, so
    no task holds more than a chunk. Rows without a key or a first order column are left out of the lags. chunk must be at least lags.
    """
    if chunk < lags:
        raise ValueError("a chunk must hold the lags")
    stats = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    placed = indexed(df.select(*dict.fromkeys([*keys, *order, value])), keys, order[0], order, "_at").join(stats.select(*keys, F.col("mean").alias("_mean")), keys)
    ends = F.when(F.col("_at") % chunk >= chunk - lags, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copies = placed.select(*keys, "_at", (F.col(value) - F.col("_mean")).alias("_d"), F.explode(ends).alias("_ahead")).withColumn("_chunk", F.floor(F.col("_at") / chunk) + F.col("_ahead"))
    w = by([*keys, "_chunk"], "_at")
    products = copies.withColumns({f"_g{k}": F.col("_d") * (F.lag("_d", k).over(w) if k else F.col("_d")) for k in range(lags + 1)}).filter("_ahead = 0")
    sums = products.groupBy(*keys).agg(*[F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(lags + 1)])
    variance = F.col("_s0") / F.col("n")
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.col(f"_s{k}") / F.col("n")
    return stats.join(sums, keys).withColumn("t", F.when(variance > 0, F.col("mean") / F.sqrt(variance / F.col("n")))).select(*keys, "n", "mean", "t")


def sharpe(df: DataFrame, keys: list[str], value: str, benchmark: float = 0.0) -> DataFrame:
    """Sharpe ratio, population skewness, non-excess kurtosis, and the probabilistic Sharpe ratio against a benchmark."""
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg(value) / F.stddev_samp(value)).alias("sr"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))
    sr = F.col("sr")
    z = (sr - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr)
    return s.withColumns({"z": z, "psr": normal_cdf(z)})


def sprt(df: DataFrame, keys: list[str], order: list[str], value: str, mean0: float, mean1: float, sigma: float, alpha: float = 0.05, beta: float = 0.2) -> DataFrame:
    """Sequential test of two means: the first crossing of the cumulative log likelihood ratio, or 'continue'."""
    up, down = float(np.log((1 - beta) / alpha)), float(np.log(beta / (1 - alpha)))
    llr = (F.col(value) - (mean0 + mean1) / 2) * ((mean1 - mean0) / sigma**2)
    run = running(df, keys, order, {"_llr": llr, "_n": F.lit(1)})
    first = F.min(F.when((F.col("_llr") >= up) | (F.col("_llr") <= down), F.struct("_n", (F.col("_llr") >= up).alias("accept"))))
    out = run.groupBy(*keys).agg(F.count("*").alias("n"), first.alias("_f"))
    return out.select(*keys, "n", F.col("_f._n").alias("stopped_at"), F.when(F.col("_f").isNull(), "continue").when(F.col("_f.accept"), "accept_h1").otherwise("accept_h0").alias("decision"))


def kolmogorov_smirnov(df: DataFrame, keys: list[str], value: str, sample: str) -> DataFrame:
    """Largest distance of two samples' distribution functions; sample: 0 or 1. Values are counted before they are ordered."""
    counts = df.groupBy(*keys, value).agg(F.count_if(F.col(sample) == 0).alias("a"), F.count_if(F.col(sample) == 1).alias("b"))
    w, all_ = by(keys, value), Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(all_) - F.sum("b").over(w) / F.sum("b").over(all_))
    return counts.withColumn("_gap", gap).groupBy(*keys).agg(F.max("_gap").alias("ks"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def walk_forward(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, folds: int, embargo_days: int) -> DataFrame:
    """Purged expanding folds by start, then order: (fold, n_train, n_test); training rows end before the test's first start less the embargo."""
    parts = indexed(df, keys, start, order).withColumn("fold", tile(F.col("index"), F.col("index_of"), folds))
    tests = parts.groupBy(*keys, "fold").agg(F.min(start).alias("_from"), F.count("*").alias("n_test")).filter("fold > 1")
    # Days are counted before they meet the folds, so the join holds days x folds and no pairs of rows.
    days = df.groupBy(*keys, end).agg(F.count("*").alias("_c"))
    joined = tests.join(days, keys).filter(F.col(end) < F.date_sub("_from", embargo_days))
    trained = joined.groupBy(*keys, "fold").agg(F.sum("_c").alias("n_train"))
    return tests.join(trained, [*keys, "fold"], "left").select(*keys, "fold", F.coalesce("n_train", F.lit(0)).alias("n_train"), "n_test")


def pbo(df: DataFrame, block: Column, variant: str, value: str, blocks: int) -> DataFrame:
    """Backtest overfitting by symmetric splits: per split the variant best in sample, and its relative rank out of sample.

    Sums by block and variant come first; the splits only add block sums.
    """
    sums = df.groupBy(block.alias("_b"), F.col(variant).alias("variant")).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    splits = list(combinations(range(blocks), blocks // 2))
    table = df.sparkSession.createDataFrame([(i, b, b in chosen) for i, chosen in enumerate(splits) for b in range(blocks)], "split int, _b int, inside boolean")
    each = sums.join(F.broadcast(table), "_b").groupBy("split", "variant").agg(*[(F.sum(F.when(c, F.col("s"))) / F.sum(F.when(c, F.col("c")))).alias(n) for n, c in (("is_mean", F.col("inside")), ("oos_mean", ~F.col("inside")))])
    w = Window.partitionBy("split")
    ranked = each.withColumns({"_best": F.row_number().over(w.orderBy(F.round("is_mean", 9).desc(), "variant")), "_rank": F.rank().over(w.orderBy(F.round("oos_mean", 9))), "_n": F.count("*").over(w)})
    return ranked.filter("_best = 1").select("split", "variant", (F.col("_rank") / (F.col("_n") + 1)).alias("omega"))


def permutation_p(df: DataFrame, observed: float, statistic: str) -> DataFrame:
    return df.agg(((1 + F.count_if(F.col(statistic) >= observed)) / (F.count("*") + 1)).alias("p"))


def stationary_bootstrap(df: DataFrame, keys: list[str], order: list[str], value: str, draws: int = 500, block: float = 5.0, seed: int = 0, chunk: int = 8192) -> DataFrame:
    """Percentile interval and one-sided p of each key's mean by stationary resampling; draws differ by key, place and seed.

    A draw is a weight a row: runs start at any row at a rate of 1 / block and last geometrically (mean: block), and a row weighs as
    many runs as cover it, once on average. Rows are placed by the first column of `order`, then the others, and drawn in chunks, whose
    sums add up, so no task holds a key's series; runs end with their chunk, and each chunk begins with runs already under way.
    Rows without a value, a key or a first order column take no part; neither does a draw that weighs no row.
    """
    if block > chunk / 20:
        raise ValueError("runs end with their chunk, so a chunk must hold many of them: at least 20 blocks")
    known = df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, *order]), F.col(value).cast("double").alias("_x"))
    placed = indexed(known, keys, order[0], order, "_at").select(*keys, F.floor(F.col("_at") / chunk).alias("_chunk"), F.xxhash64(*keys).alias("_name"), "_at", "_x")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_at")["_x"].to_numpy()
        n, first = len(x), pdf.iloc[0]
        rng = np.random.default_rng([seed, int(first["_name"]) & 0xFFFFFFFF, int(first["_chunk"])])
        sums, counts = np.empty(draws), np.empty(draws)
        for i in range(draws):
            starts = np.concatenate([np.zeros(rng.poisson(1 - 1 / block), int), rng.integers(0, n, rng.poisson(n / block))])
            ends = np.minimum(starts + rng.geometric(1 / block, len(starts)), n)
            w = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n]
            sums[i], counts[i] = w @ x, w.sum()
        return pd.DataFrame({**{k: [first[k]] * draws for k in keys}, "_draw": np.arange(draws), "_s": sums, "_c": counts})

    kinds = dict(df.dtypes)
    parts = placed.groupBy(*keys, "_chunk").applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_draw int, _s double, _c double"]))
    means = parts.groupBy(*keys, "_draw").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c")).filter("_c > 0").withColumn("_m", F.col("_s") / F.col("_c"))
    bounds = means.groupBy(*keys).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"), ((1 + F.count_if(F.col("_m") <= 0)) / (F.count("*") + 1)).alias("p"))
    stats = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"))
    return stats.join(bounds, keys).select(*keys, "n", "mean", "low", "high", "p")


def cluster_bootstrap(df: DataFrame, cluster: list[str], value: str, draws: int = 100, seed: int = 0) -> DataFrame:
    """Mean by draws over clusters: sums and counts by cluster come first, each draw is a seeded Poisson weight a cluster."""
    sums = df.groupBy(*cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, c = np.zeros(draws), np.zeros(draws)
        for pdf in batches:
            for name, x, n in zip(pdf["_name"], pdf["s"], pdf["c"], strict=True):
                w = np.random.default_rng([seed, int(name) & 0x7FFFFFFF]).poisson(1.0, draws)
                s += w * x
                c += w * n
        yield pd.DataFrame({"draw": np.arange(draws), "s": s, "c": c})

    parts = sums.withColumn("_name", F.xxhash64(*cluster)).select("_name", "s", "c").mapInPandas(run, "draw int, s double, c double")
    return parts.groupBy("draw").agg((F.sum("s") / F.sum("c")).alias("mean"))
