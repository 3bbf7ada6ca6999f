"""Scaled similarity, shapelets, soft warping, false-match rates, Sharpe corrections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf


def scaled_similarity(x: Column, centre: Column, decay: float, size: int) -> Column:
    """1 / (1 + |(x - c) w| / sqrt(sum w^2)) with weights decay^age, the newest component last."""
    weights = F.array(*[F.lit(decay ** (size - 1 - i)) for i in range(size)])
    total = float(sum(decay ** (2 * (size - 1 - i)) for i in range(size))) ** 0.5
    diff = F.zip_with(F.zip_with(x, centre, lambda a, b: a.cast("double") - b.cast("double")), weights, lambda d, w: d * w)
    return 1 / (1 + F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, d: s + d * d)) / total)


#: Templates over -1..1: a valley, a peak, a rise.
SHAPES = {"v": lambda t: abs(t), "peak": lambda t: -abs(t), "rise": lambda t: t}


def shapelet_scores(x: Column, size: int) -> dict[str, Column]:
    """Correlation of an array with each template; null without spread."""
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / size
    centred = F.transform(x, lambda v: v.cast("double") - mean)
    norm = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, v: s + v * v))
    out = {}
    for name, shape in SHAPES.items():
        t = np.array([shape(2 * i / (size - 1) - 1) for i in range(size)])
        t = (t - t.mean()) / np.sqrt(((t - t.mean()) ** 2).sum())
        product = F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in t]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        out[name] = F.when(norm > 0, product / norm)
    return out


def false_matches(scores: DataFrame, bank: str, score: str, positive: str, recall: float) -> DataFrame:
    """The similarity that `recall` of positives reach, and per negative bank the share of others that reach it too."""
    cut = scores.filter(positive).agg(F.percentile(score, F.lit(1 - recall))).first()[0]
    return scores.filter(f"not {positive}").groupBy(bank).agg(F.count("*").alias("n"), F.avg((F.col(score) >= F.lit(cut)).cast("double")).alias("fpr")).withColumn("threshold", F.lit(cut).cast("double"))


def soft_dtw(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """Soft warping distance of each row of a (rows x n) to the same row of b (rows x m, or one row for all), a diagonal at a time."""
    n, m = a.shape[1], b.shape[1]
    cost = (a[:, :, None] - b[:, None, :]) ** 2
    table = np.full((len(a), n + 1, m + 1), np.inf)
    table[:, 0, 0] = 0.0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        z = -np.stack([table[:, i - 1, j], table[:, i, j - 1], table[:, i - 1, j - 1]]) / gamma
        top = z.max(axis=0)
        table[:, i, j] = cost[:, i - 1, j - 1] - gamma * (top + np.log(np.exp(z - top).sum(axis=0)))
    return table[:, -1, -1]


def soft_dtw_divergence(series: DataFrame, key: str, values: str, prototype: list[float], gamma: float = 1.0) -> DataFrame:
    """Soft warping distance less half of both self terms: 0 for the prototype itself."""
    p = np.array([prototype], float)
    own = soft_dtw(p, p, gamma)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            out: list[float | None] = [None] * len(rows)
            for n in {len(x) for x in rows if x}:
                same = [i for i, x in enumerate(rows) if x and len(x) == n]
                for at in range(0, len(same), 128):
                    some = same[at : at + 128]
                    a = np.array([rows[i] for i in some], float)
                    found = soft_dtw(a, p, gamma) - 0.5 * (soft_dtw(a, a, gamma) + own)
                    for i, x in zip(some, found.tolist(), strict=True):
                        out[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], [key, "divergence"])

    return series.select(key, values).mapInArrow(run, f"{key} {dict(series.dtypes)[key]}, divergence double")


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def deflated_sharpe(stats: DataFrame, trials: int) -> DataFrame:
    """stats: one row a strategy with n, sr, skew, kurt. The expected best of `trials` by the spread of sr, and the probability of beating it."""
    spread = stats.agg(F.stddev_samp("sr")).first()[0] or 0.0
    euler = 0.5772156649015329
    best = spread * ((1 - euler) * normal_quantile(1 - 1 / trials) + euler * normal_quantile(1 - 1 / (trials * np.e)))
    sr = F.col("sr")
    z = (sr - best) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr)
    return stats.withColumns({"expected_best": F.lit(float(best)), "dsr": normal_cdf(z)})


def _family_draws(df: DataFrame, family: str, order: str, value: str, draws: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(family, n, mean, t) of each member, and (family, draw, _t): its centred t in each resampled world.

    Days are resampled for all members alike: sums by member and day come first, each draw weighs days by a seeded Poisson.
    """
    daily = df.groupBy(family, order).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    stats = df.groupBy(family).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.stddev_samp(value).alias("_sd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for name, d, s, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                w = np.random.default_rng([seed, d]).poisson(1.0, draws)
                a = sums.setdefault(name, [np.zeros(draws), np.zeros(draws)])
                a[0] += w * s
                a[1] += w * c
        for name, (s, c) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * draws), pa.array(np.arange(draws, dtype=np.int32)), pa.array(s), pa.array(c)], [family, "draw", "s", "c"])

    day = F.datediff(order, F.lit("1970-01-01")).alias("d")
    parts = daily.select(family, day, F.col("s").cast("double"), F.col("c").cast("double")).mapInArrow(run, f"{family} string, draw int, s double, c double")
    means = parts.groupBy(family, "draw").agg((F.sum("s") / F.sum("c")).alias("_m"))
    worlds = means.join(stats, family).select(family, "draw", ((F.col("_m") - F.col("mean")) / (F.col("_sd") / F.sqrt("n"))).alias("_t"))
    return stats.select(family, "n", "mean", (F.col("mean") / (F.col("_sd") / F.sqrt("n"))).alias("t")), worlds


def family_max(df: DataFrame, family: str, order: str, value: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """Reality check: studentised mean of each member, and the share of resampled worlds whose best member does better."""
    own, worlds = _family_draws(df, family, order, value, draws, seed)
    best = worlds.groupBy("draw").agg(F.max("_t").alias("_best"))
    # One number a draw.
    listed = best.agg(F.collect_list("_best").alias("_b"), F.lit(1).alias("_one"))
    return own.withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one").select(family, "n", "mean", "t", ((F.size(F.filter("_b", lambda x: x >= F.col("t"))) + 1) / (draws + 1)).alias("p_family"))


def romano_wolf(df: DataFrame, family: str, order: str, value: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """Stepdown adjusted p: the k-th best member against the best of those not yet passed, and never below the ones before.

    Windows hold one row a member (a draw's members, or the family's).
    """
    own, worlds = _family_draws(df, family, order, value, draws, seed)
    ranked = own.withColumn("_k", F.row_number().over(Window.orderBy(F.col("t").desc(), family)))
    rest = worlds.join(ranked.select(family, "_k", "t"), family).withColumn("_max", F.max("_t").over(Window.partitionBy("draw").orderBy(F.col("_k").desc())))
    p = rest.groupBy(family, "_k").agg(((F.count_if(F.col("_max") >= F.col("t")) + 1) / (F.count("*") + 1)).alias("_p"))
    adjusted = p.withColumn("p_adjusted", F.max("_p").over(Window.orderBy("_k"))).select(family, "p_adjusted")
    return ranked.drop("_k").join(adjusted, family)


def find_cup(close: np.ndarray, low_depth: float = 0.08, high_depth: float = 0.5, rim: float = 0.1) -> tuple[bool, float]:
    """A rounded base: two rims of like height around a trough in the middle, then a close near the right rim. (found, score)."""
    n = len(close)
    if n < 12:
        return False, 0.0
    third = n // 3
    left = int(np.argmax(close[:third]))
    right = n - third + int(np.argmax(close[n - third :]))
    trough = left + int(np.argmin(close[left : right + 1]))
    top = min(close[left], close[right])
    depth = 1 - close[trough] / top if top > 0 else 0.0
    level = abs(close[left] - close[right]) / max(close[left], close[right])
    centre = abs((trough - left) / max(right - left, 1) - 0.5)
    found = low_depth <= depth <= high_depth and level <= rim and centre <= 0.25 and close[-1] >= 0.9 * close[right]
    return bool(found), float(max(0.0, 1 - level / rim) * 0.5 + (1 - 2 * centre) * 0.5)


def cups(bars: DataFrame, size: int) -> DataFrame:
    """(symbol, date, found, score) at each bar that ends a full window of closes."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-(size - 1), 0)
    full = bars.withColumn("_w", F.collect_list("close").over(w)).filter(F.size("_w") == size).select("symbol", "date", "_w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [find_cup(np.array(x, float)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.float64())], ["symbol", "date", "found", "score"])

    return full.mapInArrow(run, "symbol string, date date, found boolean, score double")


def geometry_score(bars: DataFrame, keys: list[str], order: str, most: int = 180, least: int = 35, handle: int = 12) -> DataFrame:
    """Per key: points, correlation, smooth, handle and score of how much its last closes look like a round base with a flat handle.

    Half the correlation with a parabola (not below 0), three tenths smoothness (1 less eight times the mean change of slope) and two
    tenths flatness of the last `handle` closes (1 less two and a half times their range), of closes scaled to 0 to 1. Fewer than `least`
    closes score 0. Only the last `most` closes of a key are kept, so windows over a key are short.
    """
    known = bars.filter(F.col("close").isNotNull()).select(*keys, order, F.col("close").cast("double").alias("_c"))
    last = known.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter(F.col("_r") <= most)
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    low, high, n = F.min("_c").over(whole), F.max("_c").over(whole), F.count("*").over(whole)
    rows = last.withColumns({"_y": (F.col("_c") - low) / F.greatest(high - low, F.lit(1e-9)), "_n": n, "_x": -1 + 2 * (n - F.col("_r")) / F.greatest(n - 1, F.lit(1))})
    rows = rows.withColumn("_bend", F.abs(F.col("_y") - 2 * F.lag("_y").over(w) + F.lag("_y", 2).over(w)))
    tail = F.when(F.col("_r") <= F.when(F.col("_n") > handle, handle).otherwise(5), F.col("_y"))
    square = F.col("_x") * F.col("_x")
    # corr() itself fails on values without spread.
    corr = F.when(F.stddev_pop("_y") > 1e-9, F.covar_pop("_y", square) / F.nullif(F.stddev_pop("_y") * F.stddev_pop(square), F.lit(0.0))).otherwise(0.0)
    out = rows.groupBy(*keys).agg(F.count("*").alias("points"), F.coalesce(corr, F.lit(0.0)).alias("correlation"), (1 - F.avg("_bend") * 8).alias("smooth"), (1 - (F.max(tail) - F.min(tail)) * 2.5).alias("handle"))
    unit = lambda x: F.least(F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    out = out.withColumns({"smooth": unit("smooth"), "handle": unit("handle")})
    score = unit("correlation") * 0.5 + F.col("smooth") * 0.3 + F.col("handle") * 0.2
    return out.withColumn("score", F.when(F.col("points") >= least, score).otherwise(0.0))
