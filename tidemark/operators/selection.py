"""Selection under many trials: inference over a run, tests of the best of a family, novelty against better peers, adversarial probes."""

from __future__ import annotations

from math import e

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, normal_quantile
from .inference import benjamini_hochberg
from .ranking import indexed

EULER = 0.5772156649015329
#: Days that a task holds of a family, and members.
DAYS, MEMBERS = 512, 256
#: Blocks of a family's vectors, and numbers that a block holds at most.
BLOCKS, NUMBERS = 12, 1 << 22


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def run_inference(candidates: DataFrame, run: str, key: str, q: float = 0.05, prior: int = 0) -> DataFrame:
    """Candidates plus fdr_passed, fdr_cutoff, fdr_tests, n_trials, sr_std, sr_star and dsr: what a run's many trials leave of each.

    candidates: p_value, window, variants, sr, n_eff, skew, kurt; key is unique within a run. Step-up of the p-values (taken into 0 to
    1; those not finite take no part and pass nothing) over all candidates of the run; all p at or below the cutoff pass, ties too. A
    run's trials are the most variants of each window, summed, and `prior` ones. The Sharpe ratio is held against the best that so
    many trials yield by chance, by the spread of the run's ratios (of three at least, else the ratio is held against 0).
    Nulls: no variants are 1, no sr or skew 0, no kurt 3; without more than one effective trade there is no dsr.
    """
    tested = candidates.select(run, key, F.when(finite("p_value").isNotNull(), F.least(F.greatest(finite("p_value"), F.lit(0.0)), F.lit(1.0))).alias("_p")).filter("_p IS NOT NULL")
    stepped = benjamini_hochberg(tested, [run], "_p", key, q).select(run, key, "_p", "rejected")
    cutoffs = stepped.groupBy(run).agg(F.max(F.when(F.col("rejected"), F.col("_p"))).alias("fdr_cutoff"), F.count("*").alias("fdr_tests"))
    sr = F.coalesce(finite("sr"), F.lit(0.0))
    by_window = candidates.groupBy(run, "window").agg(F.greatest(F.max(F.coalesce(F.nullif(F.col("variants"), F.lit(0)), F.lit(1))), F.lit(0)).alias("_t"))
    spread = candidates.groupBy(run).agg(F.when(F.count("*") >= 3, F.stddev_samp(sr)).otherwise(0.0).alias("sr_std"))
    trials = by_window.groupBy(run).agg(F.greatest(F.lit(1), F.sum("_t") + prior).cast("long").alias("n_trials"))
    out = candidates.join(trials.join(spread, run), run).join(cutoffs, run, "left").join(stepped.drop("_p"), [run, key], "left")
    out = out.withColumn("_n", F.col("n_trials").cast("double")).withColumns({"_p1": 1 - 1 / F.col("_n"), "_p2": 1 - 1 / (F.col("_n") * e)})
    chance = F.col("sr_std") * ((1 - EULER) * normal_quantile("_p1") + EULER * normal_quantile("_p2"))
    out = out.withColumn("sr_star", F.when((F.col("n_trials") > 1) & (F.col("sr_std") > 0) & (F.col("n_eff") > 1), chance).otherwise(0.0))
    skew, kurt = F.coalesce(finite("skew"), F.lit(0.0)), F.coalesce(F.nullif(finite("kurt"), F.lit(0.0)), F.lit(3.0))
    width = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    dsr = F.when((F.col("n_eff") > 1) & (width > 0), normal_cdf((sr - F.col("sr_star")) * F.sqrt(F.col("n_eff") - 1) / F.sqrt(width)))
    return out.withColumns({"dsr": dsr, "fdr_passed": F.coalesce("rejected", F.lit(False)), "fdr_tests": F.coalesce("fdr_tests", F.lit(0))}).drop("_n", "_p1", "_p2", "rejected")


def block_weights(periods: int, draw: int, block: float, seed: int) -> np.ndarray:
    """How often one draw of the stationary bootstrap takes each period: runs of geometric length from uniform starts, in a circle, to `periods` in all."""
    rng = np.random.default_rng([seed, draw, periods])
    lengths = np.zeros(0, np.int64)
    while lengths.sum() < periods:
        lengths = np.concatenate([lengths, rng.geometric(1 / block, int(periods / block) + 16)])
    ends = np.minimum(np.cumsum(lengths), periods)
    lengths = np.diff(ends, prepend=0)
    starts = rng.integers(0, periods, len(lengths))
    change = np.bincount(starts, minlength=2 * periods + 1) - np.bincount(starts + lengths, minlength=2 * periods + 1)
    taken = np.cumsum(change)[: 2 * periods]
    return (taken[:periods] + taken[periods:]).astype(float)


def superior_ability(rows: DataFrame, family: str, member: str, period: str, value: str, draws: int = 500, block: float | None = None, seed: int = 0) -> DataFrame:
    """Per family: periods, members, best, best_mean, best_t, p_lower, p_consistent, p_upper: whether its best member beats 0.

    The t of the best mean is held against resampled worlds in which means are recentred: all of them (upper), those that are not
    far below 0 (consistent: t of at least -sqrt(2 ln ln n)), or only those above 0 (lower). Periods are resampled in blocks (mean
    length: the cube root of their number, at least 5) with the same weights for all members of a family. Values of one member and
    period add up, and a period without a row counts 0. Families of under five periods, and nulls, are left out.

    Members are summed by period first, periods are numbered by family and cut into pieces of DAYS; a task holds DAYS x MEMBERS sums
    and yields one row a member and draw.
    """
    sums = rows.dropna(subset=[family, member, period, value]).groupBy(family, member, period).agg(F.sum(value).cast("double").alias("_x"))
    numbered = indexed(sums.select(family, period).distinct(), [family], period, [period], "_t")
    numbered = numbered.filter(F.col("_t_of") >= 5)
    placed = sums.join(numbered, [family, period]).withColumns({"_piece": F.floor(F.col("_t") / DAYS), "_part": F.col(member).cast("string")})
    members = sums.groupBy(family).agg(F.approx_count_distinct(member).alias("_m"))
    placed = placed.join(members, family).withColumn("_slice", F.pmod(F.xxhash64("_part"), F.ceil(F.col("_m") * 2 / MEMBERS)))
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        n, piece = table["_t_of"][0].as_py(), table["_piece"][0].as_py()
        names = table[member].combine_chunks().dictionary_encode()
        x = np.zeros((min(DAYS, n - piece * DAYS), len(names.dictionary)))
        np.add.at(x, (table["_t"].to_numpy() - piece * DAYS, names.indices.to_numpy()), table["_x"].to_numpy())
        size = block or max(5, round(n ** (1 / 3)))
        w = np.stack([block_weights(n, d, size, seed)[piece * DAYS : piece * DAYS + len(x)] for d in range(draws)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(x.shape[1] + 1) * draws, pa.int32()), pa.array((w @ x).T.ravel()))
        whole = pa.array([table[family][0].as_py()] * x.shape[1], table.schema.field(family).type)
        return pa.table([whole, names.dictionary, lists], names=[family, member, "_sums"])

    view = placed.select(family, member, "_x", "_t", "_t_of", "_piece", "_slice")
    parts = view.groupBy(family, "_piece", "_slice").applyInArrow(run, f"`{family}` {kinds[family]}, `{member}` {kinds[member]}, _sums array<double>")
    worlds = parts.select(family, member, F.posexplode("_sums").alias("draw", "_s")).groupBy(family, member, "draw").agg(F.sum("_s").alias("_s"))
    n = F.col("_n")
    stats = sums.join(numbered.groupBy(family).agg(F.max("_t_of").cast("double").alias("_n")), family).groupBy(family, member).agg(F.max("_n").alias("_n"), F.sum("_x").alias("_sum"), F.sum(F.col("_x") * F.col("_x")).alias("_ss"))
    mean = F.col("_sum") / n
    stats = stats.withColumns({"_mean": mean, "_scale": F.greatest(F.sqrt(F.greatest((F.col("_ss") - n * mean * mean) / (n - 1), F.lit(0.0))), F.lit(1e-12))}).withColumn("_t", F.sqrt(n) * F.col("_mean") / F.col("_scale"))
    kept = F.when(F.col("_t") >= -F.sqrt(2 * F.log(F.log(n))), F.col("_mean")).otherwise(0.0)
    centre = {"lower": F.greatest(F.col("_mean"), F.lit(0.0)), "consistent": kept, "upper": F.col("_mean")}
    joined = worlds.join(stats, [family, member])
    best = joined.groupBy(family, "draw").agg(*[F.max(F.sqrt(n) * (F.col("_s") / n - c) / F.col("_scale")).alias(f"_{k}") for k, c in centre.items()])
    own = stats.groupBy(family).agg(F.max("_n").cast("long").alias("periods"), F.count("*").alias("members"), F.max(F.struct("_t", "_mean", F.col(member))).alias("_best"))
    floor = lambda k: F.col("_best._t") if k == "upper" else F.greatest(F.col("_best._t"), F.lit(0.0))
    counts = best.join(own, family).groupBy(family).agg(*[((F.count_if(F.col(f"_{k}") >= floor(k)) + 1) / (F.count("*") + 1)).alias(f"p_{k}") for k in centre])
    return own.join(counts, family).select(family, "periods", "members", F.col(f"_best.{member}").alias("best"), F.col("_best._mean").alias("best_mean"), F.col("_best._t").alias("best_t"), *[f"p_{k}" for k in centre])


def _placed(vectors: DataFrame, family: list[str], key: str, score: str, vector: str, block: int) -> DataFrame:
    """Rows with known vectors (`_v`) by family and length: `_rank` by falling score, then key, and `_block` of `_blocks` stretches of ranks."""
    # Floats are sent as they are, in half the bytes.
    v = F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.transform(vector, lambda x: x.cast("double"))
    known = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)
    rows = vectors.filter(known).select(*family, key, score, v.alias("_v"), F.size(vector).alias("_size"), (-F.floor(F.coalesce(F.col(score), F.lit(0.0)) * 1000)).alias("_grade"))
    placed = indexed(rows, [*family, "_size"], "_grade", [F.col(score).desc_nulls_last(), F.col(key)], "_rank")
    size = F.greatest(F.lit(1), F.least(F.greatest(F.lit(block), F.ceil(F.col("_rank_of") / BLOCKS)), F.floor(NUMBERS / F.col("_size"))))
    return placed.withColumns({"_block": F.floor(F.col("_rank") / size).cast("int"), "_blocks": F.ceil(F.col("_rank_of") / size).cast("int")})


def _nearest(x: np.ndarray, rank: np.ndarray, y: np.ndarray, other: np.ndarray, rows: int = 256, held: int = 2048) -> np.ndarray:
    """Each x's distance to the nearest y of smaller rank; infinite without one.

    Both are taken in stretches by norm. A stretch of x meets those of y by the gap between their norms, up to the gap beyond which
    no distance can be smaller. Squared distances from products choose the rows that may be nearest, within the products' rounding;
    those are then measured exactly.
    """
    near, xs, ys = np.full(len(x), np.inf), (x * x).sum(axis=1), (y * y).sum(axis=1)
    if not np.isfinite(4 * xs).all() or not np.isfinite(4 * ys).all():
        for i, row in enumerate(x):
            near[i] = np.sqrt(((y[other < rank[i]] - row) ** 2).sum(axis=1)).min(initial=np.inf)
        return near
    # Of equal y's the one of smallest rank stands for all.
    order = np.argsort(other)
    order = order[np.unique(y[order].view(f"V{y.itemsize * y.shape[1]}").ravel(), return_index=True)[1]]
    places, order = np.argsort(xs, kind="stable"), order[np.argsort(ys[order], kind="stable")]
    x, xs, rank, y, ys, other = x[places], xs[places], rank[places], y[order], ys[order], other[order]
    to = [slice(i, min(i + held, len(y))) for i in range(0, len(y), held)]
    low, high, first = (np.array([f(c[t]) for t in to]) for f, c in ((np.min, np.sqrt(ys)), (np.max, np.sqrt(ys)), (np.min, other)))
    # One product yields |y|^2 - 2xy.
    left, right = np.column_stack([-2 * x, np.ones(len(x))]), np.column_stack([y, ys]).T
    room = 4 * right.shape[0] * np.finfo(float).eps * (xs + ys.max(initial=0))
    for at in range(0, len(x), rows):
        some = slice(at, min(at + rows, len(x)))
        best, last, norms = np.full(some.stop - at, np.inf), rank[some].max(), np.sqrt(xs[[at, some.stop - 1]])
        gaps = np.maximum(np.maximum(low - norms[1], norms[0] - high), 0) - 1e-9 * (norms[1] + high)
        for k in np.argsort(gaps, kind="stable"):
            if gaps[k] > best.max():
                break
            if first[k] >= last:
                continue
            squares = left[some] @ right[:, to[k]]
            if other[to[k]].max() >= rank[some].min():
                squares[other[None, to[k]] >= rank[some, None]] = np.inf
            found = squares.argmin(axis=1)
            least = squares[np.arange(len(found)), found]
            better = np.flatnonzero(np.isfinite(least) & (best > 0) & (least + xs[some] <= best * best + room[some]))
            best[better] = np.minimum(best[better], np.sqrt(((x[at + better] - y[to[k].start + found[better]]) ** 2).sum(axis=1)))
            better = better[best[better] > 0]
            may = squares[better] <= (least + room[some])[better, None]
            for i in np.flatnonzero(may.sum(axis=1) > 1):
                best[better[i]] = min(best[better[i]], np.sqrt(((y[to[k]][may[i]] - x[at + better[i]]) ** 2).sum(axis=1)).min())
        near[places[some]] = best
    return near


def nearest_better(vectors: DataFrame, family: list[str], key: str, score: str, vector: str, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(key, nearest: distance to the nearest of the family's rows before it by score, then key), and the pairs of blocks that meet.

    A family's rows are cut by score into BLOCKS blocks (fewer if they would have under `block` rows), and a task holds each block
    against one that isn't after it. So a row is sent BLOCKS times, however many rows there are, until a block has NUMBERS numbers;
    from there on blocks keep their size and become more. The products themselves stay quadratic in a family's rows. Rows of other
    lengths don't compare; a row without peers, or with a null or non-finite component, has no nearest. The family's columns must not
    be null.
    """
    kinds = dict(vectors.dtypes)
    pair = [*family, "_size", "_late", "_early"]
    met = _placed(vectors, family, key, score, vector, block).withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select(*family, key, "_v", "_size", "_rank", "_block", F.greatest("_block", "_met").alias("_late"), F.least("_block", "_met").alias("_early"))

    def run(table: pa.Table) -> pa.Table:
        x = table["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        rank, at = table["_rank"].to_numpy(), table["_block"].to_numpy()
        late, early = np.flatnonzero(at == table["_late"][0].as_py()), np.flatnonzero(at == table["_early"][0].as_py())
        near = _nearest(x[late], rank[late], x[early], rank[early])
        some = np.isfinite(near)
        return table.select([*family, key]).take(pa.array(late[some])).append_column("_near", pa.array(near[some]))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*family, key]) + ", _near double"
    best = met.groupBy(*pair).applyInArrow(run, schema).groupBy(*family, key).agg(F.min("_near").alias("nearest"))
    return vectors.select(*family, key).join(best, [*family, key], "left"), met.select(*pair).distinct()


def novelty(candidates: DataFrame, family: list[str], key: str, score: str, vector: str, quality: Column, bonus: Column, samples: Column, bucket: list[str], block: int = 512) -> DataFrame:
    """Candidates plus similarity (to the most alike better peer), novelty, gain, bucket_rank and adjusted_score.

    Similarity is 1 / (1 + distance / sqrt(dimension)), 0 without a better peer. The expected gain is novelty times quality and bonus
    times min(1, 10 / sqrt(samples)). Within a bucket candidates are ranked by score, then key, and lose 0.12 a place beyond the third,
    at most 0.45; the adjusted score keeps 78% for what isn't new, adds 6% of the gain and 3% of the bonus, is rounded to five places and not below 0.
    """
    near, _ = nearest_better(candidates, family, key, score, vector, block)
    root = F.greatest(F.lit(1.0), F.sqrt(F.size(vector)))
    out = candidates.withColumns({"_quality": quality, "_bonus": bonus, "_samples": samples, "_root": root}).join(near, [*family, key])
    alike = F.coalesce(1 / (1 + F.col("nearest") / F.col("_root")), F.lit(0.0))
    out = out.withColumn("similarity", alike).withColumn("novelty", F.least(F.greatest(1 - F.col("similarity"), F.lit(0.0)), F.lit(1.0)))
    out = out.withColumn("gain", F.col("novelty") * (F.col("_quality") + F.col("_bonus")) * F.least(F.lit(1.0), 10 / F.sqrt(F.greatest(F.col("_samples"), F.lit(1)))))
    out = indexed(out.withColumn("_grade", -F.floor(F.coalesce(F.col(score), F.lit(0.0)) * 1000)), bucket, "_grade", [F.col(score).desc_nulls_last(), F.col(key)], "_at")
    penalty = F.least(F.lit(0.45), F.greatest(F.lit(0), F.col("_at") - 2) * 0.12)
    adjusted = F.col(score) * (0.78 + 0.22 * F.col("novelty")) * (1 - penalty) + F.col("gain") * 0.06 + F.col("_bonus") * 0.03
    return out.withColumns({"bucket_rank": F.col("_at") + 1, "adjusted_score": F.round(F.greatest(F.lit(0.0), adjusted), 5)}).select(*candidates.columns, "similarity", "novelty", "gain", "bucket_rank", "adjusted_score")


def probes(trades: DataFrame, pattern: str, symbol: str, day: str, ret: str, cost: str, opposite: str, stress: float = 2.0, least: float = 0.55) -> DataFrame:
    """Per pattern: expectancy, the score and hard failure of each adversarial probe, challenge_score, challenge_passed and failures.

    universe: without the symbol of most trades (the first by name, if several); date: halves of the trades by day, the worse one and
    their gap; cost: after costs once and `stress` times; opposite: what the other side would have earned. All come from one table of
    counts and sums by symbol and by day, so a shock is a difference of sums. Trades without pattern, symbol, day or return are left
    out; no cost or opposite is 0. A day that holds the middle counts in both halves, by its mean.
    """
    known = trades.dropna(subset=[pattern, symbol, day, ret]).select(
        F.col(pattern), F.col(symbol).alias("_symbol"), F.col(day).alias("_day"), F.col(ret).cast("double").alias("_r"), F.coalesce(F.col(cost).cast("double"), F.lit(0.0)).alias("_c"), F.coalesce(F.col(opposite).cast("double"), F.lit(0.0)).alias("_o")
    )
    cells = known.groupingSets([[F.col(pattern), F.col("_symbol")], [F.col(pattern), F.col("_day")]], pattern, "_symbol", "_day")
    cells = cells.agg(F.count("*").alias("n"), F.sum("_r").alias("s"), F.sum("_c").alias("c"), F.sum("_o").alias("o"))
    by_day = F.col("_day").isNotNull()
    w = Window.partitionBy(pattern, by_day)
    cells = cells.withColumns({"_before": F.coalesce(F.sum("n").over(w.orderBy("_day", "_symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("n").over(w)})
    half = F.ceil(F.col("_all") / 2)
    early = F.least(F.greatest(half - F.col("_before"), F.lit(0)), F.col("n"))
    a = cells.groupBy(pattern).agg(
        F.sum(F.when(by_day, F.col("n"))).alias("n"), F.sum(F.when(by_day, F.col("s"))).alias("s"), F.sum(F.when(by_day, F.col("c"))).alias("c"), F.sum(F.when(by_day, F.col("o"))).alias("o"), F.max(half).alias("_half"),
        F.sum(F.when(by_day, F.col("s") * early / F.col("n"))).alias("_first"), F.count_if(~by_day).alias("symbols"), F.min(F.when(~by_day, F.struct((-F.col("n")).alias("n"), F.col("_symbol").alias("name"), F.col("s").alias("s")))).alias("_top"),
    )
    left = F.col("n") + F.col("_top.n")
    a = a.withColumns({
        "expectancy": F.col("s") / F.col("n"), "without_top": F.when((F.col("symbols") > 1) & (left >= 3), (F.col("s") - F.col("_top.s")) / left),
        "first_half": F.col("_first") / F.col("_half"), "second_half": F.try_divide(F.col("s") - F.col("_first"), F.col("n") - F.col("_half")), "replayed": (F.col("s") - F.col("c")) / F.col("n"), "stressed": (F.col("s") - stress * F.col("c")) / F.col("n"),
    }).withColumns({"_worst": F.least("first_half", "second_half"), "_ratio": F.col("o") / F.col("n") / F.greatest(F.abs(F.col("expectancy")), F.lit(0.10))})
    short = lambda x: F.when(x > 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 + x / 0.5))
    score = {
        "universe": F.when(F.col("symbols") <= 1, 0.0).when(left < 3, 0.10).otherwise(short(F.col("without_top"))),
        "date": F.when(F.col("n") < 8, 0.55).otherwise(short(F.col("_worst")) * (1 - F.least(F.lit(0.5), F.abs(F.col("first_half") - F.col("second_half")) / 2))),
        "cost": F.when(F.col("stressed") > 0, 0.5).otherwise(0.0) + F.when(F.col("replayed") > 0, 0.5).otherwise(0.0),
        "opposite": 1 - F.least(F.greatest(F.col("_ratio"), F.lit(0.0)), F.lit(1.0)),
    }
    out = a.withColumns({f"{k}_score": F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 5) for k, x in score.items()})
    hard = {
        "universe": (F.col("symbols") <= 1) | (left < 3) | ((F.col("without_top") <= 0) & (F.col("expectancy") > 0)), "date": (F.col("n") >= 8) & (F.col("_worst") <= -0.10),
        "cost": F.col("cost_score") <= 0, "opposite": (F.col("_ratio") >= 1) & (F.col("o") > 0),
    }
    mean = sum((F.col(f"{k}_score") for k in score), F.lit(0.0)) / len(score)
    failures = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for k, x in hard.items()]))
    out = out.withColumns({"challenge_score": mean, "failures": failures})
    return out.select(pattern, "n", "expectancy", F.col("_top.name").alias("top_symbol"), "without_top", "first_half", "second_half", "stressed", *[f"{k}_score" for k in score], "challenge_score", ((F.col("challenge_score") >= least) & (F.size("failures") == 0)).alias("challenge_passed"), "failures")


def leakage_probe(samples: DataFrame, pattern: str, vector: str, outcome: str) -> DataFrame:
    """Per pattern: n, the largest correlation (of either sign) of a component with the outcome, score and hard failure.

    Sums by pattern and component merge map-side. Components without spread have no correlation; under eight samples the score is 0.65.
    """
    each = samples.filter(F.col(outcome).isNotNull()).select(pattern, F.col(outcome).cast("double").alias("y"), F.posexplode(vector).alias("d", "x")).withColumn("x", F.coalesce(F.nanvl(F.col("x").cast("double"), F.lit(0.0)), F.lit(0.0)))
    n = samples.filter(F.col(outcome).isNotNull()).groupBy(pattern).agg(F.count("*").alias("n"))
    spread = lambda c: F.stddev_pop(c) > 1e-12
    # corr() itself fails on values without spread.
    corr = F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))
    most = each.groupBy(pattern, "d").agg(F.when(spread("x") & spread("y"), F.abs(corr)).alias("r")).groupBy(pattern).agg(F.coalesce(F.max("r"), F.lit(0.0)).alias("most"))
    score = F.when(F.col("n") < 8, 0.65).otherwise(1 - F.least(F.greatest((F.col("most") - 0.55) / 0.40, F.lit(0.0)), F.lit(1.0)))
    return n.join(most, pattern).withColumns({"score": F.round(score, 5), "hard_fail": (F.col("most") >= 0.92) & (F.col("n") >= 20)})

