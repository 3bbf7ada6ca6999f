"""Evidence of models and events: calibration report, controls against targets, forward gains, window quotas, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import indexed


def cost_filter(df: DataFrame, cost: str, most: float | None) -> DataFrame:
    """Rows whose cost is at most `most`; None keeps all rows, and a null cost fails any bound."""
    return df if most is None else df.filter(F.col(cost) <= most)


def quotas(sizes: list[int], most: int) -> dict[int, int]:
    """How many of `most` windows each size gets: an even share, the rest one each to the sizes named first."""
    if not sizes:
        return {}
    share, rest = divmod(most, len(sizes))
    return {size: share + (i < rest) for i, size in enumerate(sizes)}


def windows_by_quota(bars: DataFrame, sizes: list[int], most: int, key: str = "symbol") -> DataFrame:
    """(key, size, possible, taken): the windows of each size that a key's bars hold, and how many its quota takes."""
    table = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(q).cast("long").alias("quota")) for s, q in quotas(sizes, most).items()])
    counts = bars.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_q", F.explode(table))
    possible = F.greatest(F.col("_n") - F.col("_q.size") + 1, F.lit(0))
    return counts.select(key, F.col("_q.size").alias("size"), possible.alias("possible"), F.least(possible, F.col("_q.quota")).alias("taken"))


def event_gain(bars: DataFrame, w, ahead: int, least: float, entry: str = "close") -> DataFrame:
    """Best gain of either side over the next bars from the entry price, its direction (ties: long), and whether it reaches `least`.

    Without a bar ahead the gains are 0, the direction is empty and the event fails.
    """
    frame = w.rowsBetween(1, ahead)
    price = F.greatest(F.col(entry), F.lit(1e-9))
    top, bottom = F.max("high").over(frame), F.greatest(F.min("low").over(frame), F.lit(1e-9))
    known = top.isNotNull() & F.min("low").over(frame).isNotNull()
    long, short = F.greatest(top / price - 1, F.lit(0.0)), F.greatest(1 - bottom / price, F.lit(0.0))
    out = bars.withColumns({"long_gain": F.when(known, long).otherwise(0.0), "short_gain": F.when(known, short).otherwise(0.0), "_known": known})
    gain = F.greatest("long_gain", "short_gain")
    direction = F.when(~F.col("_known"), "").when(F.col("long_gain") >= F.col("short_gain"), "long").otherwise("short")
    return out.withColumns({"gain": gain, "direction": direction, "passed": F.col("_known") & (gain >= max(0.0, least))}).drop("_known")


def control_against_target(rows: DataFrame, keys: list[str], value: str, target: Column, control: Column, family_passed: Column) -> DataFrame:
    """The best control must stay below the best target (either is 0 where there is none) and the family's test must have passed."""
    best = lambda c: F.coalesce(F.max(F.when(c, F.col(value))), F.lit(0.0))
    out = rows.groupBy(*keys).agg(best(target).alias("target_best"), best(control).alias("control_best"), F.coalesce(F.bool_and(family_passed), F.lit(False)).alias("_family"))
    failed = (F.col("control_best") >= F.col("target_best")) | ~F.col("_family")
    return out.withColumn("decision", F.when(failed, "STAT_BASELINE_FAIL").otherwise("STAT_BASELINE_PASS")).drop("_family")


def calibration_report(
    df: DataFrame, label: str, probability: str, order: list[str], weight: str | None = None, bins: int = 10, min_samples: int = 50, top_fraction: float = 0.10, min_top: int = 5,
    brier_max: float = 0.20, ece_max: float = 0.06, min_uplift: float = 0.08, rr: float = 4.0, cost_r: float = 0.0,
) -> DataFrame:
    """One row on probabilities of a binary label: Brier score, calibration error, uplift of the most probable, result beyond break-even, verdict.

    Sums by bin come first; the top fraction is found by counts of probability buckets, ties by `order`. A report is blocked, with
    its reason and no verdict in favour, by too few rows, labels that are not 0 or 1, probabilities that are null or outside 0..1,
    or weights that are null, negative or all zero. Averages over no rows are null.
    """
    rows = df.select(F.col(label).cast("double").alias("_y"), F.col(probability).cast("double").alias("_p"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    y, p, w = F.col("_y"), F.col("_p"), F.col("_w")
    fits = F.coalesce((p >= 0) & (p <= 1), F.lit(False))
    breakeven = (1 + cost_r) / (1 + rr)
    chosen = p >= breakeven
    sums = rows.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("_bin")).agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(y.isin(0.0, 1.0), F.lit(False))).alias("bad_y"), F.count_if(~fits).alias("bad_p"), F.count_if(~F.coalesce(w >= 0, F.lit(False))).alias("bad_w"), F.sum(w).alias("w"),
        F.sum(w * y).alias("wy"), F.sum(w * p).alias("wp"), F.sum(w * (p - y) * (p - y)).alias("sq"), F.count_if(chosen).alias("c"), F.sum(F.when(chosen, w)).alias("cw"), F.sum(F.when(chosen, w * y)).alias("cwy"),
    )
    add = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = sums.agg(*[add(c).alias(c) for c in ("n", "bad_y", "bad_p", "bad_w", "w", "wy", "sq", "c", "cw", "cwy")], F.sum(F.abs(F.col("wp") - F.col("wy"))).alias("gap"))
    placed = indexed(rows.withColumn("_bucket", -F.floor(F.coalesce(p, F.lit(-1.0)) * 1000)), [], "_bucket", [p.desc_nulls_last(), *[F.col(f"_o{i}") for i in range(len(order))], y.desc()], "_at")
    wanted = F.greatest(F.ceil(F.col("_at_of") * top_fraction), F.lit(1))
    top = placed.filter(F.col("_at") < wanted).agg(F.count("*").alias("top_count"), (F.sum(w * y) / F.nullif(F.sum(w), F.lit(0.0))).alias("top_rate"))
    both = total.withColumn("_one", F.lit(1)).join(top.withColumn("_one", F.lit(1)), "_one")
    mass = F.nullif(F.col("w"), F.lit(0.0))
    reason = F.when(F.col("n") < min_samples, "insufficient_samples").when(F.col("bad_y") > 0, "labels_must_be_binary").when(F.col("bad_p") > 0, "probabilities_must_be_finite_unit_interval").when((F.col("bad_w") > 0) | mass.isNull(), "sample_weight_invalid")
    out = both.select(
        F.col("n").alias("samples"), reason.alias("reason"), (F.col("sq") / mass).alias("brier"), (F.col("gap") / mass).alias("ece"), (F.col("wy") / mass).alias("base_rate"), "top_count", "top_rate",
        F.col("c").alias("selected"), (F.col("cwy") / F.nullif(F.col("cw"), F.lit(0.0))).alias("selected_rate"),
    )
    uplift = F.col("top_rate") - F.col("base_rate")
    gain = F.coalesce(F.col("selected_rate") * rr - (1 - F.col("selected_rate")) - cost_r, F.lit(0.0))
    good = (F.col("brier") <= brier_max) & (F.col("ece") <= ece_max) & (F.col("top_count") >= min_top) & (uplift >= min_uplift)
    return out.withColumns({"uplift": uplift, "selected_expectancy": gain, "passed": F.col("reason").isNull() & F.coalesce(good, F.lit(False))})


def scaled_for(vector: Column, centroid: Column, mean: Column, scale: Column) -> Column:
    """(vector - mean) / scale over as many components as the centroid has, a scale of 0 counting as 1.

    Null where the centroid is empty, another array is shorter, or a component in use is null or not finite.
    """
    n = F.size(centroid)
    head = [F.slice(F.transform(a, lambda x: x.cast("double")), 1, F.greatest(n, F.lit(0))) for a in (vector, centroid, mean, scale)]
    finite = lambda a: F.forall(a, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    fits = (n > 0) & (F.size(vector) >= n) & (F.size(mean) >= n) & (F.size(scale) >= n)
    for a in head:
        fits = fits & finite(a)
    centred = F.zip_with(head[0], head[2], lambda x, m: x - m)
    return F.when(fits, F.zip_with(centred, head[3], lambda d, s: d / F.when(s == 0, F.lit(1.0)).otherwise(s)))
