"""Trade metrics, concentration, rollups and summaries: map-side combinable aggregates, one shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profit_factor(ret: Column, no_loss: str = "null", weight: Column | None = None) -> Column:
    """Sum of gains over sum of losses. Without losses: 'null', 'gross' (the gains), or 'inf' (infinity; null without gains)."""
    w = F.lit(1.0) if weight is None else weight
    gain = F.coalesce(F.sum(F.when(ret > 0, ret * w)), F.lit(0.0))
    loss = F.coalesce(F.sum(F.when(ret < 0, -ret * w)), F.lit(0.0))
    empty = {"null": F.lit(None).cast("double"), "gross": gain, "inf": F.when(gain > 0, F.lit(float("inf")))}[no_loss]
    return F.when(loss > 0, gain / F.nullif(loss, F.lit(0.0))).otherwise(empty)


def trade_metrics(ret: Column, symbol: Column) -> list[Column]:
    return [
        F.count("*").alias("n"), F.countDistinct(symbol).alias("symbols"), F.avg(ret).alias("expectancy"), profit_factor(ret).alias("profit_factor"),
        F.avg((ret > 0).cast("double")).alias("winrate"), F.avg(F.when(ret > 0, ret)).alias("avg_win"), F.avg(F.when(ret < 0, ret)).alias("avg_loss"),
    ]


def distribution(x: Column, prefix: str = "") -> list[Column]:
    """Minimum, quartiles by linear interpolation (exact, not approximate), maximum."""
    q = lambda p: F.percentile(x, F.lit(p))
    return [F.min(x).alias(f"{prefix}min"), q(0.25).alias(f"{prefix}p25"), q(0.5).alias(f"{prefix}median"), q(0.75).alias(f"{prefix}p75"), F.max(x).alias(f"{prefix}max")]


def rollups(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """One pass over all single-key groupings: (kind, key, aggs)."""
    view = df.groupingSets([[F.col(k)] for k in keys], *keys).agg(*aggs, *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    kind, key = F.lit(None), F.lit(None)
    for k in keys:
        kind = F.when(F.col(f"_g_{k}") == 0, F.lit(k)).otherwise(kind)
        key = F.when(F.col(f"_g_{k}") == 0, F.col(k).cast("string")).otherwise(key)
    return view.withColumns({"kind": kind, "key": key}).drop(*keys, *[f"_g_{k}" for k in keys])


def contributions(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum by key, ranked by absolute size; ties by key."""
    sums = df.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.abs(F.round("total", 9)).desc(), key)))


def top_share(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    ranked = contributions(df, key, value)
    return ranked.agg((F.sum(F.when(F.col("rank") <= k, F.abs("total"))) / F.sum(F.abs("total"))).alias("top_share"))


def without_top(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """Mean without the k keys that contribute most."""
    ranked = contributions(df, key, value)
    rest = ranked.filter(F.col("rank") > k)
    return rest.agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def without_top_rows(df: DataFrame, group: str, value: str, order: list, k: int) -> DataFrame:
    """(group, mean, n) of each group's rows but for its first k in order; groups of no more rows are left out.

    The first k are found within each task and then merged, and are taken off the sums of all, so that no task orders a group.
    """
    first = df.select("*").withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_k") <= k)
    sums = lambda d, x: d.groupBy(group).agg(F.sum(value).alias(f"_s{x}"), F.count(value).alias(f"_v{x}"), F.count("*").alias(f"_n{x}"))
    both = sums(df, 0).join(sums(first, 1).withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).filter("_n0 > _n1")
    rest = F.col("_s0") - F.coalesce("_s1", F.lit(0.0))
    return both.select(group, F.when(F.col("_v0") > F.col("_v1"), rest / (F.col("_v0") - F.col("_v1"))).alias("mean"), (F.col("_n0") - F.col("_n1")).alias("n"))


def herfindahl(df: DataFrame, group: str, key: str) -> DataFrame:
    counts = df.groupBy(group, key).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("share", share).groupBy(group).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("max_share"), F.max_by(key, F.struct("n", key)).alias("largest"))


def effective_sample(df: DataFrame, cluster: list[str]) -> DataFrame:
    """Weights 1 / cluster size: their sum, and Kish's effective size."""
    sizes = df.groupBy(*cluster).agg(F.count("*").alias("c"))
    # A cluster of c rows has c weights of 1 / c: sum 1, sum of squares 1 / c.
    return sizes.agg(F.sum("c").alias("n"), F.count("*").cast("double").alias("n_eff"), (F.count("*") * F.count("*") / F.sum(1 / F.col("c"))).alias("kish"))


def calibration(df: DataFrame, p: str, outcome: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins (the last one closed) and the Brier score."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(outcome).alias("obs"), F.sum((F.col(p) - F.col(outcome)) ** 2).alias("sq"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("obs"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), F.sum("n").alias("n"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and distinct values of each column, as rows."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns], *[F.countDistinct(c).alias(f"d_{c}") for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distincts")) for c in columns])))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles by key, interpolated linearly between neighbours; nulls don't count.

    Values are counted, so equal ones are one row; counts by the leading digits of their order add up to each stretch's first place,
    and only stretches that hold a wanted place are ordered: no task holds a key's values.
    """
    v = F.col(value).cast("double")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_c"))
    # A stretch: values alike in sign, size and their first three digits or so.
    size = F.floor(F.log2(F.greatest(F.abs("_v"), F.lit(1e-300))))
    place = F.when(F.isnan("_v"), 1e9).when(F.abs("_v") < 1e-300, 0.0).when(F.abs("_v") == float("inf"), F.signum("_v") * 1e8)
    counts = counts.withColumn("_stretch", place.otherwise(F.signum("_v") * (1e5 + size + F.floor((F.abs("_v") / F.pow(F.lit(2.0), size) - 1) * 1024) / 2048)))
    w = Window.partitionBy(*keys)
    stretches = counts.groupBy(*keys, "_stretch").agg(F.sum("_c").alias("_in"))
    stretches = stretches.withColumns({"_to": F.sum("_in").over(w.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_in").over(w)})
    asked = F.array(*[F.struct(F.lit(n).alias("_name"), ((F.col("_n") - 1) * q).alias("_at")) for n, q in shares.items()])
    # A quantile's two neighbours may stand in two stretches.
    wanted = stretches.select("*", F.inline(asked)).filter((F.floor("_at") < F.col("_to")) & (F.ceil("_at") >= F.col("_to") - F.col("_in")))
    held = counts.join(wanted.select(*keys, "_stretch").distinct(), [*keys, "_stretch"])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_stretch").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = held.withColumn("_upto", upto).join(wanted, [*keys, "_stretch"]).withColumn("_last", F.col("_to") - F.col("_in") + F.col("_upto"))
    at = lambda i: F.max(F.when((i < F.col("_last")) & (i >= F.col("_last") - F.col("_c")), F.col("_v")))
    found = placed.groupBy(*keys, "_name").agg(at(F.floor("_at")).alias("_low"), at(F.ceil("_at")).alias("_high"), F.first("_at").alias("_at"))
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, between)).alias(n) for n in shares])


def feature_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, median and quartiles of each feature that every row has."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])))
    out = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.count("v").alias("n"), F.count("*").alias("_all")).filter("n = _all")
    return out.join(quantiles(long, ["feature"], "v", {"median": 0.5, "p25": 0.25, "p75": 0.75}), "feature").select("feature", "mean", "median", "p25", "p75", "n")


def bucket_table(df: DataFrame, required: DataFrame, bucket: str, aggs: list[Column]) -> DataFrame:
    """Aggregates of each required bucket; those without rows stay, with nulls and zero counts."""
    return required.join(df.groupBy(bucket).agg(*aggs, F.count("*").alias("n")), bucket, "left").fillna(0, ["n"])
