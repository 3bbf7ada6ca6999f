"""Reports and control-plane reads: funnels, contracts, leases, readiness, planners, nested evaluation, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf
from .aggregates import profit_factor
from .gates import reasons


def vwap_stats(bars: DataFrame, bucket: Column) -> DataFrame:
    """Per symbol, per session bucket, and over all: time above VWAP, crossings a bar, median and 90th percentile of the distance."""
    view = bars.withColumn("bucket", bucket)
    aggs = [F.count("*").alias("bars"), F.avg(F.col("above").cast("double")).alias("above_share"), F.avg(F.col("crossed").cast("double")).alias("chop"), F.percentile("distance_bps", F.lit(0.5)).alias("median_bps"), F.percentile(F.abs("distance_bps"), F.lit(0.9)).alias("p90_bps")]
    out = view.groupingSets([["symbol"], ["bucket"], []], "symbol", "bucket").agg(*aggs)
    return out.select(F.coalesce("symbol", F.lit("*")).alias("symbol"), F.coalesce("bucket", F.lit("*")).alias("bucket"), *[F.col(c) for c in ("bars", "above_share", "chop", "median_bps", "p90_bps")])


def overlay_metrics(ret: Column, oos: Column) -> list[Column]:
    q = lambda p: F.percentile(ret, F.lit(p))
    return [F.count("*").alias("n"), F.avg(ret).alias("mean"), profit_factor(ret).alias("pf"), q(0.1).alias("p10"), q(0.5).alias("median"), q(0.9).alias("p90"), F.avg(F.when(oos, ret)).alias("oos_mean"), F.avg(F.when(~oos, ret)).alias("is_mean")]


def funnel(stages: dict[str, Column]) -> list[Column]:
    """Counts of rows that meet each stage and all before it."""
    out, so_far = [], F.lit(True)
    for name, test in stages.items():
        so_far = so_far & F.coalesce(test, F.lit(False))
        out.append(F.count_if(so_far).alias(name))
    return out


def data_contract(bars: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Bars per key, whether they suffice, and a hash over them that doesn't depend on their order."""
    row = F.xxhash64(*[c for c in bars.columns])
    return bars.groupBy(*keys).agg(F.count("*").alias("bars"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("content_hash")).withColumn("enough", F.col("bars") >= least)


def leases(queue: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """What a reaper would do: expired items fail, lapsed leases go back to the queue or fail after too many attempts."""
    lapsed = (F.col("status") == "leased") & (F.col("lease_until") <= now)
    action = F.when((F.col("status") == "queued") & (F.col("expires_at") <= now), "expire").when(lapsed & (F.col("attempts") >= most_attempts), "fail").when(lapsed, "requeue").otherwise("keep")
    return queue.withColumn("action", action)


def claim(queue: DataFrame, now: Column, scope: str, n: int) -> DataFrame:
    """The next items of each scope by priority, then age."""
    ready = queue.filter((F.col("status") == "queued") & (F.col("expires_at") > now))
    w = Window.partitionBy(scope).orderBy(F.col("priority").desc(), "created_at", "id")
    return ready.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def readiness(json: Column, required: dict[str, str], stale: list[tuple[Column, str]]) -> list[Column]:
    """Names of required JSON paths that are missing, and of those that are stale."""
    missing = reasons([(F.get_json_object(json, path).isNull(), name) for name, path in required.items()])
    return [F.array_join(missing, ",").alias("missing"), F.array_join(reasons(stale), ",").alias("stale")]


def next_experiments(blockers: DataFrame, catalog: DataFrame, prohibited: DataFrame) -> DataFrame:
    """Catalogued experiments for the blockers found, most frequent first, less prohibited ones."""
    counts = blockers.groupBy("reason").agg(F.count("*").alias("n"))
    allowed = catalog.join(prohibited.select("experiment").distinct(), "experiment", "left_anti")
    return counts.join(allowed, "reason").select("reason", "experiment", "n")


def nested_optimization(df: DataFrame, fold: Column, variant: str, value: str) -> DataFrame:
    """Per outer fold the variant best over all other folds (no purge), its mean in the fold, and its relative rank there."""
    sums = df.groupBy(fold.alias("fold"), F.col(variant).alias("variant")).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    total = Window.partitionBy("variant")
    means = sums.withColumns({"inner": (F.sum("s").over(total) - F.col("s")) / F.nullif(F.sum("c").over(total) - F.col("c"), F.lit(0)), "outer": F.col("s") / F.col("c")})
    w = Window.partitionBy("fold")
    ranked = means.withColumns({"_k": F.row_number().over(w.orderBy(F.round("inner", 9).desc_nulls_last(), "variant")), "_r": F.rank().over(w.orderBy(F.round("outer", 9))), "_n": F.count("*").over(w)})
    return ranked.filter("_k = 1").select("fold", "variant", "outer", (F.col("_r") / (F.col("_n") + 1)).alias("relative_rank"))


def top_evidence(rows: DataFrame, group: str, score: str, key: str, groups: int, each: int) -> DataFrame:
    """The best rows of the best groups: groups by mean score, rows within them by score; both capped."""
    means = rows.groupBy(group).agg(F.avg(score).alias("_m"))
    best = means.withColumn("group_rank", F.row_number().over(Window.orderBy(F.round("_m", 9).desc(), group))).filter(F.col("group_rank") <= groups)
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), key)
    return rows.join(best, group).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each).drop("_m")


def agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Rand-type agreement of two clusterings from their contingency counts; no pairs of rows are made."""
    both = a.select(key, F.col(label).alias("_a")).join(b.select(key, F.col(label).alias("_b")), key)
    cells = both.groupBy("_a", "_b").agg(F.count("*").alias("n"))
    pairs = lambda x: x * (x - 1) / 2
    ab = cells.agg(F.sum(pairs(F.col("n"))).alias("ab"), F.sum("n").alias("n")).withColumn("_one", F.lit(1))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"p{c}")).withColumn("_one", F.lit(1))
    out = ab.join(side("_a"), "_one").join(side("_b"), "_one")
    return out.select("n", ((pairs(F.col("n")) + 2 * F.col("ab") - F.col("p_a") - F.col("p_b")) / pairs(F.col("n"))).alias("agreement"))


def obrien_fleming(t: Column, alpha: float = 0.05) -> Column:
    """Alpha spent at information share t by the O'Brien-Fleming type function."""
    from .shapes import normal_quantile

    return 2 - 2 * normal_cdf(F.lit(normal_quantile(1 - alpha / 2)) / F.sqrt(t))
