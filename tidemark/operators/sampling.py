"""Window sampling, forward outcomes, matched samples, splits and sequential evidence."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import indexed, running, tile
from .windows import by


def windows(bars: DataFrame, size: int, stride: int, forward: int) -> DataFrame:
    """Every stride-th bar that ends a full window and has a full future: excursions and horizon return of a long entry at its close."""
    w = by()
    ahead = w.rowsBetween(1, forward)
    out = bars.withColumns({
        "n": F.row_number().over(w), "future": F.count("close").over(ahead), "mfe": F.max("high").over(ahead) / F.col("close") - 1, "mae": F.min("low").over(ahead) / F.col("close") - 1,
        "horizon_return": F.lead("close", forward).over(w) / F.col("close") - 1, "window_start": F.lag("date", size - 1).over(w),
    })
    return out.filter((F.col("n") >= size) & ((F.col("n") - size) % stride == 0) & (F.col("future") == forward))


def first_touch(bars: DataFrame, stop: float, target: float, forward: int) -> DataFrame:
    """Which of two levels about the close is touched first within the next bars; the stop wins a tie."""
    w = by()
    path = bars.withColumn("_p", F.collect_list(F.struct("high", "low")).over(w.rowsBetween(1, forward)))
    at = lambda test: F.array_position(F.transform("_p", test), True)
    s, t = at(lambda b: b["low"] <= F.col("close") * (1 - stop)), at(lambda b: b["high"] >= F.col("close") * (1 + target))
    out = path.withColumns({"_s": s, "_t": t})
    return out.withColumn("touch", F.when((F.col("_s") > 0) & ((F.col("_t") == 0) | (F.col("_s") <= F.col("_t"))), "stop").when(F.col("_t") > 0, "target").otherwise("none")).drop("_p", "_s", "_t")


def resample_linear(values: Column, length: int) -> Column:
    """An array interpolated to a fixed length, ends included."""

    def at(i: Column) -> Column:
        x = i * (F.size(values) - 1) / (length - 1)
        low = F.floor(x).cast("int")
        a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, F.size(values)))
        return a + (b - a) * (x - low)

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def winsorize(df: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """value clipped to its key's quantiles, and the z-score of the clipped value (population deviation; 0 without spread)."""
    cuts = df.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("_l"), F.percentile(value, F.lit(high)).alias("_h"))
    clipped = df.join(cuts, keys).withColumn("clipped", F.least(F.greatest(F.col(value), F.col("_l")), F.col("_h"))).drop("_l", "_h")
    w = Window.partitionBy(*keys)
    spread = F.stddev_pop("clipped").over(w)
    return clipped.withColumn("z", F.when(spread > 0, (F.col("clipped") - F.avg("clipped").over(w)) / spread).otherwise(0.0))


def evenly_matched(base: DataFrame, pool: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key min(base count, pool count) rows of the pool at evenly spaced places floor(i * n / take)."""
    wanted = base.groupBy(*keys).agg(F.count("*").alias("_want"))
    w = Window.partitionBy(*keys)
    rows = pool.join(wanted, keys).withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    take = F.least("_want", "_n")
    # Place i of n is taken if some j has floor(j * n / take) = i.
    j = F.ceil(F.col("_i") * take / F.col("_n"))
    return rows.filter((j < take) & (F.floor(j * F.col("_n") / take) == F.col("_i"))).drop("_want", "_i", "_n")


def cpcv(df: DataFrame, order: list[str], start: str, end: str, groups: int, tested: int) -> DataFrame:
    """Combinatorial purged splits: rows of each split that train and test; training rows overlap no test group's span.

    Rows are counted by group and day span first; the splits join those counts.
    """
    parts = indexed(df, [], start, order).withColumn("grp", tile(F.col("index"), F.col("index_of"), groups) - 1)
    spans = parts.groupBy("grp").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.count("*").alias("n"))
    rows = parts.groupBy("grp", start, end).agg(F.count("*").alias("c"))
    table = df.sparkSession.createDataFrame([(i, g) for i, chosen in enumerate(combinations(range(groups), tested)) for g in chosen], "split int, grp int")
    tests = table.join(spans, "grp").groupBy("split").agg(F.collect_list(F.struct("s", "e")).alias("spans"), F.collect_list("grp").alias("grps"), F.sum("n").alias("n_test"))
    purged = F.exists("spans", lambda x: (F.col(start) <= x["e"]) & (F.col(end) >= x["s"]))
    # tests has one row a split: a parameter table.
    joined = rows.join(F.broadcast(tests), ~F.array_contains("grps", F.col("grp")))
    trained = joined.filter(~purged).groupBy("split").agg(F.sum("c").alias("n_train"))
    return tests.join(trained, "split", "left").select("split", F.coalesce("n_train", F.lit(0)).alias("n_train"), "n_test")


def mixture_sprt(df: DataFrame, keys: list[str], order: list[str], value: str, sigma: float, tau: float) -> DataFrame:
    """Running log Bayes factor of a normal mixture over the mean against zero, and where it is highest."""
    n, s = F.col("_count"), F.col("_sum")
    v, t = sigma**2, tau**2
    known = running(df, keys, order, {"_count": F.col(value).isNotNull().cast("long"), "_sum": F.col(value)})
    out = known.withColumns({"n": n, "log_bf": 0.5 * F.log(v / (v + n * t)) + t * s * s / (2 * v * (v + n * t))})
    return out.groupBy(*keys).agg(F.max("log_bf").alias("max_log_bf"), F.max_by("log_bf", "n").alias("last_log_bf"))


def posterior_edge(df: DataFrame, keys: list[str], value: str, prior_mean: float, prior_sd: float) -> DataFrame:
    """Conjugate normal posterior of the mean with the sample's variance."""
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    precision = 1 / prior_sd**2 + F.col("n") / F.col("v")
    return s.select(*keys, "n", ((prior_mean / prior_sd**2 + F.col("n") * F.col("m") / F.col("v")) / precision).alias("posterior_mean"), F.sqrt(1 / precision).alias("posterior_sd"))


def spend(t: Column, alpha: float = 0.05) -> dict[str, Column]:
    """Alpha spent at information share t: linear, and Pocock's log form."""
    return {"linear": alpha * t, "pocock": alpha * F.log(1 + (float(2.718281828459045) - 1) * t)}


def segment_returns(bars: DataFrame, offsets: list[int]) -> DataFrame:
    """Returns from the next open to the close of each offset, as rows."""
    w = by()
    entry = F.lead("open", 1).over(w)
    cols = [F.struct(F.lit(k).alias("offset"), (F.lead("close", k).over(w) / entry - 1).alias("ret")) for k in offsets]
    return bars.withColumn("_s", F.array(*cols)).select("symbol", "date", F.inline("_s"))


def vwap_loss_exit(bars: DataFrame) -> DataFrame:
    """Per session the entry at its second bar's open and the exit at the close of the first later bar below VWAP, or the last bar."""
    w = by(["symbol", "session"], "ts")
    rows = bars.withColumns({"_n": F.row_number().over(w), "_below": F.col("close") < F.col("vwap")})
    lost = F.min(F.when((F.col("_n") >= 2) & F.col("_below"), F.struct("_n", "close")))
    out = rows.groupBy("symbol", "session").agg(F.min(F.when(F.col("_n") == 2, F.col("open"))).alias("entry"), lost.alias("_x"), F.max(F.struct("_n", "close")).alias("_l"))
    return out.filter("entry is not null").select("symbol", "session", (F.coalesce("_x.close", "_l.close") / F.col("entry") - 1).alias("ret"), F.when(F.col("_x").isNotNull(), "vwap_loss").otherwise("session_end").alias("exit_reason"))


def running_registry(trials: DataFrame, known: DataFrame, signature: str, order: str) -> DataFrame:
    """Trials whose signature is not known, numbered; the count of trials so far in the order of arrival by day."""
    fresh = trials.join(known.select(signature).distinct(), signature, "left_anti")
    per_day = fresh.groupBy(order).agg(F.count("*").alias("new"))
    # One row a day.
    return per_day.withColumn("cumulative", F.sum("new").over(Window.orderBy(order)))
