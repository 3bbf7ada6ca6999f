"""Top-k, caps, duplicates and deterministic rankings; every order has a last tie-breaker."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def max_per_day(df: DataFrame, day: str, symbol: str, n: int) -> DataFrame:
    """The first n of a day by symbol name: alphabetical, not by quality."""
    return first_per(df, [day], [F.col(symbol)], n)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_per(df, keys, order)


def drop_all_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur once; where they are repeated, all go."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def mark_duplicates(df: DataFrame, keys: list[str], order: list[Column], reason: str = "duplicate") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("reject_reason", F.when(F.row_number().over(w) > 1, reason))


def capped_top_k(df: DataFrame, bucket: str, score: str, tie: str, limit: int, share: float) -> DataFrame:
    """Greedy: by score, at most ceil(limit * share) of a bucket, then filled up from the rest whatever the bucket."""
    cap = ceil(limit * share)
    order = [F.col(score).desc(), F.col(tie)]
    ranked = df.withColumn("_b", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    # No row beyond the limit of its own bucket can be taken in either pass.
    ranked = ranked.filter(F.col("_b") <= limit).withColumn("_over", (F.col("_b") > cap).cast("int"))
    return ranked.orderBy("_over", *order).limit(limit).drop("_b", "_over")


def systematic(df: DataFrame, order: list[Column], keys: list[str], most: int) -> DataFrame:
    """Every k-th row in order, k = max(1, n // most): the stride that stands for a random control."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most))
    return df.withColumn("_s", step).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).filter("_i % _s = 0").drop("_s", "_i")


def indexed(df: DataFrame, keys: list[str], coarse: str, order: list[Column | str], name: str = "index", few: bool = False) -> DataFrame:
    """Each row's place (from 0) among its keys' rows in the order of coarse, then `order`; also `<name>_of`, how many there are.

    No task holds all rows of a key: they are counted by coarse (a day, say), the counts add up to each day's first place, and
    rows are numbered within their day. few: the days of all keys are few enough to send to every task, which spares a shuffle.
    """
    counts = df.groupBy(*keys, coarse).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_c").over(w.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(*keys, coarse, before.alias("_before"), F.sum("_c").over(w).alias(f"{name}_of"))
    numbered = df.join(F.broadcast(bases) if few else bases, [*keys, coarse])
    within = F.row_number().over(Window.partitionBy(*keys, coarse).orderBy(*order))
    return numbered.withColumn(name, F.col("_before") + within - 1).drop("_before")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, itself: bool = True) -> DataFrame:
    """df with running sums (null and none: 0) and maxima of its keys' rows in order, this one's value included or not.

    No task holds all rows of a key: they are put together by the first column of `order` (a day, say), whose sums and maxima run
    over days, and then within a day. Rows without a key or a day are left out.
    """
    sums, maxima, day = sums or {}, maxima or {}, order[0]
    values = {**{n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}, **maxima}
    of = lambda n: F.sum if n in sums else F.max
    rows = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    days = rows.groupBy(*keys, day).agg(*[of(n)(f"_v_{n}").alias(f"_d_{n}") for n in values])
    ahead = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(*keys, day, *[of(n)(f"_d_{n}").over(ahead).alias(f"_b_{n}") for n in values])
    within = Window.partitionBy(*keys, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    joined = rows.join(before, [*keys, day])
    both = {n: (F.coalesce(f"_b_{n}", F.lit(0)) + F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) if n in sums else F.greatest(f"_b_{n}", F.max(f"_v_{n}").over(within))) for n in values}
    return joined.withColumns(both).drop(*[f"_{x}_{n}" for x in "vb" for n in values])


def tile(index: Column, n: Column, tiles: int) -> Column:
    """The tile (from 1) of a place among n; the first n % tiles tiles have one row more, as with ntile."""
    size, extra = F.floor(n / tiles), n % tiles
    wide = extra * (size + 1)
    return F.when(index < wide, F.floor(index / (size + 1))).otherwise(extra + F.floor((index - wide) / F.greatest(size, F.lit(1)))).cast("int") + 1
