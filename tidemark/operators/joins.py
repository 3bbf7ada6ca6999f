"""As-of, range, overlap, greedy and matching joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running
from .windows import in_order


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: list[str], tolerance: int | None = None) -> DataFrame:
    """Each left row with the last right row of its keys at or before `on`: one union and one window, no pairs.

    Rows with equal times: right ones come first, so they match. `tolerance`: the largest distance in seconds.
    """
    pack = F.struct(F.col(on).alias("_at"), *value)
    both = left.select(*left.columns, F.lit(1).alias("_left"), F.lit(None).cast(right.select(pack.alias("p")).schema["p"].dataType).alias("_r"))
    both = both.unionByName(right.select(*by, on, F.lit(0).alias("_left"), pack.alias("_r")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "_left")
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_left = 1")
    near = F.lit(True) if tolerance is None else F.col(on).cast("timestamp").cast("long") - F.col("_m._at").cast("timestamp").cast("long") <= tolerance
    return found.select(*left.columns, F.when(near, F.col("_m._at")).alias("matched_at"), *[F.when(near, F.col(f"_m.{v}")).alias(v) for v in value])


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """Each left row with the right row nearest in time; the earlier one where two are as near."""
    pack = F.struct(F.col(on).alias("_at"), F.col(value).alias("v"))
    both = left.select(*left.columns, F.lit(1).alias("_left"), F.lit(None).cast(right.select(pack.alias("p")).schema["p"].dataType).alias("_r"))
    both = both.unionByName(right.select(*by, on, F.lit(0).alias("_left"), pack.alias("_r")), allowMissingColumns=True)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    before = F.last("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy(on, "_left"))
    after = F.first("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy(on, F.col("_left").desc()).rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_b": before, "_a": after}).filter("_left = 1")
    take_after = F.col("_b").isNull() | (F.col("_a").isNotNull() & (micros("_a._at") - micros(on) < micros(on) - micros("_b._at")))
    return found.select(*left.columns, F.when(take_after, F.col("_a._at")).otherwise(F.col("_b._at")).alias("matched_at"), F.when(take_after, F.col("_a.v")).otherwise(F.col("_b.v")).alias(value))


def range_join(events: DataFrame, bars: DataFrame, by: list[str], start: str, end: str, at: str, bucket_days: int = 32) -> DataFrame:
    """Bars with start <= at <= end of each event's keys. Both sides carry day buckets, so the join is an equi-join whose condition trims the edges."""
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / bucket_days)
    spread = events.withColumn("_bucket", F.explode(F.sequence(number(F.col(start)), number(F.col(end)))))
    return spread.join(bars.withColumn("_bucket", number(F.col(at))), [*by, "_bucket"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def uniqueness(events: DataFrame, by: list[str], start: str, end: str, name: str = "uniqueness") -> DataFrame:
    """events plus the mean over each one's days of 1 / (events of its keys open that day), and `<name>_days`, how many these are.

    How many are open changes only on days that an event starts on or that follow one's end. These days carry the count and the sum
    of 1 / count of all days before, so an event takes two look-ups, whatever its length. Events without a key, start or end are left out.
    """
    known = events.dropna(subset=[*by, start, end]).withColumns({"_from": F.least(start, end), "_to": F.date_add(F.greatest(start, end), 1)})
    changes = known.select(*by, F.explode(F.array(F.struct(F.col("_from").alias("day"), F.lit(1).alias("n")), F.struct(F.col("_to").alias("day"), F.lit(-1).alias("n")))).alias("c"))
    daily = changes.groupBy(*by, F.col("c.day").alias("_day")).agg(F.sum("c.n").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_day")
    counted = daily.withColumns({"_open": F.sum("_n").over(w), "_days": F.datediff(F.lead("_day").over(w), "_day")})
    shares = F.when(F.col("_open") > 0, F.col("_days") / F.col("_open")).otherwise(0.0)
    before = counted.withColumn("_share", shares).select(*by, "_day", F.coalesce(F.sum("_share").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_sum"))
    at = lambda day, name: before.select(*by, F.col("_day").alias(day), F.col("_sum").alias(name))
    found = known.join(at("_from", "_s0"), [*by, "_from"]).join(at("_to", "_s1"), [*by, "_to"])
    days = F.datediff("_to", "_from")
    return found.withColumns({name: (F.col("_s1") - F.col("_s0")) / days, f"{name}_days": days}).select(*events.columns, name, f"{name}_days")


def concurrency(events: DataFrame, key: str, by: list[str], start: str, end: str) -> DataFrame:
    """Average uniqueness of each event by its key: the mean over its days of 1 / (events open that day)."""
    found = uniqueness(events.select(*dict.fromkeys([key, *by, start, end])), by, start, end, "_u")
    return found.groupBy(key).agg((F.sum(F.col("_u") * F.col("_u_days")) / F.sum("_u_days")).alias("uniqueness"))


def non_overlapping(events: DataFrame, by: list[str], start: str, end: str, key: str) -> DataFrame:
    """Greedy by start: an event is taken if it starts after the last taken one's end; without a start or an end it never is.

    A fold over each key's events in order of start, end and key, streamed: a task holds a batch and the last end.
    """
    names, at = [*by, start, end, key], len(by)
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        for b in batches:
            taken = []
            for *who, first, to in zip(*(c.to_pylist() for c in b.columns[: at + 2]), strict=True):
                if who != now:
                    now, last = who, None
                taken.append(first is not None and to is not None and (last is None or first > last))
                if taken[-1]:
                    last = to
            yield b.filter(pa.array(taken, pa.bool_()))

    return in_order(events.select(*names), by, [start, end, key]).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def overlap_clusters(events: DataFrame, by: list[str], start: str, end: str, key: str) -> DataFrame:
    """Whether an event starts at or before the latest end so far, and the number of its cluster."""
    late = running(events, by, [start, key], maxima={"_latest": F.col(end)}, itself=False)
    out = late.withColumn("is_overlap", F.coalesce(F.col(start) <= F.col("_latest"), F.lit(False))).drop("_latest")
    return running(out, by, [start, key], {"cluster": F.when(~F.col("is_overlap"), 1)})


def cyclic_pairs(real: DataFrame, pool: DataFrame, bucket: str, key: str) -> DataFrame:
    """The i-th real event of a bucket with the (i mod n)-th event of the bucket's pool of n; null where the pool has none."""
    w = Window.partitionBy(bucket).orderBy(key)
    sized = pool.withColumns({"_slot": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(bucket))})
    sizes = pool.groupBy(bucket).agg(F.count("*").alias("_size"))
    slots = real.withColumn("_i", F.row_number().over(w) - 1).join(sizes, bucket, "left").withColumn("_slot", F.pmod("_i", "_size"))
    return slots.join(sized.select(bucket, "_slot", F.col(key).alias("matched")), [bucket, "_slot"], "left").select(bucket, key, "matched")


def stratified_null(real: DataFrame, null: DataFrame, bucket: str, value: str) -> DataFrame:
    """Edge of the real mean over the null's bucket means weighted by the real counts; void if a bucket has no null."""
    counts = real.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    means = null.groupBy(bucket).agg(F.avg(value).alias("m"))
    total = counts.join(means, bucket, "left").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("m")).alias("e"), F.count_if(F.col("m").isNull()).alias("missing"))
    return total.select("n", "missing", F.when(F.col("missing") == 0, F.col("s") / F.col("n") - F.col("e") / F.col("n")).alias("edge"))


def unique_match(fills: DataFrame, trades: DataFrame, fill: str, trade: str, on: list[Column], name: str) -> DataFrame:
    """(fill, name): the trade that a fill matches, where exactly one does."""
    pairs = fills.join(trades, on).select(fill, trade)
    return pairs.groupBy(fill).agg(F.count("*").alias("_n"), F.first(trade).alias(name)).filter("_n = 1").drop("_n")


def history_levels(trades: DataFrame, keys: list[str], levels: list[list[str]], value: str) -> DataFrame:
    """Statistics at several wildcard levels in one pass (grouping sets); a key that a level leaves out is '*'."""
    view = trades.select(*keys, value)
    sets = [[F.col(c) for c in level] for level in levels]
    out = view.groupingSets(sets, *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.grouping_id().alias("level"))
    return out.select(*[F.coalesce(F.col(c), F.lit("*")).alias(c) for c in keys], "n", "mean", F.col("level").cast("long").alias("level"))


def unseen(windows: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Windows that the ledger of analysed ones does not have."""
    return windows.join(ledger.select(*key).distinct(), key, "left_anti")


def asof_small(left: DataFrame, right: DataFrame, on: str, value: list[str]) -> DataFrame:
    """As-of join without keys against a right side of at most one row a day, such as one benchmark's bars.

    The right side is filled forward to one row for each day, so an equi-join by day does it: no keyless window over
    all of the left side. Days after the last row are covered up to the left side's last day.
    """
    last_day = left.agg(F.max(on).alias("_end")).withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one").orderBy(on)
    spans = right.withColumn("_one", F.lit(1)).withColumn("_next", F.lead(on).over(w)).join(F.broadcast(last_day), "_one")
    until = F.greatest(F.coalesce(F.date_sub("_next", 1), F.col("_end")), F.col(on))
    days = spans.select(F.explode(F.sequence(F.col(on), until)).alias("_day"), F.col(on).alias("matched_at"), *value)
    return left.join(days, left[on] == days["_day"], "left").select(*[left[c] for c in left.columns], "matched_at", *value)
