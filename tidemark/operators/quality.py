"""Bar cleaning, validation and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import business_days, known
from .windows import by, longest_run

PRICES = ["open", "high", "low", "close"]


def normalize(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lower-case names with underscores, adj_close for close where that is missing, doubles, rows without gaps."""
    named = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    if "close" not in named.columns and "adj_close" in named.columns:
        named = named.withColumnRenamed("adj_close", "close")
    wanted = [*PRICES, "volume"]
    return named.select(*keys, *[known(F.col(c).cast("double")).alias(c) for c in wanted]).dropna(subset=wanted)


def violations() -> dict[str, Column]:
    c = {n: F.col(n) for n in [*PRICES, "volume"]}
    return {
        "NONPOSITIVE_PRICE": F.least(*[c[p] for p in PRICES]) <= 0, "NEGATIVE_VOLUME": c["volume"] < 0, "HIGH_BELOW_LOW": c["high"] < c["low"],
        "HIGH_BELOW_BODY": c["high"] < F.greatest(c["open"], c["close"]), "LOW_ABOVE_BODY": c["low"] > F.least(c["open"], c["close"]),
    }


def check(bars: DataFrame) -> DataFrame:
    """Rows with the codes of the rules that they break, in order."""
    return bars.withColumn("violations", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in violations().items()])))


def report(bars: DataFrame, min_bars: int = 60, max_zero_volume: float = 0.15, max_stale: int = 8, max_gap: int = 5, max_ratio: float = 4.0) -> DataFrame:
    """Per symbol: share of bars without volume, longest constant close, largest business-day gap, largest bar ratio, issue codes."""
    w = by()
    ratio = F.col("close") / F.lag("close").over(w)
    steps = bars.withColumns({"_ratio": F.greatest(ratio, 1 / ratio), "_gap": F.greatest(business_days(F.lag("date").over(w), F.col("date")) - 1, F.lit(0))})
    out = steps.groupBy("symbol").agg(F.count("*").alias("bars"), F.avg((F.col("volume") == 0).cast("double")).alias("zero_volume"), F.max("_gap").alias("max_gap"), F.max("_ratio").alias("max_ratio"))
    out = out.join(longest_run(bars, "close"), "symbol")
    codes = {"TOO_SHORT": F.col("bars") < min_bars, "ZERO_VOLUME": F.col("zero_volume") > max_zero_volume, "STALE": F.col("longest_run") > max_stale, "GAP": F.col("max_gap") > max_gap, "JUMP": F.col("max_ratio") > max_ratio}
    return out.withColumn("issues", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in codes.items()])))


def splits(bars: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Bars that open far from the last close on volume of at most three times the median of the 20 before."""
    w = by()
    frame = w.rowsBetween(-20, -1)
    typical = F.when(F.count("volume").over(frame) >= 5, F.percentile("volume", F.lit(0.5)).over(frame))
    jump = F.abs(F.col("open") / F.lag("close").over(w) - 1)
    return bars.withColumns({"jump": jump, "typical_volume": typical}).filter((F.col("jump") > threshold) & (F.col("volume") <= 3 * F.col("typical_volume")))


def gap_count(bars: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Intervals of more than one and a half times the bars' width."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    step = at - F.lag(at).over(by(keys, ts))
    return bars.withColumn("_gap", step > seconds * 1_500_000).groupBy(*keys).agg(F.count_if("_gap").alias("gaps"))


def complete(bars: DataFrame, now: Column, width_minutes: int | None) -> DataFrame:
    """Bars that have ended: those of days before today, or whose width has passed."""
    if width_minutes is None:
        return bars.filter(F.col("date") < now.cast("date"))
    return bars.filter(F.col("ts") + F.make_dt_interval(mins=F.lit(width_minutes)) <= now)


def overlap_matches(cached: DataFrame, tail: DataFrame, keys: list[str], ts: str, last: int, tolerance: float = 1e-4) -> DataFrame:
    """Per key: whether open and close of the last common bars agree."""
    both = cached.alias("a").join(tail.alias("b"), [*keys, ts]).select(*keys, ts, *[(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) / F.greatest(F.abs(F.col(f"a.{c}")), F.lit(1e-9))).alias(f"_d_{c}") for c in ("open", "close")])
    from .ranking import first_per

    recent = first_per(both, keys, [F.col(ts).desc()], last)
    return recent.groupBy(*keys).agg(F.count("*").alias("common"), F.max(F.greatest("_d_open", "_d_close")).alias("worst")).withColumn("matches", F.col("worst") <= tolerance)


def leakage(stored: DataFrame, recomputed: DataFrame, keys: list[str], features: list[str], atol: float = 1e-12) -> DataFrame:
    """Features that differ between what was stored at decision time and a recomputation on truncated data."""
    both = stored.alias("a").join(recomputed.alias("b"), keys, "full")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a.{c}").cast("double").alias("stored"), F.col(f"b.{c}").cast("double").alias("recomputed")) for c in features])
    differs = ~F.col("stored").eqNullSafe(F.col("recomputed")) & (F.abs(F.col("stored") - F.col("recomputed")) > atol) | (F.col("stored").isNull() != F.col("recomputed").isNull())
    return both.select(*keys, F.inline(pairs)).filter(differs)
