"""Window and time-series operators; frames are per symbol in time order, so each runs on one shuffle by symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import running


def by(keys="symbol", order="date") -> Window:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*([order] if isinstance(order, str) else order))


def rolling(x: Column, agg, w, size: int, least: int | None = None, shift: int = 0) -> Column:
    """agg over the last `size` rows ending `shift` rows before this one; null while fewer than `least` (default: size) have a value."""
    frame = w.rowsBetween(-(size - 1) - shift, -shift)
    return F.when(F.count(x).over(frame) >= (size if least is None else least), agg(x).over(frame))


def sma(x: Column, w, size: int) -> Column:
    return rolling(x, F.avg, w, size, max(2, size // 2))


def true_range(w) -> Column:
    """The first bar's range is high - low: greatest skips nulls."""
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, size: int = 14, least: int | None = None, w=None) -> DataFrame:
    w = w or by()
    return bars.withColumn("tr", true_range(w)).withColumn("atr", rolling(F.col("tr"), F.avg, w, size, least))


def gap_ledger(bars: DataFrame, benchmark: str, min_history: int = 20) -> DataFrame:
    """Point-in-time gap events: what is known at the open, and outcomes after it; rows of the benchmark stay, flagged."""
    w = by()
    out = atr(bars).withColumns({"previous_date": F.lag("date").over(w), "previous_close": F.lag("close").over(w)})
    out = out.withColumns({
        "gap_pct": F.col("open") / F.col("previous_close") - 1, "prior_atr_pct": F.lag(F.col("atr") / F.col("close")).over(w),
        "prior_return_5d": F.lag("close", 1).over(w) / F.lag("close", 6).over(w) - 1, "prior_return_20d": F.lag("close", 1).over(w) / F.lag("close", 21).over(w) - 1,
        "prior_volume": F.lag("volume").over(w), "open_to_close": F.col("close") / F.col("open") - 1, "close_to_next_open": F.lead("open").over(w) / F.col("close") - 1,
        "next_open_to_close": F.lead("close").over(w) / F.lead("open").over(w) - 1, "row_number": F.row_number().over(w) - 1,
    })
    direction = S.gap_direction(F.col("gap_pct"))
    out = out.withColumns({
        "gap_direction": direction, "gap_bps": F.col("gap_pct") * 10_000, "gap_filled": S.gap_filled(direction, F.col("high"), F.col("low"), F.col("previous_close")),
        "gap_fill_ratio": S.gap_fill_ratio(direction, F.col("open"), F.col("high"), F.col("low"), F.col("previous_close")), "is_benchmark": F.col("symbol") == benchmark,
    })
    size = F.abs("gap_pct")
    quality = F.when(F.col("is_benchmark"), "BENCHMARK").when(F.col("row_number") < min_history, "INSUFFICIENT_HISTORY").when(size.isNull(), "MISSING").when(size < 0.005, "GAP_TOO_SMALL").when(size >= 0.25, "SPLIT_SUSPECT").otherwise("DATA_OK")
    bench = out.filter(F.col("symbol") == benchmark).select("date", F.col("prior_return_20d").alias("benchmark_return_20d"))
    return out.withColumn("data_quality_status", quality).join(bench, "date", "left")


def runs(df: DataFrame, changed: Column, w, name: str = "run") -> DataFrame:
    """Numbers the islands that start where `changed` holds."""
    return df.withColumn(name, F.sum(F.when(changed, 1).otherwise(0)).over(w))


def streak(df: DataFrame, condition: Column, w, name: str = "streak") -> DataFrame:
    """How many rows in a row, this one included, meet the condition."""
    n = F.row_number().over(w)
    last_off = F.last(F.when(~condition, F.col("_n")), ignorenulls=True).over(w)
    return df.withColumn("_n", n).withColumn(name, F.when(condition, F.col("_n") - F.coalesce(last_off, F.lit(0))).otherwise(0)).drop("_n")


def longest_run(df: DataFrame, value: str, keys="symbol", order="date") -> DataFrame:
    """Longest run of an unchanged value by key."""
    w = by(keys, order)
    numbered = runs(df, ~F.col(value).eqNullSafe(F.lag(value).over(w)), w)
    return numbered.groupBy(keys, "run").agg(F.count("*").alias("n")).groupBy(keys).agg(F.max("n").alias("longest_run"))


def worst_streak(df: DataFrame, bad: Column, keys, order) -> DataFrame:
    """The longest streak by key, placed and counted by the first column of `order`, so that no task holds all rows of a key."""
    keys, order = ([x] if isinstance(x, str) else list(x) for x in (keys, order))
    placed = running(df, keys, order, {"_n": F.lit(1)})
    told = running(placed, keys, order, maxima={"_off": F.when(~bad, F.col("_n"))})
    length = F.when(bad, F.col("_n") - F.coalesce("_off", F.lit(0))).otherwise(0)
    return told.groupBy(*keys).agg(F.max(length).alias("worst_streak"))


def swing_indicators(bars: DataFrame) -> DataFrame:
    """Both swing families: moving averages, returns, down streak, ATR share, its trailing 40% quantile, prior 20-day high."""
    w = by()
    c = F.col("close")
    out = atr(bars).withColumns({"sma50": rolling(c, F.avg, w, 50), "sma200": rolling(c, F.avg, w, 200), "ret20": c / F.lag("close", 20).over(w) - 1})
    out = streak(out, F.coalesce(c < F.lag("close").over(w), F.lit(False)), w, "down_streak").withColumn("atr_pct", F.col("atr") / c)
    frame = w.rowsBetween(-120, -1)
    p40 = F.when(F.count("atr_pct").over(frame) >= 120, F.percentile("atr_pct", F.lit(0.4)).over(frame))
    return out.withColumns({"atr_p40": p40, "prior_high20": rolling(F.col("high"), F.max, w, 20, shift=1)})


def regime_table(bars: DataFrame, sma_days: int = 200, vol_days: int = 20, lookback: int = 252) -> DataFrame:
    """Trend by moving average and volatility terciles of the values up to the previous bar."""
    w = by()
    out = bars.withColumn("log_ret", F.log(F.col("close") / F.lag("close").over(w)))
    out = out.withColumns({"sma": rolling(F.col("close"), F.avg, w, sma_days), "vol": rolling(F.col("log_ret"), F.stddev_samp, w, vol_days) * float(252**0.5)})
    frame = w.rowsBetween(-lookback, -1)
    cut = lambda q: F.when(F.count("vol").over(frame) >= lookback, F.percentile("vol", F.lit(q)).over(frame))
    out = out.withColumns({"low_cut": cut(1 / 3), "high_cut": cut(2 / 3)})
    trend = F.when(F.col("sma").isNull(), "unknown").when(F.col("close") > F.col("sma"), "up").otherwise("down")
    state = F.when(F.col("low_cut").isNull() | F.col("vol").isNull(), "unknown").when(F.col("vol") <= F.col("low_cut"), "low").when(F.col("vol") >= F.col("high_cut"), "high").otherwise("mid")
    return out.withColumns({"trend": trend, "vol_regime": state, "regime_key": F.concat_ws("_", trend, state)})


def drawdown(df: DataFrame, value: str, keys="symbol", order="date") -> DataFrame:
    """Largest relative fall from a running maximum."""
    top = F.max(value).over(by(keys, order))
    return df.withColumn("_dd", (F.col(value) - top) / top).groupBy(keys).agg(F.min("_dd").alias("max_drawdown"))


def equity_curve(trades: DataFrame, keys="pattern", day="exit_date", ret="ret") -> DataFrame:
    w = by(keys, day)
    daily = trades.groupBy(keys, day).agg(F.sum(ret).alias("pnl"))
    out = daily.withColumn("equity", F.sum("pnl").over(w))
    return out.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(0.0))).withColumn("drawdown", F.col("equity") - F.col("peak"))


def vwap(bars: DataFrame, slope_lag: int = 3, flat_bps: float = 1.0, extension_bps: float = 150.0) -> DataFrame:
    """Session VWAP and its flags; null while a session has no volume."""
    w = by(["symbol", "session"], "ts")
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum("volume").over(w)
    out = bars.withColumn("vwap", F.when(volume > 0, F.sum(price * F.col("volume")).over(w) / volume))
    distance = (S.ratio(F.col("close"), F.col("vwap")) - 1) * 10_000
    above = F.col("close") > F.col("vwap")
    out = out.withColumns({"distance_bps": distance, "slope_bps": (S.ratio(F.col("vwap"), F.lag("vwap", slope_lag).over(w)) - 1) * 10_000})
    was = F.lag(above).over(w)
    out = out.withColumns({"above": F.coalesce(above, F.lit(False)), "crossed": F.coalesce(above != was, F.lit(False)), "reclaim": F.coalesce(above & ~was, F.lit(False)), "reject": F.coalesce(~above & was, F.lit(False))})
    out = out.withColumns({"extended": F.coalesce(F.abs("distance_bps") >= extension_bps, F.lit(False)), "slope": S.slope_direction(F.col("slope_bps"), flat_bps), "_n": F.row_number().over(w)})
    return out.withColumn("bars_since_cross", F.col("_n") - F.last(F.when(F.col("crossed"), F.col("_n")), ignorenulls=True).over(w)).drop("_n")


def opening_range(bars: DataFrame, minutes: int = 30) -> DataFrame:
    """High and low of a session's first minutes, counted from its first bar."""
    first = F.min("ts").over(Window.partitionBy("symbol", "session"))
    early = F.unix_micros(F.col("ts").cast("timestamp")) < F.unix_micros(first.cast("timestamp")) + minutes * 60_000_000
    return bars.withColumn("_early", early).filter("_early").groupBy("symbol", "session").agg(F.max("high").alias("or_high"), F.min("low").alias("or_low"), F.count("*").alias("or_bars"))


def feature_cube(bars: DataFrame) -> DataFrame:
    """Returns over 1 and 3 bars, range compression over 5 and 8 bars, place in the session's range so far."""
    w = by(["symbol", "session"], "ts")
    spread = F.col("high") - F.col("low")
    high, low = F.max("high").over(w), F.min("low").over(w)
    return bars.withColumns({
        "ret1": S.ratio(F.col("close"), F.lag("close", 1).over(w)) - 1, "ret3": S.ratio(F.col("close"), F.lag("close", 3).over(w)) - 1,
        "compression5": spread / F.nullif(rolling(spread, F.avg, w, 5, 1), F.lit(0.0)), "compression8": spread / F.nullif(rolling(spread, F.avg, w, 8, 1), F.lit(0.0)),
        "range_position": F.when(high > low, S.clamp((F.col("close") - low) / (high - low), 0.0, 1.0)),
    })


def episodes(signals: DataFrame, index: str, max_gap: int, keys="symbol") -> DataFrame:
    """Signals whose index differs by at most max_gap form an episode."""
    w = by(keys, index)
    gap = F.coalesce(F.col(index) - F.lag(index).over(w), F.lit(999_999))
    return runs(signals.withColumn("signal_gap", gap), F.col("signal_gap") > max_gap, w, "episode")


def rate_budget(events: DataFrame, seconds: int, keys, ts: str = "ts") -> DataFrame:
    """How many events of the key fell in the last seconds, this one included."""
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("used", F.count("*").over(w))


def weekly_close(bars: DataFrame) -> DataFrame:
    """Last close of each week; weeks without bars between a symbol's first and last stay, as null."""
    week = F.date_trunc("week", "date").cast("date")
    closes = bars.groupBy("symbol", week.alias("week")).agg(F.max_by("close", "date").alias("close"))
    spans = closes.groupBy("symbol").agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days"))).alias("week"))
    return spans.join(closes, ["symbol", "week"], "left")


def pivots(bars: DataFrame) -> DataFrame:
    """Local extremes, whether each is higher or lower than the last one of its kind, and the state carried forward."""
    w = by()
    h, lo = F.col("high"), F.col("low")
    out = bars.withColumns({"pivot_high": F.when((h > F.lag("high").over(w)) & (h > F.lead("high").over(w)), h), "pivot_low": F.when((lo < F.lag("low").over(w)) & (lo < F.lead("low").over(w)), lo)})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    mark = F.when(F.col("pivot_high") > last("pivot_high"), "HH").when(F.col("pivot_high") <= last("pivot_high"), "LH").when(F.col("pivot_low") > last("pivot_low"), "HL").when(F.col("pivot_low") <= last("pivot_low"), "LL")
    out = out.withColumn("mark", mark)
    return out.withColumn("state", F.last("mark", ignorenulls=True).over(w))


def trailing_slope(bars: DataFrame, size: int = 20) -> DataFrame:
    """Least-squares slope of the last closes against -1..1."""
    w = by()
    out = bars.withColumn("_n", F.row_number().over(w).cast("double"))
    frame = w.rowsBetween(-(size - 1), 0)
    # Positions are evenly spaced, so their variance is known and the middle of the frame is _n - (size - 1) / 2.
    centred = F.sum(F.col("_n") * F.col("close")).over(frame) - (F.col("_n") - (size - 1) / 2) * F.sum("close").over(frame)
    slope = centred / (size * (size * size - 1) / 12) * (size - 1) / 2
    return out.withColumn("slope", F.when(F.count("close").over(frame) >= size, slope)).drop("_n")


def back_fill(df: DataFrame, value: str, w) -> DataFrame:
    following = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(value, F.coalesce(F.first(value, ignorenulls=True).over(following), F.lit(0.0)))


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's rows in one partition and in order: what a fold over batches needs, which holds one batch and its state at a time."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def cusum(df: DataFrame, keys, order, value: str, target: float, slack: float, limit: float) -> DataFrame:
    """Two-sided CUSUM with reset at zero: by key the number of values and the first position where it passes the limit (0: never).

    A recurrence, so a fold over each key's values in order, streamed: a task holds a batch and the two sums. Values are put in order
    within the first column of `order` (a day, say), and whole days, of nothing but values, then among themselves. A null value takes
    a position and leaves the sums as they are.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, up, down, n, hit, began, done = None, 0.0, 0.0, 0, 0, False, []
        types = []
        for b in batches:
            types = [c.type for c in b.columns[:-1]]
            for *key, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not began or key != now:
                    if began:
                        done.append((*now, n, hit))
                    now, up, down, n, hit, began = key, 0.0, 0.0, 0, 0, True
                n += 1
                if x is not None:
                    up, down = max(0.0, up + (x - target - slack)), max(0.0, down - (x - target) - slack)
                    if not hit and (up > limit or down > limit):
                        hit = n
        if began:
            done.append((*now, n, hit))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [*types, pa.int64(), pa.int64()], strict=True)], [*keys, "n", "first_trigger"])

    order = list(order)
    rows = F.array_sort(F.collect_list(F.struct(*order[1:], F.col(value).cast("double").alias("_x"))))
    days = df.groupBy(*keys, F.col(order[0]).alias("_day")).agg(F.transform(rows, lambda r: r["_x"]).alias("_xs"))
    ordered = in_order(days, keys, ["_day"]).select(*keys, F.explode("_xs").alias("_x"))
    return ordered.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, first_trigger long"]))
