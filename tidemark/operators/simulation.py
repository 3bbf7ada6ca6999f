"""Trade simulation as folds and joins over bars; forward paths come from one window by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import profit_factor
from .joins import non_overlapping
from .windows import by


def forward_path(bars: DataFrame, n: int, order: str = "date") -> DataFrame:
    """Each bar with the next n bars as an array of structs."""
    bar = F.struct(order, "open", "high", "low", "close")
    return bars.withColumn("path", F.collect_list(bar).over(by(order=order).rowsBetween(1, n)))


def triple_barrier(events: DataFrame, path: str, stop: Column, target: Column, max_bars: int) -> DataFrame:
    """Long trades entered at the next open. Gap through a barrier at entry: skipped. From the second bar on an open beyond a
    barrier exits at the open; within a bar the stop wins; after max_bars the close. Excursions include the whole exit bar.
    """
    entered = events.withColumns({"_stop": stop, "_target": target, "entry": F.col(path)[0]["open"]}).filter(F.size(path) > 0)
    zero = F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("how"), F.lit(None).cast("double").alias("exit"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low"))

    def step(a: Column, b: Column) -> Column:
        i = a["i"] + 1
        later = i > 1
        how = F.when(later & (b["open"] <= b["s"]), "stop_gap").when(later & (b["open"] >= b["t"]), "target_gap").when(b["low"] <= b["s"], "stop").when(b["high"] >= b["t"], "target").when(i >= max_bars, "time")
        price = F.when(how.isin("stop_gap", "target_gap"), b["open"]).when(how == "stop", b["s"]).when(how == "target", b["t"]).when(how == "time", b["close"])
        moved = F.struct(i.alias("i"), how.alias("how"), price.alias("exit"), F.greatest(a["high"], b["high"]).alias("high"), F.least(a["low"], b["low"]).alias("low"))
        return F.when(a["how"].isNotNull(), a).otherwise(moved)

    bars = F.transform(path, lambda b: F.struct(b["open"].alias("open"), b["high"].alias("high"), b["low"].alias("low"), b["close"].alias("close"), F.col("_stop").alias("s"), F.col("_target").alias("t")))
    out = entered.withColumn("_x", F.aggregate(bars, zero, step))
    skipped = (F.col("entry") <= F.col("_stop")) | (F.col("entry") >= F.col("_target"))
    risk = F.col("entry") - F.col("_stop")
    r = lambda p: F.when(~skipped, (p - F.col("entry")) / risk)
    return out.withColumns({
        "outcome": F.when(skipped, "skip_gap").otherwise(F.coalesce("_x.how", F.lit("open"))), "bars_held": F.when(~skipped, F.col("_x.i")),
        "r": r(F.col("_x.exit")), "mfe": r(F.col("_x.high")), "mae": r(F.col("_x.low")),
    }).drop("_x", "_stop", "_target")


def fixed_hold(bars: DataFrame, signal: Column, hold: int, truncate: bool = False) -> DataFrame:
    """Trades from the next open to the close `hold` bars later, one at a time per symbol.

    Without the full hold a trade is left out, or with `truncate` ends at the last bar.
    """
    w = by()
    last = F.last("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last_day = F.max("date").over(Window.partitionBy("symbol"))
    fields = {"entry_date": F.lead("date", 1).over(w), "entry": F.lead("open", 1).over(w), "exit_date": F.lead("date", 1 + hold).over(w), "exit": F.lead("close", 1 + hold).over(w)}
    if truncate:
        fields |= {"exit_date": F.coalesce(fields["exit_date"], last_day), "exit": F.coalesce(fields["exit"], last)}
    found = bars.withColumn("_signal", signal).withColumns(fields).filter(F.col("_signal") & F.col("entry_date").isNotNull() & F.col("exit_date").isNotNull())
    found = found.withColumn("trade", F.struct("entry", "exit"))
    return non_overlapping(found, ["symbol"], "entry_date", "exit_date", "trade").select("symbol", "entry_date", "exit_date", (F.col("trade.exit") / F.col("trade.entry") - 1).alias("ret"))


def shifted_signals(bars: DataFrame, signal: Column, shifts: list[int], hold: int) -> DataFrame:
    """Placebo: the mean return of entering `shift` bars after each signal, by shift."""
    w = by()
    ret = F.lead("close", 1 + hold).over(w) / F.lead("open", 1).over(w) - 1
    numbered = bars.withColumns({"_signal": signal, "_n": F.row_number().over(w), "_ret": ret})
    moved = numbered.filter("_signal").select("symbol", "_n", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift")).withColumn("_n", F.col("_n") + F.col("shift"))
    return moved.join(numbered.select("symbol", "_n", "_ret"), ["symbol", "_n"]).groupBy("shift").agg(F.count("_ret").alias("n"), F.avg("_ret").alias("mean"))


def run_matrix(ledger: DataFrame, matrix: DataFrame, oos_from: str, costs: dict[str, float]) -> DataFrame:
    """All tests of a matrix (test_id, min_gap, max_gap, direction, regime) over a gap ledger in one job.

    A test fades the gap: the return is that from open to close, against the gap's direction. A missing benchmark return
    counts as 0, so it passes the regime 'down'.
    """
    # The matrix is a parameter of tens of rows.
    hits = ledger.join(
        F.broadcast(matrix),
        (F.abs("gap_pct") >= F.col("min_gap")) & (F.abs("gap_pct") < F.col("max_gap")) & F.col("direction").isin("any") | (F.abs("gap_pct") >= F.col("min_gap")) & (F.abs("gap_pct") < F.col("max_gap")) & (F.col("direction") == F.col("gap_direction")),
    )
    bench = F.coalesce("benchmark_return_20d", F.lit(0.0))
    hits = hits.filter((F.col("regime") == "any") | ((F.col("regime") == "down") & (bench <= 0)) | ((F.col("regime") == "up") & (bench > 0)))
    ret = F.when(F.col("gap_direction") == "up", -F.col("open_to_close")).otherwise(F.col("open_to_close"))
    hits = hits.withColumns({"ret": ret, "oos": F.col("date") >= F.lit(oos_from).cast("date")})
    aggs = [F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols")]
    for name, cost in costs.items():
        net = F.col("ret") - cost
        aggs += [F.avg(net).alias(f"mean_{name}"), profit_factor(net, "gross").alias(f"pf_{name}")]
    return hits.groupBy("test_id", "oos").agg(*aggs)
