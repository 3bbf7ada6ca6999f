"""Portfolio policies, audits and stress variants of trade rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .ranking import first_per
from .windows import by, in_order


def execution_proxy(entry: Column, high: Column, low: Column, previous_close: Column, open_: Column, dollar_volume: Column, order_value: float) -> dict[str, Column]:
    """Proxies in basis points: half-spread from the bar's range, impact by the root of participation, gap penalty, fill probability, largest order."""
    share = F.when(dollar_volume > 0, order_value / dollar_volume)
    return {
        "spread_bps": clamp((high - low) / entry * 10_000 * 0.05, 1.0, 100.0), "impact_bps": 10 * F.sqrt(F.least(share, F.lit(1.0)) * 100), "gap_bps": clamp(F.abs(open_ / previous_close - 1) * 10_000 * 0.1, 0.0, 50.0),
        "fill_probability": 1 - F.least(share, F.lit(1.0)) * 0.5, "max_order": dollar_volume * 0.01,
    }


def median_split(df: DataFrame, test: str, value: str, side: str = "below") -> DataFrame:
    """Rows of each test on one side of the median of that test's own rows."""
    cut = df.groupBy(test).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    keep = F.col(value) <= F.col("_m") if side == "below" else F.col(value) > F.col("_m")
    return df.join(cut, test).filter(keep).drop("_m")


def timing_audit(signals: DataFrame, bars: DataFrame, offsets: list[int], hold: int, oos_from: str) -> DataFrame:
    """Per offset and half: trades that enter `offset` bars after an episode's first signal; and how they compare with offset 0."""
    w = by()
    numbered = bars.withColumns({"_n": F.row_number().over(w), "ret": F.lead("close", hold).over(w) / F.col("open") - 1}).select("symbol", "_n", "date", "ret")
    first = signals.groupBy("symbol", "episode").agg(F.min("idx").alias("_i"))
    moved = first.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("_n", F.col("_i") + 2 + F.col("offset"))
    joined = moved.join(numbered, ["symbol", "_n"]).withColumn("oos", F.col("date") >= F.lit(oos_from).cast("date"))
    out = joined.groupBy("offset", "oos").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"))
    base = out.filter("offset = 0").select("oos", F.col("mean").alias("_base"))
    return out.join(base, "oos").withColumn("at_least_base", F.col("mean") >= F.col("_base")).drop("_base")


def latency(bars: DataFrame, delays: list[int], hold: int, extra_cost: float) -> DataFrame:
    """Entries at later opens, each bar of delay at an extra cost: mean by symbol and delay."""
    w = by()
    made = F.array(*[F.struct(F.lit(d).alias("delay"), (F.lead("close", hold + d).over(w) / F.lead("open", 1 + d).over(w) - 1 - extra_cost * d).alias("ret")) for d in delays])
    return bars.withColumn("_m", made).select("symbol", F.inline("_m")).groupBy("symbol", "delay").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"))


def adverse_variants(bars: DataFrame, hold: int, bps: float = 10.0) -> DataFrame:
    """The same trades as they are, entered at the next close, and at adverse prices."""
    w = by()
    out = F.lead("close", 1 + hold).over(w)
    entry = F.lead("open", 1).over(w)
    made = F.array(F.struct(F.lit("base").alias("variant"), (out / entry - 1).alias("ret")), F.struct(F.lit("next_close").alias("variant"), (out / F.lead("close", 1).over(w) - 1).alias("ret")), F.struct(F.lit("adverse").alias("variant"), (out * (1 - bps / 10_000) / (entry * (1 + bps / 10_000)) - 1).alias("ret")))
    return bars.withColumn("_m", made).select(F.inline("_m")).groupBy("variant").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"))


def edge_decay(df: DataFrame, level: str, edge: str, chosen: float, neighbours: int = 2) -> DataFrame:
    """The chosen level's edge less the mean edge of its nearest levels; df has one row a level."""
    ranked = df.filter(F.col(level) != chosen).withColumn("_k", F.row_number().over(Window.orderBy(F.abs(F.col(level) - chosen), level)))
    near = ranked.filter(F.col("_k") <= neighbours).agg(F.avg(edge).alias("near_edge"))
    own = df.filter(F.col(level) == chosen).select(F.col(edge).alias("own_edge"))
    return own.withColumn("_one", F.lit(1)).join(near.withColumn("_one", F.lit(1)), "_one").select("own_edge", "near_edge", (F.col("own_edge") - F.col("near_edge")).alias("decay"))


def two_new_a_day(candidates: DataFrame, most: int = 2) -> DataFrame:
    """Portfolio policy: a day opens at most `most` new trades, by symbol, and a symbol is locked up to its exit.

    Days depend on one another, so it is a fold over a portfolio's candidates in order, streamed: a task holds a batch, the day's count
    and the symbols that are locked now. Of a symbol's candidates of a day only the first `most` can be taken (once one is refused, so
    are all after it), and they alone get there. Candidates without an entry or exit date are left out; of equal ones the smaller ret comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, day, opened, locked = object(), None, 0, {}
        for b in batches:
            keep = []
            for portfolio, symbol, start, end in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if portfolio != now:
                    now, day, locked = portfolio, None, {}
                if start != day:
                    day, opened = start, 0
                    locked = {s: e for s, e in locked.items() if e >= start}
                take = opened < most and symbol not in locked
                if take:
                    opened += 1
                    # A trade that ends before it starts locks nothing.
                    if end >= start:
                        locked[symbol] = end
                keep.append(take)
            yield b.filter(pa.array(keep, pa.bool_()))

    view = candidates.select("portfolio", "symbol", "entry_date", "exit_date", "ret").dropna(subset=["entry_date", "exit_date"])
    view = first_per(view, ["portfolio", "entry_date", "symbol"], [F.col("exit_date"), F.col("ret")], most)
    return in_order(view, ["portfolio"], ["entry_date", "symbol", "exit_date", "ret"]).mapInArrow(run, view.schema)


def regime_flag(bars: DataFrame, benchmark: str, fallback: str) -> DataFrame:
    """date -> whether the benchmark (or else the fallback) is above its 200-day average or up over 20 days."""
    w = by()
    long = F.when(F.count("close").over(w.rowsBetween(-199, 0)) >= 200, F.avg("close").over(w.rowsBetween(-199, 0)))
    ok = F.coalesce((F.col("close") > long) | (F.col("close") / F.lag("close", 20).over(w) - 1 > 0), F.col("close") / F.lag("close", 20).over(w) - 1 > 0, F.lit(False))
    rows = bars.filter(F.col("symbol").isin(benchmark, fallback)).withColumn("ok", ok)
    return rows.groupBy("date").agg(F.coalesce(F.max(F.when(F.col("symbol") == benchmark, F.col("ok"))), F.max(F.when(F.col("symbol") == fallback, F.col("ok")))).alias("regime_ok"))


def committee(votes: dict[str, Column], needed: int) -> list[Column]:
    """Roles vote by test; a promotion needs `needed` votes and no dissent is dropped."""
    yes = sum((v.cast("int") for v in votes.values()), F.lit(0))
    dissent = F.array_compact(F.array(*[F.when(~v, F.lit(name)) for name, v in votes.items()]))
    return [yes.alias("votes"), (yes >= needed).alias("promoted"), F.array_join(dissent, ",").alias("dissent")]


def factor_score(factors: dict[str, tuple[Column, float]], bias: float = 0.0) -> Column:
    """Weighted sum of factors clamped to 0..1, itself clamped to 0..1."""
    total = F.lit(bias)
    for value, weight in factors.values():
        total = total + weight * clamp(F.coalesce(value, F.lit(0.0)), 0.0, 1.0)
    return clamp(total, 0.0, 1.0)
