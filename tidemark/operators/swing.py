"""Swing signals by variant, their trades, and the candidates of an episode's decision days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import non_overlapping
from .windows import by, episodes, swing_indicators

VARIANTS = ("CONTRACTION_ONLY", "TREND_ONLY", "RANDOM_MATCHED", "VOL_HIGH_ONLY")


def signals(bars: DataFrame, regime: DataFrame, variant: str = "CONTRACTION_ONLY") -> DataFrame:
    """(symbol, idx, date, atr_before) of days in an uptrend of the symbol and a good regime.

    CONTRACTION_ONLY: the day before's ATR share is at most the 40% quantile of the 120 days before; VOL_HIGH_ONLY: at least their 60%
    quantile; TREND_ONLY and RANDOM_MATCHED ask nothing more. regime: (date, regime_ok); days without one are bad. A symbol's last bar
    gives no signal, as it has no next open.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    w = by()
    frame = w.rowsBetween(-120, -1)
    rows = swing_indicators(bars).withColumns({"idx": F.row_number().over(w) - 1, "atr_before": F.lag("atr_pct").over(w), "_last": F.lead("date").over(w).isNull()})
    if variant == "VOL_HIGH_ONLY":
        rows = rows.withColumn("_p60", F.when(F.count("atr_pct").over(frame) >= 120, F.percentile("atr_pct", F.lit(0.6)).over(frame)))
    trend = (F.col("close") > F.col("sma50")) & (F.coalesce(F.col("close") > F.col("sma200"), F.lit(False)) | F.coalesce(F.col("sma50") > F.col("sma200"), F.lit(False)))
    more = {"CONTRACTION_ONLY": lambda: F.col("atr_before") <= F.col("atr_p40"), "VOL_HIGH_ONLY": lambda: F.col("atr_before") >= F.col("_p60")}.get(variant, lambda: F.lit(True))()
    ok = rows.join(regime.filter("regime_ok").select("date"), "date", "left_semi").filter(~F.col("_last") & trend & more)
    return ok.select("symbol", "idx", "date", "atr_before")


def trades(found: DataFrame, bars: DataFrame, hold: int, costs_bps: tuple[float, ...] = (), one_active: bool = False) -> DataFrame:
    """A trade a signal: in at the next open, out at the close `hold` days later or at the last one (truncated).

    one_active: a signal on or before its symbol's last exit is passed over, a fold of each symbol's signals. Signals without a later
    exit, or with a price that isn't positive, give no trade.
    """
    w = by()
    ahead = w.rowsBetween(1, hold + 1)
    marks = bars.withColumns({"idx": F.row_number().over(w) - 1, "entry_date": F.lead("date").over(w), "entry_price": F.lead("open").over(w), "exit_date": F.last("date").over(ahead), "exit_price": F.last("close").over(ahead), "_days": F.count("*").over(ahead) - 1})
    made = found.drop("date").join(marks.select("symbol", "idx", "date", "entry_date", "entry_price", "exit_date", "exit_price", "_days"), ["symbol", "idx"])
    made = made.filter((F.col("_days") > 0) & (F.col("entry_price") > 0) & (F.col("exit_price") > 0))
    made = made.withColumns({"_end": F.col("idx") + 1 + F.col("_days"), "gross": F.col("exit_price") / F.col("entry_price") - 1})
    if one_active:
        made = made.join(non_overlapping(made, ["symbol"], "idx", "_end", "date").select("symbol", "idx"), ["symbol", "idx"], "left_semi")
    nets = {f"net_{c:g}bps": F.col("gross") - c / 10_000 for c in costs_bps}
    return made.withColumns(nets).select("symbol", F.col("date").alias("signal_date"), "entry_date", "exit_date", F.col("_days").alias("days"), (F.col("_days") < hold).alias("truncated"), "gross", *nets)


def episode_candidates(found: DataFrame, bars: DataFrame, max_gap: int = 5, window: int = 5) -> DataFrame:
    """A row a day on which an episode may be entered: from its first signal to `window` days on, at most to its last signal.

    Signals of a symbol at most max_gap bars apart are one episode; its rank is its least ATR share. Days without a next bar are left out.
    """
    grouped = episodes(found, "idx", max_gap).groupBy("symbol", "episode").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("signals"), F.min("atr_before").alias("least_atr"))
    days = grouped.withColumn("idx", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + window, F.col("last")))))
    w = by()
    numbered = bars.select("symbol", "date", (F.row_number().over(w) - 1).alias("idx"), F.lead("date").over(w).alias("_next")).filter("_next IS NOT NULL")
    return days.join(numbered, ["symbol", "idx"]).select("symbol", "episode", F.col("date").alias("decision_date"), (F.col("idx") - F.col("first")).alias("offset"), "signals", "least_atr")
