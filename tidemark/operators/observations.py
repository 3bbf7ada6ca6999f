"""Paper observations: closed by the bars after they were opened, or still pending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof
from .windows import by


def close_observations(trades: DataFrame, bars: DataFrame, hold: int, at: str = "date") -> DataFrame:
    """Per trade: status (closed, pending), exit_reason, exit_price, closed_at, bars_held, r, mfe_r, mae_r, pnl.

    trades: trade_id, symbol, side (short, else long), entry, stop, target, qty, opened_at; bars: symbol, `at`, open, high, low, close,
    one a symbol and time. A trade stands at its entry before the first bar after opened_at. In each bar, in this order: an open
    beyond the stop exits at the open (stop_gap), one beyond the target at the target, as a limit doesn't collect the gap (target_gap),
    and within a bar the stop wins where both are reached (stop_hit, target_hit); after `hold` bars the close (time_stop). Excursions hold
    the entry and whole bars, the exit's too. Pending: no bar yet, no exit in fewer than `hold` bars, or an entry not between stop and target.

    Bars are numbered by symbol and a trade meets the `hold` after its own number by an equi-join; no path is gathered in a row.
    """
    w = by("symbol", at)
    numbered = bars.select("symbol", at, "open", "high", "low", "close", F.row_number().over(w).alias("_i"))
    placed = asof(trades.withColumn(at, F.col("opened_at")), numbered.select("symbol", at, "_i"), ["symbol"], at, ["_i"]).withColumn("_k", F.coalesce("_i", F.lit(0)))
    sign = F.when(F.lower(F.trim("side")) == "short", -1.0).otherwise(1.0)
    held = placed.select(*[c for c in trades.columns], "_k", sign.alias("_sign")).withColumn("_risk", F.col("_sign") * (F.col("entry") - F.col("stop")))
    sound = held.filter((F.col("_risk") > 0) & (F.col("_sign") * (F.col("target") - F.col("entry")) > 0))
    days = sound.select("trade_id", "symbol", "_sign", "_risk", "entry", "stop", "target", "_k", F.explode(F.sequence(F.col("_k") + 1, F.col("_k") + hold)).alias("_i"))
    path = days.join(numbered, ["symbol", "_i"])
    beyond = lambda price, level: F.col("_sign") * (F.col(price) - F.col(level)) >= 0
    short = F.col("_sign") < 0
    worst, best = F.when(short, F.col("high")).otherwise(F.col("low")), F.when(short, F.col("low")).otherwise(F.col("high"))
    stopped, reached = F.col("_sign") * (worst - F.col("stop")) <= 0, F.col("_sign") * (best - F.col("target")) >= 0
    gap_stop = F.col("_sign") * (F.col("open") - F.col("stop")) <= 0
    how = F.when(gap_stop, "stop_gap").when(beyond("open", "target"), "target_gap").when(stopped, "stop_hit").when(reached, "target_hit").when(F.col("_i") - F.col("_k") == hold, "time_stop")
    path = path.withColumn("_how", how)
    price = F.when(F.col("_how") == "stop_gap", F.col("open")).when(F.col("_how") == "stop_hit", F.col("stop")).when(F.col("_how") == "time_stop", F.col("close")).otherwise(F.col("target"))
    # A trade's bars are at most `hold`.
    ended = F.min(F.when(F.col("_how").isNotNull(), F.col("_i"))).over(Window.partitionBy("trade_id"))
    seen = path.withColumn("_end", ended).filter(F.col("_end").isNotNull() & (F.col("_i") <= F.col("_end")))
    gain = lambda p: F.col("_sign") * (F.col(p) - F.col("entry")) / F.col("_risk")
    last = F.col("_i") == F.col("_end")
    done = seen.groupBy("trade_id").agg(
        F.max(F.when(last, F.col("_how"))).alias("exit_reason"), F.max(F.when(last, price)).alias("exit_price"), F.max(F.when(last, F.col(at))).alias("closed_at"), F.max(F.col("_i") - F.col("_k")).alias("bars_held"),
        F.greatest(F.lit(0.0), F.max(F.greatest(gain("high"), gain("low")))).alias("mfe_r"), F.least(F.lit(0.0), F.min(F.least(gain("high"), gain("low")))).alias("mae_r"),
    )
    out = held.join(done, "trade_id", "left")
    move = F.col("_sign") * (F.col("exit_price") - F.col("entry"))
    return out.select("trade_id", F.when(F.col("exit_reason").isNull(), "pending").otherwise("closed").alias("status"), "exit_reason", "exit_price", "closed_at", "bars_held", (move / F.col("_risk")).alias("r"), "mfe_r", "mae_r", (move * F.col("qty")).alias("pnl"))
