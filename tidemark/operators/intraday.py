"""Intraday context: VWAP conditions, baselines, session calendar, universe and risk checks, entry plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import ladder, reasons
from .joins import asof
from .ranking import first_per, indexed


def vwap_conditions(near_bps: float = 150.0) -> dict[str, Column]:
    """Named conditions over the columns of `windows.vwap`; each is false where a part is unknown."""
    c = F.col
    near = F.abs("distance_bps") <= near_bps
    tests = {
        "reclaim_long": c("reclaim"), "reject_short": c("reject"), "pullback_long": c("above") & near & (c("slope") == "up"), "pullback_short": ~c("above") & near & (c("slope") == "down"),
        "above_rising": c("above") & (c("slope") == "up"), "below_falling": ~c("above") & (c("slope") == "down"), "reversion_long": ~c("above") & c("extended"), "reversion_short": c("above") & c("extended"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}


def volume_baseline(bars: DataFrame) -> DataFrame:
    """Average volume of each symbol's minute of the day."""
    return bars.groupBy("symbol", (F.hour("ts") * 60 + F.minute("ts")).alias("minute")).agg(F.avg("volume").alias("baseline"))


def relative_volume(bars: DataFrame, baseline: DataFrame) -> DataFrame:
    """Volume over the baseline of the same minute, or else of the last one before it."""
    rows = bars.withColumn("minute", F.hour("ts") * 60 + F.minute("ts"))
    return asof(rows, baseline, ["symbol"], "minute", ["baseline"]).withColumn("rvol", F.col("volume") / F.col("baseline"))


def last_bars(events: DataFrame, bars: DataFrame, by: list[str], k: int) -> DataFrame:
    """Each event's last k closes at or before it; events with fewer are dropped."""
    w = Window.partitionBy(*by).orderBy("ts")
    carried = bars.withColumn("closes", F.collect_list("close").over(w.rowsBetween(-(k - 1), 0))).select(*by, "ts", "closes")
    return asof(events, carried, by, "ts", ["closes"]).filter(F.size("closes") == k)


def session_calendar(days: DataFrame, holidays: list[str], half_days: list[str], open_at: int = 570, close_at: int = 960, half_close: int = 780) -> DataFrame:
    """date -> whether there is a session, why not, and its minutes: weekends first, then holidays; half days close early."""
    listed = lambda names: F.col("date").isin([F.lit(d).cast("date") for d in names]) if names else F.lit(False)
    reason = F.when(F.weekday("date") >= 5, "weekend").when(listed(holidays), "holiday")
    end = F.when(listed(half_days), half_close).otherwise(close_at)
    return days.withColumns({"closed_because": reason, "open_minute": F.when(reason.isNull(), open_at), "close_minute": F.when(reason.isNull(), end), "last_entry_minute": F.when(reason.isNull(), end - 30)})


def universe(candidates: DataFrame, key: str, order: str, rules: list[tuple[Column, str]], score: str, manual: str, limit: int) -> DataFrame:
    """The last row of each key; one first-fail reason each; what is left ranks manual first, then by score; overflow is rejected."""
    rows = first_per(candidates, [key], [F.col(order).desc()]).withColumn("reason", ladder(rules, ""))
    # Placed by manual and whole scores, so that no task ranks all candidates.
    grade = F.struct(F.coalesce(-F.col(manual).cast("int"), F.lit(1)).alias("m"), F.coalesce(-F.floor(score), F.lit((1 << 63) - 1)).alias("s"))
    order_by = [F.col(manual).desc_nulls_last(), F.col(score).desc_nulls_last(), F.col(key)]
    taken = indexed(rows.filter("reason = ''").withColumn("_grade", grade), [], "_grade", order_by, "_at").withColumn("rank", (F.col("_at") + 1).cast("int")).select(*rows.columns, "rank")
    taken = taken.withColumn("reason", F.when(F.col("rank") > limit, "max_symbols").otherwise(F.col("reason")))
    return taken.unionByName(rows.filter("reason <> ''").withColumn("rank", F.lit(None).cast("int")))


def risk_checks(trades: DataFrame, by: list[str], order: list[str], symbol: str, pnl: str, max_trades: int, max_per_symbol: int, max_loss: float) -> DataFrame:
    """The limits that a trade would break given the session's earlier ones, in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*by, symbol).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    state = trades.withColumns({"trades_before": F.count("*").over(before), "symbol_before": F.count("*").over(same), "pnl_before": F.coalesce(F.sum(pnl).over(before), F.lit(0.0))})
    tests = [(F.col("trades_before") >= max_trades, "MAX_TRADES"), (F.col("symbol_before") >= max_per_symbol, "MAX_PER_SYMBOL"), (F.col("pnl_before") <= -max_loss, "MAX_LOSS")]
    return state.withColumn("blockers", reasons(tests))


def entry_variants(bars: DataFrame, atr: str = "atr", multiple: float = 1.5) -> DataFrame:
    """Brackets for a long entry from a bar: at its close, on a stop above its high, and on a limit at the prior 20-bar high."""
    c = F.col
    risk = c(atr) * multiple
    bracket = lambda name, entry, ok: F.when(ok & (risk > 0), F.struct(F.lit(name).alias("variant"), entry.alias("entry"), (entry - risk).alias("stop"), (entry + 4 * risk).alias("target")))
    made = F.array_compact(F.array(bracket("base_limit", c("close"), F.lit(True)), bracket("stop_confirmation", c("high") * 1.001, F.lit(True)), bracket("retest_limit", c("prior_high20"), c("close") > c("prior_high20"))))
    return bars.select("symbol", "date", F.inline(made))


def failure_classes(reason: Column, metrics: list[tuple[Column, str]], tokens: dict[str, str]) -> Column:
    """All classes whose token the reason text has, then those whose metric test holds."""
    return reasons([*((F.lower(reason).contains(t), name) for t, name in tokens.items()), *metrics])


def position_size(equity: float, risk_share: float, entry: Column, stop: Column, adv_shares: Column, adv_share: float, max_exposure: float) -> Column:
    """Whole shares by the tightest of risk, liquidity and exposure caps; 0 without risk."""
    risk = entry - stop
    return F.when(risk > 0, F.floor(F.least(equity * risk_share / risk, adv_shares * adv_share, equity * max_exposure / entry))).otherwise(0).cast("long")
