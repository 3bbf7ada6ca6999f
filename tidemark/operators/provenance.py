"""What kind of evidence a trade is, from the JSON metadata that it carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import ladder
from .ranking import first_per

# Types of evidence, and where a fill's price may come from.
TYPES = ["near_miss_shadow", "shadow_no_order", "ibkr_paper_order", "ibkr_paper_fill", "live_order", "live_fill"]
PROVENANCE = ["broker_execution", "broker_statement_import", "simulated_close", "shadow_close"]
REAL_FILLS = ["broker_execution", "broker_statement_import"]
SHADOW_MODE = "lab_shadow_observation"


def _text(metadata: Column, key: str) -> Column:
    return F.trim(F.coalesce(F.get_json_object(metadata, f"$.{key}"), F.lit("")))


def _holds(metadata: Column, key: str) -> Column:
    """Whether a value is there and not false, zero or empty. The text "false" counts as false."""
    return ~_text(metadata, key).isin("", "false", "0", "0.0", "[]", "{}", "null")


def evidence(trades: DataFrame, metadata: str = "metadata", status: str = "status") -> DataFrame:
    """Adds evidence_type (null: unknown), evidence_quality and fill_provenance (null: unknown).

    An explicit type counts if it is one of TYPES; else shadows are told by their flags, and orders by the mode of execution or by a
    broker's order number. An order is a fill once the trade is closed with a price that a broker has reported. Quality is standard
    unless it is stated otherwise. Null or broken metadata: no type, standard.
    """
    m = F.col(metadata)
    near = _holds(m, "near_miss_shadow") | (_holds(m, "near_miss") & _holds(m, "no_ibkr_order"))
    mode = _text(m, "execution_mode")
    unordered = _holds(m, "no_ibkr_order") | _holds(m, "observation_only") | (mode == SHADOW_MODE)
    stated = _text(m, "fill_provenance")
    provenance = F.when(stated.isin(PROVENANCE), stated).when(near | unordered, "shadow_close")
    filled = (F.trim(F.coalesce(F.col(status), F.lit(""))) == "closed") & F.coalesce(provenance.isin(REAL_FILLS), F.lit(False))
    explicit = _text(m, "evidence_type")
    venue = F.coalesce(F.nullif(_text(m, "ibkr_mode"), F.lit("")), _text(m, "trading_mode"))
    ordered = _holds(m, "broker_order_id") | _holds(m, "parent_order_id")
    order = ladder(
        [
            (explicit.isin(TYPES), "explicit"), (near, "near_miss_shadow"), (unordered, "shadow_no_order"), ((mode == "ibkr") & (venue == "paper"), "ibkr_paper_order"), ((mode == "ibkr") & (venue == "live"), "live_order"),
            ((mode == "paper") | ordered, "ibkr_paper_order"),
        ], "",
    )
    kind = F.when(order == "explicit", explicit).otherwise(F.nullif(order, F.lit("")))
    kind = F.when(filled & (kind == "ibkr_paper_order"), "ibkr_paper_fill").when(filled & (kind == "live_order"), "live_fill").otherwise(kind)
    quality = _text(m, "evidence_quality")
    return trades.withColumns({"evidence_type": kind, "evidence_quality": F.when(quality.isin("", "normal"), "standard").otherwise(quality), "fill_provenance": provenance})


def intraday_key(metadata: Column) -> Column:
    """What tells an intraday signal apart besides symbol, pattern and time frame: variant, end of window and session; null if one lacks."""
    of = lambda key: F.get_json_object(metadata, f"$.intraday.{key}")
    variant = F.coalesce(of("entry_variant"), of("entry_variant_id"))
    whole = variant.isNotNull() & of("window_end").isNotNull() & of("session_id").isNotNull()
    return F.when(whole, F.struct(variant.alias("variant"), of("window_end").alias("window_end"), of("session_id").alias("session_id")))


def unique_signals(signals: DataFrame, order: list[Column], metadata: str = "metadata") -> DataFrame:
    """The first signal of each symbol, pattern, time frame and intraday key; signals without such a key all stay."""
    keyed = signals.withColumn("_key", intraday_key(F.col(metadata)))
    names = ["symbol", "pattern", "timeframe", "_key"]
    once = first_per(keyed.filter("_key IS NOT NULL"), names, order)
    return once.unionByName(keyed.filter("_key IS NULL")).drop("_key")
