"""Queries of window vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding as E
from ..operators import joins as J
from ..registry import query
from .inputs import BARS, daily_bars

SIZES = [20, 60]
#: Which symbol's closes stand for each benchmark.
_OF = dict(zip(E.BENCHMARKS, ("S0", "S1", "S2"), strict=False))


def embedded_bars(spark, sf_dir):
    """Daily bars with the closes of three benchmarks as of each day; there is none for industries."""
    bars = daily_bars(spark, sf_dir)
    for name, symbol in _OF.items():
        closes = bars.filter(F.col("symbol") == symbol).select("date", F.col("close").alias(name))
        bars = J.asof_small(bars, closes, "date", [name]).drop("matched_at")
    return bars


@query("window_embedding")
def window_embedding(spark, sf_dir):
    return E.embed_windows(embedded_bars(spark, sf_dir), [60])


_SCALARS = {
    "cumulative_return": "close / first - 1", "last_quarter_return": "close / quarter - 1", "gap_pct": "open / previous - 1", "breakout_strength": "close / top - 1", "breakdown_strength": "bottom / close - 1",
    "trend_regime": "CASE WHEN close >= mean20 AND mean20 >= mean50 THEN 1 WHEN close <= mean20 AND mean20 <= mean50 THEN -1 ELSE 0 END", "liquidity_score": "least(1, ln(1 + turnover) / ln(50000001))",
    "long_trigger": "CASE WHEN close >= top * 0.995::DOUBLE THEN 1 WHEN low <= top AND close > top * 0.99::DOUBLE AND close > open THEN 0.78 WHEN close > previous AND close > mean20 THEN 0.58 ELSE 0 END",
    "short_trigger": "CASE WHEN close <= bottom * 1.005::DOUBLE THEN 1 WHEN high >= bottom AND close < bottom * 1.01::DOUBLE AND close < open THEN 0.78 WHEN close < previous AND close < mean20 THEN 0.58 ELSE 0 END",
    "strength_first": "close / first - 1 - r1", "strength_second": "close / first - 1 - r2", "strength_sector": "CASE WHEN r3 <> 0 THEN close / first - 1 - r3 ELSE 0 END",
    "market_return": "CASE WHEN r1 <> 0 AND r2 <> 0 THEN (r1 + r2) / 2 ELSE r1 + r2 END", "alignment": "CASE WHEN close = first OR lead = 0 OR sign(close / first - 1) = sign(lead) THEN 1 ELSE -1 END",
    "close_position_23": "least(greatest((close - low) / greatest(high - low, 1e-9), 0), 1)", "body_23": "least(abs(close - open) / greatest(high - low, 1e-9), 1)", "drawdown_23": "close / highest - 1", "from_low_23": "close / lowest - 1",
}


def _scalars_sql(size: int) -> str:
    look = min(20, max(2, size - 1))
    ret = lambda b, n: f"CASE WHEN count({b}) OVER w >= 2 THEN last_value({b} IGNORE NULLS) OVER w / first_value({b} IGNORE NULLS) OVER w - 1 ELSE 0 END AS r{n}"
    return f"""SELECT symbol, date, {size} AS size, open, high, low, close, count(*) OVER w AS n, first_value(close) OVER w AS first, lag(close, {size - 1 - size * 3 // 4}) OVER s AS quarter, lag(close) OVER s AS previous,
  max(high) OVER (s ROWS BETWEEN {look} PRECEDING AND 1 PRECEDING) AS top, min(low) OVER (s ROWS BETWEEN {look} PRECEDING AND 1 PRECEDING) AS bottom, avg(close) OVER (s ROWS {min(20, size) - 1} PRECEDING) AS mean20, avg(close) OVER (s ROWS {min(50, size) - 1} PRECEDING) AS mean50,
  avg(close * volume) OVER (s ROWS {look - 1} PRECEDING) AS turnover, max(close) OVER w AS highest, min(close) OVER w AS lowest, {", ".join(ret(b, i + 1) for i, b in enumerate(_OF))}
FROM x WINDOW s AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS {size - 1} PRECEDING)"""


_ASOF = " ".join(f"ASOF LEFT JOIN (SELECT date, close AS {b} FROM bars WHERE symbol = '{s}') b_{b} ON bars.date >= b_{b}.date" for b, s in _OF.items())


@query(
    "window_embedding_scalars",
    f"""WITH {BARS}, x AS (SELECT bars.*, {", ".join(_OF)} FROM bars {_ASOF}), v AS ({" UNION ALL ".join(map(_scalars_sql, SIZES))}), u AS (SELECT *, CASE WHEN r1 <> 0 THEN r1 ELSE r2 END AS lead FROM v WHERE n = size)
SELECT symbol, date, size, {", ".join(f"({x})::REAL::DOUBLE AS {name}" for name, x in _SCALARS.items())} FROM u""",
    tuple(_SCALARS),
)
def window_embedding_scalars(spark, sf_dir):
    found = E.embed_windows(embedded_bars(spark, sf_dir), SIZES)
    return found.select("symbol", "date", "size", *[F.get("vector", F.lit(E.slot(name))).cast("double").alias(name) for name in _SCALARS])
