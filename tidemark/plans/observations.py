"""Queries of paper observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators.observations import close_observations
from ..registry import query
from .inputs import BARS, daily_bars, table


@query(
    "paper_close",
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars),
t AS (SELECT o_orderkey AS trade_id, 'S' || (o_orderkey % 5) AS symbol, o_orderdate::DATE AS opened_at, CASE WHEN o_orderkey % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign, (o_custkey % 9 + 1)::DOUBLE AS qty FROM orders),
e AS (SELECT t.*, close AS entry, i AS k FROM t ASOF JOIN n ON t.symbol = n.symbol AND t.opened_at >= n.date), h AS (SELECT *, entry * (1 - sign * 0.25) AS stop, entry * (1 + sign * CASE WHEN trade_id % 50 = 0 THEN -0.1 ELSE 0.6 END) AS target FROM e),
g AS (SELECT *, sign * (entry - stop) AS risk FROM h), p AS (SELECT g.*, n.i, n.date, open, high, low, close, CASE WHEN sign * (open - stop) <= 0 THEN 'stop_gap' WHEN sign * (open - target) >= 0 THEN 'target_gap' WHEN CASE WHEN sign > 0 THEN low <= stop ELSE high >= stop END THEN 'stop_hit'
  WHEN CASE WHEN sign > 0 THEN high >= target ELSE low <= target END THEN 'target_hit' WHEN n.i - k = 6 THEN 'time_stop' END AS how FROM g JOIN n ON g.symbol = n.symbol AND n.i BETWEEN k + 1 AND k + 6 WHERE risk > 0 AND sign * (target - entry) > 0),
x AS (SELECT *, min(i) FILTER (WHERE how IS NOT NULL) OVER (PARTITION BY trade_id) AS ended FROM p),
d AS (SELECT trade_id, any_value(how) FILTER (WHERE i = ended) AS exit_reason, any_value(CASE how WHEN 'stop_gap' THEN open WHEN 'stop_hit' THEN stop WHEN 'time_stop' THEN close ELSE target END) FILTER (WHERE i = ended) AS exit_price, max(date) AS closed_at, max(i - k) AS bars_held,
  greatest(0, max(greatest(sign * (high - entry), sign * (low - entry)) / risk)) AS mfe_r, least(0, min(least(sign * (high - entry), sign * (low - entry)) / risk)) AS mae_r FROM x WHERE i <= ended GROUP BY trade_id)
SELECT g.trade_id, CASE WHEN exit_reason IS NULL THEN 'pending' ELSE 'closed' END AS status, exit_reason, exit_price, closed_at, bars_held, sign * (exit_price - entry) / risk AS r, mfe_r, mae_r, sign * (exit_price - entry) * qty AS pnl FROM g LEFT JOIN d USING (trade_id)""",
    ("exit_price", "r", "mfe_r", "mae_r", "pnl"),
)
def paper_close(spark, sf_dir):
    c = F.col
    bars = daily_bars(spark, sf_dir)
    short = c("o_orderkey") % 2 == 0
    opened = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("trade_id"), F.concat(F.lit("S"), (c("o_orderkey") % 5).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("date"), F.when(short, " Short").otherwise("long").alias("side"), (c("o_custkey") % 9 + 1).cast("double").alias("qty"))
    priced = J.asof(opened, bars.select("symbol", "date", c("close").alias("entry")), ["symbol"], "date", ["entry"]).filter("entry IS NOT NULL")
    sign = F.when(c("side") == " Short", -1.0).otherwise(1.0)
    far = F.when(c("trade_id") % 50 == 0, -0.1).otherwise(0.6)
    trades = priced.select("trade_id", "symbol", "side", "qty", "entry", c("date").alias("opened_at"), (c("entry") * (1 - sign * 0.25)).alias("stop"), (c("entry") * (1 + sign * far)).alias("target"))
    return close_observations(trades, bars, 6)
