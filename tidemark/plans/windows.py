"""Queries of window and time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..registry import query
from .inputs import BARS, BENCHMARK, INTRADAY, TRADES, daily_bars, intraday_bars, table, trades

_TR = """tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
atr AS (SELECT *, CASE WHEN count(tr) OVER f >= 14 THEN avg(tr) OVER f END AS atr FROM tr WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""


@query(
    "gap_event_ledger",
    f"""WITH {BARS}, {_TR},
a AS (SELECT *, lag(date) OVER w AS previous_date, lag(close) OVER w AS previous_close, open / lag(close) OVER w - 1 AS gap_pct, lag(atr / close) OVER w AS prior_atr_pct,
  lag(close, 1) OVER w / lag(close, 6) OVER w - 1 AS prior_return_5d, lag(close, 1) OVER w / lag(close, 21) OVER w - 1 AS prior_return_20d, lag(volume) OVER w AS prior_volume,
  close / open - 1 AS open_to_close, lead(open) OVER w / close - 1 AS close_to_next_open, lead(close) OVER w / lead(open) OVER w - 1 AS next_open_to_close, row_number() OVER w - 1 AS rn
  FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY date)),
b AS (SELECT *, CASE WHEN gap_pct > 0 THEN 'up' WHEN gap_pct < 0 THEN 'down' ELSE 'flat' END AS gap_direction FROM a)
SELECT b.symbol, b.date, previous_date, gap_pct, gap_direction, prior_atr_pct, prior_return_5d, b.prior_return_20d, prior_volume, open_to_close, close_to_next_open, next_open_to_close,
  CASE gap_direction WHEN 'up' THEN low <= previous_close WHEN 'down' THEN high >= previous_close ELSE FALSE END AS gap_filled,
  CASE WHEN open <> previous_close THEN least(greatest(CASE gap_direction WHEN 'up' THEN (open - low) / (open - previous_close) ELSE (high - open) / (previous_close - open) END, 0.0), 1.0) END AS gap_fill_ratio,
  CASE WHEN b.symbol = '{BENCHMARK}' THEN 'BENCHMARK' WHEN rn < 20 THEN 'INSUFFICIENT_HISTORY' WHEN gap_pct IS NULL THEN 'MISSING' WHEN abs(gap_pct) < 0.005 THEN 'GAP_TOO_SMALL' WHEN abs(gap_pct) >= 0.25 THEN 'SPLIT_SUSPECT' ELSE 'DATA_OK' END AS data_quality_status,
  s.prior_return_20d AS benchmark_return_20d
FROM b LEFT JOIN (SELECT date, prior_return_20d FROM b WHERE symbol = '{BENCHMARK}') s ON s.date = b.date""",
    ("gap_pct", "prior_atr_pct", "prior_return_5d", "prior_return_20d", "prior_volume", "open_to_close", "close_to_next_open", "next_open_to_close", "gap_fill_ratio", "benchmark_return_20d"),
)
def gap_event_ledger(spark, sf_dir):
    ledger = W.gap_ledger(daily_bars(spark, sf_dir), BENCHMARK)
    return ledger.select(
        "symbol", "date", "previous_date", "gap_pct", "gap_direction", "prior_atr_pct", "prior_return_5d", "prior_return_20d", "prior_volume", "open_to_close", "close_to_next_open",
        "next_open_to_close", "gap_filled", "gap_fill_ratio", "data_quality_status", "benchmark_return_20d",
    )


@query("atr_daily", f"WITH {BARS}, {_TR} SELECT symbol, date, tr, atr FROM atr", ("tr", "atr"))
def atr_daily(spark, sf_dir):
    return W.atr(daily_bars(spark, sf_dir)).select("symbol", "date", "tr", "atr")


@query(
    "sma_partial",
    f"WITH {BARS} SELECT symbol, date, CASE WHEN count(close) OVER f >= 5 THEN avg(close) OVER f END AS sma FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    ("sma",),
)
def sma_partial(spark, sf_dir):
    return daily_bars(spark, sf_dir).select("symbol", "date", W.sma(F.col("close"), W.by(), 10).alias("sma"))


@query(
    "swing_indicators",
    f"""WITH {BARS}, {_TR},
a AS (SELECT *, CASE WHEN count(close) OVER f50 >= 50 THEN avg(close) OVER f50 END AS sma50, CASE WHEN count(close) OVER f200 >= 200 THEN avg(close) OVER f200 END AS sma200,
  close / lag(close, 20) OVER w - 1 AS ret20, coalesce(close < lag(close) OVER w, FALSE) AS down, atr / close AS atr_pct, row_number() OVER w AS n,
  CASE WHEN count(high) OVER f20 >= 20 THEN max(high) OVER f20 END AS prior_high20
  FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY date), f50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), f200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING),
    f20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, max(CASE WHEN NOT down THEN n END) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS off,
  CASE WHEN count(atr_pct) OVER g >= 120 THEN quantile_cont(atr_pct, 0.4) OVER g END AS atr_p40 FROM a WINDOW g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING))
SELECT symbol, date, sma50, sma200, ret20, (CASE WHEN down THEN n - coalesce(off, 0) ELSE 0 END)::BIGINT AS down_streak, atr_pct, atr_p40, prior_high20 FROM b""",
    ("sma50", "sma200", "ret20", "atr_pct", "atr_p40", "prior_high20"),
)
def swing_indicators(spark, sf_dir):
    out = W.swing_indicators(daily_bars(spark, sf_dir))
    return out.select("symbol", "date", "sma50", "sma200", "ret20", F.col("down_streak").cast("long").alias("down_streak"), "atr_pct", "atr_p40", "prior_high20")


_REGIME = f"""WITH {BARS},
l AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM bars),
v AS (SELECT *, CASE WHEN count(close) OVER s >= 200 THEN avg(close) OVER s END AS sma, CASE WHEN count(r) OVER u >= 20 THEN stddev_samp(r) OVER u * sqrt(252) END AS vol
  FROM l WINDOW s AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), u AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
c AS (SELECT *, CASE WHEN count(vol) OVER g >= 252 THEN quantile_cont(vol, 1.0 / 3) OVER g END AS low_cut, CASE WHEN count(vol) OVER g >= 252 THEN quantile_cont(vol, 2.0 / 3) OVER g END AS high_cut
  FROM v WINDOW g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
reg AS (SELECT *, CASE WHEN sma IS NULL THEN 'unknown' WHEN close > sma THEN 'up' ELSE 'down' END AS trend,
  CASE WHEN low_cut IS NULL OR vol IS NULL THEN 'unknown' WHEN vol <= low_cut THEN 'low' WHEN vol >= high_cut THEN 'high' ELSE 'mid' END AS vol_regime FROM c)"""


@query("benchmark_regimes", f"{_REGIME} SELECT symbol, date, sma, vol, trend, vol_regime, trend || '_' || vol_regime AS regime_key FROM reg", ("sma", "vol"))
def benchmark_regimes(spark, sf_dir):
    return W.regime_table(daily_bars(spark, sf_dir)).select("symbol", "date", "sma", "vol", "trend", "vol_regime", "regime_key")


@query("max_drawdown", f"WITH {BARS}, d AS (SELECT symbol, (close - max(close) OVER w) / max(close) OVER w AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, min(dd) AS max_drawdown FROM d GROUP BY symbol", ("max_drawdown",))
def max_drawdown(spark, sf_dir):
    return W.drawdown(daily_bars(spark, sf_dir), "close")


@query(
    "equity_curve",
    f"""WITH {TRADES}, d AS (SELECT pattern, exit_date, sum(ret) AS pnl FROM trades GROUP BY ALL), e AS (SELECT *, sum(pnl) OVER (PARTITION BY pattern ORDER BY exit_date) AS equity FROM d),
p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY pattern ORDER BY exit_date), 0.0) AS peak FROM e) SELECT pattern, exit_date, pnl, equity, equity - peak AS drawdown FROM p""",
    ("pnl", "equity", "drawdown"),
)
def equity_curve(spark, sf_dir):
    return W.equity_curve(trades(spark, sf_dir)).drop("peak")


def _streak_sql(test: str) -> str:
    return f"""WITH {TRADES}, a AS (SELECT *, row_number() OVER w AS n FROM trades WINDOW w AS (PARTITION BY pattern ORDER BY entry_date, trade_id)),
b AS (SELECT *, max(CASE WHEN NOT ({test}) THEN n END) OVER (PARTITION BY pattern ORDER BY n ROWS UNBOUNDED PRECEDING) AS off FROM a)
SELECT pattern, max(CASE WHEN {test} THEN n - coalesce(off, 0) ELSE 0 END)::BIGINT AS worst_streak FROM b GROUP BY pattern"""


@query("loss_streak_inclusive", _streak_sql("ret <= 0"))
def loss_streak_inclusive(spark, sf_dir):
    return W.worst_streak(trades(spark, sf_dir), F.col("ret") <= 0, "pattern", ["entry_date", "trade_id"]).withColumn("worst_streak", F.col("worst_streak").cast("long"))


@query("loss_streak_strict", _streak_sql("ret < 0"))
def loss_streak_strict(spark, sf_dir):
    return W.worst_streak(trades(spark, sf_dir), F.col("ret") < 0, "pattern", ["entry_date", "trade_id"]).withColumn("worst_streak", F.col("worst_streak").cast("long"))


@query(
    "vwap_session",
    f"""WITH {INTRADAY}, c AS (SELECT *, sum(volume) OVER w AS cv, sum((high + low + close) / 3 * volume) OVER w AS cpv FROM ibars WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)),
v AS (SELECT *, CASE WHEN cv > 0 THEN cpv / cv END AS vwap FROM c),
d AS (SELECT *, (close / vwap - 1) * 10000 AS distance_bps, (vwap / lag(vwap, 3) OVER w - 1) * 10000 AS slope_bps, close > vwap AS up, lag(close > vwap) OVER w AS was, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)),
e AS (SELECT *, coalesce(up <> was, FALSE) AS crossed FROM d)
SELECT symbol, ts, vwap, distance_bps, slope_bps, coalesce(up, FALSE) AS above, crossed, coalesce(up AND NOT was, FALSE) AS reclaim, coalesce(NOT up AND was, FALSE) AS reject,
  coalesce(abs(distance_bps) >= 150, FALSE) AS extended, CASE WHEN slope_bps IS NULL THEN 'unknown' WHEN slope_bps > 1 THEN 'up' WHEN slope_bps < -1 THEN 'down' ELSE 'flat' END AS slope,
  (n - max(CASE WHEN crossed THEN n END) OVER (PARTITION BY symbol, session ORDER BY ts))::INTEGER AS bars_since_cross FROM e""",
    ("vwap", "distance_bps", "slope_bps"),
    8,
)
def vwap_session(spark, sf_dir):
    return W.vwap(intraday_bars(spark, sf_dir)).select("symbol", "ts", "vwap", "distance_bps", "slope_bps", "above", "crossed", "reclaim", "reject", "extended", "slope", "bars_since_cross")


@query(
    "opening_range",
    f"WITH {INTRADAY}, f AS (SELECT *, min(ts) OVER (PARTITION BY symbol, session) AS first FROM ibars) SELECT symbol, session, max(high) AS or_high, min(low) AS or_low, count(*) AS or_bars FROM f WHERE ts < first + INTERVAL '30 minutes' GROUP BY ALL",
    ("or_high", "or_low"),
)
def opening_range(spark, sf_dir):
    return W.opening_range(intraday_bars(spark, sf_dir))


@query(
    "feature_cube",
    f"""WITH {INTRADAY} SELECT symbol, ts, close / lag(close, 1) OVER w - 1 AS ret1, close / lag(close, 3) OVER w - 1 AS ret3,
  (high - low) / nullif(avg(high - low) OVER (PARTITION BY symbol, session ORDER BY ts ROWS 4 PRECEDING), 0) AS compression5, (high - low) / nullif(avg(high - low) OVER (PARTITION BY symbol, session ORDER BY ts ROWS 7 PRECEDING), 0) AS compression8,
  CASE WHEN max(high) OVER w > min(low) OVER w THEN least(greatest((close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w), 0), 1) END AS range_position
FROM ibars WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)""",
    ("ret1", "ret3", "compression5", "compression8", "range_position"),
)
def feature_cube(spark, sf_dir):
    return W.feature_cube(intraday_bars(spark, sf_dir)).select("symbol", "ts", "ret1", "ret3", "compression5", "compression8", "range_position")


def _signals(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).withColumn("idx", F.row_number().over(W.by()) - 1)
    return bars.withColumn("down", F.col("close") < F.lag("close").over(W.by())).filter("down")


@query(
    "signal_episodes",
    f"""WITH {BARS}, a AS (SELECT symbol, date, row_number() OVER w - 1 AS idx, close < lag(close) OVER w AS down FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT *, coalesce(idx - lag(idx) OVER (PARTITION BY symbol ORDER BY idx), 999999) AS gap FROM a WHERE down), e AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY idx) AS episode FROM g)
SELECT symbol, episode::BIGINT AS episode, count(*) AS signals, min(date) AS first_date, max(date) AS last_date FROM e GROUP BY ALL""",
)
def signal_episodes(spark, sf_dir):
    return W.episodes(_signals(spark, sf_dir), "idx", 3).groupBy("symbol", "episode").agg(F.count("*").alias("signals"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("rate_budget", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS used FROM events")
def rate_budget(spark, sf_dir):
    return W.rate_budget(table(spark, sf_dir, "events"), 3600, "user_id").select("event_id", "user_id", "used")


@query(
    "weekly_close",
    f"""WITH {BARS}, w AS (SELECT symbol, date_trunc('week', date)::DATE AS week, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
s AS (SELECT symbol, unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL '7 days'))::DATE AS week FROM w GROUP BY symbol) SELECT symbol, week, close FROM s LEFT JOIN w USING (symbol, week)""",
    ("close",),
)
def weekly_close(spark, sf_dir):
    return W.weekly_close(daily_bars(spark, sf_dir))


@query(
    "swing_pivots",
    f"""WITH {BARS}, p AS (SELECT symbol, date, CASE WHEN high > lag(high) OVER w AND high > lead(high) OVER w THEN high END AS ph, CASE WHEN low < lag(low) OVER w AND low < lead(low) OVER w THEN low END AS pl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
q AS (SELECT *, last_value(ph IGNORE NULLS) OVER b AS lh, last_value(pl IGNORE NULLS) OVER b AS ll FROM p WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN ph > lh THEN 'HH' WHEN ph <= lh THEN 'LH' WHEN pl > ll THEN 'HL' WHEN pl <= ll THEN 'LL' END AS mark FROM q)
SELECT symbol, date, mark, last_value(mark IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS state FROM m""",
)
def swing_pivots(spark, sf_dir):
    return W.pivots(daily_bars(spark, sf_dir)).select("symbol", "date", "mark", "state")


@query(
    "trailing_slope",
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date)::DOUBLE AS n FROM bars)
SELECT symbol, date, CASE WHEN count(close) OVER f >= 20 THEN (sum(n * close) OVER f - (n - 9.5::DOUBLE) * sum(close) OVER f) / 665.0::DOUBLE * 19 / 2 END AS slope FROM n WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""",
    ("slope",),
)
def trailing_slope(spark, sf_dir):
    return W.trailing_slope(daily_bars(spark, sf_dir)).select("symbol", "date", "slope")


@query(
    "cusum_by_pattern",
    f"""WITH {TRADES}, l AS (SELECT pattern, list({{'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'i': 0::BIGINT, 'hit': 0::BIGINT, 'x': ret::DOUBLE}} ORDER BY entry_date, trade_id) AS xs FROM trades GROUP BY pattern),
f AS (SELECT pattern, len(xs) AS n, list_reduce(xs, lambda a, e: {{'up': greatest(0.0::DOUBLE, a.up + (e.x - 0.01::DOUBLE - 0.005::DOUBLE)), 'down': greatest(0.0::DOUBLE, a.down - (e.x - 0.01::DOUBLE) - 0.005::DOUBLE), 'i': a.i + 1,
  'hit': CASE WHEN a.hit = 0 AND (greatest(0.0::DOUBLE, a.up + (e.x - 0.01::DOUBLE - 0.005::DOUBLE)) > 0.5 OR greatest(0.0::DOUBLE, a.down - (e.x - 0.01::DOUBLE) - 0.005::DOUBLE) > 0.5) THEN a.i + 1 ELSE a.hit END, 'x': e.x}},
  {{'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'i': 0::BIGINT, 'hit': 0::BIGINT, 'x': 0.0::DOUBLE}}) AS r FROM l)
SELECT pattern, n::BIGINT AS n, r.hit AS first_trigger FROM f""",
)
def cusum_by_pattern(spark, sf_dir):
    return W.cusum(trades(spark, sf_dir), "pattern", ["entry_date", "trade_id"], "ret", 0.01, 0.005, 0.5)


@query(
    "longest_constant_run",
    "WITH a AS (SELECT o_custkey % 50 AS grp, o_orderkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_custkey % 50, o_orderstatus ORDER BY o_orderkey) AS island FROM orders), r AS (SELECT grp, s, island, count(*) AS n FROM a GROUP BY ALL) SELECT grp, max(n) AS longest_run FROM r GROUP BY grp",
)
def longest_constant_run(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("grp", F.col("o_custkey") % 50)
    return W.longest_run(orders, "o_orderstatus", "grp", "o_orderkey")
