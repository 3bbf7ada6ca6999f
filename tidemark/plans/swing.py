"""Queries of swing signals by variant, and of the validation summary of patterns."""

from __future__ import annotations

from math import e

from pyspark.sql import functions as F

from ..functions.scalars import quantile_sql
from ..operators import portfolio as B
from ..operators import selection as L
from ..operators import summary as M
from ..operators import swing as G
from ..registry import SQL, query
from .inputs import BARS, TRADES, daily_bars, table, trades
from .research import _ORDER, cdf_sql
from .windows import _TR

_SIGNALS = f"""{BARS}, {_TR},
i AS (SELECT *, atr / close AS atr_pct, CASE WHEN count(close) OVER f50 >= 50 THEN avg(close) OVER f50 END AS sma50, CASE WHEN count(close) OVER f200 >= 200 THEN avg(close) OVER f200 END AS sma200, row_number() OVER w - 1 AS idx, lead(date) OVER w AS next
  FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY date), f50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), f200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING)),
q AS (SELECT *, lag(atr_pct) OVER (PARTITION BY symbol ORDER BY date) AS atr_before, CASE WHEN count(atr_pct) OVER g >= 120 THEN quantile_cont(atr_pct, 0.4) OVER g END AS p40, CASE WHEN count(atr_pct) OVER g >= 120 THEN quantile_cont(atr_pct, 0.6) OVER g END AS p60
  FROM i WINDOW g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
t AS (SELECT q.* FROM q JOIN ({SQL['regime_flag']}) r ON r.date = q.date AND r.regime_ok WHERE next IS NOT NULL AND close > sma50 AND (close > sma200 OR sma50 > sma200))"""


def _signals(spark, sf_dir, variant):
    bars = daily_bars(spark, sf_dir)
    return bars, G.signals(bars, B.regime_flag(bars, "S0", "S1"), variant)


@query(
    "swing_signals_by_variant",
    f"WITH {_SIGNALS} SELECT 'CONTRACTION_ONLY' AS variant, symbol, idx, date, atr_before FROM t WHERE atr_before <= p40 UNION ALL SELECT 'TREND_ONLY', symbol, idx, date, atr_before FROM t UNION ALL SELECT 'VOL_HIGH_ONLY', symbol, idx, date, atr_before FROM t WHERE atr_before >= p60",
    ("atr_before",),
)
def swing_signals_by_variant(spark, sf_dir):
    out = None
    for variant in ("CONTRACTION_ONLY", "TREND_ONLY", "VOL_HIGH_ONLY"):
        part = _signals(spark, sf_dir, variant)[1].select(F.lit(variant).alias("variant"), "symbol", "idx", "date", "atr_before")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "swing_trades",
    f"""WITH {_SIGNALS}, m AS (SELECT symbol, row_number() OVER w - 1 AS idx, date, lead(date) OVER w AS entry_date, lead(open) OVER w AS entry_price, last_value(date) OVER a AS exit_date, last_value(close) OVER a AS exit_price, count(*) OVER a - 1 AS days
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 11 FOLLOWING))
SELECT symbol, m.date AS signal_date, entry_date, exit_date, days, days < 10 AS truncated, exit_price / entry_price - 1 AS gross, exit_price / entry_price - 1 - 0.002 AS net_20bps FROM t JOIN m USING (symbol, idx) WHERE atr_before <= p40 AND days > 0""",
    ("gross", "net_20bps"),
)
def swing_trades(spark, sf_dir):
    bars, found = _signals(spark, sf_dir, "CONTRACTION_ONLY")
    return G.trades(found, bars, 10, (20.0,))


@query(
    "episode_candidates",
    f"""WITH {_SIGNALS}, g AS (SELECT symbol, idx, atr_before, coalesce(idx - lag(idx) OVER (PARTITION BY symbol ORDER BY idx), 999999) AS gap FROM t WHERE atr_before <= p40),
e AS (SELECT *, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY idx) AS episode FROM g), x AS (SELECT symbol, episode, min(idx) AS first, max(idx) AS last, count(*) AS signals, min(atr_before) AS least_atr FROM e GROUP BY ALL),
d AS (SELECT *, unnest(generate_series(first, least(first + 5, last))) AS idx FROM x) SELECT symbol, episode::BIGINT AS episode, date AS decision_date, (idx - first)::INTEGER AS "offset", signals, least_atr FROM d JOIN i USING (symbol, idx) WHERE next IS NOT NULL""",
    ("least_atr",),
)
def episode_candidates(spark, sf_dir):
    bars, found = _signals(spark, sf_dir, "CONTRACTION_ONLY")
    return G.episode_candidates(found, bars)


_NW = SQL["newey_west"]


@query(
    "pattern_validation",
    f"""WITH {TRADES}, d AS (SELECT pattern, day, sum(n) AS n FROM (SELECT pattern, entry_date AS day, 1 AS n FROM trades UNION ALL SELECT pattern, exit_date + 1, -1 FROM trades) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS c, lead(day) OVER w - day AS days FROM d WINDOW w AS (PARTITION BY pattern ORDER BY day)), u AS (SELECT pattern, day, coalesce(sum(CASE WHEN c > 0 THEN days::DOUBLE / c ELSE 0 END) OVER (PARTITION BY pattern ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c),
w AS (SELECT t.pattern, ret AS x, (b.s - a.s) / (exit_date + 1 - entry_date) AS w FROM trades t JOIN u a ON a.pattern = t.pattern AND a.day = entry_date JOIN u b ON b.pattern = t.pattern AND b.day = exit_date + 1),
m AS (SELECT pattern, avg(x) AS mu FROM w GROUP BY 1), g AS (SELECT pattern, count(*) AS n, sum(w) AS n_eff, sum(w * x) / sum(w) AS expectancy, sum(w * x * x) AS xx, sum(w * x) FILTER (WHERE x > 0) / -sum(w * x) FILTER (WHERE x < 0) AS profit_factor,
  avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5) AS skew, avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) AS kurt FROM w JOIN m USING (pattern) GROUP BY pattern),
r AS (SELECT *, expectancy / sqrt(xx / n_eff - expectancy * expectancy) AS sr, (5 + n % 40)::BIGINT AS trials, CASE WHEN pattern <> 'AF' THEN 0.01::DOUBLE END AS sr_std FROM g), k AS (SELECT *, 1 - 1 / trials::DOUBLE AS p1, 1 - 1 / (trials::DOUBLE * {e!r}) AS p2, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS width FROM r),
y AS (SELECT *, CASE WHEN sr_std > 0 THEN sr_std * ((1 - {L.EULER!r}::DOUBLE) * ({quantile_sql('p1')}) + {L.EULER!r}::DOUBLE * ({quantile_sql('p2')})) ELSE 0 END AS sr_star FROM k),
z AS (SELECT *, sr * sqrt(n_eff - 1) / sqrt(width) AS z0, (sr - sr_star) * sqrt(n_eff - 1) / sqrt(width) AS z1 FROM y),
o AS (SELECT pattern, l_suppkey % 50 AS f, avg(l_discount - l_tax) AS null_mean FROM (SELECT *, l_returnflag || l_linestatus AS pattern FROM lineitem) GROUP BY ALL), h AS (SELECT pattern, (count(*) FILTER (WHERE null_mean >= expectancy) + 1) / (count(*) + 1) AS p_perm FROM o JOIN g USING (pattern) GROUP BY pattern)
SELECT pattern, z.n, n_eff, expectancy, profit_factor, sr, skew, kurt, v.t, trials, sr_star, {cdf_sql('z0')} AS psr, CASE WHEN sr_std > 0 THEN {cdf_sql('z1')} END AS dsr, p_perm, n_eff >= 60 AS n_eff_ok, coalesce(sr_std > 0 AND {cdf_sql('z1')} >= 0.95, false) AS dsr_ok FROM z JOIN h USING (pattern) JOIN ({_NW}) v USING (pattern)""",
    ("n_eff", "expectancy", "profit_factor", "sr", "skew", "kurt", "t", "sr_star", "psr", "dsr", "p_perm"),
)
def pattern_validation(spark, sf_dir):
    t = trades(spark, sf_dir)
    family = t.groupBy("pattern").agg(F.count("*").alias("n")).select("pattern", (F.col("n") % 40 + 5).alias("trials"), F.when(F.col("pattern") != "AF", 0.01).alias("sr_std"))
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("pattern"), (F.col("l_suppkey") % 50).alias("f"), (F.col("l_discount") - F.col("l_tax")).alias("r"))
    nulls = li.groupBy("pattern", "f").agg(F.avg("r").alias("null_mean")).drop("f")
    out = M.summarize(t, "pattern", _ORDER, "entry_date", "exit_date", "ret", 3, family, nulls, draws=100)
    return out.select("pattern", "n", "n_eff", "expectancy", "profit_factor", "sr", "skew", "kurt", "t", "trials", "sr_star", "psr", "dsr", "p_perm", "n_eff_ok", "dsr_ok")
