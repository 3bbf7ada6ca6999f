"""The validation summary of patterns: weighted expectancy, its uncertainty, and what many trials leave of it."""

from __future__ import annotations

from math import e

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, normal_quantile
from . import inference as I
from .joins import uniqueness
from .selection import EULER


def summarize(events: DataFrame, pattern: str, order: list[str], start: str, end: str, value: str, horizon: int, trials: DataFrame | None = None, nulls: DataFrame | None = None, draws: int = 500, least_eff: float = 60.0, least_dsr: float = 0.95, seed: int = 0) -> DataFrame:
    """Per pattern, of its events (already without overlaps within a symbol, net of costs):

    n, n_eff (the sum of their uniqueness over the days of start to end, whatever the symbol), expectancy, profit_factor and sr, all
    weighted by uniqueness, skew and kurt, t (Newey-West over `horizon` lags), low and high (stationary bootstrap of the mean, blocks of
    `horizon`), psr, sr_star and dsr, p_perm and the gates n_eff_ok, low_ok, dsr_ok and passed.

    trials: (pattern, trials, sr_std) of its family; with more than one trial and a known spread dsr is deflated, with more than one and
    none it is null, else it is the psr. nulls: (pattern, null_mean) of matched portfolios, held against the weighted expectancy.
    Profit factors without losses are infinite, and null without gains too. Events without a pattern, a day or a value are left out.
    """
    known = events.dropna(subset=[pattern, start, end, value, order[0]])
    weighted = uniqueness(known.select(*dict.fromkeys([pattern, start, end, value])), [pattern], start, end, "_w")
    w, x = F.col("_w"), F.col(value).cast("double")
    gain, loss = F.sum(F.when(x > 0, w * x)), -F.sum(F.when(x < 0, w * x))
    s = weighted.groupBy(pattern).agg(
        F.count("*").alias("n"), F.sum(w).alias("n_eff"), (F.sum(w * x) / F.sum(w)).alias("expectancy"), F.sum(w * x * x).alias("_xx"), F.coalesce(gain, F.lit(0.0)).alias("_gain"), F.coalesce(loss, F.lit(0.0)).alias("_loss"),
        F.skewness(x).alias("_skew"), (F.kurtosis(x) + 3).alias("_kurt"),
    )
    variance = F.col("_xx") / F.col("n_eff") - F.col("expectancy") * F.col("expectancy")
    enough = (F.col("n") >= 3) & F.col("_skew").isNotNull() & ~F.isnan("_skew")
    s = s.withColumns({
        "profit_factor": F.when(F.col("_loss") > 0, F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0))).when(F.col("_gain") > 0, float("inf")), "sr": F.when(variance > 1e-18, F.col("expectancy") / F.sqrt(variance)),
        "skew": F.when(enough, F.col("_skew")).otherwise(0.0), "kurt": F.when(enough, F.col("_kurt")).otherwise(3.0),
    })
    drift = I.newey_west(known, [pattern], order, value, horizon).select(pattern, F.when(F.col("n") >= 3, F.col("t")).alias("t"))
    bounds = I.stationary_bootstrap(known, [pattern], order, value, draws, float(horizon), seed).select(pattern, "low", "high")
    s = s.join(drift, pattern).join(bounds, pattern, "left")
    s = s.join(trials.select(pattern, "trials", "sr_std"), pattern, "left") if trials is not None else s.withColumns({"trials": F.lit(1), "sr_std": F.lit(None).cast("double")})
    s = s.withColumn("trials", F.coalesce("trials", F.lit(1))).withColumns({"_p1": 1 - 1 / F.col("trials").cast("double"), "_p2": 1 - 1 / (F.col("trials").cast("double") * e)})
    deflates = (F.col("trials") > 1) & F.coalesce(F.col("sr_std") > 0, F.lit(False))
    s = s.withColumn("sr_star", F.when(deflates, F.col("sr_std") * ((1 - EULER) * normal_quantile("_p1") + EULER * normal_quantile("_p2"))).otherwise(0.0))
    sr = F.col("sr")
    width = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    above = lambda star: F.when((F.col("n_eff") > 1) & (width > 0), normal_cdf((sr - star) * F.sqrt(F.col("n_eff") - 1) / F.sqrt(width)))
    s = s.withColumns({"psr": above(F.lit(0.0)), "dsr": F.when(deflates, above(F.col("sr_star"))).when(F.col("trials") <= 1, above(F.lit(0.0)))})
    if nulls is not None:
        held = nulls.filter(F.col("null_mean").isNotNull() & ~F.isnan("null_mean")).join(s.select(pattern, "expectancy"), pattern)
        s = s.join(held.groupBy(pattern).agg(((F.count_if(F.col("null_mean") >= F.col("expectancy")) + 1) / (F.count("*") + 1)).alias("p_perm")), pattern, "left")
    else:
        s = s.withColumn("p_perm", F.lit(None).cast("double"))
    s = s.withColumns({"n_eff_ok": F.col("n_eff") >= least_eff, "low_ok": F.coalesce(F.col("low") > 0, F.lit(False)), "dsr_ok": F.coalesce(F.col("dsr") >= least_dsr, F.lit(False))})
    names = ["n", "n_eff", "expectancy", "profit_factor", "sr", "skew", "kurt", "t", "low", "high", "psr", "trials", "sr_star", "dsr", "p_perm", "n_eff_ok", "low_ok", "dsr_ok"]
    return s.select(pattern, *names, (F.col("n_eff_ok") & F.col("low_ok") & F.col("dsr_ok")).alias("passed"))
