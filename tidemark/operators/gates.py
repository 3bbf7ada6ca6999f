"""Decision expressions: ordered first-match ladders and lists of reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(otherwise)
    for test, label in reversed(rules):
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """The distinct labels of all rules that hold, in order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in rules])))


#: Defaults of the promotion gate.
MINIMA = {"n": 100, "n_eff": 60, "symbols": 8, "profit_factor": 1.8, "expectancy": 0.25, "max_drawdown": 12.0}


def promotion_blockers(minima: dict = MINIMA) -> Column:
    c = F.col
    return reasons([
        (c("n") < minima["n"], "SAMPLE_TOO_SMALL"), (c("n_eff") < minima["n_eff"], "EFFECTIVE_SAMPLE_TOO_SMALL"), (c("symbols") < minima["symbols"], "TOO_FEW_SYMBOLS"),
        (F.coalesce(c("profit_factor"), F.lit(0.0)) < minima["profit_factor"], "PROFIT_FACTOR_LOW"), (c("expectancy") < minima["expectancy"], "EXPECTANCY_LOW"), (-c("drawdown") > minima["max_drawdown"], "DRAWDOWN_TOO_LARGE"),
    ])
