"""Request planning: what a plan's requests may be sent under several rolling budgets at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import in_order


@dataclass(frozen=True)
class Budget:
    """At most `capacity` requests in `seconds`, of which `reserved` are not for intraday ones; counted among requests alike in `alike`."""

    seconds: int
    capacity: int
    reserved: int = 0
    alike: tuple[str, ...] = ()

    def __post_init__(self):
        if self.seconds <= 0 or self.capacity <= 0 or not 0 <= self.reserved < self.capacity:
            raise ValueError("a budget needs positive seconds and capacity, and fewer reserved than its capacity")


#: The total of ten minutes, the same request within fifteen seconds, the same contract within two.
DEFAULT = (Budget(2, 5, alike=("symbol",)), Budget(15, 1, alike=("symbol", "timeframe", "role")), Budget(600, 60, 10))
FIELDS = ("symbol", "timeframe", "role")


class Rolling:
    """Admitted requests of one key, as far back as the longest budget reaches: what any budget can still count."""

    def __init__(self, budgets: tuple[Budget, ...]):
        self.budgets = sorted(budgets, key=lambda b: b.seconds)
        self.longest = self.budgets[-1].seconds
        self.admitted: deque[tuple[float, tuple, bool]] = deque()

    def _counted(self, now: float, b: Budget, fields: tuple, intraday: bool | None) -> list[float]:
        places = [FIELDS.index(f) for f in b.alike]
        return [t for t, f, i in self.admitted if t > now - b.seconds and all(f[p] == fields[p] for p in places) and (intraday is None or i == intraday)]

    def ask(self, now: float, fields: tuple, intraday: bool, fresh: bool) -> tuple[str, float | None, int]:
        """(reason, when a slot is free if denied, what is left of the tightest budget)."""
        while self.admitted and self.admitted[0][0] <= now - self.longest:
            self.admitted.popleft()
        reason, free = ("cache_fresh", None) if fresh else ("allowed", None)
        for b in self.budgets if not fresh else ():
            used, own = self._counted(now, b, fields, None), self._counted(now, b, fields, True)
            if intraday and b.reserved and len(own) >= b.capacity - b.reserved:
                reason, free = "daily_budget_reserved", min(own) + b.seconds
                break
            if len(used) >= b.capacity:
                reason, free = "pacing_exhausted", min(used) + b.seconds
                break
        if reason == "allowed":
            self.admitted.append((now, fields, intraday))
        left = []
        for b in self.budgets:
            rest = b.capacity - len(self._counted(now, b, fields, None))
            left.append(min(rest, b.capacity - b.reserved - len(self._counted(now, b, fields, True))) if intraday else rest)
        return reason, free, max(0, min(left))


def plan_requests(requests: DataFrame, keys: list[str], budgets: tuple[Budget, ...] = DEFAULT, refresh_seconds: int = 0) -> DataFrame:
    """Per request: request_id, at, reason (allowed, cache_fresh, daily_budget_reserved, pacing_exhausted, duplicate), next_at, left.

    requests: keys (whose budgets are their own, such as account and type), request_id, at, symbol, timeframe, role, scope,
    priority, portfolio_open, last_updated_at. Requests of one key and time are a plan: of those alike in symbol, timeframe and role
    (whatever their case) the first counts, the others are duplicates; the first is by open positions, then priority, then the
    oldest data (none at all first), then id, and so is the order in which budgets are asked. Data younger than refresh_seconds need
    no request. Denied requests use no budget. Null text is empty, a null scope intraday, a null priority 0; rows without a time are left out.

    A plan's outcome depends on all before it, so each key is a fold over its requests in order, streamed: a task holds a batch and
    the admitted requests that a budget can still count, at most the capacity of a budget for all.
    """
    if not any(not b.alike for b in budgets):
        raise ValueError("one budget must count all of a key's requests: it bounds the state")
    c = F.col
    clean = lambda x: F.lower(F.trim(F.coalesce(c(x), F.lit(""))))
    seconds = lambda x: F.unix_micros(c(x).cast("timestamp")) / 1e6
    known = requests.filter(c("at").isNotNull()).select(
        *keys, "request_id", "at", seconds("at").alias("_now"), *[clean(x).alias(f"_{x}") for x in FIELDS], (F.coalesce(c("scope"), F.lit("intraday")) == "intraday").alias("_intraday"),
        (-F.coalesce(c("portfolio_open"), F.lit(False)).cast("int")).alias("_shut"), (-F.coalesce(c("priority"), F.lit(0))).alias("_low"), F.coalesce(seconds("last_updated_at"), F.lit(0.0)).alias("_last"), c("last_updated_at").isNotNull().alias("_cached"),
    )
    order = ["_shut", "_low", "_last", "request_id"]
    first = F.row_number().over(Window.partitionBy(*keys, "at", *[f"_{x}" for x in FIELDS]).orderBy(*order)) == 1
    known = known.withColumn("_fresh", c("_cached") & (c("_now") - c("_last") < refresh_seconds)).withColumn("_first", first)
    kinds = dict(known.dtypes)
    view = [*keys, "request_id", "at", "_now", *[f"_{x}" for x in FIELDS], "_intraday", "_fresh", "_first"]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, current = None, None
        for b in batches:
            reasons, free, left = [], [], []
            for *key, _, _, now, symbol, timeframe, role, intraday, fresh, first in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if rolling is None or key != current:
                    rolling, current = Rolling(budgets), key
                r, f, rest = rolling.ask(now, (symbol, timeframe, role), intraday, fresh) if first else ("duplicate", None, None)
                reasons.append(r)
                free.append(f)
                left.append(rest)
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 2], pa.array(reasons, pa.string()), pa.array(free, pa.float64()), pa.array(left, pa.int32())], [*keys, "request_id", "at", "reason", "_next", "left"])

    ordered = in_order(known, keys, ["at", *order]).select(*view)
    out = ordered.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in [*keys, "request_id", "at"]), "reason string, _next double, left int"]))
    return out.withColumn("next_at", F.timestamp_micros(F.round(c("_next") * 1e6).cast("long"))).drop("_next")
