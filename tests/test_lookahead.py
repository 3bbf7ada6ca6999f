"""Classes of fields through plans, and request planning against a plain loop."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lookahead as K
from tidemark.streaming import requests as R


@pytest.fixture
def ledger(spark):
    df = spark.createDataFrame([("A", 1, 10.0, 11.0, 0.1), ("A", 2, 11.0, 10.0, -0.1)], "symbol string, day int, open double, close double, result double")
    return K.classify(df, {"open": ("symbol", "day", "open"), "close": ("close",), "outcome": ("result",)})


def test_alias_chain_is_followed(ledger):
    a = ledger.select("symbol", F.col("result").alias("x")).withColumnRenamed("x", "y").withColumn("z", F.col("y") * 2 + 1).select("symbol", "z")
    assert K.fields_read(a) == {"open": {"symbol"}, "outcome": {"result", "x", "y"}}
    with pytest.raises(K.LookaheadError, match="outcome"):
        K.known_by(a)
    assert K.known_by(a, "outcome") is a


def test_what_passes_by_is_not_read(ledger):
    b = ledger.withColumn("double", F.col("result") * 2).withColumn("gap", F.col("open") + F.col("day")).select("symbol", "gap")
    assert set(K.fields_read(b)) == {"open"} and K.known_by(b) is b


@pytest.mark.parametrize(
    "query",
    [
        lambda d: d.filter("result > 0").select("symbol"),
        lambda d: d.groupBy("symbol").agg(F.max("result").alias("m")),
        lambda d: d.groupBy("result").count().select("count"),
        lambda d: d.join(d.select(F.col("symbol").alias("s"), F.col("result").alias("r")), F.col("symbol") == F.col("s")).select("symbol", "r"),
        lambda d: d.join(d.select(F.col("result").alias("r")), F.col("open") == F.col("r")).select("symbol"),
        lambda d: d.select("symbol", F.lead("result").over(Window.partitionBy("symbol").orderBy("day")).alias("n")),
        lambda d: d.select("symbol", F.row_number().over(Window.partitionBy("symbol").orderBy("result")).alias("n")),
        lambda d: d.select(F.col("open").alias("v")).union(d.select("result")),
        lambda d: d.orderBy("result").limit(1).select("symbol"),
        lambda d: d.select(F.struct("open", "result").alias("s")).select("s.open"),
        lambda d: d.select("symbol", F.explode(F.array("result")).alias("e")),
    ],
)
def test_reading_an_outcome_is_refused(ledger, query):
    with pytest.raises(K.LookaheadError, match="outcome"):
        K.known_by(query(ledger))


def test_features_of_the_open_pass(ledger):
    w = Window.partitionBy("symbol").orderBy("day")
    later = ledger.select("symbol", F.col("day").alias("d"), "open")
    ok = ledger.withColumn("before", F.lag("open").over(w)).join(later.select(F.col("symbol").alias("s"), "d"), (F.col("symbol") == F.col("s")) & (F.col("day") == F.col("d"))).filter("open > 0").select("symbol", "before")
    assert K.known_by(ok).count() == 2
    with pytest.raises(K.LookaheadError, match="close: close"):
        K.known_by(ledger.select((F.col("close") / F.col("open")).alias("x")))
    with pytest.raises(ValueError, match="without a class"):
        K.classify(ledger, {"open": ("symbol",)})


REQUEST = "account int, request_id int, at timestamp, symbol string, timeframe string, role string, scope string, priority int, portfolio_open boolean, last_updated_at timestamp"


def plain_plan(rows, budgets, refresh):
    """request_id -> (reason, next, left), by lists of everything admitted so far."""
    out, admitted = {}, {}
    rank = lambda r: (not r[8], -(r[7] or 0), r[9].timestamp() if r[9] else 0.0, r[1])
    for r in sorted(rows, key=lambda r: (r[0], r[2], rank(r))):
        account, ident, at, *_ = r
        fields = tuple((x or "").strip().lower() for x in r[3:6])
        alike = [x for x in rows if x[0] == account and x[2] == at and tuple((y or "").strip().lower() for y in x[3:6]) == fields]
        if min(alike, key=rank)[1] != ident:
            out[ident] = ("duplicate", None, None)
            continue
        intraday, mine = (r[6] or "intraday") == "intraday", admitted.setdefault(account, [])
        count = lambda b, only: sorted(t for t, f, i in mine if t > at - timedelta(seconds=b.seconds) and (not only or i) and all(f[R.FIELDS.index(x)] == fields[R.FIELDS.index(x)] for x in b.alike))  # noqa: B023, E731
        reason, free = "allowed", None
        if r[9] and (at - r[9]).total_seconds() < refresh:
            reason = "cache_fresh"
        else:
            for b in sorted(budgets, key=lambda b: b.seconds):
                if intraday and b.reserved and len(count(b, True)) >= b.capacity - b.reserved:
                    reason, free = "daily_budget_reserved", count(b, True)[0] + timedelta(seconds=b.seconds)
                    break
                if len(count(b, False)) >= b.capacity:
                    reason, free = "pacing_exhausted", count(b, False)[0] + timedelta(seconds=b.seconds)
                    break
        if reason == "allowed":
            mine.append((at, fields, intraday))
        out[ident] = (reason, free, max(0, min(min(b.capacity - len(count(b, False)), b.capacity - b.reserved - len(count(b, True))) if intraday else b.capacity - len(count(b, False)) for b in budgets)))
    return out


def test_request_plans(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(700):
        at = start + timedelta(seconds=rng.randrange(0, 900) // 3 * 3)
        rows.append((rng.randrange(2), i, at, rng.choice(["spy", "SPY ", "qqq", None, "iwm"]), rng.choice(["1d", "5m"]), rng.choice(["", "a"]), rng.choice(["intraday", "intraday", "daily", None]), rng.choice([None, 0, 3]), rng.choice([True, False, None]), rng.choice([None, at - timedelta(seconds=rng.randrange(0, 400))])))
    budgets = (R.Budget(6, 4, alike=("symbol",)), R.Budget(20, 1, alike=("symbol", "timeframe", "role")), R.Budget(120, 25, 6))
    found = {r.request_id: (r.reason, r.next_at, r.left) for r in R.plan_requests(spark.createDataFrame(rows, REQUEST).repartition(5), ["account"], budgets, 60).collect()}
    want = plain_plan(rows, budgets, 60)
    assert found == want and {x[0] for x in want.values()} == {"allowed", "cache_fresh", "daily_budget_reserved", "pacing_exhausted", "duplicate"}
    with pytest.raises(ValueError, match="bounds the state"):
        R.plan_requests(spark.createDataFrame(rows, REQUEST), ["account"], budgets[:1])
    with pytest.raises(ValueError, match="reserved"):
        R.Budget(10, 5, 5)


def test_the_state_is_bounded():
    r = R.Rolling((R.Budget(100, 7), R.Budget(5, 2, alike=("symbol",))))
    for t in range(5000):
        r.ask(t / 10, (f"s{t % 50}", "", ""), True, False)
        assert len(r.admitted) <= 7
