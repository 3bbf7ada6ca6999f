"""Paper observations against a plain loop over each trade's bars."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators.observations import close_observations

START = datetime(2024, 1, 1)
TRADE = "trade_id int, symbol string, side string, entry double, stop double, target double, qty double, opened_at timestamp"


def plain(trade, bars, hold):
    _, symbol, side, entry, stop, target, qty, opened = trade
    sign = -1 if (side or "").strip().lower() == "short" else 1
    risk = sign * (entry - stop)
    after = [b for b in bars if b[0] == symbol and b[1] > opened][:hold]
    best = worst = 0.0
    if risk <= 0 or sign * (target - entry) <= 0:
        return ("pending", None, None, None, None, None, None, None, None)
    for i, (_, at, o, h, lo, c) in enumerate(after, 1):
        best, worst = max(best, sign * (h - entry) / risk, sign * (lo - entry) / risk), min(worst, sign * (h - entry) / risk, sign * (lo - entry) / risk)
        low, high = (lo, h) if sign > 0 else (h, lo)
        out = ("stop_gap", o) if sign * (o - stop) <= 0 else ("target_gap", target) if sign * (o - target) >= 0 else ("stop_hit", stop) if sign * (low - stop) <= 0 else ("target_hit", target) if sign * (high - target) >= 0 else ("time_stop", c) if i == hold else None
        if out:
            return ("closed", *out, at, i, sign * (out[1] - entry) / risk, best, worst, sign * (out[1] - entry) * qty)
    return ("pending", None, None, None, None, None, None, None, None)


@pytest.mark.parametrize("hold", [1, 4, 9])
def test_close_observations(spark, hold):
    rng = random.Random(11)
    bars, price = [], {"A": 100.0, "B": 50.0}
    for i in range(40):
        for s in price:
            o = price[s] * (1 + rng.gauss(0, 0.03))
            c = o * (1 + rng.gauss(0, 0.03))
            bars.append((s, START + timedelta(hours=i), o, max(o, c) * 1.01, min(o, c) * 0.99, c))
            price[s] = c
    trades = []
    for i in range(250):
        s = rng.choice(["A", "B", "C"])
        near = rng.choice([b[5] for b in bars if b[0] == s] or [10.0])
        sign = rng.choice([1, -1])
        trades.append((i, s, rng.choice([" SHORT ", "short"]) if sign < 0 else rng.choice(["long", None, ""]), near, near * (1 - sign * rng.choice([0.03, 0.1, 0.0, -0.02])), near * (1 + sign * rng.choice([0.04, 0.15, -0.01])), 3.0, START + timedelta(hours=rng.uniform(-2, 41))))
    b = spark.createDataFrame(bars, "symbol string, ts timestamp, open double, high double, low double, close double")
    got = {r.trade_id: tuple(r)[1:] for r in close_observations(spark.createDataFrame(trades, TRADE), b, hold, "ts").collect()}
    assert len(got) == len(trades)
    kinds = set()
    for t in trades:
        want = plain(t, bars, hold)
        kinds.add(want[1])
        assert got[t[0]] == tuple(pytest.approx(x) if isinstance(x, float) else x for x in want), (t, want)
    assert kinds >= {None, "stop_gap", "stop_hit", "time_stop"}
