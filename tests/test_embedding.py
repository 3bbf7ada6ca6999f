"""Window vectors against a plain version, one window and one number at a time."""

from __future__ import annotations

import datetime
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import embedding as E


def resampled(xs, points):
    return list(np.interp(np.linspace(0, 1, points), np.linspace(0, 1, len(xs)), xs))


def slope(xs):
    return float(np.polyfit(np.linspace(-1, 1, len(xs)), xs, 1)[0])


def corr(a, b):
    return 0.0 if np.std(a) == 0 or np.std(b) == 0 else float(np.corrcoef(a, b)[0, 1])


def standard(xs):
    return list((np.array(xs) - np.mean(xs)) / np.std(xs)) if np.std(xs) > 0 else [0.0] * len(xs)


def bench(values):
    known = [v for v in values if v is not None]
    ret = known[-1] / max(known[0], 1e-9) - 1 if len(known) >= 2 else 0.0
    breadth = ((known[-1] >= statistics.fmean(known[-20:])) + (known[-1] >= known[0])) / 2 if len(known) >= 5 else None
    return ret, breadth


def plain(rows):
    """rows: (date, open, high, low, close, volume, four benchmark closes) of one window."""
    day, o, h, lo, c, v, *benches = (list(x) for x in zip(*rows, strict=True))
    n = len(c)
    lg = [math.log(max(x, 1e-9)) for x in c]
    r = np.array([0.0] + [lg[i] - lg[i - 1] for i in range(1, n)])
    r = list(np.clip(r, np.quantile(r, 0.01), np.quantile(r, 0.99)))
    price = [x / c[0] - 1 for x in c]
    rel = [min(max(x / max(statistics.median(v), 1.0), 0), 5) / 5 for x in v]
    rng = [min(max((a - b) / max(x, 1e-9), 0), 0.35) / 0.35 for a, b, x in zip(h, lo, c, strict=True)]
    vol = np.array([0.0 if i == 0 else statistics.stdev(r[max(0, i - 4) : i + 1]) for i in range(n)])
    vol = np.clip(vol, 0, np.percentile(vol, 95) + 1e-9)
    vol = vol / vol.max() if vol.max() > 0 else vol
    down = [c[i] / max(c[: i + 1]) - 1 for i in range(n)]
    up = [c[i] / min(c[: i + 1]) - 1 for i in range(n)]
    tr = [h[0] - lo[0]] + [max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(1, n)]
    atr = pd.Series(tr).rolling(14).mean().bfill().tolist() if n >= 15 else [0.0] * n
    atr_pct = atr[-1] / c[-1] if n >= 15 else 0.0
    usual = statistics.median(a / x for a, x in list(zip(atr, c, strict=True))[-50:])
    look = min(20, max(2, n - 1))
    top, bottom, before = max(h[-look - 1 : -1]), min(lo[-look - 1 : -1]), c[-2]
    m20, m50 = statistics.fmean(c[-20:]), statistics.fmean(c[-50:])
    gap = o[-1] / before - 1
    weeks: dict[int, float] = {}
    for d, x in zip(day, c, strict=True):
        weeks[(d.toordinal() - 1) // 7] = x
    span = max(weeks) - min(weeks) + 1
    series = [weeks.get(k) for k in range(min(weeks), max(weeks) + 1)]
    local = c[-1] / c[0] - 1
    weekly_return = series[-1] / series[0] - 1 if span >= 2 else local
    weekly_trend = slope([x / series[0] - 1 for x in series]) if span >= 2 and None not in series else 0.0
    (r1, b1), (r2, b2), (r3, _), (r4, _) = map(bench, benches)
    lead = r1 if r1 != 0 else r2
    some = [x for x in (r1, r2) if x != 0]
    market = statistics.fmean(some) if some else 0.0
    breadths = [b for b in (b1, b2) if b is not None]
    breadth = statistics.fmean(breadths) if breadths else 0.5
    count, state, lasts = {"hh": 0, "hl": 0, "lh": 0, "ll": 0}, [0.0] * n, {"h": None, "l": None}
    for i in range(1, n - 1):
        for kind, x, pivot in (("h", h, h[i] >= h[i - 1] and h[i] >= h[i + 1]), ("l", lo, lo[i] <= lo[i - 1] and lo[i] <= lo[i + 1])):
            if pivot:
                if lasts[kind] is not None:
                    higher = x[i] > lasts[kind]
                    count[("h" if higher else "l") + kind] += 1
                    state[i] += 1 if higher else -1
                lasts[kind] = x[i]
    for i in range(1, n):
        state[i] = state[i] or state[i - 1]
    state = [min(max(x, -1), 1) for x in state]
    total = max(1, sum(count.values()))
    a, b = (n + 2) // 3, (2 * n + 2) // 3
    thirds = [statistics.fmean(rel[s]) for s in (slice(0, a), slice(a, b), slice(b, n))]
    p16, v16, x16 = standard(resampled(price, 16)), standard(resampled(rel, 16)), np.linspace(-1, 1, 16)
    flag = [*np.linspace(0, 1, 6), *np.linspace(0.65, 0.45, 5), *np.linspace(0.45, 1.15, 5)]
    long = 1.0 if c[-1] >= top * 0.995 else 0.78 if lo[-1] <= top and c[-1] > top * 0.99 and c[-1] > o[-1] else 0.58 if c[-1] > before and c[-1] > m20 else 0.0
    short = 1.0 if c[-1] <= bottom * 1.005 else 0.78 if h[-1] >= bottom and c[-1] < bottom * 1.01 and c[-1] < o[-1] else 0.58 if c[-1] < before and c[-1] < m20 else 0.0
    held_up = gap > 0.005 and lo[-1] <= top and c[-1] > max(o[-1], top * 0.995) and c[-1] > o[-1] and c[-1] >= lo[-1] + (h[-1] - lo[-1]) * 0.65
    held_down = gap < -0.005 and h[-1] >= bottom and c[-1] < min(o[-1], bottom * 1.005) and c[-1] < o[-1] and c[-1] <= lo[-1] + (h[-1] - lo[-1]) * 0.35
    width = [max(x - y, 1e-9) for x, y in zip(h, lo, strict=True)]
    channels = [
        price, r, rel, rng, [min(max((x - y) / w, 0), 1) for x, y, w in zip(c, lo, width, strict=True)], [min(abs(x - y) / w, 1) for x, y, w in zip(c, o, width, strict=True)], list(vol), down, up,
    ]
    more = [[0.0] + [rng[i] - rng[i - 1] for i in range(1, n)], [(x > 0) * y - (x < 0) * y for x, y in zip(r, rel, strict=True)], state]
    scalars = [
        local, slope(price), np.std([min(x, 0) for x in r]), np.std([max(x, 0) for x in r]), -min(down), max(up), c[-1] / c[n * 3 // 4] - 1, slope(rel), atr_pct,
        1.0 if c[-1] >= m20 >= m50 else -1.0 if c[-1] <= m20 <= m50 else 0.0, min(atr_pct / usual if usual > 0 else 1.0, 5.0), gap, c[-1] / top - 1, bottom / c[-1] - 1,
        min(1.0, math.log1p(statistics.fmean(x * y for x, y in list(zip(c, v, strict=True))[-look:])) / math.log1p(5e7)), (c[-1] - m20) / max(atr[-1], c[-1] * 0.01), long, short,
        weekly_return, weekly_trend, local - r1, local - r2, 1.0 if local == 0 or lead == 0 or (local > 0) == (lead > 0) else -1.0,
    ]
    more_scalars = [
        *(x * 5 for x in thirds), thirds[2] - thirds[0], statistics.fmean(rng[b:]) - statistics.fmean(rng[:a]), max(0, corr(p16, -abs(x16))), max(0, corr(p16, abs(x16))), max(0, corr(p16, flag)),
        corr([0.0] + [p16[i] - p16[i - 1] for i in range(1, 16)], v16), *(count[k] / total for k in ("hh", "hl", "lh", "ll")), (count["hh"] + count["hl"] - count["lh"] - count["ll"]) / total, held_up * 1.0, held_down * 1.0,
        market, breadth, r3 if r3 != 0 else market, r4 if r4 != 0 else (r3 if r3 != 0 else market), local - r3 if r3 != 0 else 0.0, local - r4 if r4 != 0 else 0.0, min(max(market * 10 + (breadth - 0.5) * 1.5, -1), 1),
    ]
    return [x for ch in channels for x in resampled(ch, 24)] + scalars + [x for ch in more for x in resampled(ch, 24)] + more_scalars


@pytest.fixture(scope="module")
def series():
    rng = random.Random(8)
    out = {}
    for symbol, n in (("A", 130), ("B", 61), ("C", 9), ("FLAT", 40)):
        rows, close, day = [], 100.0, datetime.date(2024, 1, 1)
        for i in range(n):
            day += datetime.timedelta(days=1 if rng.random() < 0.9 else rng.choice((3, 9)))
            open_ = close * (1 + rng.gauss(0, 0.012))
            close = 100.0 if symbol == "FLAT" else open_ * (1 + rng.gauss(0, 0.02))
            high, low = max(open_, close) * (1 + abs(rng.gauss(0, 0.01))), min(open_, close) * (1 - abs(rng.gauss(0, 0.01)))
            known = [None if i < 12 and symbol == "A" else 50 + 10 * math.sin(i / 9 + k) for k in range(3)] + [None]
            rows.append((day, open_, high, low, close, float(rng.randrange(1000, 90_000)), *known))
        out[symbol] = rows
    return out


def test_layout():
    assert len(E.LAYOUT) == 334 and len(set(E.LAYOUT)) == 334 and E.slot("cumulative_return") == 216


def test_vectors_equal_the_plain_version(spark, series):
    rows = [(s, *r) for s, rs in series.items() for r in rs]
    schema = "symbol string, date date, open double, high double, low double, close double, volume double, " + ", ".join(f"{b} double" for b in E.BENCHMARKS)
    bars = spark.createDataFrame(rows, schema).union(spark.createDataFrame([("A", datetime.date(2023, 1, 1), None, 1.0, 1.0, 1.0, 1.0, None, None, None, None), (None, datetime.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, None, None, None, None)], schema))
    sizes = [5, 14, 24, 60]
    # Small chunks: most windows reach into the chunk before.
    found = {(r.symbol, r.date, r.size): r.vector for r in E.embed_windows(bars, sizes, chunk=64, part=7).collect()}
    assert len(found) == sum(max(0, len(rs) - n + 1) for rs in series.values() for n in sizes)
    for (symbol, date, size), vector in found.items():
        at = [r[0] for r in series[symbol]].index(date)
        want = plain(series[symbol][at - size + 1 : at + 1])
        wrong = [(E.LAYOUT[i], x, y) for i, (x, y) in enumerate(zip(vector, want, strict=True)) if not math.isclose(x, np.float32(y), rel_tol=1e-4, abs_tol=2e-6)]
        assert not wrong, (symbol, date, size, wrong[:5])


def test_no_task_holds_a_series(spark, series):
    rows = [("A", *r) for r in series["A"]]
    schema = "symbol string, date date, open double, high double, low double, close double, volume double, " + ", ".join(f"{b} double" for b in E.BENCHMARKS)
    out = E.embed_windows(spark.createDataFrame(rows, schema), [10], chunk=32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan.split("FlatMapGroupsInArrow", 1)[1][:120]
    with pytest.raises(ValueError, match="sizes"):
        E.embed_windows(spark.createDataFrame(rows, schema), [4])
    assert E.embed_windows(spark.createDataFrame(rows, schema).filter(F.lit(False)), [10]).count() == 0
