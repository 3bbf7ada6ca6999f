"""The validation summary and swing trades against plain versions."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import summary as M
from tidemark.operators import swing as G

DAY = date(2024, 1, 1)


def test_summary_of_patterns(spark):
    rng = random.Random(5)
    rows = [(p, i, DAY + timedelta(s), DAY + timedelta(s + rng.randrange(0, 6)), rng.gauss(0.4 if p == "good" else 0.0, 1.0)) for p in ("good", "flat") for i in range(120) for s in [rng.randrange(0, 400)]]
    rows += [("wins", i, DAY + timedelta(i), DAY + timedelta(i), 1.0 + i) for i in range(3)] + [("one", 0, DAY, DAY, -1.0), ("one", 1, None, DAY, 5.0), ("one", 2, DAY, DAY, None)]
    df = spark.createDataFrame(rows, "pat string, i long, s date, e date, r double")
    trials = spark.createDataFrame([("good", 12, 0.05), ("flat", 3, None), ("wins", 1, 0.2)], "pat string, trials long, sr_std double")
    nulls = spark.createDataFrame([("good", x / 10) for x in range(-5, 6)] + [("good", float("nan")), ("flat", 9.0)], "pat string, null_mean double")
    found = {r.pat: r for r in M.summarize(df, "pat", ["s", "i"], "s", "e", "r", 4, trials, nulls, draws=60, least_eff=20.0).collect()}
    assert set(found) == {"good", "flat", "wins", "one"}
    for p, r in found.items():
        mine = sorted((x for x in rows if x[0] == p and x[2] and x[4] is not None), key=lambda x: (x[2], x[1]))
        opened = defaultdict(int)
        for _, _, s, e, _ in mine:
            for d in range((e - s).days + 1):
                opened[s + timedelta(d)] += 1
        w = np.array([np.mean([1 / opened[s + timedelta(d)] for d in range((e - s).days + 1)]) for _, _, s, e, _ in mine])
        x = np.array([m[4] for m in mine])
        mean = (w * x).sum() / w.sum()
        sd = math.sqrt((w * (x - mean) ** 2).sum() / w.sum())
        assert (r.n, r.n_eff, r.expectancy) == pytest.approx((len(x), w.sum(), mean))
        loss = -(w * x)[x < 0].sum()
        assert r.profit_factor == (pytest.approx((w * x)[x > 0].sum() / loss) if loss else math.inf)
        skew, kurt = 0.0, 3.0
        if len(x) >= 3:
            d = x - x.mean()
            skew, kurt = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2
            s0 = (d @ d) / len(d) + sum(2 * (1 - k / 5) * (d[k:] @ d[:-k]) / len(d) for k in range(1, 5) if k < len(d))
            assert r.t == (pytest.approx(x.mean() / math.sqrt(s0 / len(d))) if s0 > 0 else None)
        assert (r.skew, r.kurt) == pytest.approx((skew, kurt))
        if sd == 0:
            assert r.sr is None and r.psr is None and not r.passed
            continue
        sr = mean / sd
        n, spread = {"good": (12, 0.05), "flat": (3, None), "wins": (1, 0.2), "one": (1, None)}[p]
        star = spread * ((1 - 0.5772156649015329) * NormalDist().inv_cdf(1 - 1 / n) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (n * math.e))) if n > 1 and spread else 0.0
        psr = lambda b: NormalDist().cdf((sr - b) * math.sqrt(w.sum() - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))  # noqa: B023, E731
        assert (r.sr, r.psr, r.sr_star) == pytest.approx((sr, psr(0), star))
        assert r.dsr == (pytest.approx(psr(star)) if n <= 1 or spread else None)
        assert r.n_eff_ok == (w.sum() >= 20) and r.low_ok == (r.low > 0) and r.passed == (r.n_eff_ok and r.low_ok and r.dsr_ok)
    assert found["good"].passed and not found["flat"].passed
    assert found["good"].p_perm == pytest.approx((1 + sum(x / 10 >= found["good"].expectancy for x in range(-5, 6))) / 12) and found["flat"].p_perm == 1.0 and found["one"].p_perm is None


def test_swing_trades_one_active(spark):
    rng = random.Random(2)
    bars, found = [], []
    for s in ("A", "B"):
        for i in range(60):
            bars.append((s, DAY + timedelta(2 * i), rng.uniform(9, 11), 12.0, 8.0, rng.uniform(9, 11) if i != 30 else 0.0, 1.0))
            if rng.random() < 0.5 and i < 59:
                found.append((s, i, DAY + timedelta(2 * i), rng.random()))
    b = spark.createDataFrame(bars, "symbol string, date date, open double, high double, low double, close double, volume double")
    f = spark.createDataFrame(found, "symbol string, idx int, date date, atr_before double")
    for one in (False, True):
        got = sorted(tuple(r) for r in G.trades(f, b, 5, (10.0,), one_active=one).collect())
        want, last = [], {}
        for s, i, d, _ in sorted(found):
            x = [r for r in bars if r[0] == s]
            end = min(i + 6, 59)
            if end <= i + 1 or x[end][5] <= 0 or (one and i <= last.get(s, -1)):
                continue
            last[s] = end
            gross = x[end][5] / x[i + 1][2] - 1
            want.append((s, d, x[i + 1][1], x[end][1], end - i - 1, end < i + 6, pytest.approx(gross), pytest.approx(gross - 0.001)))
        assert got == want
    with pytest.raises(ValueError, match="variant"):
        G.signals(b, b.select("date", F.lit(True).alias("regime_ok")), "OTHER")


def test_episode_candidates(spark):
    bars = spark.createDataFrame([("A", DAY + timedelta(i), 1.0) for i in range(40)], "symbol string, date date, close double")
    found = spark.createDataFrame([("A", i, DAY + timedelta(i), float(i)) for i in (3, 4, 9, 20, 26, 32, 38, 39)], "symbol string, idx int, date date, atr_before double")
    got = sorted((r.episode, r.offset, r.decision_date, r.signals, r.least_atr) for r in G.episode_candidates(found, bars).collect())
    want = [(1, k, DAY + timedelta(3 + k), 3, 3.0) for k in range(6)] + [(2, 0, DAY + timedelta(20), 1, 20.0), (3, 0, DAY + timedelta(26), 1, 26.0), (4, 0, DAY + timedelta(32), 1, 32.0), (5, 0, DAY + timedelta(38), 2, 38.0)]
    assert got == want
