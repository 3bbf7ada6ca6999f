"""Selection under many trials, against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from statistics import NormalDist, fmean, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import selection as L


def test_normal_quantile(spark):
    ps = [1e-300, 1e-12, 1e-5, 0.02, 0.075, 0.3, 0.5, 0.9, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(S.normal_quantile("p").alias("z"))
    found = [r.z for r in df.collect()]
    assert found[-2:] == [None, None] and found[:-2] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-12)


CANDIDATES = "run string, key long, window long, variants long, p_value double, sr double, n_eff double, skew double, kurt double"


def plain_run(rows, q, prior):
    """The run's inference, one candidate at a time."""
    ps = {r[1]: min(max(r[4], 0), 1) for r in rows if r[4] is not None and math.isfinite(r[4])}
    ranked = sorted(ps.values())
    passing = [p for k, p in enumerate(ranked, 1) if p <= q * k / len(ranked)]
    cutoff = max(passing, default=None)
    trials = defaultdict(int)
    for r in rows:
        trials[r[2]] = max(trials[r[2]], r[3] or 1)
    n = max(1, prior + sum(trials.values()))
    srs = [r[5] if r[5] is not None and math.isfinite(r[5]) else 0.0 for r in rows]
    spread = stdev(srs) if len(srs) >= 3 else 0.0
    out = {}
    for r, sr in zip(rows, srs, strict=True):
        eff, skew, kurt = r[6] or 0, r[7] or 0.0, r[8] or 3.0
        star = 0.0
        if eff > 1 and spread > 0 and n > 1:
            z = NormalDist().inv_cdf
            star = spread * ((1 - 0.5772156649015329) * z(1 - 1 / n) + 0.5772156649015329 * z(1 - 1 / (n * math.e)))
        width = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
        dsr = NormalDist().cdf((sr - star) * math.sqrt(eff - 1) / math.sqrt(width)) if eff > 1 and width > 0 else None
        out[r[1]] = (r[1] in ps and cutoff is not None and ps[r[1]] <= cutoff, cutoff, len(ps), n, spread, star, dsr)
    return out


@pytest.mark.parametrize("prior", [0, 40])
def test_run_inference(spark, prior):
    rng = random.Random(2)
    rows = [("a", i, rng.randrange(3), rng.choice([None, 0, 4, 9]), rng.choice([None, float("nan"), -0.1, 1.4, 0.001, 0.001, rng.random(), rng.random() ** 4]), rng.choice([None, rng.gauss(0, 0.3)]), rng.choice([None, 1.0, 40.0]), rng.gauss(0, 1), rng.choice([None, 3.5])) for i in range(60)]
    rows += [("two", i, 0, 1, 0.9, 0.1, 30.0, 0.0, 3.0) for i in range(2)] + [("none", 0, 0, None, None, None, None, None, None)]
    found = defaultdict(dict)
    for r in L.run_inference(spark.createDataFrame(rows, CANDIDATES), "run", "key", q=0.1, prior=prior).collect():
        found[r.run][r.key] = (r.fdr_passed, r.fdr_cutoff, r.fdr_tests, r.n_trials, r.sr_std, r.sr_star, r.dsr)
    for run in ("a", "two", "none"):
        want = plain_run([r for r in rows if r[0] == run], 0.1, prior)
        assert want.keys() == found[run].keys()
        for k, w in want.items():
            told = lambda t: [-9.0 if x is None else float(x) for x in t]
            assert told(found[run][k]) == pytest.approx(told(w), rel=1e-9), (run, k)
    assert sum(x[0] for x in found["a"].values()) >= 5


def test_block_weights_take_all_periods():
    for n in (5, 17, 300):
        w = [L.block_weights(n, d, 6.0, 1) for d in range(200)]
        assert all(x.sum() == n and (x >= 0).all() for x in w) and abs(np.mean(w) - 1) < 1e-9
    assert np.array_equal(L.block_weights(300, 3, 6.0, 1), L.block_weights(300, 3, 6.0, 1))
    together = np.mean([np.mean((x[1:] > 0) & (x[:-1] > 0)) for x in w])
    assert together > np.mean([np.mean(x > 0) ** 2 for x in w]) + 0.05  # blocks: neighbours go together


def test_superior_ability(spark, monkeypatch):
    monkeypatch.setattr(L, "DAYS", 16)
    monkeypatch.setattr(L, "MEMBERS", 4)
    rng = random.Random(6)
    rows, values = [], defaultdict(lambda: defaultdict(float))
    for family, edge in (("null", 0.0), ("edge", 0.35)):
        for m in range(9):
            for t in range(60):
                if rng.random() < 0.9 or m == 0:
                    for _ in range(rng.choice([1, 1, 2])):
                        x = rng.gauss(edge if m == 4 else -1.5 if m == 5 else 0.0, 1.0)
                        rows.append((family, f"m{m}", date(2024, 1, 1) + timedelta(t), x))
                        values[family, m][t] += x
    rows += [("short", "m0", date(2024, 1, d + 1), 1.0) for d in range(4)] + [("edge", None, date(2024, 1, 1), 5.0), ("edge", "m1", date(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "family string, member string, day date, x double")
    found = {r.family: r for r in L.superior_ability(df.repartition(5), "family", "member", "day", "x", draws=80, seed=3).collect()}
    assert set(found) == {"null", "edge"}
    for family, r in found.items():
        x = np.array([[values[family, m][t] for m in range(9)] for t in range(60)])
        w = np.stack([L.block_weights(60, d, max(5, round(60 ** (1 / 3))), 3) for d in range(80)])
        mean, scale = x.mean(axis=0), x.std(axis=0, ddof=1)
        t = math.sqrt(60) * mean / scale
        assert (r.periods, r.members, r.best) == (60, 9, f"m{t.argmax()}") and r.best_t == pytest.approx(t.max())
        keep = np.where(t >= -math.sqrt(2 * math.log(math.log(60))), mean, 0)
        for name, centre, low in (("lower", np.maximum(mean, 0), True), ("consistent", keep, True), ("upper", mean, False)):
            worlds = (math.sqrt(60) * (w @ x / 60 - centre) / scale).max(axis=1)
            assert r[f"p_{name}"] == pytest.approx((1 + (worlds >= (max(t.max(), 0) if low else t.max())).sum()) / 81)
    assert found["edge"].p_consistent < 0.1 < found["null"].p_upper
    assert found["edge"].p_lower <= found["edge"].p_consistent <= found["edge"].p_upper


def test_nearest_better_skips_cells(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        scale = 10.0 ** (i % 4)
        rows.append((i, "f" if i % 7 else "g", float(rng.integers(0, 300)) / 300, [float(x) for x in rng.normal(size=5) * 0.1 + scale]))
    rows += [(5000, "f", 2.0, [1.0] * 3), (5001, "f", 0.5, None), (5002, "f", None, [float("nan")] * 5), (5003, "alone", 1.0, [1.0] * 5), (5004, "f", -1.0, [0.0] * 3)]
    df = spark.createDataFrame(rows, "id long, fam string, score double, v array<double>")
    near, looked = L.nearest_better(df, ["fam"], "id", "score", "v", block=64)
    found = {r.id: r.nearest for r in near.collect()}
    assert len(found) == len(rows)
    good = [r for r in rows if r[3] is not None and all(math.isfinite(x) for x in r[3])]
    order = lambda r: (-(r[2] if r[2] is not None else -math.inf), r[0])
    for r in rows:
        better = [np.linalg.norm(np.array(b[3]) - np.array(r[3])) for b in good if r in good and b[1] == r[1] and len(b[3]) == len(r[3]) and order(b) < order(r)]
        assert (found[r[0]] is None) == (not better) and (not better or found[r[0]] == pytest.approx(min(better), abs=1e-9))
    blocks = math.ceil(sum(r[1] == "f" for r in good) / 64)
    assert 0 < looked.count() < 0.5 * (blocks * 8) ** 2 / 2


def plain_nearest(x, rank, y, other):
    return np.array([np.sqrt(((y[other < k] - a) ** 2).sum(axis=1)).min(initial=np.inf) for a, k in zip(x, rank, strict=True)])


@pytest.mark.parametrize("kind", ["any", "copies", "norms", "far from nought", "huge"])
def test_nearest_measures_what_products_cannot_tell(kind):
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (150, 220), (220, 40)):
        x, y = rng.normal(size=(n, 4)), rng.normal(size=(m, 4))
        if kind == "copies":
            x, y = np.round(x), np.round(y)
        if kind == "norms":
            x, y = (a * 10.0 ** rng.integers(-3, 4, (len(a), 1)) for a in (x, y))
        if kind == "far from nought":
            x, y = (a * 1e-3 + 1e6 for a in (x, y))
        if kind == "huge":
            y[0] *= 1e160
            x[0] = y[0]
        rank, other = rng.permutation(500)[:n], rng.permutation(500)[:m]
        with np.errstate(over="ignore"):
            assert np.array_equal(L._nearest(x, rank, y, other, rows=16, held=32), plain_nearest(x, rank, y, other))


def test_nearest_better_sends_a_row_equally_often(spark, monkeypatch):
    rng = np.random.default_rng(8)
    met = {}
    for n in (800, 2400):
        v = rng.normal(size=(n, 6)) * 1e-3 + 1e6
        v[::5] = v[0]
        rows = [(i, i % 2, float(rng.integers(0, 50)), v[i].tolist()) for i in range(n)]
        near, pairs = L.nearest_better(spark.createDataFrame(rows, "id long, side long, score double, v array<double>"), ["side"], "id", "score", "v", block=32)
        met[n], found = pairs.count(), {r.id: r.nearest for r in near.collect()}
        place = np.empty(n, int)
        place[np.lexsort((np.arange(n), [-r[2] for r in rows]))] = np.arange(n)
        for side in (0, 1):
            ids = np.arange(side, n, 2)
            want = plain_nearest(v[ids], place[ids], v[ids], place[ids])
            assert [found[i] for i in ids] == [x if np.isfinite(x) else None for x in want]
    # Three times the rows: as many blocks, so three times as much is sent, not nine times.
    assert met[800] == met[2400]
    assert met[800] == 2 * L.BLOCKS * (L.BLOCKS + 1) // 2
    # Blocks of so many numbers that they become more.
    monkeypatch.setattr(L, "NUMBERS", 6 * 80)
    again, pairs = L.nearest_better(spark.createDataFrame(rows, "id long, side long, score double, v array<double>"), ["side"], "id", "score", "v", block=32)
    assert {r.id: r.nearest for r in again.collect()} == found and pairs.count() == 2 * 15 * 16 // 2


def test_probes(spark):
    rng = random.Random(9)
    rows = [(p, rng.choice("ABCD") if p != "single" else "A", date(2024, 1, 1) + timedelta(rng.randrange(9)), rng.gauss(0.2 if p == "good" else -0.3, 0.5), 0.01, rng.gauss(-0.2, 0.1)) for p in ("good", "bad", "single") for _ in range(41)]
    rows += [("tiny", "A", date(2024, 1, 1), 1.0, None, None), ("tiny", "B", date(2024, 1, 2), -1.0, 0.0, 0.0), ("good", None, date(2024, 1, 1), 9.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "p string, s string, d date, r double, c double, o double")
    out = L.probes(df, "p", "s", "d", "r", "c", "o")
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
    found = {r.p: r for r in out.collect()}
    for p in ("good", "bad", "single", "tiny"):
        mine = [r for r in rows if r[0] == p and r[1]]
        counts = Counter(r[1] for r in mine)
        top = min(counts, key=lambda s: (-counts[s], s))
        rest = [r[3] for r in mine if r[1] != top]
        assert found[p].n == len(mine) and found[p].top_symbol == top and found[p].expectancy == pytest.approx(fmean(r[3] for r in mine))
        assert found[p].without_top == (pytest.approx(fmean(rest)) if len(rest) >= 3 else None)
        days = defaultdict(list)
        for r in mine:
            days[r[2]].append(r[3])
        half, taken, first = math.ceil(len(mine) / 2), 0, 0.0
        for d in sorted(days):
            k = min(max(half - taken, 0), len(days[d]))
            first, taken = first + fmean(days[d]) * k, taken + len(days[d])
        assert found[p].first_half == pytest.approx(first / half)
    assert found["single"].failures[0] == "universe" and not found["bad"].challenge_passed and found["good"].challenge_passed and found["tiny"].date_score == 0.55


def test_leakage_probe(spark):
    rng = np.random.default_rng(2)
    rows = [(p, [float(x) for x in (1.0, rng.normal(), float("nan"), y if p == "leaks" else rng.normal())], y) for p in ("leaks", "fine") for y in rng.normal(size=40).tolist()] + [("few", [1.0, 2.0, 3.0, 4.0], 1.0), ("few", None, 2.0), ("few", [0.0], None)]
    found = {r.p: r for r in L.leakage_probe(spark.createDataFrame(rows, "p string, v array<double>, y double"), "p", "v", "y").collect()}
    assert found["leaks"].most == pytest.approx(1.0) and found["leaks"].hard_fail and found["leaks"].score == 0.0
    mine = [r for r in rows if r[0] == "fine"]
    want = max(abs(np.corrcoef([r[1][d] for r in mine], [r[2] for r in mine])[0, 1]) for d in (1, 3))
    assert found["fine"].most == pytest.approx(want) and not found["fine"].hard_fail and found["few"].score == 0.65
