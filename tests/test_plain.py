"""Queries that have no SQL, against plain Python over the same rows."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import inference as I
from tidemark.operators import shapes as H
from tidemark.operators import similarity as V
from tidemark.plans.inputs import daily_bars, table, trades
from tidemark.plans.research import _ORDER


@pytest.fixture(scope="module")
def lines(spark, data):
    return trades(spark, data).collect()


def test_dtw_distance(spark, data):
    found = {r.vec_id: r.dtw for r in catalog.QUERIES["dtw_distance"](spark, data).collect()}
    p = np.array([i / 64 for i in range(32)] + [1 - i / 64 for i in range(32)])
    rows = table(spark, data, "embeddings").collect()
    assert len(found) == len(rows)
    for r in rows[:60]:
        assert found[r.vec_id] == pytest.approx(V.dtw(np.array(r.embedding, float)[:, None], p[:, None], 6))


def test_dtw_of_uneven_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=n)] if n is not None else None) for i, n in enumerate([3, 3, 9, 14, 1, 0, None, 9])]
    p = [0.0, 0.4, 0.2, -0.1, 0.3]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for band in (1, 3, 20):
        for r, (_, x) in zip(V.dtw_to(df, "id", "v", p, band, rows=2).orderBy("id").collect(), rows, strict=True):
            assert r.dtw == (pytest.approx(V.dtw(np.array(x)[:, None], np.array(p)[:, None], band)) if x else None)


def test_soft_dtw_divergence(spark, data):
    found = {r.vec_id: r.divergence for r in catalog.QUERIES["soft_dtw_divergence"](spark, data).collect()}

    def soft(a, b):
        t = np.full((len(a) + 1, len(b) + 1), np.inf)
        t[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                z = [-t[i - 1, j - 1], -t[i - 1, j], -t[i, j - 1]]
                t[i, j] = (a[i - 1] - b[j - 1]) ** 2 - (max(z) + math.log(sum(math.exp(x - max(z)) for x in z)))
        return t[-1, -1]

    p = [i / 64 for i in range(64)]
    for r in table(spark, data, "embeddings").limit(8).collect():
        v = [float(x) for x in r.embedding]
        assert found[r.vec_id] == pytest.approx(soft(v, p) - 0.5 * (soft(v, v) + soft(p, p)), abs=1e-6)


def test_cup_detector(spark, data):
    closes = defaultdict(list)
    for r in sorted(daily_bars(spark, data).collect(), key=lambda r: (r.symbol, r.date)):
        closes[r.symbol].append((r.date, r.close))
    want = {(s, xs[i][0]): H.find_cup(np.array([c for _, c in xs[i - 59 : i + 1]])) for s, xs in closes.items() for i in range(59, len(xs))}
    found = {(r.symbol, r.date): (r.found, pytest.approx(r.score)) for r in catalog.QUERIES["cup_detector"](spark, data).collect()}
    assert want == found


def test_portfolio_two_new_a_day(spark, data, lines):
    want, portfolios = [], defaultdict(list)
    for r in lines:
        portfolios[r.pattern].append((r.entry_date, r.symbol, r.exit_date, r.ret))
    for name, rows in portfolios.items():
        opened, locked = defaultdict(int), {}
        for start, symbol, end, ret in sorted(rows):
            if opened[start] < 2 and (symbol not in locked or locked[symbol] < start):
                opened[start] += 1
                locked[symbol] = end
                want.append((name, symbol, start, end, ret))
    assert sorted(tuple(r) for r in catalog.QUERIES["portfolio_two_new_a_day"](spark, data).collect()) == sorted(want)


def test_cluster_bootstrap(spark, data):
    named = trades(spark, data).withColumn("name", F.xxhash64("symbol", "entry_date")).collect()
    sums, counts = defaultdict(float), defaultdict(int)
    for r in named:
        sums[r.name] += r.ret
        counts[r.name] += 1
    total, n = np.zeros(100), np.zeros(100)
    for name in sums:
        w = np.random.default_rng([0, name & 0x7FFFFFFF]).poisson(1.0, 100)
        total, n = total + w * sums[name], n + w * counts[name]
    found = {r.draw: r["mean"] for r in catalog.QUERIES["cluster_bootstrap"](spark, data).collect()}
    assert [found[i] for i in range(100)] == pytest.approx(list(total / n))


def test_stationary_bootstrap(spark, data):
    rows = defaultdict(list)
    for r in trades(spark, data).withColumn("name", F.xxhash64("pattern")).collect():
        rows[r.pattern, r.name].append((tuple(r[c] for c in _ORDER), r.ret))
    found = {r.pattern: r for r in catalog.QUERIES["stationary_bootstrap"](spark, data).collect()}
    assert set(found) == {p for p, _ in rows}
    for (pattern, name), xs in rows.items():
        x = np.array([r for _, r in sorted(xs)])
        n, rng, means = len(x), np.random.default_rng([0, name & 0xFFFFFFFF, 0]), []
        assert n <= 8192  # one chunk here; chunks are tested apart
        for _ in range(100):
            weight = np.zeros(n)
            starts = np.concatenate([np.zeros(rng.poisson(1 - 1 / 5.0), int), rng.integers(0, n, rng.poisson(n / 5.0))])
            for s, length in zip(starts, rng.geometric(1 / 5.0, len(starts)), strict=True):
                weight[s : s + length] += 1
            means.append(weight @ x / weight.sum())
        r = found[pattern]
        assert (r.n, r["mean"], r.low, r.high) == pytest.approx((n, x.mean(), *np.percentile(means, [2.5, 97.5])))
        assert r.p == pytest.approx((1 + sum(m <= 0 for m in means)) / 101)
    with pytest.raises(ValueError, match="20 blocks"):
        I.stationary_bootstrap(trades(spark, data), ["pattern"], _ORDER, "ret", block=5.0, chunk=64)


def test_family_tests(spark, data, lines):
    """Days are resampled for all members alike: the same Poisson weight a day."""
    days = {d: np.random.default_rng([0, (d - __import__("datetime").date(1970, 1, 1)).days]).poisson(1.0, 200) for d in {r.exit_date for r in lines}}
    stats, worlds = {}, {}
    for s in {r.symbol for r in lines}:
        mine = [r for r in lines if r.symbol == s]
        x = np.array([r.ret for r in mine])
        error = x.std(ddof=1) / math.sqrt(len(x))
        w = np.array([days[r.exit_date] for r in mine])
        stats[s] = (len(x), x.mean(), x.mean() / error)
        worlds[s] = (x @ w / w.sum(axis=0) - x.mean()) / error
    best = np.max(list(worlds.values()), axis=0)
    for r in catalog.QUERIES["family_reality_check"](spark, data).collect():
        assert (r.n, r["mean"], r.t) == pytest.approx(stats[r.symbol]) and r.p_family == pytest.approx((1 + (best >= r.t).sum()) / 201)
    order, low = sorted(stats, key=lambda s: (-stats[s][2], s)), 0.0
    found = {r.symbol: r.p_adjusted for r in catalog.QUERIES["romano_wolf"](spark, data).collect()}
    for k, s in enumerate(order):
        rest = np.max([worlds[o] for o in order[k:]], axis=0)
        low = max(low, (1 + (rest >= stats[s][2]).sum()) / 201)
        assert found[s] == pytest.approx(low)


def test_kmeans_clusters_are_nearest_centres(spark, data):
    rows = V.kmeans(table(spark, data, "embeddings"), "vec_id", "embedding", 8).join(table(spark, data, "embeddings"), "vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    label = np.array([r.cluster for r in rows])
    centres = np.array([x[label == k].mean(axis=0) for k in range(8)])
    nearest = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == label).mean() > 0.97
    counts = {r.cluster: r["count"] for r in catalog.QUERIES["kmeans_clusters"](spark, data).collect()}
    assert sum(counts.values()) == len(rows) and sorted(counts.values()) == sorted(np.bincount(label).tolist())
