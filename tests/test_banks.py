"""Grouped k-means, medoids, calibrated distances and coassignment against plain versions."""

from __future__ import annotations

import json
from collections import defaultdict
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import banks as B


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"g{i % 3}", [float(x) for x in rng.normal(loc=(i % 5) * 2, size=6)]) for i in range(300)]
    rows += [(1000 + i, "few", [float(i), 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(4)] + [(1004, "few", [0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    rows += [(2000, "g0", None), (2001, "g0", [float("nan")] * 6), (2002, "g1", [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    return spark.createDataFrame(rows, "id long, g string, v array<double>")


def hashes(spark, ids, salt=0):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r.id: r.h for r in df.select("id", F.xxhash64("id", F.lit(salt)).alias("h")).collect()}


def plain_kmeans(points, order, m, iterations):
    c = np.array([points[i] for i in order[:m]])
    x = np.array(list(points.values()))
    for _ in range(iterations):
        to = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[to == i].mean(axis=0) if (to == i).any() else c[i] for i in range(len(c))])
        if np.array_equal(new, c):
            break
        c = new
    return c


def good(vectors):
    out = defaultdict(dict)
    for r in vectors.collect():
        if r.v is not None and all(x is not None and x == x for x in r.v):
            out[r.g][r.id] = np.array(r.v)
    return out


def test_kmeans_and_medoids(spark, vectors, monkeypatch):
    groups = good(vectors)
    h = hashes(spark, [i for g in groups.values() for i in g])
    want = {g: plain_kmeans(p, sorted(p, key=lambda i: h[i]), 5, 10) for g, p in groups.items()}
    for numbers in (1 << 20, 40):  # 40: a pass a group or so
        monkeypatch.setattr(B, "CENTRE_NUMBERS", numbers)
        found = {json.loads(g)["g"]: c for _, centres in B.kmeans_by(vectors.repartition(7), ["g"], "id", "v", 5) for g, c in centres.items()}
        assert found.keys() == want.keys() and all(np.allclose(found[g], want[g], atol=1e-9) for g in want)
        chosen = {r.g: r.medoids for r in B.medoids(vectors.repartition(7), "g", "id", "v", 5).collect()}
        for g, points in groups.items():
            if len(points) <= 5:
                ids = sorted(points)
            else:
                ids = sorted({min(points, key=lambda i, c=c: (((points[i] - c) ** 2).sum(), i)) for c in want[g]})
            assert np.allclose(chosen[g], [points[i] for i in ids])


def test_bank_and_distances(spark, vectors):
    held = F.pmod("id", F.lit(4)) == 0
    rows = B.bank(vectors.filter("id < 1000"), "g", "id", "v", held, m=4, k=3).collect()
    groups = {g: p for g, p in good(vectors.filter("id < 1000")).items()}
    assert {r.g for r in rows} == set(groups)
    for r in rows:
        points = groups[r.g]
        fit = np.array([x for i, x in points.items() if i % 4])
        variance = fit.var(axis=0) + 0.05 * fit.var(axis=0).mean()
        assert np.allclose(r.centre, fit.mean(axis=0)) and np.allclose(r.variance, variance) and all(any(np.array_equal(m, x) for x in fit) for m in r.medoids)
        far = lambda x: sorted(np.linalg.norm(np.array(m) - x) for m in r.medoids)[:3]  # noqa: B023, E731
        knn = sorted(np.mean(far(x)) / sqrt(6) for i, x in points.items() if i % 4 == 0)
        maha = sorted(sqrt((((x - fit.mean(axis=0)) ** 2) / variance).mean()) for i, x in points.items() if i % 4 == 0)
        k = min(ceil((len(knn) + 1) * 0.9), len(knn)) - 1
        assert r.calibrating == len(knn) and r.tau_knn == pytest.approx(knn[k]) and r.tau_maha == pytest.approx(maha[k])
    assert B.bank(vectors.filter("g = 'few'"), "g", "id", "v", held).count() == 0
    assert B.medoids(vectors.limit(0), "g", "id", "v").count() == 0


def test_coassignment_equals_pairs(spark, vectors):
    voted = B.votes(vectors.filter("id < 300"), "id", "v", 4, repeats=3).withColumn("label", F.when(F.col("label") == 3, -1).otherwise(F.col("label")))
    rows = voted.withColumn("cluster", F.col("id") % 4).unionByName(spark.createDataFrame([(0, 5000, None, 9), (0, 5001, 2, 9)], "run int, id long, label int, cluster long"))
    found = {r.cluster: r for r in B.coassignment(rows, "cluster", "run", "label").collect()}
    seen, per = defaultdict(dict), defaultdict(int)
    for r in rows.collect():
        if r.label is not None:
            seen[r.cluster, r.run][r.id] = r.label
    for c in range(4):
        pairs = [(a, b) for run in range(3) for (_, a), (_, b) in combinations(seen[c, run].items(), 2)]
        together = sum(a == b and a >= 0 for a, b in pairs)
        assert (found[c].pair_observations, found[c].coassigned) == (len(pairs), together) and found[c].rate == pytest.approx(together / len(pairs))
        assert found[c].noise_rate == pytest.approx(np.mean([np.mean([x < 0 for x in seen[c, run].values()]) for run in range(3)]))
    assert found[9].pair_observations == 0 and found[9].rate is None
    assert "Join" not in B.coassignment(rows, "cluster", "run", "label")._jdf.queryExecution().executedPlan().toString()
    sizes = {run: sum(len(v) for (_, r), v in seen.items() if r == run) for run in range(3)}
    assert all(200 < n < 280 for n in sizes.values())
