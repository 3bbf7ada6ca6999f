"""Prototype banks: grouped k-means, medoids, calibrated distances, and stability of clusters over repeated clusterings."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per, indexed
from .similarity import distance, mahalanobis

#: Numbers of all centres that a pass may hold, on the driver and in each task; more groups take more passes over the rows.
CENTRE_NUMBERS = 8 << 20
Centres = dict[str, np.ndarray]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the first of equals) and the distance to it."""
    squares = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)
    to = squares.argmin(axis=1)
    return to, np.sqrt(((x - c[to]) ** 2).sum(axis=1))


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, places in the batch, vectors) of a batch."""
    if not batch.num_rows:
        return
    names = np.array(batch.column("_group").to_pylist(), object)
    vectors = _matrix(batch.column("_vector"))
    for name in sorted(set(names)):
        at = np.flatnonzero(names == name)
        yield name, at, vectors[at]


def _points(df: DataFrame, group: list[str], key: str, vector: str) -> DataFrame:
    """_group, _key, _vector; rows without a vector or with a null or non-finite component take no part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    name = F.to_json(F.struct(*group)) if group else F.lit("")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)
    return df.filter(good).select(name.alias("_group"), F.col(key).alias("_key"), v.alias("_vector"))


def _update(points: DataFrame, centres: Centres) -> Centres:
    """One step of Lloyd's method: sums by task, then by centre. A centre without members stays where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: (np.zeros_like(c), np.zeros(len(c))) for g, c in centres.items()}
        for batch in batches:
            for name, _, x in _by_group(batch):
                if name in sums:
                    to, _ = _nearest(x, centres[name])
                    np.add.at(sums[name][0], to, x)
                    np.add.at(sums[name][1], to, 1)
        rows = [(g, i, float(n[i]), s[i].tolist()) for g, (s, n) in sums.items() for i in np.flatnonzero(n)]
        yield pa.RecordBatch.from_pylist([dict(zip(("g", "i", "n", "s"), r, strict=True)) for r in rows], schema=pa.schema([("g", pa.string()), ("i", pa.int32()), ("n", pa.float64()), ("s", pa.list_(pa.float64()))]))

    parts = points.mapInArrow(run, "g string, i int, n double, s array<double>")
    each = parts.select("g", "i", "n", F.posexplode("s").alias("d", "x")).groupBy("g", "i", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    means = each.groupBy("g", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", (F.col("x") / F.col("n")).alias("x")))), lambda p: p["x"]).alias("c"))
    out = {g: c.copy() for g, c in centres.items()}
    for r in means.collect():
        out[r.g][r.i] = r.c
    return out


def _passes(points: DataFrame, m: int) -> Iterator[DataFrame]:
    """The rows in passes, such that the centres of the groups of each are within CENTRE_NUMBERS."""
    stats = points.agg(F.approx_count_distinct("_group").alias("n"), F.max(F.size("_vector")).alias("d")).first()
    n = ceil(1.2 * (stats["n"] or 0) * m * (stats["d"] or 0) / CENTRE_NUMBERS)
    for i in range(n):
        yield points.filter(F.pmod(F.xxhash64("_group"), F.lit(n)) == i) if n > 1 else points


def kmeans_by(df: DataFrame, group: list[str], key: str, vector: str, m: int, iterations: int = 10, salt: int = 0) -> Iterator[tuple[DataFrame, Centres]]:
    """Lloyd's k-means of each group's rows, all groups in one scan a step: (rows, centres by group) a pass.

    It starts from the m rows of each group with the smallest hash of key and salt, so results don't depend on how rows are dealt but
    for the order of sums. Groups of at most m rows have each row as a centre. Rows stay where they are; only centres and their sums move.
    """
    points = _points(df, group, key, vector)
    for part in _passes(points, m):
        first = first_per(part.withColumn("_h", F.xxhash64("_key", F.lit(salt))), ["_group"], [F.col("_h"), F.col("_key")], m)
        centres: Centres = {}
        for r in sorted(first.collect(), key=lambda r: (r["_group"], r["_h"])):
            centres.setdefault(r["_group"], []).append(r["_vector"])
        centres = {g: np.array(c) for g, c in centres.items()}
        for _ in range(iterations):
            moved = _update(part, centres)
            still = all(np.array_equal(moved[g], centres[g]) for g in centres)
            centres = moved
            if still:
                break
        yield part, centres


def assign(points: DataFrame, centres: Centres, key_type: str) -> DataFrame:
    """_group, _key, cluster, distance of each row of a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for name, at, x in _by_group(batch):
                to[at], far[at] = _nearest(x, centres[name])
            yield pa.RecordBatch.from_arrays([batch.column("_group"), batch.column("_key"), pa.array(to), pa.array(far)], names=["_group", "_key", "cluster", "distance"])

    return points.mapInArrow(run, f"_group string, _key {key_type}, cluster int, distance double")


def medoids(df: DataFrame, group: str, key: str, vector: str, m: int = 16, iterations: int = 10) -> DataFrame:
    """(group, medoids: array of at most m members' vectors by key): the member nearest to each centre of the group's k-means.

    The nearest are minima by task, then over tasks. A member that is nearest to two centres counts once; groups of at most m members
    have all of them.
    """
    kinds = dict(df.dtypes)
    out = None
    for points, centres in kmeans_by(df, [group], key, vector, m, iterations):
        out_type = f"_group string, _key {kinds[key]}, cluster int, distance double, _vector array<double>"

        def run(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[str, int], tuple] = {}
            schema = None
            for batch in batches:
                schema = batch.schema
                keys = batch.column("_key").to_pylist()
                for name, at, x in _by_group(batch):
                    c = centres[name]
                    squares = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) if len(x) * c.size <= 1 << 22 else np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
                    for i in range(len(c)):
                        low = squares[:, i].min()
                        for j in np.flatnonzero(squares[:, i] == low):
                            entry = (float(np.sqrt(low)), keys[at[j]], x[j].tolist())
                            best[name, i] = min(best.get((name, i), entry), entry)
            if best:
                rows = [{"_group": g, "_key": k, "cluster": i, "distance": d, "_vector": v} for (g, i), (d, k, v) in best.items()]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([schema.field("_group"), schema.field("_key"), ("cluster", pa.int32()), ("distance", pa.float64()), ("_vector", pa.list_(pa.float64()))]))

        nearest = points.mapInArrow(run, out_type).groupBy("_group", "cluster").agg(F.min(F.struct("distance", "_key", "_vector")).alias("b"))
        chosen = nearest.groupBy("_group").agg(F.array_sort(F.collect_set(F.struct("b._key", "b._vector"))).alias("some"))
        # Groups that fit are taken whole: more rows than m are never gathered.
        few = points.groupBy("_group").agg(F.count("*").alias("n")).filter(F.col("n") <= m)
        whole = points.join(few, "_group", "left_semi").groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_key", "_vector"))).alias("every"))
        part = chosen.join(whole, "_group", "left").select(F.from_json("_group", f"`{group}` {kinds[group]}")[group].alias(group), F.transform(F.coalesce("every", "some"), lambda x: x["_vector"]).alias("medoids"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], f"`{group}` {kinds[group]}, medoids array<array<double>>")


def knn_to(x: Column, bank: Column, k: int) -> Column:
    """Mean of the k smallest distances to a bank's vectors, over the root of the dimension."""
    sizes = F.sort_array(F.transform(bank, lambda c: distance(x, c)))
    nearest = F.slice(sizes, 1, k)
    return F.aggregate(nearest, F.lit(0.0), lambda s, d: s + d) / F.size(nearest) / F.sqrt(F.size(x))


def conformal_tau(df: DataFrame, group: str, score: str, key: str, alpha: float) -> DataFrame:
    """(group, n, tau): the ceil((n + 1)(1 - alpha))-th smallest score, at most the n-th. No task holds a group's scores: they are placed by hundredths."""
    placed = indexed(df.withColumn("_hundredth", F.floor(F.col(score) * 100)), [group], "_hundredth", [score, key], "_at")
    rank = F.least(F.ceil((F.col("_at_of") + 1) * F.lit(1 - alpha)), F.col("_at_of"))
    return placed.filter(F.col("_at") == rank - 1).select(group, F.col("_at_of").alias("n"), F.col(score).alias("tau"))


def bank(vectors: DataFrame, group: str, key: str, vector: str, calibrates: Column, m: int = 16, k: int = 3, alpha: float = 0.1, least: int = 8) -> DataFrame:
    """One row a group of at least `least` rows: medoids, centre, variance (regularised), members, calibrating, tau_knn, tau_maha.

    Rows for which `calibrates` holds fit nothing and give the thresholds; the others give medoids, centre and variance. To each
    variance is added the greater of 1e-9 and a twentieth of their mean. Groups without a calibrating or a fitting row have no bank.
    """
    enough = vectors.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(group)
    vectors = vectors.join(enough, group, "left_semi").select(group, key, F.transform(vector, lambda x: x.cast("double")).alias("_x"))
    fits = vectors.filter(~calibrates)
    parts = fits.select(group, F.posexplode("_x").alias("d", "x")).groupBy(group, "d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("n"))
    shape = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("d", "m", "v"))).alias("p"), F.avg("v").alias("_mean"), F.max("n").alias("members"))
    added = F.greatest(F.lit(1e-9), 0.05 * F.col("_mean"))
    shape = shape.select(group, "members", F.transform("p", lambda p: p["m"]).alias("centre"), F.transform("p", lambda p: p["v"] + added).alias("variance"))
    shape = shape.join(medoids(fits, group, key, "_x", m), group)
    held = vectors.filter(calibrates).join(shape, group).select(group, key, knn_to(F.col("_x"), F.col("medoids"), k).alias("knn"), mahalanobis(F.col("_x"), F.col("centre"), F.col("variance"), 0.0).alias("maha"))
    for name in ("knn", "maha"):
        tau = conformal_tau(held, group, name, key, alpha).select(group, F.col("n").alias("calibrating"), F.col("tau").alias(f"tau_{name}"))
        shape = shape.join(tau if name == "knn" else tau.drop("calibrating"), group)
    return shape


def votes(df: DataFrame, key: str, vector: str, k: int, repeats: int = 8, share: int = 80, iterations: int = 5, salt: int = 0) -> DataFrame:
    """(run, key, label): repeated k-means, each over the `share` percent of rows that a hash of key and run draws; all runs share each scan."""
    drawn = lambda run: F.pmod(F.xxhash64(F.col(key), run, F.lit(salt)), F.lit(100)) < share
    runs = F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), drawn)
    kinds, out = dict(df.dtypes), None
    sampled = df.select(key, vector, F.explode(runs).alias("run"))
    for points, centres in kmeans_by(sampled, ["run"], key, vector, k, iterations, salt):
        part = assign(points, centres, kinds[key]).select(F.from_json("_group", "run int")["run"].alias("run"), F.col("_key").alias(key), F.col("cluster").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], f"run int, `{key}` {kinds[key]}, label int")


def coassignment(votes: DataFrame, cluster: str, run: str, label: str) -> DataFrame:
    """Per cluster: runs, pair_observations, coassigned, rate (null without pairs) and noise_rate, of the votes on its members.

    votes: a row for each member that a run has seen; label -1 (or below) is noise, which shares no pair. A pair of members is observed
    in each run that has seen both and coassigned where both have one label; pairs are summed from counts and never made.
    """
    pairs = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    seen = votes.filter(F.col(label).isNotNull()).groupBy(cluster, run, label).agg(F.count("*").alias("n"))
    by_run = seen.groupBy(cluster, run).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(label) >= 0, pairs("n")).otherwise(0)).alias("together"), F.sum(F.when(F.col(label) < 0, F.col("n")).otherwise(0)).alias("noise"))
    out = by_run.groupBy(cluster).agg(F.count("*").alias("runs"), F.sum(pairs("n")).alias("pair_observations"), F.sum("together").alias("coassigned"), F.avg(F.col("noise") / F.col("n")).alias("noise_rate"))
    return out.withColumn("rate", F.try_divide("coassigned", "pair_observations"))
