"""Vector and shape similarity: prototypes, conformal thresholds, nearest neighbours, warping distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import indexed


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Per label the mean and the population variance of each component; combines map-side by (label, component)."""
    parts = vectors.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "m", "v")))
    return parts.groupBy(label).agg(ordered.alias("_p")).select(label, F.transform("_p", lambda p: p["m"]).alias("centroid"), F.transform("_p", lambda p: p["v"]).alias("variance"))


def mahalanobis(x: Column, centre: Column, variance: Column, floor: float = 1e-6) -> Column:
    """sqrt(mean(d^2 / variance))."""
    d = F.zip_with(x, centre, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(F.zip_with(d, variance, lambda q, v: q / F.greatest(v, F.lit(floor))), F.lit(0.0), lambda s, q: s + q) / F.size(x))


def nearest_prototypes(vectors: DataFrame, bank: DataFrame, key: str, label: str, vector: str, slice_rows: int = 10_000) -> DataFrame:
    """Each vector's nearest and second nearest prototype and the ratio of their distances; ties to the smaller label.

    The bank goes to the tasks in slices of at most slice_rows prototypes, one scan of the vectors a slice.
    """
    slices = max(1, -(-bank.count() // slice_rows))
    kinds = dict(vectors.dtypes) | {"_l": dict(bank.dtypes)[label]}
    schema = f"{key} {kinds[key]}, _d array<struct<d:double,l:{kinds['_l']}>>"
    best = None
    for i in range(slices):
        rows = sorted(bank.filter(F.pmod(F.hash(label), F.lit(slices)) == i).select(label, "centroid").collect())
        names, centres = [r[0] for r in rows], np.array([r[1] for r in rows], float)

        def run(batches: Iterator[pa.RecordBatch], names=names, centres=centres) -> Iterator[pa.RecordBatch]:
            kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kinds["_l"]]
            labels, k = pa.array(names, kind), min(2, len(names))
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                near, far = np.zeros((len(x), k), np.int64), np.zeros((len(x), k))
                # All distances of a few rows at a time, within a fixed number of differences.
                step = max(1, (1 << 22) // max(1, centres.size))
                for at in range(0, len(x), step):
                    d = np.sqrt(((x[at : at + step, None, :] - centres) ** 2).sum(axis=2))
                    near[at : at + step] = np.argsort(d, axis=1, kind="stable")[:, :k]
                    far[at : at + step] = np.take_along_axis(d, near[at : at + step], axis=1)
                pairs = pa.StructArray.from_arrays([pa.array(far.ravel()), labels.take(pa.array(near.ravel()))], ["d", "l"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pairs)], [key, "_d"])

        part = vectors.select(key, vector).mapInArrow(run, schema)
        best = part if best is None else best.unionByName(part)
    if slices > 1:
        best = best.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_d"))), 1, 2).alias("_d"))
    first, second = F.col("_d")[0], F.get(F.col("_d"), 1)
    return best.select(key, first["l"].alias("nearest"), first["d"].alias("distance"), (first["d"] / F.nullif(second["d"], F.lit(0.0))).alias("ambiguity"))


def radii(vectors: DataFrame, bank: DataFrame, label: str, vector: str, share: float = 0.9) -> DataFrame:
    """(label, radius): the exact share-quantile of the members' distances to their own prototype."""
    own = vectors.join(bank.select(label, "centroid"), label)
    return own.groupBy(label).agg(F.percentile(distance(F.col(vector), F.col("centroid")), share).alias("radius"))


def assign_within(vectors: DataFrame, bank: DataFrame, key: str, label: str, vector: str, reach: float = 1.25, noise: int = -1) -> DataFrame:
    """The nearest prototype of each vector, and `assigned`: its label within reach x its members' p90 radius, else noise."""
    near = nearest_prototypes(vectors, bank, key, label, vector)
    limits = radii(vectors, bank, label, vector).select(F.col(label).alias("nearest"), "radius")
    inside = F.col("distance") <= reach * F.col("radius")
    return near.join(limits, "nearest").select(key, "nearest", "distance", "ambiguity", "radius", F.when(inside, F.col("nearest")).otherwise(noise).alias("assigned"))


def held_for_calibration(key: str) -> Column:
    """A quarter of the keys, by hash: rows that calibrate and so must not fit."""
    return F.substring(F.md5(F.col(key).cast("string")), 1, 1) < "4"


def conformal_threshold(df: DataFrame, keys: list[str], score: str, alpha: float) -> DataFrame:
    """The order statistic ceil((n + 1)(1 - alpha)) of each key's scores; not a percentile."""
    placed = indexed(df.withColumn("_hundredth", F.floor(F.col(score) * 100)), keys, "_hundredth", [score], "_at")
    wanted = F.least(F.ceil((F.col("_at_of") + 1) * (1 - alpha)), F.col("_at_of"))
    return placed.filter(F.col("_at") == wanted - 1).select(*keys, F.col("_at_of").alias("n"), F.col(score).alias("threshold"))


def knn_distance(vectors: DataFrame, key: str, group: str, vector: str, k: int, block: int = 8192) -> DataFrame:
    """Mean distance to the k nearest of the same group: blocks of a group's rows meet its shards, and the shards' k best merge.

    No task holds more than one block and one shard, however large a group is. Squared distances from products choose the rows that
    may be among the k nearest, within the products' rounding; those rows' distances are then taken exactly.
    """
    sizes = vectors.groupBy(group).agg(F.ceil(F.count("*") / block).alias("_n"))
    sized = vectors.select(key, group, vector).join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_n")))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1).cast("array<bigint>"))
    fresh = lambda own: sized.select(*[F.col(c).alias(c) for c in (key, group, vector, "_n")], F.col("_own").alias(own))
    asked, held = fresh("_block").withColumn("_shard", every), fresh("_shard").withColumn("_block", every)

    def run(left, right):
        ids, near = [], []
        if left.num_rows and right.num_rows:
            x, y = (np.array(t.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1) for t in (left, right))
            names, held_names = (np.array(t.column(key).to_pylist(), object) for t in (left, right))
            places = {name: i for i, name in enumerate(held_names)}
            ys = (y * y).sum(axis=1)
            # Without finite squares, or with keys held twice, all rows' distances are taken.
            sure = np.isfinite(4 * ys).all() and np.isfinite(4 * (x * x).sum(axis=1)).all() and len(places) == len(y)
            # Some rows' distances at a time: within a fixed number of products.
            step = max(1, (1 << 21) // len(y))
            for at in range(0, len(x), step):
                some = x[at : at + step]
                squares = (some * some).sum(axis=1)[:, None] - 2 * some @ y.T + ys
                for i, name in enumerate(names[at : at + step]):
                    if name in places:
                        squares[i, places[name]] = np.inf
                least = np.partition(squares, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
                room = 1e-12 * x.shape[1] * ((some * some).sum(axis=1) + ys.max() + 1)
                for i, name in enumerate(names[at : at + step]):
                    may = np.flatnonzero(squares[i] <= least[i] + room[i]) if sure else np.arange(len(y))
                    may = may[held_names[may] != name]
                    found = np.sort(np.sqrt(((y[may] - some[i]) ** 2).sum(axis=1)))[:k].tolist()
                    ids += [name] * len(found)
                    near += found
        return pa.table({key: pa.array(ids, left.schema.field(key).type), "d": pa.array(near, pa.float64())})

    keys = [group, "_block", "_shard"]
    best = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, f"{key} {dict(vectors.dtypes)[key]}, d double")
    ranked = best.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("d"))).filter(F.col("_k") <= k)
    return ranked.groupBy(key).agg(F.avg("d").alias("knn"))


def dtw(a: np.ndarray, b: np.ndarray, band: int) -> float:
    """Banded warping distance of two series (rows: time), over the longer length."""
    n, m = len(a), len(b)
    band = max(band, abs(n - m))
    row = np.full(m + 1, np.inf)
    row[0] = 0
    for i in range(1, n + 1):
        low, high = max(1, i - band), min(m, i + band)
        cost = np.sqrt(((a[i - 1] - b[low - 1 : high]) ** 2).sum(axis=-1))
        fresh = np.full(m + 1, np.inf)
        for j in range(low, high + 1):
            fresh[j] = cost[j - low] + min(row[j], row[j - 1], fresh[j - 1])
        row = fresh
    return float(row[m] / max(n, m))


def dtw_rows(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """`dtw` of each row of a (rows x time) to the series b, a diagonal of the table at a time for all rows."""
    n, m = a.shape[1], len(b)
    band = max(band, abs(n - m))
    # Diagonal d holds the cells i + j = d, by i; cells beyond the band stay infinite.
    before = np.full((len(a), n + 1), np.inf)
    last = np.full((len(a), n + 1), np.inf)
    last[:, 0] = 0.0
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        i = i[(i > 0) & (d - i > 0) & (np.abs(2 * i - d) <= band)]
        now = np.full((len(a), n + 1), np.inf)
        # From (i - 1, j - 1) two diagonals back, (i - 1, j) and (i, j - 1) on the last one.
        now[:, i] = np.abs(a[:, i - 1] - b[d - i - 1]) + np.minimum(before[:, i - 1], np.minimum(last[:, i - 1], last[:, i]))
        before, last = last, now
    return last[:, n] / max(n, m)


def dtw_to(series: DataFrame, key: str, values: str, prototype: list[float], band: int, rows: int = 512) -> DataFrame:
    """(key, dtw) of each series to a prototype; null without values. Series of one length are worked on together, `rows` at a time."""
    p = np.array(prototype, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            found = np.full(len(column), np.nan)
            for n in np.unique(sizes[sizes > 0]):
                same = np.flatnonzero(sizes == n)
                for at in range(0, len(same), rows):
                    some = same[at : at + rows]
                    x = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), n)
                    found[some] = dtw_rows(x, p, band)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64(), mask=sizes == 0)], [key, "dtw"])

    return series.select(key, values).mapInArrow(run, f"{key} {dict(series.dtypes)[key]}, dtw double")


def kmeans(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """(key, cluster) by MLlib's k-means on standardised components."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data).transform(data)
    return KMeans(k=k, seed=seed, maxIter=20).fit(scaled).transform(scaled).select(key, F.col("prediction").alias("cluster"))
