"""Exact top-k inner-product search with MaxScore over sharded postings blocked by value.

Vectors are rounded to integers; a dimension is a term, and its postings in a shard are the shard's rows in order of their
value, cut into BLOCKS blocks. For a query a block's bound is the largest contribution that its rows can make to the score.
The best known k-th score is the threshold. The postings are split by their bounds: per term the blocks of the largest
contributions are essential, as far down as is needed until the bounds of the terms' next blocks sum up to less than the
threshold; a row that stands in no essential block can't reach it. (A term none of whose blocks is needed is non-essential as
a whole. Vectors are dense, so whole lists alone would rule out nothing.) The essential postings are traversed and their
contributions summed by row. The best looking rows are scored, which lifts the threshold; the other terms are probed, those that
can lower a bound most first, only for rows that stay competitive, that is whose sum and remaining bounds reach it. Shards give
their k best and merge. Results are exact, ties to the smaller id.

Queries meet the shards in blocks of QUERY_BLOCK, so no task holds more than one shard and one block; rows are dealt to both by
number, so an id that many rows share fills none. Every row is copied once for each block or shard of the other side, hence
their sizes. A query's scores are taken in doubles where none can pass 2 ** 53, which is exact, else in 64-bit integers where none
can pass these, else in integers of any size; bounds are then widened by more than doubles can err. What none can pass is the sum of
the query's components times the largest of the shard's in their dimension, so one large component costs its own queries only.
A component beyond 2 ** 62, or a result that is no 64-bit integer, is an error (OverflowError), never wrapped.

Vectors that are null, or that hold a null or a non-finite component, take no part, as queries or as candidates; neither do
null ids, and neither do vectors whose length differs from the queries' (their block is scored length by length). Repeated rows of an id are candidates
of their own, and ask once; a query's own id is never its result. No queries or no candidates: an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

SHARD_ROWS, QUERY_BLOCK, SCALE, K = 8192, 8192, 1024, 10
BLOCKS = 32
#: Rows scored before the others are probed, and terms probed between two looks at the bounds.
PROBE, STEP = 64, 4


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null where the vector takes no part."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def essential(bounds: np.ndarray, threshold: float) -> np.ndarray:
    """Per term the number of essential blocks. bounds: terms x (blocks + 1), falling; the last column is that of no block left (-inf).

    Blocks are added by the fall of the bound that they bring until the sum of the next blocks' bounds is below the threshold.
    """
    falls = np.minimum.accumulate(bounds[:, :-1] - bounds[:, 1:], axis=1)
    order = np.argsort(-falls, axis=None, kind="stable")
    terms = order // falls.shape[1]
    real = (bounds[:, :-1] - bounds[:, 1:]).ravel()[order]
    after = bounds[:, 0].sum() - np.cumsum(real)
    enough = 0 if bounds[:, 0].sum() < threshold else int(np.argmax(after < threshold)) + 1
    return np.bincount(terms[:enough], minlength=len(bounds))


class Shard:
    """A shard's rows with each term's postings in order of value, cut into blocks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, blocks: int = BLOCKS):
        self.ids, self.vectors = ids, vectors
        self.at = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(vectors, self.at.T, axis=0).T.astype(float)
        self.cuts = np.unique(np.linspace(0, len(ids), min(blocks, len(ids)) + 1).astype(np.int64))
        self.tops, self.bottoms = self.values[:, self.cuts[1:] - 1], self.values[:, self.cuts[:-1]]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Terms x (blocks + 1) bounds for a query, the block of the largest contributions first."""
        rising = q[:, None] * self.tops[:, ::-1]
        out = np.where(q[:, None] >= 0, rising, q[:, None] * self.bottoms)
        return np.concatenate([out, np.full((len(q), 1), -np.inf)], axis=1)

    def traverse(self, q: np.ndarray, depth: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, int]:
        """Each row's bound (-inf: in no essential block) and the number of postings read; rest: the bound of each term's other blocks."""
        n, rows, gains = len(self.ids), [], []
        for d in np.flatnonzero(depth):
            span = slice(n - self._rows(depth[d], False), n) if q[d] >= 0 else slice(0, self._rows(depth[d], True))
            rows.append(self.at[d, span])
            gains.append(q[d] * self.values[d, span] - rest[d])
        if not rows:
            return np.full(n, -np.inf), 0
        rows = np.concatenate(rows)
        seen = np.zeros(n, bool)
        seen[rows] = True
        return np.where(seen, np.bincount(rows, weights=np.concatenate(gains), minlength=n) + rest.sum(), -np.inf), len(rows)

    def _rows(self, blocks: int, from_below: bool) -> int:
        return int(self.cuts[blocks] if from_below else len(self.ids) - self.cuts[len(self.cuts) - 1 - blocks])


def _scorer(vectors: np.ndarray, doubles: np.ndarray, q: np.ndarray, most: float):
    """The exact scores of rows: in the narrowest numbers that can't overflow."""
    if most < 1 << 53:
        short = q.astype(float)
        return lambda rows: doubles[rows] @ short
    if most < 2.0**62:
        return lambda rows: vectors[rows] @ q
    large = q.tolist()
    return lambda rows: np.array([sum(a * b for a, b in zip(large, row, strict=True)) for row in vectors[rows].tolist()], object)


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, read: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best in a shard by MaxScore. read: gets the numbers of postings traversed and values probed."""
    if max(np.abs(vectors.astype(float)).max(initial=0), np.abs(queries.astype(float)).max(initial=0)) >= 2.0**62:
        raise OverflowError("components beyond 2 ** 62")
    mosts = np.abs(queries.astype(float)) @ np.abs(vectors.astype(float)).max(axis=0, initial=0)
    shard = Shard(ids, vectors.astype(float))
    out = []
    for qid, whole, most in zip(query_ids.tolist(), queries, mosts.tolist(), strict=True):
        q, scored = whole.astype(float), _scorer(vectors, shard.vectors, whole, most)
        slack = 0.0 if most < 1 << 53 else most * 2.0**-40
        own = ids == qid
        n = len(ids) - int(own.sum())
        bounds = shard.bounds(q)
        take = min(k, n)
        if not take:
            continue
        # The first threshold: the k-th best of the rows with the largest contributions to the terms of the largest bounds.
        lead = np.argsort(-np.abs(q) * (shard.tops[:, -1] - shard.bottoms[:, 0]), kind="stable")[:8]
        first = np.unique(np.concatenate([shard.at[d, -2 * k :] if q[d] >= 0 else shard.at[d, : 2 * k] for d in lead]))
        first = first[~own[first]]
        scores = scored(first)
        threshold = float(np.partition(scores, len(scores) - take)[len(scores) - take]) if len(scores) >= take else -np.inf
        if n <= k:
            hopeful, ceiling, postings = np.flatnonzero(~own), None, 0
        else:
            depth = essential(bounds, threshold - slack)
            rest = np.where(depth < bounds.shape[1] - 1, bounds[np.arange(len(q)), depth], np.where(q >= 0, q * shard.bottoms[:, 0], q * shard.tops[:, -1]))
            ceiling, postings = shard.traverse(q, depth, rest)
            ceiling[own] = -np.inf
            ceiling[first] = -np.inf  # scored already
            hopeful = np.flatnonzero(ceiling >= threshold - slack)
            hopeful = hopeful[np.argsort(-ceiling[hopeful], kind="stable")]
        found, values, probed = [first], [scores], 0
        if ceiling is None:
            found, values = [hopeful], [scored(hopeful)]
        else:
            # The best looking rows are scored first, so that the threshold rises; then the others are probed term by term.
            found.append(hopeful[:PROBE])
            values.append(scored(hopeful[:PROBE]))
            best = np.concatenate(values)
            if len(best) >= take:
                threshold = max(threshold, float(np.partition(best, len(best) - take)[len(best) - take]))
            rows = hopeful[PROBE:]
            high = ceiling[rows]
            terms = np.argsort(np.where(q >= 0, q * shard.bottoms[:, 0], q * shard.tops[:, -1]) - rest, kind="stable")
            for at in range(0, len(q), STEP):
                hold = high >= threshold - slack
                rows, high = rows[hold], high[hold]
                if not len(rows):
                    break
                step = terms[at : at + STEP]
                # Rows of an essential block contribute their block's rest at least, and that is counted already.
                high = high + np.minimum(q[step] * shard.vectors[np.ix_(rows, step)] - rest[step], 0).sum(axis=1)
                probed += len(rows) * len(step)
            rows = rows[high >= threshold - slack]
            found.append(rows)
            values.append(scored(rows))
        rows, scores = np.concatenate(found), np.concatenate(values)
        best = np.lexsort((ids[rows], -scores))[:k] if scores.dtype != object else sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
        out += [(qid, int(ids[rows[i]]), int(scores[i])) for i in best]
        if any(not -(1 << 63) <= x < 1 << 63 for *_, x in out[-len(best) :]):
            raise OverflowError("a score passes 64 bits")
        if read is not None:
            read.update(postings=read.get("postings", 0) + postings, probed=read.get("probed", 0) + probed, all=read.get("all", 0) + vectors.size)
    return out


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length but 0: the rows of a list column that have it, and their values as a matrix."""
    sizes = pc.list_value_length(column).to_numpy()
    return {n: (at, pc.list_flatten(column.take(pa.array(at))).to_numpy().reshape(-1, n)) for n in np.unique(sizes[sizes > 0]).tolist() for at in [np.flatnonzero(sizes == n)]}


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, <key>, score) of each query's k best among vectors; queries: rows of the same two columns."""
    numbers = lambda df: df.select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("v")).filter("id is not null and v is not null")
    numbered = lambda df: materialize(df.withColumn("row", F.monotonically_increasing_id()))
    candidates, asked = numbered(numbers(vectors)), numbered(numbers(queries).distinct())
    shards, blocks = max(1, -(-candidates.count() // SHARD_ROWS)), max(1, -(-asked.count() // QUERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    dealt = candidates.select("id", "v", deal(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # Every shard needs each query once; a block of queries is copied to the shards.
    copies = asked.select("id", "v", deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def run(left, right):
        found = []
        ours, theirs = _by_length(left.column("v")), _by_length(right.column("v"))
        for n in ours.keys() & theirs.keys():
            (at, v), (asking, q) = ours[n], theirs[n]
            ids = left.column("id").to_numpy()[at]
            order = np.argsort(ids, kind="stable")
            found += search_shard(ids[order], v[order], right.column("id").to_numpy()[asking], q, k)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.int64())})

    best = dealt.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def op3_maxscore(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, unnest(v) AS a, unnest(range(len(v))) AS d FROM e WHERE vec_id % 100 = 0),
c AS (SELECT vec_id, unnest(v) AS b, unnest(range(len(v))) AS d FROM e),
s AS (SELECT query_id, vec_id, sum(a * b)::BIGINT AS score FROM q JOIN c USING (d) WHERE vec_id <> query_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
