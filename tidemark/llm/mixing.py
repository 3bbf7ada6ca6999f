"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed place on a 60-bit hash line. Per source, the tokens are summed by hash bucket (4096 buckets a
level); the bucket in which the budget ends is split again, three levels deep, and documents below the resulting threshold
are taken. No document is sorted, and budgets nest: a smaller budget takes a subset of what a larger one takes.
A document's place follows from its id, its text and, where rows repeat both, the number of the repetition, so that copies stand
apart; which of them has which number makes no difference.

Null text or no words: size 0, takes nothing. Null source: a source of its own, last in order. Repeated rows have
places of their own and are taken or left one by one; so have rows without an id. An empty table gives an empty result. Other columns pass through
`mix` untouched; the operator's own columns start with `mix_`, and columns of the input with such names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

DIGIT_BITS, LEVELS, HASH_BITS = 12, 3, 60
#: Up to this many sources their table (a few numbers each) is broadcast; beyond it joins shuffle.
BROADCAST_SOURCES = 50_000
CYCLE = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[ \t-\r]+"), "")), F.lit(0)).cast("long")


def hash_place(key: Column) -> Column:
    """60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def places(docs: DataFrame, ident: str = "mix_id", source: str = "mix_source", place: str = "mix_place") -> DataFrame:
    """docs (a written table) with a place from ident (the hash of id and text) and the number of the row among those that share it and their source.

    Rows that share neither keep ident. The others are numbered within their partition, from the sum of the partitions before it, so that
    copies that are a third of all rows still number in parallel.
    """
    same = [ident, source]
    each = docs.withColumn("_part", F.spark_partition_id())
    by_part = materialize(each.groupBy(*same, "_part").agg(F.count("*").alias("_n")))
    many = by_part.groupBy(*same).agg(F.sum("_n").alias("_all")).filter("_all > 1").select(F.col(ident).alias("_id"), F.col(source).alias("_src"))
    shared = by_part.join(many, (F.col(ident) == F.col("_id")) & F.col(source).eqNullSafe(F.col("_src"))).drop("_id", "_src")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(shared.select(F.col(ident).alias("_id"), F.col(source).alias("_src"), F.col("_part").alias("_p"), before.alias("_start")))
    if starts.isEmpty():
        return docs.withColumnRenamed(ident, place)
    is_shared = (F.col(ident) == F.col("_id")) & F.col(source).eqNullSafe(F.col("_src")) & (F.col("_part") == F.col("_p"))
    here = F.row_number().over(Window.partitionBy(*same, "_part").orderBy(F.lit(0))) - 1
    number = F.col("_start") + here
    again = hash_place(F.concat(F.col(ident).cast("string"), F.lit(":"), number.cast("string")))
    numbered = each.join(starts, is_shared).withColumn(place, F.when(number > 0, again).otherwise(F.col(ident)))
    alone = each.join(starts, is_shared, "left_anti").withColumnRenamed(ident, place)
    return materialize(numbered.select(*[c if c != ident else place for c in docs.columns]).unionByName(alone.drop("_part")))


def targets(sizes: DataFrame, share: float = 1.0, most: float = 3.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(mix_source, mix_source_size) -> also mix_target: water-filling of share of all tokens by weight, at most `most` times each size.

    One row per source; sources are ranked by code point, null last, and weigh `cycle`, repeating.
    The sources that stop at their cap are those with the smallest cap per weight, a prefix of that order.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("_rank") % len(cycle) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", most * F.col("mix_source_size"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_rank")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    ranked = ranked.withColumn(
        "_level",
        (share * F.sum("mix_source_size").over(everything) - F.coalesce(F.sum("_cap").over(order), zero)) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(order), zero)),
    )
    fits = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_rank").alias("k"), F.col("_level").alias("level")))).over(everything)
    return ranked.withColumn("mix_target", F.least(F.col("_cap"), F.coalesce(fits["level"], F.lit(float("inf"))) * F.col("_w"))).select("mix_source", "mix_source_size", "mix_target")


def _beside(df: DataFrame, small: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Join on the source, nulls equal."""
    small = small.withColumnRenamed("mix_source", "_source")
    return df.join(F.broadcast(small) if n <= BROADCAST_SOURCES else small, F.col("mix_source").eqNullSafe(F.col("_source")), how).drop("_source")


def thresholds(places: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """(mix_source, mix_budget) -> mix_below: documents whose place is below it take the budget, as nearly as the last bucket allows."""
    edge = sources.select("mix_source", F.col("mix_budget").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(1, LEVELS + 1):
        low = HASH_BITS - DIGIT_BITS * level
        inside = _beside(places.select("mix_source", "mix_size", "mix_place"), edge, n_sources)
        if level > 1:
            inside = inside.filter(F.shiftright("mix_place", low + DIGIT_BITS) == F.col("_prefix"))
        sums = inside.groupBy("mix_source", F.shiftright("mix_place", low).alias("_bucket")).agg(F.sum("mix_size").alias("_sum"), F.first("_left").alias("_left"))
        through = F.sum("_sum").over(Window.partitionBy("mix_source").orderBy("_bucket"))
        sums = sums.filter("_sum > 0").withColumn("_through", through)
        ends = F.min(F.when(F.col("_through") > F.col("_left"), F.struct("_bucket", "_sum", "_through"))).alias("_at")
        at = sums.groupBy("mix_source").agg(ends, F.first("_left").alias("_left"))
        before = F.col("_at._through") - F.col("_at._sum")
        edge = materialize(at.select("mix_source", (F.col("_left") - before).alias("_left"), F.col("_at._bucket").alias("_prefix"), F.col("_at._sum").alias("_sum")))
    nearer = (F.col("_sum") - F.col("_left")) < F.col("_left")
    return edge.select("mix_source", F.shiftleft(F.col("_prefix") + F.when(nearer, 1).otherwise(0), HASH_BITS - DIGIT_BITS * LEVELS).alias("mix_below"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, most: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """Per document: mix_size, mix_source_size, mix_target, mix_copies (how often the mix takes it).

    `keep`: the columns to carry along (default: key alone; the rest can be joined or counted from mix_copies).
    """
    kept = [c for c in (keep or [key]) if not c.startswith("mix_")]
    named = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    placed = places(materialize(docs.select(*kept, F.col(source).alias("mix_source"), word_count(F.col(text)).alias("mix_size"), hash_place(named).alias("mix_id"))))
    sizes = placed.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"))
    whole = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(0).cast("long")
    sources = targets(sizes, share, most).withColumn("mix_whole", whole)
    sources = materialize(sources.withColumn("mix_budget", F.col("mix_target") - F.col("mix_whole") * F.col("mix_source_size")))
    n = sources.count()
    cut = _beside(sources, thresholds(placed, sources, n), n, "left").drop("mix_budget")
    taken = _beside(placed, cut, n, "left")
    extra = F.when(F.col("mix_place") < F.col("mix_below"), 1).otherwise(0)
    return taken.withColumn("mix_copies", (F.col("mix_whole") + extra).cast("long")).drop("mix_whole", "mix_below", "mix_place")


def op4_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP4_SQL = r"""
WITH i AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS id
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY id, source) - 1 AS copy FROM i),
d AS (SELECT doc_id, source, size, CASE WHEN copy = 0 THEN id ELSE ('0x' || substr(md5(id::VARCHAR || ':' || copy::VARCHAR), 1, 15))::BIGINT END AS place FROM n),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, (k % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (1.0::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
v AS (SELECT *, (SELECT arg_min(level, (cap / w, k)) FROM l WHERE level * w <= cap) AS final FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(final, 'inf'::DOUBLE) * w) AS target,
        CASE WHEN source_size > 0 THEN floor(least(cap, coalesce(final, 'inf'::DOUBLE) * w) / source_size)::BIGINT ELSE 0 END AS whole FROM v),
b AS (SELECT source, place >> 24 AS bucket, sum(size) AS n FROM d GROUP BY ALL HAVING sum(size) > 0),
c AS (SELECT b.source, bucket, n, sum(n) OVER (PARTITION BY b.source ORDER BY bucket) AS through, target - whole * source_size AS budget
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
e AS (SELECT source, min(bucket + CASE WHEN through - budget < budget - (through - n) THEN 1 ELSE 0 END) AS below FROM c WHERE through > budget GROUP BY source)
SELECT d.doc_id, d.size, t.source_size, t.target,
       d.size * (t.whole + CASE WHEN (d.place >> 24) < e.below THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
