"""Connected components by alternating large-star and small-star steps; links stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Connects each node's larger neighbours (large star) or smaller ones (small star) to the smallest node around it."""
    around = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) if small else _both_ways(links)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = around.join(least, "u")
    if small:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, root): each linked node with the smallest node of its component. Nodes without links are absent."""
    now = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    before = print_of(now)
    while before[0]:
        now = materialize(_star(_star(now, small=False), small=True))
        after = print_of(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
