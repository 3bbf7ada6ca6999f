"""Queries of prototype banks and of clusters' stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import banks as B
from ..operators.similarity import held_for_calibration, mahalanobis
from ..registry import query
from .inputs import table


def _bank(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, B.bank(v, "label", "vec_id", "embedding", held_for_calibration("vec_id"))


@query("medoid_bank")
def medoid_bank(spark, sf_dir):
    return _bank(spark, sf_dir)[1].select("label", "members", "calibrating", F.size("medoids").alias("n_medoids"), "medoids", "tau_knn", "tau_maha")


@query("medoid_distances")
def medoid_distances(spark, sf_dir):
    """Every vector against its label's bank, and whether both distances are within their thresholds."""
    v, bank = _bank(spark, sf_dir)
    out = v.join(bank, "label").select("vec_id", "label", B.knn_to(F.col("embedding"), F.col("medoids"), 3).alias("knn"), mahalanobis(F.col("embedding"), F.col("centre"), F.col("variance"), 0.0).alias("maha"), "tau_knn", "tau_maha")
    return out.withColumn("accepted", (F.col("knn") <= F.col("tau_knn")) & (F.col("maha") <= F.col("tau_maha")))


@query(
    "coassignment_counts",
    """WITH v AS (SELECT l_returnflag || l_linestatus AS cluster, unnest([0, 1, 2]) AS run, unnest([l_partkey % 7, l_suppkey % 9 - 1, CASE WHEN l_quantity >= 5 THEN l_orderkey % 2 END]) AS label FROM lineitem),
c AS (SELECT cluster, run, label, count(*) AS n FROM v WHERE label IS NOT NULL GROUP BY ALL),
r AS (SELECT cluster, run, sum(n) AS n, sum(CASE WHEN label >= 0 THEN n * (n - 1) // 2 ELSE 0 END) AS together, sum(CASE WHEN label < 0 THEN n ELSE 0 END) AS noise FROM c GROUP BY ALL)
SELECT cluster, count(*) AS runs, sum(n * (n - 1) // 2)::BIGINT AS pair_observations, sum(together)::BIGINT AS coassigned, avg(noise::DOUBLE / n) AS noise_rate, sum(together)::DOUBLE / sum(n * (n - 1) // 2) AS rate FROM r GROUP BY cluster""",
    ("noise_rate", "rate"),
)
def coassignment_counts(spark, sf_dir):
    c = F.col
    labels = F.array(c("l_partkey") % 7, c("l_suppkey") % 9 - 1, F.when(c("l_quantity") >= 5, c("l_orderkey") % 2))
    voted = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("cluster"), F.posexplode(labels).alias("run", "label"))
    return B.coassignment(voted, "cluster", "run", "label")


@query("consensus_stability")
def consensus_stability(spark, sf_dir):
    """How far eight k-means over four fifths of the vectors agree within each label."""
    v = table(spark, sf_dir, "embeddings")
    return B.coassignment(B.votes(v, "vec_id", "embedding", 8).join(v.select("vec_id", F.col("label").alias("cluster")), "vec_id"), "cluster", "run", "label")
