"""Behaviour clusters and distance to them."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserlog.functions.scores import clamp, label
from tesserlog.operators.patterns import persisted
from tesserlog.operators.quantiles import quantiles


#: Rows of a partition that clusters are fitted on.
ROWS = 250_000


def feature_vectors(matrix: DataFrame, events: list[str]) -> DataFrame:
    """block_id, features: counts scaled to unit deviation, not centred."""
    raw = VectorAssembler(inputCols=events, outputCol="raw", handleInvalid="keep").transform(matrix).select("block_id", "raw")
    return StandardScaler(inputCol="raw", outputCol="features", withStd=True, withMean=False).fit(raw).transform(raw).select("block_id", "features")


def assign_clusters(vectors: DataFrame, k: int = 8, iterations: int = 20, seed: int = 42) -> tuple[DataFrame, list[list[float]], float]:
    """(block_id, features, cluster_id), centres, cost. Rows are first put into a fixed layout, on which the result depends."""
    # so many partitions as the rows need, by a hash of the block: the same for the same table
    parts = max(1, -(-vectors.count() // ROWS))
    fixed = vectors.repartition(parts, "block_id").sortWithinPartitions("block_id")
    with persisted(fixed) as f:
        model = BisectingKMeans(k=k, maxIter=iterations, seed=seed, distanceMeasure="euclidean", predictionCol="cluster_id").fit(f)
    return model.transform(fixed), [[float(x) for x in c] for c in model.clusterCenters()], float(model.summary.trainingCost)


def own_distance(assigned: DataFrame, centres: list[list[float]]) -> DataFrame:
    """block_id, cluster_id, centroid_distance to the own centre; the centres are k literals."""
    table = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    apart = F.zip_with(vector_to_array("features"), F.element_at(table, F.col("cluster_id") + 1), lambda a, b: (a - b) * (a - b))
    return assigned.select("block_id", "cluster_id", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)).alias("centroid_distance"))


def outlier_scores(distances: DataFrame) -> DataFrame:
    """Adds cluster_outlier_score: least distance 0, 95th percentile and more 1."""
    ends = quantiles(distances, "centroid_distance", [0.0, 0.95])
    lo, hi = ends or (0.0, 0.0)
    score = clamp((F.col("centroid_distance") - lo) / (hi - lo)) if hi > lo else F.lit(0.0)
    return distances.withColumn("cluster_outlier_score", score)


def cluster_summary(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cluster: blocks, anomalous blocks and their share, mean distance, mean and largest score."""
    anomalous = F.sum(F.when(label(F.col("label")) == "ANOMALY", 1).otherwise(0))
    return scores.join(labels, "block_id", "left").groupBy("cluster_id").agg(
        F.count("*").alias("total_blocks"), anomalous.alias("anomaly_blocks"), F.avg("centroid_distance").alias("mean_centroid_dist"),
        F.avg("cluster_outlier_score").alias("mean_outlier_score"), F.max("cluster_outlier_score").alias("max_outlier_score"),
        (anomalous / F.count("*")).alias("anomaly_ratio"),
    )


def cluster_distribution(scores: DataFrame) -> DataFrame:
    """cluster_id, blocks, share; one row per cluster reaches the window."""
    counts = scores.groupBy("cluster_id").agg(F.count("*").alias("blocks"))
    return counts.select("cluster_id", "blocks", (F.col("blocks") / F.sum("blocks").over(Window.partitionBy())).alias("share"))
