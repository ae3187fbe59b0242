"""Feature matrix: occurrence counts with mining scores and block statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a block without a score gets.
FILL = {"fp_rarity_score": 0.5, "seq_deviation_score": 0.5, "cluster_outlier_score": 0.5, "cluster_id": -1.0, "log_count": 0.0, "unique_events": 0.0, "time_span": 0.0}


def assemble(occurrence: DataFrame, fp: DataFrame | None = None, seq: DataFrame | None = None, cluster: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Left joins on block_id from the occurrence features; one hash partitioning serves them all. Missing scores are filled."""
    out = occurrence
    for part, columns in ((fp, ["fp_rarity_score"]), (seq, ["seq_deviation_score"]), (cluster, ["cluster_outlier_score", "cluster_id"]), (stats, ["log_count", "unique_events", "time_span"])):
        if part is not None:
            out = out.join(part.select("block_id", *[F.col(c).cast("double").alias(c) for c in columns]), "block_id", "left")
    named = [c for c in FILL if c in out.columns]
    rest = [c for c in occurrence.columns if c != "block_id"]
    return out.select("block_id", *[F.coalesce(c, F.lit(FILL[c])).alias(c) for c in named], *rest)


def deviations(features: DataFrame) -> DataFrame:
    """(feature, deviation) of every numeric column, in one aggregate."""
    columns = [c for c in features.columns if c != "block_id"]
    row = features.agg(*[F.stddev_samp(c).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(c, F.lit(0.0)).alias("deviation")) for c in columns])).alias("x")).select("x.*")


def drop_constant(features: DataFrame) -> DataFrame:
    gone = [r["feature"] for r in deviations(features).where("deviation = 0").collect()]
    return features.drop(*gone)
