"""What the service answers, as DataFrames. A missing input is an error and never an invented number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserlog.functions.scores import severity
from tesserlog.operators.metrics import confusion, rates
from tesserlog.operators.quantiles import quantiles
from tesserlog.plans.batch import HISTORY
from tesserlog.plans.training import load_model
from tesserlog.sources.files import Files


def kpi_stats(scores: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """Totals and anomaly rate, with precision, recall and F1 where labels are there."""
    base = scores.agg(F.count("*").alias("total_blocks"), F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long").alias("anomalies"))
    base = base.withColumn("anomaly_rate", F.round(F.coalesce(F.try_divide(F.col("anomalies") * 100.0, "total_blocks"), F.lit(0.0)), 2))
    if aligned is None:
        return base
    return base.join(rates(confusion(aligned)).select(*[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")]))


def score_histogram(scores: DataFrame, column: str = "if_score", bins: int = 50) -> DataFrame:
    """bin, count over [0, 1], in 10 to 200 bins; the last bin holds 1."""
    bins = min(max(bins, 10), 200)
    at = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    counts = scores.where(F.col(column).between(0, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    return scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


PERCENTILES = (50, 75, 90, 95, 97, 99, 99.9)


def score_percentiles(scores: DataFrame, column: str = "if_score") -> DataFrame:
    """percentile, value: exact, with linear interpolation."""
    found = quantiles(scores, column, [p / 100 for p in PERCENTILES])
    return scores.sparkSession.createDataFrame([(float(p), v) for p, v in zip(PERCENTILES, found or [])], "percentile double, value double")


def anomalies_page(scores: DataFrame, page: int = 1, per_page: int = 20, least: float = 0.0) -> DataFrame:
    per_page = min(max(per_page, 1), 100)
    found = scores.where((F.col("is_anomaly") == 1) & (F.col("if_score") >= least))
    return found.orderBy(F.desc("if_score"), "block_id").offset((page - 1) * per_page).limit(per_page)


def top_patterns(patterns: DataFrame, text: str, n: int = 20) -> DataFrame:
    return patterns.orderBy(F.desc("freq"), text).limit(min(max(n, 1), 100))


def stream_logs(logs: DataFrame, order: str = "line_no", n: int = 50) -> DataFrame:
    """The last rows, with a level made from the risk flag."""
    return logs.orderBy(F.desc(order)).limit(n).withColumn("level", F.when(F.col("is_high_risk"), "ERROR").otherwise("INFO"))


def stream_alerts(scores: DataFrame, n: int = 20) -> DataFrame:
    found = scores.where("is_anomaly = 1").orderBy(F.desc("if_score"), "block_id").limit(min(max(n, 1), 100))
    return found.withColumn("severity", severity(F.col("if_score")))


def model_info(threshold, forest) -> dict:
    return {"trees": len(forest.trees), "samples": forest.samples, "features": forest.columns, "threshold": threshold.threshold, "method": threshold.method, "shape": threshold.shape, "scale": threshold.scale}


def stored_scores(spark: SparkSession, base: str) -> DataFrame:
    """The labelled scores of the training run below ``base``."""
    return spark.read.parquet(f"{base}/model_run/scores")


def stored_model_info(spark: SparkSession, base: str) -> dict:
    found = load_model(spark, f"{base}/model_run")
    if found is None:
        raise FileNotFoundError(f"no model below {base}")
    forest, threshold = found
    return model_info(threshold, forest)


def stored_history(spark: SparkSession, base: str, n: int = 50) -> DataFrame:
    """The last runs of the batch job, the latest first."""
    return spark.read.schema(HISTORY).option("recursiveFileLookup", True).json(f"{base}/batch/history").orderBy(F.desc("run_at")).limit(n)


def service_health(spark: SparkSession, base: str) -> dict[str, str]:
    """What the service stands on: ok or missing."""
    files = Files(spark)
    parts = {"logs": "logs", "scores": "model_run/scores", "model": "model_run/model/threshold.json", "store": "store", "watermark": "watermark.json"}
    return {k: "ok" if files.exists(f"{base}/{p}") else "missing" for k, p in parts.items()}
