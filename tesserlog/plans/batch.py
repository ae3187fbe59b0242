"""The hourly batch: new blocks, features, scores, alerts, retraining, run history."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserlog.functions.parse import seconds_of_day
from tesserlog.operators.iforest import Forest, score_forest
from tesserlog.operators.threshold import Threshold, label_anomalies
from tesserlog.operators.traces import block_stats, traces_from_events
from tesserlog.plans.training import load_model, train
from tesserlog.session import Settings
from tesserlog.sources.exports import save
from tesserlog.sources.files import Files
from tesserlog.sources.store import KeyedStore


@dataclass
class Watermark:
    """The last processed time and the number of runs, in a JSON file that one overwriting rename replaces."""

    spark: SparkSession
    path: str

    def load(self) -> tuple[datetime | None, int]:
        files = Files(self.spark)
        if not files.exists(self.path):
            return None, 0
        state = json.loads(files.read(self.path))
        last = state["last_processed_utc"]
        return (datetime.fromisoformat(last) if last else None), state["run_count"]

    def advance(self, to: datetime | None) -> None:
        """Only after success, so that a failed run is read again. Without a time only the run is counted."""
        last, runs = self.load()
        to = to or last
        Files(self.spark).replace(self.path, json.dumps({"last_processed_utc": to.isoformat() if to else None, "run_count": runs + 1}))


def new_rows(logs: DataFrame, since: datetime, column: str = "processed_at", until: datetime | None = None) -> DataFrame:
    """Rows after ``since`` and not after ``until``; typed literals, so that the conditions reach the scan."""
    rows = logs.where(F.col(column) > F.lit(since))
    return rows if until is None else rows.where(F.col(column) <= F.lit(until))


def new_blocks(rows: DataFrame) -> DataFrame:
    return rows.select("block_id").where("block_id is not null").distinct()


def since(watermark: Watermark, now: datetime, hours: int) -> datetime:
    return watermark.load()[0] or now - timedelta(hours=hours)


def score_new(features: DataFrame, blocks: DataFrame, forest: Forest, threshold: Threshold) -> DataFrame:
    """Scores of the new blocks under the stored model, with the threshold they were held against."""
    chosen = features.join(blocks, "block_id", "left_semi")
    return label_anomalies(score_forest(chosen, forest), threshold.threshold, threshold.method)


def confirmed_alerts(scored: DataFrame) -> DataFrame:
    """key, value: one JSON document for each anomaly."""
    body = F.struct("block_id", "if_score", F.lit("BATCH_CONFIRMED").alias("alert_type"), F.current_timestamp().alias("detected_at"))
    return scored.where("is_anomaly = 1").select(F.col("block_id").alias("key"), F.to_json(body).alias("value"))


def retrain_due(runs: int, every: int = 24) -> bool:
    """The first run and every so many after it."""
    return runs % every == 0


def run_metadata(scored: DataFrame) -> DataFrame:
    """new_blocks, anomalies_detected, anomaly_rate of a run."""
    n, a = F.count("*"), F.coalesce(F.sum("is_anomaly"), F.lit(0))
    return scored.agg(n.alias("new_blocks"), a.cast("long").alias("anomalies_detected"), F.coalesce(F.try_divide(a.cast("double"), n.cast("double")), F.lit(0.0)).alias("anomaly_rate"))


def run_batch(spark: SparkSession, logs: DataFrame, features: DataFrame, forest: Forest, threshold: Threshold, watermark: Watermark, out: str, hours: int = 1, now: datetime | None = None, store: KeyedStore | None = None, retrain: Callable[[], object] | None = None, every: int = 24) -> DataFrame:
    """One run: score what is new, write scores, alerts and history, store anomalies, retrain where due, then advance the watermark.

    The window ends with the last ``processed_at`` that the run has seen, and the watermark moves there: rows that land
    later are in a later window, none is in two. Tables of a run lie in a folder named by its window, which a
    repeated run replaces. Returns the run's history row.
    """
    now, began = now or datetime.now(timezone.utc), time.monotonic()
    start, runs = since(watermark, now, hours), watermark.load()[1]
    # as microseconds, so that no time zone of the driver comes in
    last = new_rows(logs, start).agg(F.max(F.unix_micros(F.col("processed_at").cast("timestamp")))).first()[0]
    until = datetime.fromtimestamp(last // 10**6, timezone.utc).replace(microsecond=last % 10**6) if last is not None else None
    run = f"run={start.astimezone(timezone.utc):%Y%m%dT%H%M%S%f}"
    blocks = new_blocks(new_rows(logs, start, until=until))
    scored = save(score_new(features, blocks, forest, threshold), f"{out}/scores/{run}")
    alerts = confirmed_alerts(scored)
    alerts.write.mode("overwrite").json(f"{out}/alerts/{run}")
    found = run_metadata(scored).first()
    stored = store.write_scores(scored, only_anomalies=True) if store is not None and found["anomalies_detected"] else False
    due = retrain is not None and retrain_due(runs, every)
    if due:
        retrain()
    row = (now.isoformat(), time.monotonic() - began, found["new_blocks"], found["anomalies_detected"], found["anomaly_rate"], found["anomalies_detected"] if stored else 0, found["anomalies_detected"], due)
    meta = spark.createDataFrame([row], HISTORY)
    meta.coalesce(1).write.mode("overwrite").json(f"{out}/history/{run}")
    watermark.advance(until)
    return meta


HISTORY = "run_at string, elapsed_secs double, new_blocks long, anomalies_detected long, anomaly_rate double, es_written long, alerts_published long, model_retrained boolean"


def run_batch_job(spark: SparkSession, base: str, settings: Settings | None = None, hours: int = 1, now: datetime | None = None) -> DataFrame:
    """A run over the folders below ``base``: parsed logs, features and model of the training run, store. Trains first where no model is.

    Logs are at ``logs``; training reads all of them and writes to ``model_run``, as do retrainings. A new block has
    features once a training has seen it; until then it is not scored.
    """
    s = settings or Settings.load()
    logs = spark.read.parquet(f"{base}/logs")

    def retrain() -> None:
        """All logs into features, forest and threshold."""
        events = logs.where("block_id is not null and event_id is not null")
        alphabet = sorted(r["event_id"] for r in events.select("event_id").distinct().collect())  # a catalogue of events
        stats = block_stats(events, seconds_of_day(F.col("log_time")))
        train(spark, traces_from_events(events), stats, alphabet, f"{base}/model_run", settings=s)

    fresh = load_model(spark, f"{base}/model_run") is None
    if fresh:
        retrain()
    forest, limit = load_model(spark, f"{base}/model_run")
    store = KeyedStore(spark, f"{base}/store")
    store.bootstrap()
    table = spark.read.parquet(f"{base}/model_run/features")
    mark = Watermark(spark, f"{base}/watermark.json")
    return run_batch(spark, logs, table, forest, limit, mark, f"{base}/batch", hours, now, store, None if fresh else retrain, s.retrain_every)
