"""Streams: parse once, write to several sinks; alerts per micro-batch or per event-time window."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserlog.functions.parse import open_envelopes, parse_logs
from tesserlog.operators.traces import prescreen_alerts
from tesserlog.session import Settings
from tesserlog.sources.producer import KAFKA
from tesserlog.sources.store import KeyedStore


def parsed_stream(stream: DataFrame, event: Column, high_risk: tuple[str, ...]) -> DataFrame:
    return parse_logs(open_envelopes(stream), event, high_risk)


def realtime_alerts(batch: DataFrame, threshold: int = 2) -> DataFrame:
    """JSON alert documents of one micro-batch: key, value."""
    alerts = prescreen_alerts(batch, threshold)
    body = F.struct(
        "block_id", "trigger_event", "risk_event_count", "component", F.lit("REALTIME_PRESCREEN").alias("alert_type"),
        F.current_timestamp().alias("detected_at"), F.lit("awaits confirmation by the batch layer").alias("note"),
    )
    return alerts.select(F.col("block_id").alias("key"), F.to_json(body).alias("value"))


def windowed_alerts(stream: DataFrame, threshold: int = 2, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Alerts of event-time windows, with a watermark for late lines."""
    risky = stream.where("is_high_risk").withWatermark("event_ts", late)
    first = lambda c: F.min_by(c, "line_no").alias("trigger_event" if c == "event_id" else c)
    counted = risky.groupBy(F.window("event_ts", width), "block_id").agg(F.count("*").alias("risk_event_count"), first("event_id"), first("component"))
    return counted.where(F.col("risk_event_count") >= threshold)


def start(stream: DataFrame, name: str, checkpoint: str, sink: str | Callable[[DataFrame, int], None], seconds: int | None = 10, partition_by: tuple[str, ...] = ("log_date",), mode: str = "append") -> StreamingQuery:
    """To Parquet below a path, or to a function of (batch, id). Without seconds: all that is there, then stop."""
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    if callable(sink):
        return writer.foreachBatch(sink).start()
    return writer.format("parquet").partitionBy(*partition_by).option("path", sink).start()


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One pass over the source for several sinks; a failing sink fails the batch, which is tried again from the checkpoint."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return each


def to_store(store: KeyedStore, table: str = "logs") -> Callable[[DataFrame, int], None]:
    """A sink that writes a batch to a keyed table; rows that came before replace themselves. A write that only reached the dead letters is not an error."""
    return lambda batch, _: store.write(batch, table) and None


def alerts_to_files(folder: str, threshold: int = 2) -> Callable[[DataFrame, int], None]:
    """A sink for alert documents, in a folder for each batch, which a repeated batch replaces."""
    return lambda batch, n: realtime_alerts(batch, threshold).write.mode("overwrite").json(f"{folder}/batch={n}")


def alerts_to_kafka(servers: str, topic: str, threshold: int = 2) -> Callable[[DataFrame, int], None]:
    """A sink for alert documents, through Spark's connector, where it is there."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, **KAFKA}
    return lambda batch, _: realtime_alerts(batch, threshold).write.format("kafka").options(**options).save()


def start_all(stream: DataFrame, event: Column, settings: Settings, base: str, seconds: int | None = None, alerts: Callable[[DataFrame, int], None] | None = None) -> list[StreamingQuery]:
    """Parsed logs to Parquet by day; to the store and alerts, from one pass. Each query has its own checkpoint below ``base``."""
    parsed = parsed_stream(stream, event, settings.high_risk)
    store = KeyedStore(stream.sparkSession, f"{base}/store")
    store.bootstrap()
    both = fan_out(to_store(store), alerts or alerts_to_files(f"{base}/alerts", settings.alert_threshold))
    return [
        start(parsed, "logs", f"{base}/checkpoints/logs", f"{base}/logs", seconds),
        start(parsed, "store_and_alerts", f"{base}/checkpoints/store", both, seconds),
    ]


def supervise(queries: list[StreamingQuery], poll: float = 30.0, rounds: int | None = None, report: Callable[[dict[str, float]], None] | None = None) -> None:
    """Wait; when one query dies stop all and raise its error. ``report`` gets rows a second by query after every poll."""
    done = 0
    try:
        while rounds is None or done < rounds:
            for q in queries:
                if not q.isActive and q.exception() is not None:
                    raise q.exception()
            active = [q for q in queries if q.isActive]
            if not active:
                return
            end = time.monotonic() + poll
            while time.monotonic() < end and all(q.isActive for q in active):
                time.sleep(min(0.1, poll))
            if report is not None:
                report({q.name: float((q.lastProgress or {}).get("inputRowsPerSecond") or 0) for q in active})
            done += 1
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
