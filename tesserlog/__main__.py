"""Command line: python -m tesserlog {produce,stream,batch,store} ..."""

from __future__ import annotations

import argparse

from tesserlog.functions.catalog import compile_catalog, load_catalog, match_event
from tesserlog.plans.batch import run_batch_job
from tesserlog.plans.views import stored_scores
from tesserlog.session import Settings, session
from tesserlog.sources import producer, readers
from tesserlog.sources.store import KeyedStore
from tesserlog.streaming import stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserlog")
    p.add_argument("--base", default=None, help="folder of all tables; TESSERLOG_BASE_PATH by default")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("produce", help="replay a log file as envelopes")
    c.add_argument("file")
    c.add_argument("--rate", type=int, default=1000)
    c.add_argument("--lines", type=int, default=None)
    c.add_argument("--kafka", default=None, metavar="SERVERS")
    c.add_argument("--topic", default="raw-logs")
    c = commands.add_parser("stream", help="parse envelopes as they come")
    c.add_argument("--templates", required=True, help="CSV of event ids and templates")
    c.add_argument("--once", action="store_true", help="all that is there, then stop")
    c = commands.add_parser("batch", help="one run of the batch job")
    c.add_argument("--window-hours", type=int, default=1)
    c = commands.add_parser("store", help="look after the keyed store")
    for flag in ("--bootstrap", "--health", "--replay-dlq", "--write-scores", "--compact"):
        c.add_argument(flag, action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a, s = parser().parse_args(args), Settings.load()
    spark, base = session(), a.base or s.base_path
    if a.command == "produce":
        sink = producer.to_kafka(spark, a.kafka, a.topic) if a.kafka else producer.to_files(spark, f"{base}/incoming")
        with producer.stopped_by_signals() as stop:
            print(producer.replay(producer.local_lines(a.file), sink, a.rate, a.lines, stop), "sent")
    elif a.command == "stream":
        from pyspark.sql import functions as F

        event = match_event(F.col("content"), compile_catalog(load_catalog(readers.scan_csv(spark, a.templates))))
        source = readers.stream_envelopes(spark, "json", f"{base}/incoming")
        stream.supervise(stream.start_all(source, event, s, base, None if a.once else s.trigger_seconds), report=print)
    elif a.command == "batch":
        print(run_batch_job(spark, base, s, a.window_hours).first().asDict())
    else:
        store = KeyedStore(spark, f"{base}/store")
        if a.bootstrap:
            store.bootstrap()
        if a.replay_dlq:
            print(store.replay())
        if a.write_scores:
            print(store.write_scores(stored_scores(spark, base)))
        if a.compact:
            for table in ("logs", "anomalies", "metrics", "patterns", "clusters"):
                store.compact(table)
        if a.health:
            for r in store.health().collect():
                print(r["table"], r["documents"], r["bytes"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
