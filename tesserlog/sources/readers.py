"""Readers: text lines, CSV and Parquet tables, JSON documents, and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserlog.functions.parse import ENVELOPE


def scan_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """value, line_no from 1: files by name, lines by their place in the file. Numbers come from counts of whole splits and not from one task."""
    split = ["__file", "__begin"]
    lines = spark.read.option("encoding", encoding).text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__begin"), F.monotonically_increasing_id().alias("__at")
    )
    counts = lines.groupBy(*split).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    # one row for each split of a file
    before = F.coalesce(F.sum("n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(counts.select(*split, "__first", before.alias("__before")), split)
    return placed.select("value", (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("line_no"))


def scan_csv(spark: SparkSession, path: str, schema: str | None = None, infer: bool = False) -> DataFrame:
    """A CSV table with a header; strings unless a schema or inference is asked for."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", infer).csv(path)


def scan_traces(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, events) of a trace table with columns like BlockId and Features."""
    from tesserlog.operators.traces import named_like, parse_trace

    table = scan_csv(spark, path)
    return table.select(F.col(named_like(table, "blockid", "block")).alias("block_id"), parse_trace(F.col(named_like(table, "features", "feature"))).alias("events"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, computed and written first where there is none. Other errors show."""
    if not exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stream_envelopes(spark: SparkSession, kind: str, path_or_servers: str, topic: str | None = None, offsets: str = "latest", most: int = 50_000) -> DataFrame:
    """A stream of envelopes with column value: from files of JSON lines, or from Kafka where its connector is there."""
    if kind == "kafka":
        options = {"kafka.bootstrap.servers": path_or_servers, "subscribe": topic, "startingOffsets": offsets, "maxOffsetsPerTrigger": str(most), "failOnDataLoss": "false"}
        return spark.readStream.format("kafka").options(**options).load()
    if kind == "json":
        return spark.readStream.schema(ENVELOPE).json(path_or_servers).select(F.to_json(F.struct(*ENVELOPE.fieldNames())).alias("value"))
    return spark.readStream.option("maxFilesPerTrigger", 1).text(path_or_servers)
