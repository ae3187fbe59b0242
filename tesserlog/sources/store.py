"""Keyed tables with latest-wins writes, retries, and a dead-letter queue, as Parquet and JSON."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserlog.functions.scores import render_sequence
from tesserlog.sources.files import Files
from tesserlog.sources.readers import exists

#: Key and columns of every table.
TABLES = {
    "logs": ("line_no", "line_no long, log_date string, log_time string, pid string, level string, component string, content string, block_id string, event_id string, is_high_risk boolean, ingested_at string, processed_at string"),
    "anomalies": ("block_id", "block_id string, if_score double, is_anomaly int, threshold double, threshold_method string, source string, confirmed boolean, fp_rarity_score double, seq_deviation_score double, cluster_outlier_score double, detected_at string"),
    "metrics": ("run_id", "run_id string, recorded_at string, precision double, recall double, f1 double, mcc double, auc_roc double, auc_pr double"),
    "patterns": ("pattern_id", "pattern_id string, pattern_type string, pattern string, freq long, support double"),
    "clusters": ("cluster_id", "cluster_id int, total_blocks long, anomaly_blocks long, mean_centroid_dist double, mean_outlier_score double, max_outlier_score double, anomaly_ratio double"),
}


class KeyedStore:
    """Tables below ``root``. A write appends a generation; reading keeps each key's latest row."""

    def __init__(self, spark: SparkSession, root: str, retries: int = 3, backoff: float = 2.0):
        self.spark, self.root, self.retries, self.backoff = spark, root.rstrip("/"), retries, backoff

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def bootstrap(self) -> None:
        """Create missing tables, empty."""
        for table, (_, schema) in TABLES.items():
            if not exists(self.spark, self.path(table)):
                self.spark.createDataFrame([], f"{schema}, __generation long").write.mode("ignore").parquet(self.path(table))

    def _shaped(self, df: DataFrame, table: str) -> DataFrame:
        """Known columns in their types; missing ones null, NaN null."""
        schema = self.spark.createDataFrame([], TABLES[table][1]).schema
        columns = []
        for f in schema:
            c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
            columns.append((F.nanvl(c, F.lit(None).cast("double")) if f.dataType.typeName() == "double" else c).alias(f.name))
        return df.select(*columns)

    def write(self, df: DataFrame, table: str, sink: Callable[[DataFrame, str], None] | None = None) -> bool:
        """Append with retries; after the last failure the documents go to the dead letters."""
        rows = self._shaped(df, table).withColumn("__generation", F.lit(time.time_ns()))
        put = sink or (lambda d, p: d.write.mode("append").parquet(p))
        for attempt in range(self.retries):
            try:
                put(rows, self.path(table))
                return True
            except Exception:  # any failure of the sink is retried and then kept as dead letters
                if attempt + 1 < self.retries:
                    time.sleep(self.backoff * 2**attempt)
        self.dead_letter(rows, table)
        return False

    def dead_letter(self, rows: DataFrame, table: str) -> None:
        doc = F.to_json(F.struct(*[c for c in rows.columns if c != "__generation"]))
        rows.select(F.lit(table).alias("index"), F.lit(datetime.now(timezone.utc).isoformat()).alias("failed_at"), doc.alias("doc")).write.mode("append").json(self.path("dead_letters"))

    def replay(self) -> dict[str, bool]:
        """Write dead letters again, by table; the queue goes when all have succeeded."""
        path = self.path("dead_letters")
        if not exists(self.spark, path):
            return {}
        letters = self.spark.read.schema("index string, failed_at string, doc string").json(path)
        done = {}
        for r in letters.select("index").distinct().collect():
            schema = TABLES[r["index"]][1]
            docs = letters.where(F.col("index") == r["index"]).select(F.from_json("doc", schema).alias("d")).select("d.*")
            rows = self._shaped(docs, r["index"]).withColumn("__generation", F.lit(time.time_ns()))
            rows.write.mode("append").parquet(self.path(r["index"]))
            done[r["index"]] = True
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return done

    def read(self, table: str) -> DataFrame:
        key, schema = TABLES[table]
        rows = self.spark.read.schema(f"{schema}, __generation long").parquet(self.path(table))
        values = [c for c in rows.columns if c != key]
        # rows of one write are of one generation: the greatest of them, so that every reading finds the same
        latest = rows.groupBy(key).agg(F.max(F.struct("__generation", *[c for c in values if c != "__generation"])).alias("r"))
        return latest.select(key, *[F.col("r")[c].alias(c) for c in values if c != "__generation"])

    def compact(self, table: str) -> None:
        """Keep only each key's latest row. Not for use beside writers; a crash leaves the old or the new rows at ``<table>.next``."""
        files, path = Files(self.spark), self.path(table)
        self.read(table).withColumn("__generation", F.lit(time.time_ns())).write.mode("overwrite").parquet(f"{path}.next")
        files.delete(path)
        files.rename(f"{path}.next", path)

    def health(self) -> DataFrame:
        """table, documents (-1: no table), bytes."""
        files = Files(self.spark)
        found = [(t, self.read(t).count() if files.exists(self.path(t)) else -1, files.size(self.path(t))) for t in TABLES]
        return self.spark.createDataFrame(found, "table string, documents long, bytes long")

    # documents of each table

    def write_logs(self, df: DataFrame) -> bool:
        return self.write(df, "logs")

    def write_scores(self, df: DataFrame, source: str = "batch_layer", only_anomalies: bool = False) -> bool:
        rows = df.where("is_anomaly = 1") if only_anomalies else df
        extra = {"source": F.lit(source), "confirmed": F.lit(source == "batch_layer"), "detected_at": F.current_timestamp().cast("string")}
        return self.write(rows.withColumns(extra), "anomalies")

    def write_metrics(self, df: DataFrame) -> bool:
        """One row of metrics; those inside a struct ``core_metrics`` count as columns."""
        if "core_metrics" in df.columns:
            df = df.select("core_metrics.*", *[c for c in df.columns if c != "core_metrics"])
        now = F.current_timestamp()
        return self.write(df.withColumns({"run_id": F.date_format(now, "yyyyMMdd_HHmmss"), "recorded_at": now.cast("string")}), "metrics")

    def write_patterns(self, df: DataFrame, kind: str, total: int) -> bool:
        return self.write(pattern_documents(df, kind, total), "patterns")

    def write_clusters(self, df: DataFrame) -> bool:
        return self.write(df.na.fill(0), "clusters")


def pattern_documents(df: DataFrame, kind: str, total: int) -> DataFrame:
    """pattern_id, pattern_type, pattern, freq, support of itemsets (items, freq) or sequences (sequence, freq)."""
    support = F.round(F.col("freq") / total, 6)
    if kind == "itemset":
        text = F.array_join(F.array_sort("items"), "|")
        return df.select(F.concat(F.lit("fp_"), text).alias("pattern_id"), F.lit(kind).alias("pattern_type"), text.alias("pattern"), "freq", support.alias("support"))
    text = render_sequence(F.col("sequence"))
    place = F.row_number().over(Window.orderBy(F.desc("freq"), text)) - 1  # patterns are few by their support
    return df.select(F.concat(F.lit("seq_"), place.cast("string"), F.lit("_"), F.substring(text, 1, 50)).alias("pattern_id"), F.lit(kind).alias("pattern_type"), text.alias("pattern"), "freq", support.alias("support"))
