"""Registered queries that go through readers, sinks, streams, the store, saved models and the batch job, and their SQL.

Each writes to the scratch folder and returns what is read back there, so that SQL over the driver's tables checks both ways.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserlog.functions import catalog as cat
from tesserlog.functions import parse
from tesserlog.operators import clusters, features, iforest, metrics, threshold, traces
from tesserlog.plans import batch, training, views
from tesserlog.plans import catalogue as c
from tesserlog.plans.catalogue import query
from tesserlog.session import Settings
from tesserlog.sources import exports, readers
from tesserlog.sources.scratch import scratch_path
from tesserlog.sources.store import KeyedStore
from tesserlog.streaming import stream


def _csv(df: DataFrame, tag: str) -> str:
    path = scratch_path(df.sparkSession, tag)
    df.write.option("header", True).csv(path)
    return path


# readers


@query(f"with {c.TR} select block_id, array_to_string(events, ',') as events from tr")
def csv_traces(spark: SparkSession, d: str) -> DataFrame:
    written_as = F.concat(F.lit("["), F.array_join("events", ", "), F.lit("]"))
    path = _csv(c._traces(spark, d).select(F.col("block_id").alias("BlockId"), written_as.alias("Features")), "csv-traces")
    return readers.scan_traces(spark, path).select("block_id", F.array_join("events", ",").alias("events"))


_CODED = {a: f"E{i}" for i, a in enumerate(c.ALPHABET, 1)}


@query(f"with {c.EV} select block_id, " + ", ".join(f"count(*) filter (where event = '{a}')::int as {e}" for a, e in _CODED.items()) + " from ev group by 1")
def csv_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Counts of 0 are empty cells in the file."""
    cells = [F.when(F.col(a) > 0, F.col(a)).alias(e) for a, e in _CODED.items()]
    path = _csv(c.occurrence_matrix(spark, d).select(F.col("block_id").alias("BlockId"), *cells), "csv-matrix")
    return traces.read_matrix(readers.scan_csv(spark, path, infer=True))[0]


@query(f"with {c.LABELS} select block_id, label from labs")
def csv_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = c._labels(spark, d).select(F.col("block_id").alias("BlockId"), F.col("label").alias("Label"))
    return metrics.clean_labels(readers.scan_csv(spark, _csv(rows, "csv-labels")))


@query("with t as (select event_type as template, count(*) as size from events group by 1) select 'D' || row_number() over (order by size desc, template) as event_id, template from t")
def csv_learned_templates(spark: SparkSession, d: str) -> DataFrame:
    found = c._events(spark, d).groupBy(F.col("event").alias("template")).agg(F.count("*").alias("size"))
    table = readers.scan_csv(spark, _csv(found, "csv-templates"), "template string, size int")
    return spark.createDataFrame(cat.learned_catalog(table), "event_id string, template string")


@query(c.ORACLE_SQL["fp_rarity"])
def read_or_computed(spark: SparkSession, d: str) -> DataFrame:
    """Computed where nothing is, read where something is."""
    path = scratch_path(spark, "scores")
    readers.read_or_compute(spark, path, lambda: c.fp_rarity(spark, d))

    def again() -> DataFrame:
        raise RuntimeError("computed twice")

    return readers.read_or_compute(spark, path, again)


@query(f"with {c.LINES} select row_number() over (order by line_no) as line_no, raw as value from lines")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines in several files, which follow one another by name."""
    path = scratch_path(spark, "lines")
    c._lines(spark, d).orderBy("line_no").select("raw").write.text(path)
    return readers.scan_lines(spark, path)


# streams


def _stream(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(spark, "envelopes")
    parse.make_envelopes(c._lines(spark, d), text="raw").select("value").write.text(folder)
    return readers.stream_envelopes(spark, "json", folder)


def _event():
    return cat.match_event(F.col("content"), cat.compile_catalog(c.TEMPLATES))


_LOG = ["line_no", "log_date", "level", "component", "block_id", "event_id", "is_high_risk"]
_LOG_SQL = f"with {c.LOGS} select line_no, log_date, level, component, block_id, event_id, event_id in ('T5', 'T3') as is_high_risk from logs"


@query(_LOG_SQL)
def streamed_logs(spark: SparkSession, d: str) -> DataFrame:
    """A stream of envelopes, parsed, into Parquet by day."""
    parsed, at = stream.parsed_stream(_stream(spark, d), _event(), c.RISKY), scratch_path(spark, "stream")
    stream.start(parsed, at.rsplit("/", 1)[1], f"{at}/checkpoint", f"{at}/logs", None).awaitTermination()
    return spark.read.schema(parsed.schema).parquet(f"{at}/logs").select(*_LOG)


def _both_sinks(spark: SparkSession, d: str) -> str:
    """The folder of a run of all stream sinks over what is there."""
    at = scratch_path(spark, "stream")
    for q in stream.start_all(_stream(spark, d), _event(), Settings(high_risk=c.RISKY), at):
        q.awaitTermination()
    return at


@query(_LOG_SQL)
def streamed_store(spark: SparkSession, d: str) -> DataFrame:
    return KeyedStore(spark, f"{_both_sinks(spark, d)}/store").read("logs").select(*_LOG)


@query(f"{c.ORACLE_SQL['prescreen_alerts'].replace('select block_id,', 'select block_id, ' + repr('REALTIME_PRESCREEN') + ' as alert_type,')}")
def streamed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The alert documents of one batch, read back from their files."""
    schema = "value string"
    body = "block_id string, trigger_event string, risk_event_count long, component string, alert_type string"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{_both_sinks(spark, d)}/alerts")
    return rows.select(F.from_json("value", body).alias("v")).select("v.*")


@query(f"""with {c.LOGS}, risky as (select date_trunc('day', strptime(log_date || log_time, '%y%m%d%H%M%S')) as day, * from logs where event_id in ('T5', 'T3'))
select strftime(day, '%Y-%m-%d') as day, block_id, count(*) as risk_event_count, arg_min(event_id, line_no) as trigger_event, arg_min(component, line_no) as component from risky group by 1, 2 having count(*) >= 2""")
def windowed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of event-time windows of a day; over a table, which a watermark leaves whole."""
    found = stream.windowed_alerts(c._logs(spark, d), 2, "1 day")
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "block_id", "risk_event_count", "trigger_event", "component")


# store and exports


def _store(spark: SparkSession) -> KeyedStore:
    store = KeyedStore(spark, scratch_path(spark, "store"), retries=2, backoff=0.0)
    store.bootstrap()
    return store


_STORED = f"with {c.SCORED} select block_id, round(s, 6) as if_score, p as is_anomaly, 'fixed' as threshold_method, 'batch_layer' as source, true as confirmed from al where p = 1"


def _stored(store: KeyedStore) -> DataFrame:
    return c._rounded(store.read("anomalies").select("block_id", "if_score", "is_anomaly", "threshold_method", "source", "confirmed"), "if_score")


@query(_STORED)
def stored_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Written twice, first with other scores: the later write counts."""
    store, scored = _store(spark), c._scored(spark, d)
    store.write_scores(scored.withColumn("if_score", F.col("if_score") / 2), only_anomalies=True)
    store.write_scores(scored, only_anomalies=True)
    return _stored(store)


@query(_STORED)
def replayed_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """A sink that fails every time: the rows become dead letters, which are written in the end."""
    store = _store(spark)

    def broken(rows: DataFrame, path: str) -> None:
        raise OSError("no sink")

    rows = c._scored(spark, d).where("is_anomaly = 1").withColumns({"source": F.lit("batch_layer"), "confirmed": F.lit(True)})
    if store.write(rows, "anomalies", broken) or not store.replay()["anomalies"]:
        raise RuntimeError("the rows took another way")
    return _stored(store)


@query(c.ORACLE_SQL["pattern_documents"])
def stored_patterns(spark: SparkSession, d: str) -> DataFrame:
    store, sets = _store(spark), c._sets(spark, d)
    items = c.patterns.frequent_itemsets(sets, c.SUPPORT, c.CONFIDENCE)[0]
    store.write_patterns(items, "itemset", sets.count())
    return store.read("patterns")


@query(c.ORACLE_SQL["cluster_summary"])
def stored_clusters(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    store.write_clusters(c.cluster_summary(spark, d))
    return store.read("clusters")


@query(f"with {c.SCORED}, {c._CONF} select " + ", ".join(f"round({c._RATES[k]}, 6) as {k}" for k in ("precision", "recall", "f1", "mcc")) + " from conf")
def stored_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates inside a struct, as an evaluation hands them over."""
    store = _store(spark)
    store.write_metrics(metrics.rates(metrics.confusion(c._aligned(spark, d))).select(F.struct("precision", "recall", "f1", "mcc").alias("core_metrics")))
    return c._rounded(store.read("metrics").select("precision", "recall", "f1", "mcc"), "precision", "recall", "f1", "mcc")


@query(f"with {c.SCORED} select 'anomalies' as \"table\", count(*) as documents from al where p = 1 union all select * from (values ('logs', 0::bigint), ('metrics', 0), ('patterns', 0), ('clusters', 0)) v")
def store_health(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    store.write_scores(c._scored(spark, d), only_anomalies=True)
    return store.health().select("table", "documents")


@query(f"with {c.SCORED} select block_id, round(s, 6) as if_score, p as is_anomaly from al order by s desc, block_id limit 1000")
def exported_scores(spark: SparkSession, d: str) -> DataFrame:
    """The export of the first thousand by score."""
    path = scratch_path(spark, "export")
    exports.save_csv(c._scored(spark, d), path, [F.desc("if_score"), "block_id"], 1000)
    return c._rounded(readers.scan_csv(spark, path, "block_id string, if_score double, is_anomaly int, threshold double, threshold_method string").select("block_id", "if_score", "is_anomaly"), "if_score")


@query(c.ORACLE_SQL["cluster_summary"])
def exported_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The whole summary in order of cluster."""
    path, summary = scratch_path(spark, "export"), c.cluster_summary(spark, d)
    exports.save_csv(summary, path, ["cluster_id"])
    return spark.read.option("header", True).schema(summary.schema).csv(path)


@query(f"with {c.SCORED} select b::double as bound, (select count(*) from al where s > b) as above from (values (0.0), (0.5), (0.8)) v(b)")
def counts_above(spark: SparkSession, d: str) -> DataFrame:
    found = training.count_above(c._scored(spark, d), "if_score", (0.0, 0.5, 0.8))
    return spark.createDataFrame(list(found.items()), "bound double, above long")


# miners' tables


def _settings() -> Settings:
    return Settings(min_support=c.SUPPORT, min_confidence=c.CONFIDENCE)


@query(f"with {c.SUBSETS} select items, freq from named order by freq desc, items limit 1000")
def mined_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """The itemset miner's export."""
    out = scratch_path(spark, "mined")
    training.mine_itemsets(c._sets(spark, d), out, _settings())
    return readers.scan_csv(spark, f"{out}/fp/top_itemsets", "items string, freq long")


def _mined(spark: SparkSession, d: str) -> str:
    out = scratch_path(spark, "mined")
    training.mine_sequences(c._traces(spark, d), c._labels(spark, d), out, _settings())
    return out


@query(c.ORACLE_SQL["prefixspan_patterns"].replace("label = 'NORMAL'", "label = 'ANOMALY'"))
def mined_anomalous_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The sequence miner's table of anomalous blocks."""
    return c._pattern_text(spark.read.parquet(f"{_mined(spark, d)}/seq/anomalous_patterns"))


@query(c.ORACLE_SQL["seq_deviation"])
def mined_deviations(spark: SparkSession, d: str) -> DataFrame:
    return c._rounded(spark.read.parquet(f"{_mined(spark, d)}/seq/scores"), "seq_deviation_score")


# features, model, batch


@query(f"with {c.EV}, m as (select block_id, {c._COUNTS} from ev group by 1) select block_id, " + ", ".join(f"round(coalesce({a} / nullif(stddev_samp({a}) over (), 0), 0), 6) as {a}" for a in c.ALPHABET) + " from m")
def scaled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """What clusters are made of: counts scaled to unit deviation."""
    x = vector_to_array("features")
    return c._rounded(c._vectors(spark, d).select("block_id", *[x[i].alias(a) for i, a in enumerate(c.ALPHABET)]), *c.ALPHABET)


_MINED = ("fp_rarity_score", "seq_deviation_score")


@query(f"""with recursive {c.FEAT}, cm as (select block_id, {c._COUNTS} from ev group by 1),
cd as (select block_id, (click > 0)::double as cluster_id, case when click > 0 then {c._apart(c.CENTRES[1])} else {c._apart(c.CENTRES[0])} end as dist from cm), cq as (select min(dist) as lo, quantile_cont(dist, 0.95) as hi from cd)
select block_id, {', '.join(f'round({x}, 6) as {x}' for x in _MINED)}, round(least(1, greatest(0, (dist - lo) / (hi - lo))), 6) as cluster_outlier_score, cluster_id, log_count, unique_events, time_span, {', '.join(f'round({x}, 6) as {x}' for x in c._NORM)} from feat join cd using (block_id), cq""")
def feature_matrix_given(spark: SparkSession, d: str) -> DataFrame:
    """The features of all four sources, with clusters by given centres."""
    m = c.occurrence_matrix(spark, d)
    rows = m.select("block_id", (F.col("click") > 0).cast("int").alias("cluster_id"), c.array_to_vector(F.array(*[F.col(a).cast("double") for a in c.ALPHABET])).alias("features"))
    cluster = clusters.outlier_scores(clusters.own_distance(rows, c.CENTRES))
    table = features.assemble(traces.log1p_features(m, c.ALPHABET), fp=c._rarity(spark, d), seq=c._deviation(spark, d), cluster=cluster, stats=c._stats(spark, d))
    return c._rounded(table, *_MINED, "cluster_outlier_score", *c._NORM)


_FOREST_SQL = c.ORACLE_SQL["forest_scores_given"]


def _given_model(spark: SparkSession) -> tuple[iforest.Forest, threshold.Threshold]:
    """The written-down forest and a fixed threshold, saved and loaded."""
    out = scratch_path(spark, "model")
    training.save_model(spark, out, iforest.Forest(["log_count", "time_span"], c.TREES, 16, 0.25, 0.75), threshold.Threshold(0.75, "fixed"))
    return training.load_model(spark, out)


@query(f"with f as ({_FOREST_SQL}) select block_id, if_score, (if_score >= 0.75)::int as is_anomaly, 'fixed' as threshold_method from f")
def saved_model_scores(spark: SparkSession, d: str) -> DataFrame:
    forest, limit = _given_model(spark)
    scored = threshold.label_anomalies(iforest.score_forest(c._stats(spark, d), forest), limit.threshold, limit.method)
    return c._rounded(scored.select("block_id", "if_score", "is_anomaly", "threshold_method"), "if_score")


_FROM, _NOW = datetime(2024, 1, 15, tzinfo=timezone.utc), datetime(2024, 3, 1, tzinfo=timezone.utc)
_NEW = f"with f as ({_FOREST_SQL}), new as (select distinct 'u' || user_id || '_' || strftime(ts, '%Y%m%d') as block_id from events where ts > timestamp '2024-01-15 00:00:00'), sc as (select block_id, if_score, (if_score >= 0.75)::int as is_anomaly from f semi join new using (block_id))"


def _batch_run(spark: SparkSession, d: str) -> str:
    """The folder of one run of the batch job over what came after the watermark."""
    base = scratch_path(spark, "batch-job")
    mark = batch.Watermark(spark, f"{base}/watermark.json")
    mark.advance(_FROM)
    logs = c._events(spark, d).select("block_id", F.col("ts").alias("processed_at"))
    batch.run_batch(spark, logs, c._stats(spark, d), *_given_model(spark), mark, f"{base}/batch", now=_NOW)
    return base


@query(f"{_NEW} select * from sc")
def batch_run_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{_batch_run(spark, d)}/batch/scores")
    return c._rounded(rows.select("block_id", "if_score", "is_anomaly"), "if_score")


@query(f"{_NEW} select count(*) as new_blocks, sum(is_anomaly)::bigint as anomalies_detected, round(sum(is_anomaly) / count(*), 6) as anomaly_rate, sum(is_anomaly)::bigint as alerts_published, false as model_retrained from sc")
def batch_run_history(spark: SparkSession, d: str) -> DataFrame:
    rows = views.stored_history(spark, _batch_run(spark, d))
    return c._rounded(rows.select("new_blocks", "anomalies_detected", "anomaly_rate", "alerts_published", "model_retrained"), "anomaly_rate")


@query(f"{_NEW} select block_id, 'BATCH_CONFIRMED' as alert_type from sc where is_anomaly = 1")
def batch_run_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.schema("key string, value string").option("recursiveFileLookup", True).json(f"{_batch_run(spark, d)}/batch/alerts")
    return rows.select(F.get_json_object("value", "$.block_id").alias("block_id"), F.get_json_object("value", "$.alert_type").alias("alert_type"))
