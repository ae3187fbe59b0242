import json
import random
import time
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserlog.functions import catalog, parse, scores
from tesserlog.operators import clusters, drain, iforest, metrics, patterns, threshold, traces
from tesserlog.plans import batch
from tesserlog.sources import readers, store
from tesserlog.streaming import stream

LINES = [
    "081109 203518 143 INFO dfs.Node: Receiving block blk_-16 src: x",
    "",
    "hello",
    "081109 203519 143 INFO dfs.Node: no block here",
    "081109 203520 9 WARN dfs.Node: Exception on blk_7 and blk_8",
    "   081109 203521 9 WARN dfs.Node: exception again blk_7   ",
    None,
]
CATALOG = catalog.compile_catalog([("E1", "Receiving block <*> src: <*>"), ("E2", "[*]exception[*]")])


def logs(spark):
    rows = spark.createDataFrame([(i + 1, t, "now") for i, t in enumerate(LINES)], "line_no long, raw string, ingested_at string")
    return parse.parse_logs(rows, catalog.match_event(F.col("content"), CATALOG), ("E2",))


def test_lines(spark):
    got = {r["line_no"]: r for r in logs(spark).collect()}
    assert sorted(got) == [1, 5, 6]
    assert (got[1]["block_id"], got[1]["event_id"], got[1]["is_high_risk"]) == ("blk_-16", "E1", False)
    assert (got[5]["block_id"], got[5]["event_id"], got[6]["content"]) == ("blk_7", "E2", "exception again blk_7")
    assert got[1]["event_ts"] == datetime(2008, 11, 9, 20, 35, 18)
    secs = spark.createDataFrame([("203518",), (None,), ("12",), ("ab3518",)], "t string").select(parse.seconds_of_day(F.col("t")).alias("s"))
    assert [r["s"] for r in secs.collect()] == [74118, 0, 0, 0]


def test_template_regex():
    assert catalog.template_regex("[*]Adding an existing block[*]") == r".*?Adding\s+an\s+existing\s+block.*?"
    assert catalog.compile_catalog([("a", "x"), ("b", "long one")])[0][0] == "b"


def test_envelopes_and_lines(spark, tmp_path):
    (tmp_path / "x.log").write_text("a\n\n  b \n")
    lines = readers.scan_lines(spark, str(tmp_path / "x.log"))
    sent = parse.open_envelopes(parse.make_envelopes(lines).select("value"))
    assert sorted((r["line_no"], r["raw"]) for r in sent.collect()) == [(1, "a"), (3, "b")]


def test_rarity_fixture(spark):
    sets = spark.createDataFrame([("a", ["E5", "E22"]), ("b", ["E5", "E22", "E9"]), ("c", ["E5"]), ("d", ["E11"])], "block_id string, events array<string>")
    got = {r["block_id"]: r["fp_rarity_score"] for r in patterns.rarity(sets, patterns.single_support(sets, 0.5)).collect()}
    assert got == pytest.approx({"a": 0.375, "b": 0.375, "c": 0.25, "d": 1.0})
    strict = {r["block_id"]: r["fp_rarity_score"] for r in patterns.rarity(sets, patterns.single_support(sets, 0.5), "max", True).collect()}
    assert strict == pytest.approx({"a": 0.25, "b": 0.25, "c": 0.25, "d": 1.0})


def test_sequence_deviation_equals_model(spark):
    rng = random.Random(4)
    seqs = [["E5", "E22", "E9"], ["E5", "E22"], ["E5"], ["E9"], []] + [[f"E{rng.randint(1, 4)}" for _ in range(rng.randint(0, 8))] for _ in range(60)]
    base = {"E22|E5", "E5", "E1|E2", "E1|E1|E3", "E1|E2|E3|E4"}
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)] + [("null", None)], "block_id string, events array<string>")
    got = {r["block_id"]: (r["seq_deviation_score"], r["matched_subseq_count"], r["total_subseq_count"]) for r in patterns.sequence_deviation(df, sorted(base)).collect()}
    for i, s in enumerate(seqs):
        w = s if len(s) == 1 else ["|".join(sorted(s[j : j + k])) for k in (2, 3, 4) for j in range(len(s) - k + 1)]
        m = sum(x in base for x in w)
        assert got[str(i)] == (pytest.approx(1 - m / len(w) if w else 1.0), m, len(w))
    assert got["null"] == (1.0, 0, 0)


def test_matrix_by_name(spark):
    m, events = traces.read_matrix(spark.createDataFrame([("b1", 1, None, "x"), ("b2", 0, 0, "y")], "BlockId string, E1 int, E2 int, Type string"))
    assert events == ["E1", "E2"]
    assert [(r["block_id"], r["events"]) for r in traces.matrix_to_sets(m, events).collect()] == [("b1", ["E1"])]
    assert traces.occurrence_matrix(spark.createDataFrame([], "block_id string, events array<string>"), ["a"]).count() == 0


def test_cluster_scores(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("c", 1, 3.0)], "block_id string, cluster_id int, centroid_distance double")
    s = [r["cluster_outlier_score"] for r in clusters.outlier_scores(d).orderBy("block_id").collect()]
    assert s[0] == 0 and s[1] == pytest.approx(1 / 1.9) and s[2] == 1
    labels = spark.createDataFrame([("a", "Anomaly ")], "block_id string, label string")
    got = {r["cluster_id"]: r["anomaly_ratio"] for r in clusters.cluster_summary(clusters.outlier_scores(d), labels).collect()}
    assert got == {0: 0.5, 1: 0.0}


def test_metrics_fixture_and_partitions(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.3), (0, 0, 0.1)], "y int, p int, s double")
    m = metrics.rates(metrics.confusion(rows)).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["precision"], m["recall"], m["f1"], m["mcc"]) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.0)
    assert metrics.auc_roc(rows).first()[0] == 0.75 == metrics.auc_roc(rows.repartition(3)).first()[0]
    assert metrics.auc_roc(rows.where("y = 1")).first()[0] == 0
    empty = metrics.rates(metrics.confusion(rows.limit(0))).first()
    assert empty["accuracy"] == 0 and metrics.threshold_sweep(rows.limit(0)).count() == 0


def test_forest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(600, 3)), [[9, 9, 9], [-8, 7, 9]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "block_id long, a double, b double, c double")
    forest = iforest.fit_forest(df, ["a", "b", "c"], 40, 128)
    got = iforest.score_forest(df, iforest.Forest.from_json(forest.to_json())).orderBy(F.desc("if_score")).limit(2).collect()
    assert {r["block_id"] for r in got} == {600, 601}
    again = iforest.fit_forest(df.repartition(5), ["a", "b", "c"], 40, 128)
    assert again.to_json() == forest.to_json()
    assert iforest.score_forest(df.limit(1), forest).first()["if_score"] <= 1


def test_tail_fit(spark):
    rng = np.random.default_rng(0)
    x = 0.08 / 0.25 * (rng.uniform(size=50_000) ** -0.25 - 1)
    shape, scale = threshold.fit_tail(spark.createDataFrame(pd.DataFrame({"x": x})))
    assert shape == pytest.approx(0.25, abs=0.02) and scale == pytest.approx(0.08, abs=0.003)
    few = spark.createDataFrame([(float(i),) for i in range(50)], "if_score double")
    t = threshold.fit_threshold(few)
    assert t.method == "percentile_97.0" and t.threshold == pytest.approx(47.53)
    many = threshold.fit_threshold(spark.createDataFrame([(float(v),) for v in x[:5000]], "if_score double"))
    assert many.method == "pot_gpd" and np.quantile(x[:5000], 0.97) < many.threshold
    assert threshold.fit_threshold(few.limit(0)).method == "empty"
    assert threshold.Threshold.from_json(many.to_json()) == many


def test_templates(spark):
    df = spark.createDataFrame([(f"Served block blk_{i} to 10.0.0.{i % 9}",) for i in range(40)] + [("Deleting file a",), ("Deleting file b",), (None,)], "content string")
    got = {r["template"]: r["size"] for r in drain.learn_templates(df).collect()}
    assert got == {"Served block <BLOCK> to <IP>": 40, "Deleting file <*>": 2}


def test_templates_of_a_large_group(spark, monkeypatch):
    """Many distinct messages of one length and first word: merged in parts, none is lost, different ones stay apart."""
    monkeypatch.setattr(drain, "GROUP", 50)
    kinds = ["open file x as reader now", "open socket port by writer then", "open door of house with key"]
    rows = [(kinds[i % 3].replace(kinds[i % 3].split()[2], "name" + "abcdefghij"[i // 3 % 10] + "abcdefghij"[i // 30 % 10]),) for i in range(600)]
    got = {r["template"]: r["size"] for r in drain.learn_templates(spark.createDataFrame(rows, "content string")).collect()}
    assert sum(got.values()) == 600 and len(got) == 3 and set(got.values()) == {200}
    apart = spark.createDataFrame([(f"go {'abcdefghij'[i % 10] * 3}{'abcdefghij'[i // 10 % 10]} {'klmnopqrst'[i // 100] * 2}{'abcdefghij'[i % 10]} u{'abcdefghij'[i // 7 % 10]}{'abcdefghij'[i % 9]}",) for i in range(900)], "content string")
    assert sum(r["size"] for r in drain.learn_templates(apart, similarity=0.9).collect()) == 900


def test_store_latest_wins_and_dead_letters(spark, tmp_path):
    s = store.KeyedStore(spark, str(tmp_path), retries=2, backoff=0.0)
    s.bootstrap()
    df = spark.createDataFrame([(1, 5, float("nan"))], "cluster_id int, total_blocks long, anomaly_ratio double")
    assert s.write_clusters(df)
    time.sleep(0.01)
    assert s.write_clusters(df.withColumn("total_blocks", F.lit(9)))
    assert [(r["cluster_id"], r["total_blocks"]) for r in s.read("clusters").collect()] == [(1, 9)]

    def broken(d, p):
        raise OSError("down")

    assert not s.write(df.withColumn("cluster_id", F.lit(2)), "clusters", broken)
    assert s.replay() == {"clusters": True} and s.replay() == {}
    assert s.read("clusters").count() == 2
    assert {r["table"]: r["documents"] for r in s.health().collect()}["clusters"] == 2


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    put = lambda n, ls: (src / f"{n}.json").write_text("\n".join(json.dumps({"line_no": i + 1, "ingested_at": "now", "raw": t}) for i, t in ls))
    put("a", [(i, t) for i, t in enumerate(LINES) if t is not None])
    event = catalog.match_event(F.col("content"), CATALOG)
    run = lambda: stream.start(stream.parsed_stream(readers.stream_envelopes(spark, "json", str(src)), event, ("E2",)), "q", ck, out, None).awaitTermination()
    run()
    run()
    keys = ["line_no", "block_id", "event_id", "is_high_risk"]
    assert sorted(map(tuple, spark.read.parquet(out).select(*keys).collect())) == sorted(map(tuple, logs(spark).select(*keys).collect()))
    put("b", [(90, LINES[0])])
    run()
    assert spark.read.parquet(out).count() == 4
    alerts = [json.loads(r["value"]) for r in stream.realtime_alerts(logs(spark)).collect()]
    assert [(a["block_id"], a["risk_event_count"], a["trigger_event"]) for a in alerts] == [("blk_7", 2, "E2")]


def test_windowed_alerts_and_fan_out(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"line_no": i, "ingested_at": "now", "raw": t}) for i, t in enumerate(LINES) if t))
    event = catalog.match_event(F.col("content"), CATALOG)
    parsed = stream.parsed_stream(readers.stream_envelopes(spark, "json", str(src)), event, ("E2",))
    seen = []
    sink = stream.fan_out(lambda b, n: seen.append(b.count()), lambda b, n: seen.append(b.where("is_high_risk").count()))
    stream.start(parsed, "fan", str(tmp_path / "c1"), sink, None).awaitTermination()
    assert seen == [3, 2]
    rows = []
    stream.start(stream.windowed_alerts(parsed), "win", str(tmp_path / "c2"), lambda b, n: rows.extend(b.collect()), None, mode="complete").awaitTermination()
    assert [(r["block_id"], r["risk_event_count"]) for r in rows] == [("blk_7", 2)]


def test_batch_run(spark, tmp_path):
    now = datetime(2024, 1, 2, tzinfo=timezone.utc)
    df = spark.createDataFrame([(f"b{i}", float(i % 7), float(i % 5)) for i in range(300)], "block_id string, x double, y double")
    forest = iforest.fit_forest(df, ["x", "y"], 10, 64)
    logs_ = spark.createDataFrame([("b1", datetime(2024, 1, 1, 23, 30)), ("b2", datetime(2023, 1, 1)), (None, datetime(2024, 1, 1, 23, 30))], "block_id string, processed_at timestamp")
    mark = batch.Watermark(spark, str(tmp_path / "mark.json"))
    meta = batch.run_batch(spark, logs_, df, forest, threshold.Threshold(0.0, "fixed"), mark, str(tmp_path / "out"), 1, now)
    assert (meta.first()["new_blocks"], meta.first()["anomalies_detected"]) == (1, 1)
    assert mark.load() == (datetime(2024, 1, 1, 23, 30, tzinfo=timezone.utc), 1) and batch.retrain_due(0) and not batch.retrain_due(1)
    again = batch.run_batch(spark, logs_, df, forest, threshold.Threshold(0.0, "fixed"), mark, str(tmp_path / "out"), 1, now)
    assert again.first()["new_blocks"] == 0


def test_small_expressions(spark):
    r = spark.range(1).select(scores.severity(F.lit(0.71)).alias("a"), scores.severity(F.lit(0.6)).alias("b"), scores.severity(F.lit(0.5)).alias("c")).first()
    assert tuple(r) == ("CRITICAL", "HIGH", "MEDIUM")
