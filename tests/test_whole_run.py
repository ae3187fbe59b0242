"""From raw lines to alerts: producer, streams, batch job, retraining, store, views and command line over one folder."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tesserlog.__main__ import main
from tesserlog.operators import quantiles
from tesserlog.plans import batch, training, views
from tesserlog.session import Settings, logger
from tesserlog.sources import exports, producer, readers
from tesserlog.sources.files import Files
from tesserlog.sources.store import KeyedStore
from tesserlog.streaming import stream

MESSAGES = ["Receiving block blk_{b} src: x", "Served block blk_{b} to y", "Verification succeeded for blk_{b}", "writeBlock blk_{b} received exception z"]


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """300 blocks of three or four lines; every fortieth ends in two exceptions."""
    lines = []
    for b in range(300):
        for k in [0, 1, 2] + ([3, 3] if b % 40 == 0 else [1] * (b % 2)):
            lines.append(f"0811{b % 28 + 1:02d} {b % 24:02d}{k:02d}07 {b} INFO dfs.Node: " + MESSAGES[k].format(b=b))
            if b % 50 == 0:
                lines.append("  ")
    path = tmp_path_factory.mktemp("raw") / "x.log"
    path.write_text("\n".join(lines))
    return path


def test_whole_run(spark, raw, tmp_path, capsys):
    base = str(tmp_path / "base")
    (tmp_path / "t.csv").write_text("EventId,EventTemplate\nE1,Receiving block <*> src: <*>\nE2,Served block <*>\nE3,Verification succeeded for <*>\nE9,[*]received exception[*]\n")
    assert main(["--base", base, "produce", str(raw), "--rate", "100000"]) == 0
    assert main(["--base", base, "stream", "--templates", str(tmp_path / "t.csv"), "--once"]) == 0
    logs = spark.read.parquet(f"{base}/logs")
    n = sum(bool(x.strip()) for x in raw.read_text().splitlines())
    assert logs.count() == n and logs.select("block_id").distinct().count() == 300 and logs.where("is_high_risk").count() == 16
    alerts = [json.loads(r["value"]) for r in spark.read.option("recursiveFileLookup", True).json(f"{base}/alerts").collect()]
    assert {a["block_id"] for a in alerts} == {f"blk_{b}" for b in range(0, 300, 40)} and {a["trigger_event"] for a in alerts} == {"E9"}
    assert main(["--base", base, "batch", "--window-hours", "1"]) == 0
    first = views.stored_history(spark, base).collect()
    assert len(first) == 1 and first[0]["new_blocks"] == 300 and 0 < first[0]["anomalies_detected"] <= 150 and not first[0]["model_retrained"]
    scored = views.stored_scores(spark, base)
    top = [r["block_id"] for r in scored.orderBy(F.desc("if_score"), "block_id").limit(8).collect()]
    assert len({int(b[4:]) % 40 for b in top}) <= 3 and sum(int(b[4:]) % 40 == 0 for b in top) >= 6
    info = views.stored_model_info(spark, base)
    assert {"fp_rarity_score", "cluster_outlier_score", "cluster_id", "log_count"} <= set(info["features"]) and info["trees"] == 100
    assert KeyedStore(spark, f"{base}/store").read("anomalies").count() == first[0]["anomalies_detected"]
    assert set(views.service_health(spark, base).values()) == {"ok"} and "missing" in views.service_health(spark, str(tmp_path)).values()
    # nothing new; then one late line
    job = batch.run_batch_job(spark, base, Settings(retrain_every=1)).first()
    assert (job["new_blocks"], job["model_retrained"]) == (0, True)
    (tmp_path / "late.log").write_text("081109 203518 143 INFO dfs.Node: Receiving block blk_0 src: x\n")
    Files(spark).delete(f"{base}/incoming")
    source = producer.replay(producer.local_lines(str(tmp_path / "late.log")), lambda b, k: producer.to_files(spark, f"{base}/incoming")(b, 900), 10)
    assert source == 1 and main(["--base", base, "stream", "--templates", str(tmp_path / "t.csv"), "--once"]) == 0
    job = batch.run_batch_job(spark, base).first()
    assert (job["new_blocks"], batch.Watermark(spark, f"{base}/watermark.json").load()[1]) == (1, 3)
    capsys.readouterr()
    main(["--base", base, "store", "--compact", "--health", "--write-scores", "--bootstrap", "--replay-dlq"])
    assert "anomalies" in capsys.readouterr().out and KeyedStore(spark, f"{base}/store").read("anomalies").count() == 300


def test_training_with_labels_and_ablation(spark, raw, tmp_path):
    rows = [(int(x.split("blk_")[1].split()[0]), i, next(k for k, m in enumerate(MESSAGES) if m.split()[0] in x)) for i, x in enumerate(raw.read_text().splitlines()) if x.strip()]
    events = spark.createDataFrame([(f"b{b}", i, f"E{k}") for b, i, k in rows], "block_id string, line_no int, event_id string")
    from tesserlog.operators.traces import block_stats, occurrence_matrix, traces_from_events
    from tesserlog.operators.metrics import rule_baseline

    labels = spark.createDataFrame([(f"b{b}", "Anomaly" if b % 40 == 0 else "Normal") for b in range(300)], "BlockId string, Label string")
    out, s = str(tmp_path / "o"), Settings(trees=25, dropped_events=("E2",))
    t = traces_from_events(events)
    training.train(spark, t, block_stats(events, F.col("line_no")), ["E0", "E1", "E2", "E3"], out, labels, s)
    m = spark.read.parquet(f"{out}/evaluation/metrics").first()
    assert m["recall"] > 0.2 and m["auc_roc"] > 0.9
    assert "E2_norm" not in spark.read.parquet(f"{out}/features").columns
    assert not spark.read.parquet(f"{out}/seq/anomalous_patterns").isEmpty()
    top = spark.read.option("header", True).csv(f"{out}/fp/top_itemsets").collect()
    assert [int(r["freq"]) for r in top] == sorted((int(r["freq"]) for r in top), reverse=True)
    rule = rule_baseline(occurrence_matrix(t, ["E3"]), ["E3"])
    found = {r["variant"]: r["f1"] for r in training.ablation(spark.read.parquet(f"{out}/features"), labels, out, s, rule).collect()}
    assert set(found) == {"all", "no itemsets", "no sequences", "neither", "rule"} and found["rule"] == 1
    forest, limit = training.load_model(spark, out)
    assert forest.samples == 256 and limit.method and training.load_model(spark, str(tmp_path)) is None
    assert training.count_above(spark.createDataFrame([(0.0,), (0.5,), (0.9,), (None,)], "x double"), "x", (0.0, 0.8)) == {0.0: 2, 0.8: 1}


def test_producer_rate_limit_and_stop():
    sent, clock = [], iter(range(0, 1000, 5))
    lines = ["a", "", " b ", "c", "d"]
    assert producer.replay(lines, lambda b, k: sent.append(b), rate=2, clock=lambda: next(clock)) == 4
    assert [[k for k, _ in b] for b in sent] == [["1", "3"], ["4", "5"]] and json.loads(sent[0][1][1])["raw"] == "b"
    stop = threading.Event()
    stop.set()
    assert producer.replay(lines, lambda b, k: None, rate=1, stop=stop) == 1 and producer.replay(lines, lambda b, k: None, most=3, clock=lambda: 1e9 if sent.append(0) else 9e9) == 3


def test_files(spark, tmp_path):
    files, base = Files(spark), str(tmp_path / "base")
    files.lay_out(base, ("raw", "out"))
    (tmp_path / "a.csv").write_text("x")
    assert files.names(base) == ["out", "raw"] and files.names(f"{base}/none") == []
    assert files.upload_all(str(tmp_path), f"{base}/raw", ("a.csv", "b.csv")) == {"a.csv": "uploaded", "b.csv": "missing"}
    (tmp_path / "a.csv").write_text("other")
    assert files.upload(str(tmp_path / "a.csv"), f"{base}/raw/a.csv") == "present" and files.read(f"{base}/raw/a.csv") == "x"
    assert files.upload(str(tmp_path / "a.csv"), f"{base}/raw/a.csv", force=True) == "uploaded" and files.size(f"{base}/raw") == 5
    files.replace(f"{base}/s.json", "1")
    files.replace(f"{base}/s.json", "2")
    assert files.read(f"{base}/s.json") == "2" and files.names(base) == [".s.json.crc", "out", "raw", "s.json"] or "s.json" in files.names(base)
    files.download(f"{base}/s.json", str(tmp_path / "back"))
    assert (tmp_path / "back").read_text() == "2" and files.uri(base).startswith("file:") and files.delete(base) and not files.exists(base)


def test_quantiles_equal_sorting(spark):
    import random

    rng = random.Random(3)
    for values in ([rng.gauss(0, 1) for _ in range(9000)], [1.0] * 6000 + [2.0] * 3000, [10.0 ** rng.uniform(-300, 300) for _ in range(7000)], [5.0], [float(i) for i in range(5000)] + [1e308, -1e308]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
        shares, s = [0.0, 0.01, 0.5, 0.95, 0.999, 1.0], sorted(values)
        want = []
        for p in shares:
            at = p * (len(s) - 1)
            a, b = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            want.append(a + (b - a) * (at - int(at)))
        assert quantiles.quantiles(df, "x", shares) == want
    assert quantiles.quantiles(df.limit(0), "x", [0.5]) is None


def test_supervise_raises_and_stops(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"line_no": 1, "ingested_at": "now", "raw": "x"}')

    def broken(batch, n):
        raise ValueError("sink down")

    source = readers.stream_envelopes(spark, "json", str(tmp_path / "in"))
    bad = stream.start(source, "bad", str(tmp_path / "c1"), broken, 1)
    good = stream.start(source, "good", str(tmp_path / "c2"), lambda b, n: None, 1)
    with pytest.raises(Exception, match="sink down"):
        stream.supervise([bad, good], poll=5)
    assert not good.isActive


def test_readers_settings_and_sampling(spark, tmp_path, monkeypatch):
    (tmp_path / "traces.csv").write_text('BlockId,Features\nb1,"[E5, E22]"\nb2,[]\n')
    assert {r["block_id"]: r["events"] for r in readers.scan_traces(spark, str(tmp_path / "traces.csv")).collect()} == {"b1": ["E5", "E22"], "b2": []}
    (tmp_path / "m.csv").write_text("BlockId,E1,E2,Type\nb1,1,,x\nb2,0,3,y\n")
    from tesserlog.functions.catalog import learned_catalog
    from tesserlog.functions.scores import hash_sample
    from tesserlog.operators.traces import named_like, read_matrix

    for infer in (True, False):
        m, events = read_matrix(readers.scan_csv(spark, str(tmp_path / "m.csv"), infer=infer))
        assert events == ["E1", "E2"] and [tuple(r) for r in m.orderBy("block_id").collect()] == [("b1", 1, 0), ("b2", 0, 3)]
    with pytest.raises(ValueError):
        named_like(m, "label")
    made = []
    for _ in range(2):
        assert readers.read_or_compute(spark, str(tmp_path / "t"), lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
    assert learned_catalog(spark.createDataFrame([("b <*>", 1), ("a <*>", 9), (None, 5)], "template string, size int")) == [("D1", "a <*>"), ("D2", "b <*>")]
    some = spark.range(20_000).where(hash_sample(F.col("id"), 0.1))
    assert 1800 < some.count() < 2200 and spark.range(5).where(hash_sample(F.col("id"), 1)).count() == 5
    monkeypatch.setenv("TESSERLOG_CLUSTERS", "3")
    monkeypatch.setenv("TESSERLOG_HIGH_RISK", "A,B")
    assert Settings.load().clusters == 3 and Settings.load().high_risk == ("A", "B")
    logger("t", str(tmp_path / "logs")).info("hello")
    assert "hello" in (tmp_path / "logs" / "t.log").read_text()
    exports.save_csv(spark.createDataFrame([(1, ["b", "a"]), (2, [])], "n int, x array<string>"), str(tmp_path / "csv"), [F.desc("n")], 1)
    assert [r["n"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["2"]


def test_store_documents(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path))
    core = spark.createDataFrame([((0.5, 0.25), 0.9)], "core_metrics struct<precision: double, recall: double>, auc_roc double")
    assert s.write_metrics(core) and s.read("metrics").select("precision", "recall", "auc_roc").first() == (0.5, 0.25, 0.9)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "line_no long, content string")
    assert s.write_logs(rows) and sorted((r["line_no"], r["content"]) for r in s.read("logs").collect()) == [(1, "b"), (2, "c")]
    assert s.write_logs(rows.limit(1)) and sorted((r["line_no"], r["content"]) for r in s.read("logs").collect()) == [(1, "a"), (2, "c")]
    s.compact("logs")
    assert sorted((r["line_no"], r["content"]) for r in s.read("logs").collect()) == [(1, "a"), (2, "c")] and spark.read.parquet(s.path("logs")).count() == 2
    seqs = spark.createDataFrame([([["a"], ["b"]], 3), ([["c"]], 3), ([["d"]], 9)], "sequence array<array<string>>, freq long")
    assert s.write_patterns(seqs, "sequence", 10) and sorted(r["pattern_id"] for r in s.read("patterns").collect()) == ["seq_0_d", "seq_1_a→b", "seq_2_c"]
    scored = spark.createDataFrame([("b", 0.9, 1), ("c", 0.1, 0)], "block_id string, if_score double, is_anomaly int")
    assert s.write_scores(scored, only_anomalies=True) and [(r["block_id"], r["confirmed"]) for r in s.read("anomalies").collect()] == [("b", True)]
    assert {r["table"]: r["documents"] for r in s.health().collect()}["clusters"] == -1
