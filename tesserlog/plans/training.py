"""The whole training run: three miners, features, forest, threshold, labels, evaluation. Every table is written once and read on."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserlog.functions.scores import items_key, render_sequence
from tesserlog.operators import clusters, features, iforest, metrics, patterns, threshold, traces
from tesserlog.session import Settings, logger
from tesserlog.sources.exports import save, save_csv
from tesserlog.sources.files import Files

log = logger("training")


def mine_itemsets(sets: DataFrame, out: str, s: Settings) -> DataFrame:
    """Frequent itemsets, rules and pairs, and each block's rarity, which is returned."""
    items, rules = patterns.frequent_itemsets(sets, s.min_support, s.min_confidence)
    items = save(items, f"{out}/fp/itemsets")
    save(rules, f"{out}/fp/rules")
    save(patterns.pair_support(sets, s.min_support), f"{out}/fp/pairs")
    save_csv(items.withColumn("items", items_key(F.col("items"))), f"{out}/fp/top_itemsets", [F.desc("freq"), "items"], 1000)
    return save(patterns.rarity(sets, patterns.single_support(sets, s.min_support)), f"{out}/fp/scores")


def mine_sequences(all_traces: DataFrame, labels: DataFrame | None, out: str, s: Settings) -> DataFrame:
    """Patterns of normal and of anomalous blocks, the baseline of the normal ones, and each block's deviation, which is returned.

    Without labels every block counts as normal.
    """
    normal, anomalous = split_by_label(all_traces, labels)
    found = save(patterns.sequential_patterns(traces.sequences(normal, s.max_pattern_length), s.min_support, s.max_pattern_length), f"{out}/seq/patterns")
    if anomalous is not None and not anomalous.isEmpty():
        save(patterns.sequential_patterns(traces.sequences(anomalous, s.max_pattern_length), s.min_support, s.max_pattern_length), f"{out}/seq/anomalous_patterns")
    baseline = save(patterns.normal_baseline(found, s.top_k_patterns), f"{out}/seq/baseline")
    text = found.select(render_sequence(F.col("sequence")).alias("sequence"), "freq")
    save_csv(text, f"{out}/seq/top_sequences", [F.desc("freq"), "sequence"], 1000)
    known = [r["signature"] for r in baseline.collect()]  # at most top_k_patterns
    return save(patterns.sequence_deviation(all_traces, known), f"{out}/seq/scores")


def split_by_label(all_traces: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(normal, anomalous) blocks; a block without a label is normal."""
    if labels is None:
        return all_traces, None
    marked = all_traces.join(metrics.clean_labels(labels).where("label = 'ANOMALY'").select("block_id").distinct().withColumn("bad", F.lit(True)), "block_id", "left")
    return marked.where("bad is null").drop("bad"), marked.where("bad").drop("bad")


def mine_clusters(matrix: DataFrame, events: list[str], labels: DataFrame | None, out: str, s: Settings) -> DataFrame:
    """Clusters with their summary, and each block's distance and score, which are returned."""
    vectors = clusters.feature_vectors(matrix, events)
    assigned, centres, cost = clusters.assign_clusters(vectors, s.clusters, s.cluster_iterations, s.seed)
    scores = save(clusters.outlier_scores(clusters.own_distance(assigned, centres)), f"{out}/clusters/scores")
    truth = metrics.clean_labels(labels) if labels is not None else scores.select("block_id", F.lit(None).cast("string").alias("label")).limit(0)
    summary = save(clusters.cluster_summary(scores, truth), f"{out}/clusters/summary")
    save_csv(summary, f"{out}/clusters/summary_csv", ["cluster_id"])
    log.info("clusters: cost %.3f, far blocks %s", cost, count_above(scores, "cluster_outlier_score", (0.0, 0.8)))
    return scores


def count_above(scores: DataFrame, column: str, bounds: tuple[float, ...]) -> dict[float, int]:
    """How many rows lie above each bound, in one pass."""
    row = scores.agg(*[F.sum((F.col(column) > b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]).first()
    return {b: row[f"b{i}"] or 0 for i, b in enumerate(bounds)}


def fit_and_score(table: DataFrame, out: str, s: Settings) -> tuple[iforest.Forest, threshold.Threshold, DataFrame]:
    """Forest, threshold and labelled scores of a feature matrix, saved below ``out``."""
    columns = [c for c in table.columns if c != "block_id"]
    forest = iforest.fit_forest(table, columns, s.trees, s.tree_samples, s.seed)
    raw = save(iforest.score_forest(table, forest), f"{out}/raw_scores")
    limit = threshold.fit_threshold(raw, "if_score", s.pot_q0, s.pot_risk, s.fallback_percentile, s.least_tail)
    scored = save(threshold.label_anomalies(raw, limit.threshold, limit.method), f"{out}/scores")
    save_model(table.sparkSession, out, forest, limit)
    return forest, limit, scored


def save_model(spark: SparkSession, out: str, forest: iforest.Forest, limit: threshold.Threshold) -> None:
    files = Files(spark)
    files.make_folder(f"{out}/model")
    files.replace(f"{out}/model/forest.json", forest.to_json())
    files.replace(f"{out}/model/threshold.json", limit.to_json())


def load_model(spark: SparkSession, out: str) -> tuple[iforest.Forest, threshold.Threshold] | None:
    files = Files(spark)
    if not files.exists(f"{out}/model/threshold.json"):
        return None
    return iforest.Forest.from_json(files.read(f"{out}/model/forest.json")), threshold.Threshold.from_json(files.read(f"{out}/model/threshold.json"))


def evaluate(scored: DataFrame, labels: DataFrame, out: str) -> DataFrame:
    """One row of counts, rates and areas; the sweep and the best threshold are saved beside it."""
    rows = save(metrics.align(metrics.clean_labels(labels), scored), f"{out}/evaluation/aligned")
    sweep = save(metrics.threshold_sweep(rows), f"{out}/evaluation/sweep")
    save(metrics.best_f1(sweep), f"{out}/evaluation/best_f1")
    return save(metrics.rates(metrics.confusion(rows)).join(metrics.auc_roc(rows)).join(metrics.auc_pr(rows)), f"{out}/evaluation/metrics")


def ablation(table: DataFrame, labels: DataFrame, out: str, s: Settings, rule: DataFrame | None = None) -> DataFrame:
    """variant, precision, recall, f1 of the forest with all features, without those of a miner, without both, and of a rule (block_id, p)."""
    truth, found = metrics.clean_labels(labels), []
    for name, without in (("all", ()), ("no itemsets", ("fp_rarity_score",)), ("no sequences", ("seq_deviation_score",)), ("neither", ("fp_rarity_score", "seq_deviation_score"))):
        _, _, scored = fit_and_score(table.drop(*without), f"{out}/ablation/{name.replace(' ', '_')}", s)
        found.append((name, metrics.align(truth, scored).select("y", "p")))
    if rule is not None:
        found.append(("rule", truth.join(rule, "block_id").select((F.col("label") == "ANOMALY").cast("int").alias("y"), "p")))
    out_rows = [metrics.rates(metrics.confusion(rows)).select(F.lit(name).alias("variant"), "precision", "recall", "f1") for name, rows in found]
    result = out_rows[0]
    for r in out_rows[1:]:
        result = result.union(r)
    return save(result, f"{out}/ablation/result")


def train(spark: SparkSession, all_traces: DataFrame, stats: DataFrame, alphabet: list[str], out: str, labels: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """All steps over (block_id, events) and block statistics; returns the labelled scores. ``settings.dropped_events`` are no features."""
    s = settings or Settings.load()
    kept = [a for a in alphabet if a not in s.dropped_events]
    all_traces = save(all_traces, f"{out}/traces")
    matrix = save(traces.occurrence_matrix(all_traces, kept), f"{out}/matrix")
    fp = mine_itemsets(save(traces.event_sets(all_traces), f"{out}/sets"), out, s)
    seq = mine_sequences(all_traces, labels, out, s)
    cluster = mine_clusters(matrix, kept, labels, out, s)
    table = features.assemble(traces.log1p_features(matrix, kept), fp=fp, seq=seq, cluster=cluster, stats=stats)
    table = save(features.drop_constant(save(table, f"{out}/all_features")), f"{out}/features")
    save_csv(table, f"{out}/features_csv", ["block_id"], 5000)
    _, limit, scored = fit_and_score(table, out, s)
    log.info("threshold %s", asdict(limit))
    if labels is not None:
        evaluate(scored, labels, out)
    return scored
