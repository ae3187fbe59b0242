"""Queries without SQL of their own, against the queries they are made of and brute force."""

import math
import statistics
from collections import Counter
from itertools import combinations

import pytest

from tesserlog.operators import features, metrics
from tesserlog.plans import catalogue

D = "/root/testdata/sf0.001"


def by_block(df, *columns):
    return {r["block_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_features_hold_every_mining_score(spark):
    table = catalogue.feature_matrix_full(spark, D)
    seq = by_block(catalogue.seq_deviation(spark, D), "seq_deviation_score")
    cluster = by_block(catalogue.cluster_outlier(spark, D), "cluster_outlier_score", "cluster_id")
    got = by_block(table, "seq_deviation_score", "cluster_outlier_score", "cluster_id")
    assert len(got) == len(seq) == table.count()
    for b, row in got.items():
        assert row == pytest.approx((*seq[b], *cluster[b]), abs=1e-6)
    rows = table.collect()
    found = {r["feature"]: r["deviation"] for r in catalogue.constant_columns_full(spark, D).collect()}
    assert found.pop("never") == 0 and set(found) == set(table.columns) - {"block_id"}
    for c, deviation in found.items():
        assert deviation == pytest.approx(statistics.stdev(r[c] for r in rows))


def test_forest_reads_every_feature(spark):
    f, forest = catalogue._forest(spark, D)
    assert {"fp_rarity_score", "seq_deviation_score", "cluster_outlier_score", "cluster_id", "log_count"} <= set(forest.columns)
    assert catalogue.score_new(spark, D).count() > 0


def test_no_block_loses_its_rarity(spark):
    rarity = by_block(catalogue.fp_rarity(spark, D), "fp_rarity_score")
    for table in (catalogue.feature_matrix_full(spark, D), catalogue._forest(spark, D)[0]):
        got = by_block(table, "fp_rarity_score")
        assert set(got) == set(rarity)
        assert all(got[b] == pytest.approx(rarity[b], abs=1e-6) for b in got)


def test_missing_scores_are_filled(spark):
    matrix = spark.createDataFrame([("a", 0.5), ("b", 1.5)], "block_id string, e double")
    one = spark.createDataFrame([("a", 0.25, 0.75, 0.125, 3)], "block_id string, fp_rarity_score double, seq_deviation_score double, cluster_outlier_score double, cluster_id int")
    got = by_block(features.assemble(matrix, fp=one, seq=one, cluster=one), *one.columns[1:], "e")
    assert got == {"a": (0.25, 0.75, 0.125, 3.0, 0.5), "b": (0.5, 0.5, 0.5, -1.0, 1.5)}


def test_unmatched_rows(spark):
    truth = spark.createDataFrame([("a",), ("b",), ("c",)], "block_id string")
    got = {r["side"]: r["n"] for r in metrics.unmatched(truth, spark.createDataFrame([("b",), ("x",)], "block_id string")).collect()}
    assert got == {"truth": 2, "predictions": 1}
    assert {r["side"]: r["n"] for r in catalogue.unmatched_rows_full(spark, D).collect()} == {"truth": 0, "predictions": 0}


def test_patterns_of_any_length_equal_brute_force(spark):
    rows = by_block(catalogue._traces(spark, D), "events")
    normal = {r["block_id"] for r in metrics.clean_labels(catalogue._labels(spark, D)).where("label = 'NORMAL'").collect()}
    seen = Counter()
    for b in normal:
        (e,) = rows[b]
        seen.update({">".join(c) for k in range(1, len(e) + 1) for c in combinations(e, k)})
    least = math.ceil(catalogue.SUPPORT * len(normal))
    want = {p: n for p, n in seen.items() if n >= least}
    got = {r["pattern"]: r["freq"] for r in catalogue.prefixspan_patterns(spark, D).collect()}
    assert got == want and max(p.count(">") for p in got) > 2


def test_baseline_holds_long_windows(spark, tmp_path):
    """Blocks of one repeated order: no window of four deviates."""
    kinds = ["click", "view", "purchase", "signup"]
    rows = [(b * 5 + i, 3 * b + 1, f"2024-01-01 00:00:0{i}", kinds[i % 4], 1.0) for b in range(6) for i in range(5)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = by_block(catalogue.seq_deviation(spark, str(tmp_path)), "matched_subseq_count", "total_subseq_count")
    assert len(got) == 6 and set(got.values()) == {(9, 9)}


def test_sequences_are_cut_at_twenty(spark):
    rows = by_block(catalogue._traces(spark, D), "events")
    got = by_block(catalogue.sequences_truncated(spark, D), "rendered")
    assert max(len(e) for (e,) in rows.values()) > 3
    assert got == {b: ("\u2192".join(e[:20]),) for b, (e,) in rows.items()}
