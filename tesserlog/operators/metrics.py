"""Evaluation against labels. Input rows: y (0/1), p (0/1) and s (score).

Curves work on distinct scores: counts are aggregated first, and running totals are
computed in parts of the score range, so that no task sees all scores. Rows without a
score are not on a curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserlog.functions.scores import label, ratio
from tesserlog.operators.quantiles import with_totals_below
from tesserlog.operators.traces import named_like


def clean_labels(labels: DataFrame, block_col: str | None = None, label_col: str | None = None) -> DataFrame:
    """(block_id, label) with columns found by name and labels trimmed and upper-cased."""
    block = block_col or named_like(labels, "blockid", "block")
    lab = label_col or named_like(labels, "label")
    return labels.select(F.trim(block).alias("block_id"), label(F.col(lab)).alias("label"))


def align(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Joined by block: block_id, y, p, s, with the threshold carried along where there is one."""
    y = (F.col("label") == "ANOMALY").cast("int")
    extra = [c for c in ("threshold",) if c in predictions.columns]
    return truth.join(predictions, "block_id").select("block_id", y.alias("y"), F.col("is_anomaly").alias("p"), F.col("if_score").alias("s"), *extra)


def unmatched(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows of each side without a partner: side, n."""
    a = truth.join(predictions, "block_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("truth").alias("side"), "n")
    b = predictions.join(truth, "block_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("predictions").alias("side"), "n")
    return a.union(b)


def confusion(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, tn."""
    n = lambda y, p: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("p") == p), 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """All rates of tp, fp, fn, tn; a rate without a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f = lambda b: ratio((1 + b * b) * p * r, b * b * p + r)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        "*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), p.alias("precision"), r.alias("recall"), f(1.0).alias("f1"), f(0.5).alias("f05"), f(2.0).alias("f2"),
        ratio(tp * tn - fp * fn, root).alias("mcc"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"),
        ratio(tp + fn, tp + fp + fn + tn).alias("true_rate"), ratio(tp + fp, tp + fp + fn + tn).alias("predicted_rate"),
    )


def _by_score(rows: DataFrame) -> DataFrame:
    return rows.where("s is not null").groupBy(F.col("s").cast("double").alias("s")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def auc_roc(rows: DataFrame) -> DataFrame:
    """Share of (anomaly, normal) pairs in the right order, ties half; 0 with one class only."""
    each = with_totals_below(_by_score(rows), "s", ["neg"])
    won = F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)
    return each.agg(ratio(F.sum(won), F.sum("pos") * F.sum("neg")).alias("auc_roc"))


def auc_pr(rows: DataFrame) -> DataFrame:
    """Average precision: the step sum over falling scores."""
    falling = _by_score(rows).select((-F.col("s")).alias("s"), "pos", "neg")
    each = with_totals_below(falling, "s", ["pos", "neg"])
    tp, fp = F.col("below_pos") + F.col("pos"), F.col("below_neg") + F.col("neg")
    return each.agg(ratio(F.sum(F.col("pos") * ratio(tp, tp + fp)), F.sum("pos")).alias("auc_pr"))


def threshold_sweep(rows: DataFrame, points: int = 100) -> DataFrame:
    """Counts and rates at evenly spaced thresholds from the least to the largest score; predicted where s >= threshold.

    A row is counted once, at the last threshold that it reaches; running sums do the rest.
    """
    ends = rows.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    step = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: step(i.cast("double")))
    last = F.size(F.filter("grid", lambda t: t <= F.col("s"))) - 1
    counted = rows.join(F.broadcast(ends.select(grid.alias("grid")))).groupBy(last.alias("i")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    every = ends.where("lo is not null").select(F.posexplode(grid).alias("i", "threshold")).join(counted, "i", "left")
    down = Window.orderBy(F.desc("i"))
    back = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    s = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    counts = every.select("i", "threshold", s("pos", down).alias("tp"), s("neg", down).alias("fp"), s("pos", back).alias("fn"), s("neg", back).alias("tn"))
    return rates(counts).select(F.col("i").alias("point"), "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr", F.col("recall").alias("tpr"))


def best_f1(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def rule_baseline(matrix: DataFrame, events: list[str]) -> DataFrame:
    """block_id, p: 1 where any of the events occurs."""
    return matrix.select("block_id", (F.greatest(*[F.col(e) for e in events], F.lit(0)) > 0).cast("int").alias("p"))
