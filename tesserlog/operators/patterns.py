"""Frequent itemsets, rarity, sequential patterns and deviation from the normal ones."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserlog.functions.scores import clamp, items_key


@contextmanager
def persisted(df: DataFrame):
    """Kept while an estimator passes over it, and let go after."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def frequent_itemsets(sets: DataFrame, min_support: float = 0.005, min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(itemsets: items, freq), (rules: antecedent, consequent, confidence, lift, support)."""
    with persisted(sets) as s:
        model = FPGrowth(itemsCol="events", minSupport=min_support, minConfidence=min_confidence).fit(s)
    return model.freqItemsets, model.associationRules


def itemset_support(itemsets: DataFrame, total: int) -> DataFrame:
    return itemsets.select(items_key(F.col("items")).alias("itemset"), F.size("items").alias("n_items"), "freq", (F.col("freq") / total).alias("support"))


def single_support(sets: DataFrame, min_support: float) -> DataFrame:
    """(event_id, support) of the frequent single events, without a collected total."""
    total = sets.agg(F.count("*").alias("n"))
    single = sets.select(F.explode("events").alias("event_id")).groupBy("event_id").agg(F.count("*").alias("freq"))
    return single.join(F.broadcast(total)).where(F.col("freq") >= F.ceil(min_support * F.col("n"))).select("event_id", (F.col("freq") / F.col("n")).alias("support"))


def rarity(sets: DataFrame, single: DataFrame, method: str = "avg", null_as_zero: bool = False) -> DataFrame:
    """block_id, max_single_support, avg_single_support, fp_rarity_score = clamp(1 - support of its frequent events).

    Infrequent events are left out of the mean, or count as 0; a block without frequent events scores 1.
    The event alphabet is a catalogue, so that its supports are broadcast.
    """
    support = F.coalesce("support", F.lit(0.0)) if null_as_zero else F.col("support")
    each = sets.select("block_id", F.explode("events").alias("event_id")).join(F.broadcast(single), "event_id", "left")
    block = each.groupBy("block_id").agg(F.max(support).alias("max_single_support"), F.avg(support).alias("avg_single_support"))
    used = F.col("max_single_support" if method == "max" else "avg_single_support")
    return block.select("block_id", F.coalesce("max_single_support", F.lit(0.0)).alias("max_single_support"), "avg_single_support", F.coalesce(clamp(1 - used), F.lit(1.0)).alias("fp_rarity_score"))


def pair_support(sets: DataFrame, min_support: float) -> DataFrame:
    """(pair, freq, support) of frequent pairs, each block's pairs made by array functions."""
    total = sets.agg(F.count("*").alias("n"))
    s = F.array_sort("events")
    pairs = F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: b > a), lambda b: F.concat_ws(",", a, b))))
    found = sets.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("freq"))
    return found.join(F.broadcast(total)).where(F.col("freq") >= F.ceil(min_support * F.col("n"))).select("pair", "freq", (F.col("freq") / F.col("n")).alias("support"))


def sequential_patterns(seqs: DataFrame, min_support: float = 0.005, longest: int = 20) -> DataFrame:
    """sequence, freq."""
    with persisted(seqs) as s:
        return PrefixSpan(minSupport=min_support, maxPatternLength=longest, maxLocalProjDBSize=32_000_000, sequenceCol="sequence").findFrequentSequentialPatterns(s)


def signature(events: Column, ordered: bool = False) -> Column:
    return F.array_join(events if ordered else F.array_sort(events), "|")


def normal_baseline(patterns: DataFrame, k: int = 50, ordered: bool = False) -> DataFrame:
    """The signatures of the k most frequent patterns, ties by signature and text: signature, freq."""
    first = F.transform("sequence", lambda s: s[0])
    sig = signature(first, ordered)
    top = patterns.select(sig.alias("signature"), F.array_join(first, ">").alias("t"), "freq").orderBy(F.desc("freq"), "signature", "t").limit(k)
    return top.groupBy("signature").agg(F.max("freq").alias("freq"))


def sequence_deviation(traces: DataFrame, baseline: list[str], ordered: bool = False) -> DataFrame:
    """block_id, seq_deviation_score, matched_subseq_count, total_subseq_count.

    All contiguous windows of 2 to 4 events; the share that is not in the baseline. A
    block of one event is held against the baseline itself; an empty one scores 1.
    """
    e = F.coalesce(F.col("events"), F.array().cast("array<string>"))
    n = F.size(e)
    none = F.array().cast("array<string>")

    def windows_of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: signature(F.slice(e, i, k), ordered))).otherwise(none)

    windows = F.flatten(F.array(*[windows_of(k) for k in (2, 3, 4)]))
    sigs = F.when(n == 1, e).otherwise(windows)
    known = F.array(*[F.lit(b) for b in baseline]) if baseline else F.array().cast("array<string>")
    rows = traces.select("block_id", sigs.alias("sigs")).select("block_id", F.size("sigs").alias("total"), F.size(F.filter("sigs", lambda s: F.array_contains(known, s))).alias("matched"))
    return rows.select(
        "block_id", F.when(F.col("total") > 0, 1 - F.col("matched") / F.col("total")).otherwise(1.0).alias("seq_deviation_score"),
        F.col("matched").alias("matched_subseq_count"), F.col("total").alias("total_subseq_count"),
    )
