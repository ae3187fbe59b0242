"""Template learning on masked messages.

Messages are masked and grouped by (number of words, first word) in the cluster,
after equal masked messages have been counted, so that a group only holds distinct
messages. Within a group they are merged in a fixed order by a similarity threshold,
differing words becoming wildcards; a large group is merged in parts first. There is no
limit on templates. An approximation of the sequential tree miner.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserlog.functions.parse import mask_message

WILD = "<*>"
#: Distinct messages that are merged at a time.
GROUP = 2000


def _merge(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    found: list[list] = []
    for words, n in sorted(zip((m.split(" ") for m in pdf["masked"]), pdf["n"]), key=lambda x: (-x[1], x[0])):
        best, share = None, -1.0
        for t in found:
            same = sum(a == b for a, b in zip(t[0], words)) / max(1, len(words))
            if same > share:
                best, share = t, same
        if best is not None and share >= similarity:
            best[0] = [a if a == b else WILD for a, b in zip(best[0], words)]
            best[1] += int(n)
        else:
            found.append([list(words), int(n)])
    return pd.DataFrame({"template": [" ".join(t[0]) for t in found], "size": [t[1] for t in found]})


def learn_templates(messages: DataFrame, content: str = "content", similarity: float = 0.5) -> DataFrame:
    """template, size. Words with digits are wildcards before grouping."""
    masked = F.trim(F.regexp_replace(mask_message(F.col(content)), r"\s+", " "))
    masked = F.array_join(F.transform(F.split(masked, " "), lambda w: F.when(w.rlike(r"\d"), WILD).otherwise(w)), " ")
    distinct = messages.where(F.col(content).isNotNull()).select(masked.alias("masked")).groupBy("masked").agg(F.count("*").alias("n"))
    words = F.split("masked", " ")
    keyed = distinct.withColumns({"words": F.size(words), "head": F.when(words[0].contains("<"), WILD).otherwise(words[0])})
    # a group of many messages is merged in parts, and what is left of them once more
    sizes = keyed.groupBy("words", "head").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = keyed.join(sizes, ["words", "head"]).withColumn("part", F.pmod(F.xxhash64("masked"), F.col("parts")))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _merge(pdf, similarity).assign(words=pdf["words"].iloc[0], head=pdf["head"].iloc[0], parts=pdf["parts"].iloc[0])

    shape = "template string, size long, words int, head string, parts long"
    first = dealt.groupBy("words", "head", "part").applyInPandas(merge, shape)
    again = first.where("parts > 1").select(F.col("template").alias("masked"), F.col("size").alias("n"), "words", "head", "parts").groupBy("words", "head").applyInPandas(merge, shape)
    return first.where("parts = 1").union(again).groupBy("template").agg(F.sum("size").alias("size"))


def tokens_of(template: Column) -> Column:
    """Words of more than three characters outside wildcards."""
    return F.filter(F.split(F.regexp_replace(template, r"<[^>]*>|\[\*\]", " "), r"\s+"), lambda t: F.length(t) > 3)


def template_coverage(official: DataFrame, learned: DataFrame) -> DataFrame:
    """template, covered: some learned template holds all its long words; without such words it is not covered.

    Both are catalogues; the join is on one of the words and not on all pairs.
    """
    sought = official.select("template", tokens_of(F.col("template")).alias("tokens"))
    have = learned.select(F.col("template").alias("learned"), F.array_distinct(F.split(F.col("template"), r"[^\w]+")).alias("w")).select("learned", F.explode("w").alias("word"))
    keyed = sought.withColumn("word", F.explode_outer(F.array_distinct(F.flatten(F.transform("tokens", lambda t: F.filter(F.split(t, r"[^\w]+"), lambda x: x != ""))))))
    near = keyed.join(have, "word").select("template", "tokens", "learned").distinct()
    hit = near.where(F.forall("tokens", lambda t: F.contains("learned", t)) & (F.size("tokens") > 0)).select("template").distinct().withColumn("hit", F.lit(True))
    return official.select("template").join(hit, "template", "left").select("template", F.coalesce("hit", F.lit(False)).alias("covered"))
