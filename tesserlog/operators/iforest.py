"""Isolation forest: trees grown from hash samples, scoring in vectorised batches.

The model is a table of nodes and the least and largest training score, kept as JSON.
Scores are 2 ** (-mean path / c(samples)), brought to [0, 1] by the training ends.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe))


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, depth at a leaf); feature -1 is a leaf."""
    nodes: list[tuple] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(())
        able = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth >= limit or not len(able):
            nodes[at] = (-1, 0.0, 0, 0, depth + float(mean_path(len(rows))))
            return at
        f = int(rng.choice(able))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] < cut
        if left.all() or not left.any():
            left = rows[:, f] <= rows[:, f].min()
        nodes[at] = (f, cut if left.sum() == (rows[:, f] < cut).sum() else float(np.nextafter(rows[:, f].min(), np.inf)), split(rows[left], depth + 1), split(rows[~left], depth + 1), 0.0)
        return at

    split(x, 0)
    return nodes


@dataclass
class Forest:
    columns: list[str]
    trees: list[list[tuple]]
    samples: int
    low: float = 0.0
    high: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for f, cut, left, right, leaf in self._flat():
            at = np.zeros(len(x), np.int64)
            while (f[at] >= 0).any():
                inner = np.flatnonzero(f[at] >= 0)
                k = at[inner]
                at[inner] = np.where(x[inner, f[k]] < cut[k], left[k], right[k])
            depth += leaf[at]
        return 2.0 ** (-depth / len(self.trees) / max(float(mean_path(self.samples)), 1e-9))

    def _flat(self) -> list[tuple]:
        """The trees' columns, made once in each process."""
        if getattr(self, "_columns", None) is None:
            self._columns = [tuple(np.array(c) for c in zip(*nodes)) for nodes in self.trees]
        return self._columns

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in self.__dict__.items() if k != "_columns"})

    @classmethod
    def from_json(cls, text: str) -> "Forest":
        return cls(**json.loads(text))


def fit_forest(features: DataFrame, columns: list[str], trees: int = 100, samples: int = 256, seed: int = 42) -> Forest:
    """Each tree grows on its own hash sample of ``samples`` rows, chosen in the cluster; trees grow in parallel tasks."""
    count = features.count()
    psi = max(1, min(samples, count))
    rows = features.select("block_id", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    # a row enters each tree with a chance that leaves a few spare ones; the least hashes of each tree stay. Tree numbers are
    # filtered in an array, so that a row is only repeated for the trees it enters
    rate = min(1.0, 2.0 * psi / max(count, 1))
    most = int(-(1 << 63) + rate * ((1 << 64) - 1)) if rate < 1 else (1 << 63) - 1
    entered = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("block_id", t, F.lit(seed)).alias("h")))
    picked = rows.select("x", "block_id", F.inline(F.filter(entered, lambda e: e["h"] <= F.lit(most))))
    limit = int(np.ceil(np.log2(max(psi, 2))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "block_id"], kind="stable").head(psi)
        tree = int(pdf["tree"].iloc[0])
        return pd.DataFrame({"tree": [tree], "nodes": [json.dumps(grow(np.stack(pdf["x"].to_numpy()), np.random.default_rng([seed, tree]), limit))]})

    grown = sorted(picked.groupBy("tree").applyInPandas(one, "tree int, nodes string").collect()) if count else []
    forest = Forest(columns, [[tuple(n) for n in json.loads(r["nodes"])] for r in grown], psi)
    if grown:
        ends = score_forest(features, forest, scaled=False).agg(F.min("if_score"), F.max("if_score")).first()
        forest.low, forest.high = float(ends[0]), float(ends[1])
    return forest


def score_forest(features: DataFrame, forest: Forest, scaled: bool = True) -> DataFrame:
    """block_id, if_score. Scaling uses the ends of training, so that a batch of one row means the same."""

    def run(batches):
        for pdf in batches:
            x = pdf[forest.columns].to_numpy(float)
            s = forest.raw(x) if len(x) else np.zeros(0)
            if scaled:
                s = np.clip((s - forest.low) / max(forest.high - forest.low, 1e-12), 0, 1)
            yield pd.DataFrame({"block_id": pdf["block_id"], "if_score": s})

    return features.select("block_id", *[F.col(c).cast("double").alias(c) for c in forest.columns]).mapInPandas(run, f"block_id {features.schema['block_id'].dataType.simpleString()}, if_score double")


def minmax(scores: DataFrame, column: str) -> DataFrame:
    """``column`` brought to [0, 1] by its own ends; 0 where they are equal."""
    ends = scores.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    value = F.coalesce(F.try_divide(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    return scores.join(F.broadcast(ends)).select(*[value.alias(c) if c == column else F.col(c) for c in scores.columns])
