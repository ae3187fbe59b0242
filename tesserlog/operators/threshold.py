"""Threshold from extreme values: peaks over threshold with a generalised Pareto tail."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserlog.operators.patterns import persisted
from tesserlog.operators.quantiles import quantiles


@dataclass
class Threshold:
    threshold: float
    method: str
    q0: float = 0.90
    risk_level: float = 0.01
    shape: float | None = None
    scale: float | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Threshold":
        return cls(**json.loads(text))


#: Candidates of a pass over the tail, and passes after which the interval is below the precision of a double.
GRID, PASSES = 64, 7


def tail_sums(tail: DataFrame, thetas: np.ndarray) -> np.ndarray:
    """The mean of log(1 + theta x) for each theta, summed in the tasks; -inf where it is not defined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(thetas)), 0
        for batch in batches:
            for x in np.array_split(batch.column(0).to_numpy(zero_copy_only=False), batch.num_rows // 4096 + 1):
                with np.errstate(divide="ignore", invalid="ignore"):
                    total += np.log1p(np.outer(x, thetas)).sum(0)
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(thetas)), pa.int32()), pa.array(total), pa.array([n] * len(thetas), pa.int64())], names=["i", "s", "n"])

    rows = tail.select("x").mapInArrow(run, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).collect()
    out = np.full(len(thetas), -np.inf)
    for r in rows:
        out[r["i"]] = r["m"]
    return out


def fit_tail(tail: DataFrame) -> tuple[float, float]:
    """(shape, scale) by maximum likelihood with location 0 of column ``x``, over all rows at every size.

    One-dimensional profile in theta = shape / scale; every pass takes the best of a grid and goes on between its neighbours.
    """
    ends = tail.agg(F.max("x").alias("top"), F.avg("x").alias("mean")).first()
    top, mean = float(ends["top"]), float(ends["mean"])
    thetas = np.concatenate([-np.geomspace(1e-6, 0.999, 60)[::-1] / top, np.geomspace(1e-6, 1e3, 120) / mean])
    for _ in range(PASSES):
        shape = tail_sums(tail, thetas)
        with np.errstate(divide="ignore", invalid="ignore"):
            loss = np.where(shape / thetas > 0, np.log(shape / thetas) + shape + 1, np.inf)
        loss[~np.isfinite(loss)] = np.inf
        best = int(np.argmin(loss))
        theta, found = float(thetas[best]), float(shape[best])
        a, b = thetas[max(0, best - 1)], thetas[min(len(thetas) - 1, best + 1)]
        thetas = np.linspace(a, b, GRID)
        thetas = thetas[np.abs(thetas) > 1e-300]
    return found, found / theta


def tail_threshold(base: float, shape: float, scale: float, share: float, top: float) -> float:
    """The score that a share of the tail's rows lie beyond under the fitted tail, from its start to its largest value; not finite where there is none."""
    over = -scale * np.log(share) if abs(shape) < 1e-6 else scale / shape * (share**-shape - 1)
    return float(base + min(max(over, 0.0), top)) if np.isfinite(over) else float("nan")


def fit_threshold(scores: DataFrame, column: str = "if_score", q0: float = 0.90, risk: float = 0.01, fallback: float = 97.0, least_tail: int = 10) -> Threshold:
    """Peaks over the ``q0`` quantile with a generalised Pareto tail; the ``fallback`` percentile where fewer than ``least_tail`` rows lie beyond or the fit fails."""
    found = quantiles(scores, column, [q0, fallback / 100])
    if found is None:
        return Threshold(0.0, "empty", q0, risk)
    base, simple = found
    tail = scores.where(F.col(column) > base).select((F.col(column).cast("double") - base).alias("x")).where("not isnan(x)")
    plain = Threshold(float(simple), f"percentile_{fallback}", q0, risk)
    counted = scores.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).agg(F.count("*").alias("n"), F.sum((F.col(column) > base).cast("long")).alias("m")).first()
    if (counted["m"] or 0) < least_tail:
        return plain
    with persisted(tail) as kept:
        shape, scale = fit_tail(kept)
        top = float(kept.agg(F.max("x")).first()[0])
    value = tail_threshold(base, shape, scale, risk * counted["n"] / counted["m"], top)
    return Threshold(value, "pot_gpd", q0, risk, shape, scale) if np.isfinite(value) else plain


def label_anomalies(scores: DataFrame, threshold: float, method: str = "pot_gpd", column: str = "if_score") -> DataFrame:
    return scores.withColumns({"is_anomaly": (F.col(column) >= threshold).cast("int"), "threshold": F.lit(float(threshold)), "threshold_method": F.lit(method)})
