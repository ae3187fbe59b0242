"""Exact quantiles without gathering a column in one task, and running totals over sorted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a histogram pass, and rows of a cell that the driver may read.
CELLS, READ = 1024, 4096


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float] | None:
    """The quantiles by linear interpolation, None without values. Nulls and NaN do not count.

    Every pass counts the values of the cells that still hold a sought rank (aggregates of at most ``CELLS`` rows for
    each) and goes on inside them, until a cell has one value or few rows, which are read.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    whole = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not whole["n"]:
        return None
    ranks = sorted({r for p in shares for r in (int(p * (whole["n"] - 1)), min(int(p * (whole["n"] - 1)) + 1, whole["n"] - 1))})
    found: dict[int, float] = {}
    # (least value, largest value, rows below it, rows in it) of the cells to look into, with the ranks sought there
    cells = {(whole["lo"], whole["hi"], 0, whole["n"]): ranks}
    while cells:
        open_ = {}
        for (lo, hi, below, n), sought in cells.items():
            if lo == hi:
                found |= dict.fromkeys(sought, lo)
            elif n <= READ:
                values = sorted(r["x"] for r in x.where(F.col("x").between(lo, hi)).collect())
                found |= {r: values[r - below] for r in sought}
            else:
                open_[lo, hi, below, n] = sought
        cells = {}
        if not open_:
            break
        which, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi, _, _) in enumerate(open_):
            inside, step = F.col("x").between(lo, hi), (hi / CELLS - lo / CELLS) or 5e-324
            which = F.when(inside, i).otherwise(which)
            cell = F.when(inside, F.least(F.floor((F.col("x") - lo) / step), F.lit(CELLS - 1)).cast("int")).otherwise(cell)
        counted = x.select("x", which.alias("i"), cell.alias("c")).where("i is not null").groupBy("i", "c").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        parts: dict[int, list] = {}
        for r in counted.collect():
            parts.setdefault(r["i"], []).append((r["lo"], r["hi"], r["n"]))
        for i, ((_, _, below, _), sought) in enumerate(open_.items()):
            for lo, hi, n in sorted(parts[i]):
                mine = [r for r in sought if below <= r < below + n]
                if mine:
                    cells[lo, hi, below, n] = mine
                below += n
    out = []
    for p in shares:
        at = p * (whole["n"] - 1)
        a, b = found[int(at)], found[min(int(at) + 1, whole["n"] - 1)]
        out.append(a + (b - a) * (at - int(at)))
    return out


def with_totals_below(df: DataFrame, order: str, sums: Sequence[str], parts: int = 256) -> DataFrame:
    """Adds below_<c>, the total of each of ``sums`` over smaller values of ``order``, which is unique.

    The values are cut at approximate quantiles: a window runs inside a part, and the totals of at most ``parts`` parts are summed in front of it.
    """
    edges = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part: Column = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>"), lambda e: e <= F.col(order)))
    cut = df.withColumn("__part", part)
    totals = cut.groupBy("__part").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    offsets = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{c}") for c in sums])
    joined = run.join(F.broadcast(offsets), "__part")
    return joined.select(*df.columns, *[(F.col(f"__{c}") + F.col(f"__in_{c}")).alias(f"below_{c}") for c in sums])
