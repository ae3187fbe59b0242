"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors, first by a hash of the id) the neighbour
graph is computed and cut into parts of equal size by recursive bisection: a spectral
split at the median, then balanced swaps that lower the cut. The number of parts is a
power of two that grows with the square root of the table's rows, ``PARTS`` at most. A small
network learns, on three quarters of the sample, which parts hold a vector's neighbours.
Every vector is indexed in its most probable part under a bias for each part that makes
the parts of the sample equally large; a query goes to its several most probable parts,
whose vectors are all reranked by exact inner product in double precision.

How many parts a query visits is set on the last quarter: the least number that finds
``TARGET`` of its true neighbours, and for each query as many more as it takes to hold
the neighbours asked for. Parts are dealt out in blocks of bounded rows, for vectors
and queries alike, so a part that holds a third of all vectors is many tasks; equal
vectors of a block are scored once. All vectors that may reach a query's k-th best inner
product are scored again one by one, so that ties are ties and go to the smaller id.

Vectors that are null, zero, of another length than most, or with null or non-finite
components take no part, and so do rows with a null id. Rows with the query's id are its
own and not candidates. Other repeated ids are rows of their own: each has a ranking as a
query, and each takes a place as a candidate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserlog.llm.shared import written

SAMPLE, PARTS, GRAPH, TARGET = 8192, 128, 16, 0.94
#: Rows of a block, and scores of a slice of its product.
BLOCK, CELLS = 32768, 1 << 22


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows by inner product, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        part = np.argpartition(-s, k - 1, 1)[:, :k]
        out[i : i + 1024] = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), 1, kind="stable"), 1)
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Recursive bisection into ``parts`` (a power of two) parts whose sizes differ by one at most for each level."""
    n, k = graph.shape
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    u, v = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()]), np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    while parts > 1:
        inside = part[u] == part[v]
        a, b = u[inside], v[inside]
        degree = np.maximum(1, np.bincount(a, minlength=n))
        f = rng.normal(size=n)
        for _ in range(60):  # all parts at once: second vector of the lazy walk of each
            f -= (np.bincount(part, f * degree) / np.bincount(part, degree))[part]
            f = 0.5 * f + 0.5 * np.bincount(a, f[b], n) / degree
            f /= np.sqrt(np.bincount(part, f * f) + 1e-30)[part]
        order = np.lexsort((f, part))
        sizes = np.bincount(part)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        side = (place >= (sizes[part] + 1) // 2).astype(np.int64)
        for _ in range(8):
            gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
            moved = False
            for p in range(len(sizes)):
                mine = np.flatnonzero(part == p)
                x, y = mine[side[mine] == 0], mine[side[mine] == 1]
                x, y = x[np.argsort(-gain[x], kind="stable")], y[np.argsort(-gain[y], kind="stable")]
                m = min(len(x), len(y))
                swap = int((gain[x[:m]] + gain[y[:m]] > 2).sum()) // 2
                if swap:
                    side[x[:swap]], side[y[:swap]], moved = 1, 0, True
            if not moved:
                break
        part = part * 2 + side
        parts //= 2
    return part


class Router:
    """A two-layer network from a vector to the probabilities of the parts."""

    def __init__(self, x: np.ndarray, want: np.ndarray, units: int = 96, steps: int = 900, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, c = x.shape[1], want.shape[1]
        self.scale = 1 / max(1e-12, float(np.abs(x).mean()))
        w = [rng.normal(0, d**-0.5, (d, units)), np.zeros(units), rng.normal(0, units**-0.5, (units, c)), np.zeros(c)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        self.w = w
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), 512)
            xi = x[pick] * self.scale
            h = np.tanh(xi @ w[0] + w[1])
            d2 = (self._soft(h @ w[2] + w[3]) - want[pick]) / len(pick)
            dh = d2 @ w[2].T * (1 - h * h)
            for i, g in enumerate((xi.T @ dh, dh.sum(0), h.T @ d2, d2.sum(0))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                w[i] -= 0.01 * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)

        self.bias = np.zeros(c)
        z = self._logits(x)
        for t in range(200):  # equal first choices: a part that has too many rows costs more
            size = np.bincount((z + self.bias).argmax(1), minlength=c)
            self.bias -= 0.3 * 0.98**t * np.log((size + 1) / (len(x) / c + 1))

    @staticmethod
    def _soft(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        """Each row is computed by itself, so that equal vectors get equal parts."""
        h = np.tanh(np.einsum("nd,du->nu", x * self.scale, self.w[0]) + self.w[1])
        return np.round(np.einsum("nu,uc->nc", h, self.w[2]), 9) + self.w[3]

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability, for a query."""
        return np.argsort(-self._logits(x), 1, kind="stable")

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that a vector is indexed in."""
        return (self._logits(x) + self.bias).argmax(1)


def fit(x: np.ndarray, parts: int, k: int) -> tuple[Router, int]:
    """(router, parts to visit) from the sample."""
    graph = neighbour_graph(x, max(GRAPH, k))
    part = balanced_parts(graph[:, :GRAPH], parts)
    want = np.zeros((len(x), parts))
    for j in range(graph.shape[1]):
        np.add.at(want, (np.arange(len(x)), part[graph[:, j]]), 1.0)
    learns = np.arange(len(x)) % 4 != 3 if len(x) >= 64 else np.ones(len(x), bool)
    router = Router(x[learns], (want / want.sum(1, keepdims=True))[learns])
    asks = ~learns if not learns.all() else learns
    place = np.argsort(router.order(x[asks]), 1)
    # the place, in each query's order, of the part in which each true neighbour is indexed
    reach = np.take_along_axis(place, router.home(x)[graph[asks, :k]], 1)
    found = np.cumsum(np.bincount(reach.ravel(), minlength=parts)) / reach.size
    return router, int(np.searchsorted(found, TARGET)) + 1


_FOUND = "query_row long, query_id long, vec_id long, score double"


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query of a block."""
    names = ["query_row", "query_id", "vec_id", "score"]
    if not len(queries) or not len(rows):
        return pd.DataFrame({n: np.zeros(0, float if n == "score" else np.int64) for n in names})
    rows = rows.sort_values("id", kind="stable")
    distinct, of = np.unique(np.stack(rows["v"].to_numpy()).astype(np.float64), axis=0, return_inverse=True)
    ids = rows["id"].to_numpy(np.int64)[np.argsort(of.ravel(), kind="stable")]
    count = np.bincount(of.ravel())
    begin = np.cumsum(count) - count
    q = np.stack(queries["v"].to_numpy()).astype(np.float64)
    row, qid = queries["row"].to_numpy(np.int64), queries["id"].to_numpy(np.int64)
    # sums of products in another order differ by less than this
    slack = 1e-14 * q.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(distinct, axis=1).max()
    out = []
    step = max(1, CELLS // len(distinct))
    for i in range(0, len(q), step):
        s = q[i : i + step] @ distinct.T
        if len(distinct) > k + 1:
            least = np.partition(s, len(distinct) - k - 1, 1)[:, len(distinct) - k - 1]
            asked, cand = np.nonzero(s >= (least - slack[i : i + step])[:, None])
        else:
            asked, cand = np.nonzero(np.ones(s.shape, bool))
        exact = np.concatenate([np.einsum("ij,ij->i", q[i + a], distinct[c]) for a, c in zip(np.array_split(asked, len(asked) // 65536 + 1), np.array_split(cand, len(cand) // 65536 + 1))])
        cuts = np.searchsorted(asked, np.arange(len(s) + 1))
        for r in range(len(s)):
            mine, value = cand[cuts[r] : cuts[r + 1]], exact[cuts[r] : cuts[r + 1]]
            many = np.minimum(count[mine], 2 * k + 1 if len(ids) > len(distinct) else 1)  # of equal vectors the least ids are enough
            vec = ids[np.repeat(begin[mine], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            value = np.repeat(value, many)
            ok = vec != qid[i + r]
            vec, value = vec[ok], value[ok]
            o = np.lexsort((vec, -value))[:k]
            out.append((np.full(len(o), row[i + r]), np.full(len(o), qid[i + r]), vec[o], value[o]))
    return pd.DataFrame({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(names)})


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    )
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def part_count(rows: int, most: int = PARTS) -> int:
    """The power of two at or under a quarter of the root of ``rows``: both the parts and the rows of one grow with the table."""
    return 1 << max(0, min(most.bit_length(), (math.isqrt(rows) // 4).bit_length()) - 1)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", parts: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by largest inner product, ties to the smaller id.

    is_query: a condition on column ``id``. All rows but the query's own are candidates.
    """
    rows = usable(vectors, id_col, vec_col)
    total = rows.count()
    # a share of the hash range that holds the sample with rows to spare, so that tasks do not each send a whole sample
    share = min(1.0, 2.0 * sample / max(1, total))
    near = rows.where(F.xxhash64("id") < int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else rows
    x = near.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(x):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = parts or part_count(total, min(PARTS, max(1, sample // 64)))
    if len(x) > 1:
        router, visits = fit(np.stack(x["v"].to_numpy()), parts, min(k, len(x) - 1))
    else:
        router, visits, parts = None, 1, 1

    def route(batches):
        for b in batches:
            v = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, 1))
            known = router is not None and len(b)
            order, home = (router.order(v), router.home(v)) if known else (np.zeros((len(b), 1), np.int64), np.zeros(len(b), np.int64))
            yield b.assign(parts=list(order), part=home)

    index = rows.mapInPandas(route, "id long, v array<double>, parts array<int>, part int").withColumn("row", F.monotonically_increasing_id())
    index = written(index, "ann-index")
    size = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    blocks = {p: -(-n // BLOCK) for p, n in size.items()}
    spark = rows.sparkSession
    # a query visits parts in its order until it has seen ``visits`` of them and rows for k neighbours and itself
    counts = F.create_map(*[F.lit(x) for p in range(parts) for x in (p, size.get(p, 0))])
    before = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0).cast("long"), lambda a, p: a + counts[p])
    queries = (
        index.where(is_query).select("id", "row", "v", "parts", F.posexplode("parts").alias("i", "part"))
        .where((F.col("i") < visits) | (before <= k))
    )
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    number = spark.createDataFrame([(p, blocks.get(p, 1), max(1, -(-asked.get(p, 0) // BLOCK))) for p in range(parts)], "part int, rb int, qb int")
    number = F.broadcast(number)  # one row for each part
    left = queries.join(number, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"), F.pmod(F.xxhash64("row"), F.col("qb")).cast("int").alias("q"), "id", "row", "v"
    )
    right = index.join(number, "part").select(
        F.col("part").alias("p2"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("rb")).cast("int").alias("r2"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q2"), F.col("id").alias("id2"), F.col("v").alias("v2")
    )
    found = left.groupBy("part", "r", "q").cogroup(right.groupBy("p2", "r2", "q2")).applyInPandas(lambda a, b: _best(a, b.rename(columns={"id2": "id", "v2": "v"}), k), _FOUND)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_exact(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int = 20) -> dict[int, list[int]]:
    """Brute force, for measuring recall."""
    out = {}
    for q in queries:
        s = vectors @ vectors[q]
        o = [j for j in np.lexsort((ids, -s))[: k + 1] if j != q][:k]
        out[int(ids[q])] = [int(ids[j]) for j in o]
    return out
