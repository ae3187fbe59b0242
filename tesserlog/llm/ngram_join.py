"""N-gram Jaccard join: blocked sparse matrix product of document by n-gram incidence.

The incidence matrix A (documents x hashed word n-grams) is cut twice.

1. *Which rows meet.* The n-gram axis is cut by hash range into ``m`` column blocks,
   where ``m`` exceeds the largest symmetric difference that two linked sets of that
   size can have. By the pigeonhole principle a linked pair has at least one column
   block in which its two rows are equal and not empty; all other pairs lie below the
   size-derived bound and are never formed. Each (row, block) is one 64-bit
   fingerprint. Agreements of two rows are counted over fingerprints that at most
   ``COMMON`` rows have, pairs below the bound are dropped, and rows with as many
   common fingerprints as a linked pair must share are joined by a star. The connected
   groups are the diagonal blocks outside which the product is below the bound.
2. *Their product.* Each diagonal block is multiplied, A A', over slices of its
   columns. Overlap counts accumulate slice by slice; a pair whose count plus the
   columns still to come cannot reach its bound is dropped, and the product ends
   early when no pair is open. Inside a diagonal block a slice is held dense, as its
   rows share most of their columns; between blocks nothing is formed. Diagonal blocks
   larger than a task are cut into bands of size, of which only neighbouring ones can
   reach the bound, and these into row blocks whose pairs are separate tasks.

Equal sets are one row (their digest), so copies meet only in aggregates. Fingerprints
of which a single one is more than 1 / ``SHARE`` of all (there are at most ``SHARE``) are
found by counts that the tasks send along, and never meet in one task. Fingerprints are
never stored: a first pass over the texts counts them, a second one sends them to where
they meet, as packed buckets of 12 bytes a fingerprint: the bucket's number stands for the
upper bits, 32 bits follow, then the digest. Chance agreements of shortened fingerprints
only add candidates. Texts are read once more where a bitmap of fixed size says that
their id may be in a diagonal block.

Columns of the input other than id and text are not read. Null, empty and word-less
texts have an empty set and link with nothing. Rows with a null id get a row of the
result with a null component. An id that occurs twice counts as two rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserlog.llm.shared import bounded_batches, connected_components, free_name, id_sieve, sift, written
from tesserlog.llm.textops import BLANK_SPLIT, hash_words, mix, slices, text_buffers

ROWS_PER_BLOCK, CELLS_PER_BLOCK = 2000, 1_000_000
FLUSH, STRIP = 1_000_000, 256
#: Fingerprints of a bucket, about; a task holds one bucket at a time.
KEYS_PER_BUCKET = 1 << 17
#: Blocks in which linked rows of more than a few n-grams agree at least, and the rows of a fingerprint from which it is common.
SPARE, COMMON, SHARE = 4, 8, 4096
#: kind 0: id, digest and size of a row, hash of its text; kind 1: how many fingerprints a task has met; kind 2: a fingerprint
#: and how often a task has met it. Flat, so that a reader holds few rows at a time.
_FACTS = "kind int, a long, b long, n long, t long"


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashed n-grams of each text; a shorter text is one n-gram of all its words."""
    ends = np.cumsum(counts)
    grams = np.zeros(0, np.uint64)
    if len(words) >= size:
        grams = words[: len(words) - size + 1]
        for k in range(1, size):
            grams = mix(grams) + words[k : len(words) - size + 1 + k]
        grams = mix(grams)
    for end, n in zip(ends.tolist(), counts.tolist()):
        begin = end - n
        if n >= size:
            g = np.sort(grams[begin : end - size + 1])
            yield g[np.append(True, g[1:] != g[:-1])]
        elif n:
            h = words[begin : begin + 1]
            for w in words[begin + 1 : end]:
                h = mix(h) + w
            yield mix(mix(h) + np.uint64(n))
        else:
            yield grams[:0]


def digest_of(grams: np.ndarray) -> int:
    return int(mix(np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


class Bands:
    """Size bands. Sets of one band, and of the top of the band below, are cut into the same column blocks."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * max(1.3, 101 / self.percent))))
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def blocks(self, band: int) -> tuple[int, int]:
        """(number of column blocks, blocks in which a linked pair at least agrees)."""
        self.of(self.lows[min(band, len(self.lows) - 1)])
        while len(self.lows) <= band + 1:
            self.of(self.lows[-1])
        most = self.lows[band + 1] - 1
        apart = 2 * most * (100 - self.percent) // (100 + self.percent)
        spare = SPARE + apart // 5 if apart > 3 else 1
        return apart + spare, spare

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Fingerprints of the row's column blocks, for each band in which a partner can be."""
        size = len(grams)
        band = self.of(size)
        bands = [band] + [band + 1] * (100 * size // self.percent >= self.lows[band + 1])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams), dtype=np.uint64)])
        out = []
        for b in bands:
            m, spare = self.blocks(b)
            edges = (np.arange(1, m, dtype=np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF // m))
            cuts = np.concatenate([[0], np.searchsorted(grams, edges), [size]])
            key = mix(total[cuts[1:]] - total[cuts[:-1]]) + mix(np.arange(m, dtype=np.uint64) + np.uint64(b << 40))
            full = cuts[1:] > cuts[:-1]
            # blocks that are empty in both rows agree too; rows with few of them still share SPARE others
            key = mix(key[full] if (~full).sum() <= max(0, spare - SPARE) else key)
            out.append(key & ~np.uint64(1) | np.uint64(spare > 1))  # the last bit: several blocks agree
        return np.concatenate(out)


def _facts(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, held = Bands(percent), set(), []
        schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("t", pa.int64())])

        def facts(kind: int, *columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *columns], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys = np.concatenate(held)
                held.clear()
                none = pa.nulls(1, pa.int64())
                yield facts(1, none, none, pa.array([len(keys)], pa.int64()), none)
                keys.sort()
                begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                often = np.diff(np.append(begin, len(keys)))
                begin, often = begin[often > COMMON], often[often > COMMON]
                none = pa.nulls(len(begin), pa.int64())
                yield facts(2, pa.array(keys[begin].view(np.int64)), none, pa.array(often), none)

        cells = 0
        for batch in (part for whole in batches for part in slices(whole, 1)):
            data, off = text_buffers(batch.column(1))
            words, counts = hash_words(data, off, BLANK_SPLIT)
            digests, sizes = [], []
            for grams in shingle_sets(words, counts, size):
                digests.append(digest_of(grams) if len(grams) else None)
                sizes.append(len(grams))
                if len(grams) and digests[-1] not in seen:
                    seen.add(digests[-1])
                    held.append(bands.keys(grams))
                    cells += len(held[-1])
            yield facts(0, batch.column(0).cast(pa.int64()), pa.array(digests, pa.int64()), pa.array(sizes, pa.int64()), batch.column(2))
            if cells > FLUSH:
                yield from flush()
                cells = 0
        yield from flush()

    return run


def _packed(size: int, percent: int, bits: int, hot: np.ndarray):
    """The fingerprints of all texts with their digests, by bucket (the upper ``bits``): the 32 bits that follow, the last of them the fingerprint's own last bit.

    Those among ``hot`` go whole, to negative buckets that deal them out evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, held = Bands(percent), set(), []

        def blobs(buckets: np.ndarray, begin: np.ndarray, keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = np.append(begin, len(keys))

            def binary(x: np.ndarray) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

            whole = pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), binary(keys), binary(nodes)], names=["bucket", "keys", "nodes"])
            for i in range(0, len(begin), 2048):
                yield whole.slice(i, 2048)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys = np.concatenate([k for k, _ in held])
                nodes = np.repeat(np.array([d for _, d in held], np.int64), [len(k) for k, _ in held])
                held.clear()
                often = np.isin(keys, hot)
                if often.any():
                    begin = np.arange(0, int(often.sum()), 4096)
                    yield from blobs(-1 - (nodes[often][begin] & 0xFFFFF), begin, keys[often], nodes[often])
                    keys, nodes = keys[~often], nodes[~often]
                order = np.argsort(keys)
                keys, nodes = keys[order], nodes[order]
                buckets = (keys >> np.uint64(64 - bits)).astype(np.int32)
                begin = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])[: len(keys)])
                low = (keys >> np.uint64(32 - bits)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | (keys & np.uint64(1)).astype(np.uint32)
                yield from blobs(buckets[begin], begin, low, nodes)

        cells = 0
        for batch in (part for whole in batches for part in slices(whole, 1)):
            for grams in shingle_sets(*hash_words(*text_buffers(batch.column(1)), BLANK_SPLIT), size):
                digest = digest_of(grams) if len(grams) else None
                if len(grams) and digest not in seen:
                    seen.add(digest)
                    held.append((bands.keys(grams), digest))
                    cells += len(held[-1][0])
            if cells > FLUSH:
                yield from flush()
                cells = 0
        yield from flush()

    return run


def _pair_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows come sorted by bucket. Distinct rows of a run of up to ``COMMON`` equal keys give their pairs, a longer run gives its rows.

    kind 0: a pair of which several blocks must agree; 1: a row of a long run; 2: a pair of which one block is enough;
    3: a row of a fingerprint that did not meet here. One bucket is held at a time.
    """

    def out(kind: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(v)], names=["kind", "u", "v"])

    def settled(bucket: int, held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        nodes = np.frombuffer(b"".join(n for _, n in held), np.int64)
        if bucket < 0:
            for i in range(0, len(held), 8):
                part = held[i : i + 8]
                yield out(3, np.frombuffer(b"".join(k for k, _ in part), np.int64), np.frombuffer(b"".join(n for _, n in part), np.int64))
            return
        low = np.frombuffer(b"".join(k for k, _ in held), np.uint32)
        order = np.lexsort((nodes, low))
        low, nodes = low[order], nodes[order]
        new = np.append(True, (low[1:] != low[:-1]) | (nodes[1:] != nodes[:-1]))
        keys, nodes = low[new].astype(np.int64) | bucket << 32, nodes[new]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        length = np.diff(np.append(begin, len(keys)))
        many = np.repeat(length > COMMON, length)
        yield out(1, keys[many], nodes[many])
        for d in range(1, min(COMMON, len(keys))):
            at = np.flatnonzero((keys[d:] == keys[:-d]) & ~many[d:])
            if not len(at):
                break
            several = keys[at] & 1 == 1
            yield out(0, nodes[at + d][several], nodes[at][several])
            yield out(2, nodes[at + d][~several], nodes[at][~several])

    now, held = 0, []
    for batch in batches:
        for bucket, keys, nodes in zip(*(c.to_pylist() for c in batch.columns)):
            if held and bucket != now:
                yield from settled(now, held)
                held = []
            now = bucket
            held.append((keys, nodes))
    if held:
        yield from settled(now, held)


def _candidates(texts: DataFrame, facts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges between rows that may link, from (id, text) and what ``_facts`` has counted over them.

    A linked pair agrees in ``SPARE`` blocks or more. Agreements in fingerprints that
    few rows have are counted by pair; those in common fingerprints are at most as many
    as either row has of them. A pair below the bound by this count goes. Rows with
    ``SPARE`` or more common fingerprints may link by these alone and are joined to one
    of their holders. Fingerprints without the last bit set join always.
    """
    total = facts.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    met_often = facts.where("kind = 2").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > max(COMMON, total // SHARE))
    hot = np.array([r["a"] for r in met_often.collect()], np.int64).view(np.uint64)
    bits = min(16, max(8, (total // KEYS_PER_BUCKET).bit_length()))
    packed = texts.mapInArrow(_packed(size, percent, bits, hot), "bucket int, keys binary, nodes binary")
    met = written(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pair_stream, "kind int, u long, v long"), "ngram-met")
    row = F.col("u").alias("key"), F.col("v").alias("node")
    rows = written(met.where("kind = 1").select(*row).union(met.where("kind = 3").select(*row).distinct()), "ngram-common")
    several = F.col("key").bitwiseAND(F.lit(1)) == 1
    able = rows.groupBy("node").agg(F.count(F.when(several, 1)).alias("n"))
    common = rows.join(able, "node").where(~several | (F.col("n") >= SPARE)).select("key", "node")
    common = written(common, "ngram-common")
    centre = written(common.groupBy("key").agg(F.min("node").alias("v")), "ngram-centre")
    star = common.join(centre, "key").select(F.col("node").alias("u"), "v").where("u <> v")
    pairs = met.where("kind = 0").groupBy("u", "v").agg(F.count("*").alias("agree"))
    more = lambda c: able.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    most = F.col("agree") + F.least(F.coalesce("n_u", F.lit(0)), F.coalesce("n_v", F.lit(0)))
    near = pairs.join(more("u"), "u", "left").join(more("v"), "v", "left").where(most >= SPARE).select("u", "v")
    return near.union(star).union(met.where("kind = 2").select("u", "v"))


def overlaps_reach(rows: list[np.ndarray], split: int, percent: int, slice_columns: int = 2048) -> np.ndarray:
    """Which pairs (row below ``split``, row from ``split``; all with all where split is 0) link: A A' by column slices."""
    n = len(rows)
    sizes = np.array([len(r) for r in rows], np.int64)
    top, low = (slice(0, n), slice(0, n)) if not split else (slice(0, split), slice(split, n))
    columns, column = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    spread = np.bincount(column, minlength=len(columns))
    order = np.argsort(-spread[column], kind="stable")
    # columns of one row alone add to no overlap
    order = order[spread[column[order]] > 1]
    dense = np.full(len(columns), -1)
    used = column[order]
    _, begin = np.unique(used, return_index=True)
    dense[used[np.sort(begin)]] = np.arange(len(begin))
    used = dense[used]
    by_slice = np.argsort(used // slice_columns, kind="stable")
    used, owner = used[by_slice], owner[order][by_slice]
    of_slice = used // slice_columns
    count = np.zeros((len(sizes[top]), len(sizes[low])), np.float32)
    left = np.bincount(owner, minlength=n)

    def strips() -> Iterator[tuple[slice, np.ndarray]]:
        """Some upper rows at a time, and the sums of their sizes with the lower rows' sizes: what is made of them stays small."""
        for i in range(0, len(count), STRIP):
            yield slice(i, i + STRIP), sizes[top][i : i + STRIP, None] + sizes[low]

    def may_reach(rows: slice, both: np.ndarray) -> bool:
        open_ = count[rows] + np.minimum(left[top][rows, None], left[low]) >= -(-percent * both // (100 + percent))
        if split == 0:
            open_[np.arange(len(open_)), np.arange(rows.start, rows.start + len(open_))] = False
        return bool(open_.any())

    for s in range(0, len(begin), slice_columns):
        a, b = np.searchsorted(of_slice, [s // slice_columns, s // slice_columns + 1])
        part = np.zeros((n, min(slice_columns, len(begin) - s)), np.float32)
        part[owner[a:b], used[a:b] - s] = 1
        for rows, _ in strips():
            count[rows] += part[top][rows] @ part[low].T
        left = left - np.bincount(owner[a:b], minlength=n)
        if not any(may_reach(rows, both) for rows, both in strips()):
            break
    links = np.zeros(count.shape, bool)
    for rows, both in strips():
        c = count[rows].astype(np.int64)
        links[rows] = (c >= -(-percent * both // (100 + percent))) & (100 * c >= percent * (both - c))
    return links


def _edges_of(links: np.ndarray, top: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected group of the link matrix, instead of its pairs."""
    out_u, out_v = [], []
    free_top, free_low = np.ones(len(top), bool), np.ones(len(low), bool)
    for i in range(len(top)):
        if not free_top[i]:
            continue
        rows, got_rows, got_cols = np.array([i]), [i], []
        free_top[i] = False
        while len(rows):
            cols = np.flatnonzero(links[rows].any(0) & free_low)
            free_low[cols] = False
            got_cols.extend(cols.tolist())
            rows = np.flatnonzero(links[:, cols].any(1) & free_top) if len(cols) else cols
            free_top[rows] = False
            got_rows.extend(rows.tolist())
        group = np.unique(np.concatenate([top[got_rows], low[got_cols]]))
        if len(group) > 1:
            out_u.append(group[1:])
            out_v.append(np.full(len(group) - 1, group[0]))
    return (np.concatenate(out_u), np.concatenate(out_v)) if out_u else (top[:0], top[:0])


def _product(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, g in pdf.groupby("comp", sort=False):
            g = g.drop_duplicates(["side", "node"]).sort_values("side", kind="stable")
            rows = [np.frombuffer(x, np.uint64) for x in g["grams"]]
            nodes, split = g["node"].to_numpy(np.int64), int((g["side"] == 0).sum())
            if split == 0 or (g["same"].iloc[0] == 0 and split == len(g)):
                continue
            whole = bool(g["same"].iloc[0])
            links = overlaps_reach(rows, 0 if whole else split, percent)
            found.append(_edges_of(links, nodes if whole else nodes[:split], nodes if whole else nodes[split:]))
        u = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        v = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        return pd.DataFrame({"u": u, "v": v})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("text"))):
            words, counts = hash_words(*text_buffers(batch.column("text")), BLANK_SPLIT)
            grams, keep = [], []
            for i, (g, d) in enumerate(zip(shingle_sets(words, counts, size), batch.column("node").to_pylist())):
                if len(g) and digest_of(g) == d:  # an id may stand for several texts
                    keep.append(i)
                    grams.append(g.tobytes())
            if keep:
                rest = batch.select(["node", "comp", "task", "side", "same"]).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(grams, pa.binary())], names=[*rest.schema.names, "grams"])

    return run


def _dealt(members: DataFrame, percent: int) -> DataFrame:
    """(id, node, comp, task, side, same): the tasks that each row of (node, comp, rep, n) takes part in.

    A group that fits a task is one. A larger one is cut by size: rows link within a band of sizes or with the next band,
    as a band is wider than two linked rows can differ. Each band is cut into row blocks by hash; every two blocks of one band
    or of neighbouring bands are a task.
    """
    sized = (F.count("*").alias("n_rows"), F.sum("n").alias("n_cells"))
    blocks = F.greatest(F.ceil(F.col("n_rows") / ROWS_PER_BLOCK), F.ceil(F.col("n_cells") / CELLS_PER_BLOCK)).cast("int")
    whole = members.groupBy("comp").agg(*sized).select("comp", blocks.alias("nb"))
    packs = max(1, -(-(members.agg(F.sum("n")).first()[0] or 0) // CELLS_PER_BLOCK))
    banded = written(members.join(whole, "comp").withColumn("band", F.floor(F.log("n") / math.log(1.001 * 100 / percent))), "ngram-banded")
    small = banded.where("nb = 1").select(
        F.col("rep").alias("id"), "node", "comp", F.pmod(F.xxhash64("comp"), F.lit(packs)).alias("task"), F.lit(0).alias("side"), F.lit(1).alias("same")
    )
    unit = written(banded.where("nb > 1").groupBy("comp", "band").agg(*sized).select("comp", "band", blocks.alias("own")), "ngram-units")
    beside = lambda step, name: unit.select("comp", (F.col("band") + step).alias("band"), F.col("own").alias(name))
    counts = written(unit.join(beside(-1, "above"), ["comp", "band"], "left").join(beside(1, "below"), ["comp", "band"], "left").na.fill(0), "ngram-units")
    large = banded.where("nb > 1").join(counts, ["comp", "band"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))

    def tasks(n: str, of) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), of)
        return F.when(F.col(n) > 0, each).otherwise(F.slice(each, 1, 0))

    def task(low: Column, high: Column, a: Column, b: Column, side: Column, same: Column) -> Column:
        return F.struct(F.xxhash64("comp", low, high, a, b).alias("task"), side.cast("int").alias("side"), same.cast("int").alias("same"))

    band, b, no = F.col("band"), F.col("b"), F.lit(False)
    every = F.concat(
        tasks("own", lambda o: task(band, band, F.least(b, o), F.greatest(b, o), b > o, b == o)),
        tasks("above", lambda o: task(band, band + 1, b, o, no, no)),
        tasks("below", lambda o: task(band - 1, band, o, b, F.lit(True), no)),
    )
    return small.union(large.select(F.col("rep").alias("id"), "node", "comp", F.inline(every)))


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest, n, t) of every row and (digest, comp, component) of every distinct set: its group and the group's least id."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    facts = written(bounded_batches(texts).withColumn("t", F.xxhash64("text")).mapInArrow(_facts(size, percent), _FACTS), "ngram-facts")
    rows = facts.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("digest"), "n", "t")
    near = connected_components(_candidates(texts, facts, size, percent), "ngram-near")

    classes = rows.where("digest is not null and id is not null").groupBy(F.col("digest").alias("node")).agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    members = near.union(near.select(F.col("comp").alias("node"), "comp").distinct()).join(classes, "node")
    members = written(members, "ngram-members")
    dealt = _dealt(members, percent)
    near_texts = sift(texts, id_sieve(members.select(F.col("rep").alias("id"))))
    sets = near_texts.join(dealt, "id").select("node", "comp", "task", "side", "same", "text").mapInArrow(
        _sets(size), "node long, comp long, task long, side int, same int, grams binary"
    )
    links = written(sets.groupBy("task").applyInPandas(_product(percent), "u long, v long"), "ngram-links")
    linked = connected_components(links, "ngram")

    of = linked.union(linked.select(F.col("comp").alias("node"), "comp").distinct())
    least = written(of.join(classes, "node").groupBy("comp").agg(F.min("rep").alias("component")), "ngram-least")
    of = of.join(least, "comp").select("node", "comp", "component")
    by_class = classes.join(of, "node", "left").select(F.col("node").alias("digest"), F.coalesce("comp", "node").alias("comp"), F.coalesce("component", "rep").alias("component"))
    # a written table, so that a digest with many rows can be split over tasks
    return rows, written(by_class, "ngram-classes")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable over links).

    Two rows link when 100 * |intersection| >= percent * |union| of their distinct word n-grams.
    """
    rows, by_class = _classes(docs, id_col, text_col, size, percent)
    out = rows.join(by_class, "digest", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )
    return written(out, "ngram-out")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row of ``docs`` for each group of linked rows: the least id, of its texts the one of least hash, of equal rows any.

    Rows without words and rows with a null id link with nothing and stay, of rows with equal id and text one.
    """
    rows, by_class = _classes(docs, id_col, text_col, size, percent)
    each = rows.where("id is not null").join(by_class.select("digest", "comp"), "digest", "left").groupBy("comp", "id", "t").agg(F.count("*").alias("times"))
    each = written(each, "ngram-each")
    first = written(each.where("comp is not null").groupBy("comp").agg(F.min(F.struct("id", "t")).alias("r")).select("comp", "r.*"), "ngram-first")
    first = first.select("comp", F.col("id").alias("first_id"), F.col("t").alias("first_t"))
    stays = F.col("comp").isNull() | ((F.col("id") == F.col("first_id")) & (F.col("t") == F.col("first_t")))
    each = written(each.join(first, "comp", "left").select("id", "t", "times", stays.alias("stays")), "ngram-stays")
    # only rows whose id belongs to a row that goes are shuffled with their texts
    sieve = written(id_sieve(each.where("not stays or times > 1")), "ngram-sieve")
    keep = sift(each.where("stays").select("id", "t"), sieve)
    keep = keep.select(F.col("id").alias(free_name(docs, "keep_id")), F.col("t").alias(free_name(docs, "keep_text")))
    met = sift(docs, sieve, id_col)
    same = (met[id_col].cast("long") == keep[keep.columns[0]]) & (F.xxhash64(met[text_col].cast("string")) == keep[keep.columns[1]])
    # an inner join: a semi join is moved below the sieve by the optimizer, and then shuffles every text
    kept = met.join(keep, same).drop(*keep.columns).dropDuplicates([id_col, text_col])
    return sift(docs, sieve, id_col, inside=False).union(kept).union(docs.where(F.col(id_col).isNull()))
