"""Benchmark decontamination with training suffix arrays.

Every Arrow batch of documents is a shard. A shard's suffix array holds its word
suffixes in lexicographic order; it is sparse: a suffix enters only if its first
words begin some test suffix, as no other can take part in a match. Every suffix of
every test item is then binary-searched in it. The neighbours give the longest
verbatim match; the range of suffixes that share the test suffix's window gives all
occurrences and their places. Words outside the test vocabulary are one symbol that
no test suffix contains, and a text end is a symbol of its own, so that no match
crosses texts.

The driver reads the benchmark in chunks of ``CHUNK_BYTES``; each is a broadcast of its
own. One Python stage reads the documents once: where there are several chunks, a task
holds ``GROUP_BYTES`` of text and one chunk at a time. There is no shuffle.

Consecutive windows of one item at consecutive places are one verbatim match; a
document's longest (of equal ones the first) comes with its place.

Null, empty and word-less texts have no words and are not contaminated. Null, empty and
word-less items match nothing. Repeated item ids count once; an item with a null id is
searched, but is not among the items found. Columns of ``docs`` stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserlog.llm.shared import bounded_batches, free_name
from tesserlog.llm.textops import ALNUM, hash_words, mix, text_buffers

CHUNK_BYTES, GROUP_BYTES = 8_000_000, 32_000_000
#: Words of a suffix that the arrays are sorted by, or as many as a window has; longer matches are followed from the place found.
KEY_WORDS = 32
_END, _OTHER = 1, 2


class TestSuffixes:
    """All suffixes of a chunk of items over a compact alphabet, ready for binary search."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        raw = [t.encode("utf-8", "surrogatepass") for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words, counts = hash_words(np.frombuffer(b"".join(raw), np.uint8), off, ALNUM)
        self.window, self.vocabulary = window, np.unique(words)
        ids = np.searchsorted(self.vocabulary, words).astype(np.uint32) + 3
        self.text, owner, place, left = [], [], [], []
        ends = np.cumsum(counts)
        for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
            self.text.append(ids[end - n : end])
            owner += [i] * n
            place += range(n)
            left += range(n, 0, -1)
        self.items = [k for k, _ in items]
        self.owner, self.place, self.left = (np.array(x, np.int64) for x in (owner, place, left))
        whole = counts[self.owner] if len(self.owner) else self.left
        #: Words that an occurrence spans; 0 where the suffix is shorter than its item's window.
        self.span = np.where(self.left >= np.minimum(window, whole), np.minimum(window, whole), 0)
        self.ids = ids
        self.words = max(KEY_WORDS, window)
        self.keys = suffix_keys(ids, np.arange(len(ids)), self.left, self.words)
        heads = np.minimum(3, np.maximum(self.span, 1))
        self.heads = {k: np.unique(head_hash(ids, np.flatnonzero((heads == k) & (self.span > 0)), k)) for k in (1, 2, 3)}


def suffix_keys(ids: np.ndarray, at: np.ndarray, left: np.ndarray, words: int) -> np.ndarray:
    """Big-endian bytes of the first words of each suffix; a suffix that ends earlier is padded with the text end."""
    grid = at[:, None] + np.arange(words)
    keys = np.where(np.arange(words) < left[:, None], ids[np.minimum(grid, max(len(ids) - 1, 0))] if len(ids) else 0, _END)
    return np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * words}").ravel()


def head_hash(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = ids[at].astype(np.uint64)
    for j in range(1, k):
        h = mix(h) + ids[np.minimum(at + j, max(len(ids) - 1, 0))].astype(np.uint64)
    return h


class Shard:
    """A sparse suffix array over the words of some texts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tests: TestSuffixes):
        if len(tests.vocabulary) and len(words):
            at = np.minimum(np.searchsorted(tests.vocabulary, words), len(tests.vocabulary) - 1)
            self.ids = np.where(tests.vocabulary[at] == words, at + 3, _OTHER).astype(np.uint32)
        else:
            self.ids = np.full(len(words), _OTHER, np.uint32)
        ends = np.cumsum(counts)
        known = np.flatnonzero(self.ids > _OTHER)
        doc = np.searchsorted(ends, known, "right")
        left = ends[doc] - known
        keep = np.zeros(len(known), bool)
        for k, hashes in tests.heads.items():
            if len(hashes):
                able = np.flatnonzero(left >= k)
                h = head_hash(self.ids, known[able], k)
                keep[able] |= hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
        self.at, self.doc, self.left = known[keep], doc[keep], left[keep]
        keys = suffix_keys(self.ids, self.at, self.left, tests.words)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.doc, self.left = keys[order], self.at[order], self.doc[order], self.left[order]
        self.tests = tests

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, suffix array entry) of every occurrence of a window."""
        t = self.tests
        sought = np.flatnonzero(t.span)
        if not len(sought) or not len(self.at):
            return sought[:0], sought[:0]
        out_t, out_s = [], []
        for span in np.unique(t.span[sought]):
            mine = sought[t.span[sought] == span]
            cut = f"S{4 * span}"
            # the array is sorted by longer keys, so it is sorted by their first words too
            have = np.ascontiguousarray(self.keys.view(np.uint8).reshape(len(self.keys), -1)[:, : 4 * span]).view(cut).ravel()
            want = np.ascontiguousarray(t.keys[mine].view(np.uint8).reshape(len(mine), -1)[:, : 4 * span]).view(cut).ravel()
            lo, hi = np.searchsorted(have, want, "left"), np.searchsorted(have, want, "right")
            n = hi - lo
            out_t.append(np.repeat(mine, n))
            out_s.append(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
        return np.concatenate(out_t), np.concatenate(out_s)

    def longest(self, ids: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """For each test suffix the longest verbatim match in the shard, and the array entry that has it (-1: none of ``least`` words).

        Of equally long ones the text of least id (``ids``, by text), then its first place.
        """
        t = self.tests
        best, where = np.zeros(len(t.keys), np.int64), np.full(len(t.keys), -1)
        if not len(self.at) or not len(t.keys):
            return best, where
        have, want = (k.view(np.uint8).reshape(len(k), -1, 4) for k in (self.keys, t.keys))
        mid = np.searchsorted(self.keys, t.keys)
        for j in (mid - 1, mid):
            for some in np.array_split(np.flatnonzero((j >= 0) & (j < len(self.at))), len(t.keys) // 4096 + 1):
                same = (have[j[some]] == want[some]).all(2)
                shared = np.where(same.all(1), same.shape[1], np.argmin(same, 1))
                shared = np.minimum(shared, np.minimum(self.left[j[some]], t.left[some]))
                best[some] = np.maximum(best[some], shared)

        def common(i: int, j: int) -> int:
            n = min(self.left[j], t.left[i])
            apart = np.flatnonzero(self.ids[self.at[j] : self.at[j] + n] != t.ids[i : i + n])
            return int(apart[0]) if len(apart) else int(n)

        rank = np.lexsort((self.at, ids[self.doc]))
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        for i in np.flatnonzero(best >= max(1, min(least, t.words))).tolist():
            lo, hi = self._range(i, int(best[i]))
            some = np.arange(lo, hi)
            if best[i] >= t.words:  # more words than the keys hold may stand anywhere among equal keys
                far = np.array([common(i, j) for j in range(lo, hi)])
                best[i], some = far.max(), some[far == far.max()]
            if best[i] >= least:
                where[i] = some[np.argmin(order[some])]
        return best, where

    def _range(self, i: int, words: int) -> tuple[int, int]:
        """Array entries that begin with the first words of test suffix i."""
        low = self.tests.keys[i : i + 1].view(np.uint8).reshape(1, -1).copy()
        high = low.copy()
        low[:, 4 * words :], high[:, 4 * words :] = 0, 255
        kind = self.keys.dtype
        return int(np.searchsorted(self.keys, low.view(kind).ravel())[0]), int(np.searchsorted(self.keys, high.view(kind).ravel(), "right")[0])

    def matches(self, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first word in it, words, item) of every verbatim match of a window or more."""
        t, s = self.occurrences()
        if not len(t):
            return s, s, s, s
        doc, owner = self.doc[s], self.tests.owner[t]
        at = self.at[s] - (np.cumsum(counts) - counts)[doc]
        apart = at - self.tests.place[t]
        order = np.lexsort((at, apart, owner, doc))
        doc, owner, at, apart, span = doc[order], owner[order], at[order], apart[order], self.tests.span[t][order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (apart[1:] != apart[:-1]) | (at[1:] != at[:-1] + 1))
        first = np.flatnonzero(new)
        return doc[first], at[first], np.diff(np.append(first, len(at))) + span[first] - 1, owner[first]


def _lists(doc: np.ndarray, values: pa.Array, rows: int) -> pa.Array:
    """A list for each of ``rows`` texts; ``doc`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(rows + 1)), pa.int32()), values)


def _places(counts: np.ndarray, found: list[tuple]) -> pa.Array:
    """The struct of ``find_contamination`` from matches (text, first word, words, item name)."""
    rows = len(counts)
    doc, at, words = (np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in range(3))
    names = [n for f in found for n in f[3]]
    # intervals of one text, merged: places are moved apart by text, so that one pass serves all
    step = int(counts.max(initial=0)) + 2
    order = np.argsort(doc * step + at, kind="stable")
    begin, end = (doc * step + at)[order], np.maximum.accumulate((doc * step + at + words)[order])
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1])) if len(begin) else order
    last = np.append(new[1:], len(begin)) - 1 if len(begin) else order
    of = begin[new] // step
    best = np.lexsort((at, -words, doc))
    best = best[np.append(True, doc[best][1:] != doc[best][:-1])] if len(best) else best
    longest, place, none = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.ones(rows, bool)
    longest[doc[best]], place[doc[best]], none[doc[best]] = words[best], at[best], False
    items = sorted({(int(d), n) for d, n in zip(doc.tolist(), names) if n is not None})
    columns = [
        pa.array(counts.astype(np.int64)), _lists(of, pa.array(begin[new] - of * step), rows), _lists(of, pa.array(end[last] - of * step), rows),
        _lists(np.array([d for d, _ in items], np.int64), pa.array([n for _, n in items], pa.string()), rows), pa.array(longest), pa.array(place, mask=none),
    ]
    return pa.StructArray.from_arrays(columns, ["n_words", "hit_from", "hit_to", "items", "longest", "longest_at"])


_PLACES = "struct<n_words:bigint,hit_from:array<bigint>,hit_to:array<bigint>,items:array<string>,longest:bigint,longest_at:bigint>"


class Chunks:
    """The benchmark in the tasks: one chunk at a time, the only one kept."""

    def __init__(self, bench: DataFrame, item_col: str, text_col: str, window: int):
        context = bench.sparkSession.sparkContext
        self.window, self.parts = window, [context.broadcast(c) for c in _chunks(bench, item_col, text_col)]
        self.kept: TestSuffixes | None = None

    def __iter__(self) -> Iterator[TestSuffixes]:
        for part in self.parts:
            if self.kept is None or len(self.parts) > 1:
                self.kept = TestSuffixes(part.value, self.window)
                part.__dict__.pop("_value", None)  # the suffixes are enough
            yield self.kept

    def groups(self, batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[list[tuple]]:
        """(batch, words, words of each text): single batches for one chunk, else as many as hold ``GROUP_BYTES``."""
        held, size = [], 0
        for batch in batches:
            data, off = text_buffers(batch.column(text_at))
            held.append((batch, *hash_words(data, off, ALNUM)))
            size += len(data)
            if len(self.parts) < 2 or size > GROUP_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def _chunks(bench: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, str]]]:
    """Items in chunks of bounded bytes; one task's rows at a time come to the driver."""
    rows, held = [], 0
    for r in bench.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(text_col)).distinct().toLocalIterator():
        rows.append((r[0], r[1]))
        held += len(r[1])
        if held > CHUNK_BYTES:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def find_contamination(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """``docs`` with a last column ``__places`` (or a free name like it): struct of n_words, merged word intervals [hit_from, hit_to), item ids found, words and first word of the longest match."""
    chunks, at = Chunks(bench, item_col, item_text_col, window), docs.columns.index(text_col)
    out = free_name(docs, "__places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in chunks.groups(batches, at):
            found: list[list[tuple]] = [[] for _ in group]
            for tests in chunks:
                for k, (_, words, counts) in enumerate(group):
                    doc, begin, length, item = Shard(words, counts, tests).matches(counts)
                    if len(doc):
                        found[k].append((doc, begin, length, [tests.items[i] for i in item.tolist()]))
            for (batch, _, counts), mine in zip(group, found):
                yield pa.RecordBatch.from_arrays([*batch.columns, _places(counts, mine)], names=[*batch.schema.names, out])

    return bounded_batches(docs).mapInArrow(run, docs.withColumn(out, F.lit(None).cast(_PLACES)).schema)


def _hit(p: Column) -> Column:
    return F.aggregate(F.zip_with(p["hit_to"], p["hit_from"], lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """The result of ``find_contamination`` with n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), longest_match and longest_at.

    They take the place of columns of these names.
    """
    p = F.col(found.columns[-1])
    hit = _hit(p)
    return found.withColumns({
        "n_words": p["n_words"],
        "n_hit": hit,
        "n_items": F.size(p["items"]).cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", p["items"]), 256),
        "contaminated": (hit > 0) & (share * hit >= p["n_words"]),
        "longest_match": p["longest"],
        "longest_at": p["longest_at"],
    })


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = 13, share: int = 20, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    found = find_contamination(docs, bench, text_col, item_col, item_text_col, window)
    p = F.col(found.columns[-1])
    return found.where(~((_hit(p) > 0) & (share * _hit(p) >= p["n_words"]))).drop(found.columns[-1])


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 1) -> DataFrame:
    """The longest verbatim match of every test suffix over all shards: item_id, suffix (word index), words, doc_id, doc_word.

    Suffixes without a match of ``least`` words have no row. Ties go to the least document id (a null one last), then the first place.
    """
    chunks = Chunks(bench, item_col, item_text_col, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in chunks.groups(batches, 1):
            for tests in chunks:
                for batch, words, counts in group:
                    shard = Shard(words, counts, tests)
                    ids = batch.column(0).to_pylist()
                    best, where = shard.longest(np.array([np.iinfo(np.int64).max if x is None else x for x in ids], np.int64), least)
                    i = np.flatnonzero(where >= 0)
                    doc = shard.doc[where[i]]
                    yield pa.RecordBatch.from_pydict({
                        "item_id": pa.array([tests.items[k] for k in tests.owner[i]], pa.string()), "suffix": tests.place[i], "words": best[i],
                        "doc_id": pa.array([ids[d] for d in doc], pa.int64()), "doc_word": shard.at[where[i]] - (np.cumsum(counts) - counts)[doc],
                    })

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = bounded_batches(texts).mapInArrow(run, "item_id string, suffix long, words long, doc_id long, doc_word long")
    best = F.max_by(F.struct("doc_id", "doc_word"), F.struct("words", (-F.col("doc_id")).alias("i"), (-F.col("doc_word")).alias("w")))
    return out.groupBy("item_id", "suffix").agg(F.max("words").alias("words"), best.alias("b")).select("item_id", "suffix", "words", "b.doc_id", "b.doc_word")
