"""LM scoring by masked pseudo-likelihood.

A window network reads the ``SIDE`` words on both sides of every position, never the
word itself, and predicts it. A document's score is the sum of the conditional
log-probabilities of all its words.

The network's symbols are the ``NAMED`` most frequent words, counted over all
documents, and ``HASHED`` buckets for the rest; words are runs of letters, digits and
non-ASCII characters, lower-cased A-Z. A word of a bucket has the probability of the
bucket times its share of the bucket's tokens, so that every word of the corpus has its
own: of n tokens and one for unseen words, count / (n + 1), an unseen word as one seen
once. Tasks hold the counts of up to ``LISTED`` frequent words; those of all others are
joined from the count table. Words that are not among the about ``KNOWN`` most frequent are
rare, and all windows of the corpus around rare words, exact words on both sides, are a
memory, counted in the cluster. With c occurrences of the word in its window and C of T
rare words of its bucket there, F being the bucket's rare tokens, count becomes ((c - 1) F
+ T count) / C: one occurrence, the word's own, is taken off each, so that a text which
occurs once gets nothing from itself, and what is taken off goes by the counts, so that
shares still sum to one. The softmax is factored into classes of ``CLASS`` words
of similar frequency. Training goes in ``ROUNDS``, each over a part of the documents by a
hash of their text: every task trains the network in numpy, from where the last round ended,
on all words of the part; the weights are averaged by words seen in a distributed aggregate,
so the driver only ever holds one network. The average of a round depends a little on how
documents are dealt to tasks; every round starts all tasks from one network again.

Null, empty and word-less texts have no words and a log-probability of 0. Repeated rows are
learned from and scored as often as they occur. No column but id and text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserlog.llm.shared import bounded_batches, free_name, written
from tesserlog.llm.textops import ALNUM, hash_words, mix, slices, text_buffers

NAMED, HASHED, CLASS, SIDE, UNITS = 448, 64, 16, 2, 16
SIZE = NAMED + HASHED
KNOWN, LISTED = 32768, 131072
_PAD = SIZE  # stands outside the text
_BATCH, _RATE, ROUNDS = 16384, 0.1, 2


def count_words(texts: DataFrame) -> DataFrame:
    """(h, n) of every word of all documents; a task sends one row for each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def merged():
            words, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return words, np.bincount(at, np.concatenate([h[1] for h in held])).astype(np.int64)

        size = 0
        for batch in (part for whole in batches for part in slices(whole, 0)):
            words, _ = hash_words(*text_buffers(batch.column(0)), ALNUM)
            held.append(np.unique(words, return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [merged()]
                size = 0
                if len(held[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["h", "n"])
                    held = []
        if held:
            words, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["h", "n"])

    return bounded_batches(texts).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """``buckets``: the tokens of each bucket; ``listed``, ``times``: hashes and counts of frequent words of the buckets, of which those with ``known`` or more are not rare."""

    def __init__(self, named: list[int], counts: list[int], total: int, buckets: np.ndarray, listed: np.ndarray, times: np.ndarray, known: float = np.inf):
        order = np.argsort(np.array(named, np.int64).view(np.uint64))
        self.words, self.rank = np.array(named, np.int64).view(np.uint64)[order], order
        start = np.full(SIZE, 1.0)
        start[: len(counts)] += counts
        start[NAMED:] += max(0, total - sum(counts)) / HASHED
        self.start = start / start.sum()
        self.bucket = np.log(buckets + 1.0)
        order = np.argsort(listed.view(np.uint64))
        self.listed, self.times = listed.view(np.uint64)[order], np.log(times[order].astype(np.float64))
        self.common = self.listed[times[order] >= known]
        #: Tokens of rare words in each bucket.
        self.rare = buckets - np.bincount((self.common % np.uint64(HASHED)).astype(np.int64), times[order][times[order] >= known], HASHED).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = NAMED + (hashes % np.uint64(HASHED)).astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            out = np.where(self.words[at] == hashes, self.rank[at], out)
        return out.astype(np.int16)  # sixteen bits sort by radix

    def shares(self, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of each word's share of its symbol, and where that word's count is still to be joined and stands as 1."""
        out, far = np.zeros(len(ids)), ids >= NAMED
        where = np.flatnonzero(far)
        out[where] = -self.bucket[ids[where] - NAMED]
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, hashes[where]), len(self.listed) - 1)
            known = self.listed[at] == hashes[where]
            out[where[known]] += self.times[at[known]]
            far[where[known]] = False
        return out, far


    def rare_at(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places of rare words."""
        where = np.flatnonzero(ids >= NAMED)
        if not len(self.common):
            return where
        at = np.minimum(np.searchsorted(self.common, hashes[where]), len(self.common) - 1)
        return where[self.common[at] != hashes[where]]


class Window:
    """The network: one embedding table for each place around the word, a hidden layer, a class and a member softmax."""

    def __init__(self, start: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        share = start.reshape(-1, CLASS)
        self.past: dict[str, np.ndarray] = {}
        self.p = {
            "e": r.normal(0, 0.1, (2 * SIDE, SIZE + 1, UNITS)).astype(np.float32),
            "wc": r.normal(0, 0.1, (UNITS, SIZE // CLASS)).astype(np.float32),
            "bc": np.log(share.sum(1)).astype(np.float32),
            "wm": r.normal(0, 0.1, (SIZE // CLASS, UNITS, CLASS)).astype(np.float32),
            "bm": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
        }

    def _climb(self, key: str, at, gradient: np.ndarray, rate: float) -> None:
        """Adagrad ascent on part of a parameter."""
        past = self.past.setdefault(key, np.full(self.p[key].shape, 1e-3, np.float32))
        now = past[at] + gradient * gradient
        past[at] = now
        self.p[key][at] += rate * gradient / np.sqrt(now)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> "Window":
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        return self

    def logs(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Log-probability of each target given the words around it."""
        p, n = self.p, len(target)
        order = np.argsort(target, kind="stable")  # members of a class become a run
        target = target[order]
        h = self._hidden(around[:, order])
        cuts = np.searchsorted(target, np.arange(0, SIZE + 1, CLASS))
        x = h @ p["wc"]
        x += p["bc"]
        out = x[np.arange(n), target // CLASS] - _log_sum(x)
        for c in range(SIZE // CLASS):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                x = h[a:b] @ p["wm"][c]
                x += p["bm"][c]
                out[a:b] += x[np.arange(b - a), target[a:b] % CLASS] - _log_sum(x)
        back = np.empty(n, np.float32)
        back[order] = out
        return back

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.p["e"][0][around[0]]
        for k in range(1, 2 * SIDE):
            h += self.p["e"][k][around[k]]
        return np.tanh(h, out=h)

    def learn(self, target: np.ndarray, around: np.ndarray, rate: float) -> None:
        """A step up the gradient of the targets' log-probability."""
        p, n = self.p, len(target)
        order = np.argsort(target, kind="stable")
        target, around = target[order], around[:, order]
        h = self._hidden(around)
        cuts = np.searchsorted(target, np.arange(0, SIZE + 1, CLASS))
        d = _minus_share(h @ p["wc"] + p["bc"])
        d[np.arange(n), target // CLASS] += 1
        dh = d @ p["wc"].T
        self._climb("wc", ..., h.T @ d, rate)
        self._climb("bc", ..., d.sum(0), rate)
        for c in range(SIZE // CLASS):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                d = _minus_share(h[a:b] @ p["wm"][c] + p["bm"][c])
                d[np.arange(b - a), target[a:b] % CLASS] += 1
                dh[a:b] += d @ p["wm"][c].T
                self._climb("wm", c, h[a:b].T @ d, rate)
                self._climb("bm", c, d.sum(0), rate)
        h *= h
        dh -= dh * h
        for k in range(2 * SIDE):
            by = np.argsort(around[k], kind="stable")
            word = around[k][by]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            self._climb("e", (k, word[first]), np.add.reduceat(dh[by], first), rate)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    x = x - top[:, None]
    return np.log(np.exp(x, out=x).sum(1)) + top


def _minus_share(x: np.ndarray) -> np.ndarray:
    """Minus the softmax."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x *= (-1 / x.sum(1))[:, None]
    return x


def surroundings(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(place, position): the words on both sides, within the text."""
    out = np.full((2 * SIDE, len(ids)), _PAD, np.int16)
    ends = np.cumsum(counts)
    for k, step in enumerate(range(1, SIDE + 1)):
        out[SIDE - step, step:] = ids[:-step]
        out[SIDE + k, :-step] = ids[step:]
        for j in range(step):  # the first and last words of a text have fewer around them
            long = counts > j
            out[SIDE - step, (ends - counts)[long] + j] = _PAD
            out[SIDE + k, ends[long] - 1 - j] = _PAD
    return out


def learn_vocabulary(texts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and (h, n) of the words that occur again."""
    counts = written(count_words(texts), "lm-counts")
    top = counts.orderBy(F.desc("n"), "h").limit(NAMED).collect()
    buckets = np.zeros(HASHED, np.int64)
    for r in counts.groupBy(F.pmod("h", F.lit(HASHED)).alias("b")).agg(F.sum("n").alias("n")).collect():
        buckets[r["b"]] = r["n"]
    total = int(buckets.sum())
    for r in top:
        buckets[r["h"] % HASHED] -= r["n"]
    # counts from ``least`` on belong to at most LISTED words besides the named ones, those from ``known`` on to KNOWN
    step = F.floor(F.log2("n") * 8)
    least, known, held = None, np.inf, 0
    for r in counts.where("n > 1").groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        held += r["words"]
        if held > LISTED + len(top):
            break
        least = r["n"]
        known = least if held <= KNOWN + len(top) else known
    often = F.lit(False) if least is None else F.col("n") >= least
    listed = counts.where(often).toPandas()
    listed = listed[~listed["h"].isin([r["h"] for r in top])]
    vocabulary = Vocabulary([r["h"] for r in top], [r["n"] for r in top], total, buckets, listed["h"].to_numpy(np.int64), listed["n"].to_numpy(np.int64), known)
    return vocabulary, counts.where("n > 1")


def windows_of(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the bucket of each word ``at`` and of the exact words around it, within the text."""
    ends = np.cumsum(counts)
    text = np.searchsorted(ends, at, "right")
    first, last = (ends - counts)[text], ends[text]
    h = words[at] % np.uint64(HASHED)
    for step in (*range(-SIDE, 0), *range(1, SIDE + 1)):
        there = at + step
        inside = (there >= first) & (there < last)
        h = mix(h) + np.where(inside, words[np.clip(there, 0, max(0, len(words) - 1))], np.uint64(0))
    return mix(h)


_ROW = 4096


def learn_network(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Window:
    """Train in every task on all its words, and average; every text is in one of the rounds."""
    net = Window(vocabulary.start)
    for k in range(rounds):
        _learn_round(texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), vocabulary, net)
    return net


def _learn_round(texts: DataFrame, vocabulary: Vocabulary, net: Window) -> None:
    """Move ``net`` to the average of the networks that all tasks make of it."""
    start = net.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Window(vocabulary.start).load(start), 0
        for batch in (part for whole in batches for part in slices(whole, 0)):
            words, counts = hash_words(*text_buffers(batch.column(0)), ALNUM)
            ids = vocabulary.ids(words)
            around = surroundings(ids, counts)
            for i in range(0, len(ids), _BATCH):
                net.learn(ids[i : i + _BATCH], around[:, i : i + _BATCH], _RATE)
                seen += min(_BATCH, len(ids) - i)
        if seen:
            flat = net.flat().astype(np.float64) * seen
            for i in range(0, len(flat), _ROW):
                yield pa.RecordBatch.from_arrays([pa.array([i // _ROW], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat[i : i + _ROW]], pa.list_(pa.float64()))], names=["part", "seen", "w"])

    parts = bounded_batches(texts).mapInArrow(run, "part int, seen long, w array<double>")
    each = parts.select("part", "seen", F.posexplode("w").alias("at", "w"))
    mean = each.groupBy("part", "at").agg((F.sum("w") / F.sum("seen")).alias("w"))
    got = written(mean, "lm-weights").toPandas()
    if len(got):
        flat = net.flat()
        flat[got["part"].to_numpy() * _ROW + got["at"].to_numpy()] = got["w"].to_numpy()
        net.load(flat)


def score(docs: DataFrame, vocabulary: Vocabulary, net: Window, text_col: str = "text") -> DataFrame:
    """``docs`` with a last column ``__lm`` (or a free name like it): struct of n_tokens, log_prob, the words whose log-count is still to be added, and the rare words with their windows."""
    at, out = docs.columns.index(text_col), free_name(docs, "__lm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            words, counts = hash_words(*text_buffers(batch.column(at)), ALNUM)
            ids = vocabulary.ids(words)
            around = surroundings(ids, counts)
            logs = [net.logs(ids[i : i + _BATCH], around[:, i : i + _BATCH]) for i in range(0, len(ids), _BATCH)]
            share, far = vocabulary.shares(words, ids)
            doc = np.repeat(np.arange(len(counts)), counts)
            total = np.bincount(doc, np.concatenate(logs) + share if logs else None, len(counts))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[far], minlength=len(counts)))])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[far].view(np.int64)))
            places = vocabulary.rare_at(words, ids)
            rare = pa.StructArray.from_arrays([pa.array(words[places].view(np.int64)), pa.array(windows_of(words, counts, places).view(np.int64))], ["h", "g"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[places], minlength=len(counts)))])
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)
            value = pa.StructArray.from_arrays([pa.array(counts), pa.array(total.astype(np.float64)), rest, rare], ["n_tokens", "log_prob", "rest", "rare"])
            yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(None).cast("struct<n_tokens:bigint,log_prob:double,rest:array<bigint>,rare:array<struct<h:bigint,g:bigint>>>")).schema)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from all documents and score them: id, n_tokens, log_prob (sum), mean_log_prob (null without words)."""
    texts = docs.select(F.col(text_col).alias("text"))
    vocabulary, others = learn_vocabulary(texts)
    return score_documents(docs, vocabulary, others, learn_network(texts, vocabulary), id_col, text_col)


def score_documents(docs: DataFrame, vocabulary: Vocabulary, others: DataFrame, net: Window, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score_corpus`` with what was learned, possibly from other documents; the memory is of the windows in ``docs``."""
    lm = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), vocabulary, net)
    scored = written(lm.select("id", "__lm.*").withColumn("__at", F.monotonically_increasing_id()), "lm-scored")
    counted = scored.select("__at", F.explode("rest").alias("h")).join(others, "h").select("__at", F.log("n").alias("more"))
    # a window that stands around one rare word changes nothing: only the others go on
    each = scored.select("__at", F.inline("rare"))
    again = each.groupBy("g").agg(F.count("*").alias("all")).where("all > 1").select("g")
    each = written(each.join(again, "g", "left_semi"), "lm-windows")
    here = written(each.groupBy("g", "h").agg(F.count("*").alias("c")), "lm-memory")
    window = written(here.groupBy("g").agg(F.sum("c").alias("all"), F.count("*").alias("kinds")), "lm-memory")
    rare = F.element_at(F.array(*[F.lit(int(x)) for x in vocabulary.rare]), (F.pmod("h", F.lit(HASHED)) + 1).cast("int"))
    n = F.coalesce("n", F.lit(1))
    share = ((F.col("c") - 1) * rare + F.col("kinds") * n) / (F.col("all") * n)
    memory = written(here.join(window, "g").join(others, "h", "left").select("g", "h", F.log(share).alias("more")), "lm-memory")
    remembered = each.join(memory, ["g", "h"]).select("__at", "more")
    added = counted.union(remembered).groupBy("__at").agg(F.sum("more").alias("__added"))
    log_prob = F.col("log_prob") + F.coalesce("__added", F.lit(0.0))
    return scored.drop("rest", "rare").join(added, "__at", "left").select(
        F.col("id").alias(id_col), "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob")
    )
