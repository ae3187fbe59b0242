"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters by two inputs: the word itself and its character n-grams (3 to 6
bytes, word ends included), each as log-odds of toxic against other documents in the
learning sample, so that unseen forms of a known stem still count. The network reads
windows of ``WINDOW`` words, a new one every ``STRIDE`` words, from both sides; an
attention layer pools the states; the largest window probability is the document's
score. All overlapping windows of the whole text are scored. Training treats a
document as a bag of windows: the windows that score highest carry the label.

The classifier is fitted on a bounded sample: at most ``MAX_POSITIVE`` toxic and
``MAX_NEGATIVE`` other labelled documents, first by a hash of the id, and at most
``MAX_BYTES`` of text, half for each; a text that does not fit is passed over. Null, empty and word-less texts have score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserlog.llm.shared import bounded_batches, free_name
from tesserlog.llm.textops import ALNUM, _LOWER, hash_words, mix, runs, text_buffers

WINDOW, STRIDE, STATES = 32, 16, 8
MAX_POSITIVE, MAX_NEGATIVE, MAX_BYTES = 800, 1600, 24_000_000
_SLOTS_BITS, _INPUTS = 18, 4
_BATCH, _RUN = 1024, 1 << 18


def _grams(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of word) of the character n-grams of words given by their bytes."""
    padded = size + 2
    first = np.concatenate([[0], np.cumsum(padded)[:-1]]) if len(size) else size
    text = np.full(int(padded.sum()), 1, np.uint64)  # 1 marks both word ends
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(first, size) + 1 + inside] = _LOWER[data[np.repeat(begin, size) + inside]]
    owner = np.repeat(np.arange(len(size)), padded)
    out, who = [], []
    h = text
    for n in range(2, 7):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint64(257) + text[n - 1 :]
        if n >= 3:
            same = owner[: len(h)] == owner[n - 1 :]
            out.append(mix(h[same] + np.uint64(n << 56)))
            who.append(owner[: len(h)][same])
    return (np.concatenate(out), np.concatenate(who)) if out else (text[:0], owner[:0])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)


class Lexicon:
    """Log-odds tables of words and character n-grams, from document frequencies."""

    def __init__(self):
        n = 1 << _SLOTS_BITS
        self.seen = {k: [np.zeros(n, np.float32), np.zeros(n, np.float32)] for k in ("word", "gram")}
        self.total = [0, 0]

    def add(self, t: "Words", y: int) -> None:
        self.seen["word"][y][np.unique(_slot(t.distinct))] += 1
        self.seen["gram"][y][np.unique(_slot(t.grams))] += 1
        self.total[y] += 1

    def done(self) -> "Lexicon":
        """Turn the counts into log-odds; what was seen fewer than three times counts less."""
        total = [max(1, n) for n in self.total]
        self.word, self.gram = (
            (np.log((p + 0.5) / (total[1] + 1)) - np.log((q + 0.5) / (total[0] + 1))) * np.minimum(1, (p + q) / 3)
            for q, p in (self.seen["word"], self.seen["gram"])
        )
        del self.seen
        return self

    def inputs(self, t: "Words") -> np.ndarray:
        """(distinct words, inputs)."""
        w = self.word[_slot(t.distinct)]
        g = self.gram[_slot(t.grams)]
        n = np.maximum(1, np.bincount(t.gram_of, minlength=len(w)))
        peak = np.full(len(w), -8, np.float32)
        np.maximum.at(peak, t.gram_of, g)
        return np.stack([w, peak, np.bincount(t.gram_of, g, len(w)) / n, np.log(n)], 1).astype(np.float32) / 4


class Words:
    """Words of some texts: distinct hashes, the index of each occurrence, and the distinct words' character n-grams."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        h, self.counts, begin, size = hash_words(data, off, ALNUM, spans=True)
        self.distinct, first, self.index = np.unique(h, return_index=True, return_inverse=True)
        self.grams, self.gram_of = _grams(data, begin[first], size[first])


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, text) of all windows; the last ends with the text."""
    n = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[text] + k * STRIDE, np.minimum(WINDOW, counts[text] - k * STRIDE), text


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights and passes. States run over (step, window, unit) in single precision."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        s, d = STATES, _INPUTS
        self.p = {}
        for side in "fb":
            self.p |= {f"x{side}": r.normal(0, 0.4, (d, 3 * s)), f"h{side}": r.normal(0, 0.25, (s, 3 * s)), f"c{side}": np.zeros(3 * s)}
        self.p |= {"a": r.normal(0, 0.3, (2 * s, s)), "v": r.normal(0, 0.3, s), "o": r.normal(0, 0.3, 2 * s), "z": np.full(1, -1.0)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, side: str, gates: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        s, u = STATES, self.p[f"h{side}"]
        h = np.zeros((gates.shape[1], s), np.float32)
        out = np.empty((*gates.shape[:2], s), np.float32)
        for t in range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1):
            rz = _sigmoid(gates[t, :, : 2 * s] + h @ u[:, : 2 * s])
            rh = rz[:, :s] * h
            new = np.tanh(gates[t, :, 2 * s :] + rh @ u[:, 2 * s :])
            z = rz[:, s:] * mask[t]
            after = h + z * (new - h)
            if keep is not None:
                keep.append((t, h, rz, rh, new, z))
            h = out[t] = after
        return out

    def _infer(self, side: str, gates: np.ndarray, mask: np.ndarray | None, out: np.ndarray) -> None:
        """As ``_run``, without what training needs and with windows along the last axis. The first two gates come halved, for a sigmoid by tanh."""
        s, u = STATES, self.p[f"h{side}"].T
        rz_u, new_u = np.ascontiguousarray(u[: 2 * s]) * np.float32(0.5), np.ascontiguousarray(u[2 * s :])
        h = np.zeros(out.shape[1:], np.float32)
        for t in range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1):
            rz = rz_u @ h
            rz += gates[t, : 2 * s]
            np.tanh(rz, out=rz)
            rz += 1
            rz *= np.float32(0.5)
            new = new_u @ (rz[:s] * h)
            new += gates[t, 2 * s :]
            np.tanh(new, out=new)
            new -= h
            new *= rz[s:]
            if mask is not None:
                new *= mask[t]
            h = np.add(h, new, out=out[t])

    def infer(self, halved: dict, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits, as ``forward``."""
        some = None if mask.all() else mask
        h = np.empty((2, len(index), STATES, index.shape[1]), np.float32)
        for k, side in enumerate("fb"):
            self._infer(side, np.ascontiguousarray(halved[side][index].transpose(0, 2, 1)), some, h[k])
        e = np.matmul(self.p["a"][:STATES].T, h[0])
        e += np.matmul(self.p["a"][STATES:].T, h[1])
        np.tanh(e, out=e)
        a = np.matmul(self.p["v"], e)
        if some is not None:
            a[mask == 0] = -30
        a -= a.max(0)
        np.exp(a, out=a)
        value = np.matmul(self.p["o"][:STATES], h[0]) + np.matmul(self.p["o"][STATES:], h[1])
        return (a * value).sum(0) / a.sum(0) + self.p["z"][0]

    def forward(self, projected: dict, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits. projected: the input part of the gates for each distinct word; index: (step, window)."""
        m = mask[:, :, None]
        runs = {side: self._run(side, projected[side][index], m, None if keep is None else keep.setdefault(side, [])) for side in "fb"}
        h = np.concatenate([runs["f"], runs["b"]], 2)
        e = np.tanh(h @ self.p["a"])
        a = np.where(mask > 0, e @ self.p["v"], -30)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbs->bs", a, h)
        if keep is not None:
            keep |= {"h": h, "e": e, "att": a, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["z"][0]

    def project(self, x: np.ndarray) -> dict:
        return {side: (x @ self.p[f"x{side}"] + self.p[f"c{side}"]).astype(np.float32) for side in "fb"}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """x: (step, window, input)."""
        s, p, keep = STATES, self.p, {}
        flat = np.arange(x.shape[0] * x.shape[1]).reshape(x.shape[:2])
        logit = self.forward(self.project(x.reshape(-1, x.shape[2])), flat, mask, keep)
        d = (_sigmoid(logit) - y) * weight / weight.sum()
        g = {"o": keep["pooled"].T @ d, "z": np.array([d.sum()])}
        dpool = d[:, None] * p["o"]
        dh = keep["att"][:, :, None] * dpool
        da = np.einsum("bs,tbs->tb", dpool, keep["h"])
        da = keep["att"] * (da - (keep["att"] * da).sum(0))
        g["v"] = np.einsum("tb,tbs->s", da, keep["e"])
        de = da[:, :, None] * p["v"] * (1 - keep["e"] ** 2)
        g["a"] = np.einsum("tbi,tbj->ij", keep["h"], de)
        dh = dh + de @ p["a"].T
        for k, side in enumerate("fb"):
            u, dout = p[f"h{side}"], dh[:, :, k * s : (k + 1) * s]
            gu, gx, gc, carry = np.zeros_like(u), np.zeros_like(p[f"x{side}"]), np.zeros(3 * s, np.float32), 0
            for t, h, rz, rh, new, z in reversed(keep[side]):
                up = dout[t] + carry
                dnew = up * z * (1 - new**2)
                zz = rz[:, s:]
                dz = up * (new - h) * mask[t][:, None] * zz * (1 - zz)
                drh = dnew @ u[:, 2 * s :].T
                r = rz[:, :s]
                dr = drh * h * r * (1 - r)
                carry = up * (1 - z) + drh * r + dr @ u[:, :s].T + dz @ u[:, s : 2 * s].T
                gates = np.concatenate([dr, dz, dnew], 1)
                gu[:, : 2 * s] += h.T @ gates[:, : 2 * s]
                gu[:, 2 * s :] += rh.T @ dnew
                gx += x[t].T @ gates
                gc += gates.sum(0)
            g |= {f"h{side}": gu, f"x{side}": gx, f"c{side}": gc}
        return g


class Scorer:
    """A fitted lexicon and network."""

    def __init__(self, lexicon: Lexicon, network: Network):
        self.lexicon, self.network = lexicon, network

    def logits(self, words: Words, x: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(first word, length, text, logit) of every window."""
        begin, length, text = _windows(words.counts)
        projected = self.network.project(self.lexicon.inputs(words) if x is None else x)
        for side in "fb":
            projected[side][:, : 2 * STATES] *= np.float32(0.5)
        out = np.empty(len(begin), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for i in range(0, len(begin), _BATCH):
            part = slice(i, i + _BATCH)
            mask = (steps < length[part]).astype(np.float32)
            index = words.index[np.minimum(begin[part] + steps, len(words.index) - 1)]
            out[part] = self.network.infer(projected, index, mask)
        return begin, length, text, out

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The largest window probability of each text."""
        out = np.zeros(len(off) - 1)
        for i, j in runs(off, _RUN):
            words = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            _, _, text, logit = self.logits(words)
            np.maximum.at(out, text + i, _sigmoid(logit.astype(np.float64)))
        return out


def fit(texts: list[str], labels: np.ndarray, seed: int = 7, rounds: tuple[int, ...] = (240, 80)) -> Scorer:
    """Fit on texts and 0/1 labels, with so many steps before and after the windows are chosen anew. Lexicon inputs used in training come from the half that a text is not in."""
    def words_of(text: str) -> Words:
        raw = text.encode("utf-8", "surrogatepass")
        return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))

    labels, half = np.asarray(labels, np.int64), np.arange(len(texts)) % 2
    network, every, across = Network(seed), Lexicon(), [Lexicon(), Lexicon()]
    for t, y, h in zip(texts, labels.tolist(), half.tolist()):
        w = words_of(t)
        every.add(w, y)
        across[1 - h].add(w, y)
    scorer = Scorer(every.done(), network)
    if not len(texts) or labels.min() == labels.max():
        network.p["o"][:] = 0
        network.p["z"][0] = 4.0 if len(texts) and labels.min() else -4.0
        return scorer
    words, inputs = [], []
    for t, h in zip(texts, half.tolist()):
        w = words_of(t)
        inputs.append((across[h] if hasattr(across[h], "word") else across[h].done()).inputs(w))
        w.grams = w.gram_of = None  # the large part; training needs places and inputs
        words.append(w)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    rng, step = np.random.default_rng(seed), 0
    for turn, steps in enumerate(rounds):
        xs, masks, ys = [], [], []
        for w, x, y in zip(words, inputs, labels):
            if not len(w.index):
                continue
            begin, length, _ = _windows(w.counts)
            if turn == 0:
                high = np.maximum.reduceat(np.append(x[w.index, 0] + x[w.index, 1], -9), np.minimum(begin, len(w.index) - 1))
            else:
                high = scorer.logits(w, x)[3]
            for k in np.argsort(-high, kind="stable")[: 1 if y else 2]:
                at = np.minimum(begin[k] + np.arange(WINDOW), len(w.index) - 1)
                xs.append(x[w.index[at]])
                masks.append(np.arange(WINDOW) < length[k])
                ys.append(y)
        x, mask, y = np.stack(xs, 1), np.stack(masks, 1).astype(np.float32), np.array(ys, np.float32)
        order = np.concatenate([rng.permutation(len(y)) for _ in range(steps * 256 // len(y) + 1)])
        for i in range(steps):
            part = order[i * 256 : (i + 1) * 256]
            grads = network.gradients(x[:, part], mask[:, part], y[part], np.ones(len(part), np.float32))
            step += 1
            for k, g in grads.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.p[k] -= (0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return scorer


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_bytes: int = MAX_BYTES, texts_of: DataFrame | None = None) -> Scorer:
    """Fit on the bounded sample named above. Rows without id, text or 0/1 label do not count.

    Of a repeated id the shortest text is learned, as toxic where any of its rows is.

    Where ``texts_of`` has the texts by id, ``labelled`` needs ``size`` (bytes of text) in
    their place, so that it can come from a join that moves no text.
    """
    size = F.octet_length(text_col) if texts_of is None else F.col("size")
    rows = labelled.select(F.col(id_col).alias("id"), size.alias("size"), F.col(label_col).cast("int").alias("y")).where("id is not null and size is not null and y in (0, 1)")
    rows = rows.groupBy("id").agg(F.min("size").alias("size"), F.max("y").alias("y"))
    texts, labels = [], []
    for y, most in ((1, max_positive), (0, max_negative)):
        ids = rows.where(F.col("y") == y).select("id", "size").orderBy(F.xxhash64("id"), "id").limit(most).collect()
        held, chosen = 0, []
        for r in ids:
            if held + r["size"] <= max_bytes // 2:
                held += r["size"]
                chosen.append(r["id"])
        if ids and not chosen:
            chosen = [min(ids, key=lambda r: r["size"])["id"]]
        source = labelled if texts_of is None else texts_of
        some = source.where(F.col(id_col).isin(chosen) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        # of an id's texts the shortest, of least hash on ties: what comes to the driver is what was sized above
        one = some.groupBy("id").agg(F.min_by("text", F.struct(F.octet_length("text"), F.xxhash64("text"))).alias("text"))
        found = {r["id"]: r["text"] for r in one.collect()} if chosen else {}
        texts += [found[i] for i in chosen]
        labels += [y] * len(chosen)
    return fit(texts, np.array(labels, np.int64))


def score_texts(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` with a last column ``__toxic`` (or a free name like it): the score."""
    at, out = docs.columns.index(text_col), free_name(docs, "__toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scorer.scores(*text_buffers(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, out])

    return bounded_batches(docs).mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)
