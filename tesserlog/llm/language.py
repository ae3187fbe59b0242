"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is the list of a language's most frequent character n-grams (1 to 3
letters, word ends count as a character), counted over all learning documents. A
document's own list is compared with each profile: every n-gram adds the distance
between its two places, or the profile length where the profile lacks it. The
language with the least sum wins; ties go to the first in order of name.

Null texts and texts without a letter are ``und`` with score 0, as is everything
when nothing could be learned. Score: 1 - least sum / largest possible sum, the share of
agreement with the nearest profile; it is not a probability. Every row with text and
language is learned from, a repeated one as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserlog.llm.shared import bounded_batches, free_name

PROFILE = 300
UNKNOWN = "und"
_PIECE, _BITS = 1 << 20, 18


@cache
def _letters() -> np.ndarray:
    """Letters of the first four planes; no others are assigned."""
    return np.array([chr(c).isalpha() for c in range(1 << _BITS)])


def _pieces(text: str) -> Iterator[str]:
    """A very long text in pieces that end at a blank."""
    at = 0
    while len(text) - at > 2 * _PIECE:
        cut = text.find(" ", at + _PIECE)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the text's n-grams and how often each occurs."""
    found = []
    for piece in _pieces(text or ""):
        chars = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars = np.where(chars < 1 << _BITS, chars, 0)
        chars[~_letters()[chars]] = 0
        chars = np.concatenate([[0], chars, [0]])
        chars = chars[np.append(True, (chars[1:] != 0) | (chars[:-1] != 0))]  # one mark between words
        if len(chars) < 3:
            continue
        two, three = (chars[:-1] << _BITS) | chars[1:], (chars[:-2] << 2 * _BITS) | (chars[1:-1] << _BITS) | chars[2:]
        found += [chars[chars > 0] | 1 << 60, two | 2 << 60, three[chars[1:-1] > 0] | 3 << 60]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.sort(np.concatenate(found))
    new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[new], np.diff(np.append(new, len(codes)))


def top_grams(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Codes by falling count, ties by code."""
    if len(codes) > size:
        often = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[often], counts[often]
    return codes[np.lexsort((codes, -counts))][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counts by language: one row for each n-gram, whatever the number of documents."""
    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    size: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            part = gram_counts(text.as_py())
            held.setdefault(lang, []).append(part)
            size[lang] = size.get(lang, 0) + len(part[0])
            if size[lang] > 1_000_000:
                held[lang] = [merged(held[lang])]
                size[lang] = 0
    for lang, parts in held.items():
        codes, counts = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])


class Profiles:
    """The learned profiles: sorted codes and each code's place in every language."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(ranked)
        self.codes = np.unique(np.array([c for v in ranked.values() for c in v], np.int64))
        self.place = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)  # last row: not in any profile
        for k, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.codes, np.array(ranked[lang], np.int64)), k] = np.arange(len(ranked[lang]))

    def distances(self, text: str | None) -> tuple[np.ndarray, int]:
        """Out-of-place distance to every language, and the largest possible one."""
        top = top_grams(*gram_counts(text), self.size)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = -1
        at[self.codes[at] != top] = -1
        places = self.place[at]
        apart = np.where(places < 0, self.size, np.abs(places - np.arange(len(top))[:, None]))
        return apart.sum(0), self.size * len(top)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs:
            return UNKNOWN, 0.0
        apart, most = self.distances(text)
        if not most:
            return UNKNOWN, 0.0
        best = int(np.argmin(apart))
        return self.langs[best], max(0.0, 1 - float(apart[best]) / most)


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of all documents with text and language. What comes to the driver is ``size`` rows a language."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = bounded_batches(rows).mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    ranked: dict[str, list[int]] = {}
    for r in sorted(counts.withColumn("place", place).where(F.col("place") <= size).collect(), key=lambda r: r["place"]):
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, size)


def predict_language(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with a last column ``__language`` (or a free name like it): struct of lang_pred and score."""
    at, out = docs.columns.index(text_col), free_name(docs, "__language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(at)]
            value = pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, out])

    return bounded_batches(docs).mapInArrow(run, docs.withColumn(out, F.lit(None).cast("struct<lang_pred:string,score:double>")).schema)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether crc32 of the id as text falls into the fold kept from learning; null, and so in neither part, for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold
