"""Variable-capacity best-fit packing of documents into training sequences.

Each document is cut into pieces of at most the largest permitted length. The pieces
are counted, dealt by a hash into shards of about ``SHARD`` pieces, and every shard is
packed in falling order of length:

- a piece goes to the open bin that it leaves the least room in (best fit);
- where none fits, the capacity of least cost is opened. A bin of capacity c costs
  ``overhead + c + quadratic * c * c``, less what its room will earn: room that the
  shorter pieces still to come can fill is worth its share of that price;
- at the end each bin is downsized to the least permitted length that holds its contents.

A document's length is its number of words (runs of other than blanks). Null, empty
and word-less texts have no piece and are not in the result; a repeated id counts as
several documents. The hash is of the row and the piece, both fixed in a written table
of lengths, so that neither a repeated id nor a very long document fills one shard.
Equal lengths go by row, then piece. The result says where pieces go (a document's words
from ``first_word`` on); texts are not moved.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserlog.llm.shared import written

CAPACITIES = (512, 1024, 2048, 4096)
SHARD = 50_000
OVERHEAD, QUADRATIC = 16.0, 1 / 32768


def pack(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in the bin, final capacity of the bin) of every piece."""
    capacities = sorted(set(capacities))
    order = np.argsort(-lengths, kind="stable")
    cost = {c: overhead + c + quadratic * c * c for c in capacities}
    ascending = np.sort(lengths)
    below = np.concatenate([[0], np.cumsum(ascending)])
    room: dict[int, list[int]] = {}  # room -> bins, the last opened first
    rooms: list[int] = []
    used: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def put(b: int, left: int) -> None:
        if left:
            if not room.setdefault(left, []):
                bisect.insort(rooms, left)
            room[left].append(b)

    for done, i in enumerate(order.tolist()):
        need = int(lengths[i])
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                rooms.pop(at)
        else:
            best = None
            for c in capacities:
                if c >= need:
                    # mass of the pieces to come that fit the room; these are the shortest ones
                    to_come = min(int(np.searchsorted(ascending, c - need, "right")), len(lengths) - done - 1)
                    earned = min(c - need, int(below[to_come])) * cost[c] / c
                    if best is None or cost[c] - earned < best[0]:
                        best = cost[c] - earned, c
            b, left = len(used), best[1]
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += need
        put(b, left - need)
    final = np.array([capacities[bisect.bisect_left(capacities, u)] for u in used], np.int64)
    return bins, offsets, final[bins] if len(bins) else bins


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id as text, row, n_words) of the rows with words, written: row numbers stay what they are."""
    n = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = docs.select(F.col(id_col).cast("string").alias("id"), n.alias("n_words")).withColumn("row", F.monotonically_increasing_id())
    return written(sized.where("n_words > 0").select("id", "row", "n_words"), "pack-words")


def pieces_of(sized: DataFrame, largest: int) -> DataFrame:
    """(id, row, piece, n): each document's words in pieces of at most ``largest``."""
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_words") - 1) / largest)))
    left = F.col("n_words") - F.col("piece") * largest
    return sized.select("id", "row", "n_words", piece.alias("piece")).select("id", "row", "piece", F.least(F.lit(largest).cast("long"), left).alias("n"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """One row per piece: id, piece, n_words, first_word (in the text), shard, bin, bin_offset, capacity."""
    largest = max(capacities)
    sized = word_counts(docs, id_col, text_col)
    pieces = sized.agg(F.sum(F.floor((F.col("n_words") - 1) / largest) + 1)).first()[0] or 0
    shards = max(1, -(-int(pieces) // shard))
    dealt = pieces_of(sized, largest).withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], kind="stable")
        bins, offsets, capacity = pack(pdf["n"].to_numpy(np.int64), capacities)
        return pdf.drop(columns="row").assign(bin=bins, bin_offset=offsets, capacity=capacity)

    kind = docs.schema[id_col].dataType
    packed = dealt.groupBy("shard").applyInPandas(run, "id string, piece long, n long, shard long, bin long, bin_offset long, capacity long")
    return packed.select(F.col("id").cast(kind).alias(id_col), "piece", F.col("n").alias("n_words"), (F.col("piece") * largest).alias("first_word"), "shard", "bin", "bin_offset", "capacity")
