"""Packing documents into sequences of fixed length by large-item matching.

The plan depends on lengths only. Equal lengths are interchangeable, so the lengths of all pieces
are counted on the executors and the plan is made over that histogram: at most `capacity` numbers,
however many documents there are. A piece then finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslattice.llm.common import id_and_text, staged
from opslattice.llm.encoding import encoder

PIECES = ("doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, task int, local_rank long")


class Slot(NamedTuple):
    """Pieces of `length` with ranks from first_rank on go to sequences from first_sequence on, at `offset`."""
    length: int
    first_rank: int
    first_sequence: int
    offset: int


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full pieces, of which the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return list(zip(starts, [b - a for a, b in zip(starts, starts[1:] + [n])]))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool = True) -> DataFrame:
    """Encoded pieces of every document with their rank among pieces of equal length in the same task; ids are null unless kept."""
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        end, seen = np.array([end_id], dtype="<u4").tobytes(), [0] * (capacity + 1)
        for frame in frames:
            rows = []
            for doc_id, ids in zip(frame["doc_id"].array, encode(frame["text"].array)):
                ids += end
                for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start: 4 * (start + length)]
                    rows.append((doc_id, i, start, length, part if keep_ids else None, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
                if len(rows) >= 1000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return id_and_text(docs).mapInPandas(encode, PIECES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


class _Bins:
    """Open bins as groups (count, lengths) by free space."""

    def __init__(self):
        self.gaps: list[int] = []
        self.groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(self, gap: int, count: int, lengths: tuple[int, ...]) -> None:
        if gap not in self.groups:
            insort(self.gaps, gap)
            self.groups[gap] = []
        self.groups[gap].append((count, lengths))

    def take(self, size: int) -> tuple[int, int, tuple[int, ...]] | None:
        """A group with the smallest gap that holds `size`."""
        at = bisect_left(self.gaps, size)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        count, lengths = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap], self.gaps[at]
        return gap, count, lengths


def match_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) for a histogram of lengths.

    Lengths above a third of the capacity come at most two to a sequence: each, from the largest on, is
    matched with the largest other one that fits. Smaller ones then go, from the largest on, where they
    leave the least free space; new sequences open only when none has room.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    bins = _Bins()
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        size = large[-1]
        fits = bisect_left(large, capacity - size + 1) - 1
        if fits >= 0 and large[fits] == size and left[size] == 1:
            fits -= 1
        if fits < 0:
            bins.put(capacity - size, left.pop(size), (size,))
            large.pop()
            continue
        partner = large[fits]
        if partner == size:
            count, left[size] = left[size] // 2, left[size] % 2
        else:
            count = min(left[size], left[partner])
            left[size] -= count
            left[partner] -= count
        bins.put(capacity - size - partner, count, (size, partner))
        for k in {size, partner}:
            if not left[k]:
                del left[k]
                large.remove(k)
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            gap, count, lengths = bins.take(size) or (capacity, -(-n // (capacity // size)), ())
            each = gap // size
            full = min(count, n // each)
            rest = min(n - full * each, each) if full < count else 0
            if full:
                bins.put(gap - size * each, full, lengths + (size,) * each)
            if rest:
                bins.put(gap - size * rest, 1, lengths + (size,) * rest)
            untouched = count - full - bool(rest)
            if untouched and lengths:
                bins.put(gap, untouched, lengths)
            n -= full * each + rest
    return [group for gap in bins.gaps for group in bins.groups[gap]]


def slots(bins: list[tuple[int, tuple[int, ...]]]) -> list[Slot]:
    out, ranks, sequence = [], {}, 0
    for count, lengths in bins:
        offset = 0
        for length in lengths:
            out.append(Slot(length, ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        sequence += count
    return sorted(out)


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset for written pieces (columns of PIECES, without need of the ids)."""
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(match_bins(histogram, capacity))
    keys = np.array([s.length << 44 | s.first_rank for s in table], dtype=np.int64)
    ranks, sequences, offsets = (np.array([s[i] for s in table], dtype=np.int64) for i in (1, 2, 3))
    shared = cut.sparkSession.sparkContext.broadcast((keys, ranks, sequences, offsets))

    @F.pandas_udf("sequence_id long, offset long")
    def slot_of(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, ranks, sequences, offsets = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank - ranks[at], "offset": offsets[at]})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    found = cut.join(earlier.hint("merge"), ["task", "length"]).withColumn("_slot", slot_of("length", F.col("_before") + F.col("local_rank")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "_slot.sequence_id", "_slot.offset",
                        *(["ids"] if "ids" in cut.columns else []))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves with
    keep_ids. A document is its ids plus end_id; only documents longer than the capacity are cut. Null and empty
    texts are one piece holding end_id. Repeated rows and ids, and a null doc_id, are packed row by row. Empty
    tables give no rows. Other columns of docs are ignored. Pieces of equal length are placed in the order of
    (task, row), which is fixed once the pieces are written.
    """
    cut = staged(pieces(docs, tokenizer, capacity, end_id, keep_ids), "packing-pieces")
    return place(cut if keep_ids else cut.drop("ids"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, from pack(..., keep_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_parts")).select(
        "sequence_id", "n_tokens",
        F.aggregate("_parts", F.lit(b""), lambda acc, part: F.concat(acc, part["ids"])).alias("ids"))
