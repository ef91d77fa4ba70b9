"""Benchmark passages in documents: pigeonhole pieces find places, Myers' bit-parallel distance decides.

An item of m characters may differ by k = floor(m * budget) edits. Cut into k + 1 pieces, one piece at least is untouched,
so an exact search for all pieces (Aho-Corasick) meets every occurrence; the text around each hit is then compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslattice.llm.common import id_and_text

BUDGET = 0.06
BLOCK_CHARS = 2_000_000  # items of so many characters are searched for at a time
MATCHES = "doc_id long, item_id long, distance long, start long, length long"


def normalised(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split()) if isinstance(text, str) else ""


class Item(NamedTuple):
    ids: list
    text: str
    edits: int


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 consecutive pieces (offset, piece) of nearly equal length."""
    n = edits + 1
    borders = [i * len(text) // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(borders, borders[1:])]


class Pattern:
    """An item prepared for comparison: one bit per character (Myers, 1999; Hyyrö, 2003)."""

    def __init__(self, text: str):
        self.length, self.full = len(text), (1 << len(text)) - 1
        self.where: dict[str, int] = {}
        for i, c in enumerate(text):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def nearest(self, text: str) -> tuple[int, int]:
        """(distance, end) of the substring of `text` that is nearest to the item; the first of several."""
        full, last, where = self.full, 1 << self.length - 1, self.where
        plus, minus, score = full, 0, self.length
        best, end = score, 0
        for i, c in enumerate(text, 1):
            equal = where.get(c, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | full & ~(horizontal | plus), plus & horizontal
            if up & last:
                score += 1
            elif down & last:
                score -= 1
                if score < best:
                    best, end = score, i
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | full & ~(vertical | up), up & vertical
        return best, end


class Searcher:
    """All items of one block, ready to search texts."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.patterns = [Pattern(i.text) for i in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            for offset, piece in pieces(item.text, item.edits):
                places.setdefault(piece, []).append((number, offset))
        self.machine = ahocorasick.Automaton()
        for piece, at in places.items():
            self.machine.add_word(piece, (len(piece), at))
        self.machine.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int]] = {}

    def compare(self, number: int, window: str) -> tuple[int, int]:
        if (number, window) not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[number, window] = self.patterns[number].nearest(window)
        return self.known[number, window]

    def __call__(self, text: str) -> Iterator[tuple[Item, int, int]]:
        """(item, distance, start of the searched window) of each item found, at its best place."""
        hits: dict[int, set[int]] = {}
        for end, (length, at) in self.machine.iter(text):
            for number, offset in at:
                hits.setdefault(number, set()).add(end + 1 - length - offset)
        for number, starts in hits.items():
            item, best = self.items[number], None
            m, k, seen = len(item.text), item.edits, None
            for start in sorted(starts):
                if seen is not None and start <= seen + k:
                    continue  # that occurrence lies in the window of `seen`
                if text.startswith(item.text, max(start, 0)) and start >= 0:
                    distance = 0
                else:
                    distance, _ = self.compare(number, text[max(0, start - k): start + m + 3 * k])
                seen = start
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, max(start, 0))
                    if not distance:
                        break
            if best:
                yield item, *best


def item_blocks(items: DataFrame, budget: float, block_chars: int) -> Iterator[list[Item]]:
    """Distinct item texts in blocks of bounded size; only one block at a time is on the driver."""
    norm = F.lower(F.col("text").cast("string"))
    named = items.select(F.col("item_id").cast("long").alias("item_id"), norm.alias("t")).filter(F.length(F.trim("t")) > 0)
    block, size = {}, 0
    for row in named.orderBy("item_id", "t").toLocalIterator():
        text = normalised(row["t"])
        if text and text not in block:
            block[text], size = [], size + len(text)
        if text:
            block[text].append(row["item_id"])
        if size >= block_chars:
            yield [Item(ids, t, int(len(t) * budget)) for t, ids in block.items()]
            block, size = {}, 0
    if block:
        yield [Item(ids, t, int(len(t) * budget)) for t, ids in block.items()]


def matches(docs: DataFrame, items: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, length): items found in whole documents, one row per document row and item.

    Texts and items are compared in lower case with white space as single spaces; distance counts edited characters, start is
    the place in that text (up to the error budget), length that of the item. Items without text match nothing, null and empty
    documents hold nothing. Items with equal texts are all named. Repeated rows of docs give repeated rows; a null doc_id or
    item_id is returned as null. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs)
    out = spark.createDataFrame([], MATCHES)
    for block in item_blocks(items, budget, block_chars):
        out = out.unionByName(texts.mapInPandas(_search(spark.sparkContext.broadcast([tuple(i) for i in block])), MATCHES))
    return out


def _search(shared):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Searcher([Item(*i) for i in shared.value])
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"].array, frame["text"].array):
                for item, distance, start in find(normalised(text)):
                    rows += [(doc_id, i, distance, start, len(item.text)) for i in item.ids]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "length"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"), item_id=out["item_id"].astype("Int64"))

    return search


def _holds_none(shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = Searcher([Item(*i) for i in shared.value])
        for texts in batches:
            yield pd.Series([next(find(normalised(t)), None) is None for t in texts], dtype=bool)

    return clean


def without_benchmark(docs: DataFrame, items: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold an item; columns as they were. Rows are judged by their own text."""
    out = docs
    for block in item_blocks(items, budget, block_chars):
        clean = _holds_none(docs.sparkSession.sparkContext.broadcast([tuple(i) for i in block]))
        out = out.filter(clean(F.col("text").cast("string")))
    return out
