"""Token counts of whole texts, without encoding what is known to be one token.

Before any text is read, every string of the vocabulary is put through the library's own normaliser, pre-tokeniser and merges;
those that come out as themselves, as a single pre-token and a single token, are proven. A pre-token of that set counts one
wherever it stands, as merges never cross pre-tokens. The rest is merged by the library's model, and counts of strings met
before are kept in a memory of bounded size.

White space separates pre-tokens and is dropped, so a text is looked at string by string between white space. Strings of plain
ASCII are cut by the vocabulary's pattern here; others go through the library's normaliser and pre-tokeniser.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslattice.llm.common import id_and_text

WORD_END = "</w>"
# The vocabulary's own pattern for lower-case ASCII.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_GRAPHIC = re.compile(r"[!-~]+")
# White space for str.split, but not for the vocabulary.
_UNSURE = re.compile("[\x1c-\x1f]")
_LONGEST = 40  # longer strings are not remembered
_GENERATION = 400_000  # strings; two generations are kept


def proven_tokens(path: str) -> frozenset[str]:
    """Pre-tokens, in the byte alphabet of the vocabulary, that are certain to be one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    alphabet = _byte_alphabet(tokenizer)
    proven = set()
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if not entry.endswith(WORD_END):
            continue
        piece = entry.removesuffix(WORD_END)
        try:
            text = bytes(alphabet[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        pieces = [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if pieces == [piece] and tokenizer.normalizer.normalize_str(text) == text and len(tokenizer.model.tokenize(piece)) == 1:
            proven.add(piece)
    return frozenset(proven)


def _byte_alphabet(tokenizer) -> dict[str, int]:
    """Character of the byte alphabet -> byte, as far as valid UTF-8 can show it."""
    out = {}
    points = [*range(128), *range(0x80, 0x800), *range(0x1000, 0xD000, 0x1000), *range(0x10000, 0x110000, 0x1000)]
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=False)
    for point in points:
        shown = "".join(p for p, _ in cut.pre_tokenize_str(chr(point)))
        out.update(zip(shown, chr(point).encode("utf-8")))
    return out


class Counter:
    """Number of tokens of whole texts."""

    def __init__(self, path: str, proven: frozenset[str]):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = tuple(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        self._proven = proven
        self._merged = lru_cache(1 << 16)(lambda piece: len(self._tokenizer.model.tokenize(piece)))
        self._young: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def whole(self, text: str) -> int:
        """The library's own count, for texts that cannot be cut at white space."""
        return len(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _string(self, string: str) -> int:
        if any(token in string for token in self._special):
            return self.whole(string)
        if _GRAPHIC.fullmatch(string):
            pieces = _PIECES.findall(string.lower())
        else:
            normal = self._tokenizer.normalizer.normalize_str(string)
            pieces = [piece for piece, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return sum(1 if piece in self._proven else self._merges(piece) for piece in pieces)

    def _merges(self, piece: str) -> int:
        return self._merged(piece) if len(piece) <= _LONGEST else len(self._tokenizer.model.tokenize(piece))

    def _text(self, text: str) -> int:
        if _UNSURE.search(text):
            return self.whole(text)
        strings = text.split()
        counts = list(map(self._young.get, strings))
        if None not in counts:
            return sum(counts)
        total = 0
        for string, count in zip(strings, counts):
            if count is None:
                count = self._old.get(string)
                if count is None:
                    count = self._string(string)
                if len(string) <= _LONGEST:
                    self._young[string] = count
            total += count
        if len(self._young) > _GENERATION:
            self._old, self._young = self._young, {}
        return total

    def __call__(self, texts: Iterable[str | None]) -> Iterator[int]:
        """Count of each text in turn; null is the empty text."""
        for text in texts:
            yield self._text(text) if isinstance(text, str) else 0


_counters: dict[str, Counter] = {}


def counter(path: str, proven: Broadcast) -> Counter:
    """One counter per Python worker and vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(path, proven.value)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, in one pass without a shuffle.

    Counts equal the library's without added special tokens; strings of special tokens inside a text are one token each, as is
    the library's default. Null and empty texts have no bytes and no tokens. Repeated rows and ids, and rows without doc_id, are
    counted row by row. Empty tables give no rows; other columns of docs are ignored.
    """
    proven = docs.sparkSession.sparkContext.broadcast(proven_tokens(tokenizer))  # no larger than the vocabulary

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(list(counter(tokenizer, proven)(texts)), dtype="int64")

    counted = id_and_text(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
