"""Phrases whose words stand together more often than apart, counted on a prefix-free parse of the texts.

A text is a row of tokens: words, and a line end wherever a piece ends. Where the hash of `OVERLAP` neighbouring tokens falls
into a fixed residue class a chunk starts, and the chunk before it runs on over those tokens. So cuts depend on content only,
equal passages have equal chunks wherever they stand, and the texts become a dictionary of distinct chunks with their numbers of
occurrences. A phrase of up to OVERLAP + 1 words lies whole in the chunk in which it starts before the overlap; there it is
counted, once per distinct chunk and with the chunk's weight.

A phrase can't be more frequent than its parts. Words are counted first, then pairs of frequent words, then longer phrases of
frequent pairs; what is frequent is told to the tasks by a bit table of fixed size, whose false hits only cost work. Pairs and
longer phrases are first counted by their 64-bit hash, which can count too much but never too little, and what remains is
counted again as text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslattice.llm.common import staged

LONGEST = 4  # words in a phrase
OVERLAP = LONGEST - 1
PERIOD = 32  # tokens between two cuts on average
MOST = 512  # tokens after which a chunk ends where no cut was found
TABLE_BITS = 1 << 25  # bits in a table of frequent hashes: 4 MB, whatever the corpus
PROBES = 2
KEY_BITS = 40  # of a phrase's hash, by which it is first counted
SALTS = 64
_BATCH_BYTES = 8 << 20

_random = np.random.default_rng(20240311)
_FACTORS = _random.integers(1, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# A-Z in lower case, piece ends as line ends, tab as blank: byte for byte, as all of them are ASCII.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashes(tokens: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens, repeat(seed)), dtype=np.uint64, count=len(tokens))


def _sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens that start at each place."""
    n = max(len(hashes) - k + 1, 0)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total += hashes[i: i + n] * _FACTORS[i]
    return _mix(total)


def tokens_of(text: str | None) -> list[bytes]:
    """Words and line ends of a text."""
    plain = text.encode("utf-8", "replace").translate(_PLAIN) if isinstance(text, str) else b""
    return [t for t in plain.replace(b"\n", b" \n ").split(b" ") if t]


def parse(tokens: list[bytes], period: int = PERIOD, most: int = MOST) -> Iterator[tuple[bytes, bool]]:
    """(chunk, whether it is the text's last) for each chunk; all but the last end with the start of the next."""
    if not tokens:
        return
    cuts = np.flatnonzero(_sequences(_hashes(tokens), OVERLAP) % np.uint64(period) == 0).tolist()
    starts = [0]
    for cut in [*cuts, len(tokens)]:
        while cut - starts[-1] > most + OVERLAP:
            starts.append(starts[-1] + most)
        if starts[-1] < cut < len(tokens):
            starts.append(cut)
    for start, end in zip(starts, starts[1:]):
        yield b" ".join(tokens[start: end + OVERLAP]), False
    yield b" ".join(tokens[starts[-1]:]), True


def dictionary(docs: DataFrame, period: int = PERIOD, most: int = MOST) -> DataFrame:
    """(lang, chunk, last, n): distinct chunks of the parse with their numbers of occurrences."""
    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found, size = Counter(), 0
            for lang, text in zip(frame["lang"], frame["text"]):
                for chunk, last in parse(tokens_of(text), period, most):
                    found[lang, chunk, last] += 1
                    size += len(chunk)
                if size > _BATCH_BYTES:
                    yield _frame(found)
                    found, size = Counter(), 0
            yield _frame(found)

    def _frame(found: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*key, n) for key, n in found.items()], columns=["lang", "chunk", "last", "n"])

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.filter(F.col("text").isNotNull()).mapInPandas(chunks, "lang string, chunk binary, last boolean, n long").groupBy(
        "lang", "chunk", "last").agg(F.sum("n").alias("n"))


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_INVERSES = tuple(np.uint64(pow(int(p), -1, 1 << 64)) for p in _BASES)
_SPAN = 1 << 18  # bytes whose powers are kept
_SHORT = 64  # longer words are hashed one by one


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(_SPAN + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS, _BACK = tuple(map(_powers, _BASES)), tuple(map(_powers, _INVERSES))


def _hashes_in(text: bytes, starts: np.ndarray, ends: np.ndarray, seed: int, which: int) -> np.ndarray:
    """64-bit hashes of text[start:end] for rising places: sums of bytes times powers of a base, from running totals."""
    out = np.empty(len(starts), dtype=np.uint64)
    data = np.frombuffer(text, dtype=np.uint8)
    at = 0
    while at < len(starts):
        first = starts[at]
        upto = max(np.searchsorted(ends, first + _SPAN, side="right"), at + 1)
        part = slice(at, upto)
        if ends[upto - 1] - first <= _SPAN:
            size = int(ends[upto - 1] - first)
            totals = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum((data[first: first + size].astype(np.uint64) + np.uint64(1)) * _POWERS[which][:size], out=totals[1:])
            begin = starts[part] - first
            out[part] = (totals[ends[part] - first] - totals[begin]) * _BACK[which][begin]
        at = upto
    sizes = ends - starts
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i]: ends[i]], which)
    return _mix(out + np.uint64(seed) + _mix(sizes.astype(np.uint64)))


def _language_seed(lang: str, which: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8"), which)


class _Batch:
    """Tokens of chunks of one language, one after the other in one string, with a blank between any two."""

    def __init__(self, lang: str, chunks: list[bytes], last: np.ndarray, weights: np.ndarray):
        self.text = b" ".join(chunks)
        data = np.frombuffer(self.text, dtype=np.uint8)
        blanks = np.flatnonzero(data == 32)
        self.starts = np.r_[0, blanks + 1]
        self.ends = np.r_[blanks, len(data)]
        sizes = np.fromiter((c.count(b" ") + 1 for c in chunks), dtype=np.int64, count=len(chunks))
        ends = np.cumsum(sizes)
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        self.weights = weights[chunk]
        self.end = ends[chunk]  # first place behind the chunk
        self.is_word = (data[self.starts] != 10) | (self.ends - self.starts > 1)
        self.own = (np.arange(len(self.starts)) < (ends - np.where(last, 0, OVERLAP))[chunk]) & self.is_word
        self._lang = lang
        self.hashes = self._hashed(0)

    def _hashed(self, which: int) -> np.ndarray:
        return _hashes_in(self.text, self.starts, self.ends, _language_seed(self._lang, which), which)

    @cached_property
    def _second(self) -> np.ndarray:
        return self._hashed(1)

    def keys(self, k: int) -> np.ndarray:
        """Key of the k tokens that start at each place."""
        return _sequences(self.hashes, k) & np.uint64((1 << KEY_BITS) - 1)

    def places(self, fits: np.ndarray, k: int) -> np.ndarray:
        """Places where k tokens, all of them in `fits` and in one chunk, start a phrase that is counted here."""
        n = max(len(self.starts) - k + 1, 0)
        good = self.own[:n] & (np.arange(n) + k <= self.end[:n])
        for i in range(k):
            good &= fits[i: i + n]
        return np.flatnonzero(good)

    def spelled(self, at: np.ndarray, k: int) -> Counter:
        """Phrases of k words that start at the places, with their weights. Two phrases are equal if 128 bits of hash are."""
        one, two = (_sequences(h, k)[at] for h in (self.hashes, self._second))
        order = np.argsort(one, kind="stable")
        at, one, two = at[order], one[order], two[order]
        found = Counter()
        if len(at):
            first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            sums = np.add.reduceat(self.weights[at], first).tolist()
            for start, end, n in zip(self.starts[at[first]].tolist(), self.ends[at[first] + k - 1].tolist(), sums):
                found[self.text[start:end]] += n
        return found


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, _Batch]]:
    """Languages with some megabytes of their chunks each."""
    waiting, size = [], 0
    for frame in frames:
        waiting.append(frame)
        size += int(frame["chunk"].map(len).sum())
        if size >= _BATCH_BYTES:
            yield from _by_language(waiting)
            waiting, size = [], 0
    if waiting:
        yield from _by_language(waiting)


def _by_language(frames: list[pd.DataFrame]) -> Iterator[tuple[str, _Batch]]:
    for lang, some in pd.concat(frames, ignore_index=True).groupby("lang", sort=False):
        yield lang, _Batch(lang, some["chunk"].tolist(), some["last"].to_numpy(bool), some["n"].to_numpy(np.int64))


def _added_up(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct key stands, sum of its weights), as integers."""
    if not len(keys):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return order[first], np.add.reduceat(weights[order], first)


def word_counts(parsed: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n): words with n >= least, and with phrase null the number of words of each language."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, batch in _batches(frames):
            found = batch.spelled(np.flatnonzero(batch.own), 1)
            words = [word.decode("utf-8") for word in found]
            yield pd.DataFrame({"lang": lang, "phrase": [*words, None], "n": [*found.values(), sum(found.values())]})

    counted = parsed.mapInPandas(count, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull())


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_mix(hashes + np.uint64(i)) & np.uint64(bits - 1) for i in range(PROBES)]


def _contains(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for at in _probes(hashes, len(table) << 6):
        found &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _bit_table(rows: DataFrame, hashed: Callable[[pd.DataFrame], np.ndarray], table_bits: int) -> Broadcast:
    """A table of bits with those of the rows' hashes set, put together on the executors."""
    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.concatenate(_probes(hashed(frame), table_bits))
            table = pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})
            yield table.drop_duplicates()

    spark = rows.sparkSession
    words = rows.mapInPandas(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(table_bits >> 6, dtype=np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _word_hashes(frame: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(frame), dtype=np.uint64)
    for lang, rows in frame.groupby("lang", sort=False).indices.items():
        words = [w.encode("utf-8") for w in frame["phrase"].iloc[rows]]
        ends = np.cumsum([len(w) for w in words])
        out[rows] = _hashes_in(b"".join(words), ends - [len(w) for w in words], ends, _language_seed(lang, 0), 0)
    return out


def _hash_column(frame: pd.DataFrame) -> np.ndarray:
    return frame["h"].to_numpy(np.int64).view(np.uint64)


def _hash_counts(parsed: DataFrame, least: int, found: Callable[[_Batch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(h, n): hashes of phrases with n >= least; found gives (hashes, weights) of a batch."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, batch in _batches(frames):
            for hashes, weights in found(batch):
                first, sums = _added_up(hashes, weights)
                yield pd.DataFrame({"h": hashes[first].view(np.int64), "n": sums})

    return parsed.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def phrase_counts(parsed: DataFrame, words: DataFrame, least: int, table_bits: int = TABLE_BITS) -> DataFrame:
    """(lang, phrase, n): phrases of 2 to LONGEST words with n >= least; words: the frequent words."""
    frequent = _bit_table(words, _word_hashes, table_bits)

    def known_words(batch: _Batch) -> np.ndarray:
        return _contains(frequent.value, batch.hashes) & batch.is_word

    def pairs(batch: _Batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = batch.places(known_words(batch), 2)
        yield batch.keys(2)[at], batch.weights[at]

    paired = _bit_table(_hash_counts(parsed, least, pairs).select("h"), _hash_column, table_bits)

    def runs(batch: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """For each place whether frequent words stand there, and whether a frequent pair starts there."""
        fits = known_words(batch)
        pair = np.zeros(len(fits), dtype=bool)
        both = np.flatnonzero(fits[:-1] & fits[1:])
        pair[both] = _contains(paired.value, batch.keys(2)[both])
        return fits, pair

    def placed(batch: _Batch, k: int, fits: np.ndarray, pair: np.ndarray) -> np.ndarray:
        at = batch.places(fits, k)
        for i in range(k - 1):
            at = at[pair[at + i]]
        return at

    def longer(batch: _Batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fits, pair = runs(batch)
        for k in range(3, LONGEST + 1):
            at = placed(batch, k, fits, pair)
            yield batch.keys(k)[at], batch.weights[at]

    lengthened = _bit_table(_hash_counts(parsed, least, longer).select("h"), _hash_column, table_bits)

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, batch in _batches(frames):
            fits, pair = runs(batch)
            for k in range(2, LONGEST + 1):
                at = placed(batch, k, fits, pair)
                if k > 2:
                    at = at[_contains(lengthened.value, batch.keys(k)[at])]
                found = batch.spelled(at, k)
                if found:
                    yield pd.DataFrame({"lang": lang, "phrase": [p.decode("utf-8") for p in found], "n": list(found.values())})

    return parsed.mapInPandas(spell, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= least)


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of every phrase: its lowest-scoring cut, the earliest of equals."""
    parts = words.unionByName(phrases)
    cut = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.size(cut).alias("size"), cut.alias("_w")).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "size", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("_w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    score = F.expr("CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    return cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).groupBy("lang", "phrase", "a", "size").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_c")).select("lang", "phrase", "a", "size", "_c.l", "_c.r", "_c.score")


def _most_of_longer(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer phrase that contains the phrase."""
    cut = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, size(_w) - 1), k -> transform(sequence(1, size(_w) - k + 1), i -> "
                   "array_join(slice(_w, i, k), ' '))))")
    return phrases.select("lang", F.col("n").alias("longer"), cut.alias("_w")).filter(F.size("_w") > 2).select(
        "lang", F.explode(inner).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, table_bits: int = TABLE_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` strongest phrases of each language.

    Words are runs of other characters than blank and tab inside pieces, which end at . , ; : ! ? and line ends; A-Z count as
    a-z. Candidates are phrases of 2 to 4 words that occur at least `least` times, in overlapping places too. score is
    2,000,000 a / (l + r) rounded down, at the cut where it is lowest. A candidate inside a longer one with at least `percent`
    percent of its count is dropped. Order: score, then a, both descending, then the phrase in byte order.

    Null languages count as `und`, null and empty texts have no words, repeated rows and ids count row by row; doc_id and other
    columns are not used. Empty tables give no rows, and a language without candidates has none.
    """
    parsed = staged(dictionary(docs), "collocations-parse")
    counted = staged(word_counts(parsed, least), "collocations-words")
    words = counted.filter(F.col("phrase").isNotNull())
    totals = counted.filter(F.col("phrase").isNull()).select("lang", F.col("n"))
    phrases = staged(phrase_counts(parsed, words, least, table_bits), "collocations-phrases")
    scored = _scored(phrases, words).join(_most_of_longer(phrases), ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < percent * F.col("a").cast("decimal(20,0)")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = scored.withColumn("_salt", salt).withColumn("_in_salt", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
    last = first.filter(F.col("_in_salt") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return last.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
