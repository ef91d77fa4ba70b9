"""Near-duplicate groups: MinHash bands find candidates, odd sketches thin them out, full shingle sets confirm them.

A document is its set of distinct five-word shingles. Documents with equal sets form a class, and only the class's
smallest id goes on. MinHash bands deal the classes into buckets. Inside a bucket the odd sketches (parity bitmaps of the
MinHash samples, whose XOR population count tells how many samples differ) decide which pairs are worth an exact look.

Pairs are never listed. A task that compares members of a bucket has their texts too, confirms what the sketches let pass
through an index from shingle to member, and returns a spanning forest of the links: fewer rows than members, however many
pairs there are. In the first round every class is in one bucket of its own, so the trees are groups already. In the second
round it is in another bucket and in other company. The last round compares whatever is still outside the largest group of a
bucket with the whole bucket, in every bucket, so no link between groups is lost. Large buckets are split into blocks of
bounded size in every round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslattice.llm.common import columns_of, id_and_text, staged
from opslattice.operators.graph import connected_components
from opslattice.plans.skew import hot_counts, salted_join

WORDS = 5
SAMPLES = 256  # MinHash samples, all of them folded into the sketch
BANDS, ROWS = 40, 4  # a pair of similarity 0.75 shares no band with probability 3e-7
BITS = 1024
MARGIN = 0.15  # below the wanted similarity, more than five standard errors of the sketch
BLOCK = 2048  # members of a bucket that are compared in one task at a time
HOT_ROWS = 1024  # equal documents whose join with their class is split
PART_BYTES = 8 << 20  # compressed texts of members whose shingles are indexed at a time

_random = np.random.default_rng(20240229)
_POWERS = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _random.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_PLACE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def split_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; fewer words are one shingle, none are the empty set."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - WORDS + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(WORDS):
        total += hashes[i: i + n] * _POWERS[i]
    return np.unique(_mix(total))


def minhash(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        some = shingles[at: at + 1024, None] * _A
        some += _B
        np.minimum(least, some.min(axis=0), out=least)
    return least >> np.uint64(32)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    rows = samples[: BANDS * ROWS].reshape(BANDS, ROWS)
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Bit b is the parity of the number of samples that hash to b."""
    places = (_mix(samples | _PLACE) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=BITS).astype(np.uint8) & 1).tobytes()


def most_differing_bits(similarity: float) -> int:
    """Population count of the XOR that two sets of that similarity have on average."""
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


SIGNATURES = "doc_id long, n_shingles long, fingerprint binary, sketch binary, keys array<long>, body binary"


def signatures(docs: DataFrame) -> DataFrame:
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressor = zstandard.ZstdCompressor(level=1)
        for frame in frames:
            for at in range(0, len(frame), 1000):
                rows = []
                for doc_id, text in zip(frame["doc_id"].array[at: at + 1000], frame["text"].array[at: at + 1000]):
                    words = split_words(text)
                    found = shingle_set(words)
                    if not len(found):
                        rows.append((doc_id, 0, b"", None, None, None))
                        continue
                    samples = minhash(found)
                    rows.append((doc_id, len(found), xxhash.xxh3_128_digest(found.tobytes()), odd_sketch(samples),
                                 band_keys(samples), compressor.compress(b" ".join(words))))
                out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "fingerprint", "sketch", "keys", "body"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return id_and_text(docs).mapInPandas(sign, SIGNATURES)


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, n, doc_id) of the buckets with several members; of buckets with equal members one is kept."""
    bands = reps.select("doc_id", F.explode("keys").alias("key"))
    many = staged(bands.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id").bitwiseAND((1 << 40) - 1)).alias("_s"),
        F.bit_xor(F.xxhash64(F.lit(7), "doc_id")).alias("_x")).filter("n > 1"), "neardup-keys")
    chosen = many.groupBy("n", "_s", "_x").agg(F.min("key").alias("key")).select("key", "n")
    return staged(bands.join(chosen, "key"), "neardup-buckets")


def _cards(signed: DataFrame, firsts: DataFrame, members: DataFrame) -> DataFrame:
    """Sketches and texts of the classes that are in some bucket. Texts are most of what is shuffled, and every round shuffles the cards."""
    wanted = firsts.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    return signed.select("doc_id", "fingerprint", "sketch", "body").join(wanted, ["doc_id", "fingerprint"], "left_semi").drop("fingerprint")


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows with equal `by` from sorted batches; a group may cross the border of a batch."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        keys = frame[by].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        rest = frame.iloc[starts[-1]:]
        if starts[-1]:
            yield frame.iloc[: starts[-1]], starts[:-1]
    if rest is not None:
        yield rest, np.array([0])


def _bits(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(len(column), -1)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of a against every row of b."""
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    for word in range(a.shape[1]):
        out += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return out


class _Index:
    """Shingle sets of some members, by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        shingles = np.concatenate(sets)
        order = np.argsort(shingles, kind="stable")
        self._shingles, self._owners = shingles[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def common(self, asked: np.ndarray) -> np.ndarray:
        """Number of shingles that each member shares with a sorted set."""
        start, end = np.searchsorted(self._shingles, asked, "left"), np.searchsorted(self._shingles, asked, "right")
        found = end - start
        places = np.arange(found.sum()) + np.repeat(start - (np.cumsum(found) - found), found)
        return np.bincount(self._owners[places], minlength=len(self.sizes))


def _unpacked(body: bytes) -> np.ndarray:
    return shingle_set(zstandard.ZstdDecompressor().decompress(body).split())


def spanning_links(group: np.ndarray, asks: np.ndarray, bits: np.ndarray, bodies: list[bytes], limit: int,
                   percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(places of linked members, tree of each member) after comparing every member that asks with all others.

    Members of one group are one tree from the start. Two members are compared unless they are in one tree by then; all members
    that the sketches let pass are compared exactly. One link is returned for every two trees that it joins.
    """
    tree = np.unique(group, return_inverse=True)[1]
    links, questions = [], np.flatnonzero(asks)
    part_of = np.cumsum([len(b) for b in bodies]) // PART_BYTES
    for part in np.unique(part_of):
        members = np.flatnonzero(part_of == part)
        index, sets = None, {}
        for q in questions.tolist():
            apart = (tree[members] != tree[q]) & ~(asks[members] & (members < q))
            if not apart.any():
                continue
            near = apart & (_differing(bits[q: q + 1], bits[members])[0] <= limit)
            if not near.any():
                continue
            if index is None:
                sets = {m: _unpacked(bodies[m]) for m in members.tolist()}
                index = _Index(list(sets.values()))
            own = sets[q] if q in sets else _unpacked(bodies[q])
            common = index.common(own)
            linked = members[near & (100 * common >= percent * (len(own) + index.sizes - common))]
            for other, at in zip(*np.unique(tree[linked], return_index=True)):
                links.append((q, int(linked[at])))
                tree[tree == other] = tree[q]
    return links, tree


def _blocks(frames: Iterator[pd.DataFrame], by: list[str], limit: int, percent: int) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    """(ids, links, trees) of every group of rows with equal `by`."""
    for frame, starts in _groups(frames, by):
        for a, b in zip(starts, [*starts[1:], len(frame)]):
            rows = frame.iloc[a:b]
            group, asks = rows["group"].to_numpy(np.int64), rows["asks"].to_numpy(bool)
            if (group != group[0]).any() and asks.any():
                yield rows["doc_id"].to_numpy(np.int64), *spanning_links(group, asks, _bits(rows["sketch"]), rows["body"].tolist(), limit, percent)


def _links_in(dealt: DataFrame, by: list[str], limit: int, percent: int) -> DataFrame:
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, links, _ in _blocks(frames, by, limit, percent):
            if links:
                a, b = (ids[list(x)] for x in zip(*links))
                yield pd.DataFrame({"a": a, "b": b})

    return dealt.mapInPandas(find, "a long, b long")


def _dealt(rows: DataFrame, cards: DataFrame, by: list[str]) -> DataFrame:
    """rows with sketches and texts, those with equal `by` in one task and next to each other."""
    return rows.join(cards, "doc_id").repartition(*by).sortWithinPartitions(*by, "doc_id")


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, n, doc_id, group, main) of buckets that still hold several groups; main: the largest of them."""
    named = members.join(groups, "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id"))
    sizes = named.groupBy("key", "group").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.groupBy("key").agg(F.max_by("group", F.struct("_n", "group")).alias("main"),
                                     F.count(F.lit(1)).alias("_g")).filter("_g > 1").drop("_g")
    return named.join(sizes, "key")


def _at_home(rows: DataFrame, rank: Column) -> DataFrame:
    """Every member in one bucket only: that with the largest rank."""
    home = rows.groupBy("doc_id").agg(F.max(rank)["key"].alias("key"))
    return rows.join(home, ["doc_id", "key"])


def _block(number: int, block: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(number), "doc_id"), F.ceil(F.col("n") / block)).alias("block")


def _first_round(members: DataFrame, cards: DataFrame, limit: int, percent: int, block: int) -> DataFrame:
    """(doc_id, group): every class in its largest bucket, where its tree is its group; only trees of several classes."""
    home = _at_home(members, F.struct("n", "key")).select("key", _block(0, block), "doc_id", F.col("doc_id").alias("group"), F.lit(True).alias("asks"))

    def trees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, links, tree in _blocks(frames, ["key", "block"], limit, percent):
            if links:
                found = pd.DataFrame({"doc_id": ids, "tree": tree})
                per = found.groupby("tree")["doc_id"]
                yield found.assign(group=per.transform("min"))[per.transform("size") > 1][["doc_id", "group"]]

    return _dealt(home, cards, ["key", "block"]).mapInPandas(trees, "doc_id long, group long")


def _second_round(opened: DataFrame, cards: DataFrame, limit: int, percent: int, block: int) -> DataFrame:
    """Links between groups: every class in one more bucket, drawn by a hash, and in other blocks."""
    home = _at_home(opened, F.struct(F.xxhash64(F.lit(1), "key"), "key")).select(
        "key", _block(1, block), "doc_id", "group", (F.col("group") != F.col("main")).alias("asks"))
    return _links_in(_dealt(home, cards, ["key", "block"]), ["key", "block"], limit, percent)


def _last_round(opened: DataFrame, cards: DataFrame, limit: int, percent: int, block: int) -> DataFrame:
    """Links of members outside the largest group of their bucket with the whole bucket, block by block."""
    guests = opened.filter(F.col("group") != F.col("main")).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("guest_blocks"))
    host_blocks = F.ceil(F.col("n") / block)
    placed = opened.join(guests, "key")
    hosts = placed.select(
        "key", F.pmod(F.xxhash64(F.lit(101), "doc_id"), host_blocks).alias("host"),
        F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)).alias("guest"), F.lit(False).alias("asks"), "doc_id", "group")
    asking = placed.filter(F.col("group") != F.col("main")).select(
        "key", F.explode(F.sequence(F.lit(0), host_blocks - 1)).alias("host"),
        F.pmod(F.xxhash64(F.lit(103), "doc_id"), F.col("guest_blocks")).alias("guest"), F.lit(True).alias("asks"), "doc_id", "group")
    by = ["key", "host", "guest"]
    return _links_in(_dealt(hosts.unionByName(asking), cards, by), by, limit, percent)


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, group) after more links; the graph between groups is all that is walked."""
    left = groups.select(F.col("doc_id").alias("a"), F.col("group").alias("_ga"))
    right = groups.select(F.col("doc_id").alias("b"), F.col("group").alias("_gb"))
    between = links.join(left, "a", "left").join(right, "b", "left").select(
        F.coalesce("_ga", "a").alias("a"), F.coalesce("_gb", "b").alias("b"))
    moved = staged(connected_components(between, "a", "b"), "neardup-moved")
    renamed = groups.join(moved, F.col("group") == F.col("id"), "left").select(
        "doc_id", F.coalesce("component", "group").alias("group"))
    new = moved.select(F.col("id").alias("doc_id"), F.col("component").alias("group")).join(groups, "doc_id", "left_anti")
    return staged(renamed.unionByName(new), "neardup-groups")


def near_duplicates(docs: DataFrame, percent: int = 75, block: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per doc_id.

    Documents are linked if 100 * common shingles >= percent * shingles of either; component_id is the smallest id that
    links reach, kept marks it. Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat
    a doc_id are one document, of which the row with the smallest fingerprint counts. Rows without doc_id cannot be named
    by a link: they are returned with a null component_id and kept. Empty tables give no rows; other columns are ignored.
    """
    signed = staged(signatures(docs), "neardup-signatures")
    rows = signed.select("doc_id", "n_shingles", "fingerprint")
    unnamed = rows.filter("doc_id IS NULL").select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    one = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("fingerprint", "n_shingles")).alias("_f")).select(
        "doc_id", "_f.*")
    first = staged(one.filter("n_shingles > 0").groupBy("fingerprint").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n")), "neardup-firsts")
    many = hot_counts(first, ["fingerprint"], "_n", hot_rows)
    classes = staged(salted_join(one, first.drop("_n"), ["fingerprint"], "doc_id", "left", hot=many).select(
        "doc_id", "n_shingles", "fingerprint", F.coalesce("first", "doc_id").alias("first")), "neardup-classes")
    firsts = classes.filter("n_shingles > 0 AND doc_id = first").select("doc_id", "fingerprint")
    reps = staged(signed.select("doc_id", "fingerprint", "keys").join(firsts, ["doc_id", "fingerprint"], "left_semi").select("doc_id", "keys"), "neardup-reps")
    members = _buckets(reps)
    cards = staged(_cards(signed, firsts, members), "neardup-cards")
    limit = most_differing_bits(percent / 100 - MARGIN)
    groups = staged(_first_round(members, cards, limit, percent, block), "neardup-groups")
    for further in (_second_round, _last_round):
        opened = staged(_open(members, groups), "neardup-open")
        links = staged(further(opened, cards, limit, percent, block), "neardup-links")
        groups = _merged(groups, links)
    named = classes.join(groups.withColumnRenamed("doc_id", "first"), "first", "left").select(
        "doc_id", "n_shingles", F.coalesce("group", "first").alias("component_id"))
    return named.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(unnamed)


def without_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one document of each group, columns as they were.

    Of rows that repeat a kept doc_id one stays. Rows without doc_id stay.
    """
    found = near_duplicates(docs, percent).filter("doc_id IS NOT NULL")
    kept = found.filter("kept").select("doc_id")
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
    stay = docs.join(kept, "doc_id", "left_semi")
    once = stay.join(repeated, "doc_id", "left_anti")
    again = stay.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).unionByName(docs.filter("doc_id IS NULL")).select(*columns_of(docs))
