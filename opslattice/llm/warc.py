"""Fixity audit of WARC files: record hashes under Merkle trees, compared from the roots down.

Records are written to WARC files, one segment per file, in a fixed order. An audit hashes every record of every file and
builds one tree per segment: a leaf stands for the records that start in one range of byte offsets, an inner node for `fanout`
neighbouring ranges. Replicas are compared by their roots; only below a mismatch the next level is looked at, until the ranges,
and in them the records, that differ are found.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslattice.llm.common import staged

SEGMENT_BYTES = 8 << 20  # wanted size of a file
LEAF_BYTES = 64 << 10  # records that start in so many bytes share a leaf
FANOUT = 16
LEVELS = 4  # trees are as high as LEAF_BYTES * FANOUT ** LEVELS bytes need; a root stands for the whole file
END = "\r\n\r\n"
RECORDS = "segment long, offset long, length long, record_id string, sha256 string, damaged boolean"


def record(page_id: Column, url: Column, html: Column, digest: Column) -> Column:
    """A WARC response record without the two line ends that close it; digest: sha256 of the payload when it was fetched."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    known = F.coalesce(page_id.cast("string"), F.lit("none"))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), known,
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), digest,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)


def segments(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(segment, page_id, url, html, digest): pages dealt to files by a hash of id and url, so that no host fills a file of its own."""
    size = pages.agg(F.sum(F.octet_length(F.coalesce("html", F.lit("")))).alias("n")).first()["n"] or 0
    files = max(1, -(-size // segment_bytes))
    return pages.select(F.pmod(F.xxhash64("page_id", "url"), F.lit(files)).alias("segment"), "page_id", "url", "html",
                        F.sha2(F.coalesce(F.col("html"), F.lit("")), 256).alias("digest"))


def write_warc(pages: DataFrame, folder: str) -> None:
    """Write segments() as folder/segment=n/*.txt.gz, each file a gzip-compressed WARC file in the order of ids."""
    ordered = pages.repartition("segment").sortWithinPartitions("segment", "page_id", "url", "html")
    ordered.select("segment", record(*map(F.col, ("page_id", "url", "html", "digest"))).alias("value")).write.partitionBy("segment").option(
        "lineSep", END).option("compression", "gzip").text(folder)


def parse(body: bytes) -> Iterator[tuple[int, int, str, str, bool]]:
    """(offset, length, record id, sha256, damaged) of the records of one file.

    A record is damaged if its payload does not have the digest in its header, or if its header can't be read; then it
    reaches to the next place that looks like a record.
    """
    at = 0
    while at < len(body):
        head_end = body.find(b"\r\n\r\n", at)
        fields = {}
        if body.startswith(b"WARC/1.0\r\n", at) and head_end >= 0:
            for line in body[at:head_end].split(b"\r\n")[1:]:
                name, _, value = line.partition(b": ")
                fields[name.lower()] = value
        length, digest = fields.get(b"content-length", b""), fields.get(b"warc-payload-digest", b"")
        end = head_end + 4 + int(length) if length.isdigit() else -1
        sound = 0 <= end and body[end: end + 4] == b"\r\n\r\n"
        if sound:
            payload_ok = hashlib.sha256(body[head_end + 4: end]).hexdigest().encode() == digest.removeprefix(b"sha256:")
            end += 4
        else:
            following = body.find(b"\r\n\r\nWARC/1.0\r\n", at + 1)
            payload_ok, end = False, len(body) if following < 0 else following + 4
        name = fields.get(b"warc-record-id", b"").removeprefix(b"<urn:page:").removesuffix(b">").decode("utf-8", "replace")
        yield at, end - at, name, hashlib.sha256(body[at:end]).hexdigest(), not payload_ok
        at = end


def _inflated(stored: bytes) -> bytes:
    """The content of a plain or gzip file; of a broken gzip file what comes before the break."""
    if not stored.startswith(b"\x1f\x8b"):
        return stored
    out, unpack = [], zlib.decompressobj(wbits=31)
    for at in range(0, len(stored), 1 << 16):
        try:
            out.append(unpack.decompress(stored[at: at + (1 << 16)]))
        except zlib.error:
            break
    return b"".join(out)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of every file of a replica, by offset in the uncompressed file. One file is in memory at a time; a folder
    without files has no records."""
    segment = F.regexp_extract("path", r"segment=(\d+)/[^/]*$", 1).cast("long").alias("segment")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(folder).select(
        segment, "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for segment, stored in zip(frame["segment"], frame["content"]):
                rows = [(segment, *r) for r in parse(_inflated(bytes(stored)))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])

    return files.mapInPandas(read, RECORDS)


def tree(records: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(segment, level, node, hash): level 0 are the leaves, the node 0 of level `levels` is the root of a segment.

    A node hashes its children's hashes in order, with their positions; at most `fanout` of them, or the records of one leaf.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "sha256")))
    text = F.transform(parts, lambda r: F.concat_ws(":", r["offset"].cast("string"), r["length"].cast("string"), r["sha256"]))
    level = records.groupBy("segment", F.floor(F.col("offset") / leaf_bytes).alias("node")).agg(F.sha2(F.array_join(text, "\n"), 256).alias("hash"))
    out = [level.withColumn("level", F.lit(0))]
    for number in range(1, levels + 1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("child", "hash"))),
                               lambda c: F.concat_ws(":", c["child"].cast("string"), c["hash"]))
        parent = F.floor(F.col("node") / fanout) if number < levels else F.lit(0).cast("long")
        level = level.select("segment", parent.alias("node"), F.col("node").alias("child"), "hash").groupBy("segment", "node").agg(
            F.sha2(F.array_join(children, "\n"), 256).alias("hash"))
        out.append(level.withColumn("level", F.lit(number)))
    return reduce(DataFrame.unionByName, out).select("segment", "level", "node", "hash")


def mismatches(left: DataFrame, right: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, int]:
    """(segment, node) of the leaves that differ, and the number of nodes compared: from the roots down, below mismatches only.

    A node that only one replica has differs.
    """
    wanted, compared = None, 0
    for level in range(levels, -1, -1):
        pair = [t.filter(F.col("level") == level).select("segment", "node", F.col("hash").alias(h)) for t, h in ((left, "a"), (right, "b"))]
        if wanted is not None:
            up = F.floor(F.col("node") / fanout) if level < levels - 1 else F.lit(0).cast("long")
            pair = [t.withColumn("parent", up).join(wanted, ["segment", "parent"], "left_semi").drop("parent") for t in pair]
        both = staged(pair[0].join(pair[1], ["segment", "node"], "full"), "warc-level")
        compared += both.count()
        found = both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("segment", "node")
        wanted = found.select("segment", F.col("node").alias("parent"))
    return found, compared


def audit(left: DataFrame, right: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """One row per record of either replica: segment, offset, record_id, both hashes, status.

    left and right are records as read_records() gives them. Only records of mismatching leaves are compared; all others are the
    same by their trees. Records of mismatching leaves meet by id, repeated ids in the order of their offsets, and what has
    no partner then by offset. Status: same, moved (the same bytes at another offset), changed, missing (in the right one), added
    (only in the right one). offset is that of the left replica, or of the right one for added records. Whether a replica's own
    payload digest fails is told by left_damaged and right_damaged. An empty replica makes all records of the other missing or
    added; two empty ones give no rows.
    """
    left, right = staged(left, "warc-left"), staged(right, "warc-right")
    leaves, _ = mismatches(staged(tree(left, leaf_bytes), "warc-tree"), staged(tree(right, leaf_bytes), "warc-tree"))
    bad = staged(leaves.withColumn("suspect", F.lit(True)), "warc-leaves")
    placed = [t.withColumn("node", F.floor(F.col("offset") / leaf_bytes)) for t in (left, right)]
    sound = placed[0].join(bad, ["segment", "node"], "left_anti").select(
        "segment", "offset", "length", "record_id", F.col("sha256").alias("left_sha256"), F.col("sha256").alias("right_sha256"),
        F.col("damaged").alias("left_damaged"), F.col("damaged").alias("right_damaged"), F.lit("same").alias("status"))
    place = Window.partitionBy("segment", "record_id").orderBy("offset")
    a, b = [t.join(bad, ["segment", "node"], "left_semi").withColumn("_nth", F.row_number().over(place)).select(
        "segment", F.col("record_id").alias("_id"), "_nth", *[F.col(c).alias(f"{side}_{c}") for c in ("offset", "length", "record_id", "sha256", "damaged")])
        for t, side in zip(placed, ("left", "right"))]
    by_id = staged(a.join(b, ["segment", "_id", "_nth"], "full").drop("_id", "_nth"), "warc-pairs")
    pairs = by_id.filter("left_offset IS NOT NULL AND right_offset IS NOT NULL")
    alone = [by_id.filter(F.col(f"{other}_offset").isNull()).select(
        "segment", F.col(f"{side}_offset").alias("_at"), *[f"{side}_{c}" for c in ("offset", "length", "record_id", "sha256", "damaged")])
        for side, other in (("left", "right"), ("right", "left"))]
    met = pairs.unionByName(alone[0].join(alone[1], ["segment", "_at"], "full").drop("_at"))
    equal = F.col("left_sha256") == F.col("right_sha256")
    status = (F.when(F.col("left_sha256").isNull(), "added").when(F.col("right_sha256").isNull(), "missing")
              .when(equal & (F.col("left_offset") == F.col("right_offset")), "same").when(equal, "moved").otherwise("changed"))
    closer = met.select(
        "segment", F.coalesce("left_offset", "right_offset").alias("offset"), F.coalesce("left_length", "right_length").alias("length"),
        F.coalesce("left_record_id", "right_record_id").alias("record_id"), "left_sha256", "right_sha256", "left_damaged", "right_damaged",
        status.alias("status"))
    return sound.unionByName(closer)


def decayed(pages: DataFrame, seed: int = 97) -> DataFrame:
    """A replica of segments() with bit rot: in about one page of `seed` the middle character is replaced by another of the same width."""
    middle = F.floor(F.length("html") / 2).cast("int") + 1
    now = F.substring(F.col("html"), middle, F.lit(1))
    swapped = F.when(now == "x", F.lit("y")).otherwise(F.lit("x"))
    hit = (F.pmod(F.crc32(F.encode(F.col("page_id").cast("string"), "UTF-8")), F.lit(seed)) == 0) & (F.octet_length(now) == 1)
    return pages.withColumn("html", F.when(hit, F.overlay("html", swapped, middle, 1)).otherwise(F.col("html")))
