"""Token-id store: every document's ids as one zstandard frame, all frames sharing one trained dictionary.

A store is a folder of three Parquet tables, so that any storage Spark can reach holds it:
  dictionary  one row: the dictionary, its sha256, bytes per id, end id
  blocks      frames of consecutive documents in one binary value, with the offset index of the block beside it
  index       doc_id, place of its frame, position of its ids among the ids of all documents
Every block repeats the hash of the dictionary it was written with, and readers check it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslattice.llm.common import hash_sample, id_and_text, stage_path, staged
from opslattice.llm.encoding import encoder

BLOCK_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS, SAMPLE_BYTES = 400, 8 << 10  # the dictionary is fitted on about so many documents, and so many bytes from somewhere in each
LEVEL = 3

BLOCKS = ("part int, block int, n_tokens long, dictionary_sha256 string, "
          "index array<struct<doc_id:long,offset:long,size:long,start:long,n_tokens:long>>, frames binary")
COLUMNS = ["part", "block", "n_tokens", "dictionary_sha256", "index", "frames"]


def _serialise(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def _somewhere(ids: bytes, width: int) -> bytes:
    """At most SAMPLE_BYTES of the ids, from a place that depends on all of them."""
    spare = (len(ids) - SAMPLE_BYTES) // width
    start = width * (zlib.crc32(ids) % (spare + 1)) if spare > 0 else 0
    return ids[start: start + SAMPLE_BYTES]


def train_dictionary(docs: DataFrame, tokenizer: str, width: int) -> bytes:
    """A dictionary from the serialised ids of a bounded, hash-drawn sample; empty if the sample is too small for one."""
    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for frame in frames:
            yield pd.DataFrame({"ids": [_somewhere(_serialise(ids, width), width) for ids in encode(frame["text"].array)]})

    drawn = hash_sample(id_and_text(docs).filter(F.col("text") != ""), "doc_id", SAMPLE_DOCS, "dictionary")
    # A repeated id is drawn as a whole, so the number of rows is bounded here.
    samples = sorted(bytes(r["ids"]) for r in drawn.limit(2 * SAMPLE_DOCS).mapInPandas(sample, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def write_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str, width: int = 2) -> None:
    """Encode all documents and write them to `folder` in ascending doc_id order.

    Null and empty texts hold end_id alone. Rows with equal doc_id follow each other in the order of their texts; a
    null doc_id comes first. Other columns are ignored. An empty table gives an empty store. width: bytes per stored
    id, 2 only for vocabularies of at most 65,536 ids.
    """
    spark = docs.sparkSession
    most = max(end_id, encoder(tokenizer).largest_id)
    if most >= 1 << (8 * width):
        raise ValueError(f"ids up to {most} do not fit {width} bytes")
    data = train_dictionary(docs, tokenizer, width)
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(bytearray(data), sha, width, end_id)],
                          "dictionary binary, dictionary_sha256 string, width int, end_id int"
                          ).coalesce(1).write.parquet(f"{folder}/dictionary")
    end = np.array([end_id], dtype="<u4").tobytes()

    def compress(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, compressor = encoder(tokenizer), zstandard.ZstdCompressor(level=LEVEL, **_dictionary(data))
        for frame in frames:
            encoded = encode(frame["text"].array)
            for at in range(0, len(frame), 1000):
                ids = [i + end for i in islice(encoded, 1000)]
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].array[at: at + 1000], "tie": frame["tie"].array[at: at + 1000], "n_tokens": [len(i) // 4 for i in ids],
                    "frame": [compressor.compress(_serialise(i, width)) for i in ids]})

    # Documents are encoded where they are read; only their frames are dealt out by range, with texts where these decide the order.
    texts = id_and_text(docs)
    again = staged(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id")), "token-repeats")
    tied = texts.join(again, F.col("doc_id") == F.col("_id"), "left")
    tied = tied.select("doc_id", "text", F.when(F.col("_id").isNotNull() | F.col("doc_id").isNull(), F.col("text")).alias("tie"))
    packed = staged(tied.mapInPandas(compress, "doc_id long, tie string, n_tokens long, frame binary"), "token-frames", "none")
    ordered = packed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("part", F.spark_partition_id())

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, index, out, size, start = 0, 0, [], [], 0, 0
        for frame in frames:
            part = int(frame["part"].iloc[0]) if len(frame) else part
            for doc_id, n_tokens, body in zip(frame["doc_id"].array, frame["n_tokens"], frame["frame"]):
                index.append({"doc_id": None if pd.isna(doc_id) else int(doc_id), "offset": size, "size": len(body),
                              "start": start, "n_tokens": int(n_tokens)})
                out.append(body)
                size, start = size + len(body), start + int(n_tokens)
                if size >= BLOCK_BYTES:
                    yield pd.DataFrame([(part, block, start, sha, index, b"".join(out))], columns=COLUMNS)
                    block, index, out, size, start = block + 1, [], [], 0, 0
        if index:
            yield pd.DataFrame([(part, block, start, sha, index, b"".join(out))], columns=COLUMNS)

    ordered.select("part", "doc_id", "n_tokens", "frame").mapInPandas(gather, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    blocks = _blocks(spark, folder).join(_block_starts(spark, folder), ["part", "block"])
    blocks.select("part", "block", "_start", F.explode("index").alias("i")).select(
        "i.doc_id", "part", "block", "i.offset", "i.size", (F.col("_start") + F.col("i.start")).alias("start"), "i.n_tokens",
    ).write.parquet(f"{folder}/index")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")


def _block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids before each block: running totals of blocks in a part, and of parts. Only counts of parts meet in one task."""
    blocks = _blocks(spark, folder).select("part", "block", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(parts, "part").select(
        "part", "block", (F.col("_part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("_start"))


def _opened(spark: SparkSession, folder: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["dictionary_sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return data, row["dictionary_sha256"], row["width"]


def _unpack(data: bytes, sha: str, width: int):
    decompressor = zstandard.ZstdDecompressor(**_dictionary(data))

    def ids(frame: bytes, written_with: str) -> bytes:
        if written_with != sha:
            raise ValueError("a block was written with another dictionary")
        return np.frombuffer(decompressor.decompress(frame), dtype=f"<u{width}").astype("<u4").tobytes()

    return ids


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of all documents; ids as little-endian unsigned 32-bit integers."""
    data, sha, width = _opened(spark, folder)

    def decompress(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = _unpack(data, sha, width)
        for frame in frames:
            for first, written_with, index, body in zip(frame["_start"], frame["dictionary_sha256"], frame["index"], frame["frames"]):
                for at in range(0, len(index), 500):
                    some = index[at: at + 500]
                    yield pd.DataFrame({
                        "doc_id": pd.array([i["doc_id"] for i in some], dtype="Int64"),
                        "start": [first + i["start"] for i in some],
                        "ids": [unpack(body[i["offset"]: i["offset"] + i["size"]], written_with) for i in some]})

    located = _blocks(spark, folder).join(_block_starts(spark, folder), ["part", "block"])
    return located.select("_start", "dictionary_sha256", "index", "frames").mapInPandas(
        decompress, "doc_id long, start long, ids binary")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the documents named in wanted(doc_id): index lookup, then only their frames are unpacked."""
    data, sha, width = _opened(spark, folder)
    places = spark.read.parquet(f"{folder}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    cut = places.join(_blocks(spark, folder).select("part", "block", "dictionary_sha256", "frames"), ["part", "block"]).select(
        "doc_id", "start", "dictionary_sha256",
        F.substring("frames", F.col("offset").cast("int") + 1, F.col("size").cast("int")).alias("frame"))

    @F.pandas_udf("binary")
    def unpacked(frame: pd.Series, written_with: pd.Series) -> pd.Series:
        unpack = _unpack(data, sha, width)
        return pd.Series([unpack(f, w) for f, w in zip(frame, written_with)])

    return cut.select("doc_id", "start", unpacked("frame", "dictionary_sha256").alias("ids"))


def store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> str:
    """Write a store below the shared folder; returns its folder."""
    folder = stage_path(docs.sparkSession, "tokens")
    write_store(docs, tokenizer, end_id, folder)
    return folder
