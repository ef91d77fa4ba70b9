"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslattice.plans.runtime import shared_dir


def stage_path(spark, label: str) -> str:
    """A new folder name below the shared folder of the cluster."""
    return f"{shared_dir(spark).rstrip('/')}/opslattice-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet below the shared folder and continue from the copy.

    The lineage ends there, so a lost executor costs a re-read and not a recomputation.
    """
    path = stage_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) only, whatever other columns the table brings along."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def columns_of(df: DataFrame) -> list[F.Column]:
    """All columns under their own names, whatever characters these hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(column) -> F.Column:
    """crc32 of an id as text, modulo 4: the split that the contracts name."""
    return F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(4))


def hash_sample(df: DataFrame, key: str, bound: int, seed: str) -> DataFrame:
    """About `bound` rows drawn by a hash of the key, all rows if there are fewer. Sampling is for model fits only."""
    total = df.count()
    if total <= bound:
        return df
    cut = int(bound / total * (1 << 32))
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 32)) < cut)
