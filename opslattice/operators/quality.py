"""Data-quality gates: each yields one row (gate, expected, actual, ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslattice.functions.parsing import micros


class GateFailed(RuntimeError):
    pass


def _row(name: str, expected: Column, actual: Column, ok: Column) -> list[Column]:
    return [F.lit(name).alias("gate"), expected.cast("string").alias("expected"),
            actual.cast("string").alias("actual"), ok.alias("ok")]


def gate_row_count(df: DataFrame, expected: int) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.select(*_row("row_count", F.lit(expected), F.col("n"), F.col("n") == expected))


def gate_unique(df: DataFrame, key: str) -> DataFrame:
    extra = df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("n"))
    return extra.select(*_row("unique", F.lit(0), F.col("n"), F.col("n") == 0))


def gate_no_orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    n = rows.join(parents.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return n.select(*_row("no_orphans", F.lit(0), F.col("n"), F.col("n") == 0))


def gate_chronological(df: DataFrame, ts: str) -> DataFrame:
    train, test = F.col("split") == "train", F.col("split") == "test"
    edge = df.agg(F.max(F.when(train, micros(F.col(ts)))).alias("last_train"),
                  F.min(F.when(test, micros(F.col(ts)))).alias("first_test"))
    return edge.select(*_row("chronological", F.col("first_test"), F.col("last_train"),
                             F.coalesce(F.col("last_train") <= F.col("first_test"), F.lit(True))))


def gate_no_leakage(cards: DataFrame, test: DataFrame, card_key: str, key: str) -> DataFrame:
    shared = cards.select(F.col(card_key).alias("_k")).join(test.select(F.col(key).alias("_k")), "_k", "left_semi")
    n = shared.agg(F.count(F.lit(1)).alias("n"))
    return n.select(*_row("no_leakage", F.lit(0), F.col("n"), F.col("n") == 0))


def enforce(*gates: DataFrame) -> None:
    """Raise before anything is written if a gate fails."""
    for gate in gates:
        row = gate.first()
        if not row["ok"]:
            raise GateFailed(f"{row['gate']}: expected {row['expected']}, got {row['actual']}")
