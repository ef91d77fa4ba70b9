"""Exact order statistics and running totals without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslattice.plans.runtime import written

SPLITS = 1_000
SAMPLE = 20_000  # rows that are drawn to place a bracket around a rank
BAND = 50_000  # rows that may be read to the driver once the search has closed in on them


class Ranked(NamedTuple):
    value: object
    below: int  # rows with a strictly smaller value


def _split_points(df: DataFrame, column: str, parts: int) -> list[float]:
    probabilities = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(column, probabilities, 1.0 / (4 * parts))))


def _bucketed(df: DataFrame, column: str, splits: list[float]) -> DataFrame:
    edges = [-math.inf, *[x for x in splits if math.isfinite(x)], math.inf]
    if len(edges) < 3:
        return df.withColumn("_bucket", F.lit(0.0))
    return Bucketizer(splits=edges, inputCol=column, outputCol="_bucket", handleInvalid="keep").transform(df)


def order_values(df: DataFrame, column: str, pick: Callable[[int], list[int]], band: int = BAND,
                 sample: int = SAMPLE) -> tuple[int, list[Ranked]]:
    """(n, values at the 0-based ranks pick(n)) of a column of any ordered type, without its nulls.

    The column is written once, and nothing above it runs again. A uniform sample of it brackets each rank, one pass counts the
    rows below and at the ends of the bracket, and what lies inside, about 3 percent of the rows, is read or, if there is more of it than
    `band` rows, written and searched in the same way. Nothing is shuffled or sorted but the last few rows. NaN is the largest
    number, as everywhere in Spark.
    """
    return written_order_values(written(df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull())), pick, band, sample)


def written_order_values(values: DataFrame, pick: Callable[[int], list[int]], band: int = BAND,
                         sample: int = SAMPLE) -> tuple[int, list[Ranked]]:
    """The same for a written frame with one column `v` without nulls."""
    n = values.count()
    ranks = pick(n)
    if any(r < 0 or r >= n for r in ranks):
        raise ValueError(f"rank outside the {n} values")
    known: list[Ranked] = []  # of the last rows that were read, with one past the end
    out = {}
    for rank in sorted(set(ranks)):
        inside = [k for k, following in zip(known, known[1:]) if k.below <= rank < following.below]
        if not inside:
            known = _closest(values, n, rank, band, sample)
            inside = [k for k, following in zip(known, known[1:]) if k.below <= rank < following.below]
        out[rank] = inside[0]
    return n, [out[r] for r in ranks]


def _order(value) -> tuple:
    return (True, 0) if isinstance(value, float) and math.isnan(value) else (False, value)


def _bracket(values: DataFrame, size: int, place: float, sample: int, seed: int) -> list:
    """Values of a sample around the part `place` of all rows: four standard errors below it, at it, and as far above it."""
    drawn = sorted((r["v"] for r in values.sample(min(1.0, 1.05 * sample / size), seed).collect()), key=_order)
    if not drawn:
        return []
    at, spread = int(place * len(drawn)), 2 * math.isqrt(len(drawn)) + 1
    points = [drawn[i] for i in (at - spread, at, at + spread) if 0 <= i < len(drawn)]
    return sorted({_order(p): p for p in points or [drawn[-1]]}.values(), key=_order)


def _closest(values: DataFrame, size: int, rank: int, band: int, sample: int) -> list[Ranked]:
    """Distinct values around the rank in order; the last entry only ends the one before it."""
    below, seed = 0, 0
    while size > band:
        seed += 1
        points = _bracket(values, size, (rank - below) / size, sample, seed)
        if not points:
            continue
        counts = values.agg(*[F.count_if(F.col("v") < F.lit(p)).alias(f"b{i}") for i, p in enumerate(points)],
                            *[F.count_if(F.col("v") == F.lit(p)).alias(f"e{i}") for i, p in enumerate(points)]).first()
        low, high = None, None
        for i, p in enumerate(points):
            start, end = below + counts[f"b{i}"], below + counts[f"b{i}"] + counts[f"e{i}"]
            if start <= rank < end:
                return [Ranked(p, start), Ranked(None, end)]
            if end <= rank:
                low = (p, end)
            elif high is None:
                high = (p, start)
        top = below + size if high is None else high[1]
        if low is not None:
            values, below = values.filter(F.col("v") > F.lit(low[0])), low[1]
        if high is not None:
            values = values.filter(F.col("v") < F.lit(high[0]))
        size = top - below
        if size > band:
            values = written(values, "band")
    found = sorted(values.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: _order(r["v"]))
    out = []
    for r in found:
        out.append(Ranked(r["v"], below))
        below += r["n"]
    return [*out, Ranked(None, below)]


def kth_smallest(df: DataFrame, column: str, k: int, band: int = BAND, sample: int = SAMPLE) -> Ranked:
    return order_values(df, column, lambda n: [k], band, sample)[1][0]


def exact_percentile(df: DataFrame, column: str, p: float, band: int = BAND) -> float | None:
    """Percentile with linear interpolation between the two neighbouring ranks."""
    return written_percentile(written(df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull())), p, band)


def written_percentile(values: DataFrame, p: float, band: int = BAND) -> float | None:
    """The same for a written frame with one column `v` without nulls."""
    n, found = written_order_values(values, lambda n: [math.floor(p * (n - 1)), math.ceil(p * (n - 1))] if n else [], band)
    if n == 0:
        return None
    low, high = float(found[0].value), float(found[1].value)
    if low == high or math.isnan(low):
        return low
    return low + (p * (n - 1) - math.floor(p * (n - 1))) * (high - low)


def positions(df: DataFrame, order: list[str], alias: str = "pos") -> DataFrame:
    """1-based position of every row in the order of the given columns, of any ordered types.

    Rows are dealt into ranges and sorted inside them; a row's position is its place in its range plus the rows of the ranges
    before it. Rows that are equal in all order columns share a range, so include an id. Nulls come first.
    """
    name = "_" + alias
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed = written(sorted_, "positions").withColumn("_range", F.shiftright(name, 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row per range
    return placed.join(F.broadcast(starts), "_range").withColumn(
        alias, F.col("_start") + F.col(name).bitwiseAND((1 << 33) - 1) + 1).drop("_range", "_start", name)


def running_totals(hist: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Add cum_<c> for every column in sums; `order` is unique in hist.

    Rows are cut into value ranges of similar size. Each range is accumulated by its
    own task and shifted by the totals of the ranges before it.
    """
    spark = hist.sparkSession
    parts = min(SPLITS, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = _bucketed(hist.withColumn("_x", F.col(order).cast("double")), "_x", _split_points(
        hist.withColumn("_x", F.col(order).cast("double")), "_x", parts))
    direction = F.desc if descending else F.asc
    totals = ranged.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    inner = (
        Window.partitionBy("_bucket").orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = ranged.join(F.broadcast(offsets), "_bucket")  # at most SPLITS rows
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(inner) + F.col(f"_o_{c}"))
    return out.drop("_bucket", "_x", *[f"_o_{c}" for c in sums])
