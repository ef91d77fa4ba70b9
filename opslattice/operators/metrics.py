"""Splits, thresholds and exact classification metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslattice.functions.parsing import micros
from opslattice.functions.statistics import precision_recall_f1, ratio
from opslattice.operators.sessions import one_row
from opslattice.plans.ranks import exact_percentile, kth_smallest, order_values, running_totals, written_order_values, written_percentile
from opslattice.plans.runtime import written


def split_point(df: DataFrame, ts: str, key: str, n_first: Callable[[int], int]) -> tuple[int, int] | None:
    """(time in micros, key) of the last of the first n_first(n) rows ordered by (ts, key)."""
    timed = written(df.select(micros(F.col(ts)).alias("v"), F.col(key).alias("_k")).filter("v IS NOT NULL"), "times")
    n, found = written_order_values(timed.select("v"), lambda n: [n_first(n) - 1] if n_first(n) > 0 else [])
    if not found:
        return None
    at = found[0]
    last = kth_smallest(timed.filter(F.col("v") == at.value), "_k", n_first(n) - at.below - 1)
    return at.value, last.value


def before_split(ts: Column, key: Column, point: tuple[int, int] | None) -> Column:
    if point is None:
        return F.lit(False)
    at, last = point
    return (micros(ts) < at) | ((micros(ts) == at) & (key <= last))


def chrono_split(df: DataFrame, ts: str, key: str, frac: float = 0.7) -> DataFrame:
    """Add split: the first int(n * frac) rows by (ts, key) are 'train'.

    The cut is found by selection, so the split itself is a filter: no sort, no shuffle.
    """
    first = before_split(F.col(ts), F.col(key), split_point(df, ts, key, lambda n: int(n * frac)))
    return df.withColumn("split", F.when(first, "train").otherwise("test"))


def binary_metrics(df: DataFrame, label: str, score: str, flag: str) -> DataFrame:
    """Precision, recall, F1, flagged count, and ROC-AUC / average precision.

    The ranking metrics are null unless there are more than two distinct scores.
    """
    counts = df.agg(
        F.count_if(F.col(label) & F.col(flag)).alias("tp"),
        F.count_if(flag).alias("flagged"), F.count_if(label).alias("pos"),
    ).select(*precision_recall_f1(F.col("tp"), F.col("flagged"), F.col("pos")), "flagged")
    return one_row([counts, ranking_metrics(df, label, score)])


def score_steps(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative true and false positives at every distinct score, highest first."""
    hist = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(label).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    return running_totals(hist, "score", ["pos", "neg"], descending=True)


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """Trapezoid ROC-AUC and step-wise average precision from the cumulative counts."""
    steps = score_steps(df, label, score)
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = steps.agg(
        F.sum(area).alias("area"), F.sum(F.col("pos") * precision).alias("ap"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count(F.lit(1)).alias("distinct_scores"),
    )
    usable = F.col("distinct_scores") > 2
    return sums.select(
        F.when(usable & (F.col("p") > 0) & (F.col("n") > 0), F.col("area") / (F.col("p") * F.col("n"))).alias("roc_auc"),
        F.when(usable & (F.col("p") > 0), F.col("ap") / F.col("p")).alias("pr_auc"),
    )


def threshold_curve(df: DataFrame, label: Column, score: Column, grid: list[float], base: Column | None = None) -> DataFrame:
    """F1 of (base or score >= t) for every t of the grid.

    Each row is counted once, under the number of thresholds it reaches; the grid is
    then accumulated over at most len(grid) + 1 rows.
    """
    base = F.lit(False) if base is None else base
    passed = reduce(lambda a, b: a + b, [F.when(score >= float(t), 1).otherwise(0) for t in grid])
    reached = F.when(base, F.lit(len(grid))).otherwise(passed)
    counts = df.select(reached.alias("reached"), label.alias("y")).groupBy("reached").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos")
    )
    spark = df.sparkSession
    steps = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(sorted(grid))], "step int, threshold double")
    down = Window.orderBy(F.desc("reached")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    table = (
        counts.join(steps, counts["reached"] == steps["step"], "full")
        .withColumn("reached", F.coalesce("reached", "step"))
        .withColumn("tp", F.sum(F.coalesce("pos", F.lit(0))).over(down))
        .withColumn("flagged", F.sum(F.coalesce("n", F.lit(0))).over(down))
        .withColumn("positives", F.sum("pos").over(total))
        .filter(F.col("threshold").isNotNull())
    )
    return table.select(
        "threshold", "tp", "flagged",
        *precision_recall_f1(F.col("tp"), F.col("flagged"), F.coalesce("positives", F.lit(0))),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """The lowest threshold among those with the highest F1."""
    return curve.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def percentile_threshold(df: DataFrame, column: str, p: float = 0.96) -> DataFrame:
    value = exact_percentile(df, column, p)
    return df.sparkSession.createDataFrame([(p, value)], "p double, threshold double")


def latency_percentiles(df: DataFrame, column: str) -> DataFrame:
    """Median, and the value at rank floor(0.95 n) (1-based); empty and zero latencies are dropped."""
    kept = df.filter(F.col(column) != 0)
    n, ranks = order_values(
        kept, column, lambda n: [(n - 1) // 2, n // 2, max(int(0.95 * n) - 1, 0)] if n else [])
    p50 = (float(ranks[0].value) + float(ranks[1].value)) / 2 if n else None
    p95 = float(ranks[2].value) if n else None
    return df.sparkSession.createDataFrame([(n, p50, p95)], "n bigint, p50 double, p95 double")


def median_mad(df: DataFrame, column: str) -> DataFrame:
    """Exact median and median absolute deviation; a MAD of 0 counts as 1."""
    values = written(df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull()))
    med = written_percentile(values, 0.5)
    mad = exact_percentile(values.select(F.abs(F.col("v") - F.lit(med)).alias("d")), "d", 0.5)
    return df.sparkSession.createDataFrame([(med, mad or 1.0)], "median double, mad double")


def detector_overlap(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """Positives caught by either detector, false alarms of each, and their OR combined."""
    y, fa, fb = F.col(label), F.col(a), F.col(b)
    counts = df.agg(
        F.count_if(y & fa).alias("caught_a"), F.count_if(y & fb).alias("caught_b"),
        F.count_if(y & fa & fb).alias("caught_both"), F.count_if(y & (fa | fb)).alias("caught_any"),
        F.count_if(~y & fa).alias("false_a"), F.count_if(~y & fb).alias("false_b"),
        F.count_if(fa | fb).alias("flagged_any"), F.count_if(y).alias("positives"),
    )
    return counts.select("*", *precision_recall_f1(F.col("caught_any"), F.col("flagged_any"), F.col("positives")))


def accuracy_by_type(df: DataFrame, kind: str, ok: str) -> DataFrame:
    """n and accuracy per type plus the overall row (type null) in one pass."""
    return df.rollup(kind).agg(
        F.count(F.lit(1)).alias("n"), ratio(F.count_if(ok), F.count(F.lit(1))).alias("accuracy")
    )
