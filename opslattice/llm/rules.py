"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document whose statistic exceeds a cutoff. Labelled documents of known quality decide the cutoff, per stratum:
from the mildest on, cutoffs are tested in a fixed order for "at most `risk` of the good documents are rejected" with an exact
binomial bound, and the order stops at the first that fails. The fixed order needs no correction among the cutoffs of a rule;
across rules and strata the error is split evenly (Bonferroni), and the risk is split across the rules of a stratum. Among
certified cutoffs the one that best parts bad from good documents is taken.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslattice.llm.common import staged

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
RISK = 0.03  # share of good documents of a stratum that all rules together may reject
ERROR = 0.05  # chance that any bound is wrong
WEIGHT = 10  # a wrongly rejected share of the good documents weighs so many times a rejected share of the bad
STEPS = 200  # cutoffs per rule: 0, 1/200, ..., 1
RULES = ["symbol_share", "duplicate_line_share", "repeated_word_share"]
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
STATISTICS = BASE + ", " + ", ".join(f"{r} double" for r in RULES)
REST = "(rest)"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.zeros(len(words), dtype=bool)
    for i, window in enumerate(windows):
        if counts[window] > 1:
            hit[i: i + 3] = True
    return int(hit.sum())


def text_statistics(text: str | None) -> tuple:
    """Values of STATISTICS for one whole text; null is the empty text."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
    words = raw.split()  # splits at space and the controls 9 to 13, as bytes know no other white space
    joined = b"".join(words)
    chars = len(joined.decode("utf-8"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(b"\x20\t\x0b\x0c\r")]
    repeated_lines = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    return (len(words), chars, symbols, repeated_lines, repeated, symbols / max(chars, 1), repeated_lines / max(len(lines), 1),
            repeated / max(len(words), 1))


def measured(text: Column) -> Column:
    """STATISTICS of a text column as a struct."""
    names = [c.split()[0] for c in STATISTICS.split(", ")]

    @F.pandas_udf(STATISTICS)
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t) for t in texts], columns=names)

    return measure(text.cast("string"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED_PERCENT * s["n_words"])


def at_most(k: int, n: int, share: float) -> float:
    """P(Bin(n, share) <= k). The exact upper bound for a share is below `share` at level e if and only if this is <= e."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)
            for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(good: list[int], bad: list[int], risk: float, error: float) -> int | None:
    """Step of the chosen cutoff, or None if not even the mildest can be certified.

    good[s] and bad[s] count the labelled documents whose statistic lies in step s, that is in (s-1, s] / STEPS.
    """
    n, n_bad = sum(good), sum(bad)
    best, chosen, rejected, caught = -1.0, None, 0, 0
    for step in range(len(good) - 1, -1, -1):
        # a cutoff at `step` rejects all documents of later steps
        if at_most(rejected, n, risk) > error:
            break
        gain = caught / max(n_bad, 1) - WEIGHT * rejected / max(n, 1)
        if gain > best:
            best, chosen = gain, step
        rejected, caught = rejected + good[step], caught + bad[step]
    return chosen


class Cutoff(NamedTuple):
    stratum: str
    rule: str
    cutoff: float


def needed(risk: float, error: float) -> int:
    """Good documents without which a stratum cannot certify any cutoff."""
    return math.ceil(math.log(error) / math.log1p(-risk))


def cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> list[Cutoff]:
    """Certified cutoffs from (stratum, good, RULES...). Strata with too few good documents are judged together, as REST."""
    sizes = {r["stratum"]: r["n"] for r in labelled.filter("good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= needed(risk / len(RULES), error / len(RULES))).collect()}
    share = error / (len(RULES) * (len(sizes) + 1))
    large = [s for s, n in sizes.items() if s is not None and n >= needed(risk / len(RULES), share)]
    own = F.when(F.col("stratum").isin(large), F.col("stratum")).otherwise(F.lit(REST)) if large else F.lit(REST)
    steps = [F.struct(F.lit(r).alias("rule"), F.least(F.lit(STEPS), F.ceil(F.col(r) * STEPS)).cast("int").alias("step")) for r in RULES]
    counted = labelled.select(own.alias("stratum"), "good", F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "s.rule", "s.step").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()
    out = []
    for stratum in [*sorted(large), REST]:
        for rule in RULES:
            good, bad = [0] * (STEPS + 1), [0] * (STEPS + 1)
            for r in counted:
                if (r["stratum"], r["rule"]) == (stratum, rule):
                    good[r["step"]], bad[r["step"]] = r["good"], r["bad"]
            step = certified(good, bad, risk / len(RULES), share)
            if step is not None:
                out.append(Cutoff(stratum, rule, step / STEPS))
    return out


def quality_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good), one row per labelled document; a document that is labelled both ways counts as bad."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def verdict(found: list[Cutoff], s: Column, lang: Column) -> Column:
    """Whether a document is kept: neither the base rule nor a certified cutoff of its stratum rejects it."""
    strata = sorted({c.stratum for c in found} - {REST})
    stratum = F.when(lang.isin(strata), lang).otherwise(F.lit(REST)) if strata else F.lit(REST)
    rejected = base_failed(s)
    for c in found:
        rejected = rejected | ((stratum == c.stratum) & (F.ceil(s[c.rule] * STEPS) > round(c.cutoff * STEPS)))
    return ~rejected


def calibrated(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> tuple[DataFrame, list[Cutoff]]:
    """(doc_id, lang, s) written once for all of docs, and the cutoffs certified on the labelled ones."""
    small = staged(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), measured(F.col("text")).alias("s")), "rules-statistics")
    labelled = small.filter(~base_failed(F.col("s"))).join(quality_labels(labels), "doc_id").select(
        F.col("lang").alias("stratum"), "good", *[f"s.{r}" for r in RULES])
    return small, cutoffs(labelled, risk, error)


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, the five base statistics, base_failed, kept, the statistics of the rules), one row per row of docs.

    Null, empty and blank texts have no words and fail the base rule. A null lang belongs to the rest. Without labels, or
    with too few, nothing is certified and only the base rule rejects. Repeated rows and null ids are judged row by row; a
    repeated row of a labelled document counts once per row in the calibration. An empty table gives no rows; other columns
    are ignored.
    """
    small, found = calibrated(docs, labels, risk, error)
    s = F.col("s")
    return small.select("doc_id", *[f"s.{c.split()[0]}" for c in BASE.split(", ")], base_failed(s).alias("base_failed"),
                        verdict(found, s, F.col("lang")).alias("kept"), *[f"s.{r}" for r in RULES])


def accepted(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of docs that are kept, columns as they were; cases as in judged()."""
    _, found = calibrated(docs, labels, risk, error)
    held = docs.withColumn("__rule_statistics", measured(F.col("text")))
    return held.filter(verdict(found, F.col("__rule_statistics"), F.col("lang").cast("string"))).select(*docs.columns)
