"""Personal data in texts: regex, gazetteer and context labelers vote on candidate spans, EM weighs the labelers.

Everything is DataFrame functions. Patterns find candidate spans; each labeler says yes, no or nothing about each; expectation-
maximisation over the counted vote patterns estimates how reliable the labelers are, and a logistic span classifier is fitted to
the resulting probabilities. It decides about the candidates beyond the base spans; base spans always stay.

Patterns are written without ambiguity (possessive, and entered only where a run of characters starts), so that a text is
searched in time proportional to its length.
"""

from __future__ import annotations

import functools
import math
import operator
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslattice.llm.common import columns_of, free_name, staged

# The four base kinds.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]"),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9])++", "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "\\+[0-9]"),
}
FIRST_NAMES = ["Anna", "Antonio", "Carlos", "Claire", "David", "Elena", "Emma", "Hans", "Heike", "Isabel", "James", "Jean", "John",
               "Julia", "Karl", "Klaus", "Laura", "Lucas", "Maria", "Marie", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert",
               "Sarah", "Sofia", "Thomas", "William"]
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]
# Kinds that only the classifier can admit.
FURTHER = {
    "account": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2}"),
    "national_id": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "[0-9]-[0-9]{2}-[0-9]"),
    "person": (rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(TITLES + FIRST_NAMES)})\.? \p{{Lu}}\p{{Ll}}{{1,30}}+(?: \p{{Lu}}\p{{Ll}}{{1,30}}+)?",
               rf"(?:{'|'.join(TITLES + FIRST_NAMES)})\.? \p{{Lu}}"),
    "secret": (r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])", "[0-9a-f]{32}"),
}
KINDS = [*BASE, *FURTHER]
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us"]
CONTEXT = {
    "email": ["mail", "contact", "write", "kontakt", "correo", "courriel"],
    "ip": ["ip", "host", "server", "address", "login", "adresse"],
    "card": ["card", "visa", "credit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"],
    "account": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "national_id": ["ssn", "social security", "national id", "tax id"],
    "person": ["name", "author", "dear", "by", "sincerely", "von", "por", "par"],
    "secret": ["token", "secret", "key", "password", "passwd", "credential"],
}
COUNTER_CONTEXT = ["version", "section", "isbn", "issn", "doi", "page", "figure", "commit", "checksum", "sha1", "sha256", "md5", "hash"]
NEAR = 32  # characters of context on the left
CHUNK = 256
ROUNDS = 30
ADMIT = 0.5
SPAN = "array<struct<kind:int,start:long,end:long,text:string,left:string,right:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    weighed = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    """The test that the base kinds name; further kinds have none."""
    if kind == "ip":
        parts = F.transform(F.split(text, "\\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        number = _digits(text)
        return F.length(number).between(14, 19) & luhn(number)
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    return F.lit(True)


def _starts(gaps: Column, found: Column) -> Column:
    """Start of each match: lengths of all that lies before it, summed in chunks so that arrays stay short."""
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(
        F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len")))
    empty = F.expr("array()").cast("array<long>")

    def in_chunk(acc: Column, at: Column) -> Column:
        inner = F.aggregate(
            F.slice(both, at * CHUNK + 1, CHUNK), F.struct(acc["pos"].alias("pos"), empty.alias("out")),
            lambda a, x: F.struct((a["pos"] + x["gap"] + x["len"]).alias("pos"), F.concat(a["out"], F.array(a["pos"] + x["gap"])).alias("out")))
        return F.element_at(F.transform(F.array(inner), lambda r: F.struct(
            r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), 1)

    chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.expr("array()").cast("array<array<long>>").alias("out"))
    return F.flatten(F.aggregate(chunks, start, in_chunk)["out"])


def _found(text: Column, kind: str) -> Column:
    """Spans of one kind, leftmost and non-overlapping, that pass the test of the kind."""
    pattern, gate = (BASE | FURTHER)[kind]
    number = KINDS.index(kind)

    def spans(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        rows = F.zip_with(found, _starts(gaps, found), lambda m, s: F.struct(
            F.lit(number).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("text")))
        rows = F.transform(rows, lambda r, i: r.withField("left", F.lower(F.right(F.get(gaps, i), F.lit(NEAR)))).withField(
            "right", F.left(F.get(gaps, i + 1), F.lit(1))))
        return F.filter(rows, lambda r: _valid(kind, r["text"]))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    some = F.filter(F.array(parts), lambda p: F.size(p["found"]) > 0)
    # The gate is a cheap necessary condition; most texts end there.
    return F.when(text.contains("@") if gate == "@" else text.rlike(gate), F.flatten(F.transform(some, spans)).cast(SPAN)).otherwise(
        F.expr("array()").cast(SPAN))


def with_candidates(docs: DataFrame, text: str = "text", spans: str = "_spans") -> DataFrame:
    """docs plus a column with all candidate spans, base and further."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn(spans, F.concat(*[_found(whole, k) for k in KINDS]))


def _of_kind(span: Column, by_kind: dict[str, Column]) -> Column:
    out = F.lit(0)
    for kind, value in by_kind.items():
        out = F.when(span["kind"] == KINDS.index(kind), value).otherwise(out)
    return out


def _word(text: Column, words: list[str]) -> Column:
    return text.rlike(rf"(?<![\p{{L}}])(?:{'|'.join(words)})")


def _says(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote if no is None else vote.when(no, -1)).otherwise(0)


def votes(span: Column) -> dict[str, Column]:
    """Votes of the labelers on a span: 1 yes, -1 no, 0 nothing to say."""
    text, left, right = span["text"], span["left"], span["right"]
    repeats = text.rlike(r"^(.)\1*+$|^0+$")
    few_characters = F.size(F.array_distinct(F.split(text, ""))) < 8
    shape = _of_kind(span, {
        "email": _says(text.rlike(r"^[A-Za-z0-9][^@]*@[^@]+\.[A-Za-z]{2,24}$"), text.rlike(r"\.[0-9]+$|^[.%+-]")),
        "ip": _says(text.rlike(r"^[1-9][0-9]{0,2}\."), text.rlike(r"^0|(\.0){3}$")),
        "card": _says(text.rlike(r"^[0-9]{14,19}$|^[0-9]{4}([ -][0-9]{4}){3}$"), repeats),
        "phone": _says(text.rlike(r"^\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]"), text.rlike(r"\.\.|--|^\+0")),
        "account": _says(text.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7,}"), F.length(text) < 16),
        "national_id": _says(~text.rlike(r"^(000|666|9)|-00-|0000$"), text.rlike(r"^(000|666|9)|-00-|0000$")),
        "person": _says(text.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}"), F.length(text) < 8),
        "secret": _says(F.length(text).isin(32, 40, 48, 64, 96, 128), few_characters),
    })
    gazetteer = _of_kind(span, {
        "email": _says(text.rlike(rf"\.(?:{'|'.join(TOP_DOMAINS)})$"), text.rlike(r"\.(?:png|jpg|gif|js|css|local)$")),
        "ip": _says(text.rlike(r"^(?:10|127|172|192)\.")),
        "card": _says(text.rlike(r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])")),
        "phone": _says(text.rlike(r"^\+(?:1|33|34|49|44|39|41|43)[^0-9]?")),
        "account": _says(text.rlike(r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU)")),
        "person": _says(text.rlike(rf"^(?:{'|'.join(TITLES)})\.? |(?:^| )(?:{'|'.join(FIRST_NAMES)}) ")),
    })
    context = _of_kind(span, {k: _says(_word(left, words)) for k, words in CONTEXT.items()})
    assigned = _says(left.rlike(r"[=:]\s*[\"'(<]?$"))
    edges = _says(~right.rlike(r"[\p{L}\p{N}]") & ~left.rlike(r"[\p{L}\p{N}]$"), right.rlike(r"[\p{L}\p{N}]") | left.rlike(r"[\p{L}\p{N}]$"))
    against = F.when(_word(left, COUNTER_CONTEXT), -1).otherwise(0)
    return {"shape": shape, "gazetteer": gazetteer, "context": context, "assigned": assigned, "edges": edges, "against": against}


def features(span: Column) -> list[Column]:
    """What the span classifier sees: kind, size, surroundings."""
    text, left, right = span["text"], span["left"], span["right"]
    flags = [span["kind"] == i for i in range(len(KINDS))] + [
        F.length(text) < 12, F.length(text) >= 24, text.rlike("[0-9]"), text.rlike("[A-Z]"), text.rlike("[ ().-]"),
        left.rlike(r"[=:]\s*[\"'(<]?$"), left == "", right.rlike(r"[\p{L}\p{N}]"), left.rlike(r"[\p{L}\p{N}]$"),
        functools.reduce(operator.or_, [(span["kind"] == KINDS.index(k)) & _word(left, w) for k, w in CONTEXT.items()]),
        _word(left, COUNTER_CONTEXT)]
    return [F.coalesce(f, F.lit(False)).cast("double") for f in flags]


class Labeler(NamedTuple):
    """Chances of the votes -1, 0, 1 for spans that are not personal, and for those that are."""
    no: tuple[float, float, float]
    yes: tuple[float, float, float]


class Model(NamedTuple):
    prior: float
    labelers: dict[str, Labeler]
    weights: list[float]
    intercept: float


def _posterior(prior: float, labelers: dict[str, Labeler]) -> Column:
    """Chance that a span with the votes in the columns is personal data."""
    score = F.lit(math.log(prior / (1 - prior)))
    for name, l in labelers.items():
        score = score + F.element_at(F.array(*[F.lit(math.log(y / n)) for n, y in zip(l.no, l.yes)]), F.col(name) + 2)
    return 1 / (1 + F.exp(-score))


def _chance(prior: float, labelers: dict[str, Labeler], votes: dict[str, int]) -> float:
    score = math.log(prior / (1 - prior)) + sum(math.log(l.yes[votes[k] + 1] / l.no[votes[k] + 1]) for k, l in labelers.items())
    return 1 / (1 + math.exp(-score))


def reliabilities(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, Labeler]]:
    """EM over (votes of each labeler, n), one row per distinct pattern of votes.

    There are at most 3 ** len(names) patterns, 729 for six labelers, however many spans there are. They are read once.
    """
    prior, labelers = 0.5, {name: Labeler((0.4, 0.4, 0.2), (0.1, 0.4, 0.5)) for name in names}
    rows = sorted((tuple(r[name] for name in names), r["n"]) for r in patterns.select(*names, "n").collect())
    everything = sum(n for _, n in rows)
    for _ in range(rounds if everything else 0):
        yes, hits = 0.0, {(name, vote): [0.0, 0.0] for name in names for vote in (-1, 0, 1)}
        for votes, n in rows:
            p = _chance(prior, labelers, dict(zip(names, votes)))
            yes += n * p
            for hit in zip(names, votes):
                hits[hit][0] += n * (1 - p)
                hits[hit][1] += n * p
        # One made-up vote of each kind keeps chances off zero; a labeler is not allowed to mean the opposite of what it says.
        new = {}
        for name in names:
            chances = [tuple((hits[name, v][side] + 1) / (total + 3) for v in (-1, 0, 1)) for side, total in enumerate((everything - yes, yes))]
            upside_down = chances[1][2] * chances[0][0] < chances[0][2] * chances[1][0]
            new[name] = labelers[name] if upside_down else Labeler(*chances)
        moved = max(abs(a - b) for name in names for s, t in zip(new[name], labelers[name]) for a, b in zip(s, t))
        prior, labelers = (yes + 1) / (everything + 2), new
        if moved < 1e-4:
            break
    return prior, labelers


def fit(docs: DataFrame, spans: str = "_spans") -> Model:
    """Labeler reliabilities and the span classifier, from the candidates of all documents. No candidates: nothing is admitted."""
    span = F.col("span")
    votes_of = votes(span)
    names = list(votes_of)
    spans = docs.select(F.explode(spans).alias("span"))
    seen = spans.select(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in votes_of.items()], F.array(*features(span)).alias("features"))
    counted = staged(seen.groupBy(*names, "features").agg(F.count(F.lit(1)).alias("n")), "pii-votes")
    patterns = staged(counted.groupBy(*names).agg(F.sum("n").alias("n")), "pii-patterns")
    prior, labelers = reliabilities(patterns, names)
    soft = counted.withColumn("_p", _posterior(prior, labelers)).groupBy("features").agg(
        F.sum(F.col("n") * F.col("_p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("_p"))).alias("no"))
    rows = soft.select(array_to_vector("features").alias("features"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight"))
    )).alias("s")).select("features", "s.*").filter("weight > 0")
    if rows.isEmpty():
        return Model(prior, labelers, [0.0] * (len(KINDS) + 11), -1.0)
    line = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50).fit(rows)
    return Model(prior, labelers, [float(w) for w in line.coefficients], float(line.intercept))


def _admitted(span: Column, model: Model) -> Column:
    score = functools.reduce(operator.add, [f * w for f, w in zip(features(span), model.weights)], F.lit(model.intercept))
    return (span["kind"] < len(BASE)) | (1 / (1 + F.exp(-score)) >= ADMIT)


def admitted(model: Model, spans: str = "_spans") -> Column:
    """Array of (start, kind, end) of base and admitted spans, by start, then kind as listed."""
    chosen = F.filter(spans, lambda s: _admitted(s, model))
    return F.array_sort(F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_further), one row per row of docs.

    Null texts count as empty: no spans, the hash of the empty string. Repeated rows and null ids are treated row by row;
    an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = staged(with_candidates(docs).select("doc_id", "_spans"), "pii-candidates")  # texts are searched once
    found = found.withColumn("_spans", admitted(fit(found)))
    base = F.filter("_spans", lambda s: s["kind"] < len(BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"),
                        F.size(F.filter("_spans", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_further"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    Other columns stay as they are, and so do texts without spans and null texts.
    """
    spans = free_name(docs, "spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    whole = F.col(f"`{text}`")
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.expr("array()").cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        before = F.concat(F.substring(whole, acc["pos"] + 1, s["start"] - acc["pos"]), F.get(names, s["kind"]))
        return F.when(s["start"] < acc["pos"], F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(before)).alias("out")))

    done = F.aggregate(spans, start, cut, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(whole, acc["pos"] + 1, F.length(whole))))
    found = staged(with_candidates(docs, text, spans), "pii-candidates")
    found = found.withColumn(spans, admitted(fit(found, spans), spans))
    return found.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(whole)).select(*columns_of(docs))
