import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opslattice.llm import pii
from opslattice.llm.queries import QUERIES
from tests.llm.conftest import documents

KINDS = ["email", "ip", "card", "phone"]


def base_spans(text):
    text, out = text or "", []

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            n = int(c) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def expected(text):
    spans = base_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return [sum(s[0] == k for s in spans) for k in KINDS], hashlib.sha256(joined.encode()).hexdigest(), {f"{k}:{a}:{b}" for k, a, b in spans}


def compare(result, texts):
    rows = {r["doc_id"]: r for r in result.collect()}
    assert len(rows) == len(texts)
    for i, text in texts.items():
        counts, sha, spans = expected(text)
        r = rows[i]
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) == (counts, sha), (i, text, r["spans"])
        assert spans <= set(filter(None, r["spans"].split(",")))


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    compare(QUERIES["op1_pii"](spark, folder), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()})


TRICKY = [
    "a@b.com_x@y.z", "a@b.c.d@e.f", "..%+@x.y", "a@b", "@b.c", "é@b.co", "1.2.3.4.5.6.7.8", "1.2.3", "01.002.0003.255", "1.2.3.256", "9999.1.1.1",
    "4111111111111111", "4111-1111 1111-1111", "4111  111111111111", "12 4845168114407329", "4111111111111111-", "00000000000000", "+1 (234) 567-8901",
    "+1234567890123456", "+12", "+1 2345 6789 0 ", "++49 30 1234567.", "+49(0)30-123.45.67 +1 800 555 0100", "😀 a@b.co 😀 10.0.0.1 ü +44 20 7946 0958",
    "token = \"" + "0a1b2c3d4e" * 4 + "\"", "call 4111111111111111@b.co", "", None, "a@b.co\n" * 600, "1 " * 3000, "9" * 5000, "a" * 20000 + "@", "a.b@" * 5000,
]


def test_tricky_texts(spark):
    compare(pii.digest(documents(spark, TRICKY)), dict(enumerate(TRICKY)))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="01459.@+- ()aZ_%ü", max_size=40), min_size=400, max_size=400))
def test_random_texts(spark, texts):
    compare(pii.digest(documents(spark, texts)), dict(enumerate(texts)))


@pytest.fixture(scope="module")
def mixed(spark):
    secrets = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" und so weiter' for i in range(40)]
    plain = ["a quiet sentence without anything" for _ in range(40)]
    hashes = [f"commit {hashlib.sha1(str(-i).encode()).hexdigest()} merged" for i in range(40)]
    mails = [f"mail me: user{i}@example.org today" for i in range(40)]
    return documents(spark, secrets + plain + hashes + mails)


def test_method_adds_secrets_and_leaves_plain_texts_alone(spark, mixed):
    rows = {r["doc_id"]: r["spans"] for r in pii.digest(mixed).collect()}
    assert all(rows[i].startswith("secret:9:49") for i in range(40))
    assert all(rows[i] == "" for i in range(40, 80))
    assert all(rows[i].startswith("email:9:") for i in range(120, 160))


def test_em_finds_the_reliable_labeler(spark):
    # Two labelers agree with the truth nine times in ten, the third says yes to everything.
    patterns = [(1, 1, 1, 405), (1, -1, 1, 90), (-1, 1, 1, 90), (-1, -1, 1, 415)]
    table = spark.createDataFrame(patterns, "good int, fair int, eager int, n long")
    prior, labelers = pii.reliabilities(table, ["good", "fair", "eager"])
    assert 0.4 < prior < 0.6
    weight = {k: l.yes[2] / l.no[2] for k, l in labelers.items()}
    assert weight["good"] > 3 and weight["fair"] > 3 and 0.8 < weight["eager"] < 1.25


def test_redaction(spark):
    docs = documents(spark, ["Mail a@b.co or +1 (234) 567-8901 now", "nothing here", None, "", "ü 10.0.0.1", "x 4111111111111111@b.co y"])
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == [
        "Mail [EMAIL] or [PHONE] now", "nothing here", None, "", "ü [IP]", "x [EMAIL] y"]


def test_rough_rows(spark, rough, nothing):
    assert pii.digest(rough).count() == rough.count() and pii.digest(nothing).collect() == []
    done = pii.redact(rough)
    assert done.columns == rough.columns and done.count() == rough.count()
    assert pii.redact(nothing).collect() == []
    assert not any("@" in (r["text"] or "") for r in done.collect())


def test_no_python_on_the_way(spark, mixed):
    plan = pii.digest(mixed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
