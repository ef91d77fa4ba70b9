import hashlib
import random
import re
from re import _constants, _parser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opslattice.llm import decontam, licenses, warc
from opslattice.llm.common import stage_path
from opslattice.llm.queries import QUERIES
from tests.llm.conftest import PLAIN, documents

FOLDER = "/root/testdata/sf0.001"


def nearest(pattern, text):
    """Least edit distance of pattern to a substring of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=1, max_size=90), st.text("abé", max_size=120))
def test_bit_parallel_distance(pattern, text):
    distance, end = decontam.Pattern(pattern).nearest(text)
    assert distance == nearest(pattern, text) == min(len(pattern), nearest(pattern, text[:end]))


def test_pieces_cover_the_item():
    for m in range(1, 80):
        for k in range(0, min(m, 6)):
            cut = decontam.pieces("x" * m, k)
            assert len(cut) == k + 1 and sum(len(p) for _, p in cut) == m and all(p for _, p in cut)


def test_pigeonhole_search_finds_what_brute_force_finds():
    draw = random.Random(4)
    items = [" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(14)) for _ in range(6)]
    prepared = [decontam.Item([i], t, int(len(t) * decontam.BUDGET)) for i, t in enumerate(items)]
    find = decontam.Searcher(prepared)
    for trial in range(120):
        text = [draw.choice("abcdefgh ") for _ in range(150)]
        item = draw.choice(items)
        damaged = list(item)
        for _ in range(draw.randrange(8)):
            at = draw.randrange(len(damaged))
            damaged[at: at + 1] = draw.choice([[], ["z"], [damaged[at], "z"]])
        text[60:60] = damaged
        text = "".join(text)
        expected = {i.ids[0]: nearest(i.text, text) for i in prepared if nearest(i.text, text) <= i.edits}
        assert {i.ids[0]: d for i, d, _ in find(text)} == expected, trial


def test_decontamination_query(spark):
    texts = {r["doc_id"]: decontam.normalised(r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r["item_id"]: decontam.normalised(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    rows = QUERIES["op2_benchmark_decontamination"](spark, FOLDER).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["distance"] == 0} == exact
    for r in rows:
        assert nearest(items[r["item_id"]], texts[r["doc_id"]]) == r["distance"] <= decontam.BUDGET * len(items[r["item_id"]])


def test_decontamination_of_rough_rows(spark, rough, nothing):
    items = spark.createDataFrame([(1, PLAIN, "x"), (2, PLAIN.upper(), "x"), (3, "", "x"), (4, None, "x"), (None, "wörter  und noch mehr", "x"), (1, PLAIN, "x")],
                                  "item_id long, text string, kept string")
    rows = decontam.matches(rough, items).collect()
    assert sorted({(r["doc_id"], r["item_id"] or -1) for r in rows}) == [(0, 1), (0, 2), (1, 1), (1, 2), (7, -1), (10, 1), (10, 2)]
    small = decontam.matches(rough, items, block_chars=10).collect()  # several blocks, the same finds
    assert {(r["doc_id"], r["item_id"]) for r in small} == {(r["doc_id"], r["item_id"]) for r in rows}
    left = decontam.without_benchmark(rough, items, block_chars=10)
    assert left.columns == rough.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [2, 3, 4, 5, 6, 8, 9, 9, 11]
    assert decontam.matches(nothing, items).collect() == [] and decontam.without_benchmark(nothing, items).collect() == []
    assert decontam.matches(rough, items.limit(0)).collect() == [] and decontam.without_benchmark(rough, items.limit(0)).count() == rough.count()


PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def license_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i: i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["cc", "BY", "by", "general", "public", "license", "all rights", "reserved", "é", "-", "_", "[", "4.0", "\x7f", "İ", "ß"]), max_size=25),
       st.sampled_from([" ", "-", "\n", ""]))
def test_license_base_of_random_texts(parts, between):
    text = between.join(parts)
    assert licenses.describe(text)[:5] == license_base(text)


def test_license_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op5_license_scan"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_base(texts[r["doc_id"]])
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("see https://www.mozilla.org/en-US/MPL/2.0/", "mpl-2.0"),
    ("This work is licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"), ("available under the GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and ...", "mit"),
    ("the mitigation of a permitted apache helicopter", ""), ("", ""), (None, ""),
])
def test_license_signatures(text, labels):
    assert licenses.describe(text)[5] == labels


def test_cover_equals_looking_at_all_intervals():
    rng = random.Random(4)
    for _ in range(300):
        cover, kept = licenses._Cover(), []
        for _ in range(rng.randint(1, 40)):
            start = rng.randint(0, 20)
            end = start + rng.randint(1, 12)
            contained = any(a <= start and end <= b for a, b in kept)
            assert cover.add(start, end) is not contained
            if not contained:
                kept.append((start, end))
        assert cover.starts == sorted(set(cover.starts)) and cover.ends == sorted(set(cover.ends))


def test_many_finds_take_time_in_proportion():
    import time
    text = "Licensed under the MIT License. Apache License 2.0, GPL version 3, all rights reserved. " * 4000
    start = time.process_time()
    finds = licenses.detect(licenses.normalised(text))
    assert len(finds) >= 8000 and time.process_time() - start < 8


def test_contained_finds_are_suppressed():
    words = licenses.normalised("Released under the MIT License. The MIT license is short.")
    assert [(f.label, words[f.start: f.end]) for f in licenses.detect(words)] == [("mit", b"released under the mit license"), ("mit", b"mit license")]
    assert len(licenses.RULES) > 200


def test_keyword_gate_never_hides_a_find():
    for line in open(licenses.__file__, encoding="utf-8").read().split("\n")[:3]:
        licenses.detect(licenses.normalised(line))
    texts = [t for t, *_ in [("licensed under the zlib license",), ("spdx license identifier wtfpl",), ("boost org license 1 0",), ("cc0 1 0",)]]
    for text in texts:
        words = licenses.normalised(text)
        every = [m for r in licenses.RULES for m in r.pattern.finditer(words)]
        assert bool(licenses.detect(words)) == bool(every)


@pytest.mark.parametrize("text, labels", [
    ("Mozilla Public License Version 2.0", "mpl-2.0"), ("Eclipse Public License v2.0", "epl-2.0"), ("Creative Commons Attribution 4.0", "cc-by"),
    ("GNU Free Documentation License", "gfdl"), ("GNU General Public License version 3", "gpl,gpl-3.0"), ("Creative Commons Zero", "cc0-1.0"),
    ("Do What The Fuck You Want To Public License", "wtfpl"),
])
def test_spelled_out_license_names(text, labels):
    assert licenses.describe(text)[5] == labels


def one_text_per_alternative(items):
    """Matches of a parsed expression, in which each alternative occurs with the first one of all others."""
    texts = [""]
    for op, value in items:
        if op is _constants.LITERAL:
            own = [chr(value)]
        elif op is _constants.IN:
            own = [chr(v) if o is _constants.LITERAL else chr(v[0]) if o is _constants.RANGE else "a" for o, v in value]
        elif op is _constants.BRANCH:
            own = [t for part in value[1] for t in one_text_per_alternative(part)]
        elif op is _constants.SUBPATTERN:
            own = one_text_per_alternative(value[3])
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
            own = [t * n for n in (value[0], value[0] + 1) if n <= value[1] for t in one_text_per_alternative(value[2])]
        else:
            assert op is _constants.ANY
            own = ["x"]
        texts = [t + own[0] for t in texts] + [texts[0] + o for o in own[1:]]
    return texts


def test_every_alternative_of_every_license_rule_passes_its_keywords():
    for rule in licenses.RULES:
        pattern = rule.pattern.pattern.decode().removeprefix("(?<= )").removesuffix("(?= )")
        for text in one_text_per_alternative(_parser.parse(pattern)):
            words = licenses.normalised(text)
            if words != f" {text} ".encode():  # two blanks in a row, which no text has as words
                continue
            assert rule.pattern.search(words) and rule in licenses.open_rules(words), (rule.label, text)


def test_license_of_rough_rows(spark, rough, nothing):
    rows = licenses.scanned(rough).collect()
    assert len(rows) == rough.count() and licenses.scanned(nothing).collect() == []
    one = next(r for r in rows if r["doc_id"] == 11)
    assert (one["n_base"], one["first_word"], one["last_word"], one["base_labels"]) == (2, 0, 3, "cc-by,reserved")


def warc_bytes(page_id, url, html):
    body = (html or "").encode()
    return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>\r\nWARC-Target-URI: {url or ''}\r\n"
            f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_parse_round_trip_and_damage():
    pages = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", ""), (3, None, "x\r\n\r\ny"), (None, "http://d/", "WARC/1.0\r\n")]
    body = b"".join(warc_bytes(*p) for p in pages)
    got = list(warc.parse(body))
    assert [body[a: a + n] for a, n, *_ in got] == [warc_bytes(*p) for p in pages]
    assert [(name, damaged) for _, _, name, _, damaged in got] == [("1", False), ("2", False), ("3", False), ("none", False)]
    broken = body.replace("é".encode(), b"zz")
    assert [d for *_, d in warc.parse(broken)] == [True, False, False, False]
    cut = body.replace(b"Content-Length: 9", b"Content-Length: 8")
    assert [d for *_, d in warc.parse(cut)] == [True, False, False, False]
    assert list(warc.parse(b"")) == []


def test_fixity_query(spark):
    pages = {str(r["page_id"]): r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = QUERIES["op3_warc_fixity"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["record_id"] for r in rows) == sorted(pages)
    import zlib
    hit = {i for i, html in pages.items() if zlib.crc32(i.encode()) % 97 == 0 and html and html[len(html) // 2].isascii()}
    assert hit == {r["record_id"] for r in rows if r["status"] == "changed"} == {r["record_id"] for r in rows if r["right_damaged"]}
    assert not any(r["left_damaged"] for r in rows) and {r["status"] for r in rows} <= {"same", "changed"}


PAGES = "page_id long, url string, html string, segment string, hash string"


def test_descent_finds_changes_and_compares_few_nodes(spark):
    left = spark.range(40_000).selectExpr("id % 4 AS segment", "floor(id / 4) * 1000 AS offset", "1000L AS length", "CAST(id AS string) AS record_id",
                                          "sha2(CAST(id AS string), 256) AS sha256", "false AS damaged")
    right = left.withColumn("sha256", warc.F.when(warc.F.col("record_id") == "12345", "bad").otherwise(warc.F.col("sha256"))).filter("record_id != '39999'")
    trees = [warc.tree(t) for t in (left, right)]
    leaves, compared = warc.mismatches(*trees)
    assert leaves.count() == 2 and compared < 4 + 2 * (warc.LEVELS + 1) * warc.FANOUT and trees[0].count() > 4 * compared
    rows = warc.audit(left, right)
    assert rows.count() == 40_000
    assert {(r["record_id"], r["status"]) for r in rows.filter("status != 'same'").collect()} == {("12345", "changed"), ("39999", "missing")}
    assert {r["status"] for r in warc.audit(right.limit(0), right.limit(50)).collect()} == {"added"}
    assert warc.audit(right.limit(0), right.limit(0)).collect() == []


def test_rough_pages(spark):
    rows = [(1, "http://a/", "<p>ü</p>" * 1000, "s", "h"), (1, "http://a/", "<p>ü</p>" * 1000, "s", "h"), (2, None, "", "s", "h"), (3, "u\r\nv", None, "s", "h"),
            (None, "http://b/", "x\r\n\r\nWARC/1.0\r\n", "s", "h")]
    pages = warc.segments(spark.createDataFrame(rows, PAGES), segment_bytes=4000)
    folder = stage_path(spark, "warc")
    warc.write_warc(pages, folder)
    read = warc.read_records(spark, folder)
    assert sorted((r["record_id"], r["damaged"]) for r in read.collect()) == [("1", False), ("1", False), ("2", False), ("3", False), ("none", False)]
    assert warc.segments(spark.createDataFrame([], PAGES)).collect() == []


def replica(spark, rows):
    folder = stage_path(spark, "warc")
    warc.write_warc(warc.segments(spark.createDataFrame(rows, PAGES), segment_bytes=1 << 30), folder)
    return folder


def statuses(left, right):
    return {r["record_id"]: r["status"] for r in warc.audit(left, right, leaf_bytes=500).collect()}


def test_a_longer_record_moves_the_others(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * 10, "s", "h") for i in range(50)]
    longer = [(i, u, h + "!" if i == 20 else h, s, x) for i, u, h, s, x in rows]
    left, right = (warc.read_records(spark, replica(spark, r)) for r in (rows, longer))
    # the number of digits in the content length stays, so that one byte is all that is added
    found = statuses(left, right)
    order = [r["record_id"] for r in left.orderBy("offset").collect()]
    at = order.index("20")
    assert found == {i: "same" if n < at else "changed" if n == at else "moved" for n, i in enumerate(order)}
    gone = statuses(left, right.filter("record_id != '30'"))
    assert gone["30"] == "missing" and sum(s == "missing" for s in gone.values()) == 1


def test_an_unreadable_header_meets_its_record_by_offset(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * 10, "s", "h") for i in range(30)]
    left = warc.read_records(spark, replica(spark, rows))
    body = b"".join(warc_bytes(i, u, h) for i, u, h, _, _ in rows).replace(b"Record-ID: <urn:page:7>", b"Record-XX: <urn:page:7>")
    right = spark.createDataFrame([(left.first()["segment"], *r) for r in warc.parse(body)], warc.RECORDS)
    assert {i: s for i, s in statuses(left, right).items() if s != "same"} == {"7": "changed"}


def test_broken_and_empty_replicas(spark):
    import gzip
    body = b"".join(warc_bytes(i, "u", str(i) * 3000) for i in range(100))
    stored = bytearray(gzip.compress(body))
    assert warc._inflated(bytes(stored)) == body and warc._inflated(body) == body
    stored[len(stored) // 2] ^= 0xFF
    kept = warc._inflated(bytes(stored))
    assert kept == body[: len(kept)] or len(kept) <= len(body)
    assert warc._inflated(bytes(stored[: len(stored) // 2])) == body[: len(warc._inflated(bytes(stored[: len(stored) // 2])))]
    empty = replica(spark, [])
    assert warc.read_records(spark, empty).collect() == []
    some = warc.read_records(spark, replica(spark, [(1, "u", "x", "s", "h")]))
    assert statuses(some, warc.read_records(spark, empty)) == {"1": "missing"}
    assert warc.audit(warc.read_records(spark, empty), warc.read_records(spark, empty)).collect() == []


def test_documents_helper(spark):
    assert documents(spark, ["a", None]).count() == 2
