"""License detection: ordered signature rules on the words of a text, gated by keywords, with suppression of contained finds.

A text is turned into its lower-case words, joined by single blanks. Each rule is a regular expression over that form with a
priority. From the expression follow sets of keywords, of each of which every match contains one; it is tried only if the text
has one of each set. Finds are taken by priority, then length; a find inside an interval that is
already taken is dropped, so "licensed under the MIT license" hides the bare name in it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from re import _constants, _parser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslattice.llm.common import id_and_text

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
# The base phrases and their labels.
BASE = [(b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved")]

# Label, name as it is written in words, SPDX identifier in words, words of its address.
NAMES = [
    ("mit", r"(?:mit|expat|x11)", r"mit", r"opensource org licenses mit"),
    ("mit-0", r"mit no attribution", r"mit 0", r"opensource org licenses mit 0"),
    ("isc", r"isc", r"isc", r"opensource org licenses isc"),
    ("0bsd", r"(?:zero clause bsd|0bsd|free public license 1 0 0)", r"0bsd", r"opensource org licenses 0bsd"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause", r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", r"bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("bsd", r"(?:berkeley software distribution|bsd style|bsd)", r"bsd", r"opensource org licenses bsd license"),
    ("apache-1.1", r"apache(?: software)?(?: license)? (?:version |v )?1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache-2.0", r"apache(?: software)?(?: license)? (?:version |v )?2(?: 0)?", r"apache 2 0", r"apache org licenses license 2 0"),
    ("gpl-1.0", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v)?1(?: 0)?", r"gpl 1 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v)?2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl) ?(?:version |v)?3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", r"gpl", r"gnu org (?:copyleft|licenses) gpl"),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public license|lgpl) ?(?:version |v)?2(?: 0)?", r"lgpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?2 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license|lgpl", r"lgpl", r"gnu org (?:copyleft|licenses) lesser"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl) ?(?:version |v)?3(?: 0)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    ("agpl", r"(?:gnu )?affero general public license|agpl", r"agpl", r"gnu org licenses agpl"),
    ("gfdl", r"(?:gnu )?free documentation license|gfdl", r"gfdl 1 [1-3](?: only| or later)?", r"gnu org licenses fdl"),
    ("mpl-1.1", r"(?:mozilla public license|mpl) ?(?:version |v)?1 [01]", r"mpl 1 [01]", r"mozilla org mpl mpl 1 1"),
    ("mpl-2.0", r"(?:mozilla public license|mpl) ?(?:version |v)?2(?: 0)?", r"mpl 2 0", r"mozilla org (?:en us )?mpl 2 0"),
    ("epl-1.0", r"(?:eclipse public license|epl) ?(?:version |v)?1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2.0", r"(?:eclipse public license|epl) ?(?:version |v)?2(?: 0)?", r"epl 2 0", r"eclipse org legal epl 2 0"),
    ("cddl-1.0", r"common development and distribution license(?: (?:version |v)?1 0)?|cddl(?: 1 0)?", r"cddl 1 0", r"opensource org licenses cddl"),
    ("cpl-1.0", r"common public license(?: (?:version |v)?1 0)?", r"cpl 1 0", r"opensource org licenses cpl"),
    ("eupl", r"european union public licen[cs]e|eupl", r"eupl 1 [0-2]", r"joinup ec europa eu .{0,40}eupl"),
    ("artistic-1.0", r"artistic license(?: 1 0)?", r"artistic 1 0", r"opensource org licenses artistic license 1"),
    ("artistic-2.0", r"artistic license (?:version )?2(?: 0)?", r"artistic 2 0", r"opensource org licenses artistic license 2"),
    ("boost-1.0", r"boost software license(?: (?:version )?1 0)?", r"bsl 1 0", r"boost org license 1 0"),
    ("zlib", r"zlib(?: libpng)?", r"zlib", r"opensource org licenses zlib"),
    ("unlicense", r"unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license", r"wtfpl", r"wtfpl net"),
    ("python-2.0", r"(?:python|psf)(?: software foundation)? license(?: (?:version )?2)?", r"(?:python|psf) 2 0", r"docs python org .{0,10}license"),
    ("ruby", r"ruby license", r"ruby", r"ruby lang org .{0,10}license"),
    ("php-3.01", r"php license(?: (?:version )?3 0?1?)?", r"php 3 01", r"php net license"),
    ("postgresql", r"postgresql license", r"postgresql", r"postgresql org about licence"),
    ("openssl", r"openssl license", r"openssl", r"openssl org source license"),
    ("ofl-1.1", r"sil open font license(?: (?:version )?1 1)?", r"ofl 1 1", r"scripts sil org ofl"),
    ("ms-pl", r"microsoft public license", r"ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", r"microsoft reciprocal license", r"ms rl", r"opensource org licenses ms rl"),
    ("ecl-2.0", r"educational community license(?: (?:version )?2 0)?", r"ecl 2 0", r"opensource org licenses ecl 2 0"),
    ("ncsa", r"university of illinois ncsa open source license|ncsa license", r"ncsa", r"opensource org licenses ncsa"),
    ("upl-1.0", r"universal permissive license", r"upl 1 0", r"oss oracle com licenses upl"),
    ("odbl-1.0", r"open (?:data commons open )?database license|odbl", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", r"open data commons attribution license|odc by", r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", r"public domain dedication and license|pddl", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("cc0-1.0", r"cc0(?: 1 0)?|creative commons zero", r"cc0 1 0", r"creativecommons org publicdomain zero"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: [1-4] [05])?", r"cc by [1-4] [05]", r"creativecommons org licenses by"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", r"cc by sa [1-4] [05]", r"creativecommons org licenses by sa"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv\w*)(?: [1-4] [05])?", r"cc by nd [1-4] [05]", r"creativecommons org licenses by nd"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", r"cc by nc [1-4] [05]", r"creativecommons org licenses by nc"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*)(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]", r"creativecommons org licenses by nc nd"),
    ("bsl-1.1", r"business source license(?: (?:version )?1 1)?", r"busl 1 1", r"mariadb com bsl11"),
    ("sspl-1.0", r"server side public license|sspl", r"sspl 1 0", r"mongodb com licensing server side public license"),
    ("elastic-2.0", r"elastic license (?:version )?2(?: 0)?", r"elastic 2 0", r"elastic co licensing elastic license"),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?", r"openrail", r"bigscience huggingface co .{0,20}rail"),
    ("llgpl", r"lisp lesser general public license|llgpl", r"llgpl", r"opensource franz com preamble"),
]
# Sentences of license texts and notices: label, expression, priority, confidence.
CLAUSES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 90, 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 90, 1.0),
    ("bsd-3-clause", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products", 90, 1.0),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 90, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 80, 0.9),
    ("apache-2.0", r"you may not use this file except in compliance with the license", 85, 0.9),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements", 85, 1.0),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license", 85, 1.0),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 86, 1.0),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", 86, 1.0),
    ("gpl-or-later", r"either version [123] of the license or (?:at your option )?any later version", 84, 0.8),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", 90, 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 90, 1.0),
    ("zlib", r"altered source versions must be plainly marked as such", 85, 0.9),
    ("boost-1.0", r"unless such copies or derivative works are solely in the form of machine executable object code", 90, 1.0),
    ("ofl-1.1", r"the font software may be modified altered or added to", 85, 0.9),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 70, 0.8),
    ("public-domain", r"public domain", 20, 0.4),
    ("reserved", r"all rights reserved", 60, 0.9),
    ("reserved", r"copyright (?:c )?(?:[0-9]{4} )+.{0,60}? all rights reserved", 65, 1.0),
    ("reserved", r"alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", 60, 0.9),
    ("copyright", r"copyright (?:c )?[0-9]{4}(?: [0-9]{4})*", 30, 0.5),
    ("no-commercial", r"(?:not|no) (?:for |be used for )?commercial (?:use|purposes)", 50, 0.7),
    ("no-redistribution", r"(?:may not|must not|shall not) be (?:copied |reproduced )?(?:or )?redistributed", 50, 0.7),
    ("proprietary", r"proprietary and confidential|confidential and proprietary", 60, 0.9),
    ("proprietary", r"without (?:the )?(?:prior |express )*written permission (?:of|from)", 40, 0.6),
    ("unnamed", r"(?:licensed|released|distributed|available) under (?:the |a |an )?(?:terms of )?(?:\w+ ){0,4}?licen[cs]e", 10, 0.4),
]
_LICENSE = r"(?: public)?(?: licen[cs]e)?"
# How a name is used: expression around the name, priority, confidence. More words around it mean a stronger statement.
FRAMES = [
    (r"(?:licen[cs]ed|released|distributed|published|available|provided|covered) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{})" + _LICENSE, 75, 1.0),
    (r"(?:under|see|subject to|accept) (?:the )?(?:terms of (?:the )?)?(?:{}) licen[cs]e", 65, 0.9),
    (r"(?:{}) licen[cs]e", 45, 0.8),
]
BARE = {"gpl", "lgpl", "agpl", "gfdl", "cc0-1.0", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "wtfpl",
        "apache-2.0", "gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0"}


class Rule(NamedTuple):
    label: str
    keywords: tuple[frozenset[bytes], ...]
    pattern: re.Pattern
    priority: int
    confidence: float


def _strings(items, most: int = 16) -> tuple[set[str] | None, list[set[str]]]:
    """All strings that a parsed expression matches, if at most `most`; sets of strings of each of which every match contains one."""
    run, whole, sets = {""}, True, []
    for op, value in items:
        own, inner = None, []
        if op is _constants.LITERAL:
            own = {chr(value)}
        elif op is _constants.IN and all(o is _constants.LITERAL for o, _ in value):
            own = {chr(v) for _, v in value}
        elif op is _constants.SUBPATTERN:
            own, inner = _strings(value[3], most)
        elif op is _constants.BRANCH:
            parts = [_strings(p, most) for p in value[1]]
            if all(own for own, _ in parts):
                own = set().union(*(own for own, _ in parts))
            else:
                each = [([own] if own else []) + inner for own, inner in parts]
                inner = [set().union(*(max(e, key=lambda c: min(map(len, c))) for e in each))] if all(each) else []
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0]:
            inner = _strings(value[2], most)[1]
        if own and len(run) * len(own) <= most:
            run = {a + b for a in run for b in own}
            continue
        sets += [run, *inner]
        run, whole = own or {""}, False
    return (run if whole else None), [c for c in [*sets, run] if min(map(len, c)) > 1]


def _whole_word(keyword: bytes) -> bytes | None:
    """The longest word that stands between blanks in the keyword, and so in every text that has it."""
    return max(keyword.split(b" ")[1:-1], key=len, default=None)


def keywords(pattern: str) -> tuple[frozenset[bytes], ...]:
    """Sets of keywords, those with whole words and the longest first; a text without one of each has no match of the pattern between blanks."""
    _, sets = _strings(_parser.parse(f" (?:{pattern}) "))
    return tuple(sorted({frozenset(k.encode() for k in c) for c in sets},
                        key=lambda c: (any(_whole_word(k) is None for k in c), -min(map(len, c)), sorted(c))))


def _rule(label: str, pattern: str, priority: int, confidence: float) -> Rule:
    # A find stands between blanks; the first one is looked at only, so that finds may share a blank.
    return Rule(label, keywords(pattern), re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )"), priority, confidence)


def signatures() -> list[Rule]:
    """All rules, the strongest first."""
    rules = [_rule(*c) for c in CLAUSES]
    for label, name, identifier, address in NAMES:
        rules += [_rule(label, frame.format(name), priority, confidence) for frame, priority, confidence in FRAMES]
        rules.append(_rule(label, rf"spdx license identifier (?:{identifier})", 95, 1.0))
        rules.append(_rule(label, rf"(?:www )?{address}(?: [1-4] [05])?", 55, 0.9))
        if label in BARE:
            rules.append(_rule(label, rf"(?:{name})", 35, 0.7))
    return sorted(rules, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


RULES = signatures()
# Rules by their first set of keywords, so that a set is looked up once for all of them.
_GROUPS: dict[frozenset[bytes], list[int]] = {}
for _i, _r in enumerate(RULES):
    _GROUPS.setdefault(_r.keywords[0], []).append(_i)
_CHOICES = {c: [(k, _whole_word(k)) for k in sorted(c)] for r in RULES for c in r.keywords}


class Find(NamedTuple):
    label: str
    start: int
    end: int
    confidence: float


def normalised(text: str | None) -> bytes:
    """Words with A-Z in lower case, a blank before, between and behind them."""
    raw = text.encode("utf-8", "replace").lower() if isinstance(text, str) else b""
    return b" " + b"".join(w + b" " for w in _WORDS.findall(raw))


def open_rules(words: bytes) -> list[Rule]:
    """The rules whose keywords the text has."""
    seen = set(words.split(b" "))
    known: dict[frozenset[bytes], bool] = {}

    def has(choice: frozenset[bytes]) -> bool:
        if (at := known.get(choice)) is None:
            at = known[choice] = any((word is None or word in seen) and k in words for k, word in _CHOICES[choice])
        return at

    return [RULES[i] for i in sorted(i for first, group in _GROUPS.items() if has(first) for i in group if all(map(has, RULES[i].keywords)))]


class _Cover:
    """Intervals of which none contains another: starts and ends both rise."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """False if an interval contains this one; otherwise it is added, and those that it contains go."""
        at = bisect_right(self.starts, start)
        if at and self.ends[at - 1] >= end:
            return False
        first = bisect_left(self.starts, start)
        last = max(first, bisect_right(self.ends, end))
        self.starts[first:last], self.ends[first:last] = [start], [end]
        return True


def detect(words: bytes) -> list[Find]:
    """Finds that no stronger find contains, by place. Offsets are bytes of the normalised text."""
    found = [(-r.priority, m.start() - m.end(), m.start(), m.end(), r) for r in open_rules(words) for m in r.pattern.finditer(words)]
    cover = _Cover()
    kept = [Find(rule.label, start, end, rule.confidence) for _, _, start, end, rule in sorted(found, key=lambda f: f[:4]) if cover.add(start, end)]
    return sorted(kept, key=lambda f: (f.start, f.end, f.label))


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place of a base phrase."""
    at = []
    for phrase, label in BASE:
        position = words.find(b" " + phrase + b" ")
        while position >= 0:
            at.append((position, label))
            position = words.find(b" " + phrase + b" ", position + 1)
    out, before, index = [], 0, 0
    for position, label in sorted(at):
        index += words.count(b" ", before, position)
        before = position
        out.append((index, label))
    return out


def describe(text: str | None) -> tuple:
    words = normalised(text)
    places = base_places(words)
    finds = detect(words)
    base = sorted({label for _, label in places})
    miss = 1.0
    for confidence in {f.label: f.confidence for f in sorted(finds, key=lambda f: f.confidence)}.values():
        miss *= 1 - confidence
    return (words.count(b" ") - 1, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base),
            ",".join(sorted({*base, *(f.label for f in finds)})), 1.0 if places else 1 - miss, len(finds))


SCAN = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_finds long")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of SCAN, one row per row of docs.

    Null texts count as empty: no words, no places, empty labels, score 0. Repeated rows and null ids are scanned row by row;
    an empty table gives no rows; other columns are ignored.
    """
    names = [c.split()[0] for c in SCAN.split(", ")]

    @F.pandas_udf(SCAN)
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([describe(t) for t in texts], columns=names)
        return out.assign(first_word=out["first_word"].astype("Int64"), last_word=out["last_word"].astype("Int64"))

    return id_and_text(docs).select("doc_id", scan("text").alias("_s")).select("doc_id", "_s.*")
