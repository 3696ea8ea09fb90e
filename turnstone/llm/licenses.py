"""License scan: ordered signature rules over normalised words.

A text is lower-cased (A-Z only) and cut into words; signatures are regexes over the words joined by one blank and match
whole words. A rule runs only on texts that hold its keyword. Detections are resolved in order of priority, then length,
then place, then rule: one whose words all lie inside those of a kept detection is suppressed. Base phrases are found
by themselves and are never suppressed.

Null text is empty text, with no words and no labels. Repeated rows stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import map_batches, slices, to_batch, utf8

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_VERSION = r"(?:v|version |ver )?"
#: label, spdx words, names, places on the web (all as normalised words), keywords of which every name holds one.
FAMILIES = [
    ("mit", "mit", "mit(?: expat)? licen[cs]e|expat licen[cs]e|mit x11 licen[cs]e", "opensource org licenses? mit", "mit licen,mit expat,expat licen,mit x11"),
    ("mit-0", "mit 0", "mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e", "opensource org licenses? mit 0", "mit no attribution,mit 0"),
    ("x11", "x11", "x11 licen[cs]e|x consortium licen[cs]e", "www xfree86 org", "x11 licen,x consortium"),
    ("apache-2.0", "apache 2 0", f"apache(?: software)? licen[cs]e {_VERSION}2(?: 0)?|asl 2 0|apache 2(?: 0)? licen[cs]e", "apache org licenses license 2 0", "apache licen,apache software licen,asl 2,apache 2"),
    ("apache-1.1", "apache 1 1", f"apache(?: software)? licen[cs]e {_VERSION}1 1", "apache org licenses license 1 1", "apache licen,apache software licen"),
    ("apache-1.0", "apache 1 0", f"apache(?: software)? licen[cs]e {_VERSION}1 0", "apache org licenses license 1 0", "apache licen,apache software licen"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", f"(?:gnu )?(?:general public licen[cs]e|gpl) {_VERSION}1(?: 0)?", "gnu org licenses (?:old licenses )?gpl 1 0", "general public licen,gpl"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", f"(?:gnu )?(?:general public licen[cs]e|gpl) {_VERSION}2(?: 0)?|gplv2", "gnu org licenses (?:old licenses )?gpl 2 0", "general public licen,gpl"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", f"(?:gnu )?(?:general public licen[cs]e|gpl) {_VERSION}3(?: 0)?|gplv3", "gnu org licenses gpl 3 0", "general public licen,gpl"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", f"(?:gnu )?(?:library general public licen[cs]e|lgpl) {_VERSION}2(?: 0)?", "gnu org licenses (?:old licenses )?lgpl 2 0", "library general public,lgpl"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", f"(?:gnu )?(?:lesser general public licen[cs]e|lgpl) {_VERSION}2 1|lgplv2 1", "gnu org licenses (?:old licenses )?lgpl 2 1", "lesser general public,lgpl"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", f"(?:gnu )?(?:lesser general public licen[cs]e|lgpl) {_VERSION}3(?: 0)?|lgplv3", "gnu org licenses lgpl 3 0", "lesser general public,lgpl"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", f"(?:gnu )?(?:affero general public licen[cs]e|agpl) {_VERSION}3(?: 0)?|agplv3", "gnu org licenses agpl 3 0", "affero general public,agpl"),
    ("agpl-1.0", "agpl 1 0", f"affero general public licen[cs]e {_VERSION}1(?: 0)?", "affero org oagpl", "affero general public"),
    ("bsd-0-clause", "0bsd", "(?:zero|0) clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?", "opensource org licenses? 0bsd", "clause bsd,bsd zero clause"),
    ("bsd-2-clause", "bsd 2 clause", "(?:2|two) clause bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", "opensource org licenses? bsd 2 clause", "clause bsd,bsd 2 clause,bsd two clause,simplified bsd,freebsd licen"),
    ("bsd-3-clause", "bsd 3 clause", "(?:3|three) clause bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", "opensource org licenses? bsd 3 clause", "clause bsd,bsd 3 clause,bsd three clause,new bsd,modified bsd,revised bsd"),
    ("bsd-4-clause", "bsd 4 clause", "(?:4|four) clause bsd(?: licen[cs]e)?|original bsd licen[cs]e", "www freebsd org copyright license", "clause bsd,bsd 4 clause,bsd four clause,original bsd"),
    ("mpl-1.0", "mpl 1 0", f"mozilla public licen[cs]e {_VERSION}1 0|mpl {_VERSION}1 0", "mozilla org mpl 1 0", "mozilla public,mpl"),
    ("mpl-1.1", "mpl 1 1", f"mozilla public licen[cs]e {_VERSION}1 1|mpl {_VERSION}1 1", "mozilla org mpl 1 1", "mozilla public,mpl"),
    ("mpl-2.0", "mpl 2 0", f"mozilla public licen[cs]e {_VERSION}2(?: 0)?|mpl {_VERSION}2 0", "mozilla org mpl 2 0", "mozilla public,mpl"),
    ("epl-1.0", "epl 1 0", f"eclipse public licen[cs]e {_VERSION}1(?: 0)?", "eclipse org legal epl v10", "eclipse public"),
    ("epl-2.0", "epl 2 0", f"eclipse public licen[cs]e {_VERSION}2(?: 0)?", "eclipse org legal epl (?:v20|2 0)", "eclipse public"),
    ("cddl-1.0", "cddl 1 0", f"common development and distribution licen[cs]e(?: {_VERSION}1 0)?|cddl {_VERSION}1 0", "opensource org licenses? cddl 1 0", "common development and distribution,cddl"),
    ("cpl-1.0", "cpl 1 0", f"common public licen[cs]e(?: {_VERSION}1 0)?", "ibm com developerworks library os cpl", "common public licen"),
    ("isc", "isc", "isc licen[cs]e|internet systems consortium licen[cs]e", "opensource org licenses? isc", "isc licen,internet systems consortium"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib net zlib license", "zlib"),
    ("bsl-1.0", "bsl 1 0", f"boost software licen[cs]e(?: {_VERSION}1 0)?", "boost org license 1 0", "boost software"),
    ("unlicense", "unlicense", "the unlicense|unlicense licen[cs]e", "unlicense org", "unlicense"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public licen[cs]e|wtfpl", "wtfpl net", "do what the fuck,wtfpl"),
    ("artistic-1.0", "artistic 1 0", f"artistic licen[cs]e {_VERSION}1(?: 0)?", "perlfoundation org artistic license 1 0", "artistic licen"),
    ("artistic-2.0", "artistic 2 0", f"artistic licen[cs]e {_VERSION}2(?: 0)?", "perlfoundation org artistic license 2 0", "artistic licen"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql org about licence", "postgresql licen"),
    ("python-2.0", "python 2 0", "python software foundation licen[cs]e|psf licen[cs]e", "python org psf license", "python software foundation,psf licen"),
    ("php-3.01", "php 3 01", f"php licen[cs]e(?: {_VERSION}3 01)?", "php net license 3 01", "php licen"),
    ("ruby", "ruby", "ruby licen[cs]e", "ruby lang org en about license", "ruby licen"),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl org source license", "openssl licen"),
    ("ms-pl", "ms pl", "microsoft public licen[cs]e", "opensource org licenses? ms pl", "microsoft public"),
    ("ms-rl", "ms rl", "microsoft reciprocal licen[cs]e", "opensource org licenses? ms rl", "microsoft reciprocal"),
    ("eupl-1.1", "eupl 1 1", f"european union public licen[cs]e {_VERSION}1 1|eupl {_VERSION}1 1", "joinup ec europa eu software page eupl", "european union public,eupl"),
    ("eupl-1.2", "eupl 1 2", f"european union public licen[cs]e {_VERSION}1 2|eupl {_VERSION}1 2", "eupl eu 1 2", "european union public,eupl"),
    ("ofl-1.1", "ofl 1 1", f"sil open font licen[cs]e(?: {_VERSION}1 1)?", "scripts sil org ofl", "sil open font"),
    ("odbl-1.0", "odbl 1 0", f"open database licen[cs]e(?: {_VERSION}1 0)?|odbl", "opendatacommons org licenses odbl", "open database licen,odbl"),
    ("pddl-1.0", "pddl 1 0", "public domain dedication and licen[cs]e|pddl", "opendatacommons org licenses pddl", "public domain dedication,pddl"),
    ("odc-by-1.0", "odc by 1 0", "open data commons attribution licen[cs]e|odc by", "opendatacommons org licenses by", "open data commons,odc by"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", f"(?:gnu )?free documentation licen[cs]e(?: {_VERSION}1 3)?", "gnu org licenses fdl", "free documentation licen"),
    ("elastic-2.0", "elastic 2 0", f"elastic licen[cs]e(?: {_VERSION}2 0)?", "elastic co licensing elastic license", "elastic licen"),
    ("sspl-1.0", "sspl 1 0", "server side public licen[cs]e|sspl", "mongodb com licensing server side public license", "server side public,sspl"),
    ("busl-1.1", "busl 1 1", f"business source licen[cs]e(?: {_VERSION}1 1)?", "mariadb com bsl11", "business source licen"),
    ("cc0-1.0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?|creative commons zero", "creativecommons org publicdomain zero 1 0", "cc0,creative commons zero"),
    ("public-domain", "licenseref public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "creativecommons org publicdomain mark 1 0", "the public domain"),
    ("all-rights-reserved", "licenseref proprietary", "all rights reserved|proprietary and confidential|no part of this (?:work|publication|document) may be reproduced", "licenseref proprietary notice", "all rights reserved,proprietary and confidential,may be reproduced"),
]
#: The Creative Commons licenses: every mix of terms, in every version, as words and as long names.
CC_TERMS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Passages of license texts themselves.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "this permission notice"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote", "neither the name of"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "all advertising materials"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of", "this program is free software"),
    ("gpl", "you should have received a copy of the gnu general public license along with", "you should have received a copy"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with", "you should have received a copy"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with", "you should have received a copy"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "this software is provided as is"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "permission is hereby granted free of charge"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("wtfpl", "you just do what the fuck you want to", "you just do what"),
    ("cc0-1.0", "to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", "to the extent possible under law"),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "this font software"),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission is granted to copy"),
    ("all-rights-reserved", "unauthorized (?:copying|use|reproduction) of this (?:file|work|document) .{0,60}?is strictly prohibited", "strictly prohibited"),
]
#: Weaker signs without a version or a family.
LOOSE = [
    ("gpl", "(?:gnu )?general public licen[cs]e|gnu gpl", "general public licen,gnu gpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl", "lesser general public,library general public,gnu lgpl"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e|gnu agpl", "affero general public,gnu agpl"),
    ("apache", "apache(?: software)? licen[cs]e", "apache licen,apache software licen"),
    ("bsd", "bsd licen[cs]e|bsd style licen[cs]e", "bsd licen,bsd style licen"),
    ("mpl", "mozilla public licen[cs]e", "mozilla public"),
    ("epl", "eclipse public licen[cs]e", "eclipse public"),
    ("cc", "creative commons(?: licen[cs]e)?", "creative commons"),
    ("copyleft", "copyleft", "copyleft"),
    ("open-source", "open source licen[cs]e", "open source licen"),
    ("spdx", "spdx licen[cs]e identifier", "spdx licen"),
]
GRANT = "(?:is |are |been |was )?(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered)(?: to you)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?(?: gnu)? "


@dataclass(frozen=True)
class Rule:
    """A signature: label, regex over whole words, priority, and keywords of which every match holds one."""

    label: str
    pattern: re.Pattern
    priority: int
    keywords: tuple[str, ...]


def _rule(label: str, body: str, priority: int, keywords: str) -> Rule:
    return Rule(label, re.compile(f"(?:^|(?<= ))(?:{body})(?= |$)"), priority, tuple(keywords.split(",")))


def _site(web: str) -> str:
    """The words of a web place before its first varying part, which every match holds."""
    return re.split(r" ?\w*[(?]", web)[0]


@cache
def rules() -> tuple[Rule, ...]:
    """All signatures in order; a few hundred."""
    found = []
    for label, spdx, names, web, keywords in FAMILIES:
        found += [_rule(label, f"spdx licen[cs]e identifier (?:{spdx})", 100, "spdx licen"), _rule(label, web, 90, _site(web))]
        found += [_rule(label, f"{GRANT}(?:{names})", 80, keywords), _rule(label, names, 60, keywords)]
    for terms, words in CC_TERMS.items():
        for version in CC_VERSIONS:
            label = f"cc-{terms}-{version.replace(' ', '.')}".replace(" ", "-")
            short = f"cc {terms} (?:licen[cs]e )?{version}"
            long = f"creative commons {words}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)? {version}"
            found += [_rule(label, f"spdx licen[cs]e identifier cc {terms} {version}", 100, "spdx licen"), _rule(label, f"creativecommons org licenses {terms} {version}", 90, "creativecommons org")]
            for body, keywords in ((short, f"cc {terms}"), (long, "creative commons attribution")):
                found += [_rule(label, f"{GRANT}(?:an? )?{body}", 80, keywords), _rule(label, body, 60, keywords)]
    found += [_rule(label, body, 70, keywords) for label, body, keywords in PASSAGES]
    found += [_rule(label, f"{GRANT}(?:{body})", 50, keywords) for label, body, keywords in LOOSE]
    found += [_rule(label, body, 40, keywords) for label, body, keywords in LOOSE]
    return tuple(found)


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: bytes) -> list[bytes]:
    """Words of digits, letters and bytes beyond ASCII, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


@cache
def _gate() -> dict[bytes, tuple[int, ...]]:
    """The rules of each keyword."""
    by_word: dict[bytes, tuple[int, ...]] = {}
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            by_word[word.encode()] = (*by_word.get(word.encode(), ()), i)
    return by_word


def detect(joined: bytes) -> list[tuple[int, int, int]]:
    """All detections, before suppression: first word, word after the last, rule."""
    numbers = sorted({i for word, at in _gate().items() if word in joined for i in at})
    if not numbers:
        return []
    text = joined.decode("utf-8", "replace")
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    found = [(match.start(), match[0].count(" ") + 1, i) for i in numbers for match in rules()[i].pattern.finditer(text)]
    first = np.searchsorted(blanks, [at for at, _, _ in found]).tolist()
    return [(at, at + n, i) for at, (_, n, i) in zip(first, found, strict=True)]


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those that no kept detection contains, best first.

    A detection is contained where the greatest end of the kept ones that start no later reaches its own; a tree of
    greatest ends by place of start tells that in a few steps.
    """
    starts = {start: i + 1 for i, start in enumerate(sorted({one[0] for one in found}))}
    furthest = [0] * (len(starts) + 1)
    kept: list[tuple[int, int, int]] = []
    for one in sorted(found, key=lambda d: (-rules()[d[2]].priority, d[0] - d[1], d)):
        at, end = starts[one[0]], 0
        while at:
            end, at = max(end, furthest[at]), at & (at - 1)
        if end < one[1]:
            kept.append(one)
            at = starts[one[0]]
            while at < len(furthest):
                furthest[at], at = max(furthest[at], one[1]), at + (at & -at)
    return kept


def base_places(padded: bytes) -> tuple[list[int], set[str]]:
    """First words of all base phrases, and their labels, in words joined by blanks, with a blank at each end."""
    at, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        body = b" " + phrase.encode() + b" "
        place = padded.find(body)
        while place >= 0:
            at.append(place)
            labels.add(label)
            place = padded.find(body, place + 1)
    return (np.searchsorted(np.flatnonzero(np.frombuffer(padded, np.uint8) == 32), at).tolist() if at else []), labels


def describe(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of one text."""
    words = normalised(text)
    joined = b" ".join(words)
    places, base = base_places(b" " + joined + b" ")
    kept = resolve(detect(joined))
    labels = base | {rules()[i].label for _, _, i in kept}
    score = max([rules()[i].priority / 100 for _, _, i in kept] + [0.5 * bool(base)])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, len(kept)


_OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "n_detections": pa.int64()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows = [describe(text) for text in utf8(batch.column(1))]
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        yield to_batch({"doc_id": batch.column(0)} | {name: list(column) for name, column in zip(list(_OUT)[1:], columns, strict=True)}, _OUT)


def scan(docs: DataFrame) -> DataFrame:
    """License phrases and signatures of docs (doc_id, text): a row for each row."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, schema)
