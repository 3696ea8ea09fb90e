import random
import re
import time

import pytest

from turnstone.llm import licenses
from turnstone.llm.queries import op4_license_scan

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    """The base columns, by looking at every word."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_license_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in rows)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache,apache-2.0"),
        ("Released under the GNU General Public License v3", "gpl,gpl-3.0"),
        ("the GNU Lesser General Public License version 2.1 applies", "gpl,lgpl-2.1"),
        ("see https://creativecommons.org/licenses/by-sa/4.0/ for terms", "cc-by-sa-4.0"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd-2-clause"),
        ("mitlicense and apachelicense are no words of ours", ""),
        ("MIT\nLicense", "mit"),
    ],
)
def test_signatures(text, labels):
    assert licenses.describe(text.encode())[5] == labels


def test_contained_detections_are_suppressed():
    assert len(licenses.rules()) > 200
    found = licenses.detect(b"licensed under the apache license version 2 0")
    kept = licenses.resolve(found)
    assert len(found) > len(kept) == 1
    for a, b, _ in found:
        assert any(x <= a and b <= y for x, y, _ in kept)
    # Every rule's matches hold one of its keywords, or the gate would lose them.
    for rule in licenses.rules():
        for text in ("apache license 2 0", "gnu general public license version 3", "cc by sa 4 0", "gplv2", "lgplv3", "boost software license 1 0", "open database license", "wtfpl", "cc0 1 0 universal"):
            if rule.pattern.search(text):
                assert any(word in text for word in rule.keywords)


def test_odd_rows(spark, docs, no_docs):
    out = licenses.scan(docs.withColumnRenamed("size", "labels"))
    assert out.count() == docs.count()
    for r in out.where("doc_id in (2, 3, 4)").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (0, 0, None, None, "", "", 0.0)
    assert out.where("doc_id = 6").first().n_words == 9002
    assert licenses.scan(no_docs).count() == 0


def test_suppression_against_all_pairs():
    rng = random.Random(4)
    for _ in range(200):
        found = [(a, a + rng.randrange(1, 9), rng.randrange(len(licenses.rules()))) for a in (rng.randrange(30) for _ in range(40))]
        kept = []
        for one in sorted(found, key=lambda d: (-licenses.rules()[d[2]].priority, d[0] - d[1], d)):
            if not any(a <= one[0] and one[1] <= b for a, b, _ in kept):
                kept.append(one)
        assert licenses.resolve(found) == kept


def test_a_long_bundle_of_licenses_takes_seconds():
    text = ("Licensed under the MIT License or the Apache License, Version 2.0; GNU General Public License v3 too.\n" * 100_000).encode()
    began = time.time()
    out = licenses.describe(text)
    assert out[1] == 300_000 and out[5] == "apache,apache-2.0,gpl,gpl-3.0,mit" and time.time() - began < 60
