import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.llm import spelling
from turnstone.llm.queries import op12_spelling_variants

from .conftest import SF


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def count(docs, shortest=5, least=3, drop_every=97) -> dict[str, int]:
    n: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % drop_every == 0 else run] += 1
    return {word: k for word, k in n.items() if len(word) >= shortest and k >= least}


def brute_force(n: dict[str, int], ratio=2) -> list[tuple]:
    forms, rows = {}, []
    for word in n:
        others = [other for other in n if near(word, other)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        forms[word] = (best if best is not None and n[best] >= ratio * n[word] else None, len(others))
    for word, (form, others) in forms.items():
        root = word
        while forms[root][0] is not None:
            root = forms[root][0]
        rows.append((word, form, root, n[word], others, n[form] if form is not None else None))
    return sorted(rows, key=str)


def got(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = op12_spelling_variants(spark, SF)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(out) == brute_force(count(docs))


@pytest.mark.parametrize("shard_rows", [1, 3, 40, 2000])
def test_shards_lose_no_pair(spark, shard_rows):
    letters = "abé"
    words = sorted({f"{letters[i % 3]}{letters[i // 3 % 3]}{letters[i // 9 % 3]}aa{letters[i // 27 % 3]}b{letters[i // 81 % 3] * (i % 4)}" for i in range(300)})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    found = [tuple(r) for r in spelling.near_words(frame, shard_rows).select("word", "other").collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if near(a, b))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=4, max_size=5), max_size=25), st.integers(0, 4), st.integers(0, 4))
def test_a_shard_finds_all_its_pairs(words, before, after):
    if before + after > 4:
        return
    for key in {(w[:before], w[len(w) - after :]) for w in words}:
        own = [w for w in words if (w[:before], w[len(w) - after :]) == key]
        found = [(a, b) for a, _, b, _ in spelling._near_pairs([(w, 1) for w in own], 5, before, after)]
        place = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        expected = {frozenset((a, b)) for a in own for b in own if near(a, b) and 5 in (len(a), len(b)) and before <= place(a, b) < 5 - after}
        assert {frozenset(p) for p in found} == expected and len(found) == len(expected)


def test_chains_of_forms(spark):
    text = " ".join(["abcdef"] * 64 + ["abcdeg"] * 32 + ["abcdhg"] * 16 + ["abchhg"] * 8 + ["abhhhg"] * 4 + ["other", "others", "another"] * 3)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = {r.word: r for r in spelling.variants(frame, drop_every=1 << 33).collect()}
    assert rows["abhhhg"].form == "abchhg" and rows["abhhhg"].root == rows["abcdeg"].root == "abcdef" and rows["abcdef"].form is None
    assert rows["other"].form is None and rows["other"].n_near == 1 and rows["another"].root == "another"


def test_ties_go_to_the_smallest_word(spark):
    text = " ".join(["grüße"] * 3 + ["grübe", "grÿße", "gräße"] * 6)
    rows = got(spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), drop_every=1 << 33))
    assert rows == brute_force(count([(1, text)], drop_every=1 << 33)) and {r[0]: r[1] for r in rows}["grüße"] == "gräße"


def test_odd_rows(spark, docs, no_docs):
    rows = [(None, "Öffnen öffnen ÖFFNEN öffne ×÷×÷× ×÷×÷ "), (9, "straße,straße;straßen'strassenŠkodaskodaāabcde " * 4), (9, "straße,straße;straßen'strassenŠkodaskodaāabcde " * 4)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    clashing = more.withColumns({name: F.lit("x") for name in ("word", "n", "form", "root", "length", "key", "before", "after", "n_near")})
    for drop_every in (1, 2, 97):
        assert got(spelling.variants(clashing, drop_every=drop_every)) == brute_force(count([tuple(r) for r in more.collect()], drop_every=drop_every))
    assert spelling.variants(no_docs).count() == 0 and spelling.variants(docs.where("doc_id in (2, 3, 4)")).count() == 0


def test_long_texts(spark):
    rows = [(1, "letters lettres lettets " * 400_000), (2, "x" * 3_000_000)]  # 9.6 MB, and one endless word
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    n = spelling.count_words(frame, least=1)
    assert {r.word[:9]: r.n for r in n.collect()} == {w[:9]: k for w, k in count(rows, least=1).items()}
