"""The evidence gate rule by rule, sequential application, and candidates."""

import pytest
from pyspark.sql import functions as F

from turnstone.operators import evidence

ENTRIES = [
    ("cents a share", None, None, ["sense to share"], "amount", ["dividend"]),
    ("Acme Corp", ["Acme"], None, ["ack me corp"], "company_name", ["results", "guidance"]),
    ("EBITDA", ["ebit da"], None, ["e bit da"], "finance", None),
    ("Item", None, None, ["it"], "product_name", None),
]
TEXT = "The dividend is 12 sense to share and ack me corp results show e bit da and ebit da, it grows 5 cents a share"
CASES = [  # source, replacement, canonical, decision and reason in v2, in v3
    ("", "x", "EBITDA", "reject incomplete", "reject incomplete"), ("nowhere", "EBITDA", "EBITDA", "reject source_not_in_text", "reject source_not_in_text"), ("e bit da", "X", "unknown", "reject unknown_term", "reject unknown_term"),
    ("The", "the", "EBITDA", "no_op no_change", "no_op no_change"), ("5 cents a share", "5 cents per share", "cents a share", "no_op amount_is_right", "no_op amount_is_right"), ("ebit da", "EBITDA", "EBITDA", "no_op accepted_form", "no_op accepted_form"),
    ("show", "EBITDA", "EBITDA", "accept accepted", "needs_review no_error_form"), ("it", "Item", "Item", "reject common_word", "reject common_word"), ("e bit da", "profit", "EBITDA", "reject term_not_named", "reject term_not_named"),
    ("12 sense to share", "13 cents a share", "cents a share", "reject other_numbers", "reject other_numbers"), ("12 sense to share", "12 cents a share", "cents a share", "accept accepted", "accept accepted"),
    ("sense to share", "cents a share", "cents a share", "reject no_number", "reject no_number"), ("e bit da", "EBITDA margin", "EBITDA", "reject unsupported_tokens", "reject unsupported_tokens"),
    ("ack me corp", "Acme Corp", "Acme Corp", "accept accepted", "accept accepted"), ("e bit da", "EBITDA", "EBITDA", "accept accepted", "accept accepted"),
]


@pytest.fixture
def glossary(spark):
    return spark.createDataFrame(ENTRIES, evidence.GLOSSARY)


@pytest.mark.parametrize("version", ["v2", "v3"])
def test_rules_one_by_one(spark, glossary, version):
    rows = [(i, 0, *case[:3]) for i, case in enumerate(CASES)]
    proposals = spark.createDataFrame(rows, "id int, place int, source string, replacement string, canonical string")
    texts = spark.createDataFrame([(i, TEXT) for i, _ in enumerate(CASES)], "id int, text string")
    got = {r.id: f"{r.records[0].decision} {r.records[0].reason}" for r in evidence.apply_corrections(texts, proposals, glossary, version).collect()}
    assert [got[i] for i in range(len(CASES))] == [case[3 if version == "v2" else 4] for case in CASES]


def test_names_need_their_context(spark, glossary):
    texts = spark.createDataFrame([(1, "ack me corp said so")], "id int, text string")
    proposals = spark.createDataFrame([(1, 0, "ack me corp", "Acme Corp", "Acme Corp")], "id int, place int, source string, replacement string, canonical string")
    assert evidence.apply_corrections(texts, proposals, glossary).first().records[0].reason == "name_without_context"


def test_later_proposals_see_earlier_edits(spark, glossary):
    rows = [(1, 0, "e bit da", "EBITDA", "EBITDA"), (1, 1, "E bit da", "EBITDA", "EBITDA"), (1, 2, "e bit da", "EBITDA", "EBITDA"), (1, 3, "e bit da", "EBITDA", "EBITDA")]
    proposals = spark.createDataFrame(rows, "id int, place int, source string, replacement string, canonical string")
    texts = spark.createDataFrame([(1, "e bit da, E BIT DA $"), (2, "untouched")], "id int, text string")
    out = {r.id: r for r in evidence.apply_corrections(texts, proposals, glossary).collect()}
    assert out[1].corrected == "EBITDA, EBITDA $" and out[2].corrected == "untouched" and out[2].records == []
    assert [(r.place, r.decision) for r in out[1].records] == [(0, "accept"), (2, "reject")]


def test_candidates(spark, glossary):
    texts = spark.createDataFrame([(1, TEXT), (2, "12 sense to share"), (3, "Acme and ebit da")], "id int, text string")
    got = {(r.id, r.source, r.replacement) for r in evidence.candidates(texts, glossary).collect()}
    assert got == {(1, "12 sense to share", "12 cents a share"), (2, "12 sense to share", "12 cents a share"), (1, "ack me corp", "Acme Corp"), (1, "e bit da", "EBITDA"), (1, "it", "Item")}
    assert evidence.candidates(texts, glossary.where(F.lit(False))).count() == 0
