"""Replies as a table: untrusted texts, gates, and scores before and after."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import evidence, replies

ENTRIES = [("cents a share", ["cents per share"], None, ["sense to share", "seems to share"], "finance_unit", ["dividend"], 1), ("Aspen", ["Aspen's"], None, ["aspirin"], "company_name", ["results", "welcome"], 2), ("EBITDA", None, ["e b i t d a"], ["e bit da"], "finance", None, 3)]
WRONG, RIGHT = "A reinstatement of our dividend at 262 seems to share.", "A reinstatement of our dividend at 262 cents a share."
GOOD = {"source_text": "262 seems to share", "replacement_text": "262 cents a share", "canonical_term": "cents a share", "reason": "keeps the number"}


@pytest.fixture
def glossary(spark):
    return spark.createDataFrame(ENTRIES, evidence.GLOSSARY + ", entry_place int")


def said(spark, *texts):
    return spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "id int, reply string")


def test_untrusted_replies(spark):
    odd = [
        {"corrections": [GOOD], "needs_review": []}, "```json\n" + json.dumps({"corrections": [GOOD]}) + "\n```", "Sure! " + json.dumps({"corrections": [GOOD]}) + " Hope it helps.", "no object", '{"corrections": [', "}{", None,
        {"corrections": [5, None, {"source_text": 7}, [GOOD]], "needs_review": ["x", {"source_text": "s", "candidate_term": "T"}], "no_op": "none"}, {"corrections": "none"}, "{}",
    ]
    got = {}
    for r in replies.parse_replies(said(spark, *odd)).collect():
        got.setdefault(r.id, []).append((r.list, r.place, r.source, r.canonical, r.failed))
    good = [("corrections", 0, "262 seems to share", "cents a share", None)]
    assert got[0] == got[1] == got[2] == good
    assert got[3] == got[5] == got[6] == [(None, 0, "", "", "no_json_object")] and got[4] == [(None, 0, "", "", "no_json_object")]
    assert sorted(got[7]) == [("corrections", 0, "", "", "not_an_object"), ("corrections", 1, "", "", "not_an_object"), ("corrections", 2, "7", "", None), ("corrections", 3, "", "", "not_an_object"), ("needs_review", 1, "s", "T", None)]
    assert 8 not in got and 9 not in got
    assert replies.parse_replies(said(spark, '{"a": }')).first().failed == "damaged_json"


def test_evaluation(spark, glossary):
    rows = [
        (0, RIGHT, WRONG, "en"), (1, "Revenue improved this quarter.", "Revenue improved this quarter.", "en"), (2, "The dividend was 42 cents per share.", "The dividend was 42 cents per share, e bit da", "en"),
        (3, "Welcome to Aspen's results", "Welcome to aspirin results", "en"), (4, None, None, None), (5, "会议开始", "会义开始", "zh"),
    ]
    told = [
        (0, {"corrections": [GOOD, GOOD, "x"], "needs_review": [], "no_op": [{"source_text": "a", "canonical_term": "b"}]}), (1, {"corrections": [{"source_text": "Revenue", "replacement_text": "EBITDA", "canonical_term": "EBITDA"}]}),
        (2, {"corrections": [{"source_text": "42 cents per share", "replacement_text": "42 cents a share", "canonical_term": "cents a share"}]}), (3, "not json"),
    ]
    answers = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in told], "id int, reply string")
    frame = spark.createDataFrame(rows, "id int, reference_text string, hypothesis_text string, language string")
    got = {r.id: r for r in replies.evaluate_replies(frame, answers, glossary).collect()}
    assert got[0].corrected_text == RIGHT and (got[0].wer_before, got[0].wer_after) == (0.2, 0.0) and (got[0].n_accept, got[0].n_reject, got[0].n_no_op) == (1, 2, 1)
    assert got[0].missing_before == ["cents a share"] and got[0].missing_after == [] and (got[0].term_recall_before, got[0].term_recall_after, got[0].term_f1_after) == (0.0, 1.0, 1.0)
    assert not got[1].asked and got[1].corrected_text == rows[1][2] and got[1].n_accept == got[1].n_reject == 0 and got[1].term_f1_before == 1.0
    assert got[2].asked and got[2].n_no_op == 1 and got[2].corrected_text == rows[2][2]
    assert got[3].n_reject == 1 and got[3].wer_after == got[3].wer_before > 0 and got[3].missing_after == ["Aspen"]
    assert not got[4].asked and got[4].wer_before == 0.0 and got[5].wer_before == 0.25
    summed = replies.reply_summary(replies.evaluate_replies(frame, answers, glossary).join(frame.select("id", "language"), "id"), ["language"]).where("language = 'en'").first()
    assert (summed.n_rows, summed.n_accept, summed.n_reject, summed.asked) == (4, 1, 3, True) and summed.mean_wer_delta < 0


def test_known_gates(spark, glossary):
    cases = [
        ("Please put it on the share folder.", "the share", "cents a share", "cents a share", ("reject", "no_number")), ("Welcome to Aspen's results presentation.", "Aspen's", "Aspen", "Aspen", ("no_op", "accepted_form")),
        ("The dividend was 42 cents per share.", "42 cents per share", "42 cents a share", "cents a share", ("no_op", "amount_is_right")), ("a \\E b e bit da", "e bit da", "EBITDA", "EBITDA", ("accept", "accepted")), ("a \\E b", "\\E", "EBITDA", "EBITDA", ("accept", "accepted")),
    ]
    texts = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, text string")
    proposals = spark.createDataFrame([(i, 0, *c[1:4]) for i, c in enumerate(cases)], "id int, place int, source string, replacement string, canonical string")
    got = {r.id: r for r in evidence.apply_corrections(texts, proposals, glossary).collect()}
    assert [(got[i].records[0].decision, got[i].records[0].reason) for i in range(len(cases))] == [c[4] for c in cases]
    assert got[4].corrected == "a EBITDA b"


def test_candidates_keep_the_glossary_order(spark, glossary):
    text = "E bit DA and aspirin: dividend 5 sense to share, 262 seems to share, 5 Sense to Share, e bit da"
    got = evidence.candidates(spark.createDataFrame([(1, text)], "id int, text string"), glossary).orderBy("place").collect()
    assert [(r.source, r.replacement) for r in got] == [("5 sense to share", "5 cents a share"), ("262 seems to share", "262 cents a share"), ("aspirin", "Aspen"), ("e bit da", "EBITDA")]


def test_related_terms(spark):
    pairs = [("pyannote", "pyannote.audio", True), ("DM-ASR", "dm asr", True), ("RAG", "WER", False), ("...", "x", False)]
    frame = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r[0] for r in frame.select(replies.related(replies.term_key(F.col("a")), replies.term_key(F.col("b")))).collect()] == [p[2] for p in pairs]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=90), st.lists(st.sampled_from("abcd"), max_size=90))
def test_edit_distance(a, b):
    assert T.edit_distance(a, b) == plain_distance(a, b)


def test_tables_as_long_as_the_texts_are_not_broadcast(spark, glossary):
    rows = spark.createDataFrame([(i, RIGHT, WRONG, "en") for i in range(4)], "id int, reference_text string, hypothesis_text string, language string")
    texts = rows.select("id", F.col("hypothesis_text").alias("text"))
    offered = evidence.candidates(texts, glossary)
    for made in (offered, evidence.apply_corrections(texts, offered, glossary), replies.evaluate_replies(rows, said(spark, *[{"corrections": [GOOD]}] * 4), glossary)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [id" in plan and "BroadcastHashJoin [id" not in plan
