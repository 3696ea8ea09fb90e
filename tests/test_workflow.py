import re

import pytest

from turnstone.operators import anchors, workflow
from turnstone.sources.tables import conversation_words


@pytest.fixture
def meeting(spark):
    words = [(1, 0, i, w, i * 400, i * 400 + 400) for i, w in enumerate("the ear said rack the".split())] + [(1, 1, 0, "later", 9000, 9400)]
    turns = [(1, "A", 0, 1600), (1, "B", 1200, 2400)]
    find = workflow.exact_terms(spark.createDataFrame([("the ear", "DER"), ("rack", "RAG")], "form string, canonical string"))
    return spark.createDataFrame(words, "clip_id long, idx long, pos long, word string, start_ms long, end_ms long"), spark.createDataFrame(turns, "clip_id long, speaker string, start_ms long, end_ms long"), find


def rows(name, meeting):
    return workflow.variant(name, *meeting).orderBy("anchor").collect()


def test_each_variant_adds_to_the_one_before(meeting):
    (one,) = rows("asr_only", meeting)
    assert (one.speaker, one.text, one.needs_review, one.start_ms, one.end_ms) == ("UNKNOWN", "the ear said rack the later", False, 0, 9400)
    assert [(r.speaker, r.text) for r in rows("temporal_anchor_only", meeting)] == [("UNKNOWN", "the ear said rack the"), ("UNKNOWN", "later")]
    assert [(r.speaker, r.overlap, r.needs_review) for r in rows("reference_speaker_time", meeting)] == [("A", False, False), ("A", False, False), ("B", False, False), ("UNKNOWN", False, True)]
    aware = rows("overlap_aware", meeting)
    assert [(r.text, r.overlap, r.terms) for r in aware] == [("the ear said", False, []), ("rack", True, []), ("the", False, []), ("later", False, [])]
    assert aware[1].interruption and aware[1].speakers == ["A", "B"]
    assert [r.terms for r in rows("term_rescue", meeting)] == [["DER"], ["RAG"], [], []]
    assert [r.corrected for r in rows("constrained_correction", meeting)] == ["DER said", "RAG", "the", "later"]
    assert [r.corrected for r in rows("full", meeting)] == ["DER said", "RAG", "the", "later"]


def test_unknown_names_are_refused(meeting):
    with pytest.raises(ValueError, match="no such variant"):
        workflow.variant("magic", *meeting)


def test_all_variants_at_once_are_each_of_them(meeting):
    together = workflow.variants(*meeting)
    for name in workflow.VARIANTS:
        alone = workflow.variant(name, *meeting)
        assert together.where(f"variant = '{name}'").select(alone.columns).orderBy("anchor").collect() == alone.orderBy("anchor").collect()


def test_words_are_dealt_by_clip_alone(spark):
    turns = spark.createDataFrame([(1, 0, "A", "word " * 200, 0, 80_000), (1, 1, "B", "word word", 59_000, 61_000), (2, 0, "A", "one", 0, 1000)], "clip_id long, idx long, speaker string, text string, start_ms long, end_ms long")
    aligned = anchors.align_words(conversation_words(turns), turns)
    near = aligned.where("clip_id = 1 and idx = 0 and start_ms between 58500 and 61000").collect()
    assert {(r.start_ms, *r.speakers) for r in near} == {(60_800, "A"), *((ms, "A", "B") for ms in range(58_800, 60_800, 400))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = anchors.sessionize(anchors.align_words(conversation_words(turns), turns))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all(re.fullmatch(r"clip_id#\d+L(, bucket#\d+L)?, \d+", keys) for keys in dealt)  # turns by bucket, words never
