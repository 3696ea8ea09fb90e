"""Audits, reviews, gate features and labels on known rows."""

import pytest
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import audits, gate_features, review, rollups

_RESULT = "clip_id string, dataset_name string, language string, model_name string, error_rate string, cleaned_error_rate string, reference_text string, hypothesis_text string"
NAMES = ("fleurs_en_1578", "Google FLEURS", "en", "tiny", "0.9", None, "Then, Lakkha Singh took the lead in singing the bhajans.", "Then lock a sink to the lid and sink in the mushrooms.")
MEETING = ("high", "AMI Meeting Corpus", "en", "tiny", "0.5", "0.3", "Um this is the kick-off meeting for twenty five minutes.", "This is the kickoff meeting.")
FINE = ("low", "Google FLEURS", "en", "tiny", "0.1", None, "The system works.", "The system works.")


def test_transcripts(spark):
    rows = {r.clip_id: r for r in audits.audit_transcripts(spark.createDataFrame([NAMES, MEETING, FINE], _RESULT)).collect()}
    names, meeting, fine = (rows[x[0]] for x in (NAMES, MEETING, FINE))
    assert "proper_noun_or_named_entity" in names.error_types and names.candidates == ["Lakkha Singh"] and names.term_candidate and names.missing == ["lakkha", "singh", "took", "lead", "singing", "bhajans"]
    assert meeting.error_types == ["number_or_quantity", "meeting_disfluency_or_truncation", "truncation_or_omission"]
    assert meeting.notes == "hypothesis/reference length ratio=0.50; cleaned meeting metric is lower after disfluency removal"
    assert fine.error_types == ["general_asr_error"] and not fine.term_candidate and fine.notes == ""


def test_transcripts_with_odd_texts(spark):
    odd = [("a", None, None, None, None, None, None, None), ("b", "x", "zh", "m", "0.4", None, "会议 RAG 开始", "会议"), ("c", "x", "en", "m", "x", "", "\\E Foo-Bar O'Neil ASR", "")]
    rows = {r.clip_id: r for r in audits.audit_transcripts(spark.createDataFrame(odd, _RESULT)).collect()}
    assert rows["a"].error_types == ["general_asr_error"] and rows["a"].missing == []
    assert rows["b"].error_types[0] == "professional_term_or_glossary" and "mandarin_low_frequency_or_script" in rows["b"].error_types and rows["b"].missing == ["开", "始"]
    assert rows["c"].candidates == ["ASR", "Foo-", "Bar O'", "Neil ASR"]


def test_the_worst_transcripts(spark):
    frame = spark.createDataFrame([FINE, MEETING, NAMES], _RESULT)
    assert [r.clip_id for r in audits.worst_transcripts(frame, 0.2).collect()] == [NAMES[0], MEETING[0]]
    assert [r.clip_id for r in audits.worst_transcripts(frame, top=1).collect()] == [NAMES[0]]
    with pytest.raises(KeyError, match="hypothesis_text"):
        audits.worst_transcripts(frame.drop("hypothesis_text"))


_CORRECTION = "raw_text string, corrected_text string, neighbours string, evidence array<string>, overlap boolean"


@pytest.mark.parametrize(
    "row,risk,review_needed,unsupported",
    [
        (("we use piano note", "we use pyannote", "", ["pyannote", "piano note"], False), "medium", False, []), (("we use piano note here again", "we use pyannote here again", "", ["pyannote"], False), "low", False, []),
        (("the result is unclear", "the result is approved friday", "", [], False), "high", True, ["approved", "friday"]), (("one two three", "one two four", "four", None, True), "low", False, []),
        (("one two three", "two four five", "four five", None, True), "medium", True, []), (("a b", "a b a b a b a", "", [], False), "high", True, []), ((None, None, None, None, None), "low", False, []),
    ],
)
def test_corrections(spark, row, risk, review_needed, unsupported):
    got = audits.audit_corrections(spark.createDataFrame([row], _CORRECTION)).first()
    assert (got.risk, got.needs_review, got.unsupported) == (risk, review_needed, unsupported)


def test_changes_are_told(spark):
    got = audits.audit_corrections(spark.createDataFrame([("a b c", "a x c d", "", ["x"], False)], _CORRECTION)).first()
    assert got.changed_tokens == ["replace: b -> x", "insert: ∅ -> d"] and got.supported == ["x"] and got.unsupported == ["d"]


@pytest.mark.parametrize(
    "row,decision",
    [
        (("RAG", True, "put the rack on the table", "Meeting room."), "reject"), (("RAG", True, "the rack improves", "Retrieval augmented generation benchmark."), "accept"), (("RAG", False, "rack", "A benchmark."), "needs_review"),
        (("TagSpeech", True, "tag speech", "A paper."), "needs_review"), (("WER", True, "where is the room", "benchmark"), "reject"), (("Qwen", True, "q when", ""), "accept"), (("DER", True, "the ear", ""), "needs_review"),
    ],
)
def test_verifier(spark, row, decision):
    frame = spark.createDataFrame([row], "canonical string, safe boolean, raw string, context string")
    got = frame.select(review.verify_term(F.col("canonical"), F.col("safe"), F.col("raw"), F.col("context")).alias("v")).first().v
    assert got.decision == decision and got.reason


def test_overlap_policy(spark):
    rows = [(True, "high", "plain", ["A", "B"]), (True, "low", "it broke -- off", ["A"]), (False, "low", "plain", ["A"]), (False, "LOW", "it was ...", ["A"]), (False, "low", "plain", []), (False, "medium", "plain", ["A"])]
    frame = spark.createDataFrame(rows, "overlap boolean, level string, text string, speakers array<string>")
    reject = review.rejects_before_correction(F.col("overlap"), F.col("level"), F.col("text"))
    look = lambda aware: review.needs_review(F.col("overlap"), F.col("level"), F.col("speakers"), F.col("text"), reject, F.lit(False), aware)
    got = frame.select(reject.alias("reject"), look(True).alias("aware"), look(False).alias("unaware"), review.uncertainty_confidence(F.col("level")).alias("c")).collect()
    assert [r.reject for r in got] == [True, True, False, False, False, False] and [r.aware for r in got] == [True, True, False, True, True, True]
    assert [r.unaware for r in got] == [True, True, False, False, False, False] and [r.c for r in got] == [0.35, 0.92, 0.92, 0.92, 0.92, 0.62]


def test_gold_labels(spark):
    frame = spark.createDataFrame([(" ACCEPT", "reject"), ("", "Needs_Review "), (None, "reject")], "human string, suggested string")
    label, source = review.gold_label(F.col("human"), F.col("suggested"))
    assert [tuple(r) for r in frame.select(label, source).collect()] == [("accept", "human_checked"), ("needs_review", "pilot_auto_labeled"), ("reject", "pilot_auto_labeled")]
    with pytest.raises(Exception, match="no such label: maybe"):
        spark.createDataFrame([("maybe", "accept")], "human string, suggested string").select(label).collect()


def test_selective_metrics(spark):
    pairs = [("accept", "accept"), ("reject", "accept"), ("reject", "reject"), ("needs_review", "needs_review"), ("needs_review", "reject")]
    got = rollups.selective_metrics(spark.createDataFrame([("k", *p) for p in pairs], "k string, true string, predicted string"), ["k"]).first()
    assert (got.unsafe_accept_rate, got.needs_review_recall, got.accept_precision, got.reject_recall, got.coverage) == (0.25, 0.5, 0.5, 0.5, 0.8)
    assert got.macro_f1 == round((2 / 3 + 0.5 + 2 / 3) / 3, 6)


def featured(spark, **row):
    typed = ", ".join(f"{name} {'boolean' if isinstance(value, bool) else 'double' if isinstance(value, float) else 'string'}" for name, value in row.items())
    return gate_features.labels(gate_features.features(spark.createDataFrame([tuple(row.values())], typed))).first()


def test_features_track_change_and_risk(spark):
    got = featured(
        spark, raw_text="we use piano note", corrected_text="we use pyannote", retrieved_candidates='["pyannote"]', applied_corrections='["piano note -> pyannote"]', expected_terms='["pyannote"]', true_positive_terms='["pyannote"]',
        overlap=True, uncertainty_level="high", needs_review=True,
    )
    assert (got.retrieval_candidate_count, got.num_changed_tokens, got.changed_token_ratio, got.heavy_overlap_flag, got.label) == (1, 2, 0.5, 1, "needs_review")
    assert round(got.context_risk_score, 9) == round(0.18 + 0.27 + 0.25 + 0.18 * 0.5 + 0.12 * 3 / 17, 9) and got.language_other_flag == 1


def test_labels_are_conservative(spark):
    bad = featured(spark, raw_text="partial words", corrected_text="a complete unsupported claim", invented_content=True, safety_pass=False)
    assert (bad.label, bad.label_reason) == ("reject", "invented content; safety policy failed")
    assert featured(spark, raw_text="partial words", corrected_text="partial words", needs_review=True, overlap=True, uncertainty_level="high", safety_pass=True).label == "needs_review"
    open_target = featured(spark, raw_text="x", corrected_text="x ", expected_terms='["t"]', missed_terms='["t"]')
    assert (open_target.label, open_target.ambiguous) == ("needs_review", True)
    assert featured(spark, raw_text="x", corrected_text="y", text_error_before=0.1, text_error_after=0.2, expected_terms="t").label_reason == "correction increased reference text error"
    assert featured(spark, raw_text="x", corrected_text="x").label_reason == "negative-control text safely preserved"


def test_risk_ignores_outcomes(spark):
    row = {"raw_text": "we use piano note", "corrected_text": "we use pyannote", "overlap": True, "uncertainty_level": "medium"}
    outcome = featured(spark, **row, needs_review=True, correction_rejected=True, unsupported_change_count="3", invented_content=True, speaker_attribution_changed=True)
    assert featured(spark, **row).context_risk_score == outcome.context_risk_score and outcome.unsupported_change_count == 3


def test_leaks(spark):
    names = [*gate_features.AUDIT_AWARE, *gate_features.OTHER_FIELDS]
    rows = {r.feature: r for r in gate_features.audit_features(spark.createDataFrame([(n,) for n in names], "feature string")).collect()}
    assert rows["correction_rejected_input_flag"].category == "direct_label_proxy_features" and rows["invented_content_flag"].category == "final_audit_outcome_features"
    assert not rows["needs_review_input_flag"].evidence_only and rows["reference_text"].category == "risky_reference_derived_features" and rows["overlap_flag"].risk_only
    leaking = {*gate_features.LABEL_PROXIES, *gate_features.REFERENCE_DERIVED, *gate_features.AUDIT_OUTCOMES}
    assert not leaking & {*gate_features.EVIDENCE_ONLY, *gate_features.RISK_ONLY} and len(gate_features.AUDIT_AWARE) == 36 and len(gate_features.RISK_ONLY) == 14


def test_baselines(spark):
    rows = [{"raw_text": "a b", "corrected_text": "c d"}, {"raw_text": "a", "corrected_text": "a", "overlap": "true", "uncertainty_level": "high"}, {"raw_text": "a", "corrected_text": "a", "variant": "llm", "correction_rejected": "true"}]
    frame = spark.createDataFrame([tuple(row.get(name) for name in gate_features.COLUMNS) for row in rows], ", ".join(f"{name} string" for name in gate_features.COLUMNS))
    got = gate_features.features(frame).select(gate_features.policy_baseline(), gate_features.predecision_baseline(), gate_features.llm_baseline()).collect()
    assert [tuple(r) for r in got] == [("accept", "reject", "accept"), ("needs_review", "needs_review", "accept"), ("reject", "accept", "reject")]


def test_secrets_stems_and_languages(spark):
    frame = spark.createDataFrame([("sk-secret-value-1234", "_a b/c._", "zh_CN"), ("short", "..", " EN-us "), (" ", "x", None)], "key string, name string, lang string")
    got = frame.select(T.masked(F.col("key")), T.safe_stem(F.col("name")), T.canonical_language(F.col("lang")), T.metric_of(F.col("lang"))).collect()
    assert [tuple(r) for r in got] == [("sk-...34", "a_b_c", "zh-cn", "CER"), ("*****", "transcript", "en-us", "WER"), ("(not configured)", "x", "", "WER")]


def test_length_ratios_are_rounded_by_their_exact_value(spark):
    """5/8 is a half, told to even; 23/40 lies just under one. Java's format makes 0.63 and 0.58 of them."""
    rows = [(i, " ".join(["word"] * n), " ".join(["word"] * k), "en", "x", 0.5, None) for i, (k, n) in enumerate([(5, 8), (23, 40), (1, 8), (3, 8), (7, 10)])]
    df = spark.createDataFrame(rows, "i int, reference_text string, hypothesis_text string, language string, dataset_name string, error_rate double, cleaned_error_rate double")
    got = [r.notes.rpartition("=")[2] for r in audits.audit_transcripts(df).orderBy("i").collect()]
    assert got == ["0.62", "0.57", "0.12", "0.38", "0.70"]
