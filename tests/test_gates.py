"""The gates on known proposals."""

import pytest
from pyspark.sql import functions as F

from turnstone.operators import gates

_ROW = "raw_text string, corrected_text string, context string, terms array<string>, overlap boolean, heavy_overlap boolean, speaker_ambiguity boolean, partial boolean"


def scored(spark, *rows):
    frame = spark.createDataFrame([(*row, *([False] * (8 - len(row)))) for row in rows], _ROW)
    return gates.binary_gate(gates.gate_scores(gates.evidence(frame))).collect()


def test_known_proposals(spark):
    rows = scored(
        spark,
        ("we use piano note", "we use pyannote", "Speaker diarization toolkit discussion.", ["pyannote"]),
        ("put it on the rack", "put it on the RAG", "A physical equipment rack is being discussed.", ["RAG"]),
        ("where changed after the test", "WER changed after the test", "A test is mentioned without specifying ASR.", ["WER"]),
        ("same text", "Same text", "", None), ("", "words", None, None), ("speaker a said", "speaker b said", "", []),
    )
    assert [r.decision for r in rows] == ["accept", "reject", "needs_review", "accept", "reject", "reject"]
    assert rows[0].support_score > rows[0].risk_score and rows[0].binary_decision == "safe_to_apply" and (rows[0].support_score, rows[0].risk_score) == (0.8, 0.15)
    assert rows[0].removed == ["piano", "note"] and rows[0].added == ["pyannote"] and rows[3].binary_decision == "do_not_apply"
    assert rows[0].explanation == "accept: retrieval and context support pyannote; most inserted tokens are grounded; observed risk: low edit risk."
    assert rows[4].risk_score == 1.0 and rows[5].attribution_changed


def test_a_reordering_is_an_edit(spark):
    row = scored(spark, ("one two three", "three one two", "", []))[0]
    assert not row.no_change and row.removed == ["three"] and row.added == ["three"] and row.support_ratio == 1.0


@pytest.mark.parametrize("at,risk", [(4, 0.12), (5, 0.28), (6, 0.28), (7, 0.2)])
def test_flags_add_their_risk(spark, at, risk):
    row = ["a b c d e f", "a b c d e g", "", []] + [i == at for i in range(4, 8)]
    plain, flagged = scored(spark, row[:4], row)
    assert round(flagged.risk_score - plain.risk_score, 6) == risk


def test_margins(spark):
    frame = spark.createDataFrame([(0.2, 0.1, False), (0.2, 0.3, False), (0.2, 0.195, False), (0.2, 0.1, True)], "before double, after double, unsafe boolean")
    label, reason = gates.margin_label(F.col("before"), F.col("after"), 0.01, F.col("unsafe"))
    rows = frame.select(label.alias("label"), reason.alias("reason")).collect()
    assert [r.label for r in rows] == ["safe_to_apply", "do_not_apply", "do_not_apply", "do_not_apply"]
    assert rows[0].reason == "error_after + 0.010 < error_before" and rows[3].reason.startswith("Safety override")
    with pytest.raises(ValueError, match="negative"):
        gates.margin_label(F.col("before"), F.col("after"), -0.1)
