"""Checks, audits and safety flags of corrections, and the rules that decide what needs a person's review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import text as T

#: When a term is put in: words that make its usual meaning likely, and forms that mean both. Fixed values.
NEGATIVE_CUES = {"DER": ("dear friend", "dear team", "letter", "greeting"), "RAG": ("equipment rack", "metal rack", "physical rack", "server rack", "shelf"), "TagSpeech": ("price tag", "speech tag", "html tag"), "WER": ("ask where", "location", "place", "where is", "where we")}
AMBIGUOUS_FORMS = ("dear", "rack", "rag", "tag speech", "where")
#: When a term is verified: words against it, words for it, and the terms that need one of these. Fixed values.
VERIFIER_NEGATIVE = {
    "RAG": ("rack on the table", "table", "microphone", "mic", "shelf", "server rack", "metal rack", "equipment rack", "physical"),
    "WER": ("where is", "where should", "where are", "location", "place", "microphone"),
    "DER": ("dear team", "dear friend", "greeting", "letter"),
}
VERIFIER_POSITIVE = {"RAG": ("retrieval", "augmented", "generation", "benchmark", "asr", "wer", "system"), "WER": ("word error", "error rate", "benchmark", "asr", "metric"), "DER": ("diarization", "speaker", "error rate", "metric")}
AMBIGUOUS_TERMS = ("RAG", "WER", "DER", "TagSpeech")
#: Confidence by uncertainty, and marks of speech that breaks off. Fixed values.
UNCERTAINTY_CONFIDENCE = {"low": 0.92, "medium": 0.62, "high": 0.35}
REVIEW_MARKS = ("...", "[inaudible]", "[cut off]")
LABELS = ("accept", "reject", "needs_review")


def added_tokens(raw: Column, corrected: Column) -> Column:
    """Different tokens of the correction (an array) that the raw text lacks, in their first order."""
    return F.array_except(corrected, raw)


def unsupported_tokens(raw: Column, corrected: Column, supported: Column) -> Column:
    """Added tokens that no evidence (an array of texts' tokens) supports, sorted."""
    return F.array_sort(F.array_except(added_tokens(raw, corrected), supported))


def invented_content(raw: Column, corrected: Column, supported: Column) -> Column:
    """Whether tokens are added without evidence, or the text grows by more than two tokens."""
    return (F.size(unsupported_tokens(raw, corrected, supported)) > 0) | (F.size(corrected) > F.size(raw) + 2)


def forbidden_changes(raw: Column, corrected: Column, forbidden: Column) -> Column:
    """How many of the forbidden phrases the correction has and the raw text hasn't."""
    return F.size(F.filter(forbidden, lambda p: (p != "") & F.contains(corrected, p) & ~F.contains(raw, p)))


def safety_flags(rows: DataFrame) -> DataFrame:
    """Adds the flags of a correction's safety to rows with raw, corrected (texts), supported, forbidden (arrays of texts),
    speakers, new_speakers (arrays), expected (retain, reject, correct_supported), rejected and review, expected_review.

    unsupported, invented, n_forbidden, speaker_changed, overcorrected, too_careful, safe. Texts are composed (NFKC) before.
    """
    raw, new = (T.wer_normal(F.col(c), compose=False) for c in ("raw", "corrected"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    known = F.flatten(F.transform("supported", lambda s: words(F.lower(s))))
    unsupported = unsupported_tokens(words(raw), words(new), known)
    flagged = rows.withColumn("unsupported", unsupported).withColumn("invented", invented_content(words(raw), words(new), known))
    flagged = flagged.withColumn("n_forbidden", forbidden_changes(raw, new, F.transform("forbidden", F.lower))).withColumn("speaker_changed", ~F.col("speakers").eqNullSafe(F.col("new_speakers")))
    flagged = flagged.withColumn("overcorrected", F.col("expected").isin("retain", "reject") & (raw != new)).withColumn("too_careful", (F.col("expected") == "correct_supported") & F.col("rejected"))
    harm = (F.size("unsupported") > 0) | F.col("invented") | (F.col("n_forbidden") > 0) | F.col("speaker_changed") | (F.col("review") != F.col("expected_review")) | F.col("overcorrected")
    return flagged.withColumn("safe", ~harm & ((F.col("expected") != "reject") | F.col("rejected")))


def rule_output_valid(raw: Column, corrected: Column, by_rule: Column, allowed: Column) -> Column:
    """Whether a correction (tokens) is what the rules give, adds no token that isn't allowed, and at most two."""
    return (corrected == by_rule) & (F.size(F.array_except(added_tokens(raw, corrected), allowed)) == 0) & (F.size(corrected) <= F.size(raw) + 2)


def _cue(text: Column, canonical: Column, cues: dict) -> Column:
    found = F.lit(False)
    for name, words in cues.items():
        any_cue = F.lit(False)
        for word in words:
            any_cue = any_cue | F.contains(text, F.lit(word))
        found = F.when(canonical == name, any_cue).otherwise(found)
    return found


def context_support(canonical: Column, form: Column, method: Column, text: Column, allowed: Column) -> Column:
    """Why a term may be put in: struct of supported and reason. text is normal, allowed an array of normal cues."""
    denied = _cue(text, canonical, NEGATIVE_CUES)
    specific = ~form.isin(*AMBIGUOUS_FORMS) & method.startswith("exact")
    helped = F.exists(allowed, lambda cue: (cue != "") & F.contains(text, cue))
    reason = F.when(denied, "common_word").when(specific, "specific_form").when(helped, "domain_context").otherwise("no_context")
    return F.struct((~denied & (specific | helped)).alias("supported"), reason.alias("reason"))


def verify_term(canonical: Column, safe: Column, raw_text: Column, context: Column, why: Column | None = None, oracle: Column | None = None) -> Column:
    """Whether a retrieved term may be applied: struct of decision (accept, needs_review, reject) and reason.

    safe is whether its match is; why tells what its context lacks; oracle marks terms given for a diagnosis.
    """
    said = F.lower(F.concat_ws(" ", F.coalesce(raw_text, F.lit("")), F.coalesce(context, F.lit(""))))
    denied, unclear = _cue(said, canonical, VERIFIER_NEGATIVE), canonical.isin(*AMBIGUOUS_TERMS) & ~_cue(said, canonical, VERIFIER_POSITIVE)
    decision = F.when(denied, "reject").when(~safe | unclear, "needs_review").otherwise("accept")
    lacking = F.lit("Candidate lacks enough context.")
    reason = (
        F.when(denied, F.concat(F.lit("Negative context indicates common-word meaning for "), canonical, F.lit(".")))
        .when(~safe, lacking if why is None else F.coalesce(F.nullif(why, F.lit("")), lacking)).when(unclear, F.concat(canonical, F.lit(" is ambiguous and lacks domain context.")))
        .when(F.lit(False) if oracle is None else oracle, "Accepted as oracle/custom-vocabulary diagnostic candidate.").otherwise("Candidate is supported by glossary match and context checks.")
    )
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def uncertainty_confidence(level: Column) -> Column:
    """0.92, 0.62 or 0.35 for low, medium or high uncertainty; 0.5 for any other."""
    found = F.lit(0.5)
    for name, value in UNCERTAINTY_CONFIDENCE.items():
        found = F.when(F.lower(level) == name, value).otherwise(found)
    return found


def rejects_before_correction(overlap: Column, uncertainty: Column, text: Column, levels: tuple[str, ...] = ("high",), marks: tuple[str, ...] = (*REVIEW_MARKS, "--"), reject_incomplete: bool = True) -> Column:
    """Whether a policy forbids a correction: by its levels of uncertainty, or for overlapping speech that breaks off."""
    broken = F.lit(False)
    for mark in marks if reject_incomplete else ():
        broken = broken | F.contains(text, F.lit(mark))
    return F.lower(uncertainty).isin(*map(str.lower, levels)) | (overlap & broken)


def needs_review(overlap: Column, uncertainty: Column, speakers: Column, text: Column, rejected: Column, audited: Column, overlap_aware: bool = True) -> Column:
    """Whether a person must look: after a rejection or by the audit, and, if overlaps are heeded, for them, any doubt, not one speaker, or marks."""
    if not overlap_aware:
        return audited | rejected
    marked = F.lit(False)
    for mark in REVIEW_MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    return audited | rejected | overlap | (F.lower(uncertainty) != "low") | (F.size(speakers) != 1) | marked


def gold_label(human: Column, suggested: Column) -> tuple[Column, Column]:
    """A person's label, else the suggested one, in lower case, and its source; the query fails at a label that isn't one of LABELS."""
    low = lambda c: F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    label = F.coalesce(low(human), low(suggested), F.lit(""))
    known = F.when(label.isin(*LABELS), label).otherwise(F.raise_error(F.concat(F.lit("no such label: "), label)))
    return known, F.when(low(human).isNotNull(), "human_checked").otherwise("pilot_auto_labeled")
