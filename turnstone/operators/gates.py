"""Deterministic gates for correction proposals, scored on evidence from before the decision.

A proposal has a raw and a corrected text, a context, retrieved terms and flags of its speech. What it changes comes from
the edits between the token arrays; terms are weighed by their context; everything else is column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators import alignment

#: What a token is, who is named as speaking, and cues: of terms by the first key that fits, of doubt, of contradiction. Fixed values.
TOKEN = r"[\p{L}\p{N}_]+(?:[.-][\p{L}\p{N}_]+)*"
SPEAKER = r"(?i)\b(speaker|participant)\s*([a-z]|[0-9]+)\b"
TERM_CUES = {
    "pyannote": ("speaker", "diarization", "audio", "meeting", "turn"),
    "diarization": ("speaker", "meeting", "turn", "segmentation", "who spoke"),
    "rag": ("retrieval", "glossary", "knowledge", "asr", "correction"),
    "wer": ("asr", "metric", "error rate", "transcription", "benchmark"),
    "der": ("diarization", "metric", "speaker error", "benchmark"),
    "temporal anchor": ("alignment", "timestamp", "speaker-time", "timeline", "anchor"),
    "tagspeech": ("paper", "temporal", "speech", "research"),
    "dm-asr": ("paper", "speaker", "asr", "research"),
    "qwen": ("model", "llm", "api", "language model"),
}
AMBIGUITY_CUES = (
    "ambiguous", "unclear", "underspecified", "weak", "not explicit", "not explicitly", "not identified", "not sufficiently", "does not identify", "but not ", "no model", "no speaker", "lacks ",
    "without naming", "without specifying", "without speaker", "may be", "might be", "is likely", "is plausible",
)
CONTRADICTION_CUES = (
    "physical", "ordinary", "greeting", "location question", "place name", "musician", "emotional", "unrelated", "direct message", "not a ", "no source evidence", "no timing evidence", "no result", "no guarantee",
    "no comparison", "no correction is needed",
)
#: Points for support and risk, and the limits of decisions. Fixed values.
SUPPORT = {"base": 0.15, "no_change": 0.9, "term": 0.35, "each_term": 0.1, "terms_most": 0.55, "grounded": (0.8, 0.2), "half_grounded": (0.5, 0.1), "only_removed": 0.05, "contradiction": 0.4, "ambiguity": 0.15}
RISK = {
    "base": 0.05, "overlap": 0.12, "heavy_overlap": 0.28, "speaker_ambiguity": 0.28, "partial": 0.2, "large_edit": (0.55, 0.2), "edit": (0.3, 0.1), "much_longer": (0.5, 0.35), "longer": (0.2, 0.15), "weak_terms": 0.25,
    "ambiguity": 0.28, "contradiction": 0.5, "weakly_grounded": 0.25, "attribution": 0.55,
}
REJECT_RISK, UNSUPPORTED, UNSUPPORTED_RISK, REVIEW_RISK, ACCEPT_SUPPORT = 0.78, 0.3, 0.45, 0.4, 0.58


def folded(text: Column) -> Column:
    """Lower case, with ss for the letter that lower case alone leaves."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(f"({TOKEN})"), 1)


def _holds_any(text: Column, cues) -> Column:
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(text, F.lit(cue))
    return found


def _in_context(term: Column, context: Column) -> Column:
    """Whether the context has a cue of the first key that the term holds or is part of; terms without a key need none."""
    found = F.lit(True)
    for key, cues in reversed(TERM_CUES.items()):
        found = F.when(F.contains(term, F.lit(key)) | F.contains(F.lit(key), term), _holds_any(context, cues)).otherwise(found)
    return found


def _speakers(text: Column) -> Column:
    named = F.regexp_extract_all(text, F.lit(f"({SPEAKER.replace('(?i)', '(?i:', 1)}))"), 0)
    parts = F.transform(named, lambda m: F.concat(F.lower(F.regexp_extract(m, SPEAKER, 1)), F.lit(" "), F.lower(F.regexp_extract(m, SPEAKER, 2))))
    return F.array_sort(F.array_distinct(parts))


def evidence(rows: DataFrame) -> DataFrame:
    """Adds what the scores need to rows with raw_text, corrected_text, context (texts) and terms (array of retrieved ones).

    raw, corrected (tokens), removed, added (by the edit script, in order), no_change, changed_ratio, length_growth,
    supported_terms, weak_terms, support_ratio, ambiguity, contradiction and attribution_changed. Null texts are empty.
    """
    clean = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    c = F.col
    cut = rows.withColumns({name: clean(name) for name in ("raw_text", "corrected_text", "context")}).withColumns({"raw": tokens(c("raw_text")), "corrected": tokens(c("corrected_text"))})
    aligned = cut.withColumn("edited", alignment.edits(c("raw"), c("corrected"), leave_out_common=True))
    removed, added = alignment.removed_and_added(c("raw"), c("corrected"), c("edited"))
    changed = aligned.withColumns({"removed": removed, "added": added}).drop("edited")
    context, whole = folded(c("context")), F.array_join("corrected", " ")
    stripped = F.filter(F.transform(F.coalesce("terms", F.array().cast("array<string>")), F.trim), lambda t: t != "")
    said = F.filter(stripped, lambda t: (F.size(tokens(t)) > 0) & F.contains(whole, F.array_join(tokens(t), " ")))
    retrieved = F.flatten(F.transform(stripped, tokens))
    grounded = F.size(F.filter("added", lambda w: F.array_contains(retrieved, w) | F.array_contains(c("raw"), w)))
    n_raw, n_new = F.size("raw"), F.size("corrected")
    return changed.withColumns({
        "supported_terms": F.filter(said, lambda t: _in_context(folded(t), context)), "weak_terms": F.filter(said, lambda t: ~_in_context(folded(t), context)),
        "support_ratio": F.when(F.size("added") > 0, grounded / F.size("added")).otherwise(1.0), "no_change": c("raw") == c("corrected"),
        "changed_ratio": (F.size("removed") + F.size("added")) / F.greatest(n_raw + n_new, F.lit(1)), "length_growth": F.greatest(F.lit(0.0), (n_new - n_raw) / F.greatest(n_raw, F.lit(1))),
        "ambiguity": _holds_any(context, AMBIGUITY_CUES), "contradiction": _holds_any(context, CONTRADICTION_CUES), "attribution_changed": _speakers(c("raw_text")) != _speakers(c("corrected_text")),
    })


def _clip(value: Column) -> Column:
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 3)


def _points(*cases) -> Column:
    return sum((F.when(when, value).otherwise(0.0) for when, value in cases), F.lit(0.0))


def _steps(value: Column, *steps) -> Column:
    """The points of the first step (from, points) that the value reaches; else 0."""
    out = F.lit(0.0)
    for least, points in reversed(steps):
        out = F.when(value >= least, points).otherwise(out)
    return out


def gate_scores(rows: DataFrame) -> DataFrame:
    """Adds support_score, risk_score, decision (accept, needs_review, reject) and explanation to rows with evidence().

    rows also has the flags overlap, heavy_overlap, speaker_ambiguity and partial. Empty texts are rejected with risk 1.
    """
    c = F.col
    edit, n_supported, n_added = ~c("no_change"), F.size("supported_terms"), F.size("added")
    weakly = (n_added > 0) & (c("support_ratio") < SUPPORT["half_grounded"][0])
    support = (
        SUPPORT["base"] + _points((n_supported > 0, F.least(F.lit(SUPPORT["terms_most"]), SUPPORT["term"] + SUPPORT["each_term"] * n_supported)))
        + _steps(c("support_ratio"), SUPPORT["grounded"], SUPPORT["half_grounded"]) + _points(((n_added == 0) & (F.size("removed") > 0), SUPPORT["only_removed"]))
        - F.when(c("contradiction"), SUPPORT["contradiction"]).when(c("ambiguity"), SUPPORT["ambiguity"]).otherwise(0.0)
    )
    risk = (
        RISK["base"] + _points(*((c(name), RISK[name]) for name in ("overlap", "heavy_overlap", "speaker_ambiguity", "partial"))) + _steps(c("changed_ratio"), RISK["large_edit"], RISK["edit"])
        + _steps(c("length_growth"), RISK["much_longer"], RISK["longer"])
        + _points((F.size("weak_terms") > 0, RISK["weak_terms"]), (c("ambiguity"), RISK["ambiguity"]), (c("contradiction") & edit, RISK["contradiction"]), (weakly, RISK["weakly_grounded"]), (c("attribution_changed"), RISK["attribution"]))
    )
    empty = (c("raw_text") == "") | (c("corrected_text") == "")
    scored = rows.withColumns({
        "empty": empty, "support_score": F.when(empty, 0.0).otherwise(_clip(F.when(c("no_change"), F.lit(SUPPORT["no_change"])).otherwise(support))), "risk_score": F.when(empty, 1.0).otherwise(_clip(risk)),
        "supports": F.array_compact(F.array(
            F.when(c("no_change"), "the proposal preserves the ASR evidence"), F.when(edit & (n_supported > 0), F.concat(F.lit("retrieval and context support "), F.array_join("supported_terms", ", "))),
            F.when(edit & (c("support_ratio") >= SUPPORT["grounded"][0]), "most inserted tokens are grounded"),
        )),
        "risks": F.array_compact(F.array(
            F.when(c("overlap"), "overlap"), F.when(c("heavy_overlap"), "heavy overlap"), F.when(c("speaker_ambiguity"), "speaker ambiguity"), F.when(c("partial"), "partial utterance"),
            F.when(c("changed_ratio") >= RISK["large_edit"][0], "large edit"), F.when(c("length_growth") >= RISK["much_longer"][0], "substantial unsupported expansion"),
            F.when(F.size("weak_terms") > 0, "retrieval term lacks matching context"), F.when(c("ambiguity"), "context explicitly signals ambiguity"),
            F.when(c("contradiction") & edit, "context contradicts the proposed domain edit"), F.when(weakly, "inserted tokens are weakly grounded"), F.when(c("attribution_changed"), "speaker attribution changed"),
        )),
    })
    decision = (
        F.when(c("empty"), "reject").when(c("no_change"), "accept").when(c("attribution_changed") | (c("risk_score") >= REJECT_RISK), "reject")
        .when((c("support_score") < UNSUPPORTED) & (c("risk_score") >= UNSUPPORTED_RISK), "reject").when(c("ambiguity"), "needs_review")
        .when((c("risk_score") >= REVIEW_RISK) | (c("support_score") < ACCEPT_SUPPORT), "needs_review").otherwise("accept")
    )
    either = lambda name, joint, none: F.when(F.size(name) > 0, F.array_join(name, joint)).otherwise(none)
    told = F.concat(c("decision"), F.lit(": "), either("supports", "; ", "no strong support evidence"), F.lit("; observed risk: "), either("risks", ", ", "low edit risk"), F.lit("."))
    decided = scored.withColumn("decision", decision)
    return decided.withColumn("explanation", F.when(c("empty"), "Reject: empty raw or proposed text is not auditable.").otherwise(told)).drop("empty", "supports", "risks")


def binary_gate(scored: DataFrame) -> DataFrame:
    """Adds binary_decision: safe_to_apply only for an accepted edit of low risk without severe timing doubts."""
    c = F.col
    safe = (c("decision") == "accept") & ~c("no_change") & (c("support_score") >= ACCEPT_SUPPORT) & (c("risk_score") < REVIEW_RISK) & ~(c("heavy_overlap") | c("speaker_ambiguity")) & ~(c("partial") & (c("risk_score") >= 0.35))
    return scored.withColumn("binary_decision", F.when(safe, "safe_to_apply").otherwise("do_not_apply"))


def margin_label(before: Column, after: Column, margin: float = 0.0, unsafe: Column | None = None) -> tuple[Column, Column]:
    """Label and reason: safe_to_apply where the error falls by more than the margin and nothing unsafe was found. ValueError below 0."""
    if margin < 0:
        raise ValueError("the margin of improvement must not be negative")
    unsafe = F.lit(False) if unsafe is None else F.coalesce(unsafe, F.lit(False))
    better = after + margin < before
    label = F.when(unsafe | ~F.coalesce(better, F.lit(False)), "do_not_apply").otherwise("safe_to_apply")
    override = "Safety override: unsupported, invented, forbidden, or speaker-attribution-changing content was detected."
    return label, F.when(unsafe, override).when(better, f"error_after + {margin:.3f} < error_before").otherwise(f"error_after + {margin:.3f} >= error_before")
