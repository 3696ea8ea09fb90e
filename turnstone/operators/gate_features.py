"""What a gate may know of a correction: features, their leaks, labels, and plain baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators import alignment

#: Features by what they are known from, in the order of models' columns. Fixed values.
EVIDENCE_ONLY = (
    "retrieval_candidate_count", "applied_correction_count", "num_changed_tokens", "changed_token_ratio", "edit_distance_ratio", "overlap_flag", "heavy_overlap_flag", "uncertainty_score", "context_risk_score", "api_used_flag",
    "llm_variant_flag", "rule_variant_flag", "language_en_flag", "language_fr_flag", "language_zh_flag", "language_other_flag", "source_term_rescue_flag", "source_overlap_safety_flag", "source_independent_flag",
)
RISK_ONLY = tuple(name for name in EVIDENCE_ONLY if name not in ("retrieval_candidate_count", "applied_correction_count") and not name.startswith("source_"))
REFERENCE_DERIVED = ("expected_term_count", "text_error_before", "negative_control_flag")
LABEL_PROXIES = (
    "needs_review_input_flag", "correction_rejected_input_flag", "true_positive_term_count", "false_positive_term_count", "missed_term_count", "term_precision", "term_recall", "term_f1", "text_error_after", "error_delta",
)
AUDIT_OUTCOMES = ("unsupported_change_count", "forbidden_change_count", "invented_content_flag", "speaker_attribution_changed_flag")
AUDIT_AWARE = (*EVIDENCE_ONLY, *REFERENCE_DERIVED, *LABEL_PROXIES, *AUDIT_OUTCOMES)
FEATURE_SETS = {"audit_aware": AUDIT_AWARE, "evidence_only": EVIDENCE_ONLY, "risk_only": RISK_ONLY}
#: Fields that are no features, and why each class leaks. Fixed values.
OTHER_FIELDS = {
    "safety_pass": ("direct_label_proxy_features", "Final policy pass/fail value used to derive the target label."), "needs_review": ("direct_label_proxy_features", "Final review decision; direct target proxy."),
    "correction_rejected": ("direct_label_proxy_features", "Final rejection decision; direct target proxy."), "expected_label": ("direct_label_proxy_features", "Training target and never a model input."),
    "reference_text": ("risky_reference_derived_features", "Ground-truth text unavailable at deployment time."),
}
CLASSES = {
    "direct_label_proxy_features": (LABEL_PROXIES, "Direct encoding of the review/rejection target decision."), "final_audit_outcome_features": (AUDIT_OUTCOMES, "Post-correction audit outcome unavailable before gating."),
    "risky_reference_derived_features": (REFERENCE_DERIVED, "Requires reference labels, expected terms, or derived correctness."),
}
ALLOWED = ("allowed_pre_decision_features", "Available from the proposal, retrieval trace, overlap evidence, or model metadata.")
TOKEN = r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*|[㐀-鿿]"
UNCERTAINTY = {"none": 0.0, "low": 0.25, "medium": 0.6, "high": 1.0}
#: Weights of the risk of a context. Fixed values.
RISK = {"overlap": 0.18, "heavy_overlap": 0.27, "uncertainty": 0.25, "changed": 0.18, "distance": 0.12}
#: Columns of a decision, all of which may be lacking; texts but for numbers. Lists are JSON or parts between commas.
COLUMNS = (
    "raw_text", "corrected_text", "text_error_before", "text_error_after", "overlap", "uncertainty_level", "difficulty", "notes", "context", "variant", "language", "source_experiment", "retrieved_candidates", "applied_corrections",
    "expected_terms", "true_positive_terms", "false_positive_terms", "missed_terms", "term_precision", "term_recall", "term_f1", "unsupported_change_count", "unsupported_changes", "forbidden_change_count",
    "forbidden_changes_detected", "invented_content", "speaker_attribution_changed", "needs_review", "correction_rejected", "api_used", "expected_safe_behavior", "safety_pass", "correction_error",
)


def leakage(feature: Column) -> tuple[Column, Column]:
    """A feature's or field's class and why."""
    kind, reason = F.lit(ALLOWED[0]), F.lit(ALLOWED[1])
    for name, (members, why) in CLASSES.items():
        kind, reason = F.when(feature.isin(*members), name).otherwise(kind), F.when(feature.isin(*members), why).otherwise(reason)
    for field, (name, why) in OTHER_FIELDS.items():
        kind, reason = F.when(feature == field, name).otherwise(kind), F.when(feature == field, why).otherwise(reason)
    return kind, reason


def audit_features(names: DataFrame) -> DataFrame:
    """names (feature) with category, which sets have it, excluded (from both strict sets) and rationale."""
    kind, reason = leakage(F.col("feature"))
    of = lambda which: F.col("feature").isin(*FEATURE_SETS[which])
    return names.select("feature", kind.alias("category"), *(of(which).alias(which) for which in FEATURE_SETS), (~of("evidence_only") & ~of("risk_only")).alias("excluded"), reason.alias("rationale"))


def count_list(value: Column) -> Column:
    """How many entries a list has: a JSON list, else parts between commas that aren't blank; 0 for null and blanks."""
    listed = F.from_json(value, "array<string>")
    parts = F.filter(F.split(value, ","), lambda x: F.trim(x) != "")
    return F.when(value.isNull() | (F.trim(value) == ""), 0).otherwise(F.coalesce(F.size(listed), F.when(F.try_parse_json(value).isNotNull(), F.lit(1)), F.size(parts)))


def _truth(value: Column) -> Column:
    """1, true, yes, y, or a number that isn't 0; false for null."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "y") | (value.try_cast("double") != 0), F.lit(False))


def with_columns(rows: DataFrame) -> DataFrame:
    """rows with all COLUMNS as texts, null where they lack one."""
    return rows.withColumns({name: F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string") for name in COLUMNS})


def features(rows: DataFrame) -> DataFrame:
    """Adds the 36 features of AUDIT_AWARE, as doubles, to rows with any of COLUMNS, one correction decision each."""
    c = F.col
    text = lambda name: F.coalesce(c(name), F.lit(""))
    low = lambda name: F.lower(text(name))
    number = lambda name, default=0.0: F.coalesce(F.nanvl(c(name).try_cast("double"), F.lit(None).cast("double")), F.lit(default) if isinstance(default, float) else default)
    flag = lambda condition: condition.cast("int").cast("double")
    rows = with_columns(rows)
    cut = lambda name: F.regexp_extract_all(low(name), F.lit(f"({TOKEN})"), 1)
    rows = rows.withColumns({"raw_tokens": cut("raw_text"), "new_tokens": cut("corrected_text")})
    # Both in one step, so that a task has one Python worker for them.
    rows = rows.withColumns({"edited": alignment.edits(c("raw_tokens"), c("new_tokens"), leave_out_common=True), "letters": alignment.distance(text("raw_text"), text("corrected_text"))})
    changed = F.aggregate("edited", F.lit(0), lambda n, e: n + F.greatest(e["a_end"] - e["a_start"], e["b_end"] - e["b_start"]))
    uncertainty = number("uncertainty_level")
    for level, value in UNCERTAINTY.items():
        uncertainty = F.when(F.lower(F.trim("uncertainty_level")) == level, value).otherwise(uncertainty)
    distance = c("letters") / F.greatest(F.length(text("raw_text")), F.length(text("corrected_text")), F.lit(1))
    rows = rows.withColumns({"changed": changed, "uncertainty": uncertainty, "distance": distance, "overlapping": _truth(c("overlap"))})
    ratio = c("changed") / F.greatest(F.size("raw_tokens"), F.size("new_tokens"), F.lit(1))
    heavy = c("overlapping") & ((c("uncertainty") >= 0.9) | F.contains(low("difficulty"), F.lit("heavy")) | F.contains(low("notes"), F.lit("heavy")))
    control = (
        (count_list(c("expected_terms")) == 0) | F.contains(low("expected_safe_behavior"), F.lit("negative control")) | F.contains(low("notes"), F.lit("negative control")) | F.contains(low("context"), F.lit("physical rack"))
        | F.contains(low("expected_safe_behavior"), F.lit("normal word"))
    )
    risk = F.least(F.lit(1.0), RISK["overlap"] * flag(c("overlapping")) + RISK["heavy_overlap"] * flag(heavy) + RISK["uncertainty"] * c("uncertainty") + RISK["changed"] * ratio + RISK["distance"] * c("distance"))
    counted = lambda count, listed: F.coalesce(F.nanvl(c(count).try_cast("double"), F.lit(None).cast("double")).cast("long").cast("double"), F.when(c(count).isNotNull() & (F.trim(count) != ""), 0.0), count_list(c(listed)).cast("double"))
    language = F.regexp_replace(F.lower(F.trim(F.coalesce(F.nullif(c("language"), F.lit("")), F.lit("unknown")))), "_", "-")
    is_a = lambda *codes, names: language.isin(*codes) | sum((F.startswith(language, F.lit(f"{code}-")).cast("int") for code in codes), F.lit(0)).cast("boolean") | sum((F.contains(language, F.lit(name)).cast("int") for name in names), F.lit(0)).cast("boolean")
    en, fr, zh = is_a("en", names=("english",)), is_a("fr", names=("french",)), is_a("zh", "cmn", names=("chinese", "mandarin"))
    before = number("text_error_before")
    after = number("text_error_after", before)
    made = {
        "retrieval_candidate_count": count_list(c("retrieved_candidates")), "applied_correction_count": count_list(c("applied_corrections")), "num_changed_tokens": c("changed"), "changed_token_ratio": ratio, "edit_distance_ratio": c("distance"),
        "overlap_flag": flag(c("overlapping")), "heavy_overlap_flag": flag(heavy), "uncertainty_score": c("uncertainty"), "context_risk_score": risk, "api_used_flag": flag(_truth(c("api_used"))),
        "llm_variant_flag": flag(F.contains(low("variant"), F.lit("llm"))), "rule_variant_flag": flag(F.contains(low("variant"), F.lit("rule"))), "language_en_flag": flag(en), "language_fr_flag": flag(fr), "language_zh_flag": flag(zh),
        "language_other_flag": flag(~(en | fr | zh)), **{f"source_{name}_flag": flag(F.contains(low("source_experiment"), F.lit(name))) for name in ("term_rescue", "overlap_safety", "independent")},
        "expected_term_count": count_list(c("expected_terms")), "text_error_before": before, "negative_control_flag": flag(control), "needs_review_input_flag": flag(_truth(c("needs_review"))),
        "correction_rejected_input_flag": flag(_truth(c("correction_rejected"))), "true_positive_term_count": count_list(c("true_positive_terms")), "false_positive_term_count": count_list(c("false_positive_terms")),
        "missed_term_count": count_list(c("missed_terms")), "term_precision": number("term_precision"), "term_recall": number("term_recall"), "term_f1": number("term_f1"), "text_error_after": after, "error_delta": before - after,
        "unsupported_change_count": counted("unsupported_change_count", "unsupported_changes"), "forbidden_change_count": counted("forbidden_change_count", "forbidden_changes_detected"),
        "invented_content_flag": flag(_truth(c("invented_content"))), "speaker_attribution_changed_flag": flag(_truth(c("speaker_attribution_changed"))),
    }
    shadowed = {f"__{name}": value.cast("double") for name, value in made.items()}
    done = rows.withColumns(shadowed).drop("raw_tokens", "new_tokens", "edited", "letters", "changed", "uncertainty", "distance", "overlapping")
    return done.withColumns({name: c(f"__{name}") for name in made}).drop(*shadowed)


def labels(featured: DataFrame) -> DataFrame:
    """Adds label (accept, reject, needs_review), label_reason and ambiguous to rows with features()."""
    c = F.col
    error = F.trim(F.coalesce("correction_error", F.lit("")))
    failed = c("safety_pass").isNotNull() & ~_truth(c("safety_pass"))
    told = F.array_compact(F.array(
        F.when(c("correction_rejected_input_flag") > 0, "explicitly rejected"), F.when(c("invented_content_flag") > 0, "invented content"), F.when(c("speaker_attribution_changed_flag") > 0, "speaker attribution changed"),
        F.when(c("forbidden_change_count") > 0, "forbidden change"), F.when(c("unsupported_change_count") > 0, "unsupported change"), F.when(error != "", "strict correction validation failed"), F.when(failed, "safety policy failed"),
    ))
    same = F.trim(F.coalesce("raw_text", F.lit(""))) == F.trim(F.coalesce("corrected_text", F.lit("")))
    open_target = same & (c("expected_term_count") > 0) & (c("missed_term_count") > 0)
    outcome = lambda label, reason, ambiguous=False: F.struct(F.lit(label).alias("label"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(ambiguous).alias("ambiguous"))
    rule = (
        F.when(F.size("told") > 0, outcome("reject", F.array_join("told", "; "))).when(c("needs_review_input_flag") > 0, outcome("needs_review", "source audit requested human review"))
        .when(open_target, outcome("needs_review", "supported target remains unresolved", True)).when(c("error_delta") < -1e-9, outcome("reject", "correction increased reference text error"))
        .when(same & (c("negative_control_flag") > 0), outcome("accept", "negative-control text safely preserved")).otherwise(outcome("accept", "supported correction or safe preservation"))
    )
    ruled = featured.withColumn("told", told).withColumn("rule", rule)
    return ruled.withColumns({"label": c("rule.label"), "label_reason": c("rule.reason"), "ambiguous": c("rule.ambiguous")}).drop("told", "rule")


def policy_baseline() -> Column:
    """Rejects what the audit found, reviews what it doubts: it knows outcomes."""
    c = F.col
    unsafe = F.lit(False)
    for name in ("correction_rejected_input_flag", *AUDIT_OUTCOMES):
        unsafe = unsafe | (c(name) > 0)
    return F.when(unsafe, "reject").when((c("needs_review_input_flag") > 0) | (c("heavy_overlap_flag") > 0), "needs_review").otherwise("accept")


def predecision_baseline() -> Column:
    """Only what is known before: large edits without candidates are rejected, doubtful or overlapping ones reviewed."""
    c = F.col
    overlap = c("overlap_flag") > 0
    large = (c("changed_token_ratio") >= 0.75) & (c("retrieval_candidate_count") == 0) & ~overlap
    doubt = (c("heavy_overlap_flag") > 0) | (c("uncertainty_score") >= 0.9) | (overlap & ((c("changed_token_ratio") >= 0.25) | (c("edit_distance_ratio") >= 0.20)))
    return F.when(large, "reject").when(doubt, "needs_review").otherwise("accept")


def llm_baseline() -> Column:
    """What a language model said itself; all others are accepted."""
    c = F.col
    return F.when(c("llm_variant_flag") <= 0, "accept").when(c("correction_rejected_input_flag") > 0, "reject").when(c("needs_review_input_flag") > 0, "needs_review").otherwise("accept")
