"""Audits: what probably went wrong in a transcript, and whether a correction goes beyond its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import alignment
from turnstone.operators.edit_errors import DISFLUENCIES

#: Terms of the field, words that begin sentences, number words, words whose loss doesn't matter, and patterns. Fixed values.
DOMAIN_TERMS = ("pyannote.audio", "pyannote", "speaker diarization", "diarization", "overlapping speech", "cross-speech", "ASR", "WER", "DER", "WDER", "RAG", "faster-whisper", "VAD", "LLM correction", "temporal anchor")
SENTENCE_STARTS = "a an and but de for i il in it maintenant okay right so the then this um we".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten twenty thirty forty fifty hundred thousand million billion".split()
STOP_WORDS = "a an and are as at be for in is it of on or that the this to we with".split()
ACRONYM = r"(?U)\b[A-Z]{2,}(?:[./-][A-Z0-9]+)*\b"
_NAME = "(?:[A-ZÀ-ÖØ-Þ][a-zÀ-ÖØ-öø-ÿ'’-]+|[A-Z]{2,})"
ENTITY = rf"(?U)\b{_NAME}(?:\s+{_NAME})*\b"
NUMBER = r"(?U)\b\d+(?:[.,]\d+)?\b"
HAN = r"[一-鿿]"
TOKEN = r"[A-Za-z0-9一-鿿]+(?:[.-][A-Za-z0-9]+)*"
#: How many missing tokens are told, and limits of the omission rule. Fixed values.
MISSING, SHORT_RATIO, HIGH_ERROR = 20, 0.72, 0.2


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def _listed(words) -> Column:
    return F.array(*map(F.lit, words))


def holds_phrase(text: Column, normal: Column, phrase: Column, mandarin: Column) -> Column:
    """Whether a text (and its normal form) has the phrase: as it stands in Mandarin, else in normal form between other signs than a-z and 0-9."""
    target = T.wer_normal(phrase, compose=False)
    bounded = F.when(target == "", False).otherwise(F.rlike(normal, F.concat(F.lit(r"(?<![a-z0-9])\Q"), target, F.lit(r"\E(?![a-z0-9])"))))
    return F.when(phrase == "", False).when(mandarin | phrase.rlike(HAN), F.contains(text, phrase)).otherwise(bounded)


def named_entities(text: Column) -> Column:
    """Different runs of capitalised words, without fillers, words that begin sentences and what has two letters."""
    runs = F.transform(_found(text, ENTITY), lambda m: F.regexp_replace(m, r"(?U)\s+", " "))
    one = lambda m: ~F.contains(m, F.lit(" "))
    filler = lambda m: T.wer_normal(m, compose=False).isin(*DISFLUENCIES)
    return F.array_distinct(F.filter(runs, lambda m: ~filler(m) & ~(one(m) & (F.lower(m).isin(*SENTENCE_STARTS) | (F.length(m) <= 2)))))


def numbers(normal: Column) -> Column:
    """Different numbers of a normal text: those of digits first, then words."""
    words = F.filter(F.split(normal, " "), lambda w: w.isin(*NUMBER_WORDS))
    return F.array_distinct(F.concat(_found(normal, NUMBER), words))


def audit_transcripts(rows: DataFrame, terms=DOMAIN_TERMS) -> DataFrame:
    """Adds error_types, candidates (terms, acronyms and names that the hypothesis lacks), missing (tokens), term_candidate and notes
    to rows with reference_text, hypothesis_text, language, dataset_name, error_rate and cleaned_error_rate (null where unknown)."""
    c = F.col
    texts = {name: F.coalesce(F.col(name), F.lit("")) for name in ("reference_text", "hypothesis_text", "language", "dataset_name")}
    rows = rows.withColumns(texts | {"error_rate": F.coalesce(c("error_rate").try_cast("double"), F.lit(0.0)), "cleaned_error_rate": c("cleaned_error_rate").try_cast("double")})
    rows = rows.withColumns({"ref": T.wer_normal(c("reference_text")), "hyp": T.wer_normal(c("hypothesis_text")), "mandarin": T.is_mandarin(c("language"))})
    cut = lambda name: F.filter(F.split(name, " "), lambda w: w != "")
    rows = rows.withColumns({"ref_tokens": cut("ref"), "hyp_tokens": cut("hyp")})
    lacks = lambda found: F.filter(found, lambda p: ~holds_phrase(c("hypothesis_text"), c("hyp"), p, c("mandarin")))
    known = F.filter(_listed(terms), lambda p: holds_phrase(c("reference_text"), c("ref"), p, c("mandarin")))
    rows = rows.withColumns({
        "lost_terms": lacks(known), "lost_acronyms": lacks(F.array_distinct(_found(c("reference_text"), ACRONYM))), "lost_names": lacks(named_entities(c("reference_text"))),
        "same_numbers": numbers(c("ref")) == numbers(c("hyp")),
    })
    han = lambda name: _found(c(name), HAN)
    gone = F.filter("ref_tokens", lambda w: ~F.array_contains(c("hyp_tokens"), w) & ~w.isin(*STOP_WORDS) & (F.length(w) > 2))
    missing = F.when(c("mandarin"), F.filter(han("reference_text"), lambda w: ~F.contains(c("hypothesis_text"), w))).otherwise(gone)
    ratio = F.when(c("mandarin"), F.size(han("hypothesis_text")) / F.greatest(F.size(han("reference_text")), F.lit(1))).otherwise(F.size("hyp_tokens") / F.greatest(F.size("ref_tokens"), F.lit(1)))
    rows = rows.withColumns({"missing": F.slice(F.array_distinct(missing), 1, MISSING), "ratio": ratio})
    short, high = c("ratio") < SHORT_RATIO, c("error_rate") >= HIGH_ERROR
    meeting = F.contains(F.lower("dataset_name"), F.lit("ami")) | F.arrays_overlap("ref_tokens", _listed(DISFLUENCIES))
    types = F.array_compact(F.array(
        F.when(F.size("lost_terms") > 0, "professional_term_or_glossary"), F.when(F.size("lost_acronyms") > 0, "acronym_or_short_code"), F.when(F.size("lost_names") > 0, "proper_noun_or_named_entity"),
        F.when(~c("same_numbers"), "number_or_quantity"), F.when(c("mandarin") & high, "mandarin_low_frequency_or_script"), F.when(meeting, "meeting_disfluency_or_truncation"), F.when(short & high, "truncation_or_omission"),
    ))
    notes = F.array_compact(F.array(
        F.when(short & high, F.concat(F.lit("hypothesis/reference length ratio="), T.two_places(c("ratio")))),
        F.when((c("cleaned_error_rate") >= 0) & (c("cleaned_error_rate") < c("error_rate")), "cleaned meeting metric is lower after disfluency removal"),
    ))
    candidates = F.array_distinct(F.concat("lost_terms", "lost_acronyms", "lost_names"))
    done = rows.withColumns({"error_types": F.when(F.size(types) == 0, F.array(F.lit("general_asr_error"))).otherwise(types), "candidates": candidates, "term_candidate": F.size(candidates) > 0, "notes": F.array_join(notes, "; ")})
    return done.drop("ref", "hyp", "mandarin", "ref_tokens", "hyp_tokens", "lost_terms", "lost_acronyms", "lost_names", "same_numbers", "ratio")


def worst_transcripts(rows: DataFrame, least_error: float = 0.0, top: int | None = None) -> DataFrame:
    """The rows of at least that error rate, the largest errors (then clip_id, model_name) first, so many if top is given. KeyError for a table without its columns."""
    lacking = sorted({"clip_id", "reference_text", "hypothesis_text", "error_rate"} - set(rows.columns))
    if lacking:
        raise KeyError(f"the transcripts lack {', '.join(lacking)}")
    rate = F.coalesce(F.col("error_rate").try_cast("double"), F.lit(0.0))
    order = [rate.desc(), F.col("clip_id").desc(), *([F.col("model_name").desc()] if "model_name" in rows.columns else [])]
    chosen = rows.where(rate >= least_error).orderBy(*order)
    return chosen.limit(top) if top is not None else chosen


def audit_corrections(rows: DataFrame) -> DataFrame:
    """Adds changed_tokens, supported, unsupported (inserted tokens, sorted), risk (low, medium, high) and needs_review to rows with
    raw_text, corrected_text, neighbours (text), evidence (array of texts: canonical names and forms of candidates) and overlap."""
    c = F.col
    cut = lambda text: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), 1), F.lower)
    rows = rows.withColumns({"raw": cut(c("raw_text")), "new": cut(c("corrected_text")), "known": F.concat(cut(c("raw_text")), cut(c("neighbours")), F.flatten(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), cut)))})
    rows = rows.withColumn("edited", alignment.edits(c("raw"), c("new"), leave_out_common=True))
    rows = rows.withColumns({"inserted": alignment.removed_and_added(c("raw"), c("new"), c("edited"))[1], "edit_ratio": 1.0 - alignment.similarity(c("raw"), c("new"), c("edited"))})
    said = lambda tokens: F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise("∅")
    changed = F.transform("edited", lambda e: F.concat(e["op"], F.lit(": "), said(alignment.span(c("raw"), e["a_start"], e["a_end"])), F.lit(" -> "), said(alignment.span(c("new"), e["b_start"], e["b_end"]))))
    rows = rows.withColumns({"changed_tokens": changed, "supported": F.array_sort(F.array_intersect("inserted", "known")), "unsupported": F.array_sort(F.array_except("inserted", "known"))})
    much_longer = (F.size("new") / F.greatest(F.size("raw"), F.lit(1)) > 1.5) & (F.size("new") > F.size("raw") + 2)
    overlapping = F.coalesce("overlap", F.lit(False)) & (c("edit_ratio") > 0.35)
    rows = rows.withColumn("risk", F.when((F.size("unsupported") > 0) | much_longer, "high").when(overlapping | (c("edit_ratio") > 0.4), "medium").otherwise("low"))
    return rows.withColumn("needs_review", (F.size("unsupported") > 0) | overlapping | much_longer).drop("raw", "new", "known", "edited", "inserted", "edit_ratio")
