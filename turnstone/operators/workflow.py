"""The seven variants of a meeting's workflow, each adding to the one before, over many clips at once.

asr_only: one span a clip. temporal_anchor_only: words grouped by time. reference_speaker_time: with speakers, one at a
time. overlap_aware: with overlaps and interruptions. term_rescue: with retrieved terms. constrained_correction: with
rule corrections for those terms. full: the same anchors, from which cards and summaries are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import anchors, intervals, meetings, terms
from turnstone.scratch import written

VARIANTS = ("asr_only", "temporal_anchor_only", "reference_speaker_time", "overlap_aware", "term_rescue", "constrained_correction", "full")
#: Terms of an anchor at most.
TERMS = 5
_COLUMNS = ("clip_id", "anchor", "speaker", "speakers", "start_ms", "end_ms", "text", "overlap", "interruption", "needs_review", "confidence")


def _plain(rows: DataFrame) -> DataFrame:
    """Anchors that no event was looked for."""
    no = F.lit(False)
    return rows.withColumn("overlap", no).withColumn("interruption", no).withColumn("needs_review", F.col("speaker") == anchors.UNKNOWN).select(*_COLUMNS)


def asr_only(words: DataFrame) -> DataFrame:
    """All of a clip's words as one span of nobody, which needs no review as nothing is claimed."""
    listed = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "idx", "pos", "word")))
    rows = words.groupBy("clip_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(listed, lambda x: x["word"]), " ").alias("text"))
    rows = rows.withColumn("anchor", F.lit(1).cast("long")).withColumn("speaker", F.lit(anchors.UNKNOWN)).withColumn("speakers", F.array().cast("array<string>")).withColumn("confidence", F.lit(0.0).cast("double"))
    return _plain(rows).withColumn("needs_review", F.lit(False))


def by_time(words: DataFrame) -> DataFrame:
    nobody = words.withColumn("speakers", F.array().cast("array<string>")).withColumn("speaker", F.lit(anchors.UNKNOWN)).withColumn("confidence", anchors.confidence(F.lit(anchors.UNKNOWN)))
    return _plain(anchors.sessionize(nobody))


def by_speaker(grouped: DataFrame) -> DataFrame:
    """Anchors of words with speakers (see anchors.sessionize), one speaker at a time."""
    return meetings.single_speaker_view(_plain(grouped)).select(*_COLUMNS)


def with_events(grouped: DataFrame, turns: DataFrame) -> DataFrame:
    """The same anchors with the overlaps and interruptions of the turns."""
    events = intervals.overlap_events(turns).unionByName(intervals.interruption_events(turns))
    found = anchors.temporal_anchors(grouped.drop("n_words", "text"), events)
    return found.join(grouped.select("clip_id", "anchor", "text"), ["clip_id", "anchor"]).select(*_COLUMNS)


def with_terms(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """rows with terms: the TERMS best matches (id, canonical, score) of each anchor, ties by name."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.lower("canonical"))
    best = matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TERMS)
    listed = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical"))), lambda x: x["canonical"]).alias("terms"))
    return rows.withColumn("id", anchor_id()).join(listed, "id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).drop("id")


def anchor_id():
    return F.format_string("%s_anchor_%03d", F.col("clip_id").cast("string"), F.col("anchor").cast("int"))


def exact_terms(glossary: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A way to find terms: forms (form, canonical) that stand in the text word by word, with score 1."""

    def find(texts: DataFrame) -> DataFrame:
        return terms.phrase_matches(texts, glossary).select("id", "canonical", F.lit(1.0).alias("score")).distinct()

    return find


def _grouped(words: DataFrame, turns: DataFrame) -> DataFrame:
    return anchors.sessionize(anchors.align_words(words, turns))


def _rescued(rows: DataFrame, find_terms: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return with_terms(rows, find_terms(rows.select(anchor_id().alias("id"), T.tokens(F.col("text")).alias("tokens"))))


def _finished(rows: DataFrame, name: str) -> DataFrame:
    """rows of a variant with terms, if they have none yet, and corrected."""
    rows = rows if "terms" in rows.columns else rows.withColumn("terms", F.array().cast("array<string>"))
    corrects = VARIANTS.index(name) >= VARIANTS.index("constrained_correction")
    corrected = terms.rule_correction(F.col("text"), F.col("terms")) if corrects else F.col("text")
    return rows.withColumn("corrected", corrected).withColumn("variant", F.lit(name))


def variant(name: str, words: DataFrame, turns: DataFrame, find_terms: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The anchors of one variant, with terms and corrected. words: clip_id, idx, pos, word, start_ms, end_ms; find_terms
    takes texts (id, tokens) and gives matches (id, canonical, score). ValueError for a name that isn't one of VARIANTS."""
    if name not in VARIANTS:
        raise ValueError(f"no such variant: {name}")
    if name == "asr_only":
        rows = asr_only(words)
    elif name == "temporal_anchor_only":
        rows = by_time(words)
    elif name == "reference_speaker_time":
        rows = by_speaker(_grouped(words, turns))
    else:
        rows = with_events(_grouped(words, turns), turns)
    if VARIANTS.index(name) >= VARIANTS.index("term_rescue"):
        rows = _rescued(rows, find_terms)
    return _finished(rows, name)


def variants(words: DataFrame, turns: DataFrame, find_terms: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The anchors of all variants (see variant). What several share, anchors of speakers, with events and with terms, is worked out once and written."""
    grouped = written(_grouped(words, turns), "workflow-anchors")
    aware = written(with_events(grouped, turns), "workflow-events")
    rescued = written(_rescued(aware, find_terms), "workflow-terms")
    rows = dict.fromkeys(VARIANTS, rescued) | {"asr_only": asr_only(words), "temporal_anchor_only": by_time(words), "reference_speaker_time": by_speaker(grouped), "overlap_aware": aware}
    both = None
    for name in VARIANTS:
        done = _finished(rows[name], name)
        both = done if both is None else both.unionByName(done)
    return both


def counters(rows: DataFrame) -> DataFrame:
    """By variant and clip: anchors, those with a known speaker, overlaps, interruptions, reviews, terms, changed texts, span."""
    known = ~F.col("speaker").isin(anchors.UNKNOWN, anchors.OVERLAP)
    return rows.groupBy("variant", "clip_id").agg(
        F.count("*").alias("n"), F.count_if(known).alias("n_known"), F.count_if("overlap").alias("n_overlap"), F.count_if("interruption").alias("n_interruption"), F.count_if("needs_review").alias("n_review"),
        F.sum(F.size("terms")).cast("long").alias("n_terms"), F.count_if(F.col("text") != F.col("corrected")).alias("n_corrected"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
    )
