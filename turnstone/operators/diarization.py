"""Scores of clips' predicted turns, by mode: labels, coverage, boundaries, events, and standard errors with collar and without overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators import intervals, matching, meetings
from turnstone.operators.anchors import OVERLAP, UNKNOWN
from turnstone.scratch import written

#: Milliseconds around a reference boundary that standard errors leave out.
COLLAR_MS = 250


def standard_errors(reference: DataFrame, predicted: DataFrame, collar_ms: int = COLLAR_MS, skip_overlap: bool = False) -> DataFrame:
    """clip_id, der and jer outside the collar and, if overlaps are skipped, where at most one reference speaker talks.

    Labels are mapped on what is left; a clip whose reference is cut away has null.
    """
    cuts = intervals.boundary_cuts(reference, collar_ms)
    if skip_overlap:
        cuts = cuts.unionByName(intervals.overlap_regions(reference).select("clip_id", "start_ms", "end_ms"))
    cuts = written(cuts, "cuts")
    ref, pred = (written(intervals.without(rows, cuts), "left-turns") for rows in (reference, predicted))
    mapping = written(matching.map_speakers(intervals.speaker_overlap_matrix(ref, pred)), "left-mapping")
    errors = matching.mapped_error(ref, pred, mapping).where("ref_ms > 0").select("clip_id", F.col("error").alias("der"))
    return reference.select("clip_id").distinct().join(errors, "clip_id", "left").join(matching.jaccard_error(ref, pred, mapping), "clip_id", "left")


def label_error_rate(reference: DataFrame, predicted: DataFrame, mapping: DataFrame) -> DataFrame:
    """clip_id and label_error: the share of reference speakers' time in which the mapped prediction lacks them; 0 without any.

    UNKNOWN and OVERLAP are nobody, on both sides.
    """
    known = lambda rows: rows.where(~F.col("speaker").isin(UNKNOWN, OVERLAP))
    own = known(reference)
    total = intervals.interval_union(own, "clip_id", "speaker").groupBy("clip_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"))
    said = known(predicted).join(mapping.select("clip_id", F.col("pred_speaker").alias("speaker"), "mapped_to"), ["clip_id", "speaker"]).select("clip_id", F.col("mapped_to").alias("speaker"), "start_ms", "end_ms")
    other = intervals.interval_union(said, "clip_id", "speaker").select(F.col("clip_id").alias("p_clip"), F.col("speaker").alias("p_speaker"), F.col("start_ms").alias("ps"), F.col("end_ms").alias("pe"))
    met = intervals.meeting(intervals.interval_union(own, "clip_id", "speaker"), other, ("start_ms", "end_ms"), ("ps", "pe"), "p_clip").where("speaker = p_speaker")
    right = met.groupBy("clip_id").agg(F.sum(F.least("end_ms", "pe") - F.greatest("start_ms", "ps")).alias("right"))
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("right", F.lit(0)) / F.col("total")))
    clips = reference.select("clip_id").distinct().join(total, "clip_id", "left").join(right, "clip_id", "left")
    return clips.select("clip_id", F.when(F.col("total") > 0, F.round(rate, 6)).otherwise(0.0).alias("label_error"))


def events_of(turns: DataFrame) -> DataFrame:
    """Overlaps and interruptions by rule, numbered: clip_id, id, type, start_ms, end_ms, speakers."""
    found = intervals.overlap_events(turns).unionByName(intervals.interruption_events(turns))
    return found.withColumn("id", F.row_number().over(Window.partitionBy("clip_id").orderBy("start_ms", "end_ms", "type", F.array_join("speakers", "+")))).select("clip_id", "id", "type", "start_ms", "end_ms", "speakers")


def score_turns(reference: DataFrame, reference_events: DataFrame, predicted: DataFrame, predicted_events: DataFrame | None = None, standard: bool = False) -> DataFrame:
    """A row for each clip of reference (clip_id, id, speaker, start_ms, end_ms), with all scores of its predicted turns.

    Predicted events come from the turns by rule unless they are given. Event scores are null where the reference has no such
    events, boundary errors where nothing matches. standard adds der and jer, with overlaps and without. What several scores
    read is worked out once and written; the tables that are given are read many times, so they should be written as well.
    """
    found = written(events_of(predicted), "found-events") if predicted_events is None else predicted_events
    mapping = written(matching.map_speakers(intervals.speaker_overlap_matrix(*(rows.where(~F.col("speaker").isin(UNKNOWN, OVERLAP)) for rows in (reference, predicted)))), "mapping")
    counted = lambda rows, name: rows.groupBy("clip_id").agg(F.count("*").alias(name))
    out = counted(reference, "n_ref_turns").join(counted(predicted, "n_pred_turns"), "clip_id", "left")
    out = out.join(label_error_rate(reference, predicted, mapping), "clip_id", "left").join(intervals.coverage(reference, predicted).select("clip_id", "coverage"), "clip_id", "left")
    out = out.join(matching.boundary_error(reference, predicted, mapping).select("clip_id", "boundary_mae_ms"), "clip_id", "left")
    for kind, score in (("overlap", matching.event_scores), ("interruption", matching.interruption_scores)):
        ref, pred = (rows.where(F.col("type") == kind) for rows in (reference_events, found))
        scored = score(ref, pred).where("n_ref > 0").select("clip_id", *(F.col(name).alias(f"{kind}_{name}") for name in ("precision", "recall", "f1")))
        out = out.join(counted(ref, f"n_ref_{kind}s"), "clip_id", "left").join(counted(pred, f"n_pred_{kind}s"), "clip_id", "left").join(scored, "clip_id", "left")
    if standard:
        for skip, suffix in ((False, ""), (True, "_skip_overlap")):
            errors = standard_errors(reference, predicted, skip_overlap=skip)
            out = out.join(errors.select("clip_id", F.col("der").alias(f"der{suffix}"), F.col("jer").alias(f"jer{suffix}")), "clip_id", "left")
    return out.na.fill(0, [name for name in out.columns if name.startswith("n_")])


def baselines(reference: DataFrame, reference_events: DataFrame) -> DataFrame:
    """score_turns of two modes: no_diarization, one turn of nobody over the clip and no events; reference_assisted, the reference's own turns with events by rule."""
    alone = meetings.no_diarization(reference).select("clip_id", F.lit(1).alias("id"), "speaker", "start_ms", "end_ms")
    none = score_turns(reference, reference_events, alone, reference_events.where(F.lit(False))).withColumn("mode", F.lit("no_diarization"))
    return none.unionByName(score_turns(reference, reference_events, reference).withColumn("mode", F.lit("reference_assisted")))
