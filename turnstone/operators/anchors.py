"""Words to speakers, words to anchors, anchors to cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators import intervals

UNKNOWN, OVERLAP = "UNKNOWN", "OVERLAP"


def confidence(label: Column) -> Column:
    return F.when(label == OVERLAP, 0.55).when(label == UNKNOWN, 0.5).otherwise(0.9)


def confidence_label(value: Column) -> Column:
    return F.when(value >= 0.8, "high").when(value >= 0.6, "review").otherwise("uncertain")


def align_words(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Different words with the turns that hold their midpoint: speakers (sorted), speaker (one, UNKNOWN or OVERLAP), confidence."""
    t = turns.select("clip_id", F.struct("speaker", "start_ms", "end_ms").alias("turn"), F.explode(intervals.buckets("start_ms", "end_ms")).alias("bucket"))
    # A clip's turns by time bucket, on clip_id alone: words that are dealt by clip meet them where they are, once each.
    listed = t.groupBy("clip_id", "bucket").agg(F.collect_list("turn").alias("near")).groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "near"))).alias("turns"))
    middle = F.col("start_ms") + F.col("end_ms")
    near = F.try_element_at("turns", F.expr(f"(start_ms + end_ms) div 2 div {intervals.BUCKET_MS}"))
    speakers = F.transform(F.filter(near, lambda x: (x["start_ms"] * 2 <= middle) & (middle < x["end_ms"] * 2) & x["speaker"].isNotNull()), lambda x: x["speaker"])
    held = words.join(listed, "clip_id", "left").select("clip_id", "idx", "pos", "word", "start_ms", "end_ms", F.coalesce(F.array_sort(F.array_distinct(speakers)), F.array().cast("array<string>")).alias("speakers"))
    label = F.when(F.size("speakers") == 0, UNKNOWN).when(F.size("speakers") == 1, F.col("speakers")[0]).otherwise(OVERLAP)
    return held.withColumn("speaker", label).withColumn("confidence", confidence(F.col("speaker")))


def sessionize(aligned: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """Neighbouring words of the same speakers, at most gap_ms apart, as anchors.

    clip_id, anchor, speaker, speakers, start_ms, end_ms, n_words, text, confidence (the least).
    """
    w = Window.partitionBy("clip_id").orderBy("start_ms", "end_ms", "idx", "pos")
    same = (F.lag("speaker").over(w) == F.col("speaker")) & (F.lag("speakers").over(w) == F.col("speakers")) & (F.col("start_ms") - F.lag("end_ms").over(w) <= gap_ms)
    marked = aligned.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("anchor", F.sum("new").over(w))
    words = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "idx", "pos", "word")))
    return marked.groupBy("clip_id", "anchor").agg(
        F.first("speaker").alias("speaker"), F.first("speakers").alias("speakers"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"),
        F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("text"), F.min("confidence").alias("confidence"),
    )


def temporal_anchors(anchors: DataFrame, events: DataFrame) -> DataFrame:
    """Anchors with the overlap and interruption events that they meet.

    overlap: the words overlap or an overlap event is met; speakers: those of both; confidence at most 0.55 with overlap;
    needs_review: overlap or no known speaker.
    """
    e = events.select(F.col("clip_id").alias("e_clip"), "type", F.col("start_ms").alias("e_start"), F.col("end_ms").alias("e_end"), F.col("speakers").alias("e_speakers"))
    met = intervals.meeting(anchors, e, ("start_ms", "end_ms"), ("e_start", "e_end"), "e_clip", "left")
    keys = ["clip_id", "anchor", "speaker", "speakers", "start_ms", "end_ms", "confidence"]
    found = met.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("type") == "overlap"), F.lit(False)).alias("meets"), F.coalesce(F.bool_or(F.col("type") == "interruption"), F.lit(False)).alias("interruption"),
        F.flatten(F.collect_list(F.when(F.col("type") == "overlap", F.col("e_speakers")))).alias("others"),
    )
    found = found.withColumn("overlap", F.col("meets") | (F.col("speaker") == OVERLAP)).withColumn("all", F.array_sort(F.array_union("speakers", "others")))
    speaker = F.when(F.size("all") > 1, OVERLAP).otherwise(F.col("speaker"))
    return found.select(
        "clip_id", "anchor", speaker.alias("speaker"), F.col("all").alias("speakers"), "start_ms", "end_ms", "overlap", "interruption",
        F.when(F.col("overlap"), F.least("confidence", F.lit(0.55))).otherwise(F.col("confidence")).alias("confidence"), (F.col("overlap") | (speaker == UNKNOWN)).alias("needs_review"),
    )


def speaker_cards(turns: DataFrame) -> DataFrame:
    """clip_id, speaker, speaking_ms, n_turns, first_ms, longest_ms."""
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    return turns.groupBy("clip_id", "speaker").agg(F.sum(length).alias("speaking_ms"), F.count("*").alias("n_turns"), F.min("start_ms").alias("first_ms"), F.max(length).alias("longest_ms"))


def top_terms(terms: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent terms (clip_id, speaker, term, at) of each speaker; equal counts go to the one seen first."""
    counts = terms.groupBy("clip_id", "speaker", "term").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    w = Window.partitionBy("clip_id", "speaker").orderBy(F.desc("n"), "first_at")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("clip_id", "speaker", "rank", "term", "n")
