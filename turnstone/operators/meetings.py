"""Joins, choices and views of meetings: anchors with segments, turns and events; windows, lanes and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators import intervals


def _first(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")


def first_segment(anchors: DataFrame, segments: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Each anchor (clip_id, id, start_ms, end_ms) with its first intersecting segment, by segment id; null where there is none."""
    met = intervals.bucketed_pairs(anchors, segments, bucket_ms)
    found = met.groupBy("clip_id", F.col("id1").alias("id")).agg(F.min("id2").alias("segment"))
    return anchors.select("clip_id", "id").join(found, ["clip_id", "id"], "left")


def least_turn_confidence(anchors: DataFrame, turns: DataFrame) -> DataFrame:
    """Each anchor (clip_id, id, speakers) with the least confidence of its speakers' turns (clip_id, speaker, confidence), to thousandths.

    A turn without a confidence has 0.9; an anchor without turns of its speakers has 0.5.
    """
    by_speaker = turns.groupBy("clip_id", "speaker").agg(F.min(F.coalesce("confidence", F.lit(0.9))).alias("least"))
    own = anchors.select("clip_id", "id", F.explode_outer("speakers").alias("speaker")).join(by_speaker, ["clip_id", "speaker"], "left")
    return own.groupBy("clip_id", "id").agg(F.coalesce(F.round(F.min("least"), 3), F.lit(0.5)).alias("confidence"))


def anchor_probability(anchors: DataFrame, segments: DataFrame, words: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """What the transcript thinks of each anchor (clip_id, id, start_ms, end_ms), to thousandths.

    An anchor's segment is the first (by id) that it meets. The mean probability of that segment's words (segment, start_ms,
    end_ms, probability) in the anchor; without any, 1 + the segment's avg_logprob within 0 and 1; else 0.75.
    """
    source = first_segment(anchors, segments, bucket_ms).select("clip_id", "id", "segment")
    known = words.where("probability is not null and start_ms is not null and end_ms is not null")
    numbered = known.withColumn("id", F.xxhash64("clip_id", "segment", "start_ms", "end_ms", "probability"))
    met = intervals.bucketed_pairs(anchors, numbered, bucket_ms).select("clip_id", F.col("id1").alias("id"), "id2").distinct()
    own = met.join(source, ["clip_id", "id"]).join(numbered.select("clip_id", "segment", F.col("id").alias("id2"), "probability"), ["clip_id", "segment", "id2"])
    mean = own.groupBy("clip_id", "id").agg(F.avg("probability").alias("mean"))
    log_p = segments.select("clip_id", F.col("id").alias("segment"), "avg_logprob")
    fallback = F.least(F.greatest(1 + F.col("avg_logprob"), F.lit(0.0)), F.lit(1.0))
    joined = source.join(log_p, ["clip_id", "segment"], "left").join(mean, ["clip_id", "id"], "left")
    return joined.select("clip_id", "id", F.coalesce(F.round("mean", 3), F.round(fallback, 3), F.lit(0.75)).alias("probability"))


def events_with_anchors(events: DataFrame, anchors: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Events (clip_id, id, start_ms, end_ms, anchor_ids) with their anchors: those named, else those that they intersect."""
    named = events.select("clip_id", "id", F.explode("anchor_ids").alias("anchor")).join(anchors.select("clip_id", F.col("id").alias("anchor")), ["clip_id", "anchor"], "left_semi")
    unnamed = events.join(named.select("clip_id", "id").distinct(), ["clip_id", "id"], "left_anti")
    met = intervals.bucketed_pairs(unnamed, anchors, bucket_ms).select("clip_id", F.col("id1").alias("id"), F.col("id2").alias("anchor"))
    both = named.select("clip_id", "id", "anchor").unionByName(met).groupBy("clip_id", "id").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"))
    return events.select("clip_id", "id").join(both, ["clip_id", "id"], "left").select("clip_id", "id", F.coalesce("anchors", F.array().cast("array<int>")).alias("anchors"))


def words_in_windows(words: DataFrame, windows: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Words clipped to the windows that they meet: clip_id, window, id, start_ms, end_ms."""
    met = intervals.bucketed_pairs(windows, words, bucket_ms)
    met = met.join(windows.select("clip_id", F.col("id").alias("id1"), F.col("start_ms").alias("ws"), F.col("end_ms").alias("we")), ["clip_id", "id1"])
    met = met.join(words.select("clip_id", F.col("id").alias("id2"), "start_ms", "end_ms"), ["clip_id", "id2"])
    return met.select("clip_id", F.col("id1").alias("window"), F.col("id2").alias("id"), F.greatest("start_ms", "ws").alias("start_ms"), F.least("end_ms", "we").alias("end_ms"))


def padded_window(start: Column, end: Column, pad: int, length: Column) -> tuple[Column, Column]:
    """A stretch with pad on both sides, within 0 and length."""
    low = F.greatest(F.lit(0), start - pad)
    return low, F.greatest(low, F.least(end + pad, length))


def variants(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Each row once for each variant."""
    return rows.withColumn("variant", F.explode(F.array(*map(F.lit, names))))


def timeline(turns: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Turns in their speakers' lanes, overlaps in one of their own: clip_id, lane, start_ms, end_ms."""
    own = turns.select("clip_id", F.col("speaker").alias("lane"), "start_ms", "end_ms")
    return own.unionByName(overlaps.select("clip_id", F.lit("OVERLAP").alias("lane"), "start_ms", "end_ms"))


def anchor_lanes(anchors: DataFrame) -> DataFrame:
    """Anchors once for each of their speakers; without any, in the lane UNKNOWN."""
    return anchors.select("clip_id", "id", F.explode_outer("speakers").alias("lane"), "start_ms", "end_ms").withColumn("lane", F.coalesce("lane", F.lit("UNKNOWN")))


def single_speaker_view(anchors: DataFrame) -> DataFrame:
    """Anchors as if nobody overlapped: the first speaker alone, no overlap, no review for it."""
    return anchors.withColumn("speakers", F.slice("speakers", 1, 1)).withColumn("speaker", F.coalesce(F.get("speakers", F.lit(0)), F.lit("UNKNOWN"))).withColumn("overlap", F.lit(False)).withColumn("needs_review", F.col("speaker") == "UNKNOWN")


def no_diarization(turns: DataFrame) -> DataFrame:
    """One turn of UNKNOWN over each clip."""
    return turns.groupBy("clip_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).withColumn("speaker", F.lit("UNKNOWN"))


def label_error(reference: Column, predicted: Column) -> Column:
    """Share of places with another label; null for arrays of different length."""
    wrong = F.size(F.filter(F.zip_with(reference, predicted, lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    return F.when(F.size(reference) != F.size(predicted), None).when(F.size(reference) == 0, 0.0).otherwise(F.round(wrong / F.size(reference), 6))


def overlap_flag_error(matches: DataFrame) -> DataFrame:
    """clip_id, n, wrong: reference turns whose best match has another overlap flag."""
    return matches.groupBy("clip_id").agg(F.count("*").alias("n"), F.count_if(~F.col("ref_overlap").eqNullSafe(F.coalesce("hyp_overlap", F.lit(False)))).alias("wrong"))


def interruption_candidates(turns: DataFrame) -> DataFrame:
    """Interruptions of clips with at least two speakers, numbered by time, for a person to label."""
    several = turns.groupBy("clip_id").agg(F.count_distinct("speaker").alias("n_speakers")).where("n_speakers >= 2")
    events = intervals.interruption_events(turns).join(several, "clip_id", "left_semi")
    w = Window.partitionBy("clip_id").orderBy("start_ms", "end_ms", intervals.joined_speakers())
    return events.withColumn("number", F.row_number().over(w)).withColumn("candidate_id", F.format_string("%s_interruption_%03d", F.col("clip_id").cast("string"), "number"))


def prefix_match(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of left with the row of right whose other is key, else is it but for case and marks, else begins with it."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    r = right.select(F.col(other).alias("candidate"), norm(F.col(other)).alias("r_norm"))
    plain = left.select(key, norm(F.col(key)).alias("l_norm"))
    exact = plain.join(r, F.col(key) == F.col("candidate")).withColumn("how", F.lit(1))
    same = plain.join(r, F.col("l_norm") == F.col("r_norm")).withColumn("how", F.lit(2))
    # Prefixes meet by equal strings: each candidate is cut to the lengths that keys have.
    lengths = plain.select(F.length("l_norm").alias("n")).where("n > 0").distinct()
    cut = r.join(F.broadcast(lengths), F.length("r_norm") > F.col("n")).select("candidate", "r_norm", F.expr("left(r_norm, n)").alias("l_norm"))
    begins = plain.join(cut, "l_norm").withColumn("how", F.lit(3))
    found = _first(exact.select(key, "candidate", "how").unionByName(same.select(key, "candidate", "how")).unionByName(begins.select(key, "candidate", "how")), [key], "how", "candidate")
    return left.select(key).join(found, key, "left")


def candidate_rollup(matches: DataFrame) -> DataFrame:
    """Matches (canonical, method, score, anchor_id, place) by canonical in any case and method: best score, anchors in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "anchor_id"))), lambda x: x["anchor_id"])
    rows = matches.groupBy(F.lower("canonical").alias("canonical"), "method").agg(F.max("score").alias("score"), F.array_distinct(listed).alias("anchor_ids"))
    return rows


def evidence_cards(anchors: DataFrame, quotes: int = 4, terms: int = 6) -> DataFrame:
    """By clip and speaker: anchors, overlaps, reviews, the first quotes and the most frequent long words."""
    quote = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), 1, quotes)
    cards = anchors.groupBy("clip_id", "speaker").agg(F.count("*").alias("n"), F.count_if("overlap").alias("n_overlap"), F.count_if("needs_review").alias("n_review"), quote.alias("quotes"))
    words = anchors.select("clip_id", "speaker", "id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{6,}"), 0)).alias("pos", "word"))
    counts = words.groupBy("clip_id", "speaker", "word").agg(F.count("*").alias("n_word"), F.min(F.struct("id", "pos")).alias("at"))
    w = Window.partitionBy("clip_id", "speaker").orderBy(F.desc("n_word"), "at")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= terms).groupBy("clip_id", "speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("terms"))
    return cards.join(top, ["clip_id", "speaker"], "left")
