"""Windows of a recording that are worth keeping as clips: those with several speakers, overlapping speech first, few shared seconds."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators import intervals

#: Length of a window, how long before a word it begins, and how much two chosen ones may share.
LENGTH_MS, LEAD_MS, SHARED_MS = 20_000, 2_000, 2_000


def candidate_windows(words: DataFrame, length_ms: int = LENGTH_MS, lead_ms: int = LEAD_MS) -> DataFrame:
    """clip_id, start_ms, end_ms, overlap of the different windows that begin just before a word (clip_id, speaker, start_ms, end_ms)
    and hold words of two speakers. overlap is whether words of different speakers that it meets share time."""
    windows = words.select("clip_id", F.greatest(F.lit(0), F.col("start_ms") - lead_ms).alias("start_ms")).distinct().withColumn("end_ms", F.col("start_ms") + length_ms)
    # A speaker's words may be merged, as only whether a window meets any of them counts.
    spoken = intervals.interval_union(words, "clip_id", "speaker").select(F.col("clip_id").alias("s_clip"), "speaker", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    met = intervals.meeting(windows, spoken, ("start_ms", "end_ms"), ("s", "e"), "s_clip")
    several = met.groupBy("clip_id", "start_ms", "end_ms").agg(F.count_distinct("speaker").alias("speakers")).where("speakers >= 2").drop("speakers")
    # Both words of a pair meet a window just when the time they share, from the later start to the earlier end, does.
    pairs = words.select("clip_id", F.col("speaker").alias("speaker1"), F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    others = words.select(F.col("clip_id").alias("o_clip"), F.col("speaker").alias("speaker2"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    shared = intervals.meeting(pairs, others, ("s1", "e1"), ("s2", "e2"), "o_clip").where("speaker1 < speaker2")
    regions = intervals.interval_union(shared.select("clip_id", F.greatest("s1", "s2").alias("start_ms"), F.least("e1", "e2").alias("end_ms")), "clip_id")
    regions = regions.select(F.col("clip_id").alias("r_clip"), F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"))
    held = intervals.meeting(several, regions, ("start_ms", "end_ms"), ("rs", "re"), "r_clip").select("clip_id", "start_ms").distinct().withColumn("overlap", F.lit(True))
    return several.join(held, ["clip_id", "start_ms"], "left").select("clip_id", "start_ms", "end_ms", F.coalesce("overlap", F.lit(False)).alias("overlap"))


def _choose(length_ms: int, shared_ms: int):
    def run(candidates: pd.DataFrame) -> pd.DataFrame:
        # All windows are as long, so one shares too much time with a chosen one just when their starts are too near.
        apart, chosen, kept = length_ms - shared_ms, [], []
        ordered = candidates.sort_values(["overlap", "start_ms"], ascending=[False, True])
        for i, start in zip(ordered.index, ordered["start_ms"], strict=True):
            at = bisect_left(chosen, start)
            if (at == 0 or start - chosen[at - 1] >= apart) and (at == len(chosen) or chosen[at] - start >= apart):
                insort(chosen, start)
                kept.append(i)
        return ordered.loc[kept, ["clip_id", "start_ms", "end_ms", "overlap"]]

    return run


def select_windows(candidates: DataFrame, most: int | None = None, length_ms: int = LENGTH_MS, shared_ms: int = SHARED_MS) -> DataFrame:
    """The windows of candidates (clip_id, start_ms, end_ms, overlap) that are chosen, with place (from 1) by clip, at most so many.

    Those with overlap come first, then the earlier; one that shares more than shared_ms with a chosen one is left out.
    Windows too far apart to share time don't affect each other, so each cluster of near ones is chosen from by itself.
    """
    w = Window.partitionBy("clip_id").orderBy("start_ms")
    far = F.coalesce((F.col("start_ms") - F.lag("start_ms").over(w) >= length_ms - shared_ms).cast("int"), F.lit(1))
    clustered = candidates.withColumn("far", far).withColumn("cluster", F.sum("far").over(w)).drop("far")
    clip_type = candidates.schema["clip_id"].dataType.simpleString()
    chosen = clustered.groupBy("clip_id", "cluster").applyInPandas(_choose(length_ms, shared_ms), f"clip_id {clip_type}, start_ms long, end_ms long, overlap boolean")
    placed = chosen.withColumn("place", F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("overlap"), "start_ms")))
    return placed.where(F.col("place") <= most) if most is not None else placed
