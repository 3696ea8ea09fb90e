"""Interval operators over turns (clip_id, speaker, start_ms, end_ms), half-open and in whole milliseconds.

Comparing whole milliseconds accepts an overlap of exactly the least length, which a difference of binary fractions of
seconds may miss by a rounding error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Length of the time buckets by which intervals of a clip are joined.
BUCKET_MS = 60_000


def buckets(start: str, end: str) -> Column:
    """The time buckets that an interval touches."""
    return F.sequence(F.expr(f"{start} div {BUCKET_MS}"), F.expr(f"greatest({start}, {end} - 1) div {BUCKET_MS}"))


def in_buckets(rows: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """rows once for each time bucket that they touch."""
    return rows.withColumn(name, F.explode(buckets(start, end)))


def meeting(left: DataFrame, right: DataFrame, own: tuple[str, str], other: tuple[str, str], clip: str, how: str = "inner") -> DataFrame:
    """Pairs of a clip's rows that share time, a pair once: joined on clip (clip_id and clip) and time bucket.

    A pair meets in each bucket that both touch; the one that holds the later start counts. So the work grows with the
    pairs and not with the square of a clip. A left join gives left rows without a partner once for each of their buckets.
    """
    later = f"greatest({own[0]}, {other[0]})"
    on = f"clip_id = {clip} and own_bucket = other_bucket and least({own[1]}, {other[1]}) > {later} and own_bucket = {later} div {BUCKET_MS}"
    return in_buckets(left, *own, "own_bucket").join(in_buckets(right, *other, "other_bucket"), F.expr(on), how).drop("own_bucket", "other_bucket")


def holding(points: DataFrame, rows: DataFrame, point: str, own: tuple[str, str], clip: str, condition: str, how: str = "inner") -> DataFrame:
    """points, each in one time bucket, with the rows of the clip that touch its bucket and meet the condition."""
    dealt = points.withColumn("own_bucket", F.expr(f"{point} div {BUCKET_MS}"))
    return dealt.join(in_buckets(rows, *own, "other_bucket"), F.expr(f"clip_id = {clip} and own_bucket = other_bucket and {condition}"), how).drop("own_bucket", "other_bucket")


def joined_speakers(column: str = "speakers") -> Column:
    """A sorted array of speakers as text."""
    return F.array_join(F.col(column), "+")


def positive(turns: DataFrame) -> DataFrame:
    return turns.where("end_ms > start_ms")


def elementary_intervals(turns: DataFrame) -> DataFrame:
    """clip_id, a, z: the stretches between neighbouring boundaries of a clip."""
    ends = positive(turns).select("clip_id", F.explode(F.array("start_ms", "end_ms")).alias("a")).distinct()
    return ends.withColumn("z", F.lead("a").over(Window.partitionBy("clip_id").orderBy("a"))).where("z is not null")


def active_speakers(turns: DataFrame) -> DataFrame:
    """clip_id, a, z, speakers: the sorted speakers of each elementary interval that has any."""
    t = positive(turns).select(F.col("clip_id").alias("turn_clip"), "speaker", "start_ms", "end_ms")
    e = elementary_intervals(turns)
    held = holding(e, t, "a", ("start_ms", "end_ms"), "turn_clip", "start_ms <= a and z <= end_ms")
    return held.groupBy("clip_id", "a", "z").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))


def merge_equal_neighbours(pieces: DataFrame) -> DataFrame:
    """Touching pieces (clip_id, a, z, speakers) of the same speakers as one: clip_id, start_ms, end_ms, speakers, duration_ms."""
    w = Window.partitionBy("clip_id").orderBy("a")
    new = ~F.coalesce((F.lag("z").over(w) == F.col("a")) & (F.lag("speakers").over(w) == F.col("speakers")), F.lit(False))
    islands = pieces.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w))
    merged = islands.groupBy("clip_id", "island", "speakers").agg(F.min("a").alias("start_ms"), F.max("z").alias("end_ms"))
    return merged.select("clip_id", "start_ms", "end_ms", "speakers", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def overlap_regions(turns: DataFrame) -> DataFrame:
    """Stretches with two or more different active speakers."""
    return merge_equal_neighbours(active_speakers(turns).where(F.size("speakers") >= 2))


def severity(duration: Column) -> Column:
    return F.when(duration >= 1000, "high").otherwise("medium")


def overlap_events(turns: DataFrame) -> DataFrame:
    """Overlap regions as events: clip_id, type, start_ms, end_ms, speakers, severity."""
    return overlap_regions(turns).select("clip_id", F.lit("overlap").alias("type"), "start_ms", "end_ms", "speakers", severity(F.col("duration_ms")).alias("severity"))


def interruption_events(turns: DataFrame, least_ms: int = 200) -> DataFrame:
    """A later speaker starts within a turn, overlaps it by least_ms and goes on after it. Equal events are one."""
    t = positive(turns)
    first = t.select(F.col("clip_id").alias("first_clip"), F.col("speaker").alias("first_speaker"), F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    later = t.select("clip_id", F.col("speaker").alias("later_speaker"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    # A later turn starts in one bucket, in which the first turn must be; least_ms is positive.
    met = holding(later, first, "s2", ("s1", "e1"), "first_clip", f"first_speaker <> later_speaker and s2 > s1 and e2 > e1 and e1 - s2 >= {max(least_ms, 1)}")
    events = met.select("clip_id", F.lit("interruption").alias("type"), F.col("s2").alias("start_ms"), F.col("e1").alias("end_ms"), F.array("first_speaker", "later_speaker").alias("speakers"))
    return events.distinct().withColumn("severity", severity(F.col("end_ms") - F.col("start_ms")))


def pairwise_overlaps(turns: DataFrame, least_ms: int = 50) -> DataFrame:
    """Pairs of a clip's turns, the earlier idx first, that overlap by least_ms."""
    a = turns.select("clip_id", F.col("idx").alias("i"), F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    b = turns.select(F.col("clip_id").alias("b_clip"), F.col("idx").alias("j"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    shared = F.least("e1", "e2") - F.greatest("s1", "s2")
    met = meeting(a, b, ("s1", "e1"), ("s2", "e2"), "b_clip").where("i < j").withColumn("overlap_ms", shared)
    return met.where(F.col("overlap_ms") >= least_ms).select("clip_id", "i", "j", "overlap_ms")


def flagged_by_overlap(turns: DataFrame, least_ms: int = 50) -> DataFrame:
    """turns with overlap: whether either side of some pairwise overlap."""
    pairs = pairwise_overlaps(turns, least_ms)
    sides = pairs.select("clip_id", F.explode(F.array("i", "j")).alias("idx")).distinct().withColumn("overlap", F.lit(True))
    return turns.join(sides, ["clip_id", "idx"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(False)))


def interval_union(rows: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching intervals of each key as one: keys, start_ms, end_ms."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reached = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reached.isNull() | (F.col("start_ms") > reached)).cast("int")
    islands = positive(rows).withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def without(turns: DataFrame, cuts: DataFrame) -> DataFrame:
    """What is left of turns (clip_id, speaker, start_ms, end_ms) outside cuts (clip_id, start_ms, end_ms)."""
    joined = interval_union(cuts, "clip_id")
    w = Window.partitionBy("clip_id").orderBy("start_ms")
    far = F.lit(1 << 60)
    before = joined.select("clip_id", F.coalesce(F.lag("end_ms").over(w), -far).alias("gs"), F.col("start_ms").alias("ge"))
    after = joined.groupBy("clip_id").agg(F.max("end_ms").alias("gs")).select("clip_id", "gs", far.alias("ge"))
    clips = turns.select("clip_id").distinct().join(joined.select("clip_id").distinct(), "clip_id", "left_anti").select("clip_id", (-far).alias("gs"), far.alias("ge"))
    # A gap is cut to its clip's turns first, as intervals meet by time buckets.
    span = turns.groupBy(F.col("clip_id").alias("s_clip")).agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    gaps = before.unionByName(after).unionByName(clips).join(span, F.col("clip_id") == F.col("s_clip")).select(F.col("clip_id").alias("g_clip"), F.greatest("gs", "lo").alias("gs"), F.least("ge", "hi").alias("ge")).where("ge > gs")
    met = meeting(positive(turns), gaps, ("start_ms", "end_ms"), ("gs", "ge"), "g_clip")
    return met.select("clip_id", "speaker", F.greatest("start_ms", "gs").alias("start_ms"), F.least("end_ms", "ge").alias("end_ms"))


def boundary_cuts(reference: DataFrame, collar_ms: int) -> DataFrame:
    """Stretches around the boundaries of a reference."""
    near = reference.select("clip_id", F.explode(F.array("start_ms", "end_ms")).alias("at")).distinct()
    return near.select("clip_id", (F.col("at") - collar_ms).alias("start_ms"), (F.col("at") + collar_ms).alias("end_ms"))


def coverage(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """clip_id, total_ms, covered_ms, coverage of the reference's union by the predicted union; 1 without reference time."""
    r = interval_union(reference, "clip_id").select("clip_id", F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"))
    p = interval_union(predicted, "clip_id").select(F.col("clip_id").alias("p_clip"), F.col("start_ms").alias("ps"), F.col("end_ms").alias("pe"))
    total = r.groupBy("clip_id").agg(F.sum(F.col("re") - F.col("rs")).alias("total_ms"))
    met = meeting(r, p, ("rs", "re"), ("ps", "pe"), "p_clip")
    covered = met.groupBy("clip_id").agg(F.sum(F.least("re", "pe") - F.greatest("rs", "ps")).alias("covered_ms"))
    both = total.join(covered, "clip_id", "left").withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0)))
    return both.withColumn("coverage", F.when(F.col("total_ms") > 0, F.round(F.col("covered_ms") / F.col("total_ms"), 6)).otherwise(1.0))


def bucketed_pairs(left: DataFrame, right: DataFrame, bucket_ms: int, least_ms: int = 1) -> DataFrame:
    """Overlapping pairs of left and right (clip_id, id, start_ms, end_ms) for long clips: joined on time buckets, a pair once.

    A pair meets in every bucket that both cover; the one that holds the later start counts.
    """
    cut = lambda rows, n: positive(rows).select(
        "clip_id", F.col("id").alias(f"id{n}"), F.col("start_ms").alias(f"s{n}"), F.col("end_ms").alias(f"e{n}"), F.explode(F.sequence(F.expr(f"start_ms div {bucket_ms}"), F.expr(f"(end_ms - 1) div {bucket_ms}"))).alias("bucket")
    )
    met = cut(left, 1).join(cut(right, 2), ["clip_id", "bucket"])
    met = met.withColumn("overlap_ms", F.least("e1", "e2") - F.greatest("s1", "s2")).where(F.col("overlap_ms") >= least_ms)
    return met.where(F.col("bucket") == F.expr(f"greatest(s1, s2) div {bucket_ms}")).select("clip_id", "id1", "id2", "overlap_ms")


def evidence_links(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """Events with the ordered ids (idx) of the anchors that they intersect."""
    a = anchors.select(F.col("clip_id").alias("a_clip"), "idx", F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    met = meeting(events, a, ("start_ms", "end_ms"), ("a_start", "a_end"), "a_clip", "left")
    return met.groupBy("clip_id", "type", "start_ms", "end_ms", "speakers", "severity").agg(F.array_sort(F.collect_set("idx")).alias("anchor_ids"))


def deduplicate_events(events: DataFrame, order: str) -> DataFrame:
    """The first event, by order, of each (clip_id, type, start_ms, end_ms, speakers in any order)."""
    w = Window.partitionBy("clip_id", "type", "start_ms", "end_ms", F.array_sort("speakers")).orderBy(order)
    return events.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def best_overlap_match(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Each reference turn with the hypothesis turn of most overlap; ties by boundary distance, then by smaller idx."""
    r = reference.select("clip_id", F.col("idx").alias("ref_idx"), F.col("speaker").alias("ref_speaker"), F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"))
    h = hypothesis.select(F.col("clip_id").alias("h_clip"), F.col("idx").alias("hyp_idx"), F.col("speaker").alias("hyp_speaker"), F.col("start_ms").alias("hs"), F.col("end_ms").alias("he"))
    met = meeting(r, h, ("rs", "re"), ("hs", "he"), "h_clip", "left")
    met = met.withColumn("overlap_ms", F.when(F.col("hs").isNotNull(), F.least("re", "he") - F.greatest("rs", "hs")).otherwise(0))
    w = Window.partitionBy("clip_id", "ref_idx").orderBy(F.desc("overlap_ms"), F.abs(F.col("rs") - F.col("hs")) + F.abs(F.col("re") - F.col("he")), "hyp_idx")
    return met.withColumn("place", F.row_number().over(w)).where("place = 1").select("clip_id", "ref_idx", "ref_speaker", "hyp_idx", "hyp_speaker", "rs", "re", "overlap_ms")


def diarization_error(matches: DataFrame) -> DataFrame:
    """clip_id, ref_ms, wrong_ms, wder: reference time whose best match has another speaker or is missing."""
    wrong = F.when(F.col("hyp_speaker").eqNullSafe(F.col("ref_speaker")), 0).otherwise(F.col("re") - F.col("rs"))
    sums = matches.groupBy("clip_id").agg(F.sum(F.col("re") - F.col("rs")).alias("ref_ms"), F.sum(wrong).alias("wrong_ms"))
    return sums.withColumn("wder", F.when(F.col("ref_ms") > 0, F.round(F.col("wrong_ms") / F.col("ref_ms"), 6)).otherwise(0.0))


def speaker_overlap_matrix(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """clip_id, ref_speaker, pred_speaker, overlap_ms over all pairs of turns that overlap."""
    r = reference.select("clip_id", F.col("speaker").alias("ref_speaker"), F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"))
    p = predicted.select(F.col("clip_id").alias("p_clip"), F.col("speaker").alias("pred_speaker"), F.col("start_ms").alias("ps"), F.col("end_ms").alias("pe"))
    met = meeting(r, p, ("rs", "re"), ("ps", "pe"), "p_clip")
    return met.groupBy("clip_id", "ref_speaker", "pred_speaker").agg(F.sum(F.least("re", "pe") - F.greatest("rs", "ps")).alias("overlap_ms"))
