import random

from pyspark.sql import functions as F

from turnstone.operators import intervals
from turnstone.plans import matching_queries
from turnstone.streaming import overlaps

SF = "/root/testdata/sf0.001"
ORIGIN = 1_600_000_000_000


def test_sessions_are_the_whole_tables(spark):
    whole = sorted(tuple(r) for r in matching_queries.speech_sessions(spark, SF).collect())
    assert whole and sorted(tuple(r) for r in matching_queries.streaming_sessions(spark, SF).collect()) == whole


def turns(spark, rows):
    frame = spark.createDataFrame([(c, s, a + ORIGIN, z + ORIGIN) for c, s, a, z in rows], "clip_id string, speaker string, start_ms long, end_ms long")
    return frame.withColumn("ts", F.timestamp_millis("start_ms")).select("clip_id", "speaker", "ts", "start_ms", "end_ms")


def test_overlaps_of_a_stream_are_the_batch_ones(spark, tmp_path):
    dice = random.Random(5)
    rows = [(dice.choice("cde"), dice.choice("abx"), start, start + dice.choice([0, 400, 3000, 90_000])) for start in (dice.randrange(0, 4_000_000, 100) for _ in range(500))]
    rows += [("f", "a", 0, 5000), ("f", "b", 3000, 8000), ("f", "a", 5000, 9000), ("f", "c", 4_100_000, 4_200_000)]
    folder, parts = str(tmp_path / "turns"), 6
    for k in range(parts):
        some = [r for r in rows if min(r[2] * parts // 4_000_000, parts - 1) == k]
        dice.shuffle(some)
        turns(spark, some).coalesce(1).write.mode("append").parquet(folder)
    found, late = overlaps.run_to_end(overlaps.overlap_regions(overlaps.read_turns(spark, folder), "1 minute"), str(tmp_path / "out"), str(tmp_path / "state"), lambda: overlaps.write_end(spark, folder))
    batch = intervals.overlap_regions(spark.createDataFrame(rows, "clip_id string, speaker string, start_ms long, end_ms long"))
    listed = lambda frame: sorted((r.clip_id, r.start_ms % ORIGIN, r.end_ms % ORIGIN, r.speakers, r.duration_ms) for r in frame.collect())
    assert listed(found) == listed(batch) and late == 0 and ("f", 3000, 8000, ["a", "b"], 5000) in listed(found)


def test_late_turns_are_counted(spark, tmp_path):
    folder = str(tmp_path / "turns")
    for part in ([("c", "a", 0, 9000), ("c", "b", 2000, 4000)], [("c", "a", 9_000_000, 9_001_000)], [("c", "b", 9_000_500, 9_002_000)], [("c", "x", 100, 300)]):
        turns(spark, part).coalesce(1).write.mode("append").parquet(folder)
    found, late = overlaps.run_to_end(overlaps.overlap_regions(overlaps.read_turns(spark, folder)), str(tmp_path / "out"), str(tmp_path / "state"), lambda: overlaps.write_end(spark, folder))
    assert sorted((r.start_ms - ORIGIN, r.end_ms - ORIGIN) for r in found.collect()) == [(2000, 4000), (9_000_500, 9_001_000)] and late == 1
    assert overlaps.ROCKS not in spark.conf.get(overlaps.STORE)


def test_a_sweep(spark):
    assert overlaps.regions([("a", 0, 10), ("b", 5, 8), ("a", 10, 20), ("b", 9, 12), ("c", 3, 3)]) == [(5, 8, ["a", "b"]), (9, 12, ["a", "b"])]
