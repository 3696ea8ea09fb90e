"""Documents of many shapes, archives and reused stages, on files written by hand."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from turnstone.artifacts import Artifacts
from turnstone.plans.document_queries import meeting_stages
from turnstone.sources import archives, documents


def variants(spark, *docs):
    return spark.createDataFrame([(i, doc if isinstance(doc, str) else json.dumps(doc)) for i, doc in enumerate(docs)], "id int, value string").withColumn("v", F.try_parse_json("value"))


def test_texts_of_maps(spark):
    docs = [
        {"anchors": [{"raw_text": " a ", "corrected_text": "b"}, {"text": "c"}, 7, {"x": 1}]}, {"conversation_map": {"anchors": [{"utterance": 5}]}}, {"anchors": [], "correction_audits": [{"before_text": "a", "after_text": "z"}]},
        {"anchors": [{"x": 1}], "corrections": [{"original_text": "o"}]}, {"anchors": "no"}, {}, [1],
    ]
    raw, corrected = documents.map_texts(F.col("v"))
    got = variants(spark, *docs).orderBy("id").select(raw, corrected).collect()
    assert [tuple(r) for r in got] == [("a c", "b c"), ("5", "5"), ("a", "z"), ("o", "o"), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize("metadata,path,expected", [
    ({}, "full/base__fleurs_en_1548.json", ("fleurs_en_1548", "base")), ({"clip_id": "ami_es2002a_01"}, "x/tiny__fleurs_zh_cn_1579.json", ("ami_es2002a_01", "tiny")), ({"clip_id": "none", "model_name": " own "}, "x.json", (None, "own")),
    ({"audio_path": "a/Large-v3/FLEURS_de_7.wav"}, "x.json", ("FLEURS_de_7", "large")), ({"clip_id": ""}, "x.json", (None, "unknown")),
])
def test_samples_and_models(spark, metadata, path, expected):
    row = variants(spark, {"metadata": metadata}).select(*documents.sample_and_model(F.col("v"), F.lit(path))).first()
    assert tuple(row) == expected


def test_collecting_prefers_folders_and_counts_reasons(spark, tmp_path):
    for name, text in {"full/base__fleurs_en_1.json": '{"anchors": [{"raw_text": "a"}]}', "full/broken.json": "{", "other/base__fleurs_en_2.json": "[]", "other/deep/base__fleurs_en_3.json": "{}"}.items():
        (tmp_path / "maps" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "maps" / name).write_text(text)
    read = documents.read_documents(spark, str(tmp_path / "maps"))
    rows = {r.path: r for r in documents.collect_maps(read).collect()}
    assert rows["full/base__fleurs_en_1.json"].corrected_text == "a" and rows["full/base__fleurs_en_1.json"].skipped is None
    assert (rows["full/broken.json"].skipped, rows["other/base__fleurs_en_2.json"].skipped, rows["other/deep/base__fleurs_en_3.json"].skipped) == ("json_error", "not_dict_json", "missing_raw_text")
    some = documents.collect_maps(read, ("full",))
    assert {r.path for r in some.collect()} == {"full/base__fleurs_en_1.json", "full/broken.json"} and [tuple(r) for r in documents.skip_reasons(some).collect()] == [("json_error", 1)]
    assert documents.collect_maps(read, ("nowhere",)).count() == 4


def test_texts_of_transcripts(spark):
    docs = ['"whole"', ["a", {"text": "b", "corrected_text": "c"}, {"x": 1}, 5], {"transcript": [{"raw_text": "t"}], "text": "no"}, {"segments": {"asr_segments": {"temporal_transcript": "deep"}}}, {"reference": "r"}, {"x": 1}, "{"]
    got = documents.with_transcript_text(variants(spark, *docs), "v").orderBy("id").collect()
    assert [r.text for r in got] == ["whole", "a c 5", "t", "deep", "r", None, None] and "__inner" not in got[0].asDict()
    named = documents.with_transcript_text(variants(spark, {"note": "n", "segments": ["x"]}, {"segments": [{"note": "y", "text": "z"}]}), "v", field="note").orderBy("id").collect()
    assert [r.text for r in named] == ["n", "y"]
    sizes = variants(spark, [1, 2], {"segments": [1], "transcript": "no"}, {"x": 1}).orderBy("id").select(F.size(documents.segments_of(F.col("v")))).collect()
    assert [r[0] for r in sizes] == [2, 1, None]


def zipped(**members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in members.items():
            archive.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = '<n:x xmlns:n="urn:n"><w starttime="1.25" endtime="1.5"> a &amp; b </w><n:w starttime="0.1" endtime="0.2">c</n:w><w starttime="3">no end</w><w starttime="4" endtime="5"> </w></n:x>'
    whole = zipped(ami__words__ES1_dot_A_dot_words_dot_xml=good, ami__words__ES1_dot_B_dot_words_dot_xml=good[:60], ami__words__ES10_dot_A_dot_words_dot_xml=good, ami__other_dot_xml="<x/>")
    damaged = bytearray(zipped(ami__words__ES1_dot_C_dot_words_dot_xml=good * 1))
    damaged[60] ^= 0xFF
    for name, data in {"a.zip": whole, "b.zip": b"no archive", "c.zip": zipped(readme="x"), "d.zip": bytes(damaged), "e.txt": whole}.items():
        (tmp_path / name).write_bytes(data)
    read = archives.read_archives(spark, str(tmp_path))
    rows = [(r.path.rsplit("/", 1)[-1], r.speaker, r.start_ms, r.end_ms, r.word, r.reason) for r in archives.archive_words(read, "ES1").collect()]
    assert sorted(r for r in rows if r[4]) == [("a.zip", "SPEAKER_A", 100, 200, "c", None), ("a.zip", "SPEAKER_A", 1250, 1500, "a & b", None)]
    reasons = {r[0]: r[5] for r in rows if r[5]}
    assert reasons["a.zip"] == "damaged member: ParseError" and reasons["b.zip"] == "damaged archive" and reasons["c.zip"] == "no word annotations" and reasons["d.zip"].startswith("damaged")
    assert archives.archive_words(read).where("word = 'c'").count() == 2


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    made = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, made


def test_stages_are_reused(spark, tmp_path):
    rows = [(1, 0, "a", "one two", 0, 2000), (1, 1, "b", "three", 1500, 3000), (2, 0, "a", "four", 0, 1000)]
    write = lambda rows, mode="errorifexists": spark.createDataFrame(rows, "clip_id long, idx int, speaker string, text string, start_ms long, end_ms long").coalesce(1).write.mode(mode).parquet(str(tmp_path / "turns"))
    write(rows)
    kept = Artifacts(spark, str(tmp_path / "stages"))
    run = lambda **settings: meeting_stages(kept, str(tmp_path / "turns"), **settings)
    reused = lambda made: [made[name].reused for name in ("overlaps", "anchors", "summary")]
    first, first_jobs = jobs(spark, "first", run)
    assert reused(first) == [False] * 3 and first_jobs > 0
    again, again_jobs = jobs(spark, "again", run)
    assert reused(again) == [True] * 3 and again_jobs <= 3  # at most a look at each table's schema
    assert {tuple(r) for r in again["summary"].table().collect()} == {(1, 2, 3, 1, 500), (2, 1, 1, 0, 0)}
    assert reused(run(gap_ms=5)) == [True, False, False] and reused(run()) == [True] * 3
    write([*rows, (3, 0, "a", "new", 0, 400)], "overwrite")
    assert reused(run()) == [False] * 3 and run()["summary"].table().count() == 3
    (tmp_path / "stages" / f"summary-{run()['summary'].key[:32]}" / "_SUCCESS").unlink()
    assert reused(run()) == [True, True, False]
