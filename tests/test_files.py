import json

import pytest

from turnstone.sources import files


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("clip_id,path\na,x.wav\n")
    assert files.read_manifest(spark, f"{tmp_path}/m.csv", ["clip_id"]).collect() == [("a", "x.wav")]
    with pytest.raises(ValueError, match="lacks lang"):
        files.read_manifest(spark, f"{tmp_path}/m.csv", ["clip_id", "lang"])


def test_predictions_and_words(spark, tmp_path):
    timed = {"segments": [{"start": 0, "end": 2, "text": " hello there ", "words": [{"word": " hello", "start": 0.1, "end": 0.5}, {"word": "lost", "start": None, "end": None}]}, {"start": 2, "end": 3.5, "text": "bye"}]}
    (tmp_path / "tiny__c1.json").write_text(json.dumps(timed))
    (tmp_path / "tiny__c2.json").write_text(json.dumps({"mode": "mock", "segments": []}))
    (tmp_path / "tiny__c3.json").write_text("{}")
    found = files.read_predictions(spark, str(tmp_path))
    assert [(r.clip_id, r.model_name) for r in found.collect()] == [("c1", "tiny")]
    words = sorted(tuple(r) for r in files.segment_words(found).collect())
    assert words == [("c1", 0, 0, "hello", 100, 500), ("c1", 1, 0, "bye", 2000, 3500)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "text": "x"}\n\n{"id": "b"}\nnot json\n')
    good, bad = files.read_jsonl(spark, f"{tmp_path}/c.jsonl", "id string, text string", ["id", "text"])
    assert [tuple(r) for r in good.collect()] == [("a", "x")]
    assert sorted(r.problem for r in bad.collect()) == ["lacks id, text", "lacks text"]


def test_glossary(spark, tmp_path):
    (tmp_path / "g.md").write_text("# Terms\n| Term | Note |\n| --- | --- |\n| DER | error |\n- piano note -> pyannote\n")
    rows = sorted((r.canonical, r.form) for r in files.read_glossary(spark, f"{tmp_path}/g.md").collect())
    assert rows == [("DER", "DER"), ("pyannote", "piano note")]


def test_kaldi(spark, tmp_path):
    (tmp_path / "text").write_text("u1 hello you\nu2 bye\n")
    (tmp_path / "segments").write_text("u1 rec 0.5 1.25\nu2 rec 2 3\n")
    (tmp_path / "utt2spk").write_text("u1 A\n")
    rows = sorted(files.read_kaldi(spark, *(f"{tmp_path}/{x}" for x in ("text", "segments", "utt2spk"))).collect())
    assert rows == [("u1", "rec", "A", 500, 1250, "hello you"), ("u2", "rec", None, 2000, 3000, "bye")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "clip_id string, n int")
    files.write_documents(rows, f"{tmp_path}/docs")
    assert sorted(spark.read.schema("n int, clip_id string").json(f"{tmp_path}/docs").select("clip_id", "n").collect()) == [("a", 1), ("b", 2)]
    files.write_report(rows, f"{tmp_path}/report", ["n", "clip_id"])
    assert files.read_results(spark, f"{tmp_path}/report").columns == ["n", "clip_id", "source_file"]
    assert files.checksums(spark, f"{tmp_path}/report/*.csv").where("length(sha256) = 64").count() >= 1


def test_textgrid(spark, tmp_path):
    body = 'item []:\n  item [1]:\n    name = "A"\n    intervals [1]:\n      xmin = 0\n      xmax = 1.5\n      text = "hi ""you"""\n    intervals [2]:\n      xmin = 1.5\n      xmax = 2\n      text = ""\n  item [2]:\n    name = "B"\n    intervals [1]:\n      xmin = 0.25\n      xmax = 1\n      text = " yes "\n'
    (tmp_path / "m1.TextGrid").write_text("xmin = 0\nxmax = 2\n" + body)
    rows = sorted(tuple(r) for r in files.read_textgrid(spark, str(tmp_path)).collect())
    assert rows == [("m1", "A", 0, 1500, 'hi "you"'), ("m1", "B", 250, 1000, "yes")]


def test_small_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "c1.txt").write_text("\n hello you \n")
    assert [tuple(r) for r in files.read_transcripts(spark, f"{tmp_path}/t").collect()] == [("c1", "hello you")]
    assert files.read_or_empty(spark, " ", "a int").count() == files.read_or_empty(spark, f"{tmp_path}/no.csv", "a int").count() == 0
    (tmp_path / "p.json").write_text('{"mode": "strict", "limit": 2}')
    assert files.read_object(spark, f"{tmp_path}/p.json", ["mode"])["limit"] == 2
    with pytest.raises(ValueError, match="lacks name"):
        files.read_object(spark, f"{tmp_path}/p.json", ["mode", "name"])
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "tiny__c2.json").write_text(json.dumps({"mode": "mock", "segments": []}))
    with pytest.raises(Exception, match="no real prediction"):
        files.read_predictions(spark, f"{tmp_path}/x", refuse=True).collect()


@pytest.mark.parametrize("part, name", [("file_queries", "prediction_scan"), ("document_queries", "document_texts")])
def test_documents_come_in_few_files(spark, monkeypatch, tmp_path, part, name):
    """A file a document cost the driver seconds for every thousand."""
    import importlib

    plans = importlib.import_module(f"turnstone.plans.{part}")
    monkeypatch.setattr(plans, "new_folder" if part == "file_queries" else "folder", lambda spark, name: str(tmp_path / "kept"))
    n = plans.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert n > 0 and len(list((tmp_path / "kept").rglob("*.parquet"))) <= 16 and not list((tmp_path / "kept").rglob("*=*"))
