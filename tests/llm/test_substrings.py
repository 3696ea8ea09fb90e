import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import substrings
from turnstone.llm.queries import op10_repeats

from .conftest import SF


def brute(rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for at in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[at : at + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for at in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[at : at + 50])] < i:
                gone[at : at + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op10_repeats(spark, SF).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("batches", [1, 3])
def test_made_up_repeats(spark, batches):
    rng = np.random.default_rng(5)
    make = lambda n: [f"w{x}" for x in rng.integers(0, 30, n)]
    base, passage = make(300), make(60)
    rows = [(5, base), (3, base[:200]), (9, base[100:151]), (9, base[100:150]), (7, passage + base[10:60]), (8, passage[:50] + make(20)), (2, passage[1:]), (11, ["x"] * 400), (12, ["x"] * 130), (1, ["x"] * 49), (13, make(5) + passage[5:58] + make(7) + base[220:290])]
    rows += [(20 + i, base[: 60 + i]) for i in range(30)] + [(100, None), (None, base), (101, []), (4, base), (4, base)]
    rows = [(i, None if w is None else " \n".join(w)) for i, w in rows]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    out = substrings.remove_repeats(df, batches=batches, with_text=True)
    assert sorted((tuple(r)[:4] for r in out.collect()), key=str) == brute(rows)
    for r in out.where("kept_text is not null").collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_odd_rows(spark, docs, no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0
    out = substrings.remove_repeats(docs.withColumn("mark", F.lit("x")))
    assert out.count() == docs.count() and out.where("n_removed > 0").count() == 0


def test_an_index_that_outlives_a_call(spark, tmp_path):
    rng = np.random.default_rng(8)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1000, n))
    passage, twice = make(120), make(80)
    calls = [
        [(1, make(30) + " " + passage + " " + make(30)), (2, make(90))],
        [(11, make(10) + " " + passage[: len(passage) // 2 + 100] + " " + make(20)), (12, twice), (13, make(70))],
        [(21, twice + " " + make(5)), (22, passage), (23, make(60) + " " + passage), (24, twice + " " + make(9))],
    ]
    came = []
    for rows in calls:
        came += rows
        index = substrings.FingerprintIndex(spark, str(tmp_path), max_runs=2)
        out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=1, index=index)
        want = {r[0]: r for r in brute(came)}
        assert sorted(tuple(r) for r in out.collect()) == sorted(want[i] for i, _ in rows)
    # The third run made the index compact itself.
    index = substrings.FingerprintIndex(spark, str(tmp_path), max_runs=2)
    assert len(index.runs) == 1 and index.history("texts").count() == len(came)
