import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnstone.llm import resampling
from turnstone.llm.queries import op11_resample

from .conftest import SF


def words(text) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(docs: list[tuple], target: list, grams=1, buckets=10_000, percent=10, least=20, seed=2024) -> list[tuple]:
    features = lambda ws: [" ".join(ws[i : i + k]) for k in range(1, grams + 1) for i in range(len(ws) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in features(words(text)))
    t = Counter(bucket(f) for text in target for f in features(words(text)))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        own = features(words(text))
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = percent * len(enough) // 100
    ranked = [(*r, i + 1 if i < drawn else None) for i, r in enumerate(enough)]
    return sorted([*ranked, *((*r, None) for r in rows if r[1] < least)], key=str)


def got(frame) -> list[tuple]:
    return sorted((tuple(row) for row in frame.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = op11_resample(spark, SF)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((d, f, w, s, r) for d, _, f, w, s, r in brute_force(docs, target)), key=str)


@pytest.mark.parametrize("grams", [2, 3])
def test_longer_features(spark, docs, grams):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = ["the cat sat on the mat", None, "Der Hund", ""]
    frame = spark.createDataFrame([(x,) for x in target], "text string")
    out = resampling.resample(docs, frame, grams=grams, buckets=50, percent=70, least_words=1, seed=7)
    assert got(out) == brute_force(rows, target, grams, 50, 70, 1, 7)


def test_odd_rows(spark, docs, no_docs):
    more = docs.union(spark.createDataFrame([(None, "the cat and the dog " * 9, "en", "a", "x")] * 2, docs.schema))
    clashing = more.withColumns({name: F.lit("x") for name in ("score", "rank", "weight", "n_words", "before")})
    target = spark.createDataFrame([("the cat sat",)], "text string").withColumn("doc_id", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in more.collect()]
    assert got(resampling.resample(clashing, target, least_words=1, percent=100)) == brute_force(rows, ["the cat sat"], least=1, percent=100)
    assert got(resampling.resample(clashing, target.limit(0))) == brute_force(rows, [])
    assert resampling.resample(no_docs, target).count() == 0


def test_long_texts_and_many_ties(spark):
    text = "alpha beta gamma " * 500_000  # 8.5 MB
    rows = [(1, text)] + [(7, "alpha beta " * 10)] * 300 + [(i, "alpha " * 25) for i in range(1000, 1400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(resampling.resample(frame, frame.limit(1).selectExpr("'gamma' as text"), percent=60)) == brute_force(rows, ["gamma"], percent=60)


def test_counts_are_the_same_for_any_partitions(spark, docs):
    one, many = (resampling.bucket_counts(docs.repartition(n)).tolist() for n in (1, 13))
    assert one == many and sum(one) == sum(len(words(r.text)) for r in docs.collect())
