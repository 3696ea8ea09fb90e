from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnstone.llm import neardup
from turnstone.llm.queries import op3_near_duplicates

from .conftest import SF


def brute(rows):
    """Classes by all pairs, with the operator's weights and plain shingles."""
    grams = {i: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else Counter() for i, t in rows}
    df = Counter(g for c in grams.values() for g in c)
    top = log(1 / neardup.COMMON)
    weight = {g: max(log(len(rows) / n), 0.01) if n >= neardup.COMMON * len(rows) else top for g, n in df.items()}
    parent = {i: i for i in grams}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_gram = defaultdict(list)
    for i, c in grams.items():
        for g in c or [()]:
            by_gram[g].append(i)
    for a, b in {(a, b) for own in by_gram.values() for a in own for b in own if a < b}:
        x, y = grams[a], grams[b]
        least = sum(min(n, y[g]) * weight[g] for g, n in x.items())
        total = sum(n * weight[g] for g, n in (x | y).items())
        if (least / total if total else 1) >= neardup.THRESHOLD and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in grams}


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in op3_near_duplicates(spark, SF).collect()} == brute(rows)


def test_star_of_copies_around_a_later_base(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    rows = [(50, " ".join(base))]
    for i in range(40):  # each near the base, most too far from each other
        own = list(base)
        for at in rng.choice(400, 7, replace=False):
            own[at] = f"x{i}-{at}"
        rows.append((i if i < 20 else i + 100, " ".join(own)))
    rows += [(500 + i, " ".join(f"z{x}" for x in rng.integers(0, 10**6, 300))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, got = brute(rows), {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert sum(want[i] != got[i] for i in want) <= 1


def test_large_star_of_copies_is_one_class(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    rows = [(500, " ".join(base))]
    for i in range(1000):  # each near the base, most too far from each other
        own = list(base)
        for at in rng.choice(400, 7, replace=False):
            own[at] = f"x{i}-{at}"
        rows.append((i if i < 500 else i + 1, " ".join(own)))
    others = spark.range(1001, 121001).select(F.col("id").alias("doc_id"), F.concat(F.lit("other"), "id").alias("text"))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(others)
    got = neardup.near_duplicates(df)
    assert got.where("doc_id <= 1000 and class_id <> 0").count() == 0
    assert got.where("doc_id > 1000 and class_id <> doc_id").count() == 0


def test_blocks_link_across_groups():
    def row(i, own, label):
        return i, label, np.zeros(neardup.DRAWS, "<u2").tobytes(), np.array(own, "<u4").tobytes(), b""

    one, two, three = list(range(10)), [*range(9), 20], list(range(50, 60))
    rows = [(7, 0, 0, True, *row(1, one, 1)), (7, 0, 0, False, *row(2, two, 2)), (7, 0, 0, False, *row(3, three, 3)), (7, 0, 1, True, *row(1, one, 1)), (7, 0, 1, False, *row(4, one, 1))]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=list("abcdefghi"))
    out = pa.Table.from_batches(list(neardup._link_blocks(4.6, 0.8)([batch]))).to_pylist()
    assert out == [{"a": 1, "b": 2}]


def test_sampling_estimates_similarity():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    wa, wb = np.exp(rng.integers(-3, 4, 2000) * neardup.STEP), np.exp(rng.integers(-3, 4, 2000) * neardup.STEP)
    a, b = dict(zip(keys[:2000], wa)), dict(zip(keys[500:2500], wb))
    for k in list(keys[500:1800]):
        b[k] = a[k]
    pack = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs(neardup.weighted_jaccard(pack(a), pack(b)) - true) < 1e-9
    with np.errstate(over="ignore"):
        hits = []
        for shift in range(30):
            moved = [(k ^ np.uint64(shift * 7919), w) for k, w in (pack(a), pack(b))]
            drawn = neardup.draw(moved)
            hits.append((drawn[0] == drawn[1]).mean())
    assert abs(np.mean(hits) - true) < 0.03


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 3), (20, 21), (30, 31)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 8, 9, 10)}, 20: 20, 21: 20, 30: 30, 31: 30, **{100 + i: 100 for i in range(41)}}


def test_odd_rows(spark, docs, no_docs):
    out = {(r.doc_id, r.class_id, r.n_copies) for r in neardup.near_duplicates(docs.withColumn("bucket", F.lit(1))).collect()}
    assert out == {(1, 1, 1), (2, 2, 3), (3, 2, 3), (4, 2, 3), (5, 5, 2), (6, 6, 1), (7, 7, 1), (8, 8, 1)}
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7, 8]
    assert neardup.near_duplicates(no_docs).count() == 0


def test_lossy_counts_keep_all_that_is_common():
    rng = np.random.default_rng(2)
    share, counts, total, n = 0.02, neardup.LossyCounts(0.01), Counter(), 3000
    for i in range(n):
        own = np.unique(np.concatenate([rng.integers(0, 10**6, 40), rng.integers(0, 60, 3)])).astype(np.uint64)
        total.update(own.tolist())
        counts.add(own)
        if i % 100 == 99:
            counts.count()
    counts.count()
    known = dict(zip(counts.shingles.tolist(), counts.n.tolist(), strict=True))
    assert all(known[s] >= c - 0.01 * n for s, c in total.items() if c >= share * n)
    assert all(c <= total[s] for s, c in known.items()) and len(known) < len(total) / 3


def _as_batches(texts, size):
    return [pa.RecordBatch.from_arrays([pa.array(range(at, at + len(texts[at : at + size])), pa.int64()), pa.array(texts[at : at + size])], names=["doc_id", "text"]) for at in range(0, len(texts), size)]


def test_a_group_of_copies_in_one_task_names_nothing(spark, monkeypatch):
    """Each task named all shingles of half the share of its own texts, so groups of near copies made rows by their length."""
    rng = np.random.default_rng(3)
    base = " ".join(f"v{k}" for k in range(3000))
    texts = [f"{base} end{i}" for i in range(20)] + [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 30)) for _ in range(400)]
    rows = [row for batch in neardup._sketch(iter(_as_batches(texts, 64))) for row in batch.to_pylist()]
    most = neardup.CELL_ROWS * neardup.CELLS // neardup.PART
    assert [r["doc_id"] for r in rows[: len(texts)]] == list(range(len(texts))) and len(rows) <= len(texts) + most
    monkeypatch.setattr(neardup, "CELLS", 1 << 10)  # many shingles share a cell, and counts stay exact
    texts = ["the cat sat on the mat " * (i % 3) + " ".join(f"w{k}" for k in rng.integers(0, 10**6, 30)) for i in range(300)]
    hashed = list(neardup._words_of(pa.array(texts)))
    with np.errstate(over="ignore"):
        true = Counter(s for words in hashed for s in np.unique(neardup.shingles(words)).tolist())
    hot = np.arange(neardup.CELL_ROWS * neardup.CELLS)

    class Sent:
        value = hot

    counted = Counter()
    for part in (texts[:100], texts[100:]):
        for batch in neardup._count_hot(Sent)(iter([pa.RecordBatch.from_arrays([pa.array(part)], names=["text"])])):
            counted.update(dict(zip(batch.column(0).to_numpy().view(np.uint64).tolist(), batch.column(1).to_pylist(), strict=True)))
    assert counted == true


def test_common_shingles_are_exact_however_texts_are_dealt(spark):
    rng = np.random.default_rng(4)
    texts = [("one two three four five six seven " if i % 60 == 0 else "") + " ".join(f"w{k}" for k in rng.integers(0, 10**6, 20)) for i in range(1200)]
    with np.errstate(over="ignore"):
        true = Counter(s for words in neardup._words_of(pa.array(texts)) for s in np.unique(neardup.shingles(words)).tolist())
    common = {s for s, c in true.items() if c >= neardup.COMMON * len(texts)}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 7):
        read = neardup.stage(neardup.map_batches(frame.repartition(parts), neardup._sketch, "doc_id long, one long, two long, counts binary"), "t")
        found = neardup._common_weights(frame, read, len(texts))
        assert set(found.common.tolist()) == common and common
        assert np.allclose(found.idf, [np.log(len(texts) / true[s]) for s in found.common.tolist()])
