import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import topk
from turnstone.llm.queries import op7_top_products

from .conftest import SF


def brute(rows, is_query, k=5):
    fine = [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in fine:
        if is_query(q):
            scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(v, w, strict=True))), i) for i, w in fine if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op7_top_products(spark, SF).collect()} == brute(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("spread", [0.1, 30.0])
def test_small_blocks_ties_and_odd_rows(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([spread, 1])]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, None), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2020, [float("nan")] * 6), (2030, [float("inf")] * 6), (2040, [0.0] * 6), (2050, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding != []]
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, block=32, query_block=7)
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda i: i % 10 == 0)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 256 * 5)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_lengths_and_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3 + i % 2) * 10.0 ** rng.integers(0, 7)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = set()
    for d in (3, 4):
        want |= brute([r for r in rows if len(r[1]) == d], lambda i: i % 10 in (0, 5))
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, block=16).collect()} == want
    huge = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_a_pair_of_blocks_is_scored_as_a_whole(monkeypatch):
    """Each query of a block met the candidates by itself: hundreds of small products a pair of blocks."""
    rng, calls = np.random.default_rng(2), []
    monkeypatch.setattr(topk, "_scores", lambda a, b, own=topk._scores: calls.append(len(a)) or own(a, b))
    rows, ids = rng.integers(-256, 256, (200, 6)), np.arange(200)
    rows = rows[np.argsort(-(rows**2).sum(axis=1))]
    batch = topk.to_batch({"query_ids": [ids[:50].tobytes()], "query_rows": [rows[:50].tobytes()], "floors": [np.full(50, -np.inf).tobytes()], "ids": [ids.tobytes()], "rows": [rows.tobytes()]}, dict.fromkeys(("query_ids", "query_rows", "floors", "ids", "rows"), topk.pa.binary()))
    found = [out.to_pylist() for out in topk._search(6, 5, np.eye(6), 2)([batch])][0]
    scores = rows[:50] @ rows.T
    np.fill_diagonal(scores, -(10**9))
    assert calls == [50] and {(r["query_id"], r["vec_id"]) for r in found} == {(i, int(v)) for i in range(50) for v in np.lexsort((ids, -scores[i]))[:5]}
