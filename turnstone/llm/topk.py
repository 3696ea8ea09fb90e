"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

Vectors become whole numbers, floor(scale * x). A rotation by the eigenvectors of the vectors' second moments gathers
most of their length in the first coordinates. Vectors are dealt out in blocks by descending length. Queries, also in
blocks, first meet the longest vectors, which gives each a lower bound of its k-th score; then the blocks whose lengths
can still reach it. Within a block, a pair is dropped as soon as the product of its first coordinates plus the product
of the lengths of what is left can't reach the bound. What remains is scored in whole numbers.

Vectors that are null or empty, or that hold null or non-finite components, take no part. An inner product needs two
vectors of one length, so vectors of each length are searched by themselves, one length after the other. Products are
exact: in doubles where those hold them, else in 64 bits, else in Python's whole numbers; a component or score beyond 64
bits counts as the nearest that fits. Equal scores go to the smaller id. Repeated ids are candidates of their own; a
query never meets rows of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import drop, stage, to_batch

SCALE = 256
K = 5
#: Vectors in a block of candidates, and queries in a block.
BLOCK, QUERY_BLOCK = 4096, 512
#: Rotated coordinates in the partial sums.
LEADING = 16


def whole_vectors(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """id, v (array of long) for the vectors that take part."""
    x = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(fine, F.lit(False)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column(0), d).astype(np.float64)
            total += m.T @ m
        yield to_batch({"i": np.arange(d * d, dtype=np.int32), "x": total.reshape(-1)}, {"i": pa.int32(), "x": pa.float64()})

    return run


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the second moments, the largest first. The driver gets d * d numbers."""
    rows = vectors.select("v").mapInArrow(_moments(d), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros(d * d)
    for row in rows:
        moments[row.i] = row.x
    return np.ascontiguousarray(np.linalg.eigh(moments.reshape(d, d))[1][:, ::-1])


_BLOCK = {"n": pa.int32(), "longest": pa.float64(), "least": pa.float64(), "ids": pa.binary(), "rows": pa.binary(), "floors": pa.binary()}
_BLOCK_SCHEMA = "n int, longest double, least double, ids binary, rows binary, floors binary"


def _blocks(d: int, size: int):
    """Consecutive vectors (id, v, floor) as blocks of bytes, with the greatest length and the least floor of each."""

    def cut(ids: np.ndarray, rows: np.ndarray, floors: np.ndarray) -> pa.RecordBatch:
        longest = float(np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max()))
        return to_batch({"n": [len(ids)], "longest": [longest], "least": [float(floors.min())], "ids": [ids.tobytes()], "rows": [rows.astype(np.int32 if np.abs(rows.astype(np.float64)).max() < 2**31 - 1 else np.int64).tobytes()], "floors": [floors.tobytes()]}, _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, floors = np.zeros(0, np.int64), np.zeros((0, d), np.int64), np.zeros(0)
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            rows = np.concatenate([rows, _matrix(batch.column(1), d)])
            floors = np.concatenate([floors, batch.column(2).to_numpy(zero_copy_only=False)])
            while len(ids) >= size:
                yield cut(ids[:size], rows[:size], floors[:size])
                ids, rows, floors = ids[size:], rows[size:], floors[size:]
        if len(ids):
            yield cut(ids, rows, floors)

    return run


def _rows(data: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * d else np.int64).reshape(n, d).astype(np.int64)


_FOUND = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole rows."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    least, most = -(2**63), 2**63 - 1
    return np.array([[min(max(x, least), most) for x in row] for row in a.astype(object) @ b.astype(object).T], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score down and id up."""
    if len(scores) > 8 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _search(d: int, k: int, rotate: np.ndarray, leading: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                query_ids, ids = np.frombuffer(one["query_ids"], np.int64), np.frombuffer(one["ids"], np.int64)
                queries, rows = _rows(one["query_rows"], len(query_ids), d), _rows(one["rows"], len(ids), d)
                floor = np.frombuffer(one["floors"], np.float64)
                turned_q, turned = queries @ rotate, rows @ rotate
                rest_q, rest = np.linalg.norm(turned_q[:, leading:], axis=1), np.linalg.norm(turned[:, leading:], axis=1)
                norms = np.linalg.norm(turned, axis=1)
                lengths = np.linalg.norm(turned_q, axis=1)
                slack = 1 + 1e-9 * lengths * norms.max(initial=0.0)
                # Partial sums and what the rest can add, of all pairs of the blocks at once: a product of narrow matrices.
                short_q, short = np.column_stack([turned_q[:, :leading], rest_q]), np.column_stack([turned[:, :leading], rest])
                alive = short_q @ short.T >= (floor - slack)[:, None]
                alive &= query_ids[:, None] != ids
                out_q, out_v, out_s = [], [], []
                some = np.flatnonzero(alive.any(axis=0))  # rows that any query still needs
                products = _scores(queries, rows[some]) if len(some) else None
                for i in np.flatnonzero(alive.any(axis=1)).tolist():
                    live = np.flatnonzero(alive[i, some])
                    scores, live_ids = products[i, live], ids[some[live]]
                    reach = scores >= floor[i]
                    scores, live_ids = scores[reach], live_ids[reach]
                    if not len(scores):
                        continue
                    best = _best(scores, live_ids, k)
                    out_q.append(np.full(len(best), query_ids[i]))
                    out_v.append(live_ids[best])
                    out_s.append(scores[best])
                if out_q:
                    yield to_batch({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)}, _FOUND)

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query, the k other rows of largest inner product.

    Repeated query ids are asked once, with the smallest of their vectors. Blocks of queries meet blocks of candidates
    in groups: a block of candidates lies in one group, a block of queries is sent to each.
    """
    lengths = sorted(row.d for row in vectors.where(F.size(column) > 0).select(F.size(column).alias("d")).distinct().collect())
    found = [_top_k(vectors.where(F.size(column) == d), is_query, d, k, key, column, scale, block, query_block) for d in lengths or [1]]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _top_k(vectors: DataFrame, is_query, d: int, k: int, key: str, column: str, scale: int, block: int, query_block: int) -> DataFrame:
    """top_k for vectors of one length."""
    spark = vectors.sparkSession
    none = F.lit(float("-inf")).alias("floor")
    whole = stage(whole_vectors(vectors, key, column, scale), "topk-vectors")
    rotate = rotation(whole, d)
    search = _search(d, k, rotate, min(LEADING, d))
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    by_length = whole.withColumn("length", squares).repartitionByRange(F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id")
    blocks = stage(by_length.select("id", "v", none).mapInArrow(_blocks(d, block), _BLOCK_SCHEMA), "topk-blocks")
    asked = whole_vectors(vectors.where(is_query), key, column, scale).groupBy("id").agg(F.min("v").alias("v"))
    # No more groups than blocks of candidates: a block of queries is sent to each.
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count()))

    def meet(questions: DataFrame, candidates: DataFrame, name: str, one: bool = False) -> DataFrame:
        """Results of all blocks of questions against those blocks of candidates that can reach their floors; one block of candidates is sent to the questions."""
        sent = questions.mapInArrow(_blocks(d, query_block), _BLOCK_SCHEMA).selectExpr("longest as query_longest", "least", "ids as query_ids", "rows as query_rows", "floors")
        reaches = F.col("query_longest") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("least")
        dealt = candidates.select("longest", "ids", "rows", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"))
        if one:
            met = sent.join(F.broadcast(dealt), reaches)
        else:
            sent = sent.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            met = sent.join(dealt, (sent["group"] == dealt["group"]) & reaches)
        rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # each row holds two whole blocks
        try:
            return stage(met.select("query_ids", "query_rows", "floors", "ids", "rows").mapInArrow(search, "query_id long, vec_id long, score long"), name)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)

    longest = blocks.agg(F.max(F.struct("longest", F.xxhash64("ids").alias("mark"))).alias("m")).first().m
    is_longest = F.xxhash64("ids") == F.lit(longest.mark if longest else 0)
    head = meet(asked.select("id", "v", none), blocks.where(is_longest), "topk-head", one=True)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = head.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("found"))
    known = asked.join(floors, "id", "left").select("id", "v", F.coalesce("found", F.lit(float("-inf"))).alias("floor"))
    rest = meet(known.sortWithinPartitions("floor"), blocks.where(~is_longest), "topk-rest")
    out = head.unionByName(rest).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    drop(whole, blocks)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
