"""Importance resampling towards a target: documents that look like the target's texts are drawn more often.

Features are hashed to buckets. The first pass counts them over all documents and over all target texts: a task adds up
one vector of bucket counts with np.bincount, and treeReduce adds the tasks' vectors. A bucket's gain is the logarithm
of its share in the target over its share in the documents. The second pass gathers the gains of each document's
features and adds them up with np.bincount. A document's weight is their mean; with Gumbel noise of its id it becomes a
score, and the highest scores are a sample without replacement whose odds grow with the weight.

Words are digits, a-z, A-Z lower-cased, and every character beyond ASCII; features are all runs of 1 to ``grams`` words.
Null texts have no features, so weight 0, and are never drawn as they are too short. A null doc_id has the noise of an
empty id and comes last among equal scores. Repeated rows stay, each with a rank of its own. Without documents or target
texts all counts are 0 and the gains follow from the shares' added ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import map_batches, slices, split_words, stage, to_batch, word_parts

BUCKETS = 10_000
SEED = 2024
#: Of the documents with that many words, so many in a hundred are drawn.
LEAST_WORDS = 20
PERCENT = 10
#: Parts of a long text that are worked on at once, in bytes; only single words can be cut apart.
PART_BYTES = 4 << 20


def _fold() -> np.ndarray:
    """What each byte becomes: word bytes stay, A-Z in lower case, all others are blanks."""
    table = np.full(256, 32, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_FOLD = _fold()


def buckets_of(texts: pa.Array, grams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' features by parts: rows of texts, their numbers of words, and the bucket of each feature with its row."""
    for rows, parts in word_parts(texts, _FOLD.__getitem__, PART_BYTES if grams == 1 else 1 << 62):
        words, place, n = split_words(parts)
        owner, spelled, found = np.repeat(rows, n), words, []
        for width in range(1, grams + 1):
            if width > 1:
                run = pc.binary_join_element_wise(*(words.take(pa.array(place[k : len(place) - width + 1 + k])) for k in range(width)), " ")
                inside = owner[: len(owner) - width + 1] == owner[width - 1 :]
                coded = run.filter(pa.array(inside)).dictionary_encode()
                spelled, at, own = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), owner[: len(owner) - width + 1][inside]
            else:
                at, own = place, owner
            bucket = np.fromiter(map(zlib.crc32, spelled.cast(pa.binary()).to_pylist()), np.int64, len(spelled)) % buckets
            found.append((bucket[at], own))
            if len(place) <= width:
                break
        yield rows, n, np.concatenate([b for b, _ in found]), np.concatenate([o for _, o in found])


def _count(grams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches, 0):
            for _, _, bucket, _ in buckets_of(batch.column(0), grams, buckets):
                counts += np.bincount(bucket, minlength=buckets)
        yield to_batch({"counts": [counts.tobytes()]}, {"counts": pa.binary()})

    return run


def bucket_counts(texts: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of texts (text) are in each bucket: one vector a task, added up in a tree of tasks."""
    vectors = map_batches(texts.select("text"), _count(grams, buckets), "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda row: np.frombuffer(row.counts, np.int64)).treeReduce(np.add)


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, in thousandths, from its counts in the documents and in the target texts."""
    n, all_documents, all_target = len(documents), float(documents.sum()), float(target.sum())
    ratios = ((float(t) + 1) * (all_documents + n) / ((float(s) + 1) * (all_target + n)) for s, t in zip(documents, target, strict=True))
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64)


_WEIGHTS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_features": pa.int64(), "weight": pa.int64()}


def _weigh(grams: int, gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = gain.value
        for batch in slices(batches, 1):
            n_words, n_features, total = np.zeros((3, batch.num_rows), np.int64)
            for rows, n, bucket, owner in buckets_of(batch.column(1), grams, len(of_bucket)):
                np.add.at(n_words, rows, n)
                n_features += np.bincount(owner, minlength=batch.num_rows)
                total += np.bincount(owner, of_bucket[bucket], minlength=batch.num_rows).astype(np.int64)  # whole numbers below 2**53
            yield to_batch({"doc_id": batch.column(0), "n_words": n_words, "n_features": n_features, "weight": total // np.maximum(n_features, 1)}, _WEIGHTS)

    return run


def weights(docs: DataFrame, gain: np.ndarray, grams: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of gains, 0 without features) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, _weigh(grams, shared), "doc_id long, n_words long, n_features long, weight long")


def with_score(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """weighted with score: the weight and Gumbel noise of the id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighted.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3 ... of the drawn rows by score, then doc_id; null for all others.

    scored is read three times, so it should be a written table. How many rows have each score is known to the driver:
    gains and noise lie within 50,000 thousandths either way, so that is a bounded table whatever the rows. It says
    where each score's ranks begin, so only rows of one score are ordered together.
    """
    counts = sorted(((r.score, r.n) for r in scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in counts) // 100
    starts, before = [], 0
    for score, n in counts:
        if before >= drawn:
            break
        starts.append((score, before))
        before += n
    first = F.broadcast(scored.sparkSession.createDataFrame(starts, "score long, before long"))
    near = scored.join(first, "score", "left").withColumn("before", F.when(F.col("n_words") >= least_words, F.col("before")))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    rank = (F.col("before") + place).cast("long")
    ranked = near.where("before is not null").withColumn("rank", F.when(rank <= drawn, rank))
    others = near.where("before is null").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).drop("before")


def resample(docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs (doc_id, text), drawn towards target (text)."""
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    scored = stage(with_score(weights(docs, gain, grams), seed), "resample-scores")
    return draw(scored, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
