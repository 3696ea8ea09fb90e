"""One-to-one matching of intervals and of speaker labels, clip by clip, and the scores built on it.

Candidate pairs come from a join; what is left of a clip, its pairs or its label matrix, is matched in order by a small
function over lists. A clip's size is bounded by a meeting's length, so no group grows with the number of clips.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from turnstone.operators.intervals import boundary_cuts, elementary_intervals, holding, interval_union, meeting, without


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared time over the time from the first start to the last end."""
    shared = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, shared / hull).otherwise(0.0)


def candidate_pairs(reference: DataFrame, predicted: DataFrame, least_iou: float) -> DataFrame:
    """clip_id, ref, pred, iou, boundary_ms of pairs (clip_id, id, start_ms, end_ms) of at least least_iou."""
    r = reference.select("clip_id", F.col("id").alias("ref"), F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"))
    p = predicted.select(F.col("clip_id").alias("p_clip"), F.col("id").alias("pred"), F.col("start_ms").alias("ps"), F.col("end_ms").alias("pe"))
    met = meeting(r, p, ("rs", "re"), ("ps", "pe"), "p_clip").withColumn("iou", iou(F.col("rs"), F.col("re"), F.col("ps"), F.col("pe"))).where(F.col("iou") >= least_iou)
    return met.select("clip_id", "ref", "pred", "iou", (F.abs(F.col("rs") - F.col("ps")) + F.abs(F.col("re") - F.col("pe"))).alias("boundary_ms"))


#: Clips whose pairs or cells a task holds as Python objects at once.
SOME_CLIPS = 256


def _by_clip(function, kind, arrow: pa.DataType):
    """A column of what function makes of each row's lists."""

    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for lists in parts:
            done = [pa.array([], arrow)]
            for at in range(0, len(lists[0]), SOME_CLIPS):
                done.append(pa.array([function(*row) for row in zip(*(x.slice(at, SOME_CLIPS).to_pylist() for x in lists), strict=True)], arrow))
            yield pa.concat_arrays(done)

    # Not twice for the filter that Spark puts before an explode.
    return F.arrow_udf(run, kind).asNondeterministic()


def _greedy(refs: list, preds: list) -> list[int]:
    """Places of the pairs that are kept, from 1."""
    used_refs, used_preds, kept = set(), set(), []
    for at, (ref, pred) in enumerate(zip(refs, preds, strict=True), 1):
        if ref not in used_refs and pred not in used_preds:
            used_refs.add(ref)
            used_preds.add(pred)
            kept.append(at)
    return kept


# Pandas frames by clip took milliseconds a clip; lists are as large and quick.
_kept = _by_clip(_greedy, ArrayType(IntegerType()), pa.list_(pa.int32()))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """Pairs in descending order of (iou, ref, pred), each side used once."""
    order = ["iou", "ref", "pred"]
    row = F.struct(*order, *(name for name in pairs.columns if name not in (*order, "clip_id")))
    listed = pairs.groupBy("clip_id").agg(F.sort_array(F.collect_list(row), asc=False).alias("listed"))
    chosen = listed.select("clip_id", "listed", F.explode(_kept(F.col("listed")["ref"], F.col("listed")["pred"])).alias("at"))
    return chosen.select("clip_id", F.element_at("listed", F.col("at")).alias("pair")).select("clip_id", "pair.*").select(*pairs.columns)


def event_scores(reference: DataFrame, predicted: DataFrame, least_iou: float = 0.3) -> DataFrame:
    """clip_id, n_ref, n_pred, n_matched, precision, recall, f1, boundary_mae_ms for every clip of either side.

    Without predictions precision is 1 if there is nothing to find, else 0; without references recall is 1. The mean
    boundary error is over matched pairs' starts and ends, null without any.
    """
    return _scores(reference, predicted, candidate_pairs(reference, predicted, least_iou))


def _scores(reference: DataFrame, predicted: DataFrame, pairs: DataFrame) -> DataFrame:
    matched = greedy_matches(pairs)
    counted = reference.select("clip_id", F.lit(1).alias("r"), F.lit(0).alias("p"), F.lit(0).alias("m"), F.lit(None).cast("long").alias("b"))
    counted = counted.unionByName(predicted.select("clip_id", F.lit(0).alias("r"), F.lit(1).alias("p"), F.lit(0).alias("m"), F.lit(None).cast("long").alias("b")))
    counted = counted.unionByName(matched.select("clip_id", F.lit(0).alias("r"), F.lit(0).alias("p"), F.lit(1).alias("m"), F.col("boundary_ms").alias("b")))
    sums = counted.groupBy("clip_id").agg(F.sum("r").alias("n_ref"), F.sum("p").alias("n_pred"), F.sum("m").alias("n_matched"), F.sum("b").alias("b"))
    precision = F.when(F.col("n_pred") > 0, F.col("n_matched") / F.col("n_pred")).otherwise((F.col("n_ref") == 0).cast("double"))
    recall = F.when(F.col("n_ref") > 0, F.col("n_matched") / F.col("n_ref")).otherwise(1.0)
    scored = sums.withColumn("precision", precision).withColumn("recall", recall)
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total > 0, F.round(2 * F.col("precision") * F.col("recall") / total, 6)).otherwise(0.0)
    mae = F.when(F.col("n_matched") > 0, F.round(F.col("b") / (2 * F.col("n_matched")), 3))
    return scored.select("clip_id", "n_ref", "n_pred", "n_matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), f1.alias("f1"), mae.alias("boundary_mae_ms"))


def interruption_scores(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """event_scores for events (clip_id, id, start_ms, end_ms, speakers) that share any time, between equal speaker pairs where both are known."""
    pairs = candidate_pairs(reference, predicted, 1e-9)
    named = lambda rows, x: rows.select("clip_id", F.col("id").alias(x), F.array_sort("speakers").alias(f"{x}_speakers"))
    pairs = pairs.join(named(reference, "ref"), ["clip_id", "ref"]).join(named(predicted, "pred"), ["clip_id", "pred"])
    unknown = (F.size("ref_speakers") < 2) | (F.size("pred_speakers") < 2)
    return _scores(reference, predicted, pairs.where(unknown | (F.col("ref_speakers") == F.col("pred_speakers"))).select("clip_id", "ref", "pred", "iou", "boundary_ms"))


def boundary_error(reference: DataFrame, predicted: DataFrame, mapping: DataFrame) -> DataFrame:
    """clip_id, n_matched, boundary_mae_ms: turns (id, speaker) matched greedily where they share time and the mapped speaker."""
    mapped = predicted.join(mapping.select("clip_id", F.col("pred_speaker").alias("speaker"), "mapped_to"), ["clip_id", "speaker"])
    pairs = candidate_pairs(reference, mapped, 1e-9)
    pairs = pairs.join(reference.select("clip_id", F.col("id").alias("ref"), F.col("speaker").alias("ref_speaker")), ["clip_id", "ref"]).join(mapped.select("clip_id", F.col("id").alias("pred"), "mapped_to"), ["clip_id", "pred"])
    matched = greedy_matches(pairs.where("ref_speaker = mapped_to").select("clip_id", "ref", "pred", "iou", "boundary_ms"))
    return matched.groupBy("clip_id").agg(F.count("*").alias("n_matched"), F.round(F.sum("boundary_ms") / (2 * F.count("*")), 3).alias("boundary_mae_ms"))


def best_assignment(weight: np.ndarray) -> list[int]:
    """For each row its column, or -1, so that the weights' sum is greatest.

    Shortest augmenting paths with potentials, in cubic time of a clip's labels.
    """
    rows, columns = weight.shape
    if rows > columns:
        out = [-1] * rows
        for column, row in enumerate(best_assignment(weight.T)):
            if row >= 0:
                out[row] = column
        return out
    cost = weight.max(initial=0) - weight.astype(float)
    u, v, owner = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for row in range(rows):
        best, before, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        at, column = row, -1
        while True:
            slack = cost[at] - u[at] - v
            better = ~done & (slack + 0.0 < best)
            best[better], before[better] = slack[better], column
            column = int(np.argmin(np.where(done, np.inf, best)))
            step = best[column]
            done[column] = True
            u[[row, *owner[done & (np.arange(columns) != column)]]] += step
            v[done & (np.arange(columns) != column)] -= step
            best[~done] -= step
            best[column] = 0.0
            at = int(owner[column])
            if at < 0:
                break
        while column >= 0:
            back = int(before[column])
            owner[column] = owner[back] if back >= 0 else row
            column = back
    out = [-1] * rows
    for column, row in enumerate(owner.tolist()):
        if row >= 0:
            out[row] = column
    return out


def _map_labels(refs: list, preds: list, shared: list) -> list[dict]:
    cells = [cell for cell in zip(refs, preds, shared, strict=True) if cell[0] is not None and cell[1] is not None]
    rows, columns = sorted({ref for ref, _, _ in cells}), sorted({pred for _, pred, _ in cells})
    table = np.zeros((len(rows), len(columns)), np.int64)
    at, to = {name: i for i, name in enumerate(rows)}, {name: i for i, name in enumerate(columns)}
    for ref, pred, ms in cells:
        table[at[ref], to[pred]] += ms or 0
    return [{"pred_speaker": columns[c], "mapped_to": rows[i], "overlap_ms": int(table[i, c])} for i, c in enumerate(best_assignment(table)) if c >= 0 and table[i, c] > 0]


_mapped = _by_clip(
    _map_labels, ArrayType(StructType([StructField("pred_speaker", StringType()), StructField("mapped_to", StringType()), StructField("overlap_ms", LongType())])),
    pa.list_(pa.struct([("pred_speaker", pa.string()), ("mapped_to", pa.string()), ("overlap_ms", pa.int64())])),
)


def map_speakers(matrix: DataFrame) -> DataFrame:
    """clip_id, pred_speaker, mapped_to, overlap_ms: labels one to one, with the greatest shared time (see speaker_overlap_matrix)."""
    listed = matrix.groupBy("clip_id").agg(F.collect_list(F.struct(F.col("ref_speaker").alias("r"), F.col("pred_speaker").alias("p"), F.coalesce("overlap_ms", F.lit(0)).cast("long").alias("ms"))).alias("cells"))
    cells = F.col("cells")
    return listed.select("clip_id", F.explode(_mapped(cells["r"], cells["p"], cells["ms"])).alias("m")).select("clip_id", "m.*")


def mapped_error(reference: DataFrame, predicted: DataFrame, mapping: DataFrame) -> DataFrame:
    """clip_id, ref_ms, missed_ms, false_alarm_ms, confused_ms, error: diarization error without collar.

    Each stretch between neighbouring boundaries of both sides has a set of reference and of mapped predicted speakers:
    with r, p of them and c in both, max(0, r - p) are missed, max(0, p - r) false alarms and min(r, p) - c confused.
    """
    renamed = predicted.join(mapping.select("clip_id", F.col("pred_speaker").alias("speaker"), "mapped_to"), ["clip_id", "speaker"], "left")
    renamed = renamed.select("clip_id", F.coalesce("mapped_to", F.concat(F.lit("?"), F.col("speaker"))).alias("speaker"), "start_ms", "end_ms", F.lit(False).alias("is_ref"))
    turns = reference.select("clip_id", "speaker", "start_ms", "end_ms", F.lit(True).alias("is_ref")).unionByName(renamed)
    pieces = elementary_intervals(turns).withColumnRenamed("clip_id", "piece_clip")
    held = holding(pieces.withColumnRenamed("piece_clip", "clip_id"), turns.withColumnRenamed("clip_id", "turn_clip"), "a", ("start_ms", "end_ms"), "turn_clip", "start_ms <= a and z <= end_ms and end_ms > start_ms")
    sets = held.groupBy("clip_id", "a", "z").agg(F.collect_set(F.when(F.col("is_ref"), F.col("speaker"))).alias("ref"), F.collect_set(F.when(~F.col("is_ref"), F.col("speaker"))).alias("pred"))
    r, p, both, ms = F.size("ref"), F.size("pred"), F.size(F.array_intersect("ref", "pred")), F.col("z") - F.col("a")
    zero = F.lit(0)
    sums = sets.groupBy("clip_id").agg(
        F.sum(ms * r).alias("ref_ms"), F.sum(ms * F.greatest(zero, r - p)).alias("missed_ms"), F.sum(ms * F.greatest(zero, p - r)).alias("false_alarm_ms"), F.sum(ms * (F.least(r, p) - both)).alias("confused_ms")
    )
    wrong = F.col("missed_ms") + F.col("false_alarm_ms") + F.col("confused_ms")
    return sums.withColumn("error", F.when(F.col("ref_ms") > 0, F.round(wrong / F.col("ref_ms"), 6)).otherwise(0.0))


def with_collar(turns: DataFrame, reference: DataFrame, collar_ms: int) -> DataFrame:
    """turns without the stretches within collar_ms of the reference's boundaries: clip_id, speaker, start_ms, end_ms."""
    return without(turns, boundary_cuts(reference, collar_ms))


def jaccard_error(reference: DataFrame, predicted: DataFrame, mapping: DataFrame) -> DataFrame:
    """clip_id, jer: mean over reference speakers of 1 - shared time over the time of either, with mapped labels."""
    mapped = predicted.join(mapping.select("clip_id", F.col("pred_speaker").alias("speaker"), "mapped_to"), ["clip_id", "speaker"]).select("clip_id", F.col("mapped_to").alias("speaker"), "start_ms", "end_ms")
    union = lambda rows: interval_union(rows.select("clip_id", "speaker", "start_ms", "end_ms"), "clip_id", "speaker")
    r, p = union(reference), union(mapped)
    length = lambda rows, name: rows.groupBy("clip_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(name))
    other = p.select(F.col("clip_id").alias("p_clip"), F.col("speaker").alias("p_speaker"), F.col("start_ms").alias("ps"), F.col("end_ms").alias("pe"))
    shared = meeting(r, other, ("start_ms", "end_ms"), ("ps", "pe"), "p_clip").where("speaker = p_speaker").groupBy("clip_id", "speaker").agg(F.sum(F.least("end_ms", "pe") - F.greatest("start_ms", "ps")).alias("both"))
    rows = length(r, "own").join(length(p, "said"), ["clip_id", "speaker"], "left").join(shared, ["clip_id", "speaker"], "left").na.fill(0, ["said", "both"])
    return rows.groupBy("clip_id").agg(F.round(F.avg(1 - F.col("both") / (F.col("own") + F.col("said") - F.col("both"))), 6).alias("jer"))
