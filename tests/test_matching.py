import random
from itertools import permutations

import numpy as np
import pytest

from turnstone.operators import matching


def test_greedy_matches_use_each_side_once(spark):
    ref = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 200), (2, 1, 0, 50)], "clip_id long, id long, start_ms long, end_ms long")
    pred = spark.createDataFrame([(1, 1, 10, 100), (1, 2, 20, 120), (3, 1, 0, 5)], "clip_id long, id long, start_ms long, end_ms long")
    rows = {r.clip_id: r for r in matching.event_scores(ref, pred).collect()}
    assert (rows[1].n_matched, rows[1].precision, rows[1].recall, rows[1].f1, rows[1].boundary_mae_ms) == (1, 0.5, 0.5, 0.5, 5.0)
    assert (rows[2].precision, rows[2].recall, rows[2].f1, rows[2].boundary_mae_ms) == (0.0, 0.0, 0.0, None)
    assert (rows[3].precision, rows[3].recall) == (0.0, 1.0)


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 4), (4, 2)])
def test_assignment_against_all_permutations(shape):
    rng = np.random.default_rng(8)
    for _ in range(20):
        weight = rng.integers(0, 9, shape)
        chosen = matching.best_assignment(weight)
        used = [c for c in chosen if c >= 0]
        small = weight if shape[0] <= shape[1] else weight.T
        best = max(sum(small[i, c] for i, c in enumerate(p)) for p in permutations(range(small.shape[1]), small.shape[0]))
        assert len(set(used)) == len(used) and sum(weight[i, c] for i, c in enumerate(chosen) if c >= 0) == best


def test_mapped_error(spark):
    schema = "clip_id long, speaker string, start_ms long, end_ms long"
    ref = spark.createDataFrame([(1, "A", 0, 100), (1, "B", 100, 200)], schema)
    pred = spark.createDataFrame([(1, "x", 0, 90), (1, "y", 110, 200), (1, "x", 150, 200)], schema)
    mapping = spark.createDataFrame([(1, "x", "A", 90), (1, "y", "B", 90)], "clip_id long, pred_speaker string, mapped_to string, overlap_ms long")
    row = matching.mapped_error(ref, pred, mapping).first()
    assert (row.ref_ms, row.missed_ms, row.false_alarm_ms, row.confused_ms, row.error) == (200, 20, 50, 0, 0.35)


EVENTS = "clip_id long, id long, start_ms long, end_ms long, speakers array<string>"


def test_interruptions_match_between_equal_speakers_alone(spark):
    ref = spark.createDataFrame([(1, 1, 0, 100, ["A", "B"]), (1, 2, 200, 300, ["A", "B"])], EVENTS)
    pred = spark.createDataFrame([(1, 1, 90, 150, ["B", "A"]), (1, 2, 200, 300, ["A", "C"]), (1, 3, 250, 260, [])], EVENTS)
    row = matching.interruption_scores(ref, pred).first()
    assert (row.n_ref, row.n_pred, row.n_matched, row.precision, row.recall, row.f1) == (2, 3, 2, 0.666667, 1.0, 0.8)


def test_boundary_error_of_mapped_speakers(spark):
    turns = "clip_id long, id long, speaker string, start_ms long, end_ms long"
    ref = spark.createDataFrame([(1, 1, "A", 0, 100), (1, 2, "B", 100, 200)], turns)
    pred = spark.createDataFrame([(1, 1, "x", 10, 100), (1, 2, "y", 90, 230), (1, 3, "z", 0, 100)], turns)
    mapping = spark.createDataFrame([(1, "x", "A"), (1, "y", "B")], "clip_id long, pred_speaker string, mapped_to string")
    row = matching.boundary_error(ref, pred, mapping).first()
    assert (row.n_matched, row.boundary_mae_ms) == (2, (10 + 0 + 10 + 30) / 4)


def test_collar_and_jaccard(spark):
    schema = "clip_id long, speaker string, start_ms long, end_ms long"
    ref = spark.createDataFrame([(1, "A", 0, 1000), (1, "B", 1000, 2000)], schema)
    pred = spark.createDataFrame([(1, "x", 0, 1100), (1, "y", 1100, 2000)], schema)
    mapping = spark.createDataFrame([(1, "x", "A", 1000), (1, "y", "B", 900)], "clip_id long, pred_speaker string, mapped_to string, overlap_ms long")
    left = {tuple(r) for r in matching.with_collar(pred, ref, 250).collect()}
    assert left == {(1, "x", 250, 750), (1, "y", 1250, 1750)}
    error = matching.mapped_error(matching.with_collar(ref, ref, 250), matching.with_collar(pred, ref, 250), mapping).first()
    assert (error.ref_ms, error.error) == (1000, 0.0)
    assert matching.jaccard_error(ref, pred, mapping).first().jer == round((1 - 1000 / 1100 + 1 - 900 / 1000) / 2, 6)


def test_clips_are_matched_as_lists(spark):
    """Frames of pandas by clip took milliseconds each, twice for each of the three, so seconds grew with the clips."""
    dice = random.Random(3)
    rows = [(clip, dice.randint(0, 4), dice.randint(0, 4), dice.choice([0.5, 0.5, 0.25]), dice.randint(0, 9)) for clip in range(600) for _ in range(6)]
    rows = [(*key, pair[0], pair[1]) for key, pair in {row[:3]: row[3:] for row in rows}.items()]
    pairs = spark.createDataFrame(rows, "clip_id long, ref long, pred long, iou double, boundary_ms long")
    found = matching.greedy_matches(pairs)
    wanted = []
    for clip in range(600):
        refs, preds = set(), set()
        for row in sorted((r for r in rows if r[0] == clip), key=lambda r: (r[3], r[1], r[2]), reverse=True):
            if row[1] not in refs and row[2] not in preds:
                refs.add(row[1]), preds.add(row[2]), wanted.append(row)
    assert found.columns == pairs.columns and sorted(map(tuple, found.collect())) == sorted(wanted)
    cells = spark.createDataFrame([(1, "a", "x", 5), (1, "a", "x", 4), (1, "b", "x", 8), (1, None, "y", 9), (1, "b", "y", None), (2, "a", None, 3)], "clip_id long, ref_speaker string, pred_speaker string, overlap_ms long")
    mapped = matching.map_speakers(cells)
    assert sorted(map(tuple, mapped.collect())) == [(1, "x", "a", 9)]
    plans = [frame.select("*")._jdf.queryExecution().executedPlan().toString() for frame in (found, mapped)]
    assert all("Pandas" not in plan and sum("ArrowEvalPython [" in line for line in plan.splitlines()) == 1 for plan in plans)
