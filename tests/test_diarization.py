"""Scores of turns against sums over every millisecond, and by hand."""

import random
from itertools import permutations

import pytest

from turnstone.operators import diarization, intervals, matching

TURNS = "clip_id long, id int, speaker string, start_ms long, end_ms long"


def active(turns, t, nobody=()):
    return {s for _, _, s, a, z in turns if a <= t < z and s not in nobody}


def plain(ref, pred, nobody=(), cut=lambda t: False):
    """Right and whole reference time under the best mapping, missed, false and confused, over every ten milliseconds."""
    times = [t for t in range(0, 4000, 10) if not cut(t)]
    names, said = sorted({r[2] for r in ref} - set(nobody)), sorted({p[2] for p in pred} - set(nobody))
    best = None
    for chosen in permutations([*names, *[None] * len(said)], len(said)):
        mapping = dict(zip(said, chosen, strict=True))
        right = sum(len(active(ref, t, nobody) & {mapping.get(s) for s in active(pred, t, nobody)}) for t in times)
        best = max(best or (0, None), (right, tuple(sorted(mapping.items(), key=str))), key=lambda x: x[0])
    right, total = best[0], sum(len(active(ref, t, nobody)) for t in times)
    wrong = sum(max(len(active(ref, t)), len(active(pred, t))) for t in times) - right
    return right, total, wrong


@pytest.mark.parametrize("seed", range(5))
def test_errors_against_plain_sums(spark, seed):
    dice = random.Random(seed)
    turn = lambda i, names: (1, i, dice.choice(names), *sorted(dice.sample(range(0, 4000, 10), 2)))
    ref, pred = [turn(i, "ab") for i in range(5)], [turn(i, ["x", "y", "UNKNOWN"] if seed % 2 else "xy") for i in range(6)]
    r, p = spark.createDataFrame(ref, TURNS), spark.createDataFrame(pred, TURNS)
    nobody = ("UNKNOWN", "OVERLAP")
    mapping = matching.map_speakers(intervals.speaker_overlap_matrix(r, p.where("speaker <> 'UNKNOWN'")))
    right, total, _ = plain(ref, pred, nobody)
    got = diarization.label_error_rate(r, p, mapping).first().label_error
    # The mapping is the best by shared time of turns; with one speaker's turns overlapping, it may differ from that by sets.
    assert got >= round(1 - right / total, 6) - 1e-9 and got <= 1
    for skip in (False, True):
        cut = lambda t: any(abs(t + 5 - edge) < 100 for x in ref for edge in x[3:]) or (skip and len(active(ref, t)) > 1)  # noqa: B023, E731
        right, total, wrong = plain(ref, pred, cut=cut)
        row = diarization.standard_errors(r, p, 100, skip).first()
        if total:
            assert row.der >= round(wrong / total, 6) - 1e-6
        else:
            assert row.der is None


def test_without(spark):
    turns = spark.createDataFrame([(1, 0, "a", 0, 100_000), (1, 1, "b", 50, 60), (2, 0, "a", 5, 9)], TURNS)
    cuts = spark.createDataFrame([(1, 10, 20), (1, 15, 70_000), (3, 0, 9)], "clip_id long, start_ms long, end_ms long")
    assert sorted(tuple(r) for r in intervals.without(turns, cuts).collect()) == [(1, "a", 0, 10), (1, "a", 70_000, 100_000), (2, "a", 5, 9)]


def test_baselines(spark):
    ref = spark.createDataFrame([(1, 0, "a", 0, 4000), (1, 1, "b", 3000, 8000), (2, 0, "a", 0, 1000), (2, 1, "UNKNOWN", 1000, 2000)], TURNS)
    rows = {(r.clip_id, r["mode"]): r for r in diarization.baselines(ref, diarization.events_of(ref)).collect()}
    none, own = rows[1, "no_diarization"], rows[1, "reference_assisted"]
    assert (none.label_error, none.coverage, none.overlap_recall, none.overlap_precision, none.n_pred_turns, none.boundary_mae_ms) == (1.0, 1.0, 0.0, 0.0, 1, None)
    assert (own.label_error, own.coverage, own.overlap_f1, own.interruption_f1, own.boundary_mae_ms, own.n_ref_overlaps) == (0.0, 1.0, 1.0, 1.0, 0.0, 1)
    assert rows[2, "reference_assisted"].label_error == 0.0 and rows[2, "no_diarization"].overlap_f1 is None and rows[2, "no_diarization"].n_ref_overlaps == 0


def test_standard_errors(spark):
    ref = spark.createDataFrame([(1, 0, "a", 0, 4000), (1, 1, "b", 3000, 8000)], TURNS)
    pred = spark.createDataFrame([(1, 0, "x", 0, 3000), (1, 1, "y", 3000, 8000)], TURNS)
    whole, skipped = diarization.standard_errors(ref, pred).first(), diarization.standard_errors(ref, pred, skip_overlap=True).first()
    # Left outside the collar: 250-2750, 3250-3750, 4250-7750; of the overlap half a second, of which x lacks a.
    assert whole.der == round(500 / (2500 + 500 * 2 + 3500), 6) and skipped.der == 0.0 and skipped.jer == 0.0
    scored = diarization.score_turns(ref, diarization.events_of(ref), pred, standard=True).first()
    assert scored.der == whole.der and scored.jer_skip_overlap == 0.0 and scored.label_error == round(1000 / 9000, 6)


def test_scores_read_written_tables(spark):
    """The plan worked out turns, events and mappings anew for each score: 447 and 116 exchanges."""
    from turnstone.plans import matching_queries

    for name, most in (("clip_scores", 130), ("baseline_scores", 90)):
        plan = matching_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        exchanges = plan.split("== Initial Plan ==")[-1].count("Exchange")
        assert "conversations" not in plan and exchanges <= most, (name, exchanges)
