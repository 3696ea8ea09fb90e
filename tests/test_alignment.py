"""The alignment against a plain one, and the categories of known errors."""

import random
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.operators import alignment, edit_errors

from .compare import connect

_TOKENS = st.lists(st.sampled_from("abcdef"), max_size=30)


def plain(a, b, autojunk=False):
    return [code for code in SequenceMatcher(None, a, b, autojunk=autojunk).get_opcodes() if code[0] != "equal"]


@settings(max_examples=400, deadline=None)
@given(_TOKENS, _TOKENS)
def test_edits_equal_a_plain_alignment(a, b):
    assert list(alignment.edits_between(a, b)) == plain(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefghijklmnopqrstuvwxyz0123456789"), min_size=190, max_size=260), st.randoms(use_true_random=False))
def test_common_tokens_begin_no_block(a, random):
    b = [random.choice("aaab012") if random.random() < 0.3 else token for token in a]
    b += ["a"] * (210 - len(b))
    assert list(alignment.edits_between(a, b, leave_out_common=True)) == plain(a, b, autojunk=True)


def test_long_texts():
    a = [f"w{i % 1700}" for i in range(20_000)]
    b = [token for i, token in enumerate(a) if i % 97]
    assert list(alignment.edits_between(a, b)) == [("delete", i, i + 1, i - k, i - k) for k, i in enumerate(range(0, 20_000, 97))]


def test_columns(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"]), (2, [], ["a"]), (3, ["a"], []), (4, None, None), (5, ["a"], ["a"])], "id int, a array<string>, b array<string>")
    edited = rows.withColumn("edited", alignment.edits(F.col("a"), F.col("b")))
    got = {r.id: r for r in edited.select("id", "edited", F.array(*alignment.removed_and_added(F.col("a"), F.col("b"), F.col("edited"))).alias("moved"), alignment.similarity(F.col("a"), F.col("b"), F.col("edited")).alias("ratio")).collect()}
    assert [tuple(e) for e in got[1].edited] == [("replace", 1, 2, 1, 2), ("insert", 3, 3, 3, 4)] and got[1].moved == [["b"], ["x", "d"]]
    assert got[1].ratio == SequenceMatcher(None, "abc", "axcd").ratio() and got[5].ratio == 1.0
    assert [tuple(e) for e in got[2].edited] == [("insert", 0, 0, 0, 1)] and [tuple(e) for e in got[3].edited] == [("delete", 0, 1, 0, 0)] and got[4].edited == got[5].edited == []


CASES = [
    ("replace", "262 cents a", "262 seems to", "number_unit_error"), ("replace", "gonna", "going to", "disfluency_or_style_error"), ("replace", "going to", "gonna", "disfluency_or_style_error"),
    ("replace", "may five", "may", "date_time_error"), ("delete", "dividend", "", "domain_term_error"), ("delete", "well well", "", "disfluency_or_style_error"), ("replace", "he", "she", "function_word_error"),
    ("insert", "", "content", "omission_or_insertion"), ("replace", "house", "mouse", "semantic_word_error"), ("replace", "2021", "twenty", "date_time_error"), ("insert", "", "uh", "disfluency_or_style_error"),
]


def test_categories_of_single_edits(spark):
    rows = spark.createDataFrame([(op, a.split(), b.split(), want) for op, a, b, want in CASES], "op string, a array<string>, b array<string>, want string")
    named = rows.withColumn("category", edit_errors.category(F.col("op"), F.col("a"), F.col("b"))).collect()
    assert [(r.a, r.category) for r in named] == [(r.a, r.want) for r in named]


def test_a_row_with_a_wrong_number_and_its_summaries(spark):
    row = ("clip", "Earnings-22", "en", "base", "0.2", "0.18", "a dividend at 262 cents a share".split(), "a dividend at 262 seems to share".split())
    clean = ("clean", "Earnings-22", "en", "large", "", None, ["same"], ["same"])
    rows = spark.createDataFrame([row, clean], "clip_id string, dataset_name string, language string, model_name string, error_rate string, cleaned_error_rate string, reference array<string>, hypothesis array<string>")
    keys = ["dataset_name", "language", "model_name"]
    errors = edit_errors.classify(rows, [*keys, "clip_id"])
    only = errors.collect()
    assert [(r.op, r.category, r.impact, r.removed, r.added) for r in only] == [("replace", "number_unit_error", "meaning_likely_changed", ["cents", "a"], ["seems", "to"])]
    assert "numeric-unit" in only[0].recommendation
    summed = edit_errors.category_summary(rows, errors, keys, ["clip_id", "place"]).collect()
    assert [(r.category, r.n, r.share, r.mean_wer, r.mean_cleaned_wer, r.example_reference) for r in summed] == [("number_unit_error", 1, 1.0, 0.2, 0.18, "cents a")]
    models = {r.model_name: r for r in edit_errors.model_summary(rows, errors, keys, ["clip_id", "place"]).collect()}
    assert models["base"].top_categories == '[["number_unit_error", 1]]' and models["base"].gap == 0.02
    assert models["large"].top_categories == "[]" and models["large"].mean_wer == 0.0


@pytest.mark.parametrize("leave_out", [False, True])
def test_the_sql_of_edits(leave_out):
    import random

    from turnstone.plans.edit_queries import edits_sql

    dice = random.Random(7)
    pairs = [(i, [dice.choice("abcdefgh") for _ in range(dice.choice([0, 3, 40, 230]))], [dice.choice("aaabcdefgh") for _ in range(dice.choice([0, 5, 40, 240]))]) for i in range(25)]
    con = connect("/root/testdata/sf0.001")
    con.sql("create table pairs (id bigint, a varchar[], b varchar[])")
    con.executemany("insert into pairs values (?, ?, ?)", pairs)
    got = con.sql(f"with recursive {edits_sql(leave_out)} select id, op, a0, a1, b0, b1 from edits order by id, place").fetchall()
    assert got == [(i, *edit) for i, a, b in pairs for edit in plain(a, b, autojunk=leave_out)]


def test_errors_are_aligned_once_in_slices(spark, monkeypatch):
    """The filter before an explode had each pair aligned four times, and a summary two times more; a batch was Python objects as a whole."""
    from turnstone.plans import edit_queries

    for name in ("edit_categories", "edit_category_summary", "edit_model_summary"):
        plan = getattr(edit_queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert sum("ArrowEvalPython [run(" in line for line in plan.splitlines()) == 1, name
    rows = [(i, ["a", "b", None, "c"][: i % 5] or None, list("abc" * (i % 3))) for i in range(alignment.SOME_ROWS * 2 + 3)]
    frame = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").coalesce(1)
    got = {r.id: [tuple(e) for e in r.edited] for r in frame.select("id", alignment.edits(F.col("a"), F.col("b")).alias("edited")).collect()}
    assert got == {i: list(alignment.edits_between(a or [], b)) for i, a, b in rows}


def test_letters_changed_are_levenshteins(spark):
    """Spark's own filled a table of letters by letters for each pair of whole turns."""
    dice = random.Random(11)
    word = lambda n, letters: "".join(dice.choice(letters) for _ in range(n))
    pairs = [(word(dice.randint(0, 90), letters), word(dice.randint(0, 90), letters)) for letters in ("ab", "abcdefgh ", "aé😀ß") for _ in range(60)]
    middle = [(head + a + tail, head + b + tail) for a, b in pairs[:60] for head, tail in [(word(40, "ab"), word(40, "ab"))]]
    rows = [*pairs, *middle, ("", ""), ("", "abc"), ("abc", "abcabc"), (None, "a"), ("a", None)]
    frame = spark.createDataFrame(rows, "a string, b string").select(alignment.distance("a", "b").alias("own"), F.levenshtein("a", "b").alias("right"))
    assert frame.where(~F.col("own").eqNullSafe(F.col("right"))).count() == 0
    long = "letters in turn " * 2000
    began = time.process_time()
    assert alignment.letters_changed(long, "x" + long + "y") == 2 and alignment.letters_changed("a" + long, long[:-1] + "b") == 2
    assert time.process_time() - began < 20


def test_features_of_decisions_fill_no_table_of_letters(spark):
    from turnstone.operators import gate_features

    rows = spark.createDataFrame([("we use piano note", "we use pyannote")], "raw_text string, corrected_text string")
    featured = gate_features.features(rows)
    assert "levenshtein" not in featured._jdf.queryExecution().optimizedPlan().toString().lower()
    assert featured.select("edit_distance_ratio").first() == rows.select(F.levenshtein("raw_text", "corrected_text") / 17).first()
