import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnstone.llm import tokencount
from turnstone.llm.common import word_parts
from turnstone.llm.queries import op13_token_counts, tokenizer_path

from .conftest import SF

PATH = tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)
WHOLE = tokencount.whole_tokens(PATH)


def plain(text) -> int:
    return len(PLAIN.encode(text or "", add_special_tokens=False).ids)


def test_query_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {r.doc_id: (len((r.text or "").encode()), plain(r.text), plain(r.text) > 2048) for r in docs}
    got = op13_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == expected and len(got) == len(docs)


def test_whole_tokens_are_proven_one_by_one():
    vocabulary = PLAIN.get_vocab(with_added_tokens=False)
    for string in sorted(WHOLE)[::50]:
        assert [token.id for token in PLAIN.model.tokenize(string)] == [vocabulary[f"{string}</w>"]]
    left_out = [s.removesuffix("</w>") for s in vocabulary if s.endswith("</w>") and s.removesuffix("</w>") and s.removesuffix("</w>") not in WHOLE]
    assert all(len(PLAIN.model.tokenize(s)) > 1 or PLAIN.model.tokenize(s)[0].id != vocabulary[f"{s}</w>"] for s in left_out[:2000])


def test_shortcut_leaves_whole_tokens_unmerged():
    counter = tokencount.TokenCounter(PATH, WHOLE)
    assert counter.count(pa.array(["the cat sat on the mat , the end ."])).tolist() == [10] and counter.merged == 0
    counter.count(pa.array(["xqzzv"]))
    assert counter.merged == 1


ODD = [
    "a\x1cb\x85c d e", "İstanbul ΣΑΣ don't I'LL x<|endoftext|>y <|startoftext|>", "é ́x", "日本語 text 123", "�\U0001f600", "'s 's's don''t", "   ", "<|endoftext|>" * 3,
    "Ǻ K ſ ß ŉ", "x" * 5000, "no break", "१२३ ٣ ½ ²",
]


def test_odd_texts():
    counter = tokencount.TokenCounter(PATH, WHOLE, remembered=5)
    for texts in (ODD, [" ".join(ODD), None, "", "  x  "]):
        assert counter.count(pa.array(texts)).tolist() == [plain(text) for text in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aAéÉßÀ́İ' .,!<|>19\n\t\xa0 日の", "'s", "ing", "the ", "<|endoftext|>"]), max_size=40).map("".join), max_size=4))
def test_any_text(texts):
    assert tokencount.TokenCounter(PATH, WHOLE).count(pa.array(texts, pa.string())).tolist() == [plain(text) for text in texts]


def test_odd_rows(spark, docs, no_docs):
    clashing = docs.withColumns({"n_tokens": F.lit("x"), "n_bytes": F.lit("x"), "over_limit": F.lit("x"), "whole": F.lit(1)}).union(docs.where("doc_id = 1").selectExpr("cast(null as long)", "text", "lang", "source", "size", "'x'", "'x'", "'x'", "1"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(clashing, PATH).collect()), key=str)
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), plain(r.text), plain(r.text) > 2048) for r in clashing.collect()), key=str)
    assert tokencount.count_tokens(no_docs, PATH).count() == 0
    assert [r.over_limit for r in tokencount.count_tokens(docs.where("doc_id = 1"), PATH, limit=7).collect()] == [False]
    assert [r.over_limit for r in tokencount.count_tokens(docs.where("doc_id = 1"), PATH, limit=6).collect()] == [True]


def test_long_texts(spark):
    text = "The cat, sat on zqxv mats. " * 400_000  # 11 MB
    rows = spark.createDataFrame([(1, text), (2, "q" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(rows, PATH).collect()}
    assert got == {1: 400_000 * plain("The cat, sat on zqxv mats."), 2: plain("q" * 300_000)}


@pytest.mark.parametrize("limit", [1, 3, 8, 1000])
def test_parts_are_whole_texts_cut_at_blanks(limit):
    texts = pa.array(["zero", "aa bb  cc ddddddddddddddd e", None, "", "x\ty", "é é é é", " lead", "trail "]).slice(1)
    joined, last = [b""] * len(texts), -1
    for rows, parts in word_parts(texts, limit=limit):
        assert rows[0] >= last
        last = rows[-1]
        for row, part in zip(rows.tolist(), parts.to_pylist(), strict=True):
            assert not joined[row] or part[:1] in " \t"
            joined[row] += part.encode()
    assert joined == [(text or "").encode() for text in texts.to_pylist()]


def test_a_tokenizer_that_keeps_white_space_is_refused(spark, docs):
    with pytest.raises(ValueError, match="white space"):
        tokencount.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    assert np.array(tokencount.TokenCounter(PATH, frozenset()).count(pa.array(["the cat"]))).tolist() == [2]
