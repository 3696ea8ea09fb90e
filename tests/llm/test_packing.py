import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from turnstone.llm import packing
from turnstone.llm.queries import op8_packing, tokenizer_path

from .conftest import SF


def check(pieces, texts, length=4096):
    """Every id in one piece; sequences gapless and full but for the last."""
    plain = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = plain.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2]
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    total = sum(p.length for p in pieces)
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for number, own in by_sequence.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert sum(p.length for p in own) == min(length, total - number * length)


def test_round_trip_of_the_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(op8_packing(spark, SF).collect(), texts)


def test_odd_rows(spark, docs, no_docs):
    one = docs.dropDuplicates(["doc_id"])
    check(packing.pack(one, tokenizer_path(), length=256).collect(), {r.doc_id: r.text for r in one.collect()}, 256)
    assert packing.pack(docs, tokenizer_path()).groupBy().sum("length").first()[0] == packing.pack(one, tokenizer_path()).groupBy().sum("length").first()[0] + packing.pack(one.where("doc_id = 5"), tokenizer_path()).groupBy().sum("length").first()[0]
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_tokenizer_agrees_on_odd_text():
    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["a\x1cb\x85c d e", "İstanbul ΣΑΣ don't I'LL x<|endoftext|>y", "é ́x", "日本語 text 123", "�\U0001f600"]
    ids, n = packing.WordTokenizer(tokenizer_path(), remembered=3).encode(pa.array([*texts, None, "", "  x  "]))
    assert n.sum() == len(ids) and n[-3:].tolist()[:2] == [0, 0]
    for text, own in zip([*texts, "", "", "  x  "], np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize("tokens", [[5000, 3, 70000, 1], [1], [40, 40, 40], [10**5] * 32])
def test_rounds(tokens, kind):
    rounds = packing.Rounds(tokens, 64)
    rounds.tokens = rounds.tokens.astype(kind)
    n = -(-sum(tokens) // 64)
    sent = rounds.sent(np.arange(n + 1))
    assert (np.diff(sent, axis=0) >= 0).all() and sent[-1].tolist() == tokens
    assert (np.abs(sent - np.minimum(np.arange(n + 1) * 64, sum(tokens))[:, None] * np.array(tokens) / sum(tokens)) < len(tokens)).all()
    for queue, own in enumerate(tokens):
        place = np.unique(np.linspace(0, own - 1, 500).astype(np.int64))
        at = rounds.sequence_of(np.full(len(place), queue), place)
        assert (sent[at, queue] <= place).all() and (sent[at + 1, queue] > place).all()


def test_windows_hold_the_share_of_small_sources(spark):
    rows = [(s * 40 + i, f"s{s:02}", "the cat sat " * (20 + (s + i) % 7)) for s in range(100) for i in range(40)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string"), tokenizer_path()).collect()
    check(pieces, {i: text for i, _, text in rows})
    total, by_source, by_window = sum(p.length for p in pieces), defaultdict(int), defaultdict(int)
    for p in pieces:
        by_source[p.source] += p.length
        by_window[p.sequence_id, p.source] += p.length
    for number in range(total // 4096):
        assert all(abs(by_window[number, source] - 4096 * n / total) < 3 for source, n in by_source.items())


def test_rounds_of_sources_below_a_token_a_sequence():
    tokens = [3000, 5, 1] + [40] * 60
    rounds = packing.Rounds(tokens, 64)
    n = -(-sum(tokens) // 64)
    sent = rounds.sent(np.arange(n + 1))
    assert (np.diff(sent, axis=0) >= 0).all() and sent[-1].tolist() == tokens
    assert sent.sum(axis=1).tolist() == [min(i * 64, sum(tokens)) for i in range(n + 1)]
    found = rounds.pieces(np.arange(len(tokens)), np.zeros(len(tokens), np.int64), np.array(tokens))
    place = sorted(zip(found["sequence"].tolist(), found["offset"].tolist(), found["length"].tolist(), strict=True))
    assert [s * 64 + o for s, o, _ in place] == list(np.cumsum([0] + [k for _, _, k in place])[:-1]) and sum(k for _, _, k in place) == sum(tokens)
