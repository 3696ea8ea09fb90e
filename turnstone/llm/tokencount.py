"""Token counts by the whole-token shortcut.

A tokenizer cuts a text into pre-tokens and merges each by itself. Most pre-tokens are strings of its vocabulary that
come out as the one token they are, though not every string of a vocabulary does. So the model is asked once, before
any text is read, which strings do (``whole_tokens``); pre-tokens among those count 1, and only the rest is merged.

The tokenizer must drop white space, so that texts can be cut there and each different word needs its count once; one
that keeps it is refused. Words that hold one of its special strings go through the whole tokenizer, which makes them
one token by default. Null is empty, with no tokens; repeated rows stay; a null doc_id stays null. Long texts are cut at
white space, so a task holds a few megabytes of text at a time, or one word if that is longer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import map_batches, slices, split_words, to_batch, word_parts

LIMIT = 2048
#: Words whose counts a worker remembers; when full, it starts anew.
REMEMBERED = 500_000
#: Words that are cut into pre-tokens at once.
WORDS_AT_ONCE = 4096


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens, in the model's letters, that the model turns into one token: each string of the vocabulary is tried.

    The vocabulary's size bounds the set, whatever the texts.
    """
    with open(path, encoding="utf-8") as file:
        end = json.load(file)["model"].get("end_of_word_suffix") or ""
    tokenizer = _tokenizer(path)
    found = set()
    for string, number in tokenizer.get_vocab(with_added_tokens=False).items():
        bare = string.removesuffix(end)
        if bare and string.endswith(end) and [token.id for token in tokenizer.model.tokenize(bare)] == [number]:
            found.add(bare)
    return frozenset(found)


def drops_white_space(path: str) -> bool:
    """Whether words alone have the tokens that they have in a text."""
    encode = lambda text: _tokenizer(path).encode(text, add_special_tokens=False).ids
    return encode(" one \n\t two  3 ") == encode("one") + encode("two") + encode("3")


class TokenCounter:
    """Tokens of texts, by the proven whole tokens and the tokenizer's own normal form, cutting and merges."""

    def __init__(self, path: str, whole: frozenset[str], remembered: int = REMEMBERED):
        self.tokenizer, self.whole, self.remembered = _tokenizer(path), whole, remembered
        self.special = tuple(token.content for token in self.tokenizer.get_added_tokens_decoder().values())
        # Words that can't be cut among others: what they hold would hide where they end.
        self.alone = re.compile("|".join([r"^$", r"\s", *map(re.escape, self.special)])).search
        self.words: dict[str, int] = {}
        self.merged = 0

    def _pieces(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(text)

    def _normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _tokens(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        self.merged += 1
        return len(self.tokenizer.model.tokenize(piece))

    def _count_word(self, word: str) -> int:
        if any(string in word for string in self.special):
            return len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return sum(self._tokens(piece) for piece, _ in self._pieces(self._normal(word)))

    def _count_new(self, words: list[str]) -> list[int]:
        """Counts of some words, which are all cut at once. None may be empty, special or hold white space beyond ASCII."""
        normal = self._normal(" ".join(words))
        pieces = self._pieces(normal)
        ends = np.cumsum(np.fromiter(map(len, normal.split(" ")), np.int64, len(words)) + 1)
        owner = np.searchsorted(ends, np.fromiter((at for _, (at, _) in pieces), np.int64, len(pieces)), "right")
        tokens = np.fromiter((self._tokens(piece) for piece, _ in pieces), np.int64, len(pieces))
        return np.bincount(owner, tokens, minlength=len(words)).astype(np.int64).tolist()

    def _of_words(self, words: list[str]) -> np.ndarray:
        if len(self.words) + len(words) > self.remembered:
            self.words = {}
        new = [word for word in words if word not in self.words]
        alone = [word for word in new if self.alone(word)]
        if alone:
            self.words.update((word, self._count_word(word)) for word in alone)
            new = [word for word in new if word not in self.words]
        for start in range(0, len(new), WORDS_AT_ONCE):
            some = new[start : start + WORDS_AT_ONCE]
            self.words.update(zip(some, self._count_new(some), strict=True))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        for rows, parts in word_parts(texts):
            words, place, n = split_words(parts)
            tokens = self._of_words(words.to_pylist())[place] if len(words) else np.zeros(0, np.int64)
            np.add.at(total, np.repeat(rows, n), tokens)
        return total


_counters: dict[str, TokenCounter] = {}
_OUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64()}


def _count(path: str, whole):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:  # a worker keeps what it knows from task to task
            _counters[path] = TokenCounter(path, whole.value)
        for batch in slices(batches, 1):
            texts = batch.column(1)
            yield to_batch({"doc_id": batch.column(0), "n_bytes": pc.fill_null(pc.binary_length(texts), 0), "n_tokens": _counters[path].count(texts)}, _OUT)

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each row of docs (doc_id, text); other columns are not read.

    Nothing is shuffled. What is broadcast are the proven whole tokens, which the vocabulary bounds.
    """
    if not drops_white_space(tokenizer_path):
        raise ValueError(f"{tokenizer_path} keeps white space in its tokens, so its texts can't be counted by words")
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = map_batches(rows, _count(tokenizer_path, whole), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
