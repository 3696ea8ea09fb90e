"""Language ID by hyperdimensional profiles.

Every letter has a random bipolar vector. An n-gram's vector binds its letters' vectors, each permuted by its place; a
language's prototype bundles the vectors of all n-grams of its texts; a text gets the language whose prototype has the
largest cosine with the text's own bundle. Bundling is a sum, so texts are first counted by n-gram and each distinct
n-gram is bound once.

Letters are Unicode letters, lower-cased; every run of other characters is one blank, which has a vector too. A text
that is null or has no letter is ``und`` with score 0. Equal cosines go to the smaller language name. Without any
training text all predictions are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import map_batches, slices, to_batch

DIMENSIONS = 1024
SEED = 20260
BLANK = 32
#: Texts whose bundles are made in one matrix product.
TEXTS_AT_ONCE = 64
#: Bytes of text that are cut into n-grams at once.
TEXT_BYTES = 1 << 20
_MARK = 0x10FFFF


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, with blanks around and between words, and the text that each belongs to."""
    joined = chr(_MARK).join(["", *(text.lower().replace(chr(_MARK), " ") for text in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = points == _MARK
    owner = np.cumsum(mark) - 1
    letter = _is_letter()[points]
    points = np.where(letter, points, np.uint32(BLANK))
    kept = letter | mark
    kept[1:] |= ~letter[1:] & letter[:-1]
    return points[kept], owner[kept]


def gram_counts(texts: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the three-letter grams of texts by group: group, gram (three code points in 63 bits), count."""
    points, owner = _letters(texts)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols, at = np.unique(points, return_inverse=True) if points.max() > 0xFFFF else _small_unique(points)
    n = len(symbols)
    first, second, third = at[:-2], at[1:-1], at[2:]
    blank = np.searchsorted(symbols, BLANK)
    whole = second != blank
    code = ((first * n + second) * n + third)[whole]
    group = groups[owner[1:-1][whole]]
    if n**3 <= 1 << 23:
        present = np.flatnonzero(np.bincount(code, minlength=n**3))
        place = np.zeros(n**3, np.int64)
        place[present] = np.arange(len(present))
        cell = group * len(present) + place[code]
    else:
        present, inverse = np.unique(code, return_inverse=True)
        cell = group * len(present) + inverse
    if not len(present):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = np.bincount(cell)
    used = np.flatnonzero(table)
    gram = present[used % len(present)]
    wide = symbols.astype(np.int64)
    return used // len(present), (wide[gram // (n * n)] << 42) | (wide[gram // n % n] << 21) | wide[gram % n], table[used]


def _small_unique(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(0x10000, bool)
    seen[points] = True
    symbols = np.flatnonzero(seen)
    place = np.zeros(0x10000, np.int64)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[points]


@cache
def _letter_vector(point: int, dimensions: int, shift: int) -> np.ndarray:
    bits = np.random.default_rng([SEED, point]).integers(0, 2, dimensions, np.int8)
    return np.roll(bits * 2 - 1, shift).astype(np.int8)


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of grams: the first letter permuted twice, the second once, the third not."""
    bound = np.ones((len(grams), dimensions), np.int8)
    for shift, bits in ((2, 42), (1, 21), (0, 0)):
        points, place = np.unique((grams >> bits) & 0x1FFFFF, return_inverse=True)
        bound *= np.stack([_letter_vector(int(p), dimensions, shift) for p in points])[place] if len(points) else bound
    return bound


_COUNTS = {"lang": pa.string(), "gram": pa.int64(), "n": pa.int64()}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0, TEXT_BYTES):
        langs, group = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
        group, gram, n = gram_counts([text or "" for text in batch.column(0).to_pylist()], group)
        yield to_batch({"lang": langs[group].tolist(), "gram": gram, "n": n}, _COUNTS)


_PARTS = {"lang": pa.string(), "dimension": pa.int32(), "value": pa.int64()}


def _bundle(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            gram, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for start in range(0, len(lang), 4096):
                part = slice(start, start + 4096)
                vectors = gram_vectors(gram[part], dimensions).astype(np.float64)
                for name in set(lang[part]):
                    sums[name] = sums.get(name, 0) + (n[part] * (lang[part] == name)).astype(np.float64) @ vectors
        for name, total in sums.items():
            yield to_batch({"lang": [name] * dimensions, "dimension": np.arange(dimensions, dtype=np.int32), "value": total.astype(np.int64)}, _PARTS)

    return run


def train(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype for each language of labelled (text, lang), from all texts whose lang isn't null.

    Spark counts the n-grams of each language and bundles them. The driver gets one vector for each language, which
    doesn't grow with the texts, but does with the different values of lang: 8 KB each, so clean that column first.
    """
    known = labelled.where("lang is not null and text is not null").select("text", "lang")
    counts = map_batches(known, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = counts.mapInArrow(_bundle(dimensions), "lang string, dimension int, value long")
    prototypes: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "dimension").agg(F.sum("value").alias("value")).collect():
        prototypes.setdefault(row.lang, np.zeros(dimensions))[row.dimension] = row.value
    return prototypes


_PREDICTED = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64()}


def _predict(names: list[str], unit: np.ndarray, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, TEXT_BYTES):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            for start in range(0, len(texts) if names else 0, TEXTS_AT_ONCE):
                some = texts[start : start + TEXTS_AT_ONCE]
                group, gram, n = gram_counts(some, np.arange(len(some)))
                if not len(gram):
                    continue
                grams, place = np.unique(gram, return_inverse=True)
                counts = np.zeros((len(some), len(grams)), np.float32)
                counts[group, place] = n
                bundles = counts @ gram_vectors(grams, dimensions).astype(np.float32)
                length = np.linalg.norm(bundles, axis=1)
                cosine = (bundles @ unit.T) / np.maximum(length, 1e-9)[:, None]
                best = np.argmax(cosine, axis=1)
                has = np.bincount(group, minlength=len(some)) > 0
                rows = start + np.flatnonzero(has)
                lang[rows] = np.array(names, dtype=object)[best[has]]
                score[rows] = np.clip(cosine[np.arange(len(some)), best][has], 0, 1)
            yield to_batch({"doc_id": batch.column(0), "lang_pred": lang.tolist(), "score": np.round(score, 4)}, _PREDICTED)

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs (doc_id, text). Repeated rows stay."""
    names = sorted(prototypes)
    dimensions = len(prototypes[names[0]]) if names else DIMENSIONS
    unit = np.stack([prototypes[name] / max(np.linalg.norm(prototypes[name]), 1e-9) for name in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32)
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _predict(names, unit, dimensions), "doc_id long, lang_pred string, score double")
