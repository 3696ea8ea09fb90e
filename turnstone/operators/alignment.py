"""Alignment of token arrays by their longest common blocks, and the edits between them.

The longest block that both arrays share is kept, of equally long ones that which begins first, in the first array before
the second; what lies before it and after it is aligned in the same way. So an edit is a gap between blocks: something
replaced, deleted or inserted. Equal tokens are paired once, as sparse numbers with the length of the run that each
begins; a part of the arrays takes the pairs inside it and clips their runs, so no table of all places is filled.

A pair of arrays is aligned in one task. It needs memory for its pairs of equal tokens: a few million for texts of ten
thousand words. Null arrays are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: From so many tokens on, those of over 1 % are too common to begin a block, if common ones are left out. Fixed values.
COMMON_FROM, COMMON_SHARE = 200, 100

Edit = tuple[str, int, int, int, int]


def equal_pairs(a: np.ndarray, b: np.ndarray, leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] == b[j], in order, and how many pairs follow on from each; leave_out marks codes that aren't paired."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    many = np.where(leave_out[a], 0, high - low) if leave_out is not None else high - low
    i = np.repeat(np.arange(len(a)), many)
    j = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(i))] if len(i) else np.zeros(0, np.int64)
    by_diagonal = np.lexsort((i, j - i))
    last = np.append((np.diff((j - i)[by_diagonal]) != 0) | (np.diff(i[by_diagonal]) != 1), True)[: len(i)]
    ends = np.flatnonzero(last)
    run = np.empty(len(i), np.int64)
    run[by_diagonal] = ends[np.searchsorted(ends, np.arange(len(i)))] - np.arange(len(i)) + 1
    return i, j, run


def common_blocks(a: list, b: list, leave_out_common: bool = False) -> list[tuple[int, int, int]]:
    """Blocks (i, j, length) with a[i : i + length] == b[j : j + length], in order.

    With leave_out_common, tokens that are very common in a long b begin no block, but a block goes on over them; where
    nothing else is shared, what both parts begin with is one.
    """
    codes = {token: code for code, token in enumerate(dict.fromkeys([*b, *a]))}
    one, two = (np.fromiter(map(codes.__getitem__, x), np.int64, len(x)) for x in (a, b))
    common = np.bincount(two, minlength=len(codes)) > len(b) // COMMON_SHARE + 1 if leave_out_common and len(b) >= COMMON_FROM else None
    found, open_parts = [], [(0, len(a), 0, len(b), *equal_pairs(one, two, common))]
    while open_parts:
        a_low, a_high, b_low, b_high, i, j, run = open_parts.pop()
        start, other, size = a_low, b_low, 0
        if len(i):
            length = np.minimum(run, np.minimum(a_high - i, b_high - j))
            best = int(np.argmax(length))
            start, other, size = int(i[best]), int(j[best]), int(length[best])
        while common is not None and start > a_low and other > b_low and one[start - 1] == two[other - 1]:
            start, other, size = start - 1, other - 1, size + 1
        while common is not None and start + size < a_high and other + size < b_high and one[start + size] == two[other + size]:
            size += 1
        if not size:
            continue
        found.append((start, other, size))
        before, after = (i < start) & (j < other), (i >= start + size) & (j >= other + size)
        open_parts.append((a_low, start, b_low, other, i[before], j[before], run[before]))
        open_parts.append((start + size, a_high, other + size, b_high, i[after], j[after], run[after]))
    return sorted(found)


def edits_between(a: list, b: list, leave_out_common: bool = False) -> Iterator[Edit]:
    """What makes b of a: (replace, delete or insert, where it starts and ends in a, where in b)."""
    a_at = b_at = 0
    for start, other, size in [*common_blocks(a, b, leave_out_common), (len(a), len(b), 0)]:
        if a_at < start or b_at < other:
            yield ("replace" if b_at < other else "delete") if a_at < start else "insert", a_at, start, b_at, other
        a_at, b_at = start + size, other + size


#: Rows whose tokens a task holds as Python objects at once, whatever the size of its batches.
SOME_ROWS = 128
_EDITS = ArrayType(StructType([StructField("op", StringType()), *(StructField(name, IntegerType()) for name in ("a_start", "a_end", "b_start", "b_end"))]))
_EDITS_ARROW = pa.list_(pa.struct([("op", pa.string()), *((name, pa.int32()) for name in ("a_start", "a_end", "b_start", "b_end"))]))


def _edits_of(leave_out_common: bool):
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in parts:
            done = [pa.array([], _EDITS_ARROW)]
            for at in range(0, len(a), SOME_ROWS):
                pairs = zip(a.slice(at, SOME_ROWS).to_pylist(), b.slice(at, SOME_ROWS).to_pylist(), strict=True)
                done.append(pa.array([[dict(zip(_EDITS.elementType.names, edit, strict=True)) for edit in edits_between(x or [], y or [], leave_out_common)] for x, y in pairs], _EDITS_ARROW))
            yield pa.concat_arrays(done)

    return F.arrow_udf(run, _EDITS)


_align, _align_uncommon = _edits_of(False), _edits_of(True)
#: For edits that are exploded: a filter on an array before it is exploded would align each pair once more.
_align_once = _edits_of(False).asNondeterministic()


def edits(a: Column, b: Column, leave_out_common: bool = False) -> Column:
    """Array of edits (op, a_start, a_end, b_start, b_end) that make b of a, both arrays of tokens."""
    return (_align_uncommon if leave_out_common else _align)(a, b)


def letters_changed(a: str, b: str) -> int:
    """The least number of inserted, deleted or replaced letters that make b of a.

    What both begin and end with is left out; of the rest, a column of the table of distances is kept as bits: where it
    rises and where it falls from row to row.
    """
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[len(a) - 1 - high] == b[len(b) - 1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, letter in enumerate(a):
        at[letter] = at.get(letter, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    rise, fall, distance = every, 0, len(a)
    for letter in b:
        same = at.get(letter, 0)
        level = (((same & rise) + rise) ^ rise) | same | fall
        up, down = fall | (every & ~(level | rise)), rise & level
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        rise, fall = down | (every & ~(level | up)), up & level
    return distance


def _distances(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in parts:
        done = [pa.array([], pa.int32())]
        for at in range(0, len(a), SOME_ROWS):
            pairs = zip(a.slice(at, SOME_ROWS).to_pylist(), b.slice(at, SOME_ROWS).to_pylist(), strict=True)
            done.append(pa.array([None if x is None or y is None else letters_changed(x, y) for x, y in pairs], pa.int32()))
        yield pa.concat_arrays(done)


#: What F.levenshtein gives, which fills a table of letters by letters for each pair; null if either text is.
distance = F.arrow_udf(_distances, IntegerType())


def matched(a: Column, edited: Column) -> Column:
    """How many tokens of a are in blocks."""
    return F.coalesce(F.size(a), F.lit(0)) - F.aggregate(edited, F.lit(0), lambda n, e: n + e["a_end"] - e["a_start"])


def similarity(a: Column, b: Column, edited: Column) -> Column:
    """Twice the tokens in blocks over all tokens of both; 1 for two empty arrays."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * matched(a, edited) / total)


def span(tokens: Column, start: Column, end: Column) -> Column:
    """The tokens from start up to end."""
    return F.slice(tokens, start + 1, end - start)


def removed_and_added(a: Column, b: Column, edited: Column) -> tuple[Column, Column]:
    """The tokens of a that edits take away, and those of b that they put in, in order, repeats kept."""
    gone = F.flatten(F.transform(edited, lambda e: span(a, e["a_start"], e["a_end"])))
    new = F.flatten(F.transform(edited, lambda e: span(b, e["b_start"], e["b_end"])))
    return gone, new


def explode_edits(rows: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """A row for each edit between the arrays a and b: keep, place (from 0), op, removed, added, and both with two tokens around."""
    aligned = rows.select(*keep, F.col(a).alias("a"), F.col(b).alias("b"), _align_once(F.col(a), F.col(b)).alias("edited"))
    each = aligned.select(*keep, "a", "b", F.posexplode("edited").alias("place", "e"))
    around = lambda x, s, e: span(x, F.greatest(F.lit(0), s - 2), F.least(F.size(x), e + 2))
    c = F.col
    return each.select(
        *keep, "place", c("e.op").alias("op"), span(c("a"), c("e.a_start"), c("e.a_end")).alias("removed"), span(c("b"), c("e.b_start"), c("e.b_end")).alias("added"),
        around(c("a"), c("e.a_start"), c("e.a_end")).alias("removed_context"), around(c("b"), c("e.b_start"), c("e.b_end")).alias("added_context"),
    )
