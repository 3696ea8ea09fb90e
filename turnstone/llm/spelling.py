"""Spelling variant grouping by a positional q-gram index with a count filter.

Words within one edit share nearly all of their two-letter grams, at places that differ by one at most: of two words
whose longer one has L letters, padded at both ends, at least L - 1. So an index of grams and places gives, for each
word, one list of words a gram; the lists are merged with a heap, and words that come up L - 1 times are verified.

The index is cut into shards that Spark deals out. One edit leaves the first or the second half of a word alone, so
each word goes to the shard of its length and first half and to that of its length and second half, as a word of its
own length and as one that lacks a letter of the next length. A shard of more than ``SHARD_ROWS`` rows is cut again in
the same way: what both words share grows by half of the letters still open, until a single letter is open and a shard
holds a word for each letter of the alphabet at most. No pair is lost, and each is found in one shard: the one whose
open letters hold the first that differs.

Letters are A-Z, lower-cased, a-z and U+00C0 to U+00FF as they are. Null texts have no words; a null doc_id counts as an
empty one in the rule that drops letters. Repeated rows count as often as they come; without words the result is empty.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import drop, map_batches, slices, split_words, stage, to_batch, word_parts

SHORTEST = 5
LEAST_COUNT = 3
#: A word's form must be that many times as frequent.
RATIO = 2
#: Rows of a shard before it is cut again.
SHARD_ROWS = 2000
#: Rows of shards that a task searches.
TASK_ROWS = 50_000
#: Different words that a task counts before it hands them on.
COUNTED_AT_ONCE = 400_000
DROP_EVERY = 97


def _letters(data: np.ndarray) -> np.ndarray:
    """The bytes of texts with blanks for all that is no letter: U+00C0 to U+00FF are 0xC3 and one byte more."""
    lead = data == 0xC3
    after = np.append(False, lead[:-1])
    low = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    return np.where(lead | after | ((low >= 0x61) & (low <= 0x7A)), low, np.uint8(32))


_COUNTS = {"word": pa.string(), "n": pa.int64()}


def _count(shortest: int, drop_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for batch in slices(batches, 1):
            prefix = [zlib.crc32(b"%s:" % (b"" if x is None else b"%d" % x)) for x in batch.column(0).to_pylist()]
            for rows, parts in word_parts(batch.column(1), _letters):
                words, place, n = split_words(parts)
                if not len(words):
                    continue
                listed = words.to_pylist()
                coded = [word.encode() for word in listed]
                # A word's fate is one within a document, so each is looked at once there.
                code, times = np.unique(np.repeat(rows, n) * len(listed) + place, return_counts=True)
                row, at = code // len(listed), code % len(listed)
                hashes = np.fromiter((zlib.crc32(coded[w], prefix[r]) for w, r in zip(at.tolist(), row.tolist(), strict=True)), np.int64, len(code))
                cut = hashes % drop_every == 0
                whole = np.bincount(at[~cut], times[~cut], minlength=len(listed)).astype(np.int64)
                for i in np.flatnonzero(whole).tolist():
                    if len(listed[i]) >= shortest:
                        counts[listed[i]] += int(whole[i])
                for i, h, k in zip(at[cut].tolist(), hashes[cut].tolist(), times[cut].tolist(), strict=True):
                    gone = h % len(listed[i])
                    if len(listed[i]) > shortest:
                        counts[listed[i][:gone] + listed[i][gone + 1 :]] += k
                if len(counts) > COUNTED_AT_ONCE:
                    yield to_batch({"word": list(counts), "n": list(counts.values())}, _COUNTS)
                    counts.clear()
        if counts:
            yield to_batch({"word": list(counts), "n": list(counts.values())}, _COUNTS)

    return run


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """word and n of all words of docs (doc_id, text) of that many letters that occur that often; tasks add up their own first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = map_batches(rows, _count(shortest, drop_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _shards(before, after, length):
    """The two shards that a word of a shard goes to: letters agreed before and after the open ones, of words of a length."""
    half = F.floor((length - before - after) / 2).cast("int")
    open_letters = length - before - after
    return F.array(F.struct((before + half).alias("before"), after.alias("after")), F.struct(before.alias("before"), (after + open_letters - half).alias("after")))


def _cut(rows: DataFrame) -> DataFrame:
    """rows (word, n, length, before, after) by the two finer shards of each; key holds the letters that a shard agrees on."""
    size = F.length("word")
    finer = rows.select("word", "n", "length", F.explode(_shards(F.col("before"), F.col("after"), F.col("length"))).alias("s")).select("word", "n", "length", "s.*")
    agreed = F.concat_ws(" ", F.substring(F.col("word"), F.lit(1), F.col("before")), F.substring(F.col("word"), size - F.col("after") + 1, F.col("after")))
    return finer.withColumn("key", agreed)


_PAIRS = {"word": pa.string(), "n": pa.int64(), "other": pa.string(), "other_n": pa.int64()}


def _one_edit(home: str, other: str) -> int:
    """The place of the only edit that makes other of home, a word as long or one letter longer; -1 if there is none."""
    at = 0
    for a, b in zip(home, other, strict=False):
        if a != b:
            break
        at += 1
    return at if home[at + 1 :] == other[at + (len(home) == len(other)) :] and home != other else -1


def _near_pairs(rows: list[tuple[str, int]], length: int, before: int, after: int) -> Iterator[tuple[str, int, str, int]]:
    """Pairs within one edit of a shard: words of the length, and words that lack a letter, with those of the length."""
    homes = sorted(row for row in rows if len(row[0]) == length)
    shorts = [row for row in rows if len(row[0]) < length]
    if not homes or len(homes) + len(shorts) < 2:
        return
    # Only grams that touch open letters tell words apart; they stand at places before .. length - after.
    first, last = before, length - after
    index: dict[tuple[int, str], list[int]] = defaultdict(list)
    # Of a home's open + 1 grams an edit spoils two at most; with one letter open, all agree on the letters outside.
    least = last - first - 1
    for i, (word, n) in enumerate([*homes, *shorts]):
        padded = f"^{word}$"
        if i < len(homes):
            grams = [(place, padded[place : place + 2]) for place in range(first, last + 1)]
        else:
            grams = [(at, padded[place : place + 2]) for place in range(first, last) for at in (place, place + 1)]
        if least > 0:
            lists = [index[gram] for gram in grams if gram in index]
            found = [j for j, same in groupby(merge(*lists)) if sum(1 for _ in same) >= least] if len(lists) >= least else ()
        else:
            found = range(min(i, len(homes)))
        for j in found:
            home, home_n = homes[j]
            if first <= _one_edit(home, word) < last:
                yield home, home_n, word, n
        if i < len(homes):
            for gram in grams:
                index[gram].append(i)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of all shards of rows that come sorted by shard; a shard may go on in the next batch."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)

    found: list[tuple] = []
    for shard, own in groupby(rows(), key=lambda row: row[:4]):
        found.extend(_near_pairs([(row[4], row[5]) for row in own], *shard[:3]))
        if len(found) >= 20_000:
            yield to_batch(dict(zip(_PAIRS, zip(*found, strict=True), strict=True)), _PAIRS)
            found = []
    if found:
        yield to_batch(dict(zip(_PAIRS, zip(*found, strict=True), strict=True)), _PAIRS)


_SHARD = ("length", "before", "after", "key")


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, n, other, other_n: each pair of words (word, n) within one edit, in both directions."""
    zero = F.lit(0)
    own = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("length"))
    rows, parts, staged = own.select("*", zero.alias("before"), zero.alias("after")), [], []
    while True:
        rows = _cut(rows)
        # A shard of words that all lack a letter has no word to be near to.
        sizes = rows.groupBy(*_SHARD).agg(F.count("*").alias("rows"), F.sum((F.length("word") == F.col("length")).cast("int")).alias("homes")).where("rows > 1 and homes > 0")
        sizes = stage(sizes.withColumn("large", (F.col("rows") > shard_rows) & (F.col("length") - F.col("before") - F.col("after") > 1)), "spelling-shards")
        staged.append(sizes)
        parts.append(rows.join(sizes.where("not large").select(*_SHARD), [*_SHARD], "left_semi"))
        if sizes.where("large").isEmpty():
            break
        rows = stage(rows.join(sizes.where("large").select(*_SHARD), [*_SHARD], "left_semi").drop("key"), "spelling-large")
        staged.append(rows)
    together, n_rows = parts[0], sum(sizes.where("not large").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] for sizes in staged if "large" in sizes.columns)
    for part in parts[1:]:
        together = together.unionByName(part)
    # A row takes long to search for its bytes, so its number of rows decides how many tasks there are.
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))
    dealt = together.select(*_SHARD, "word", "n").repartition(tasks, *_SHARD).sortWithinPartitions(*_SHARD)
    pairs = stage(dealt.mapInArrow(_search, "word string, n long, other string, other_n long"), "spelling-pairs")
    drop(*staged)
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(links: DataFrame) -> DataFrame:
    """word and root: where the forms of links (word, form) lead. A form is more frequent, so they end; each round halves the way."""
    known = stage(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = known.join(further, "root", "left")
        longer = stage(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop(known)
        known = longer
        if known.where("moved").isEmpty():
            return known.drop("moved")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT, ratio: int = RATIO, shard_rows: int = SHARD_ROWS, drop_every: int = DROP_EVERY) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs (doc_id, text)."""
    words = stage(count_words(docs, shortest, least, drop_every), "spelling-words")
    near = near_words(words, shard_rows).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.other"))
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best.alias("form"), F.when(best.isNotNull(), -F.col("best.less")).alias("form_n"))
    formed = stage(formed, "spelling-forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
