"""Substring dedup over a log-structured fingerprint index.

A window is WINDOW consecutive words. A window's fingerprint is the least hash of its GRAM-word grams, so equal windows
have equal fingerprints, and neighbouring windows mostly share one: a span is a longest stretch of consecutive windows of
one document with one fingerprint. Documents arrive in batches by doc_id. A batch's spans become a run of the index, a
table sorted by fingerprint that is never changed: fingerprint, two hashes of the span's words, smallest doc_id. Each
batch is joined with the runs so far, and runs are compacted into one when there are more than MAX_RUNS. An index with a
path keeps its runs there, with the batches' spans and texts, so that later calls meet all that came before; a batch is
then judged by what has come so far.

A span that an earlier document has too, by both independent hashes, repeats whole. Where a fingerprint has several spans, they may still share
windows (at the ends of a copied passage); the windows of each such span's first document are then read from the text
again and compared by two independent hashes. A window repeats if its word sequence starts in a document with a smaller
doc_id, and the words of repeating windows are removed.

Documents of fewer than WINDOW words lose nothing. Null text has no words. Rows without doc_id come before no other and
lose nothing. Repeated rows (equal doc_id) are not each other's originals. Hot spans are aggregated before they are
joined, and the join's large side can be split.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import drop, map_batches, mixed, slices, split_words, stage, to_batch, utf8, word_hashes

WINDOW = 50
GRAM = 8
BATCHES = 2
MAX_RUNS = 1
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverses, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(base), np.uint64(pow(int(base), -1, 1 << 64))
        return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Hashes of any stretch of a word sequence."""

    def __init__(self, words: np.ndarray, which: int = 0):
        size = 1 << max(10, len(words).bit_length())
        up, self.down = _powers(int(_BASES[which]), size)
        own = words if which == 0 else mixed(words + _BASES[1])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(words)])])

    def of(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Hash of the words from first up to after."""
        return mixed((self.sums[after] - self.sums[first]) * self.down[first] + (after - first).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def spans(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Fingerprint, two hashes, first and last window of each span of a word sequence."""
    n = len(words) - window + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    rolling = Rolling(words)
    at = np.arange(len(words) - gram + 1)
    prints = _least(rolling.of(at, at + gram), window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    last = np.append(first[1:], n) - 1
    return prints[first].view(np.int64), rolling.of(first, last + window).view(np.int64), Rolling(words, 1).of(first, last + window).view(np.int64), first, last


_SPANS = {"doc_id": pa.int64(), "mark": pa.int64(), "n_words": pa.int64(), "sha": pa.string(), "prints": pa.list_(pa.int64()), "spans": pa.list_(pa.int64()), "checks": pa.list_(pa.int64()), "firsts": pa.list_(pa.int32()), "lasts": pa.list_(pa.int32())}
_SPANS_SCHEMA = "doc_id long, mark long, n_words long, sha string, prints array<long>, spans array<long>, checks array<long>, firsts array<int>, lasts array<int>"


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in slices(batches, 2):
            out: dict[str, list] = {name: [] for name in list(_SPANS)[2:]}
            different, place, n = split_words(batch.column(2))
            hashed = np.split(word_hashes(different.cast(pa.binary()).to_pylist())[place], np.cumsum(n)[:-1])
            for doc_id, text, own in zip(batch.column(0).to_pylist(), utf8(batch.column(2)), hashed, strict=True):
                words = text.split()
                found = spans(own if doc_id is not None else own[:0])
                for name, value in zip(out, (len(words), hashlib.sha256(b" ".join(words)).hexdigest(), *found), strict=True):
                    out[name].append(value)
            yield to_batch({"doc_id": batch.column(0), "mark": batch.column(1)} | out, _SPANS)


class FingerprintIndex:
    """Sorted runs of fingerprint, span, check and first_doc, the smallest doc_id with that span.

    Without a path the runs are scratch tables of one call. With one, runs, spans and texts lie below it for the calls to
    come; one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.path, self.max_runs = spark, path, max_runs
        self.runs: list[DataFrame] = [self._read("runs", name) for name in self._names("runs")]

    def _folder(self, kind: str):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        """Finished tables below the path, oldest first."""
        if self.path is None:
            return []
        folder, store = self._folder(kind)
        found = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
        jvm = self.spark.sparkContext._jvm
        return sorted(name for name in found if store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{name}/_SUCCESS")))

    def _read(self, kind: str, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.path}/{kind}/{name}")
        table._staged_at = f"{self.path}/{kind}/{name}"
        return table

    def _write(self, rows: DataFrame, kind: str) -> DataFrame:
        if self.path is None:
            return stage(rows, f"substrings-{kind}")
        name = f"{len(self._names(kind)):06d}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{kind}/{name}")
        return self._read(kind, name)

    def _sorted_run(self, rows: DataFrame) -> DataFrame:
        merged = rows.groupBy("print", "span", "check").agg(F.min("first_doc").alias("first_doc"), F.sum("n").alias("n"))
        return self._write(merged.sortWithinPartitions("print", "span"), "runs")

    def append(self, batch: DataFrame) -> None:
        """A new run for a batch (print, span, check, doc_id); compacts when there are too many."""
        self.runs.append(self._sorted_run(batch.select("print", "span", "check", F.col("doc_id").alias("first_doc"), F.lit(1).alias("n"))))
        if len(self.runs) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        """All runs merged into one."""
        old = self.runs
        self.runs = [self._sorted_run(self._all())]
        drop(*old)

    def _all(self) -> DataFrame:
        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.unionByName(run)
        return rows

    def entries(self) -> DataFrame:
        """print, span, check, first_doc, n over all runs."""
        if len(self.runs) == 1:
            return self.runs[0]
        return self._all().groupBy("print", "span", "check").agg(F.min("first_doc").alias("first_doc"), F.sum("n").alias("n"))

    def history(self, kind: str) -> DataFrame | None:
        """The spans or texts of all calls so far; None where there is none."""
        names = self._names(kind)
        return self.spark.read.parquet(*[f"{self.path}/{kind}/{name}" for name in names]) if names else None

    def remember(self, spans_table: DataFrame, texts: DataFrame) -> None:
        """Keep a call's spans and texts, by which later calls compare windows."""
        if self.path is not None:
            self._write(spans_table, "spans")
            self._write(texts.where("doc_id is not null"), "texts")

    def close(self) -> None:
        if self.path is None:
            drop(*self.runs)


_WINDOWS = {"doc_id": pa.int64(), "mark": pa.int64(), "at": pa.int32(), "one": pa.int64(), "two": pa.int64()}


def _read_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of the windows first to last of each text's ranges."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for doc_id, mark, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = word_hashes(text.split())
                at = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges]))
                one, two = (Rolling(words, i).of(at, at + WINDOW).view(np.int64) for i in (0, 1))
                yield to_batch({"doc_id": [doc_id] * len(at), "mark": [mark] * len(at), "at": at, "one": one, "two": two}, _WINDOWS)


_KEPT = {"doc_id": pa.int64(), "mark": pa.int64(), "n_removed": pa.int64(), "sha": pa.string(), "kept": pa.string()}


def _covered(n: int, ranges: list[dict]) -> np.ndarray:
    """Whether each of n words lies in one of the windows first to last of ranges."""
    change = np.zeros(n + 1, np.int64)
    for r in ranges:
        change[r["first"]] += 1
        change[r["last"] + WINDOW] -= 1
    return np.cumsum(change[:-1]) > 0


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in list(_KEPT)[2:]}
            for text, ranges in zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                gone = _covered(len(words), ranges)
                kept = b" ".join(word for word, g in zip(words, gone, strict=True) if not g)
                for name, value in zip(out, (int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None), strict=True):
                    out[name].append(value)
            yield to_batch({"doc_id": batch.column(0), "mark": batch.column(1)} | out, _KEPT)

    return run


def _pieces(table: DataFrame) -> DataFrame:
    """A row for each span of a table of documents' spans."""
    names = {"prints": "print", "spans": "span", "checks": "check", "firsts": "first", "lasts": "last"}
    zipped = F.arrays_zip(*[F.col(many).alias(one) for many, one in names.items()])
    return table.select("doc_id", "mark", F.explode(zipped).alias("s")).select("doc_id", "mark", "s.*")


def remove_repeats(docs: DataFrame, batches: int = BATCHES, with_text: bool = False, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, null where nothing goes) for each row of docs (doc_id, text).

    With an index that has a path, docs also meet the documents of all calls before, and are added to them.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    table = stage(map_batches(texts, _cut_spans, _SPANS_SCHEMA), "substrings-spans")
    pieces = _pieces(table)
    bounds = table.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0], 1000).alias("at")).first()["at"] or []
    edges = [None, *(bounds if batches > 1 else []), None]
    index, whole = index or FingerprintIndex(docs.sparkSession), None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = pieces
        batch = batch.where(F.col("doc_id") > low) if low is not None else batch
        batch = batch.where(F.col("doc_id") <= high) if high is not None else batch
        index.append(batch.select("print", "span", "check", "doc_id"))
        known = index.entries().where("n > 1").select(F.col("span").alias("known_span"), F.col("check").alias("known_check"), "first_doc")
        hits = batch.join(known, F.expr("span = known_span and check = known_check")).where("first_doc < doc_id").select("doc_id", "mark", "first", "last")
        hits = stage(hits, "substrings-hits")
        whole = hits if whole is None else whole.unionByName(hits)
    # Fingerprints with several spans: the windows of each span's first document.
    entries = index.entries()
    several = entries.groupBy("print").agg(F.count("*").alias("spans")).where("spans > 1").select(F.col("print").alias("open_print"))
    open_ = stage(entries.join(several, F.expr("print = open_print")).select(F.col("span").alias("open_span"), F.col("check").alias("open_check"), "first_doc"), "substrings-open")
    old_spans, old_texts = index.history("spans"), index.history("texts")
    all_pieces = pieces if old_spans is None else pieces.unionByName(_pieces(old_spans))
    all_texts = texts if old_texts is None else texts.unionByName(old_texts)
    ranges = all_pieces.join(open_, F.expr("span = open_span and check = open_check and doc_id = first_doc")).select("doc_id", "mark", "first", "last")
    ranges = stage(ranges.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "substrings-ranges")
    seen = texts.dropDuplicates(["doc_id", "mark"])
    read = map_batches(all_texts.dropDuplicates(["doc_id", "mark"]).join(ranges, ["doc_id", "mark"]), _read_windows, "doc_id long, mark long, at int, one long, two long")
    windows = stage(read, "substrings-windows")
    # Written, so that the join shuffles its sides by itself and Spark can split a common window's rows.
    first = windows.groupBy("one", "two").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    first = stage(first, "substrings-first")
    again = windows.join(first.select("one", "two", "first_doc"), ["one", "two"]).where("first_doc < doc_id").select("doc_id", "mark", "at")
    # Neighbouring windows become one range before a document's are gathered.
    island = F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("at"))
    again = again.distinct().withColumn("island", island).groupBy("doc_id", "mark", "island").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("island")
    gone = whole.unionByName(again).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    gone = stage(gone, "substrings-gone")
    index.remember(table, texts)
    index.close()
    drop(windows, first, ranges, open_)
    # Documents that go whole need no text; the others' kept words are hashed.
    counts = table.select("doc_id", "mark", "n_words", "sha")
    total = counts.dropDuplicates(["doc_id", "mark"]).join(gone, ["doc_id", "mark"]).select("doc_id", "mark", "n_words", "ranges", _joined_length(F.col("ranges")).alias("n_gone"))
    partly = total.where("n_gone < n_words").select("doc_id", "mark", "ranges")
    cut = map_batches(seen.join(partly, ["doc_id", "mark"]).select("doc_id", "mark", "text", "ranges"), _remove(with_text), "doc_id long, mark long, n_removed long, sha string, kept string")
    fully = total.where("n_gone = n_words").select("doc_id", "mark", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("sha"), F.lit("" if with_text else None).cast("string").alias("kept"))
    changed = cut.unionByName(fully).withColumnRenamed("sha", "new_sha")
    out = counts.join(changed, ["doc_id", "mark"], "left")
    shown = [F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("new_sha", "sha").alias("kept_sha256")]
    return out.select("doc_id", "n_words", *shown, *([F.col("kept").alias("kept_text")] if with_text else []))


def _joined_length(ranges):
    """Words that windows first to last of ranges cover together."""
    ordered = F.array_sort(F.transform(ranges, lambda r: F.struct(r["first"].alias("first"), (r["last"] + WINDOW).alias("after"))))
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("after"))
    return F.aggregate(ordered, none, lambda t, r: F.struct((t["words"] + F.greatest(F.lit(0), r["after"] - F.greatest(t["after"], r["first"]))).alias("words"), F.greatest(t["after"], r["after"]).alias("after")))["words"]
