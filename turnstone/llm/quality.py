"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters as they stand, of any script; white space is one blank. All n-grams of all trusted texts are
counted. Each order's counts are joined with the totals of their contexts and with the next lower order's probabilities,
in shards by context and by suffix, so the model grows with the corpus and no step holds it whole.

Scores need no chain of look-ups: ln p of a character is the sum, over the n-grams that end at it and those that end just
before it, of what each seen one adds. gain is ln p less what its context and suffix would give without it; back is what
a context takes from a character that never followed it. So perplexity is a sum over joins of a text's n-grams with the
table of gains, and the table may be cut into shards in any way: shards of at most SHARD n-grams (16 bytes each, whatever
the corpus's size) are broadcast one after the other, each is joined with all texts, and the sums are added up. Texts are
never shuffled for it; they are read once a shard, of which there are as many as the model has multiples of SHARD.

A document is rejected when its perplexity exceeds its language's limit: the chosen quantile of that language's trusted
documents, and some margin. Short texts vary more, so each text's logarithm first loses ALLOWANCE over the square root
of its characters. A language with few trusted documents takes the limit of all trusted documents, and without
any trusted text all documents that have a character are kept. Null and empty texts have no perplexity and are rejected.
A null language is a language of its own. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import drop, map_batches, mixed, slices, stage, to_batch

ORDER = 5
QUANTILE = 0.995
MARGIN = 1.05
#: Allowance for the chance in short texts, over the square root of their characters.
ALLOWANCE = 3.0
#: Trusted documents that a language needs for a limit of its own.
ENOUGH = 50
#: Steps of the logarithm of the perplexity in which quantiles are taken.
STEP = 0.001
#: N-grams of the model that are broadcast at once: a hash and two numbers each, 16 bytes.
SHARD = 1 << 22
#: Characters of text that are cut into n-grams at once.
AT_ONCE = 1 << 20
#: Different n-grams that a task counts before it passes them on.
HELD = 1 << 20
#: Stands before each text; in texts it is taken as a blank.
EDGE = "\U0010ffff"
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0x8CB92BA72F3D8DD7], np.uint64)


def plain(text: str) -> str:
    """The text with one blank for each stretch of white space, and none at its ends."""
    return " ".join(text.replace(EDGE, " ").split())


def windows(texts: list[str], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of plain texts, the places at which a character ends an n-gram, and each one's text; in parts."""
    edge, parts, owners, size = EDGE * (order - 1), [], [], 0

    def out():
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        place = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
        at = np.flatnonzero(place >= order - 1)
        return points, at, np.repeat(np.array(owners), length - (order - 1))

    for i, text in enumerate(texts):
        text = edge + plain(text)
        for start in range(0, len(text) - order + 1, AT_ONCE):
            parts.append(text[start : start + AT_ONCE + order - 1])
            owners.append(i)
            size += len(parts[-1])
            if size >= AT_ONCE:
                yield out()
                parts, owners, size = [], [], 0
    if parts:
        yield out()


def marks(points: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """A hash, not yet mixed, of the n-gram that ends at each place."""
    total = np.full(len(at), order, np.uint64)
    for back in range(order):
        total += points[at - back].astype(np.uint64) * _STEPS[back]
    return total


def row_marks(grams: np.ndarray) -> np.ndarray:
    """The same hash for n-grams as rows of code points, mixed."""
    order = grams.shape[1]
    return mixed((grams[:, ::-1].astype(np.uint64) * _STEPS[:order]).sum(axis=1, dtype=np.uint64) + np.uint64(order))


def different(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value among the different ones, and where each of those stands."""
    number, values_found = pd.factorize(values)
    first = np.empty(len(values_found), np.int64)
    first[number[::-1]] = np.arange(len(values) - 1, -1, -1)
    return number, first


def strings(grams: np.ndarray) -> list[str]:
    order, whole = grams.shape[1], np.ascontiguousarray(grams, "<u4").tobytes().decode("utf-32-le", "replace")
    return [whole[i : i + order] for i in range(0, len(whole), order)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of order ORDER and how often they come; an n-gram may come in several rows."""
    types, held, size = {"gram": pa.string(), "n": pa.int64()}, [], 0

    def out() -> Iterator[pa.RecordBatch]:
        grams, n = np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held])
        number, first = different(row_marks(grams))
        total = np.bincount(number, n).astype(np.int64)
        for start in range(0, len(first), 50_000):
            yield to_batch({"gram": strings(grams[first[start : start + 50_000]]), "n": total[start : start + 50_000]}, types)

    for batch in slices(batches, 0, AT_ONCE):
        for points, at, _ in windows([text or "" for text in batch.column(0).to_pylist()]):
            number, first = different(marks(points, at, ORDER))
            held.append((points[at[first][:, None] + np.arange(1 - ORDER, 1)], np.bincount(number)))
            size += len(first)
        if size >= 2 * HELD:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney smoothing, from how many n-grams come once to four times."""
    few = dict(counts.where("n <= 4").groupBy("n").count().collect())
    n1, n2, n3, n4 = (few.get(i, 0) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), top) for d, top in zip(found, (0.95, 1.9, 2.85), strict=True))


@dataclass
class Model:
    """gains: a staged table of gram, gain and back; base: ln p of a character that no trusted text has."""

    gains: DataFrame
    base: float
    n_grams: int


def train(trusted: DataFrame, order: int = ORDER) -> Model | None:
    """The model of all of trusted (text). None if there is no text."""
    counts = {order: stage(map_batches(trusted.select("text"), _count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "quality-counts")}
    for k in range(order - 1, 0, -1):  # lower orders count the different characters before them
        counts[k] = stage(counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"quality-counts-{k}")
    if counts[1].isEmpty():
        drop(*counts.values())
        return None
    parts, lower, base = [], None, 0.0
    for k in range(1, order + 1):
        ds = _discounts(counts[k])
        discount = F.when(F.col("n") == 1, ds[0]).when(F.col("n") == 2, ds[1]).otherwise(ds[2])
        grams = counts[k].withColumn("context", F.substring("gram", 1, k - 1))
        few = [F.sum((F.col("n") == i).cast("long") if i < 3 else (F.col("n") > 2).cast("long")) for i in (1, 2, 3)]
        totals = grams.groupBy("context").agg(F.sum("n").alias("total"), *[n.alias(f"n{i}") for i, n in enumerate(few)])
        held = sum((F.col(f"n{i}") * d for i, d in enumerate(ds)), F.lit(0.0))
        totals = stage(totals.select("context", "total", (held / F.col("total")).alias("left")), f"quality-totals-{k}")
        share = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")
        if k == 1:
            all_ = totals.first()
            unseen = all_.left / (counts[1].count() + 1)
            base = float(np.log(unseen))
            own = grams.withColumn("total", F.lit(all_.total)).select("gram", (share + unseen).alias("p"), F.lit(base).alias("without"))
        else:
            known = grams.join(totals, "context").withColumn("suffix", F.substring("gram", 2, k - 1))
            known = known.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            own = known.select("gram", (share + F.col("left") * F.col("below")).alias("p"), (F.log("left") + F.log("below")).alias("without"))
            parts.append(totals.select(F.col("context").alias("gram"), F.lit(0.0).alias("gain"), F.log("left").alias("back")))
        own = stage(own, f"quality-p-{k}")
        parts.append(own.select("gram", (F.log("p") - F.col("without")).alias("gain"), F.lit(0.0).alias("back")))
        lower = own
    gains = parts[0]
    for part in parts[1:]:
        gains = gains.unionByName(part)
    gains = stage(gains.groupBy("gram").agg(F.sum("gain").alias("gain"), F.sum("back").alias("back")), "quality-gains")
    drop(*counts.values())
    return Model(gains, base, gains.count())


_PACKED = {"marks": pa.binary(), "gains": pa.binary(), "backs": pa.binary()}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of gram, gain and back as bytes, with n-grams as hashes."""
    with np.errstate(over="ignore"):
        for batch in batches:
            by_order: dict[int, list[int]] = {}
            grams = batch.column(0).to_pylist()
            for i, gram in enumerate(grams):
                by_order.setdefault(len(gram), []).append(i)
            mark = np.zeros(len(grams), np.uint64)
            for order, at in by_order.items():
                points = np.frombuffer("".join([grams[i] for i in at]).encode("utf-32-le"), np.uint32)
                mark[at] = row_marks(points.reshape(-1, order))
            numbers = [batch.column(i).to_numpy().astype(np.float32).tobytes() for i in (1, 2)]
            yield to_batch({"marks": [mark.tobytes()], "gains": [numbers[0]], "backs": [numbers[1]]}, _PACKED)


class Shard:
    """Some n-grams of a model, by their sorted hashes."""

    def __init__(self, rows: list):
        mark = np.frombuffer(b"".join(r.marks for r in rows), np.uint64)
        order = np.argsort(mark, kind="stable")
        self.marks = mark[order]
        self.gains = np.frombuffer(b"".join(r.gains for r in rows), np.float32)[order]
        self.backs = np.frombuffer(b"".join(r.backs for r in rows), np.float32)[order]

    def _look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = row_marks(grams)
        at = np.minimum(np.searchsorted(self.marks, keys), max(len(self.marks) - 1, 0))
        hit = self.marks[at] == keys if len(self.marks) else np.zeros(len(keys), bool)
        at = np.where(hit, at, 0)
        return np.where(hit, self.gains[at].astype(np.float64), 0.0), np.where(hit, self.backs[at].astype(np.float64), 0.0)

    def _sums(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gains and backs of each n-gram and of all its suffixes."""
        gain, back = self._look_up(grams)
        if grams.shape[1] > 1:
            number, first = different(row_marks(grams[:, 1:]))
            lower_gain, lower_back = self._sums(grams[first][:, 1:])
            gain, back = gain + lower_gain[number], back + lower_back[number]
        return gain, back

    def of(self, grams: np.ndarray) -> np.ndarray:
        """What the shard adds to ln p of the last character of each n-gram."""
        total, order = self._look_up(grams)[0], grams.shape[1]
        both = np.concatenate([grams[:, 1:], grams[:, :-1]])
        number, first = different(row_marks(both))
        gain, back = self._sums(both[first])
        return total + gain[number[: len(grams)]] + back[number[len(grams) :]] if order > 1 else total


def shards(model: Model, size: int = SHARD) -> Iterator[Shard]:
    """The model in shards of about size n-grams at most. The driver holds one at a time."""
    n = -(-model.n_grams // size)
    for i in range(n):
        rows = model.gains.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == i) if n > 1 else model.gains
        yield Shard(map_batches(rows, _pack, "marks binary, gains binary, backs binary").collect())


def log_p(shard: Shard, texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each text, and the sum of what the shard adds to their ln p."""
    n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    with np.errstate(over="ignore"):
        for points, at, owner in windows(texts, order):
            number, first = different(marks(points, at, order))
            added = shard.of(points[at[first][:, None] + np.arange(1 - order, 1)])
            n += np.bincount(owner, minlength=len(texts))
            total += np.bincount(owner, added[number], minlength=len(texts))
    return n, total


_SCORED = {"doc_id": pa.int64(), "lang": pa.string(), "mark": pa.int64(), "n_symbols": pa.int64(), "added": pa.float64()}
_SCORED_SCHEMA = "doc_id long, lang string, mark long, n_symbols long, added double"


def _score(shard):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, 2 * AT_ONCE):
            n, total = log_p(shard.value, [text or "" for text in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(total)], names=list(_SCORED))

    return run


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, lang, mark (a hash of the text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("mark"), "text")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, mark, n_symbols and log_perplexity (mean -ln p of a character; null without one), staged.

    A row for each row of docs (doc_id, lang, text). Rows that are alike have one score.
    """
    rows, sums = marked(docs), None
    if model is None:
        n_symbols = F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))).cast("long")
        rows = rows.select("doc_id", "lang", "mark", n_symbols.alias("n_symbols"))
        return stage(rows.withColumn("log_perplexity", F.when(F.col("n_symbols") > 0, F.lit(0.0))), "quality-scores")
    own, n = [], 0
    for shard in shards(model):
        shared = docs.sparkSession.sparkContext.broadcast(shard)
        own.append(stage(map_batches(rows, _score(shared), _SCORED_SCHEMA), "quality-added"))
        shared.destroy()
        n += 1
    sums = own[0]
    if n > 1:
        for part in own[1:]:
            sums = sums.unionByName(part)
        sums = sums.groupBy("doc_id", "lang", "mark").agg(F.max("n_symbols").alias("n_symbols"), (F.sum("added") * n / F.count("*")).alias("added"), (F.count("*") / n).cast("int").alias("rows"))
        sums = sums.select("doc_id", "lang", "mark", "n_symbols", "added", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("col")
    value = F.when(F.col("n_symbols") > 0, -(F.lit(model.base) + F.col("added") / F.col("n_symbols")))
    if n == 1:
        return _like(sums, sums.select("doc_id", "lang", "mark", "n_symbols", value.alias("log_perplexity")))
    out = stage(sums.select("doc_id", "lang", "mark", "n_symbols", value.alias("log_perplexity")), "quality-scores")
    drop(*own)
    return out


def _like(staged: DataFrame, df: DataFrame) -> DataFrame:
    """df, read from a staged table that goes when df is dropped."""
    df._staged_at = staged._staged_at
    return df


ADJUSTED = f"(log_perplexity - {ALLOWANCE} / sqrt(n_symbols))"


def limits(scored: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, enough: int = ENOUGH) -> DataFrame:
    """limit_lang and limit: by language the quantile of the trusted documents' perplexities, times margin.

    Quantiles are of counts by STEP of the logarithm. The row for all languages together has overall = true.
    """
    own = scored.join(trusted_ids, "doc_id", "left_semi").where("log_perplexity is not null")
    own = own.groupBy("lang", F.ceil(F.expr(ADJUSTED) / STEP).alias("step")).count()
    both = own.select("lang", F.lit(False).alias("overall"), "step", "count").unionByName(own.groupBy("step").agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("overall"), "step", "count"))
    whole = Window.partitionBy("overall", "lang")
    both = both.withColumn("through", F.sum("count").over(whole.orderBy("step"))).withColumn("n", F.sum("count").over(whole))
    found = both.where(F.col("through") >= F.col("n") * quantile).groupBy("overall", "lang").agg(F.min("step").alias("step"), F.max("n").alias("n"))
    return found.where(F.col("overall") | (F.col("n") >= enough)).select("overall", F.col("lang").alias("limit_lang"), (F.col("step") * STEP + float(np.log(margin))).alias("limit"))


def _fit(docs: DataFrame, trusted_ids: DataFrame, quantile: float, margin: float) -> DataFrame:
    """score's columns, limit and keep for each row of docs."""
    trusted_ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id"))
    trusted_ids = trusted_ids.hint("merge")  # labels grow with the documents, so they are never broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(rows.join(trusted_ids, "doc_id", "left_semi"))
    scored = score(docs, model)
    found = stage(limits(scored, trusted_ids, quantile, margin), "quality-limits")
    overall = found.where("overall").select("limit").collect()
    if model is not None:
        drop(model.gains)
    limit = F.coalesce(F.col("limit"), F.lit(overall[0].limit if overall else None).cast("double"))
    joined = scored.join(found.where("not overall").drop("overall"), F.expr("lang <=> limit_lang"), "left").withColumn("limit", limit)
    return joined.withColumn("keep", F.col("log_perplexity").isNotNull() & F.coalesce(F.expr(ADJUSTED) <= F.col("limit"), F.lit(True)))


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, limit and keep for each row of docs (doc_id, lang, text).

    trusted_ids (doc_id) names the documents whose text the model learns, all of it.
    """
    out = _fit(docs, trusted_ids, quantile, margin)
    return out.select("doc_id", "lang", "n_symbols", F.round(F.exp("log_perplexity"), 6).alias("perplexity"), F.round(F.exp("limit"), 6).alias("limit"), "keep")


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that people found good."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id")


def keep_good(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """The rows of docs that aren't rejected, with docs' columns. Texts are scored once, then joined by doc_id and hash."""
    kept = _fit(docs, trusted_ids, quantile, margin).where("keep").select(F.col("doc_id").alias("kept_id"), F.col("lang").alias("kept_lang"), F.col("mark").alias("kept_mark")).hint("merge")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("kept_id")) & docs["lang"].eqNullSafe(F.col("kept_lang")) & (F.xxhash64(docs["text"]) == F.col("kept_mark"))
    return docs.join(kept, same, "left_semi")
