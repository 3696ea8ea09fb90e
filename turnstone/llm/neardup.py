"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document's shingles are its runs of SHINGLE words, lower-cased; a shorter text is one shingle. A shingle weighs its
count times its inverse document frequency, ln(1 / f) with f the share of documents that hold it, at most ln(1 / COMMON).
Shingles in at least a share COMMON of all documents are found exactly in two passes. First each task counts its shingles
by cell, in a table of CELL_ROWS rows of CELLS cells, whose cells are then added up over all tasks; a shingle's cells hold
at least its own count. Then shingles with all cells at or above the share are counted over all documents, whatever the
partitions. So a task sends a table of fixed size, and counts only of what shares all its cells with common shingles; a
group of copies in one task names nothing. All rarer shingles weigh the same: with their own frequencies, texts in a large group of near copies would
weigh what they share less than their few differences, and the group would fall apart.

Exact copies (equal words) are one text from here on. Each text draws DRAWS consistent samples: for a shingle of weight w
and draw k, r and c are Gamma(2, 1) and b uniform, all from the hash of shingle and k; t = floor(ln w / r + b), and the
shingle with the least ln c - r * (t - b + 1) is drawn, with its t. Two texts draw the same with the probability of their
weighted Jaccard similarity. The variates come from a table of VARIATES entries, and weights are whole steps of
ln w, so what a shingle bids is looked up.

Draws in bands of ROWS make buckets. A bucket first gives the edges of its greatest spanning tree by agreement of draws,
of at least LIKELY: fewer pairs than texts. Buckets of more than GROUP texts are dealt into groups
of about that many there, and all texts are paired with the bucket's smallest doc_id as well. Pairs are verified by their
weighted Jaccard similarity, over 32 bits of each shingle's hash. Where a bucket's texts are then in several components,
the best linked text of the largest component is paired with all texts outside it; and where they still are, each text
outside the largest is compared with every other text of the bucket, block by block, unless links join the two already.
So all pairs of a bucket whose draws agree in at least LIKELY are compared or in one class.
Links of at least THRESHOLD join texts; components of links are
the classes, and a class's id is its smallest doc_id.

Null and empty texts (no words) are copies of each other only if both have no words. Repeated rows get the same class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import drop, map_batches, mixed, slices, split_words, stage, to_batch, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
COMMON = 0.01
ROWS, BANDS = 4, 14
DRAWS = ROWS * BANDS
VARIATES = 1 << 16
#: Steps of ln w in which weights are kept for sampling, and the number of steps.
STEP, STEPS = 0.25, 64
#: Bytes of text that are drawn from at once.
SIGNED_BYTES = 1 << 19
#: Shingles that a task gathers before it counts them.
GATHERED = 1 << 19
#: The table of counts: rows, cells of each, and cells of the parts in which its rows are added up.
CELL_ROWS, CELL_BITS, PART = 2, 18, 1 << 12
CELLS = 1 << CELL_BITS
#: Texts of a bucket whose draws are compared in one group, and the least agreement of a pair.
GROUP, LIKELY = 512, 0.6
#: Texts of each side that are compared by all pairs in one block.
BLOCK = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words; a shorter text is one shingle, no words are none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        total = total * _BASE + words[i : i + n]
    return mixed(total + np.uint64(min(len(words), SHINGLE)))


def _words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of each text's words, with A-Z in lower case; each different word is hashed once."""
    words, place, n = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashed = word_hashes(words.cast(pa.binary()).to_pylist())[place]
    return iter(np.split(hashed, np.cumsum(n)[:-1]) if len(n) else [])


_DOCS = {"doc_id": pa.int64(), "one": pa.int64(), "two": pa.int64(), "counts": pa.binary()}


def _cells(own: np.ndarray) -> list[np.ndarray]:
    """The cell of each shingle in each row of the table of counts."""
    return [(own >> np.uint64(row * CELL_BITS)).astype(np.int64) & (CELLS - 1) for row in range(CELL_ROWS)]


class LossyCounts:
    """Counts of distinct shingles by document; what is forgotten was in at most a share of error of the documents."""

    def __init__(self, error: float):
        self.error, self.documents, self.known = error, 0, 0
        self.shingles, self.n, self.missed = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        self.gathered: list[np.ndarray] = []
        self.size = 0

    def add(self, own: np.ndarray) -> None:
        self.gathered.append(own)
        self.documents += 1
        self.size += len(own)
        if self.size >= GATHERED:
            self.count()

    def count(self) -> None:
        """Take in what was gathered and forget what is rare."""
        new, n = np.unique(np.concatenate(self.gathered), return_counts=True) if self.gathered else (self.shingles[:0], self.n[:0])
        old, at = _places(self.shingles, new)
        self.n[at] += n[old]
        self.shingles = np.concatenate([self.shingles, new[~old]])
        self.missed = np.concatenate([self.missed, np.full(int((~old).sum()), self.error * self.known)])
        self.n = np.concatenate([self.n, n[~old]])
        order = np.argsort(self.shingles)
        order = order[(self.n + self.missed > self.error * self.documents)[order]]
        self.shingles, self.n, self.missed = self.shingles[order], self.n[order], self.missed[order]
        self.known, self.gathered, self.size = self.documents, [], 0


def _packed(counts: np.ndarray) -> bytes:
    """Counts byte by byte, the low bytes of all first, which are most of what isn't 0."""
    return np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(counts: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's two hashes; at the end, the task's counts of shingles by cell, in parts of PART cells numbered in one."""
    table = np.zeros((CELL_ROWS, CELLS), np.uint32)
    with np.errstate(over="ignore"):
        for batch in slices(batches, 1):
            out: dict[str, list] = {"doc_id": batch.column(0), "one": [], "two": [], "counts": [None] * batch.num_rows}
            held = []
            for words in _words_of(batch.column(1)):
                at = np.arange(1, len(words) + 1, dtype=np.uint64)
                out["one"].append(int(mixed(np.array([(mixed(words * _BASE + at)).sum(dtype=np.uint64)]))[0].view(np.int64)))
                out["two"].append(int((mixed((words + at) * _BASE)).sum(dtype=np.uint64).view(np.int64)))
                held.append(np.unique(shingles(words)))
            for row, cells in zip(table, _cells(np.concatenate(held)) if held else (), strict=False):
                row += np.bincount(cells, minlength=CELLS).astype(np.uint32)
            yield to_batch(out, _DOCS)
        parts = table.reshape(-1, PART)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            yield to_batch({"doc_id": pa.nulls(len(used), pa.int64()), "one": used, "two": [0] * len(used), "counts": [_packed(parts[i]) for i in used]}, _DOCS)


def _hot_cells(least: float):
    """Cells, numbered over all rows, whose counts in all tasks are together at least so much; parts come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(PART, np.int64)

        def close() -> pa.RecordBatch:
            return to_batch({"cell": (part or 0) * PART + np.flatnonzero(total >= least)}, {"cell": pa.int64()})

        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != part:
                    if part is not None:
                        yield close()
                    part, total = at, np.zeros(PART, np.int64)
                total += _unpacked(counts)
        if part is not None:
            yield close()

    return run


def _count_hot(hot):
    """Shingles all of whose cells are hot, with the number of a task's texts that hold them."""

    def counted(known: tuple[np.ndarray, np.ndarray], gathered: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(gathered), return_counts=True)
        every, at = np.unique(np.concatenate([known[0], new]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([known[1], n])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        table, known, gathered, size = np.zeros(CELL_ROWS * CELLS, bool), none, [], 0
        table[hot.value] = True
        table = table.reshape(CELL_ROWS, CELLS)
        row = lambda x: to_batch({"shingle": x[0].view(np.int64), "n": x[1]}, {"shingle": pa.int64(), "n": pa.int64()})
        with np.errstate(over="ignore"):
            for batch in slices(batches, 0):
                for words in _words_of(batch.column(0)):
                    own = np.unique(shingles(words))
                    own = own[np.logical_and.reduce([of_row[cells] for of_row, cells in zip(table, _cells(own), strict=True)])]
                    gathered.append(own)
                    size += len(own)
                    if size >= GATHERED:
                        known, gathered, size = counted(known, gathered), [], 0
                        if len(known[0]) >= GATHERED:
                            yield row(known)
                            known = none
            if gathered:
                known = counted(known, gathered)
        yield row(known)

    return run


def _places(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the sorted table, and where."""
    if not len(table) or not len(keys):
        return np.zeros(len(keys), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    hit = table[at] == keys
    return hit, at[hit]


@cache
def _bids() -> np.ndarray:
    """For each step of ln w and each variate: the rank of its bid, least first. Equal draws have equal ranks."""
    rng = np.random.default_rng(77)
    r, c, b = rng.gamma(2, 1, VARIATES), rng.gamma(2, 1, VARIATES), rng.random(VARIATES)
    log_w = (np.arange(STEPS)[:, None] - STEPS // 2) * STEP
    t = np.floor(log_w / r + b)
    bids = np.log(c) - r * (t - b + 1)
    _, rank = np.unique(bids, return_inverse=True)
    return rank.reshape(-1).astype(np.uint64)


class Weights:
    """Distinct shingles of a text with their weights."""

    def __init__(self, common: np.ndarray, idf: np.ndarray, top: float):
        self.common, self.idf, self.top = common, idf, top

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, n = np.unique(shingles(words), return_counts=True)
        weight = np.full(len(own), self.top)
        hit, at = _places(self.common, own)
        weight[hit] = self.idf[at]
        return own, n * weight


def draw(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """DRAWS samples of each text, from its shingles and weights. All texts have shingles."""
    keys = np.concatenate([own for own, _ in texts])
    weight = np.concatenate([w for _, w in texts])
    starts = np.cumsum([0] + [len(own) for own, _ in texts])[:-1]
    step = np.clip(np.rint(np.log(np.maximum(weight, 1e-9)) / STEP) + STEPS // 2, 0, STEPS - 1).astype(np.int64) * VARIATES
    bids, out = _bids(), np.empty((len(texts), DRAWS), np.uint64)
    for k in range(DRAWS):
        own = (keys ^ np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
        own ^= own >> np.uint64(33)
        own *= np.uint64(0xC4CEB9FE1A85EC53)
        bid = bids[step + (own >> np.uint64(48)).astype(np.int64)]
        out[:, k] = np.minimum.reduceat((bid << np.uint64(40)) | (own & np.uint64((1 << 40) - 1)), starts)
    return out


_BUCKETS = {"doc_id": pa.int64(), "buckets": pa.list_(pa.int64()), "draws": pa.binary()}


def _signatures(weights):
    """Buckets of each text, and 16 bits of each of its draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, 1):
                read = _words_of(batch.column(1))
                for some in slices(iter([batch]), 1, SIGNED_BYTES):
                    texts = [weights.value.of(next(read)) for _ in range(some.num_rows)]
                    full = [i for i, (own, _) in enumerate(texts) if len(own)]
                    if not full:
                        continue
                    drawn = draw([texts[i] for i in full])
                    made = []
                    for band in range(BANDS):
                        mark = np.full(len(full), band + 1, np.uint64)
                        for j in range(ROWS):
                            mark = mixed(mark * _BASE + drawn[:, band * ROWS + j])
                        made.append(mark.view(np.int64))
                    short = mixed(drawn).astype("<u2")
                    yield to_batch({"doc_id": some.column(0).take(pa.array(full)), "buckets": list(np.stack(made, axis=1)), "draws": [x.tobytes() for x in short]}, _BUCKETS)

    return run


def likely_pairs(draws: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a group's texts, by place: the edges of a greatest spanning tree of their agreements."""
    n = len(draws)
    agree = (draws[:, None, :] == draws[None, :, :]).mean(axis=2) if n <= 128 else np.stack([(draws == one).mean(axis=1) for one in draws])
    if n == 2:
        return [(0, 1)] if agree[0, 1] >= LIKELY else []
    np.fill_diagonal(agree, -1)
    pairs = set()
    best, source, free = agree[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    free[0] = False
    for _ in range(n - 1):
        at = int(np.argmax(np.where(free, best, -2)))
        if best[at] >= LIKELY:
            pairs.add((min(at, int(source[at])), max(at, int(source[at]))))
        free[at] = False
        nearer = agree[at] > best
        best[nearer], source[nearer] = agree[at][nearer], at
    return sorted(pairs)


def _pair_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each run of rows with equal bucket and salt."""
    key, ids, draws, out = None, [], [], []

    def close() -> None:
        if len(ids) > 1:
            out.extend((ids[i], ids[j]) for i, j in likely_pairs(np.frombuffer(b"".join(draws), "<u2").reshape(len(ids), -1)))

    for batch in batches:
        for bucket, salt, doc_id, drawn in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (bucket, salt) != key:
                close()
                key, ids, draws = (bucket, salt), [], []
            ids.append(doc_id)
            draws.append(drawn)
        yield to_batch({"a": [min(x) for x in out], "b": [max(x) for x in out]}, {"a": pa.int64(), "b": pa.int64()})
        out.clear()
    close()
    if out:
        yield to_batch({"a": [min(x) for x in out], "b": [max(x) for x in out]}, {"a": pa.int64(), "b": pa.int64()})


_VECTORS = {"doc_id": pa.int64(), "shingles": pa.binary(), "weights": pa.binary()}


def _vectors(weights):
    """Sorted 32-bit shingles and weights of each text; no weights where all are the one of a single rare shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, 1):
                out: dict[str, list] = {"doc_id": batch.column(0), "shingles": [], "weights": []}
                for words in _words_of(batch.column(1)):
                    own, weight = weights.value.of(words)
                    short = (own >> np.uint64(32)).astype("<u4")
                    order = np.argsort(short, kind="stable")
                    out["shingles"].append(short[order].tobytes())
                    out["weights"].append(b"" if (weight == weights.value.top).all() else weight[order].astype(np.float32).tobytes())
                yield to_batch(out, _VECTORS)

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of greatest weights; shingles are sorted."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    hit, at = _places(a[0], b[0])
    least = float(np.minimum(a[1][at], b[1][hit]).sum(dtype=np.float64))
    return least / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - least)


def _read(own: bytes, weight: bytes, top: float) -> tuple[np.ndarray, np.ndarray]:
    shingle = np.frombuffer(own, "<u4")
    return shingle, np.frombuffer(weight, np.float32) if weight else np.full(len(shingle), np.float32(top))


def _compare(top: float):
    """Similarity of each row's two vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *packed = (batch.column(i).to_pylist() for i in range(6))
            similarity = [weighted_jaccard(_read(p, q, top), _read(r, s, top)) for p, q, r, s in zip(*packed, strict=True)]
            yield to_batch({"a": a, "b": b, "similarity": similarity}, {"a": pa.int64(), "b": pa.int64(), "similarity": pa.float64()})

    return run


def _link_blocks(top: float, threshold: float):
    """Links between the strays and the other texts of each run of rows with equal bucket, i and j."""

    def links(strays: list, every: list) -> list[tuple[int, int]]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if not strays or not every:
            return []
        drawn = np.frombuffer(b"".join(row[2] for row in every), "<u2").reshape(len(every), -1)
        read = [_read(row[3], row[4], top) for row in every]
        total = np.array([float(w.sum(dtype=np.float64)) for _, w in read])
        found = []
        for doc_id, label, draws, shingle, weight in strays:
            mine = _read(shingle, weight, top)
            size = float(mine[1].sum(dtype=np.float64))
            agree = (drawn == np.frombuffer(draws, "<u2")).mean(axis=1)
            # A similarity is at most the smaller over the larger total.
            near = np.flatnonzero((agree >= LIKELY) & (np.minimum(total, size) >= (threshold - 1e-9) * np.maximum(total, size)))
            for at in near[np.argsort(-agree[near], kind="stable")]:
                other, its = every[at][0], every[at][1]
                if other == doc_id or find(label) == find(its):
                    continue
                if weighted_jaccard(mine, read[at]) >= threshold:
                    parent[find(label)] = find(its)
                    found.append((min(doc_id, other), max(doc_id, other)))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, strays, every = None, [], []
        for batch in batches:
            out = []
            for bucket, i, j, stray, *row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if (bucket, i, j) != key:
                    out += links(strays, every)
                    key, strays, every = (bucket, i, j), [], []
                (strays if stray else every).append(row)
            yield to_batch({"a": [a for a, _ in out], "b": [b for _, b in out]}, {"a": pa.int64(), "b": pa.int64()})
        out = links(strays, every)
        yield to_batch({"a": [a for a, _ in out], "b": [b for _, b in out]}, {"a": pa.int64(), "b": pa.int64()})

    return run


def components(edges: DataFrame, name: str = "neardup-components") -> DataFrame:
    """node and its component's smallest node, for the nodes of edges (a, b). Rounds end when no label changes."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), name)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        new = stage(lower.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.coalesce("next", "label").alias("label")), name)
        changed = not new.where("label <> old").isEmpty()
        drop(labels)
        labels = new.select("node", "label")
        labels._staged_at = new._staged_at
        if not changed:
            drop(both)
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_copies (rows with its words) for each row of docs (doc_id, text) with a doc_id."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = stage(map_batches(texts, _sketch, "doc_id long, one long, two long, counts binary"), "neardup-texts")
    rows = read.where("counts is null").select("doc_id", "one", "two")
    weights = spark.sparkContext.broadcast(_common_weights(texts, read, rows.count()))
    # One text for all its exact copies.
    firsts = stage(rows.groupBy("one", "two").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies")), "neardup-firsts")
    signed = map_batches(texts, _signatures(weights), "doc_id long, buckets array<long>, draws binary")
    signed = stage(signed.join(firsts.select("text_id").hint("merge"), F.col("doc_id") == F.col("text_id"), "left_semi"), "neardup-signatures")
    members = stage(_members(signed), "neardup-members")
    wanted = texts.join(members.select(F.col("doc_id").alias("held_id")).distinct().hint("merge"), F.col("doc_id") == F.col("held_id"), "left_semi")
    vectors = stage(map_batches(wanted, _vectors(weights), "doc_id long, shingles binary, weights binary").dropDuplicates(["doc_id"]), "neardup-vectors")
    top = float(np.log(1 / COMMON))
    links = stage(_candidates(signed, members), "neardup-candidates")
    found = stage(_verified(links, vectors, top, threshold), "neardup-links")
    labels = components(found)
    # Stars of each bucket's best linked text, then all pairs of what is still apart.
    unlinked = stage(_open(members, labels), "neardup-open")
    stars = stage(_verified(_stars(unlinked, found), vectors, top, threshold), "neardup-stars")
    if not stars.isEmpty():
        found = found.unionByName(stars)
        drop(labels, unlinked)
        labels = components(found)
        unlinked = stage(_open(members, labels), "neardup-open")
    rest = stage(_rest(unlinked, signed, vectors, top, threshold), "neardup-rest")
    if not rest.isEmpty():
        drop(labels)
        labels = components(found.unionByName(rest))
    drop(vectors, signed, links, members, unlinked)
    classes = firsts.join(labels, F.col("text_id") == F.col("node"), "left").select("one", "two", "n_copies", F.coalesce("label", "text_id").alias("class_id"))
    return rows.join(stage(classes, "neardup-classes"), ["one", "two"]).select("doc_id", "class_id", "n_copies")


def _verified(links: DataFrame, vectors: DataFrame, top: float, threshold: float) -> DataFrame:
    """Those of links (a, b) with a similarity of at least threshold."""
    side = lambda x: vectors.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"{x}_shingles"), F.col("weights").alias(f"{x}_weights"))
    paired = links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_shingles", "a_weights", "b_shingles", "b_weights")
    return map_batches(paired, _compare(top), "a long, b long, similarity double").where(F.col("similarity") >= threshold).select("a", "b")


def _common_weights(texts: DataFrame, read: DataFrame, n: int) -> Weights:
    """Inverse document frequencies of the shingles that at least a share COMMON of all n documents hold."""
    parts = read.where("counts is not null").select("one", "counts").repartition(_partitions(texts), "one").sortWithinPartitions("one")
    cells = np.sort(map_batches(parts, _hot_cells(COMMON * n), "cell long").toArrow().column("cell").to_numpy())
    counts = []
    if len(cells):
        sent = texts.sparkSession.sparkContext.broadcast(cells)
        counted = map_batches(texts.select("text"), _count_hot(sent), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        counts = [(r.shingle, r.n) for r in counted.where(F.col("n") >= COMMON * n).collect()]
    common = np.array([s for s, _ in counts], np.int64).view(np.uint64)
    order = np.argsort(common)
    idf = np.maximum(np.log(n / np.array([c for _, c in counts], float)), 0.01)[order]
    return Weights(common[order], idf, float(np.log(1 / COMMON)))


def _members(signed: DataFrame) -> DataFrame:
    """bucket, doc_id, smallest doc_id (head) and size n, of buckets of at least two texts."""
    pairs = signed.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = pairs.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("head < last").select("bucket", "head", "n")
    return pairs.join(shared, "bucket")


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _candidates(signed: DataFrame, members: DataFrame) -> DataFrame:
    """Likely pairs a < b of the texts of signed (doc_id, buckets, draws)."""
    large = members.where((F.col("n") > GROUP) & (F.col("head") < F.col("doc_id"))).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    salt = F.pmod(F.xxhash64("doc_id", "bucket"), F.ceil(F.col("n") / GROUP)).cast("int")
    grouped = members.select("doc_id", "bucket", salt.alias("salt")).join(signed.select("doc_id", "draws"), "doc_id")
    grouped = grouped.select("bucket", "salt", "doc_id", "draws").repartition(_partitions(signed), "bucket", "salt").sortWithinPartitions("bucket", "salt", "doc_id")
    return map_batches(grouped, _pair_groups, "a long, b long").unionByName(large).where("a < b").distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with texts in several components: bucket, doc_id, n, label, the label that most have, n_stray others.

    In a bucket of two texts the pair was a candidate.
    """
    known = members.where("n > 2").join(labels, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    known = stage(known, "neardup-known")
    most = known.groupBy("bucket", "label").agg(F.count("*").alias("own"), F.max("n").alias("size")).groupBy("bucket").agg(F.max(F.struct("own", "label")).alias("most"), F.max("size").alias("size"))
    most = most.where("most.own < size").select("bucket", F.col("most.label").alias("most"), (F.col("size") - F.col("most.own")).alias("n_stray"))
    return known.join(most, "bucket")


def _stars(unlinked: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs a < b of a bucket's best linked text of the component that most have, and the texts of other components."""
    ends = found.select(F.col("a").alias("end")).unionByName(found.select(F.col("b").alias("end"))).groupBy("end").agg(F.count("*").alias("degree"))
    inner = unlinked.where("label = most").join(ends, F.col("doc_id") == F.col("end"), "left")
    hubs = inner.groupBy("bucket").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "doc_id")).getField("doc_id").alias("hub"))
    pairs = unlinked.where("label <> most").select("bucket", "doc_id").join(hubs, "bucket")
    return pairs.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()


def _rest(unlinked: DataFrame, signed: DataFrame, vectors: DataFrame, top: float, threshold: float) -> DataFrame:
    """Links a, b that join the components of each bucket: every text outside the largest one meets every other text.

    Those texts (strays) are dealt into groups, as are all texts; each group of strays meets each group of all.
    """
    groups = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("doc_id", "bucket"), groups(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), groups(n) - 1))
    stray = unlinked.where("label <> most").select("bucket", deal("n_stray").alias("i"), others("n").alias("j"), F.lit(True).alias("stray"), "doc_id", "label")
    every = unlinked.select("bucket", others("n_stray").alias("i"), deal("n").alias("j"), F.lit(False).alias("stray"), "doc_id", "label")
    placed = stray.unionByName(every).join(signed.select("doc_id", "draws"), "doc_id").join(vectors, "doc_id")
    placed = placed.select("bucket", "i", "j", "stray", "doc_id", "label", "draws", "shingles", "weights").repartition(_partitions(signed), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc_id")
    return map_batches(placed, _link_blocks(top, threshold), "a long, b long").distinct()


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose class has a smaller doc_id. Rows without doc_id stay.

    Repeated rows of one doc_id are one; where their texts differ, the text of the least hash stays, whatever the order.
    """
    first = near_duplicates(docs, threshold).where("doc_id = class_id").select(F.col("class_id").alias("kept_id")).distinct()
    kept = docs.join(first.hint("merge"), F.col("doc_id") == F.col("kept_id"), "left_semi")
    chosen = kept.groupBy("doc_id").agg(F.min_by(F.struct(*[kept[name] for name in kept.columns]), F.xxhash64("text")).alias("first_row"))
    return chosen.select("first_row.*").unionByName(docs.where("doc_id is null"))
