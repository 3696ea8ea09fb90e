"""Mixture-controlled packing: a fair merge of source queues.

Every source is a queue of its documents' tokens. Token k of a queue of n is due at (k + 1/2) / n of the whole, in ticks
of one token; queues are merged by due time, then by source, and each LENGTH tokens of the merge are a sequence, in which
a queue's tokens lie together. So any task can work out which sequence holds a token from the queues' numbers of tokens:
nothing crosses sequences and partitions as a state. A queue is never more than a few tokens from its share of the tokens
packed, however small the share; a queue of less than a token a sequence sends one every few sequences. All queues run
dry together in the last sequence, so nothing but that one is padded, and every sequence holds the mix.

The null source is a source like any other. Null text is empty: it has only the end-of-document token. Within a queue,
documents keep the order of the input's partitions. Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import drop, map_batches, slices, split_words, stage, to_batch

LENGTH = 4096
END = 2
#: Entries of a matrix of places by queues that are worked out at once.
ENTRIES = 1 << 21
#: Bytes of text that are tokenized at once.
TEXT_BYTES = 6 << 20
#: Pieces whose ids a worker remembers; when full, it starts anew.
REMEMBERED = 1_000_000
#: Punctuation that the tokenizer takes as one piece after letters, what isn't that, and a word of Latin-1 letters.
_TAIL = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
_NOT_TAIL = r"^[^!\"#$%&()*+,\-./:;=?@\[\]^_`{}~]*"
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]*$"


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _letters_of_bytes() -> dict[int, int]:
    """The letter that a byte-level model has for each byte: its own where that prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in prints]
    return dict(zip(prints, prints, strict=True)) | {byte: 256 + i for i, byte in enumerate(rest)}


def _byte_letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_letters_of_bytes())


class WordTokenizer:
    """Ids of texts by a tokenizer that lower-cases and drops white space, so that words are encoded once and remembered.

    A word that is Latin-1 letters, or those and punctuation after them, is two of the tokenizer's own pieces, which are
    remembered. Any other word is a piece of its own and goes through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.remembered, self.pieces = path, remembered, {}
        self.model = _tokenizer(path).model

    def _encode_whole(self, new: list[str]) -> None:
        """Encode pieces that are whole for the tokenizer, so that its model alone is needed."""
        cut = self.model.tokenize
        for piece in new:
            self.pieces[piece] = array("I", [one.id for one in cut(piece if piece.isascii() else _byte_letters(piece))]).tobytes()

    def _encode_others(self, new: list[str]) -> None:
        for start in range(0, len(new), 4096):
            some = new[start : start + 4096]
            coded = _tokenizer(self.path).encode_batch_fast(some, add_special_tokens=False)
            self.pieces.update((word, np.array(one.ids, "<u4").tobytes()) for word, one in zip(some, coded, strict=True))

    def _ids(self, pieces: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has."""
        listed = pieces.to_pylist()
        if len(self.pieces) + len(listed) > self.remembered:
            self.pieces = {}
        self.pieces.setdefault("", b"")
        coded = list(map(self.pieces.get, listed))
        if None in coded:
            encode([piece for piece, ids in zip(listed, coded, strict=True) if ids is None])
            coded = list(map(self.pieces.__getitem__, listed))
        return np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each text has. ASCII white space never lies in a token."""
        words, place, n = split_words(texts)
        core = pc.utf8_rtrim(words, characters=_TAIL)
        whole = pc.match_substring_regex(core, _LETTERS)
        core = pc.if_else(whole, pc.utf8_lower(core), "").dictionary_encode()
        tail = pc.if_else(whole, pc.replace_substring_regex(words, pattern=_NOT_TAIL, replacement=""), "").dictionary_encode()
        other = pc.if_else(whole, "", words).dictionary_encode()
        ids, first, length = np.zeros(0, "<u4"), [], []
        for part, encode in ((core, self._encode_whole), (tail, self._encode_whole), (other, self._encode_others)):
            own, size = self._ids(part.dictionary, encode)
            at = part.indices.to_numpy(zero_copy_only=False)
            first.append((len(ids) + np.cumsum(size) - size)[at])
            length.append(size[at])
            ids = np.concatenate([ids, own])
        # Each word is its core, its tail and, if those are empty, itself.
        first, length = np.stack(first, axis=1)[place].reshape(-1), np.stack(length, axis=1)[place].reshape(-1)
        through = np.cumsum(length)
        edge = np.append(0, through[2::3])[np.append(0, np.cumsum(n))]
        total = int(length.sum())
        return ids[np.repeat(first - (through - length), length) + np.arange(total)], np.diff(edge)


@cache
def _words_of(path: str) -> WordTokenizer:
    """A worker's tokenizer, which keeps what it knows from task to task."""
    return WordTokenizer(path)


_TOKENS = {"part": pa.int64(), "doc_id": pa.int64(), "source": pa.string(), "first": pa.int64(), "n": pa.int64(), "ids": pa.binary()}
_TOKENS_SCHEMA = "part long, doc_id long, source string, first long, n long, ids binary"


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _words_of(path)
        part, sent = TaskContext.get().partitionId(), {}
        for batch in slices(batches, 2, TEXT_BYTES):
            sources = batch.column(1).to_pylist()
            ids, n = tokenizer.encode(batch.column(2))
            ids, n = np.insert(ids, np.cumsum(n), end), n + 1
            first = []
            for source, own in zip(sources, n.tolist(), strict=True):
                first.append(sent.get(source, 0))
                sent[source] = first[-1] + own
            wide = 2 if ids.max(initial=0) < 65536 else 4
            cut = np.append(0, np.cumsum(n)) * wide
            whole = ids.astype(f"<u{wide}").tobytes()
            yield to_batch({"part": [part] * len(n), "doc_id": batch.column(0), "source": sources, "first": first, "n": n, "ids": [whole[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]}, _TOKENS)

    return run


class Rounds:
    """Who sends what in which sequence, from the queues' numbers of tokens."""

    def __init__(self, tokens: list[int], length: int):
        self.length, self.total = length, sum(tokens)
        kind = np.int64 if self.total * self.total < 2**60 else object
        self.tokens = np.array(tokens, kind)

    def _due(self, ticks: np.ndarray) -> np.ndarray:
        """Tokens of each queue (a column) that are due before each tick."""
        due = -((self.total - 2 * self.tokens[None, :] * ticks[:, None]) // (2 * self.total))
        return np.maximum(due, 0)

    def sent(self, sequences: np.ndarray) -> np.ndarray:
        """Tokens that each queue (a column) has sent when that many sequences are full."""
        packed = np.minimum(sequences.astype(self.tokens.dtype) * self.length, self.total)
        # The last tick before which no more than that is due; it differs from packed by half a token a queue at most.
        low, high = np.maximum(packed - len(self.tokens) - 1, 0), np.minimum(packed + len(self.tokens) + 1, self.total)
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self._due(middle).sum(axis=1) <= packed
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        due = self._due(low)
        now = self._due(low + 1) - due
        left = (packed - due.sum(axis=1))[:, None] - (np.cumsum(now, axis=1) - now)
        return (due + np.minimum(np.maximum(left, 0), now)).astype(np.int64)

    def sequence_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The sequence, from 0, that holds each place of each queue."""
        out, some = np.empty(len(place), np.int64), max(1, ENTRIES // len(self.tokens))
        for start in range(0, len(place), some):
            own, at = queue[start : start + some], place[start : start + some].astype(self.tokens.dtype)
            tick = (2 * at + 1) * self.total // (2 * self.tokens[own])
            due, row = self._due(tick), np.arange(len(at))
            now = self._due(tick + 1) - due
            before = (np.cumsum(now, axis=1) - now)[row, own] + due.sum(axis=1) + at - due[row, own]
            out[start : start + some] = (before // self.length).astype(np.int64)
        return out

    def _parts(self, sequence: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a queue in a sequence: tokens that it has sent before and after, and tokens of other queues before its own."""
        out, some = np.empty((3, len(own)), np.int64), max(1, ENTRIES // len(self.tokens))
        for start in range(0, len(own), some):
            one, place = np.unique(sequence[start : start + some], return_inverse=True)
            before, after = self.sent(one), self.sent(one + 1)
            ahead, queue = np.cumsum(after - before, axis=1) - (after - before), own[start : start + some]
            out[:, start : start + some] = before[place, queue], after[place, queue], ahead[place, queue]
        return out[0], out[1], out[2]

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Pieces of documents of n > 0 tokens from start on in their queues: row, sequence, start, length, offset."""
        first, last = self.sequence_of(queue, start), self.sequence_of(queue, start + n - 1)
        # By sequences, or by tokens where there are fewer of them.
        many = np.minimum(last - first + 1, n)
        row = np.repeat(np.arange(len(n)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        sequence, sparse = first[row] + at, (last - first + 1 > n)[row]
        sequence[sparse] = self.sequence_of(queue[row[sparse]], start[row[sparse]] + at[sparse])
        single = np.append(True, (np.diff(row) != 0) | (np.diff(sequence) != 0))[: len(row)]
        row, sequence = row[single], sequence[single]
        before, after, ahead = self._parts(sequence, queue[row])
        low = np.maximum(before, start[row])
        high = np.minimum(after, start[row] + n[row])
        found = {"row": row, "sequence": sequence, "start": low - start[row], "length": high - low, "offset": ahead + low - before}
        return {name: values[high > low] for name, values in found.items()}


_PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "source": pa.string()}
_PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _pack(tokens: list[int], length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(tokens, length)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_id, source, queue, start, n = (batch.column(i) for i in range(5))
            n = n.to_numpy()
            ids = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4") for x, k in zip(batch.column(5).to_pylist(), n, strict=True)]
            found = rounds.pieces(queue.to_numpy(), start.to_numpy(), n)
            cut = [ids[r][s : s + k].tobytes() for r, s, k in zip(found["row"], found["start"], found["length"], strict=True)]
            out = {"doc_id": doc_id.take(pa.array(found["row"])), "start": found["start"], "length": found["length"], "ids_crc32": [zlib.crc32(x) for x in cut], "doc_tokens": n[found["row"]], "sequence_id": found["sequence"], "offset": found["offset"], "source": source.take(pa.array(found["row"]))}
            yield to_batch(out | ({"ids": cut} if with_ids else {}), _PIECES | ({"ids": pa.binary()} if with_ids else {}))

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece of docs (doc_id, source, text): where it starts and where it lies; with_ids adds its ids.

    The tokens are written once, as a table in the shared folder. The driver and the tasks get each source's tokens.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    tokens = stage(map_batches(rows, _tokenize(tokenizer_path, end), _TOKENS_SCHEMA), "pack-tokens")
    parts = stage(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "pack-parts")
    queues = [(row.source, row.n) for row in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()]
    queues.sort(key=lambda x: (x[0] is None, x[0] or ""))
    numbers = [n for _, n in queues]
    numbered = docs.sparkSession.createDataFrame([(source, i) for i, (source, _) in enumerate(queues)], "queue_source string, queue long")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(numbered), F.expr("source <=> queue_source"))
    starts = stage(starts.select(F.col("source").alias("start_source"), F.col("part").alias("start_part"), "queue", "before"), "pack-starts")
    placed = tokens.join(starts, F.expr("source <=> start_source and part = start_part"))
    placed = placed.select("doc_id", "source", "queue", (F.col("before") + F.col("first")).alias("start"), "n", "ids")
    drop(parts)
    return map_batches(placed, _pack(numbers, length, with_ids), _PIECES_SCHEMA + ", ids binary" * with_ids)
