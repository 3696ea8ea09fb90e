"""What the corpus operators share: scratch tables, batches of bounded size, word hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Documents can be long, so batches hold few of them.
BATCH_ROWS = 512
#: Bytes of text that a task works on at once; a longer text is worked on by itself.
SLICE_BYTES = 4 << 20

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own.

    Only a local master without the setting gets a temporary folder; a cluster without it gets a folder in the warehouse,
    if that is no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if "://" not in warehouse:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        return f"{warehouse}/_scratch"
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="turnstone-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a written table, which cuts its lineage and outlives a lost executor."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that a batch of long documents fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with short batches; schema is a DDL string."""
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about limit bytes in the column at that place; a longer value comes by itself."""
    held, bytes_held = [], 0

    def out() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        held.clear()
        return whole

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(size[start - 1]) if start else 0
            after = int(np.searchsorted(size, before + limit - bytes_held, "right"))
            if after == start and held:
                yield out()
                bytes_held = 0
                continue
            after = max(after, start + 1)
            held.append(batch.slice(start, after - start))
            bytes_held += int(size[after - 1]) - before
            start = after
            if bytes_held >= limit:
                yield out()
                bytes_held = 0
    if held:
        yield out()


def _as_text(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def word_parts(texts: pa.Array, fold=None, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Parts of texts of about limit bytes together, cut at white space only, and the row that each part belongs to.

    fold turns all bytes (uint8) into others of the same number first, say those outside words into blanks. Null is empty.
    A run of bytes without white space stays whole, however long.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return
    own = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[own[0] : own[-1]]
    own, data = own - own[0], data if fold is None else fold(data)
    starts, owner = [own[:-1]], [np.arange(len(own) - 1)]
    for row in np.flatnonzero(np.diff(own) > limit).tolist():
        blank = np.flatnonzero((data[own[row] : own[row + 1]] == 32) | ((data[own[row] : own[row + 1]] >= 9) & (data[own[row] : own[row + 1]] <= 13)))
        cut = np.unique(np.searchsorted(blank, np.arange(limit, own[row + 1] - own[row], limit)))
        cut = blank[cut[cut < len(blank)]] + own[row]
        starts.append(cut), owner.append(np.full(len(cut), row))
    starts, owner = np.concatenate(starts), np.concatenate(owner)
    order = np.lexsort((owner, starts))
    starts, owner = np.append(starts[order], own[-1]), owner[order]
    at = 0
    while at < len(owner):
        to = max(int(np.searchsorted(starts, starts[at] + limit, "right")) - 1, at + 1)
        yield owner[at:to], _as_text(starts[at : to + 1] - starts[at], data[starts[at] : starts[to]])
        at = to


def to_batch(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A record batch with these columns, in the order of types."""
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in types.items()], names=list(types))


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts' bytes; null is empty."""
    return [text or b"" for text in texts.cast(pa.binary()).to_pylist()]


def batches_with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        yield batch, utf8(batch.column(batch.schema.get_field_index("text")))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of all texts, at ASCII white space; the place there of each word in turn; words of each text.

    Null texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    place, different = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    # White space at the ends of a text leaves an empty word.
    empty = pc.index(different, "").as_py()
    if empty >= 0:
        real = place != empty
        owner = np.repeat(np.arange(len(n)), n)[real]
        place, n = place[real], np.bincount(owner, minlength=len(n))
    return different, place, n


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_count(text) -> F.col:
    """Number of words between the six ASCII white spaces; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
