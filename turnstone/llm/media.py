"""Media columns: Netpbm and BMP bytes to arrays, NPY tiles and difference hashes.

``store_payload`` writes bytes as binary PGM, one byte a sample; ``media_features`` decodes the stored bytes of any
Netpbm (P1 to P6) or uncompressed BMP image, resizes by area over an integral image and returns an NPY tile and a
difference hash. Null content is empty content; bytes that are no such image give null features and a reason.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import map_batches, slices, to_batch, utf8

#: Samples in a row of a stored payload, and the multiple to which a payload is padded.
WIDTH = 64


def pad_payload(content: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return content + bytes(max(1, -(-len(content) // WIDTH)) * WIDTH - len(content))


def encode_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _netpbm(data: bytes) -> tuple[np.ndarray, int]:
    kind, at, fields = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _HEADER.match(data, at)
        if not found:
            raise ValueError("short header")
        fields.append(int(found[1]))
        at = found.end()
    width, height = fields[:2]
    top = fields[2] if len(fields) == 3 else 1
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("bad header")
    planes = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * planes
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array([int(x) for x in (re.findall(rb"[01]", body) if kind == b"P1" else body.split())][:count], np.int64)
    elif kind == b"P4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)
        values = bits[:, :width].reshape(-1).astype(np.int64)
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at + 1)
    if len(values) < count:
        raise ValueError("short data")
    if kind in (b"P1", b"P4"):
        values = 1 - values
    values = values.astype(np.uint16 if top > 255 else np.uint8)
    return values.reshape((height, width, 3) if planes == 3 else (height, width)), top


def _bmp(data: bytes) -> np.ndarray:
    offset, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if header < 40 or (packed, bits) not in ((0, 8), (0, 24), (0, 32), (3, 16), (3, 32)) or width < 1 or height == 0:
        raise ValueError("not an uncompressed 8, 16, 24 or 32 bit bitmap")
    row = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if packed == 3:
        return _bit_fields(rows[:, : width * bits // 8], bits, struct.unpack_from("<III", data, 54))
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)
        return palette[pixels[:, :, 0]][:, :, 2::-1]
    return pixels[:, :, 2::-1]


def _bit_fields(rows: np.ndarray, bits: int, masks: tuple[int, int, int]) -> np.ndarray:
    """Red, green and blue from the bits that the masks name, each stretched to 0 to 255."""
    words = np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4").astype(np.int64)
    out = np.zeros((*words.shape, 3), np.uint8)
    for i, mask in enumerate(masks):
        if mask:
            low = (mask & -mask).bit_length() - 1
            most = mask >> low
            out[:, :, i] = (((words & mask) >> low) * 255 + most // 2) // most
    return out


def scaled(image: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to top stretched to all that their type holds, so that images of any top compare."""
    most = np.iinfo(image.dtype).max
    return image if top == most else ((image.astype(np.int64) * most + top // 2) // top).clip(0, most).astype(image.dtype)


def decode_samples(data: bytes) -> tuple[np.ndarray, int]:
    """Height x width samples, or height x width x 3 for colours, and the greatest value that they may have.

    ValueError if the bytes are no such image.
    """
    try:
        if re.match(rb"P[1-6]\s", data):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data), 255
    except (struct.error, ValueError, OverflowError) as bad:
        raise ValueError(f"damaged image: {bad}") from None
    raise ValueError("neither Netpbm nor BMP")


def decode_image(data: bytes) -> np.ndarray:
    """The samples alone."""
    return decode_samples(data)[0]


def _at_edges(table: np.ndarray, size: int, parts: int) -> np.ndarray:
    """parts times the integral table's rows at the parts + 1 edges that cut size rows evenly."""
    edge = np.arange(parts + 1, dtype=np.int64) * size
    whole, rest = edge // parts, edge % parts
    after = table[np.minimum(whole + 1, size)]
    return table[whole] * parts + (after - table[whole]) * rest.reshape(-1, *[1] * (table.ndim - 1))


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, rounded half up; whole-number arithmetic over the integral image."""
    grey = image if image.ndim == 2 else image.astype(np.int64) @ np.array([299, 587, 114]) // 1000
    rows, columns = grey.shape
    table = np.zeros((rows + 1, columns + 1), np.int64)
    np.cumsum(grey, 0, out=table[1:, 1:])
    np.cumsum(table[1:, 1:], 1, out=table[1:, 1:])
    cut = _at_edges(_at_edges(table, rows, height).T, columns, width).T
    sums = cut[1:, 1:] - cut[:-1, 1:] - cut[1:, :-1] + cut[:-1, :-1]
    area = rows * columns
    return (2 * sums + area) // (2 * area)


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: whether each of 8 x 9 area means is less than its right neighbour."""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image as a side x side NPY file."""
    out = io.BytesIO()
    np.lib.format.write_array(out, area_resize(image, side, side).astype(image.dtype), version=(1, 0))
    return out.getvalue()


_STORED = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary()}


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        content = utf8(batch.column(1))
        yield to_batch({"doc_id": batch.column(0), "n_bytes": [len(x) for x in content], "media": [encode_pgm(pad_payload(x)) for x in content]}, _STORED)


def store_payload(rows: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """Each row's bytes as a PGM image, which holds them all: doc_id, n_bytes, media."""
    return map_batches(rows.select(F.col(key).cast("long").alias("doc_id"), F.col(content).cast("binary").alias("content")), _store, "doc_id long, n_bytes long, media binary")


_FEATURES = {
    "doc_id": pa.int64(), "height": pa.int32(), "width": pa.int32(), "samples_bytes": pa.int64(), "samples_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "dhash": pa.string(), "tile_npy": pa.binary(), "problem": pa.string(),
}
FEATURE_SCHEMA = "doc_id long, height int, width int, samples_bytes long, samples_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile_npy binary, problem string"


def _features(side: int, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: dict[str, list] = {name: [] for name in _FEATURES}
            out["doc_id"] = batch.column(0)
            for media in utf8(batch.column(1)):
                row: dict = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
                try:
                    image, top = decode_samples(media)
                    samples = image.tobytes()
                    row |= {"height": image.shape[0], "width": image.shape[1], "samples_bytes": len(samples), "samples_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-WIDTH:])}
                    image = scaled(image, top)
                    row |= {"dhash": difference_hash(image), "tile_npy": npy_tile(image, side)}
                except ValueError as bad:
                    row["problem"] = str(bad)
                for name in _FEATURES:
                    if name != "doc_id":
                        out[name].append(row.get(name))
            made = to_batch(out, _FEATURES)
            names = [*batch.schema.names[2 : 2 + carried], *_FEATURES]
            yield pa.RecordBatch.from_arrays([*batch.columns[2 : 2 + carried], *made.columns], names=names)

    return run


def media_features(rows: DataFrame, key: str = "doc_id", media: str = "media", side: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """Decode the stored images: shape, hashes of samples and of stored bytes, difference hash, NPY tile.

    A row for each input row, repeated rows too, with the carried columns as they are. Images that can't be decoded
    have null features and a problem.
    """
    kept = rows.select(F.col(key).cast("long").alias("doc_id"), F.col(media).alias("media"), *carry)
    schema = "".join(f"`{name}` {kept.schema[name].dataType.simpleString()}, " for name in carry) + FEATURE_SCHEMA
    return map_batches(kept, _features(side, len(carry)), schema)


def write_tiles(features: DataFrame, path: str) -> None:
    """The tiles as a table: doc_id, dhash, tile_npy (each a whole NPY file)."""
    features.where("tile_npy is not null").select("doc_id", "dhash", "tile_npy").write.parquet(path)
