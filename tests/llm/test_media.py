import hashlib
import io
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import media
from turnstone.llm.queries import op6_media

from .conftest import SF


def slow_resize(image, height, width):
    """Area means by adding up every piece of every pixel."""
    rows, columns = image.shape
    out = np.zeros((height, width), np.int64)
    for i in range(height):
        for j in range(width):
            top, bottom, left, right = Fraction(i * rows, height), Fraction((i + 1) * rows, height), Fraction(j * columns, width), Fraction((j + 1) * columns, width)
            total = Fraction(0)
            for y in range(rows):
                for x in range(columns):
                    high, wide = min(bottom, y + 1) - max(top, y), min(right, x + 1) - max(left, x)
                    if high > 0 and wide > 0:
                        total += high * wide * int(image[y, x])
            out[i, j] = int(total / ((bottom - top) * (right - left)) + Fraction(1, 2))
    return out


@pytest.mark.parametrize("shape", [(1, 64), (5, 7), (8, 9), (20, 13)])
def test_resize_against_brute_force(shape):
    image = np.random.default_rng(3).integers(0, 256, shape, np.uint8)
    for size in ((8, 9), (4, 4), (16, 16)):
        assert np.array_equal(media.area_resize(image, *size), slow_resize(image, *size))
    small = slow_resize(image, 8, 9)
    assert media.difference_hash(image) == f"{int(''.join(str(int(a < b)) for row in small for a, b in zip(row, row[1:], strict=False)), 2):016x}"


def test_formats():
    rng = np.random.default_rng(4)
    grey, colour = rng.integers(0, 256, (3, 5), np.uint8), rng.integers(0, 256, (3, 5, 3), np.uint8)
    assert np.array_equal(media.decode_image(b"P5 # note\n5 3\n255\n" + grey.tobytes()), grey)
    assert np.array_equal(media.decode_image(b"P6\n5 3\n255\n" + colour.tobytes()), colour)
    assert np.array_equal(media.decode_image(b"P2\n5 3\n255\n" + b" ".join(b"%d" % x for x in grey.reshape(-1))), grey)
    assert np.array_equal(media.decode_image(b"P3\n5 3\n255\n" + b" ".join(b"%d" % x for x in colour.reshape(-1))), colour)
    assert media.decode_image(b"P1\n3 2\n101\n010").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode_image(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 1, 0], [1, 0, 1]]
    wide = rng.integers(0, 65536, (2, 2)).astype(">u2")
    assert np.array_equal(media.decode_image(b"P5\n2 2\n65535\n" + wide.tobytes()), wide)
    rows = b"".join(row[:, ::-1].tobytes() + bytes(1) for row in colour[::-1])
    bitmap = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert np.array_equal(media.decode_image(bitmap), colour)
    for bad in (b"", b"GIF89a", b"P5\n5 3\n255\n", b"P5\n0 3\n255\n", b"P6 x", bitmap[:60], b"BM"):
        with pytest.raises(ValueError):
            media.decode_image(bad)


def test_query_against_brute_force(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 or (64 if not texts[r.doc_id] else 0))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.difference_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64))


def test_odd_rows_and_tiles(spark, docs, no_docs, tmp_path):
    out = media.media_features(media.store_payload(docs.withColumnRenamed("size", "media")), carry=("n_bytes",))
    assert out.count() == docs.count() and {r.samples_bytes for r in out.where("doc_id in (2, 3)").collect()} == {64}
    media.write_tiles(out, f"{tmp_path}/tiles")
    tiles = spark.read.parquet(f"{tmp_path}/tiles").collect()
    assert len(tiles) == docs.count() and all(np.load(io.BytesIO(r.tile_npy)).shape == (16, 16) for r in tiles)
    damaged = docs.select("doc_id", F.lit(b"P5 9").alias("media"))
    assert {r.problem for r in media.media_features(damaged).collect()} == {"damaged image: short header"}
    assert media.media_features(media.store_payload(no_docs)).count() == 0
