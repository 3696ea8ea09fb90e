"""Words from XML annotations in zip archives: members are streamed out of each archive, dealt out and parsed one by one.

What can't be read is a row with a reason: a damaged archive, one without annotations, a damaged member.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = ".words.xml"
_MEMBERS = "member string, data binary, reason string"
_WORDS = "speaker string, start_ms long, end_ms long, word string, reason string"


class _Members:
    """The word annotations of an archive, one a row."""

    def eval(self, content: bytes, meeting: str) -> Iterator[tuple]:
        wanted, found = f"/words/{meeting or ''}", 0
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except zipfile.BadZipFile:
            yield None, None, "damaged archive"
            return
        for name in archive.namelist():
            if wanted in f"/{name}" and name.endswith(SUFFIX) and (not meeting or f"{wanted}." in f"/{name}"):
                found += 1
                try:
                    yield name, archive.read(name), None
                except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError) as error:
                    yield name, None, f"damaged member: {type(error).__name__}"
        if not found:
            yield None, None, "no word annotations"


def _milliseconds(value: str | None) -> int | None:
    return None if value is None else round(float(value) * 1000)


class _Words:
    """The timed words of one member."""

    def eval(self, member: str | None, data: bytes | None, reason: str | None) -> Iterator[tuple]:
        if reason:
            yield None, None, None, None, reason
            return
        parts = member.rsplit("/", 1)[-1].split(".")
        speaker = f"SPEAKER_{parts[1] if len(parts) >= 3 else 'UNKNOWN'}"
        try:
            read = []
            for _, element in ElementTree.iterparse(io.BytesIO(data)):
                if element.tag.rsplit("}", 1)[-1] == "w":
                    text, times = (element.text or "").strip(), [_milliseconds(element.attrib.get(name)) for name in ("starttime", "endtime")]
                    if text and None not in times:
                        read.append((speaker, *times, text, None))
        except (ElementTree.ParseError, ValueError) as error:
            yield None, None, None, None, f"damaged member: {type(error).__name__}"
            return
        yield from read


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the zip files below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")


def archive_words(archives: DataFrame, meeting: str = "", partitions: int | None = None) -> DataFrame:
    """path, member, speaker, start_ms, end_ms, word and reason of the words in archives (path, content), of one meeting or, by default, all.

    An archive is unpacked in one task, as its directory is at its end; its members are dealt out to all tasks by name. A
    member whose words can't all be read gives its reason and no words.
    """
    members, words = F.udtf(_Members, returnType=_MEMBERS), F.udtf(_Words, returnType=_WORDS)
    listed = archives.lateralJoin(members(F.col("content").outer(), F.lit(meeting))).select("path", "member", "data", F.col("reason").alias("failed"))
    dealt = listed.repartition(partitions or int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "member")
    return dealt.lateralJoin(words(F.col("member").outer(), F.col("data").outer(), F.col("failed").outer())).select("path", "member", "speaker", "start_ms", "end_ms", "word", "reason")
