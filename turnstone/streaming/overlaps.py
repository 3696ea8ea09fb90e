"""Overlapping speech in a stream of turns: state by clip, regions that are sent when no later turn can change them.

Turns (clip_id, speaker, ts, start_ms, end_ms; ts is when a turn starts, start_ms and end_ms are milliseconds since 1970)
may come in any order within the watermark, but not at its first instant, 1970 itself, which is late from the start. A clip keeps its turns until the watermark has passed them; timers at their ends send the regions that lie before it. What
comes later than the watermark is dropped by Spark, and counted. A stream ends with a mark far in the future, after which
all regions are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "clip_id string, start_ms long, end_ms long, speakers string"
_TURN = "speaker string, start_ms long, end_ms long"
#: Between speakers' names in what a processor gives, which can't be an array.
BETWEEN = "\x1f"
#: State stores that keep lists and timers.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The clip and the time of the mark that ends a stream.
END_CLIP, END_TIME = "__end__", "2200-01-01"


def regions(turns: list[tuple[str, int, int]]) -> list[tuple[int, int, list[str]]]:
    """Stretches of the same two or more speakers, by a sweep over the turns' ends."""
    ends = sorted({t for turn in turns if turn[2] > turn[1] for t in turn[1:]})
    starting, ending, active, found = {}, {}, {}, []
    for speaker, start, end in turns:
        if end > start:
            starting.setdefault(start, []).append(speaker)
            ending.setdefault(end, []).append(speaker)
    for a, z in zip(ends, ends[1:], strict=False):
        for speaker in ending.get(a, ()):
            active[speaker] -= 1
        for speaker in starting.get(a, ()):
            active[speaker] = active.get(speaker, 0) + 1
        now = sorted(speaker for speaker, n in active.items() if n)
        if len(now) >= 2:
            if found and found[-1][1] == a and found[-1][2] == now:
                found[-1] = (found[-1][0], z, now)
            else:
                found.append((a, z, now))
    return found


class OverlapProcessor(StatefulProcessor):
    """A clip's open turns, and up to where its regions have been sent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", _TURN)
        self.sent = handle.getValueState("sent", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            self.turns.appendList([(str(s), int(a), int(z)) for s, a, z in zip(part["speaker"], part["start_ms"], part["end_ms"], strict=True)])
            for end in sorted({int(x) for x in part["closes_ms"]}):
                self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # A turn that is still to come starts at the watermark or later, so it can't change what ends before it.
        passed = timerValues.getCurrentWatermarkInMs()
        until = self.sent.get()[0] if self.sent.exists() else -1
        kept = [tuple(turn) for turn in self.turns.get()]
        found = [r for r in regions(kept) if r[0] >= until]
        done, still = [r for r in found if r[1] < passed], [r for r in found if r[1] >= passed]
        if done:
            self.sent.update((max(r[1] for r in done),))
        needed = min([passed, *(r[0] for r in still)])
        left = [turn for turn in kept if turn[2] > needed]
        if left:
            self.turns.put(left)
        else:
            self.turns.clear()
        if done:
            yield pd.DataFrame({"clip_id": [str(key[0])] * len(done), "start_ms": [r[0] for r in done], "end_ms": [r[1] for r in done], "speakers": [BETWEEN.join(r[2]) for r in done]})

    def close(self) -> None:
        pass


def overlap_regions(turns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """clip_id (a string), start_ms, end_ms, speakers, duration_ms of a stream of turns."""
    rows = turns.select(F.col("clip_id").cast("string").alias("clip_id"), "speaker", "ts", "start_ms", "end_ms", F.col("end_ms").alias("closes_ms")).withWatermark("ts", late)
    found = rows.groupBy("clip_id").transformWithStateInPandas(statefulProcessor=OverlapProcessor(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    return found.select("clip_id", "start_ms", "end_ms", F.split("speakers", BETWEEN).alias("speakers"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def read_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of turns in a folder as a stream, a file at a time in the order in which they came."""
    return spark.readStream.schema("clip_id string, speaker string, ts timestamp, start_ms long, end_ms long").option("maxFilesPerTrigger", 1).parquet(folder)


def write_end(spark: SparkSession, folder: str) -> None:
    """The mark that ends a stream of turns, as a file of its folder."""
    mark = spark.range(1).select(F.lit(END_CLIP).alias("clip_id"), F.lit("").alias("speaker"), F.lit(END_TIME).cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("start_ms"), F.lit(0).cast("long").alias("end_ms"))
    mark.write.mode("append").parquet(folder)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mark) -> tuple[DataFrame, int]:
    """What a stream gives in all, and how many rows came too late: it runs over what there is, then mark() writes its end, then it goes on."""
    spark, dropped = stream.sparkSession, 0
    before = spark.conf.get(STORE)
    for last in (False, True):
        if last:
            mark()
        spark.conf.set(STORE, ROCKS)
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        spark.conf.set(STORE, before)
        query.awaitTermination()
        dropped += sum(int(operator["numRowsDroppedByWatermark"]) for progress in query.recentProgress for operator in progress["stateOperators"])
    return spark.read.schema(stream.schema).parquet(path), dropped
