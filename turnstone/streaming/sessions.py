"""Live turns: sessions and overlap counts over event time, with a watermark for late rows.

The same functions take a streaming or a static DataFrame of turns (speaker, ts timestamp, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The speaker and the time of the mark that ends a stream.
END, END_TIME = "__end__", "2200-01-01"


def speech_sessions(turns: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """speaker, start, end, n: a speaker's rows at most gap apart are one session. Rows later than the watermark go."""
    sessions = turns.withWatermark("ts", late).groupBy("speaker", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return sessions.select("speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def activity_by_window(turns: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, n, n_speakers (about) of each stretch of event time."""
    counts = turns.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("speaker").alias("n_speakers"))
    return counts.select(F.col("w.start").alias("start"), "n", "n_speakers")


def read_event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of speaker, ts: eight speakers."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    return stream.select((F.col("user_id") % 8).cast("string").alias("speaker"), F.col("ts").cast("timestamp").alias("ts"))


def read_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Marks (speaker, ts) that end a stream, as a stream of the files in a folder."""
    return spark.readStream.schema("speaker string, ts timestamp").parquet(folder)


def write_end(spark: SparkSession, folder: str) -> None:
    """A mark far in the future: once it has been read, the watermark has passed all that came before."""
    spark.range(1).select(F.lit(END).alias("speaker"), F.lit(END_TIME).cast("timestamp").alias("ts")).write.mode("append").parquet(folder)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream has so far, written by an available-now query to path; sessions still open at its end stay in the state."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
