"""Turns and words of meetings, read from the conversation and event tables; times are whole milliseconds.

A clip is a conversation or a day; all of a clip's rows meet in one task, as a meeting's length bounds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str):
    return F.filter(F.split(F.col(text), "\\s+"), lambda w: w != "")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, idx, speaker, text, start_ms, end_ms: 0.4 s a word, 1 s at least; each turn starts in the last fifth of the one before."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("clip_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text", F.greatest(F.lit(1000), F.size(words_of("text")) * 400).cast("long").alias("dur_ms")
    )
    before = Window.partitionBy("clip_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.expr("dur_ms * 4 div 5")).over(before), F.lit(0))
    return turns.withColumn("start_ms", start).select("clip_id", "idx", "speaker", "text", "start_ms", (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"))


def conversation_words(turns: DataFrame) -> DataFrame:
    """clip_id, idx, pos, word, start_ms, end_ms: a word each 0.4 s from its turn's start."""
    words = turns.select("clip_id", "idx", F.col("start_ms").alias("turn_ms"), F.posexplode(words_of("text")).alias("pos", "word"))
    return words.select("clip_id", "idx", "pos", "word", (F.col("turn_ms") + F.col("pos") * 400).alias("start_ms"), (F.col("turn_ms") + F.col("pos") * 400 + 400).alias("end_ms"))


#: The same in SQL, to be put before a query.
TURNS_SQL = """turns as (
  select clip_id, idx, speaker, text, start_ms, start_ms + dur_ms as end_ms from (
    select *, coalesce(sum(dur_ms * 4 // 5) over (partition by clip_id order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms from (
      select conv_id as clip_id, turn as idx, role as speaker, text, greatest(1000, 400 * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::bigint as dur_ms from conversations)))"""
WORDS_SQL = TURNS_SQL + """, words as (
  select clip_id, idx, pos - 1 as pos, word, start_ms + (pos - 1) * 400 as start_ms, start_ms + pos * 400 as end_ms from (
    select clip_id, idx, start_ms, unnest(ws) as word, generate_subscripts(ws, 1) as pos from (
      select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as ws from turns)))"""
