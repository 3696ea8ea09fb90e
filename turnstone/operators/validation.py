"""Checks of manifests, labels and splits: tables of what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """clip_id and problem: ids that come twice, missing paths, durations that are no number."""
    twice = manifest.groupBy("clip_id").count().where("count > 1").select("clip_id", F.lit("duplicate id").alias("problem"))
    missing = manifest.where("path is null or trim(path) = ''").select("clip_id", F.lit("missing path").alias("problem"))
    bad = manifest.where(F.col("duration").try_cast("double").isNull()).select("clip_id", F.lit("bad duration").alias("problem"))
    return twice.unionByName(missing).unionByName(bad)


def label_violations(labels: DataFrame, clips: DataFrame, least: int = 300) -> DataFrame:
    """doc_id and the first problem of each label: unknown clip, label outside 0 and 1, clip shorter than least."""
    known = labels.join(clips.withColumn("known", F.lit(True)), "doc_id", "left")
    problem = F.when(F.col("known").isNull(), "unknown clip").when(~F.col("quality").isin(0, 1), "bad label").when(F.col("n_chars") < least, "interval beyond the clip")
    return known.select("doc_id", problem.alias("problem")).where("problem is not null")


def split_by_group(rows: DataFrame, group: str) -> DataFrame:
    """Adds split: 70 % train, 15 % validation, 15 % test, all rows of a group in one."""
    bucket = F.conv(F.substring(F.md5(group), 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test"))


def leaking_groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
