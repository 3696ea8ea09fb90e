"""Stages of a job as tables that are reused: a table's address is a hash of the stage's code, its inputs and its settings.

A stage whose table is finished is read and not run; a changed input, setting or line of code changes its address and
those of the stages after it, and of no others.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from turnstone.scratch import path_exists


@dataclass(frozen=True)
class Artifact:
    """A finished table: its name, address and place."""

    name: str
    key: str
    path: str
    reused: bool
    spark: SparkSession

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of the files below path: what a source was when it was read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, files = [], place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


class Artifacts:
    """Tables of stages below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def source(self, name: str, path: str) -> Artifact:
        """A table that is given, as an input of stages."""
        return Artifact(name, fingerprint(self.spark, path), path, True, self.spark)

    def address(self, name: str, build: Callable, inputs: dict[str, Artifact], settings: dict) -> str:
        told = {"name": name, "code": inspect.getsource(build), "inputs": {key: one.key for key, one in sorted(inputs.items())}, "settings": settings}
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()

    def stage(self, name: str, build: Callable[..., DataFrame], inputs: dict[str, Artifact] | None = None, **settings) -> Artifact:
        """The table that build makes of its inputs' tables and settings, both by name; run only if no finished one is there.

        Writing ends with a mark of success, so what a lost job left behind is overwritten.
        """
        inputs = inputs or {}
        key = self.address(name, build, inputs, settings)
        path = f"{self.root}/{name}-{key[:32]}"
        reused = path_exists(self.spark, f"{path}/_SUCCESS")
        if not reused:
            build(**{key: one.table() for key, one in inputs.items()}, **settings).write.mode("overwrite").parquet(path)
        return Artifact(name, key, path, reused, self.spark)
