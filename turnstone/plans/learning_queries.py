"""Queries of learned gates; models have no SQL and are held to their accuracy in tests/test_learning.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import gate_features, learning, rollups
from turnstone.plans.audit_queries import decisions
from turnstone.scratch import written
from turnstone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FEATURES = {"length": ["n_words", "mean_word"], "all": ["n_words", "mean_word", "marks", "capitals", "breaks"]}


def query(function):
    QUERIES[function.__name__] = function
    return function


def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with features of their text and a split by source, so that no source is on both sides; written, as each model reads them many times."""
    text, n = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    words = F.regexp_count(text, F.lit(r"\S+"))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("text is not null")
    features = {"n_words": words, "mean_word": n / F.greatest(words, F.lit(1)), "marks": F.regexp_count(text, F.lit(r"[^\p{L}\s]")) / n, "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / n, "breaks": F.regexp_count(text, F.lit(r"\n")) / n}
    label = F.when(F.col("quality") == 1, "accept").otherwise("reject")
    return written(rows.select("doc_id", label.alias("label"), (F.pmod(F.xxhash64("source"), F.lit(10)) < 7).alias("is_train"), *[c.cast("double").alias(name) for name, c in features.items()]), "gate-rows")


@query
def gate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions of a logistic model and a forest on two sets of features."""
    rows = gate_rows(spark, sf_dir)
    scored = learning.heldout_scores(rows.where("is_train"), rows.where("not is_train"), FEATURES, "label", trees=40)
    return scored.select("doc_id", "feature_set", "model", "label", "predicted", F.col("probabilities")["accept"].alias("p_accept"))


@query
def gate_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and class metrics of each of them."""
    return rollups.class_metrics(gate_predictions(spark, sf_dir), ["feature_set", "model"], ["accept", "reject"], "label", "predicted")


@query
def gate_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the forest by importance."""
    features = FEATURES["all"]
    model = learning.fit_gate(gate_rows(spark, sf_dir).where("is_train"), features, "label", "forest", trees=40)
    rows = [(i + 1, name, round(value, 6)) for i, (name, value) in enumerate(learning.importances(model, features))]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def labelled_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on proposals with all features, their label and a split by conversation: train, calibrate, test."""
    rows = gate_features.labels(gate_features.features(decisions(spark, sf_dir)))
    part = F.pmod(F.xxhash64("clip_id"), F.lit(100))
    split = F.when(part < 60, "train").when(part < 75, "calibrate").otherwise("test")
    return written(rows.select("clip_id", "idx", "label", split.alias("split"), *gate_features.AUDIT_AWARE), "decisions")


def nine_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_decisions(spark, sf_dir)
    sets = {name: list(features) for name, features in gate_features.FEATURE_SETS.items()}
    of = lambda split: rows.where(F.col("split") == split)
    return learning.heldout_scores(of("train"), of("test"), sets, "label", learning.KINDS, trees=40, calibrate=of("calibrate"), rounds=8)


@query
def gate_nine_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out metrics of three kinds of models on three sets of features, three classes each."""
    return rollups.selective_metrics(nine_predictions(spark, sf_dir), ["feature_set", "model"], "label", "predicted")


@query
def gate_best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best model of each set of features."""
    return learning.best_model(gate_nine_models(spark, sf_dir))
