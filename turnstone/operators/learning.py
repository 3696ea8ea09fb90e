"""Learned gates: features, class weights, models by MLlib, their probabilities and importances."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.operators.rollups import balanced_weights, first_by

#: Model kinds; MLlib's boosted trees tell two classes apart, and any number one by one.
KINDS = ("logistic", "forest", "boosted")


def _estimator(kind: str, trees: int, seed: int):
    common = {"featuresCol": "scaled", "labelCol": "label_index", "weightCol": "weight"}
    if kind == "logistic":
        return LogisticRegression(maxIter=100, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=trees, minInstancesPerNode=2, seed=seed, **common)
    if kind == "boosted":
        return GBTClassifier(maxIter=20, seed=seed, **common)
    raise ValueError(f"no such model: {kind}")


def fit_gate(rows: DataFrame, features: list[str], label: str, kind: str, trees: int = 240, seed: int = 42) -> PipelineModel:
    """A gate from rows with numeric features and a label; classes weigh alike, features are scaled. Null features count as 0."""
    stages = [
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=features, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), _estimator(kind, trees, seed),
    ]
    return Pipeline(stages=stages).fit(balanced_weights(rows.na.fill(0, features), label))


def predict_gate(model: PipelineModel, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """rows with predicted and probabilities, a map from label to probability."""
    labels = model.stages[0].labels
    scored = model.transform(rows.na.fill(0, features).withColumn("weight", F.lit(1.0)))
    names = F.array(*map(F.lit, labels))
    each = F.transform(vector_to_array("probability"), lambda p: F.round(p, 6))
    return scored.select(*rows.columns, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"), F.map_from_arrays(names, each).alias("probabilities"))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by descending importance: a forest's own, a logistic model's greatest absolute weight."""
    last = model.stages[-1]
    values = abs(last.coefficientMatrix.toArray()).max(axis=0) if hasattr(last, "coefficientMatrix") else last.featureImportances.toArray()
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


class BoostedGate:
    """Boosted trees for any number of classes: one model tells each class from the rest, and its margins are calibrated.

    A logistic curve, fitted on rows that the trees did not see, turns a class's margin into a probability; the classes'
    probabilities are then scaled to add up to 1. A class that the calibrating rows lack, or that they have alone, keeps
    the trees' own probability.
    """

    def __init__(self, labels: list[str], features: list[str], models: list[PipelineModel], curves: list[tuple[float, float] | None]):
        self.labels, self.features, self.models, self.curves = labels, features, models, curves

    @staticmethod
    def fit(train: DataFrame, calibrate: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 3, seed: int = 42) -> BoostedGate:
        train, calibrate = train.na.fill(0, features).cache(), calibrate.na.fill(0, features).cache()
        labels, models, curves = sorted(r[0] for r in train.select(label).distinct().collect()), [], []
        for name in labels:
            mine = lambda rows: rows.withColumn("mine", (F.col(label) == name).cast("double"))  # noqa: B023, E731
            trees = GBTClassifier(featuresCol="features", labelCol="mine", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)
            models.append(Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(balanced_weights(mine(train), "mine")))
            margins = BoostedGate._margin(models[-1], mine(calibrate)).select("mine", F.array("__margin").alias("margin"))
            seen = margins.agg(F.count_distinct("mine")).first()[0]
            curve = LogisticRegression(featuresCol="x", labelCol="mine", regParam=0.01).fit(margins.select("mine", array_to_vector("margin").alias("x"))) if seen == 2 else None
            curves.append((float(curve.coefficients[0]), float(curve.intercept)) if curve else None)
        train.unpersist(), calibrate.unpersist()
        return BoostedGate(labels, features, models, curves)

    @staticmethod
    def _margin(model: PipelineModel, rows: DataFrame) -> DataFrame:
        kept = [F.col(name) for name in rows.columns]
        return model.transform(rows.withColumn("weight", F.lit(1.0))).select(*kept, vector_to_array("rawPrediction")[1].alias("__margin"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with predicted, the likeliest class (of equal ones the first by name), and probabilities, a map from class to probability."""
        out, columns = rows.na.fill(0, self.features), rows.columns
        for i, (model, curve) in enumerate(zip(self.models, self.curves, strict=True)):
            slope, shift = curve or (2.0, 0.0)  # twice the margin is the logarithm of the trees' own odds
            out = self._margin(model, out).withColumn(f"__p{i}", 1 / (1 + F.exp(-(F.lit(slope) * F.col("__margin") + F.lit(shift))))).drop("__margin")
        own = [F.col(f"__p{i}") for i in range(len(self.labels))]
        shares = [p / sum(own, F.lit(0.0)) for p in own]
        best = F.array_max(F.array(*(F.struct(share.alias("p"), F.lit(-i).alias("at")) for i, share in enumerate(shares))))
        names = F.array(*map(F.lit, self.labels))
        return out.select(*columns, F.get(names, -best["at"]).alias("predicted"), F.map_from_arrays(names, F.array(*(F.round(share, 6) for share in shares))).alias("probabilities"))


def heldout_scores(train: DataFrame, test: DataFrame, feature_sets: dict[str, list[str]], label: str, kinds: tuple[str, ...] = KINDS[:2], trees: int = 240, calibrate: DataFrame | None = None, rounds: int = 20) -> DataFrame:
    """Predictions on test of each model kind on each set of features: feature_set, model, and test's columns.

    Boosted trees tell more than two classes apart if there are rows to calibrate them on, of groups that train doesn't have.
    """
    both = None
    for name, features in feature_sets.items():
        for kind in kinds:
            if kind == "boosted" and calibrate is not None:
                scored = BoostedGate.fit(train, calibrate, features, label, rounds).predict(test)
            else:
                scored = predict_gate(fit_gate(train, features, label, kind, trees), test, features, label)
            scored = scored.withColumn("feature_set", F.lit(name)).withColumn("model", F.lit(kind))
            both = scored if both is None else both.unionByName(scored)
    return both


def best_model(metrics: DataFrame) -> DataFrame:
    """The row of metrics (feature_set, model, macro_f1, unsafe_accept_rate) of greatest macro-F1, then least unsafe rate, then name, for each set."""
    return first_by(metrics, ["feature_set"], [F.desc("macro_f1"), F.col("unsafe_accept_rate"), F.col("model")])
