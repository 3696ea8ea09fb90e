from pyspark.sql import functions as F

from turnstone.operators import gate_features, learning
from turnstone.plans import learning_queries

SF = "/root/testdata/sf0.01"


def test_gates_on_held_out_sources(spark):
    rows = learning_queries.gate_model_scores(spark, SF).collect()
    scores = {(r.feature_set, r.model): r.macro_f1 for r in rows}
    assert len(scores) == 4 and scores["all", "forest"] > 0.8 and scores["all", "logistic"] > 0.7
    out = learning_queries.gate_predictions(spark, SF)
    assert out.where("p_accept < 0 or p_accept > 1 or predicted is null").count() == 0


def test_model_survives_a_file(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 2).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "no").otherwise("yes").alias("y"))
    model = learning.fit_gate(rows, ["x"], "y", "boosted")
    model.write().overwrite().save(f"{tmp_path}/gate")
    again = learning.PipelineModel.load(f"{tmp_path}/gate")
    assert learning.predict_gate(again, rows, ["x"], "y").where("y <> predicted").count() == 0
    assert learning.importances(model, ["x"])[0][0] == "x"


def test_boosted_trees_tell_three_classes_apart(spark):
    rows = spark.range(900).select((F.col("id") % 90).cast("double").alias("x"), (F.rand(3) * 5).alias("noise"), F.expr("case when id % 90 < 30 then 'accept' when id % 90 < 60 then 'needs_review' else 'reject' end").alias("y"), F.expr("id div 90 % 3").alias("fold"))
    rows = rows.cache()
    gate = learning.BoostedGate.fit(rows.where("fold = 0"), rows.where("fold = 1"), ["x", "noise"], "y", rounds=5)
    out = gate.predict(rows.where("fold = 2").withColumn("margin", F.lit("x"))).cache()
    assert gate.labels == ["accept", "needs_review", "reject"] and "margin" in out.columns
    assert out.where("y <> predicted").count() < 15
    assert out.where("abs(aggregate(map_values(probabilities), 0D, (s, p) -> s + p) - 1) > 1e-5 or exists(map_values(probabilities), p -> p < 0)").count() == 0
    # Calibrated: among rows of high probability, about as many are right.
    sure = out.select(F.expr("array_max(map_values(probabilities))").alias("p"), (F.col("y") == F.col("predicted")).cast("int").alias("hit")).where("p > 0.8").agg(F.avg("p"), F.avg("hit")).first()
    assert abs(sure[0] - sure[1]) < 0.1
    alone = learning.BoostedGate.fit(rows.where("fold = 0"), rows.where("fold = 1 and y = 'accept'"), ["x", "noise"], "y", rounds=2)
    assert alone.curves == [None, None, None] and alone.predict(rows.limit(5)).count() == 5


def test_nine_models(spark):
    metrics = learning_queries.gate_nine_models(spark, SF).collect()
    assert {(r.feature_set, r.model) for r in metrics} == {(s, m) for s in gate_features.FEATURE_SETS for m in learning.KINDS}
    assert all(r.macro_f1 > 0.8 for r in metrics if r.feature_set == "audit_aware" and r.model != "logistic") and all(0 <= r.unsafe_accept_rate <= 1 for r in metrics)
    best = learning.best_model(spark.createDataFrame([("a", "m2", 0.5, 0.1), ("a", "m1", 0.5, 0.1), ("a", "m0", 0.5, 0.2), ("b", "m9", 0.1, 0.0)], "feature_set string, model string, macro_f1 double, unsafe_accept_rate double")).collect()
    assert sorted((r.feature_set, r.model) for r in best) == [("a", "m1"), ("b", "m9")]


def test_models_read_written_features(spark):
    """Each pass of each model cut the texts of all documents anew."""
    plan = learning_queries.gate_rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "text" not in [name for name in learning_queries.gate_rows(spark, SF).columns]
