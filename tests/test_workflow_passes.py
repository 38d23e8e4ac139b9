"""How often the workflow computes its input and scores its rows, and how the fit's rows are dealt out."""

import pytest
from pyspark.sql import functions as F

from featureflow.operators import train as TR
from featureflow.plans import workflow as W
from featureflow.session import scratch_path

CLASSES = ["low", "mid", "high"]
MEASURES = ["f1", "f2", "f3", "f4"]
RENAME = {"f1": "sepal_length", "f2": "sepal_width", "f3": "petal_length", "f4": "petal_width"}


def _rows(spark, n):
    label = F.when(F.col("f1") < 3, "low").when(F.col("f1") < 6, "mid").otherwise("high")
    return spark.range(n, numPartitions=1).select(F.col("id").alias("obs_id"), (F.col("id") % 9).cast("double").alias("f1"),
                                                  *[(F.col("id") % k + 1.0).alias(f"f{i}") for i, k in ((2, 5), (3, 7), (4, 11))]) \
        .withColumn("label", label)


@pytest.mark.parametrize("grid", [None, {"num_trees": [4], "max_depth": [3], "min_samples_leaf": [1]}])
def test_workflow_computes_its_source_once_and_scores_once_a_model(spark, monkeypatch, grid):
    n, scored, seen = 360, [], spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x

    def predict(model, df, *args, **kwargs):
        scored.append(model)
        return TR.predict(model, df, *args, **kwargs)

    monkeypatch.setattr(W, "predict", predict)
    source = _rows(spark, n).withColumn("f2", F.udf(noted, "double")("f2"))
    out = scratch_path(spark, "workflow")
    res = W.run_workflow(spark, source, W.WorkflowConfig(
        "obs_id", "label", CLASSES, MEASURES, RENAME, "2024-06-01 00:00:00", "2024-06-01 12:00:00", out, n_folds=3, grid=grid,
        forest_params={"num_trees": 10, "max_depth": 5, "seed": 42}))
    assert seen.value == n
    assert len(scored) == (2 if grid else 1)
    # the last model's reports fit its saved model and the test rows
    rec = spark.read.json(f"{out}/evaluation_report").first()
    assert rec["accuracy"] == res["metrics"]["accuracy"]
    assert sum(sum(r) for r in rec["confusion_matrix"]) == spark.read.parquet(f"{out}/split").where("split = 'test'").count()
    assert spark.read.json(f"{out}/{'metrics_tuned' if grid else 'metrics'}").first()["accuracy"] == rec["accuracy"]


def test_forest_is_fitted_on_evenly_dealt_rows(spark, monkeypatch):
    dealt, fitted, estimator = [], [], TR.forest_estimator

    class Pipe:
        def __init__(self, pipe):
            self.pipe = pipe

        def fit(self, data):
            dealt.extend(r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect())
            fitted.extend(tuple(r) for r in data.select(TR.LABEL, *MEASURES).collect())
            return self.pipe.fit(data)

    def forest_estimator(*args, **kwargs):
        pipe, forest = estimator(*args, **kwargs)
        return Pipe(pipe), forest

    monkeypatch.setattr(TR, "forest_estimator", forest_estimator)
    # one file's rows, most of them equal
    rows = _rows(spark, 400).unionAll(_rows(spark, 1).crossJoin(spark.range(1200)).drop("id")).coalesce(1)
    model = TR.train_forest(rows, MEASURES, "label", CLASSES, num_trees=3, seed=42)
    want = TR.with_label_index(rows, "label", CLASSES).select(TR.LABEL, *MEASURES).collect()
    assert sorted(fitted) == sorted(tuple(r) for r in want)
    assert len(dealt) >= spark.sparkContext.defaultParallelism and max(dealt) <= 2 * min(dealt)
    assert TR.predict(model, rows, CLASSES).where("predicted_label = label").count() > 0.8 * rows.count()
