import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF0001, SF001
from featureflow.functions.forest import forest_from_mllib, forest_proba
from featureflow.operators import evaluate as EV
from featureflow.operators.split import stratified_split
from featureflow.operators.train import (
    best_run, load_model, load_scaler, log_run, predict, read_runs, save_model, train_forest,
)
from featureflow.session import scratch_path
from featureflow.sources.standins import OBS_MEASURES, rule_labelled_observations

CLASSES = ["low", "mid", "high"]


@pytest.fixture(scope="module")
def split(spark):
    return stratified_split(rule_labelled_observations(spark, SF001), "obs_id", "label").cache()


def test_accuracy_gate_on_learnable_label(spark, split):
    model = train_forest(split.where("split = 'train'"), OBS_MEASURES, "label", CLASSES,
                         num_trees=100, max_depth=5, seed=42)
    pred = predict(model, split.where("split = 'test'"), CLASSES)
    acc = EV.evaluation_report(pred, "label", "predicted_label", with_matrix=False).first()["accuracy"]
    assert acc > 0.85


def test_mllib_forest_equals_expression_forest(spark, split):
    model = train_forest(split.where("split = 'train'"), OBS_MEASURES, "label", CLASSES,
                         num_trees=100, max_depth=5, seed=42)
    path = scratch_path(spark, "rf")
    model.stages[-1].write().overwrite().save(path)
    forest = forest_from_mllib(spark, path, CLASSES)
    test = split.where("split = 'test'")
    both = model.transform(test).select(vector_to_array("probability").alias("m"),
                                        forest_proba(forest, OBS_MEASURES).alias("e"))
    worst = both.select(F.max(F.aggregate(F.zip_with("m", "e", lambda a, b: F.abs(a - b)), F.lit(0.0),
                                          lambda acc, x: F.greatest(acc, x)))).first()[0]
    assert worst < 1e-9


def test_model_persistence_and_missing_artifacts(spark, split):
    model = train_forest(split.where("split = 'train'"), OBS_MEASURES, "label", CLASSES, num_trees=3, seed=42)
    path = scratch_path(spark, "model")
    save_model(model, path)
    back = load_model(path)
    a = predict(model, split, CLASSES).select("obs_id", "prediction").orderBy("obs_id").collect()
    b = predict(back, split, CLASSES).select("obs_id", "prediction").orderBy("obs_id").collect()
    assert a == b
    with pytest.raises(Exception):
        load_model(scratch_path(spark, "absent"))
    assert load_scaler(spark, scratch_path(spark, "absent")) is None


def test_run_log_best_run(spark):
    runs = scratch_path(spark, "runs")
    log_run(spark, runs, "exp", {"n": 1}, {"accuracy": 0.5})
    best = log_run(spark, runs, "exp", {"n": 2}, {"accuracy": 0.9})
    log_run(spark, runs, "other", {"n": 3}, {"accuracy": 0.99})
    r = best_run(read_runs(spark, runs), "exp", "accuracy").first()
    assert r["run_id"] == best and r["params"]["n"] == "2"


def test_runs_logged_at_once_are_all_kept(spark):
    from concurrent.futures import ThreadPoolExecutor

    runs = scratch_path(spark, "runs")
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda i: log_run(spark, runs, "a/b = c%d" % (i % 2), {"n": i}, {"accuracy": i / 10}, f"m{i}"), range(8)))
    rows = read_runs(spark, runs).collect()
    assert sorted(r["run_id"] for r in rows) == sorted(ids)
    assert {(r["experiment"], r["params"]["n"], r["model_path"]) for r in rows} == {("a/b = c%d" % (i % 2), str(i), f"m{i}") for i in range(8)}
    assert best_run(read_runs(spark, runs), "a/b = c1", "accuracy").first()["params"]["n"] == "7"


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) == 10
    assert set(E.oracle_sql()) <= set(E.queries())
    assert os.path.isdir(SF0001)


def test_workflow_end_to_end(spark):
    from featureflow.plans.workflow import WorkflowConfig, run_workflow
    from featureflow.sources.standins import OBS_RENAME
    from featureflow.sources.versions import read_table
    out = scratch_path(spark, "workflow")
    cfg = WorkflowConfig(id_col="obs_id", label_col="label", classes=CLASSES, measures=OBS_MEASURES,
                         rename=OBS_RENAME, forest_params={"num_trees": 10, "max_depth": 5, "seed": 42}, base_time="2024-06-01 00:00:00", as_of="2024-06-01 12:00:00",
                         out_dir=out, grid={"num_trees": [10], "max_depth": [3, 5], "min_samples_leaf": [1]},
                         n_folds=3)
    res = run_workflow(spark, rule_labelled_observations(spark, SF0001), cfg)
    assert res["metrics"]["accuracy"] > 0.8 and res["metrics"]["cv_score"] > 0.8
    assert spark.read.json(f"{out}/metrics").first()["n_estimators"] == 10
    tuned = spark.read.json(f"{out}/metrics_tuned").first()
    assert tuned["cv_score"] > 0.8 and tuned["best_params"]["num_trees"] == 10
    lines = spark.read.text(f"{out}/confusion_matrix").collect()
    assert len(lines) == 3
    assert read_table(spark, f"{out}/feature_table").count() == rule_labelled_observations(spark, SF0001).count()
