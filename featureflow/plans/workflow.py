"""End-to-end training workflow (the reference's stage sequence, E1).

features → feature table (fixed schema, replaced as a whole) → exact stratified split
(written, by split) → scaler fit on train → one fixed forest and its plain
metrics record → with a grid: grid search with stratified folds and the tuned
record → test evaluation of the last model → evaluation record, matrix text,
importances → run log. One lazy lineage per step; besides these tables only
the source and each model's predictions of the test rows are written, to the
shared scratch folder, because several steps read them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from featureflow.operators import evaluate as EV
from featureflow.operators.features import engineer_features
from featureflow.operators.scale import apply_scaler, fit_scaler
from featureflow.operators.split import stratified_folds, stratified_split
from featureflow.operators.train import (
    grid_search, importances, log_run, predict, save_model, save_scaler, train_forest,
)
from featureflow.schema import PLAIN_RECORD, TUNED_RECORD
from featureflow.session import written
from featureflow.sources.files import write_record
from featureflow.sources.versions import replace_table


@dataclass
class WorkflowConfig:
    id_col: str
    label_col: str
    classes: Sequence
    measures: Sequence[str]               # four measures, in feature-table order
    rename: dict                          # measure → feature-table name
    base_time: str
    as_of: str
    out_dir: str                          # shared folder for tables, model, reports
    test_size: float = 0.2
    seed: int = 42
    n_folds: int = 5
    grid: dict | None = None              # None: only the forest with forest_params
    forest_params: dict = field(default_factory=lambda: {"num_trees": 100, "max_depth": 5, "seed": 42})
    experiment: str = "featureflow"


MODEL_TYPE = "RandomForestClassifier"


def _predicted(model, test: DataFrame, cfg: WorkflowConfig) -> DataFrame:
    """Label and predicted label of every test row, scored once for all that is read from them."""
    pred = predict(model, test, cfg.classes, keep=[cfg.label_col])
    return written(pred.select(cfg.label_col, "predicted_label"), "predicted")


def _accuracy(pred: DataFrame, cfg: WorkflowConfig) -> float:
    return EV.evaluation_report(pred, cfg.label_col, "predicted_label", with_matrix=False).first()["accuracy"]


def _write_metrics(spark: SparkSession, path: str, schema: T.StructType, record: dict) -> None:
    write_record(spark.createDataFrame([record], schema), path)


def run_workflow(spark: SparkSession, source: DataFrame, cfg: WorkflowConfig) -> dict:
    out = cfg.out_dir.rstrip("/")
    source = written(source, "source")  # read by the feature table and by the split, each several times
    feats = engineer_features(source, cfg.id_col, dict(cfg.rename), cfg.base_time, cfg.as_of)
    replace_table(feats, f"{out}/feature_table")

    split = stratified_split(source, cfg.id_col, cfg.label_col, cfg.test_size, cfg.seed)
    stratified_folds(split, cfg.n_folds).write.mode("overwrite").partitionBy("split").parquet(f"{out}/split")
    split = spark.read.parquet(f"{out}/split")
    train = split.where(F.col("split") == "train")
    scaler = fit_scaler(train, cfg.measures)
    save_scaler(scaler, f"{out}/scaler")
    scaler = spark.read.parquet(f"{out}/scaler")
    x = apply_scaler(split, scaler, cfg.measures)
    x_train, x_test = x.where(F.col("split") == "train"), x.where(F.col("split") == "test")

    metrics: dict = {}
    params: dict = dict(cfg.forest_params)
    model = train_forest(x_train, cfg.measures, cfg.label_col, cfg.classes, **cfg.forest_params)
    pred = _predicted(model, x_test, cfg)
    _write_metrics(spark, f"{out}/metrics", PLAIN_RECORD, {
        "accuracy": _accuracy(pred, cfg), "model_type": MODEL_TYPE,
        "n_estimators": params["num_trees"], "max_depth": params["max_depth"]})
    if cfg.grid:
        model, cand = grid_search(x_train, cfg.measures, cfg.label_col, cfg.classes, "fold",
                                  cfg.n_folds, cfg.grid, cfg.seed, cfg.id_col)
        cand.write.mode("overwrite").parquet(f"{out}/candidates")
        best = spark.read.parquet(f"{out}/candidates").where("is_best").first()
        metrics["cv_score"] = best["mean_accuracy"]
        params = {k: best[k] for k in ("num_trees", "max_depth", "min_samples_split", "min_samples_leaf")}
        pred = _predicted(model, x_test, cfg)
        _write_metrics(spark, f"{out}/metrics_tuned", TUNED_RECORD, {
            "accuracy": _accuracy(pred, cfg), "cv_score": best["mean_accuracy"], "best_params": params,
            "model_type": MODEL_TYPE})
    save_model(model, f"{out}/model")

    report = EV.evaluation_report(pred, cfg.label_col, "predicted_label")
    write_record(report, f"{out}/evaluation_report")
    rec = spark.read.json(f"{out}/evaluation_report").first()
    metrics.update({k: rec[k] for k in ("accuracy", "precision", "recall", "f1_score")})
    EV.write_matrix_text(EV.confusion_matrix_lines(pred, cfg.label_col, "predicted_label"),
                         f"{out}/confusion_matrix")
    EV.feature_importances(spark, importances(model), list(cfg.measures)) \
        .write.mode("overwrite").parquet(f"{out}/feature_importance")
    run_id = log_run(spark, f"{out}/runs", cfg.experiment, params, metrics, f"{out}/model")
    return {"run_id": run_id, "metrics": metrics, "params": params}
