"""Model operators on MLlib: forest training (M1), grid search with
cross-validation (M2, A12, R4), scoring (M3, M5), feature importances (R3),
model/scaler persistence (IO9) and the run log (IO10).

MLlib trains the forest distributed (per-node split statistics are
aggregated across partitions); nothing here gathers rows on the driver.
Labels are encoded by class *position* (not StringIndexer's frequency
order), so probability index i is class i.

The search needs limits on the distinct rows of a node's bag, which MLlib does
not have (its counts are draws, and it has no ``min_samples_split``), so its
forests are grown by ``operators/growth.py`` and handed over as MLlib models.
An unlimited depth becomes MLlib's maximum depth 30.
"""

from __future__ import annotations

import datetime as dt
import itertools
import logging
import statistics
import uuid
from collections.abc import Sequence
from urllib.parse import quote

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from featureflow.functions.forest import argmax_index, confidence
from featureflow.functions.lookup import index_of
from featureflow.operators import growth
from featureflow.schema import SCALER
from featureflow.session import scratch_path

log = logging.getLogger(__name__)

LABEL = "__label_idx"
FEATURES = "__features"
MLLIB_MAX_DEPTH = 30

# The reference's forest and search grid.
FOREST_PARAMS = {"num_trees": 100, "max_depth": 5, "seed": 42}
FULL_GRID = {
    "num_trees": [50, 100, 200],
    "max_depth": [3, 5, 7, None],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
}


def with_label_index(df: DataFrame, label_col: str, classes: Sequence) -> DataFrame:
    idx = index_of(label_col, list(classes))
    return df.withColumn(LABEL, F.when(idx.isNull(), F.raise_error(
        F.concat(F.lit("unknown class: "), F.col(label_col).cast("string")))).otherwise(idx).cast("double"))


def forest_estimator(feature_cols: Sequence[str], num_trees: int = 100, max_depth: int | None = 5,
                     seed: int = 42, min_instances: int = 1) -> tuple[Pipeline, RandomForestClassifier]:
    rf = RandomForestClassifier(labelCol=LABEL, featuresCol=FEATURES, numTrees=num_trees,
                                maxDepth=MLLIB_MAX_DEPTH if max_depth is None else max_depth, seed=seed,
                                minInstancesPerNode=min_instances, featureSubsetStrategy="sqrt",
                                impurity="gini", bootstrap=True)
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol=FEATURES, handleInvalid="error")
    return Pipeline(stages=[asm, rf]), rf


def train_forest(df: DataFrame, feature_cols: Sequence[str], label_col: str, classes: Sequence,
                 num_trees: int = 100, max_depth: int | None = 5, seed: int = 42,
                 min_instances: int = 1) -> PipelineModel:
    """Fit the forest (M1) on ``df`` (gini, bootstrap, sqrt features).

    MLlib reads its input several times (metadata, split candidates, bagged
    points), so the label and the features are persisted (memory, spilling to
    disk; lost blocks are recomputed from lineage) for the fit only. Every pass
    takes as long as its longest task, so the rows are dealt out evenly first, by
    turns: equal rows too go to all tasks. A task's rows are sorted because their
    draws follow from their order, which a recomputed task must have again."""
    pipe, _ = forest_estimator(feature_cols, num_trees, max_depth, seed, min_instances)
    rows = with_label_index(df, label_col, classes).select(LABEL, *[F.col(f"`{c}`") for c in dict.fromkeys(feature_cols)])
    data = rows.repartition(growth.task_count(rows)).sortWithinPartitions(*rows.columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipe.fit(data)
    finally:
        data.unpersist()


def predict(model: PipelineModel, df: DataFrame, classes: Sequence, class_names: Sequence[str] | None = None,
            keep: Sequence[str] | None = None) -> DataFrame:
    """Score (M3): ``prediction`` (class position, ties → lowest),
    ``predicted_label``, ``probability`` array, ``confidence``."""
    scored = model.transform(df)
    proba = vector_to_array(F.col("probability"))
    pred = argmax_index(proba)
    labels = F.array(*[F.lit(c) for c in classes])
    cols = [F.col(c) for c in (keep if keep is not None else df.columns)]
    out = [*cols, pred.alias("prediction"), F.element_at(labels, pred + 1).alias("predicted_label")]
    if class_names is not None:
        out.append(F.element_at(F.array(*[F.lit(n) for n in class_names]), pred + 1).alias("prediction_label"))
    return scored.select(*out, proba.alias("probability"), confidence(proba).alias("confidence"))


def forest_model(spark: SparkSession, feature_cols: Sequence[str], n_classes: int, nodes: Sequence[tuple],
                 seed: int = 42) -> PipelineModel:
    """A pipeline whose forest has the given nodes ``(tree, node, feature, threshold, left, right, draws by class, n)``
    (pre-order numbers; -1 for a leaf's feature and children).

    MLlib builds forests by fitting or loading only: a forest of the right shape, without splits, is fitted on one
    row per class, saved, given these nodes (one row per tree node, model metadata) and loaded."""
    n_trees = len({n[0] for n in nodes})
    pipe, _ = forest_estimator(feature_cols, n_trees, 0, seed)
    label = F.col(LABEL).alias(LABEL, metadata={"ml_attr": {"type": "nominal", "num_vals": n_classes}})
    rows = spark.range(n_classes).select(F.col("id").cast("double").alias(LABEL),
                                         *[F.col("id").cast("double").alias(c) for c in feature_cols])
    model = pipe.fit(rows.select(label, *feature_cols))
    bare, full = scratch_path(spark, "forest"), scratch_path(spark, "forest-nodes")
    forest = model.stages[-1]
    forest.write().save(bare)
    forest.write().save(full)
    schema = spark.read.parquet(f"{bare}/data").schema

    def gini(w: list[float]) -> float:
        return 1.0 - sum((x / sum(w)) ** 2 for x in w)

    weights = {(n[0], n[1]): n[6] for n in nodes}
    out = []
    for tree, node, feature, threshold, left, right, w, n in nodes:
        gain = -1.0 if feature < 0 else gini(w) - sum(
            sum(weights[tree, c]) / sum(w) * gini(weights[tree, c]) for c in (left, right))
        split = (feature, [] if threshold is None else [float(threshold)], -1)
        out.append((tree, (node, float(max(range(n_classes), key=lambda c: (w[c], -c))), gini(w), w, n, gain, left, right, split)))
    spark.createDataFrame(out, schema).write.mode("overwrite").parquet(f"{full}/data")
    return PipelineModel([*model.stages[:-1], type(forest).load(full)])


# Grid axes in the order in which ties are broken: by name, as the reference's search orders them [lib]
GRID_AXES = ("max_depth", "min_samples_leaf", "min_samples_split", "num_trees")
GRID_DEFAULTS = {"max_depth": [None], "min_samples_leaf": [1], "min_samples_split": [2], "num_trees": [100]}
CANDIDATES = T.StructType([T.StructField("candidate", T.IntegerType()), T.StructField("num_trees", T.IntegerType()),
                           T.StructField("max_depth", T.IntegerType()), T.StructField("min_samples_split", T.IntegerType()),
                           T.StructField("min_samples_leaf", T.IntegerType()), T.StructField("mean_accuracy", T.DoubleType()),
                           T.StructField("std_accuracy", T.DoubleType())])


def grid_search(train: DataFrame, feature_cols: Sequence[str], label_col: str, classes: Sequence,
                fold_col: str, n_folds: int = 5, grid: dict | None = None, seed: int = 42, id_col: str | None = None):
    """Grid search with k-fold cross-validation on a given fold column (M2).

    Returns ``(best_model, candidates)``: ``best_model`` is grown on all of ``train``; ``candidates`` has one row
    per grid point with the mean and standard deviation of fold accuracy (A12) and ``is_best`` (highest mean;
    ties → first in grid order, R4). The default grid is the reference's 108 candidates. Forests are grown by
    ``operators/growth.py``: one of the largest size per fold and leaf limit holds all candidates of that limit.
    A row's bootstrap draws follow from ``id_col`` (from all its columns if None, so equal rows share them).
    """
    grid = {**GRID_DEFAULTS, **(grid or FULL_GRID)}
    grid["max_depth"] = [growth.MAX_DEPTH if d is None else d for d in grid["max_depth"]]
    spark, n_classes, features = train.sparkSession, len(classes), list(feature_cols)
    data, cuts = growth.prepare(with_label_index(train, label_col, classes), features, LABEL, fold_col,
                                [id_col] if id_col else train.columns)
    # without a fold left out (-1): the forests for the model, of which the best candidate's is taken
    trees = growth.grow(data, max(grid["num_trees"]), grid["min_samples_leaf"], [*range(n_folds), -1], n_classes,
                        len(features), seed)
    scores = growth.fold_scores(data, trees, grid["max_depth"], grid["min_samples_split"], grid["num_trees"], n_classes)
    rows = []
    for point in itertools.product(*(grid[a] for a in GRID_AXES)):
        p = dict(zip(GRID_AXES, point))
        folds = scores.get((p["num_trees"], p["max_depth"], p["min_samples_split"], p["min_samples_leaf"]), {})
        if len(folds) != n_folds:
            raise ValueError(f"every fold needs rows: found {sorted(folds)} of {n_folds}")
        rows.append((len(rows), p["num_trees"], p["max_depth"], p["min_samples_split"], p["min_samples_leaf"],
                     statistics.fmean(folds.values()), statistics.pstdev(folds.values())))
    cand = spark.createDataFrame(rows, CANDIDATES)  # one row per grid point (model metadata)
    number, size, depth, split_limit, leaf_limit, *_ = max(rows, key=lambda r: (r[5], -r[0]))
    whole = int(np.flatnonzero((trees.leaf_limit == leaf_limit) & (trees.left_out == -1))[0])
    model = forest_model(spark, features, n_classes, growth.node_rows(trees, whole, cuts, depth, split_limit, size), seed)
    return model, cand.withColumn("is_best", F.col("candidate") == number)


def importances(model: PipelineModel) -> list[float]:
    """Impurity importances of the fitted forest (empty if the last stage
    has none, as the reference skips the plot)."""
    last = model.stages[-1]
    return list(map(float, last.featureImportances.toArray())) if hasattr(last, "featureImportances") else []


# Persistence (IO9) -------------------------------------------------------------------------

def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def model_stage_path(path: str, index: int, uid: str) -> str:
    """Where a saved pipeline keeps one of its (fewer than ten) stages."""
    return f"{path.rstrip('/')}/stages/{index}_{uid}"


def load_model(path: str) -> PipelineModel:
    """A missing model is an error."""
    return PipelineModel.load(path)


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame | None:
    """A missing scaler is a warning and scoring proceeds unscaled."""
    try:
        return spark.read.schema(SCALER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("scaler not found at %s; scoring unscaled", path)
        return None


# Batch scoring file → file (M5) --------------------------------------------------------------

def batch_predict_file(spark: SparkSession, model: PipelineModel, in_path: str, out_path: str,
                       schema: T.StructType, feature_cols: Sequence[str], id_col: str, classes: Sequence,
                       class_names: Sequence[str], scaler: DataFrame | None = None,
                       as_of: str | None = None) -> DataFrame:
    """Read a headered CSV with a declared schema, score every row, write
    only the prediction columns (plus the id, since Spark keeps no row order)."""
    from featureflow.operators.scale import apply_scaler
    from featureflow.sources.files import read_csv, write_csv

    df = read_csv(spark, in_path, schema)
    x = apply_scaler(df, scaler, feature_cols) if scaler is not None else df
    p = predict(model, x, classes, class_names, keep=[id_col])
    out = p.select(id_col, "prediction", "prediction_label", F.to_json("probability").alias("probability"),
                   "confidence", F.lit(as_of).cast("string").alias("timestamp"))
    write_csv(out, out_path)
    return out


# Run log (IO10) -------------------------------------------------------------------------------

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("model_path", T.StringType()),
    T.StructField("logged_at", T.TimestampNTZType()),
    T.StructField("experiment", T.StringType()),
])


def log_run(spark: SparkSession, runs_path: str, experiment: str, params: dict, metrics: dict,
            model_path: str | None = None, logged_at: dt.datetime | None = None) -> str:
    """Append one run record to the runs table; the experiment exists as soon
    as it has a run. Every run is a folder of its own, committed by itself and
    found by listing, so any number of writers may log to one table."""
    run_id = uuid.uuid4().hex
    row = (run_id, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()},
           model_path, logged_at or dt.datetime.now(), experiment)
    own = f"{runs_path.rstrip('/')}/experiment={quote(experiment, safe='')}/run_id={run_id}"
    spark.createDataFrame([row], RUNS).drop("experiment", "run_id").coalesce(1).write.parquet(own)
    return run_id


def read_runs(spark: SparkSession, runs_path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(runs_path).select(*RUNS.fieldNames())


def best_run(runs: DataFrame, experiment: str, metric: str) -> DataFrame:
    """The experiment's run with the highest ``metric`` (max_by)."""
    r = runs.where(F.col("experiment") == experiment).where(F.col("metrics")[metric].isNotNull())
    return r.agg(F.max_by(F.struct(*[F.col(c) for c in runs.columns]), F.col("metrics")[metric]).alias("r")) \
        .select("r.*")
