"""Request scoring (M6 single, M7 batch) over a table or stream of bodies.

One request = one row ``(req_id, body)``. Parsing and the rule checks are
expressions (see ``functions/requests.py``); valid feature vectors go
through the optional scaler (a scalar subquery) and the model: a saved MLlib
pipeline (``load_serving_model``) or a forest expression. Nothing leaves the
JVM and nothing is shuffled: the plan is a projection (plus ``posexplode``
for batch samples), so it also runs unchanged on a stream. A caller whose
batch source has few splits may ask for ``spread_over`` tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featureflow.functions.forest import (
    Forest, argmax_index, confidence, forest_proba, probability_columns, probability_map,
)
from featureflow.functions.lookup import name_by_index
from featureflow.functions.requests import MISSING, batch_request, single_request
from featureflow.operators.scale import scaler_map
from featureflow.operators.train import load_model, load_scaler
from featureflow.schema import FEATURE_MEASURES


# The examples in the answer to a request without features.
EXAMPLE = [5.1, 3.5, 1.4, 0.2]
BATCH_EXAMPLE = [EXAMPLE, [6.2, 2.8, 4.8, 1.8]]


@dataclass
class ServingModel:
    forest: Forest | None                     # None: ``pipeline`` scores
    class_names: Sequence[str]
    scaler: DataFrame | None = None           # (feature, mean, scale); None = unscaled
    feature_names: Sequence[str] = tuple(FEATURE_MEASURES)
    pipeline: PipelineModel | None = None     # its last stage is the classifier


def load_serving_model(spark: SparkSession, model_path: str, class_names: Sequence[str],
                       scaler_path: str | None = None,
                       feature_names: Sequence[str] = tuple(FEATURE_MEASURES)) -> ServingModel:
    """The saved pipeline and scaler, read once. A missing model is an error;
    a missing scaler is a warning and requests are scored unscaled."""
    scaler = load_scaler(spark, scaler_path) if scaler_path else None
    return ServingModel(None, class_names, scaler, feature_names, load_model(model_path))


def _with_proba(df: DataFrame, model: ServingModel, xs: Sequence[str], ok) -> DataFrame:
    """Adds ``__proba``, the class probabilities (null where not ``ok``)."""
    if model.pipeline is None:
        return df.withColumn("__proba", F.when(ok, forest_proba(model.forest, xs)))
    # The vector is assembled here, not by the pipeline's assembler: rejected
    # requests have no features, get zeros and their result is dropped.
    classifier = model.pipeline.stages[-1]
    vector = array_to_vector(F.array(*[F.coalesce(F.when(ok, F.col(x)), F.lit(0.0)) for x in xs]))
    scored = classifier.transform(df.withColumn(classifier.getFeaturesCol(), vector))
    proba = vector_to_array(F.col(classifier.getProbabilityCol()))
    return scored.withColumn("__proba", F.when(ok, proba)).drop(
        classifier.getFeaturesCol(), classifier.getRawPredictionCol(), classifier.getProbabilityCol(),
        classifier.getPredictionCol())


def _predict_columns(df: DataFrame, model: ServingModel, xs: Sequence[str], ok) -> DataFrame:
    if model.scaler is not None:
        df = df.withColumn("__scaler", scaler_map(model.scaler))
        m = F.col("__scaler")
        df = df.withColumns({x: (F.col(x) - m[name]["mean"]) / m[name]["scale"]
                             for x, name in zip(xs, model.feature_names)}).drop("__scaler")
    df = _with_proba(df, model, xs, ok)
    proba = F.col("__proba")
    pred = argmax_index(proba)
    return df.withColumns({
        "prediction": pred,
        "class_name": name_by_index(pred, list(model.class_names)),
        "confidence": confidence(proba),
    }).select("*", *probability_columns(F.col("__proba"), model.class_names)).drop("__proba")


def spread(df: DataFrame, tasks: int | None, key: str = "req_id") -> DataFrame:
    """Parsing bodies is CPU work per row with no shuffle, so it runs in as
    many tasks as the source has splits. A caller who knows that a batch
    source has few splits (one unsplittable file) may have it hash-spread on
    the request id (deterministic, so a retried task sees the same rows)."""
    return df if tasks is None else df.repartition(tasks, key)


def score_requests(requests: DataFrame, model: ServingModel, as_of: str | None = None,
                   spread_over: int | None = None) -> DataFrame:
    """One result row per request: status, error, received length, echoed
    inputs, prediction, class name, per-class probabilities, confidence."""
    r = single_request(spread(requests.select("req_id", "body"), spread_over), "body")
    xs = [f"__x{i}" for i in range(len(model.feature_names))]
    r = r.select("req_id", "status", "error", "received",
                 *[F.element_at("features", i + 1).alias(x) for i, x in enumerate(xs)])
    r = r.select("*", *[F.col(x).alias(f"in_{name}") for x, name in zip(xs, model.feature_names)])
    ok = F.col("status") == 200
    out = _predict_columns(r, model, xs, ok).withColumn("success", ok)
    if as_of is not None:
        out = out.withColumn("timestamp", F.when(ok, F.lit(as_of)))
    return out.drop(*xs)


def response_documents(scored: DataFrame, model: ServingModel, as_of: str) -> DataFrame:
    """``(req_id, status, document)``: the JSON answer to each single request
    from ``score_requests`` rows. A valid request has its nested prediction
    with the probabilities map (F6), the echoed inputs and ``as_of``; a
    wrong length the received length; missing features the expected format."""
    ok = F.col("status") == 200
    # fixed values: the example shown in the answer
    example = F.when(F.col("error") == MISSING, F.struct(F.array(*[F.lit(x) for x in EXAMPLE]).alias("features")))
    document = F.struct(
        F.when(ok, F.lit(True)).when(F.col("status") == 500, F.lit(False)).alias("success"),
        F.col("error"), F.col("received"), example.alias("expected_format"),
        F.when(ok, _prediction(model)).alias("prediction"),
        F.when(ok, F.struct(*[F.col(f"in_{n}").alias(n) for n in model.feature_names])).alias("input_features"),
        F.when(ok, F.lit(as_of)).alias("timestamp"))
    return scored.select("req_id", "status", F.to_json(document).alias("document"))  # null fields are left out


def batch_documents(requests: DataFrame, model: ServingModel, as_of: str, spread_over: int | None = None) -> DataFrame:
    """``(req_id, status, document)``: the JSON answer to each batch request.

    A request's samples came in one body and go back into one document. A
    forest is an expression, so they are scored inside the row: one parse, no
    explode and no shuffle. A pipeline scores rows, so its samples are
    exploded and put together again."""
    if model.forest is None:
        return _joined_documents(*score_batch_requests(requests, model, spread_over), model, as_of)
    b = batch_request(spread(requests.select("req_id", "body"), spread_over), "body")
    b = b.withColumn("__scaler", scaler_map(model.scaler) if model.scaler is not None else F.lit(None))
    b = b.withColumn("__p", F.transform("samples", lambda x, i: _answer(model, x, i)))
    return b.select("req_id", "status", F.to_json(_batch_document(model, as_of, F.size("samples"))).alias("document"))


def _answer(model: ServingModel, sample: Column, place: Column) -> Column:
    """One sample's entry in the document, from its array of features."""
    xs = [F.element_at(sample, i + 1) for i in range(len(model.feature_names))]
    m = F.col("__scaler")
    scaled = xs if model.scaler is None else [(x - m[name]["mean"]) / m[name]["scale"] for x, name in zip(xs, model.feature_names)]

    def entry(proba: Column) -> Column:
        pred = argmax_index(proba)
        prediction = F.struct(pred.alias("prediction"), name_by_index(pred, list(model.class_names)).alias("class_name"),
                              probability_map(proba, model.class_names).alias("probabilities"), confidence(proba).alias("confidence"))
        return F.struct(place.alias("sample_id"), prediction.alias("prediction"), F.array(*xs).alias("input_features"))

    return F.get(F.transform(F.array(forest_proba(model.forest, scaled)), entry), 0)


def _batch_document(model: ServingModel, as_of: str, total: Column) -> Column:
    """The answer from ``status``, ``error`` and the entries ``__p`` of a successful request; null fields are left out."""
    ok = F.col("status") == 200
    example = F.when(F.col("error") == MISSING, F.struct(
        F.array(*[F.array(*[F.lit(x) for x in row]) for row in BATCH_EXAMPLE]).alias("features")))
    return F.struct(
        F.when(ok, F.lit(True)).when(F.col("status") == 500, F.lit(False)).alias("success"),
        F.col("error"), example.alias("expected_format"), F.when(ok, F.col("__p")).alias("predictions"),
        F.when(ok, total).alias("total_samples"), F.when(ok, F.lit(as_of)).alias("timestamp"))


def _joined_documents(summary: DataFrame, predictions: DataFrame, model: ServingModel, as_of: str) -> DataFrame:
    sample = F.struct("sample_id", _prediction(model).alias("prediction"),
                      F.array(*[f"in_{n}" for n in model.feature_names]).alias("input_features"))
    in_order = F.array_sort(F.collect_list(sample), lambda a, b: a["sample_id"] - b["sample_id"])
    lists = predictions.groupBy("req_id").agg(in_order.alias("__p"))
    empty = F.array().cast(lists.schema["__p"].dataType)
    joined = summary.join(lists, "req_id", "left").withColumn("__p", F.coalesce("__p", empty))
    return joined.select("req_id", "status", F.to_json(_batch_document(model, as_of, F.col("total_samples"))).alias("document"))


def _prediction(model: ServingModel) -> Column:
    probabilities = probability_map(F.array(*[f"p_{n}" for n in model.class_names]), model.class_names)
    return F.struct("prediction", "class_name", probabilities.alias("probabilities"), "confidence")


def score_batch_requests(requests: DataFrame, model: ServingModel, spread_over: int | None = None):
    """``(summary, predictions)``: per request ``status, error, success,
    total_samples``; per sample of a successful request ``sample_id`` (0-based
    position, R6), inputs and prediction."""
    b = batch_request(spread(requests.select("req_id", "body"), spread_over), "body")
    ok = F.col("status") == 200
    summary = b.select("req_id", "status", "error", ok.alias("success"),
                       F.when(ok, F.size("samples")).cast("int").alias("total_samples"))
    xs = [f"__x{i}" for i in range(len(model.feature_names))]
    # A filter on status, or the non-null filter Spark infers for an inner
    # explode, would be pushed down and re-expanded into every rule
    # projection; the outer explode keeps the rules computed once, and the
    # filter on its output position cannot move below the generator.
    samples = b.select("req_id", F.posexplode_outer("samples").alias("sample_id", "__s")) \
        .where(F.col("sample_id").isNotNull())
    samples = samples.select("req_id", F.col("sample_id").cast("int").alias("sample_id"),
                             *[F.element_at("__s", i + 1).alias(x) for i, x in enumerate(xs)])
    samples = samples.select("*", *[F.col(x).alias(f"in_{n}") for x, n in zip(xs, model.feature_names)])
    preds = _predict_columns(samples, model, xs, F.lit(True)).drop(*xs)
    return summary, preds
