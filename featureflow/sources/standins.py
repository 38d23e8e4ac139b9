"""Keyed inputs derived from the driver tables (the reference bundles a
150-row sample; any keyed table plays its role here).

All builders are lazy DataFrame plans over the parquet files, so their
work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featureflow.session import table

# Measure columns of the observation stand-in and their
# feature-table names.
OBS_MEASURES = ["f1", "f2", "f3", "f4"]
OBS_RENAME = {"f1": "sepal_length", "f2": "sepal_width", "f3": "petal_length", "f4": "petal_width"}
OBS_CLASSES = ["F", "O", "P"]
OBS_CLASS_NAMES = ["finished", "open", "partial"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with line items: ``obs_id, f1..f4, label, ts``.

    Line items are aggregated per order *before* the join: the partial
    aggregate shrinks lineitem map-side, its output is hash-partitioned on the
    order key, and the join then only has to shuffle ``orders``. ``max`` is
    exact, so every engine gets the same doubles.
    """
    li = (table(spark, sf_dir, "lineitem")
          .groupBy(F.col("l_orderkey").alias("obs_id"))
          .agg(F.max("l_quantity").alias("f1"), F.max("l_extendedprice").alias("f2"),
               F.max("l_discount").alias("f3"), F.max("l_tax").alias("f4")))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("obs_id"), F.col("o_orderstatus").alias("label"),
        F.col("o_orderdate").alias("ts"))
    return li.join(orders, "obs_id", "inner").select("obs_id", *OBS_MEASURES, "label", "ts")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature side of the feature/label alignment: per-order line-item maxima."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_orderkey").alias("obs_id"))
            .agg(F.max("l_quantity").alias("f1"), F.max("l_extendedprice").alias("f2"),
                 F.max("l_discount").alias("f3"), F.max("l_tax").alias("f4")))


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label side of the alignment: one label per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("obs_id"), F.col("o_orderstatus").alias("label"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request-log records from ``events``: an ``error`` event is a failed
    request, ``value`` is the response time in seconds, one phase per day."""
    ev = table(spark, sf_dir, "events")
    epoch = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / F.lit(1e6)
    ok = F.col("event_type") != "error"
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.when(ok, F.lit(200)).otherwise(F.lit(500)).alias("status_code"),
        F.col("value").alias("response_time"),
        ok.alias("success"),
        epoch.alias("timestamp"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("server error")).alias("error"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("phase"),
    )


def feature_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows for the point-in-time join: ``view`` events keyed by user."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    return ev.select(
        F.col("user_id"), F.col("ts").alias("event_timestamp"),
        F.col("ts").alias("created_timestamp"), F.col("event_id").alias("feature_event_id"),
        F.col("value").alias("view_value"),
        F.get_json_object("props", "$.k").cast("double").alias("view_k"),
    )


def spine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spine rows for the point-in-time join: ``purchase`` events."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select(F.col("event_id"), F.col("user_id"), F.col("ts"))


def rule_labelled_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a learnable rule label (driver labels are near random):
    class by bands of the largest quantity and discount."""
    obs = observations(spark, sf_dir)
    label = (F.when(F.col("f1") < 40, F.lit("low"))
             .when(F.col("f3") < 0.08, F.lit("mid"))
             .otherwise(F.lit("high")))
    return obs.withColumn("label", label)


def _request_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("req_id"), "event_type", k.alias("k"),
        (k.cast("double") / F.lit(2.0)).alias("x1"), (F.col("value") * F.lit(300.0)).alias("x2"),
        ((k % 11).cast("double") / F.lit(100.0)).alias("x3"), ((k % 9).cast("double") / F.lit(100.0)).alias("x4"))


def _num(*cols) -> list:
    out = []
    for i, c in enumerate(cols):
        if i:
            out.append(F.lit(","))
        out.append(F.col(c).cast("string") if isinstance(c, str) else c)
    return out


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(req_id, body)`` single-prediction requests, one per event; the event
    type picks the request shape so every rule outcome occurs:
    view → valid (some with a repeated key, some with a non-finite number
    beside the features); click → 2 features; signup → ``{}`` / ``null`` / no
    ``features``; error → not JSON / ``features: null``; purchase → a string or
    NaN element / 5 features / a 4-character string / a boolean element."""
    p = _request_parts(spark, sf_dir)
    four = F.concat(F.lit('{"features":['), *_num("x1", "x2", "x3", "x4"), F.lit("]}"))
    k = F.col("k")
    inside = F.concat(F.lit('"features":['), *_num("x1", "x2", "x3", "x4"), F.lit("]}"))
    body = (F.when((F.col("event_type") == "view") & (k % 6 == 5), F.concat(F.lit('{"features":null,'), inside))
            .when((F.col("event_type") == "view") & (k % 6 == 4),
                  F.concat(F.lit('{"note":"a \\"NaN\\", ok","limit":-Infinity,"note":NaN,'), inside))
            .when(F.col("event_type") == "view", four)
            .when(F.col("event_type") == "click", F.concat(F.lit('{"features":['), *_num("x1", "x2"), F.lit("]}")))
            .when(F.col("event_type") == "signup",
                  F.when(k % 3 == 0, F.lit("{}")).when(k % 3 == 1, F.lit("null"))
                  .otherwise(F.concat(F.lit('{"other":'), F.when(k % 2 == 0, F.lit("NaN")).otherwise(k.cast("string")), F.lit("}"))))
            .when(F.col("event_type") == "error",
                  F.when(k % 2 == 0, F.concat(F.lit("not json "), k.cast("string")))
                  .otherwise(F.lit('{"features":null}')))
            .otherwise(
                F.when(k % 4 == 0, F.concat(
                    F.lit('{"features":['), *_num("x1", F.when(k % 8 == 0, F.lit("NaN")).otherwise(F.lit('"x"')), "x3", "x4"),
                    F.lit("]}")))
                .when(k % 4 == 1, F.concat(F.lit('{"features":['), *_num("x1", "x2", "x3", "x4", "x1"),
                                           F.lit("]}")))
                .when(k % 4 == 2, F.lit('{"features":"abcd"}'))
                .otherwise(F.concat(F.lit('{"features":['), *_num(F.lit("true"), "x2", "x3", "x4"),
                                    F.lit("]}")))))
    return p.select("req_id", body.alias("body"))


def batch_request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(req_id, body)`` batch requests: view → two valid samples, some behind
    a repeated key; click → second sample too short; signup → empty list; error
    → a null sample or one with an infinity;
    purchase → a non-numeric first sample followed by a short one."""
    p = _request_parts(spark, sf_dir)
    s1 = F.concat(F.lit("["), *_num("x1", "x2", "x3", "x4"), F.lit("]"))
    s2 = F.concat(F.lit("["), *_num("x4", "x3", "x2", "x1"), F.lit("]"))
    bad = F.concat(F.lit("["), *_num("x1", "x2", F.lit('"x"'), "x4"), F.lit("]"))
    et = F.col("event_type")
    k = F.col("k")
    body = (F.when(et == "view", F.concat(F.when(k % 3 == 0, F.lit('{"features":[[1]],"features":[')).otherwise(F.lit('{"features":[')),
                                          s1, F.lit(","), s2, F.lit("]}")))
            .when(et == "click", F.concat(F.lit('{"features":['), s1, F.lit(",["), F.col("x1").cast("string"),
                                          F.lit("]]}")))
            .when(et == "signup", F.lit('{"features":[]}'))
            .when(et == "error", F.concat(F.lit('{"features":['), s1, F.when(k % 2 == 0, F.lit(",null]}"))
                                          .otherwise(F.lit(",[1,2,Infinity,4]]}"))))
            .otherwise(F.concat(F.lit('{"features":['), bad, F.lit(",[1,2]]}"))))
    return p.select("req_id", body.alias("body"))
