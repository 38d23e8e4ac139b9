"""Declared schemas and `conform` (fixed table schema, IO5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Raw measure names, feature-table names and class names of the
# reference data model.
RAW_MEASURES = ["sepal length (cm)", "sepal width (cm)", "petal length (cm)", "petal width (cm)"]
FEATURE_MEASURES = ["sepal_length", "sepal_width", "petal_length", "petal_width"]
RAW_TO_FEATURE = dict(zip(RAW_MEASURES, FEATURE_MEASURES))
CLASS_NAMES = ["setosa", "versicolor", "virginica"]
FEATURE_TABLE_COLUMNS = [
    "entity_id", "sepal_length", "sepal_width", "petal_length", "petal_width",
    "sepal_ratio", "petal_ratio", "total_area", "event_timestamp", "created_timestamp",
]

RAW = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in RAW_MEASURES]
    + [
        T.StructField("target", T.IntegerType()),
        T.StructField("target_name", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

FEATURES = T.StructType(
    [T.StructField("entity_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in FEATURE_TABLE_COLUMNS[1:8]]
    + [
        T.StructField("event_timestamp", T.TimestampNTZType()),
        T.StructField("created_timestamp", T.TimestampNTZType()),
    ]
)

SCALER = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("scale", T.DoubleType()),
])

REQUEST = T.StructType([
    T.StructField("req_id", T.LongType()),
    T.StructField("body", T.StringType()),
])

REQUEST_LOG = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("response_time", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("phase", T.StringType()),
])

EVALUATION = T.StructType([
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
])


PLAIN_RECORD = T.StructType([
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("n_estimators", T.IntegerType()),
    T.StructField("max_depth", T.IntegerType()),
])

TUNED_RECORD = T.StructType([
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("cv_score", T.DoubleType()),
    T.StructField("best_params", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("model_type", T.StringType()),
])


class SchemaMismatch(ValueError):
    pass


def conform(df: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Select the schema's columns in order and cast to its types.

    A missing column raises. Extra columns are dropped, or raise when
    ``strict``. Casts follow the session's ANSI setting, so a value that does
    not convert fails the job instead of turning into null.
    """
    have = set(df.columns)
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise SchemaMismatch(f"missing columns: {missing}")
    if strict:
        extra = [c for c in df.columns if c not in {f.name for f in schema.fields}]
        if extra:
            raise SchemaMismatch(f"unexpected columns: {extra}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def require_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing columns: {missing}")
