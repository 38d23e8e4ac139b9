"""Tables that are replaced as a whole and never half (IO4, IO5, S2 sink).

A table's folder holds `versions/<name>`, complete Parquet tables, and
`pointers/<number>-<name>`, one small committed record for each replacement.
A write first stages its version; only then a pointer names it. Readers take
the version of the highest pointer (of two writers with one number, the larger
name, for every reader alike), so they see the old rows until the new ones are
complete, a load that fails leaves the old table, and readers of an earlier
version keep its files. Nothing but Spark's own writers and readers is used, so
any store that Spark can write works; old versions are the owner's to remove.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from featureflow.schema import conform

POINTER = "number long, version string"


def current_pointer(spark: SparkSession, path: str):
    """The record of the highest pointer, or None for a table that was never written."""
    try:
        pointers = spark.read.schema(POINTER).option("mode", "FAILFAST").json(f"{path.rstrip('/')}/pointers/*")
        return pointers.orderBy(F.desc("number"), F.desc("version")).first()  # one row per replacement
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_table(df: DataFrame, path: str, schema: T.StructType | None = None) -> str:
    """Replace the table with the rows of df (conformed to a fixed schema); returns the new version's folder."""
    spark, root, name = df.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    staged = f"{root}/versions/{name}"
    (df if schema is None else conform(df, schema)).write.parquet(staged)
    last = current_pointer(spark, root)
    number = 1 + (last["number"] if last else 0)
    spark.createDataFrame([(number, name)], POINTER).coalesce(1).write.json(f"{root}/pointers/{number:012d}-{name}")
    return staged


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version's rows; a table that was never written is an error."""
    last = current_pointer(spark, path)
    if last is None:
        raise FileNotFoundError(f"no version of a table at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/versions/{last['version']}")
