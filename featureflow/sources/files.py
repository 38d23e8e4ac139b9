"""File sources and sinks: CSV (IO1, IO2), warehouse load (IO4), metrics
records as JSON (IO6).

Schemas are declared, never inferred by default; reads fail fast on a
malformed record instead of silently nulling it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from featureflow.sources.versions import read_table, replace_table


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             infer: bool = False) -> DataFrame:
    """Headered CSV (IO1). ``schema`` is the normal case; ``infer=True`` is
    the opt-in equivalent of the reference's type inference."""
    r = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV, replacing what is there (IO2). One file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def load_table(spark: SparkSession, csv_path: str, schema: T.StructType | None, target: str,
               table_name: str | None = None, infer: bool = False) -> int:
    """CSV → table, replacing its rows (IO4): header skipped, columns conformed
    to the fixed schema, the new version written beside the old one and then
    pointed to (``read_table`` reads it; with ``table_name`` the catalog table
    is pointed to it as well). A load that fails leaves the old rows. Returns
    the loaded row count, read back from the written table. ``infer=True`` with
    no schema is the opt-in equivalent of the reference's type detection."""
    if schema is None and not infer:
        raise ValueError("load_table needs a schema, or infer=True")
    version = replace_table(read_csv(spark, csv_path, schema, infer), target, schema)
    if table_name:
        if spark.catalog.tableExists(table_name):
            spark.sql(f"ALTER TABLE {table_name} SET LOCATION '{version}'")
        else:
            spark.catalog.createTable(table_name, path=version, source="parquet")
        spark.catalog.refreshTable(table_name)
        return spark.table(table_name).count()
    return read_table(spark, target).count()


def write_record(df: DataFrame, path: str) -> None:
    """A one-row metrics record as JSON (IO6)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_record(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a metrics record; an absent record reads as no rows (the
    reference treats a missing file as an empty dict)."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
