"""Data-quality rules (V1–V12) → ``DataFrame[rule, column, observed, threshold, passed]``.

All data rules of one table become aggregate expressions of a single
``agg`` (one scan, map-side partial aggregation), and the one result row is
unpivoted with ``inline``. Schema rules need no job and become literal rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from featureflow.sources.versions import read_table

_INF = float("inf")

RESULT = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("observed", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("passed", T.BooleanType()),
])


def _row(rule: str, column: str, observed: Column, threshold: Column, passed: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"),
                    observed.cast("double").alias("observed"), threshold.cast("double").alias("threshold"),
                    F.coalesce(passed, F.lit(False)).alias("passed"))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


_numbers = itertools.count()


def _alias(kind: str) -> str:
    """A fresh aggregate name, so a rule may occur any number of times in one validation."""
    return f"__v_{kind}_{next(_numbers)}"


@dataclass
class Rule:
    """A rule contributes aggregate expressions and result rows over them."""
    aggs: list[Column] = field(default_factory=list)
    rows: list[Column] = field(default_factory=list)


def _floating(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))


def required_columns(df: DataFrame, cols: Sequence[str]) -> Rule:
    have = set(df.columns)
    return Rule(rows=[_row("required_column", c, F.lit(1.0 if c in have else 0.0), F.lit(1.0),
                           F.lit(c in have)) for c in cols])


def column_count(df: DataFrame, expected: int) -> Rule:
    n = len(df.columns)
    return Rule(rows=[_row("column_count", "*", F.lit(n), F.lit(expected), F.lit(n == expected))])


def row_count(expected) -> Rule:
    name = _alias("rows")
    o = F.col(name)
    return Rule(aggs=[F.count(F.lit(1)).alias(name)],
                rows=[_row("row_count", "*", o, _lit(expected), o == _lit(expected))])


def no_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> Rule:
    """Null count per column and in total; NaN counts as null, as in pandas."""
    cols = list(cols or df.columns)
    aggs, rows, names = [], [], []
    for c in cols:
        cond = F.col(f"`{c}`").isNull()
        if _floating(df, c):
            cond = cond | F.isnan(F.col(f"`{c}`"))
        name = _alias("null")
        names.append(name)
        aggs.append(F.count_if(cond).alias(name))
        rows.append(_row("null_count", c, F.col(name), F.lit(0), F.col(name) == 0))
    total = sum((F.col(name) for name in names), F.lit(0))
    rows.append(_row("null_count", "*", total, F.lit(0), total == 0))
    return Rule(aggs=aggs, rows=rows)


def distinct_count(col: str, expected: int, approx: bool = False) -> Rule:
    c = F.col(f"`{col}`")
    agg = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    name = _alias("distinct")
    o = F.col(name)
    return Rule(aggs=[agg.alias(name)],
                rows=[_row("distinct_count", col, o, F.lit(expected), o == expected)])


def no_infinity(cols: Sequence[str]) -> Rule:
    """Count of ±inf per column; NaN passes, as in the reference."""
    aggs, rows = [], []
    for c in cols:
        name = _alias("inf")
        aggs.append(F.count_if(F.abs(F.col(f"`{c}`")) == F.lit(_INF)).alias(name))
        o = F.col(name)
        rows.append(_row("infinite_count", c, o, F.lit(0), o == 0))
    return Rule(aggs=aggs, rows=rows)


def positive_std(cols: Sequence[str]) -> Rule:
    """Sample standard deviation > 0; a null deviation (one row) fails."""
    aggs, rows = [], []
    for c in cols:
        name = _alias("std")
        aggs.append(F.stddev_samp(F.col(f"`{c}`")).alias(name))
        o = F.col(name)
        rows.append(_row("std_positive", c, o, F.lit(0), o > 0))
    return Rule(aggs=aggs, rows=rows)


def non_negative(cols: Sequence[str]) -> Rule:
    aggs, rows = [], []
    for c in cols:
        name = _alias("min")
        aggs.append(F.min(F.col(f"`{c}`")).alias(name))
        o = F.col(name)
        rows.append(_row("min_non_negative", c, o, F.lit(0), o >= 0))
    return Rule(aggs=aggs, rows=rows)


def mean_gap(cols: Sequence[str], split_col: str, a: str = "train", b: str = "test",
             max_gap: float = 1.0) -> Rule:
    """|mean over split a − mean over split b| < max_gap per column (V9),
    as conditional averages in the same single pass."""
    aggs, rows = [], []
    s = F.col(split_col)
    for c in cols:
        x = F.col(f"`{c}`")
        in_a, in_b = _alias("mean"), _alias("mean")
        aggs += [F.avg(F.when(s == a, x)).alias(in_a), F.avg(F.when(s == b, x)).alias(in_b)]
        o = F.abs(F.col(in_a) - F.col(in_b))
        rows.append(_row("mean_gap", c, o, F.lit(max_gap), o < max_gap))
    return Rule(aggs=aggs, rows=rows)


def same_columns(left: DataFrame, right: DataFrame) -> Rule:
    """V8: both frames have the same columns in the same order."""
    ok = list(left.columns) == list(right.columns)
    return Rule(rows=[_row("same_columns", "*", F.lit(1.0 if ok else 0.0), F.lit(1.0), F.lit(ok))])


def shape(df: DataFrame) -> DataFrame:
    """``(rows, columns)`` of a frame (A1): one count, the width from the schema."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Evaluate all rules with one aggregate pass over ``df``."""
    aggs = [a for r in rules for a in r.aggs]
    rows = [row for r in rules for row in r.rows]
    base = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    return base.select(F.inline(F.array(*rows)))


# Metric gates over a metrics record -------------------------------------------------

GATE = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("observed", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("status", T.StringType()),
])


def metric_gates(metrics: DataFrame, gates: dict[str, float]) -> DataFrame:
    """Each gate is ``metric > threshold``; a metric the record lacks (column
    absent or null) is 'skipped', as the reference skips absent metrics."""
    rows = []
    for name, thr in gates.items():
        if name in metrics.columns:
            o = F.col(f"`{name}`").cast("double")
            status = F.when(o.isNull(), "skipped").when(o > thr, "passed").otherwise("failed")
        else:
            o, status = F.lit(None).cast("double"), F.lit("skipped")
        rows.append(F.struct(F.lit(name).alias("metric"), o.alias("observed"),
                             F.lit(float(thr)).alias("threshold"), status.alias("status")))
    return metrics.select(F.inline(F.array(*rows)))


# Artifacts exist and load ---------------------------------------------------------

_ABSENT_CONDITIONS = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _absent(error: Exception) -> bool:
    """The error says that a path is missing or that nothing can be read there."""
    if isinstance(error, FileNotFoundError):  # a table without a version
        return True
    if isinstance(error, AnalysisException):
        return error.getCondition() in _ABSENT_CONDITIONS
    # a model's metadata is read as an RDD: its input format names a missing path itself
    return isinstance(error, (Py4JJavaError, PySparkException)) and "Input path does not exist" in str(error)


def artifact_checks(spark, artifacts: dict[str, tuple[str, str]]) -> DataFrame:
    """``{name: (kind, path)}`` with kind 'parquet' | 'json' | 'text' |
    'csv' | 'table' (a table of versions) | 'model'; each artifact passes when it loads (reading only its
    metadata/schema, no data pass). A path that does not exist, or that holds
    no readable table or model, fails its check; any other error (a lost
    store, no permission) is raised. One row per artifact."""
    from pyspark.ml import PipelineModel

    rows = []
    for name, (kind, path) in artifacts.items():
        try:
            if kind == "model":
                PipelineModel.load(path)
            elif kind == "table":
                read_table(spark, path).schema  # noqa: B018
            elif kind == "csv":
                spark.read.option("header", True).csv(path).schema  # noqa: B018
            else:
                getattr(spark.read, kind)(path).schema  # noqa: B018
            ok = True
        except Exception as e:  # noqa: BLE001
            if not _absent(e):
                raise
            ok = False
        rows.append(_row("artifact_exists", name, F.lit(1.0 if ok else 0.0), F.lit(1.0), F.lit(ok)))
    return spark.range(1).select(F.inline(F.array(*rows)))
