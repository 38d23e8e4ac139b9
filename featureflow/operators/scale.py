"""Standard scaling (A5 fit, J2 apply).

The reference's scaler uses the *population* standard deviation and treats
a (numerically) constant feature as scale 1. MLlib's ``StandardScaler``
uses the sample deviation, so the statistics are computed here with one
aggregate pass and applied as a scalar subquery: the fitted table has one
row per feature, Spark runs it once and inlines the result, no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featureflow.schema import SCALER

_EPS = 2.220446049250313e-16  # float64 machine epsilon (fixed value)


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, mean, scale)``: mean and population std per column; a
    column whose variance is within rounding error of zero gets scale 1."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(c)).alias(f"m{i}"), F.var_pop(F.col(c)).alias(f"v{i}")]
    stats = df.agg(*aggs)
    n = F.col("__n").cast("double")
    entries = []
    for i, c in enumerate(cols):
        m, v = F.col(f"m{i}"), F.col(f"v{i}")
        constant = v <= n * F.lit(_EPS) * v + F.pow(n * m * F.lit(_EPS), 2)
        scale = F.when(constant, F.lit(1.0)).otherwise(F.sqrt(v))
        entries.append(F.struct(F.lit(c).alias("feature"), m.alias("mean"), scale.alias("scale")))
    return stats.select(F.inline(F.array(*entries))).select(
        *[F.col(f.name).cast(f.dataType) for f in SCALER.fields])


def scaler_map(scaler: DataFrame) -> Column:
    """The fitted table as one ``map<feature, struct<mean, scale>>`` value,
    evaluated once as a scalar subquery."""
    return scaler.select(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale"))))).scalar()


def apply_scaler(df: DataFrame, scaler: DataFrame | None, cols: Sequence[str]) -> DataFrame:
    """``(x - mean) / scale`` with the fitted (training) statistics. A missing
    scaler leaves the values unscaled, as the reference's service does."""
    if scaler is None:
        return df
    # one scalar subquery, referenced by every column (kept as its own
    # projection because it is used more than once)
    staged = df.withColumn("__ff_scaler", scaler_map(scaler))
    m = F.col("__ff_scaler")
    return staged.withColumns({c: (F.col(c) - m[c]["mean"]) / m[c]["scale"] for c in cols}).drop("__ff_scaler")
