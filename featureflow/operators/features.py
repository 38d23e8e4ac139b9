"""Raw snapshot (IO3) and feature engineering (F1–F5, P1, P2, IO5)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featureflow.functions.arith import ieee_div, sum_of_products
from featureflow.functions.lookup import index_of, name_by_index, ntz
from featureflow.operators.ranking import row_index
from featureflow.schema import FEATURE_MEASURES, FEATURE_TABLE_COLUMNS, FEATURES, conform, require_columns


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename map (P2); a name that is not in the frame is an error."""
    require_columns(df, list(mapping))
    return df.withColumnsRenamed(mapping)


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column selection by list (P1): order kept, a missing column raises."""
    require_columns(df, list(cols))
    return df.select(*[F.col(f"`{c}`") for c in cols])


def head_rows(df: DataFrame, order_cols: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows (P4). Spark keeps no row order, so "first" is by the
    given key; planned as a top-n (each task keeps n rows, one merge)."""
    return df.orderBy(*[F.col(c) for c in order_cols]).limit(n)


def raw_snapshot(df: DataFrame, id_col: str, measures: dict[str, str], label_col: str,
                 classes: Sequence[str], class_names: Sequence[str], as_of) -> DataFrame:
    """Raw table (IO3): measures under their raw names, numeric ``target``
    (class position), ``target_name`` (F3 by list index) and one ingestion
    timestamp for all rows (F5, a parameter instead of the wall clock)."""
    target = index_of(label_col, list(classes)).cast("int")
    return df.select(
        F.col(id_col),
        *[F.col(src).cast("double").alias(raw) for src, raw in measures.items()],
        target.alias("target"),
        name_by_index(target, list(class_names)).alias("target_name"),
        ntz(as_of).alias("timestamp"),
    )


def derived_features(df: DataFrame, measures: Sequence[str] = FEATURE_MEASURES) -> DataFrame:
    """Ratios and area (F2a–c) over four measures named like the feature table:
    ``m0/m1``, ``m2/m3`` with IEEE division, ``m0*m1 + m2*m3``."""
    m0, m1, m2, m3 = measures
    return df.withColumns({
        "sepal_ratio": ieee_div(m0, m1),
        "petal_ratio": ieee_div(m2, m3),
        "total_area": sum_of_products([(m0, m1), (m2, m3)]),
    })


def steps_before(position: Column, base_time, step: dt.timedelta = dt.timedelta(hours=1)) -> Column:
    """``base_time - position * step``."""
    us = step // dt.timedelta(microseconds=1)
    return F.timestamp_add("MICROSECOND", -position * F.lit(us).cast("long"), ntz(base_time))


def engineer_features(df: DataFrame, order_col: str, rename: dict[str, str], base_time,
                      created_time, buckets: int | None = None,
                      step: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """Feature table in the fixed 10-column schema (F1–F5, P1, P2, IO5).

    ``entity_id`` is the row's 0-based position in ``order_col`` order, as a
    string; ``event_timestamp = base_time - position * step``; one
    ``created_timestamp`` for all rows. Times and step are parameters: with
    an hour a row, timestamps before the year 1 start at some 18 million rows,
    so a large table needs a shorter step.
    """
    indexed = row_index(df, order_col, "__ff_idx", buckets=buckets)
    renamed = rename_columns(indexed, rename)
    feats = derived_features(renamed).withColumns({
        "entity_id": F.col("__ff_idx").cast("string"),
        "event_timestamp": steps_before(F.col("__ff_idx"), base_time, step),
        "created_timestamp": ntz(created_time),
    })
    return conform(select_columns(feats, FEATURE_TABLE_COLUMNS), FEATURES)
