"""Feature/label alignment by key.

The reference zips two files by row position; Spark has no row order, so
rows are aligned by an id with an equi-join, and keys that are missing on
either side or repeated are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def align(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Inner equi-join on ``key`` (both sides hash-partitioned on the key)."""
    return features.join(labels, on=key, how="inner")


def alignment_report(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: matched keys, keys only on one side, repeated keys per side.

    Each side is first reduced to ``(key, count)`` with a map-side partial
    aggregate; the full outer join of the two reduced sides is co-partitioned
    on the key, so no raw row crosses the network twice.
    """
    f = features.groupBy(key).agg(F.count(F.lit(1)).alias("nf"))
    lab = labels.groupBy(key).agg(F.count(F.lit(1)).alias("nl"))
    j = f.join(lab, on=key, how="full_outer")
    return j.agg(
        F.count_if(F.col("nf").isNotNull() & F.col("nl").isNotNull()).alias("matched_keys"),
        F.count_if(F.col("nl").isNull()).alias("features_only_keys"),
        F.count_if(F.col("nf").isNull()).alias("labels_only_keys"),
        F.count_if(F.col("nf") > 1).alias("repeated_feature_keys"),
        F.count_if(F.col("nl") > 1).alias("repeated_label_keys"),
        F.coalesce(F.sum(F.col("nf") * F.col("nl")), F.lit(0)).cast("long").alias("joined_rows"),
    )
