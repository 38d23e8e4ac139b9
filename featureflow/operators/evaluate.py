"""Evaluation (A6–A9, M9), matrix text sink (IO8) and importances.

Everything is derived from ONE ``groupBy(actual, predicted).count()`` over
the scored rows (map-side partial aggregation; at most C² output rows).
Per-class and averaged metrics are then computed on that tiny table. The
class list is the sorted union of actual and predicted values, as in the
reference's metric library; empty cells of the matrix are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def confusion_pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(actual, predicted, n)`` for the observed pairs only. A null class
    fails the job (it has no place in a sorted class list)."""
    a, p = (F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null class in {c}"))).otherwise(F.col(c))
            for c in (actual, predicted))
    return df.groupBy(a.alias("actual"), p.alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_rows(pairs: DataFrame) -> DataFrame:
    """One row per class ``(actual, counts, classes)``; ``counts`` follows
    ``classes`` (the sorted class list). Works on the C-row class table only."""
    present = pairs.groupBy("actual").agg(
        F.map_from_entries(F.collect_list(F.struct("predicted", "n"))).alias("m"))
    every = pairs.select(F.col("actual").alias("c")).union(pairs.select(F.col("predicted").alias("c"))).distinct()
    j = every.join(present, every["c"] == present["actual"], "left")
    j = j.withColumn("classes", F.array_sort(F.collect_set("c").over(Window.partitionBy())))
    counts = F.transform("classes", lambda x: F.coalesce(F.col("m")[x], F.lit(0).cast("long")))
    return j.select(F.col("c").alias("actual"), counts.alias("counts"), "classes")


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Zero-filled long form ``(actual, predicted, n)``: C × C rows."""
    rows = confusion_rows(confusion_pairs(df, actual, predicted))
    return rows.select("actual", "classes", F.posexplode("counts").alias("pos", "n")).select(
        "actual", F.element_at("classes", F.col("pos") + 1).alias("predicted"), "n")


def confusion_matrix_lines(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Text form of the matrix (IO8): one line per actual class, counts
    separated by one space, in class order."""
    rows = confusion_rows(confusion_pairs(df, actual, predicted))
    return rows.select("actual", F.array_join(F.transform("counts", lambda x: x.cast("string")), " ").alias("line"))


def write_matrix_text(lines: DataFrame, path: str) -> None:
    """Write the lines ordered by class as one text file (C lines)."""
    lines.orderBy("actual").select("line").coalesce(1).write.mode("overwrite").text(path)


def class_stats(pairs: DataFrame) -> DataFrame:
    """``(cls, support, predicted_n, tp)`` per class of the union."""
    roles = F.array(
        F.struct(F.col("actual").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("pred_n"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0).cast("long"))
                 .alias("tp")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("pred_n"), F.lit(0).cast("long").alias("tp")),
    )
    return pairs.select(F.inline(roles)).groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("pred_n").alias("pred_n"), F.sum("tp").alias("tp"))


def _safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (the reference's zero-division result)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    s = class_stats(pairs)
    return s.select(
        "cls", "support", "tp", "pred_n",
        _safe_ratio(F.col("tp"), F.col("pred_n")).alias("precision"),
        _safe_ratio(F.col("tp"), F.col("support")).alias("recall"),
        # F1 from counts: 2·tp / (support + predicted)
        _safe_ratio(2 * F.col("tp"), F.col("support") + F.col("pred_n")).alias("f1_score"),
    )


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows ``label, precision, recall, f1_score, support`` for each class,
    then 'accuracy' (f1_score = accuracy, precision/recall null), 'macro avg'
    and 'weighted avg' (A8)."""
    m = class_metrics(confusion_pairs(df, actual, predicted))
    per_class = m.select(F.col("cls").cast("string").alias("label"), "precision", "recall", "f1_score",
                         F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    summary = m.agg(
        (F.sum("tp") / tot).alias("acc"), tot.cast("long").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("support") * F.col("precision")) / tot).alias("wp"),
        (F.sum(F.col("support") * F.col("recall")) / tot).alias("wr"),
        (F.sum(F.col("support") * F.col("f1_score")) / tot).alias("wf"),
    )
    nul = F.lit(None).cast("double")
    tail = summary.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("label"), nul.alias("precision"), nul.alias("recall"),
                 F.col("acc").alias("f1_score"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1_score"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1_score"), F.col("n").alias("support")),
    )))
    return per_class.unionByName(tail)


def evaluation_report(df: DataFrame, actual: str, predicted: str, with_matrix: bool = True) -> DataFrame:
    """One record (M9): accuracy and support-weighted precision, recall and
    F1 (A6, A7), plus the confusion matrix as nested arrays (A9)."""
    pairs = confusion_pairs(df, actual, predicted)
    m = class_metrics(pairs)
    tot = F.sum("support")
    out = m.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("support") * F.col("precision")) / tot).alias("precision"),
        (F.sum(F.col("support") * F.col("recall")) / tot).alias("recall"),
        (F.sum(F.col("support") * F.col("f1_score")) / tot).alias("f1_score"),
    )
    if with_matrix:
        rows = confusion_rows(pairs)
        matrix = rows.select(F.transform(F.array_sort(F.collect_list(F.struct("actual", "counts"))),
                                         lambda r: r["counts"])).scalar()
        out = out.withColumn("confusion_matrix", matrix)
    return out


def feature_importances(spark: SparkSession, importances: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Importances sorted descending (R3); ties keep the higher index first,
    as a reversed ascending argsort does. Model metadata: one row per feature."""
    rows = [(i, names[i], float(v)) for i, v in enumerate(importances)]
    schema = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("feature", T.StringType()),
                           T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(rows, schema).orderBy(F.col("importance").desc(), F.col("index").desc())
