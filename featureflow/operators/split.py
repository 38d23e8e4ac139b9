"""Exact stratified train/test split (R1) and stratified folds (R2).

Counts follow the reference's splitter: ``n_test = ceil(test_size * n)``,
``n_train = n - n_test``; per class ``floor(n_c * n_train / n)`` plus one
for the classes with the largest remainders (ties: class order) until the
train total is reached. Membership is by rank of
``md5(id || ':' || seed)`` within the class: deterministic, identical in any
engine, and independent of partitioning. Counts are exact, unlike
``randomSplit`` / ``sampleBy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from featureflow.operators.ranking import exact_rank, hash_trie


def split_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def _allocation(label_col: str, test_size: float):
    """Per-class train counts from the small class-size table (largest remainder)."""

    def per_class(sizes: DataFrame) -> DataFrame:
        # sizes: (label, n) — one row per class
        total = Window.partitionBy()
        dec = "decimal(38,0)"
        n = F.sum("n").over(total)
        n_test = F.ceil(F.lit(float(test_size)) * n.cast("double")).cast("long")
        t = sizes.select(label_col, F.col("n").alias("n_c"), n.alias("n_all"), n_test.alias("n_test"),
                         F.count(F.lit(1)).over(total).alias("n_classes"))
        t = t.withColumn("n_train", F.col("n_all") - F.col("n_test"))
        # exact integer arithmetic: n_c * n_train can exceed a long at scale
        prod = F.col("n_c").cast(dec) * F.col("n_train").cast(dec)
        quot = F.expr(f"cast(n_c as {dec}) * cast(n_train as {dec}) div cast(n_all as {dec})")
        t = t.withColumns({"fl": quot.cast("long"),
                           "rem": prod - quot.cast(dec) * F.col("n_all").cast(dec)})
        order = Window.partitionBy().orderBy(F.col("rem").desc(), F.col(label_col))
        need = F.col("n_train") - F.sum("fl").over(total)
        t = t.withColumn("n_train_c", F.col("fl") + F.when(F.row_number().over(order) <= need, 1).otherwise(0))
        bad = (F.when(F.col("n_c") < 2, F.raise_error(F.concat(
                   F.lit("stratified split: class "), F.col(label_col).cast("string"),
                   F.lit(" has fewer than 2 members"))))
               .when(F.col("n_train") < F.col("n_classes"), F.raise_error(F.lit(
                   "stratified split: train size is smaller than the number of classes")))
               .when(F.col("n_test") < F.col("n_classes"), F.raise_error(F.lit(
                   "stratified split: test size is smaller than the number of classes"))))
        return t.select(label_col, F.coalesce(bad.cast("long"), F.col("n_train_c")).alias("__ff_ntrain"),
                        F.col("n_c").alias("__ff_nclass"))

    return per_class


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2,
                     seed: int = 42, cell_rows: int = 1_000_000, rank_col: str = "class_rank",
                     split_col: str = "split") -> DataFrame:
    """Adds ``split`` ('train'|'test') and the row's 0-based ``class_rank``.

    Work per task is bounded by the cells of a trie over the hash's digits
    (``cell_rows`` rows a cell), not by class size, so a class holding a third
    of all rows is spread out; the table of cells has at most 16 rows per class
    and per ``cell_rows`` rows. ``id_col`` must be unique; a row
    without a label fails the split (it would belong to no class).
    """
    h = "__ff_h"
    label = F.col(label_col)
    no_label = F.raise_error(F.lit("stratified split: a row has no label")).cast(df.schema[label_col].dataType)
    staged = df.withColumns({h: split_hash(id_col, seed), label_col: F.when(label.isNull(), no_label).otherwise(label)})
    cells = hash_trie(staged, h, [label_col], "__ff_cell", cell_rows)
    ranked = exact_rank(cells, [h, id_col], F.col("__ff_cell"), partition_cols=[label_col], name=rank_col,
                        per_partition=_allocation(label_col, test_size))
    return (ranked.withColumn(split_col, F.when(F.col(rank_col) < F.col("__ff_ntrain"), F.lit("train"))
                              .otherwise(F.lit("test")))
            .drop(h, "__ff_cell", "__ff_ntrain", "__ff_nclass"))


def stratified_folds(split_df: DataFrame, k: int = 5, rank_col: str = "class_rank",
                     split_col: str = "split", fold_col: str = "fold") -> DataFrame:
    """Fold number for training rows (R2): ``class_rank % k``. Train rows are
    the first ranks of each class, so each class's fold sizes differ by at
    most one. Test rows get null."""
    return split_df.withColumn(
        fold_col,
        F.when(F.col(split_col) == "train", (F.col(rank_col) % k).cast("int")).otherwise(F.lit(None).cast("int")))
