"""Exact dedup through an extendible-hash index kept in shared files (DataFrame operations only).

1. Directory. It is built over the distinct 64-bit keys: starting from the depth
   that their number suggests, the directory doubles until no bucket exceeds its
   capacity; a bucket that fits keeps its smaller local depth, so it covers a
   wider key range. Keys with equal leading bits up to DEEPEST share a bucket.
2. Owners. The directory routes every row to its bucket; rows are dealt by ranges
   of (bucket, key, salt), so an owner task has a key range, and a group of copies
   of any size is shared by SALTS owners at most. An owner compares the texts of
   each key byte by byte: equal ones become one entry, different ones under one
   key stay apart.
3. Index. The entries of a text from several salts are merged by digest, numbered
   along the chain of their key and written to the shared folder.
4. Every row looks its entry up in its bucket, by key and along the chain by
   digest; the lookup join splits hot keys (AQE).

Normalisation lower-cases A-Z only. A null text counts as empty. The row with
the largest id of a group stays; rows that share this id stay together. Null
ids lose against any id; a group of only null ids keeps all its rows. The
pipeline's stage (drop_copies) further keeps one row of equal id and text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.session import scratch_path

BUCKET_ENTRIES = 200_000
DEEPEST = 60        # bits of a key that the directory tells apart at most
SALTS = 64          # owners that share the copies of one text


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the faster built-in."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(cell, bucket, local_depth) for every cell of the final global depth, and that depth, of distinct keys.

    A cell is the first `depth` bits of a key; a bucket is named by its first cell."""
    n = entries.count()
    start = max(0, (max(1, n // capacity)).bit_length() - 1)
    depth = start + 4
    while True:
        cells = entries.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("cell")).agg(F.count("*").alias("n"))
        if cells.filter(F.col("n") > capacity).isEmpty() or depth >= DEEPEST:
            break
        depth += 1  # doubling
    ranges = cells.withColumn("local_depth", F.explode(F.sequence(F.lit(start), F.lit(depth)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {depth} - local_depth)"))
    loads = ranges.groupBy("local_depth", "prefix").agg(F.sum("n").alias("load"))
    fits = loads.filter((F.col("load") <= capacity) | (F.col("local_depth") == depth)).drop("load")
    chosen = ranges.join(fits, ["local_depth", "prefix"]).groupBy("cell").agg(F.min("local_depth").alias("local_depth"))
    bucket = F.expr(f"shiftleft(shiftright(cell, {depth} - local_depth), {depth} - local_depth)")
    return chosen.withColumn("bucket", bucket), depth


def cell(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth)


def build_index(rows: DataFrame, capacity: int = BUCKET_ENTRIES) -> tuple[DataFrame, DataFrame, int]:
    """Index entries (bucket, key, chain, digest, keep_id, group_size) of rows (id, key, text), in shared files, and
    the directory with its depth."""
    spark = rows.sparkSession
    path = scratch_path(spark, "exact-dedup")
    rows.select("key").distinct().write.parquet(f"{path}/keys")
    cells, depth = directory(spark.read.parquet(f"{path}/keys"), capacity)
    cells.write.parquet(f"{path}/directory")
    cells = spark.read.parquet(f"{path}/directory")
    routed = rows.withColumn("cell", cell(depth)).join(cells, "cell").select(
        "bucket", "key", F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).alias("salt"), "id", "text")
    owners = routed.repartitionByRange("bucket", "key", "salt")
    compared = owners.groupBy("bucket", "key", "salt", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    entries = compared.select("bucket", "key", F.sha2("text", 256).alias("digest"), "keep_id", "n").groupBy(
        "bucket", "key", "digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest"))
    entries.withColumn("chain", chain).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index"), cells, depth


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = BUCKET_ENTRIES, key=F.xxhash64) -> DataFrame:
    """Every row's (id_col, keep_id, group_size, kept, digest, bucket, chain). `key` gives a text's 64-bit key."""
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", key(F.col("text")))
    index, cells, depth = build_index(rows, capacity)
    asks = rows.select("id", "key", F.sha2("text", 256).alias("digest")).withColumn("cell", cell(depth)).join(cells, "cell")
    found = asks.drop("local_depth").join(index, ["bucket", "key", "digest"], "left")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "digest", "bucket", "chain")


def one_of_equal(rows: DataFrame, docs: DataFrame, *keys: str) -> DataFrame:
    """Of rows that agree on the keys (null equals null) one, with the columns of docs: the smallest by a hash
    of its columns, so reruns agree. Partial aggregation merges a hot row before the shuffle."""
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("__row")
    return rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(one).select("__row.*")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of kept rows with equal id and normalised text, one."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(
        F.col(id_col).alias("__id"), F.col("digest").alias("__digest")).distinct()
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    here = docs.withColumns({"__here": F.sha2(text, 256)})
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__here") == F.col("__digest"))
    return one_of_equal(here.join(kept, same, "left_semi"), docs, id_col, "__here")
