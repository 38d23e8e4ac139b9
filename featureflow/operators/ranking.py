"""Exact, deterministic, distributed ranking (F1 row index, R1/R2 ranks).

A plain ``row_number()`` over no partition (or over a handful of classes)
moves everything (or a third of everything) into one task. Instead:

1. every row gets a *bucket* that is a monotone function of its order key;
2. ``groupBy(partition, bucket).count()`` — a small table;
3. prefix sums over that small table give each bucket's starting offset;
4. ``row_number()`` inside ``(partition, bucket)`` plus the offset.

The result is exact for any monotone bucket function; balanced buckets only
make it fast. Nothing depends on partition ids, so a recomputed partition
(after an executor loss) gets the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from featureflow.session import written

_BUCKET = "__ff_bucket"
_OFFSET = "__ff_offset"
_KEYNUM = "__ff_keynum"
_SALTS = 256         # first-level merges of quantile sketches
_SKETCH_SIZE = 4096  # rank error of about 1/1500 of a bucket; some 100 KB
_KEYS_A_BUCKET = 32  # keys drawn for each splitter
_HEAVY = 4           # a part this many times its share is cut again
_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def exact_rank(df: DataFrame, order_cols: Sequence[str], bucket: Column,
               partition_cols: Sequence[str] = (), name: str = "rank",
               check_unique: bool = True,
               per_partition: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """0-based ``row_number`` within ``partition_cols`` ordered by ``order_cols``.

    ``bucket`` must be non-decreasing in the order key within each partition.
    With ``check_unique`` a repeated order key fails the job (ties would make
    the numbering depend on execution order).

    ``per_partition`` receives the small table ``(partition cols..., n)`` of
    partition sizes and may return extra per-partition columns (keyed by the
    partition columns); they ride along the small offsets join instead of
    costing another pass over the data.
    """
    parts = list(partition_cols)
    order = list(order_cols)
    # The bucket is never null for the callers here; the coalesce makes that
    # visible to Catalyst. Otherwise it infers ``isnotnull(bucket)`` from the
    # offsets join and pushes it (with the whole bucket expression) below
    # upstream aggregates, e.g. computing an md5 per raw line item, and the
    # extra filter keeps identical subplans from sharing one exchange.
    b = df.withColumn(_BUCKET, F.coalesce(bucket, F.lit(-1)))
    counts = b.groupBy(*parts, _BUCKET).agg(F.count(F.lit(1)).alias("__ff_n"))
    prior = Window.partitionBy(*parts).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*parts, _BUCKET,
                            F.coalesce(F.sum("__ff_n").over(prior), F.lit(0)).cast("long").alias(_OFFSET))
    if per_partition is not None:
        sizes = counts.groupBy(*parts).agg(F.sum("__ff_n").cast("long").alias("n"))
        if parts:
            offsets = offsets.join(per_partition(sizes), on=parts, how="inner")
        else:  # one global partition: a one-row table, added as scalar subqueries (no join)
            extra = per_partition(sizes)
            offsets = offsets.withColumns({c: extra.select(c).scalar() for c in extra.columns})
    # Rank inside (partition, bucket) first, then add the bucket's offset.
    # The big side is shuffled once, by the window key, and that shuffle does
    # not wait for the small offsets chain (counts -> prefix sums -> per
    # partition extras). The offsets table has one row per (partition,
    # bucket): AQE broadcasts it once it has seen its size; otherwise the join
    # reuses the window's partitioning and order, so only the offsets move.
    local = Window.partitionBy(*parts, _BUCKET).orderBy(*order)
    ranked = b.withColumn("__ff_local", F.row_number().over(local) - 1)
    if check_unique:
        key = F.struct(*order) if len(order) > 1 else F.col(order[0])
        prev = F.lag(key).over(local)
        ranked = ranked.withColumn(
            "__ff_local",
            F.when(prev.isNotNull() & (prev == key),
                   F.raise_error(F.lit(f"order key {order} is not unique")).cast("int"))
            .otherwise(F.col("__ff_local")),
        )
    out = ranked.join(offsets, on=[*parts, _BUCKET], how="inner") \
        .withColumn(name, (F.col("__ff_local") + F.col(_OFFSET)).cast("long")).drop("__ff_local")
    return out.drop(_BUCKET, _OFFSET)


def key_as_double(df: DataFrame, col: str) -> Column:
    """A monotone double image of an order key that has one (for bucketing only)."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                       T.FloatType, T.DoubleType, T.DecimalType)):
        return c.cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{col}`)").cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c).cast("double")
    raise TypeError(f"cannot order by column {col} of type {dt}")


def _refine(staged: DataFrame, bounds: list[float], parts: int) -> tuple[list[float], int]:
    """``bounds`` of ``_KEYNUM`` with every bucket between them cut at its own
    approximate quantiles into ``parts``, and the row count.

    Quantile sketches of a fixed size are merged in two levels, per (bucket,
    salt) and then per bucket, so no task merges the sketches of all splits.
    The salt is the split's number: it decides only where a sketch is merged,
    and ranks are exact for any boundaries.
    """
    salted = _bucketize(staged.where(~F.isnan(_KEYNUM)), bounds, "__b").withColumn(
        "__salt", F.spark_partition_id() % _SALTS)
    k = F.lit(_SKETCH_SIZE)
    sketches = salted.groupBy("__b", "__salt").agg(F.kll_sketch_agg_double(_KEYNUM, k).alias("k")) \
        .groupBy("__b").agg(F.kll_merge_agg_double("k", k).alias("k"))
    ranks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    rows = sketches.select(F.kll_sketch_get_n_double("k").alias("n"),
                           F.kll_sketch_get_quantile_double("k", ranks).alias("q")).collect()  # one row a bucket
    return sorted({*bounds, *(x for r in rows for x in r["q"])}), sum(r["n"] for r in rows)


def _is_text(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.StringType, T.BinaryType))


def key_splitters(df: DataFrame, col: str, need: int, n: int) -> list:
    """About ``need - 1`` whole keys that cut the ``n`` keys of ``col`` into like parts, in order.

    A hash of the key draws about ``_KEYS_A_BUCKET`` keys a part, range partitioning sorts them, and only the first
    key of each part comes to the driver."""
    share = min(1.0, _KEYS_A_BUCKET * need / max(1, n))
    drawn = df.select(col).where(F.col(col).isNotNull()).where(
        F.pmod(F.xxhash64(col), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    first = drawn.repartitionByRange(need, col).groupBy(F.spark_partition_id().alias("part")).agg(F.min(col).alias("key"))
    return sorted(bytes(r["key"]) if isinstance(r["key"], bytearray) else r["key"] for r in first.collect())[1:]


def splitter_bucket(col: str, splitters: list) -> Column:
    """How many of the sorted splitters are at or below the key, by binary search."""
    if not splitters:
        return F.lit(0)
    keys, none = F.array(*[F.lit(k) for k in splitters]), F.lit(0)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(keys, middle) <= F.col(col)
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(
            F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high")))

    ends = F.struct(none.alias("low"), F.lit(len(splitters)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))
    return F.aggregate(steps, ends, halve)["low"]


def text_splitters(df: DataFrame, col: str, need: int, n: int) -> list:
    """Splitters of a string or binary key; a part of over ``_HEAVY`` times its share is cut again at its own keys."""
    splitters, share = key_splitters(df, col, need, n), max(1, n // need)
    while splitters:
        at = splitter_bucket(col, splitters)
        heavy = df.select(at.alias("b")).groupBy("b").count().where(F.col("count") > _HEAVY * share).collect()  # few parts
        if not heavy:
            break
        rows = sum(r["count"] for r in heavy)
        more = key_splitters(df.where(at.isin([r["b"] for r in heavy])), col, -(-2 * rows // share), rows)
        if set(more) <= set(splitters):
            break
        splitters = sorted({*splitters, *more})
    return splitters


def _bucketize(staged: DataFrame, bounds: list[float], out: str) -> DataFrame:
    splits = [float("-inf")] + sorted({b for b in bounds if math.isfinite(b)}) + [float("inf")]
    if len(splits) < 3:
        return staged.withColumn(out, F.lit(0))
    bz = Bucketizer(splits=splits, inputCol=_KEYNUM, outputCol=out, handleInvalid="error")
    return bz.transform(staged).withColumn(out, F.col(out).cast("int"))


def with_quantile_bucket(df: DataFrame, col: str, out: str, buckets: int = 256) -> DataFrame:
    """Add ``out``: a bucket number from approximate quantile boundaries of ``col``.

    One aggregate pass returns ``buckets - 1`` boundaries (an array whose size
    is the parameter, not the data); MLlib's Bucketizer then does a JVM binary
    search per row. Strings and binaries are cut at whole keys instead. Equal
    keys always land in the same bucket.
    """
    if _is_text(df, col):
        cuts = text_splitters(df, col, buckets, df.count()) if buckets > 1 else []
        return df.withColumn(out, splitter_bucket(col, cuts))
    staged = df.withColumn(_KEYNUM, key_as_double(df, col))
    bounds = _refine(staged, [], buckets)[0] if buckets > 1 else []
    return _bucketize(staged, bounds, out).drop(_KEYNUM)


def row_index(df: DataFrame, order_col: str, name: str = "row_index", buckets: int | None = None,
              rows_per_bucket: int = 1_000_000, coarse_buckets: int = 256) -> DataFrame:
    """Contiguous 0..n-1 index in ``order_col`` order (F1).

    Not ``monotonically_increasing_id`` (gaps, depends on partitioning) and
    not an un-partitioned window (one task for everything). The number of
    range buckets follows the row count (about ``rows_per_bucket`` rows
    per window task) unless ``buckets`` is given. The count and
    ``coarse_buckets`` quantile boundaries come from one aggregate pass. They
    are thinned to the needed number; an input of more than
    ``coarse_buckets * rows_per_bucket`` rows has each bucket cut again at its
    own quantiles, pass by pass, so buckets stay bounded at any size (the
    driver holds one number per ``rows_per_bucket`` rows). String and binary
    keys are cut at sampled whole keys, so what they share does not matter.
    """
    if df.schema[order_col].nullable:
        df = df.withColumn(order_col, F.when(F.col(order_col).isNull(),
                                             F.raise_error(F.lit(f"null in order key {order_col}")))
                           .otherwise(F.col(order_col)))
    if buckets is not None:
        staged = with_quantile_bucket(df, order_col, "__ff_qbucket", buckets)
    elif _is_text(df, order_col):
        n = df.count()
        need = max(2, df.sparkSession.sparkContext.defaultParallelism, -(-n // rows_per_bucket))
        staged = df.withColumn("__ff_qbucket", splitter_bucket(order_col, text_splitters(df, order_col, need, n)))
    else:
        staged = df.withColumn(_KEYNUM, key_as_double(df, order_col))
        have = max(2, coarse_buckets)
        bounds, n = _refine(staged, [], have)
        # at least one bucket per default task slot, so the window is always
        # hash-partitioned by bucket (never a single-partition exchange)
        floor = max(2, df.sparkSession.sparkContext.defaultParallelism)
        need = max(floor, -(-n // rows_per_bucket))
        if need < have and bounds:
            # boundary j/need is the coarse boundary round(j * have / need)
            bounds = [bounds[min(len(bounds), max(1, round(j * have / need))) - 1] for j in range(1, need)]
        while have < need:
            parts = min(coarse_buckets, -(-need // have))
            bounds, _ = _refine(staged, bounds, parts)
            have *= parts
        staged = _bucketize(staged, bounds, "__ff_qbucket").drop(_KEYNUM)
    ranked = exact_rank(staged, [order_col], F.col("__ff_qbucket"), name=name)
    return ranked.drop("__ff_qbucket")


def hash_trie(df: DataFrame, hex_col: str, partition_cols: Sequence[str], out: str, cell_rows: int = 1_000_000,
              digits: int = 1) -> DataFrame:
    """Add ``out``: a row's cell in a trie over the leading digits of a lowercase hex hash, numbered in hash order.

    Cells of ``digits`` digits are counted per partition; only those of more than ``cell_rows`` rows are cut by
    another digit and counted again, until none is heavy. So the cells are few for a small input and bounded for a
    large one, whatever a partition's share of the rows is. Heavy cells (at most one per ``cell_rows`` rows and
    level) are joined back, one join a level."""
    parts = list(partition_cols)
    rows = df.withColumn("__depth", F.lit(digits))
    cell = lambda: F.substring(F.col(hex_col), F.lit(1), F.col("__depth"))
    depth = digits
    while depth < 15:
        here = rows.where(F.col("__depth") == depth).groupBy(*parts, cell().alias("__cell")).agg(F.count("*").alias("__n"))
        heavy = written(here.where(F.col("__n") > cell_rows).select(*parts, "__cell"), "heavy-cells")
        if heavy.isEmpty():
            break
        heavy = heavy.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(parts)], F.col("__cell").alias("__heavy"))
        same = cell() == F.col("__heavy")
        for i, c in enumerate(parts):
            same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
        rows = rows.join(heavy, same, "left")
        rows = rows.withColumn("__depth", F.when(F.col("__heavy").isNotNull(), depth + 1).otherwise(F.col("__depth")))
        rows = rows.drop("__heavy", *[f"__p{i}" for i in range(len(parts))])
        depth += 1
    return rows.withColumn(out, F.conv(F.rpad(cell(), 15, "0"), 16, 10).cast("long")).drop("__depth")
