"""Exact percentile with linear interpolation, without gathering a group.

``percentile`` keeps a value→count map per group (unbounded for a big
group of continuous values) and ``percentile_approx`` is approximate. Here:

1. a double has a 64-bit image that orders like it (its bits, with negative
   ones turned round); one pass counts the values of every group by the
   image's ``lead_bits`` leading bits, with their minimum and maximum. No
   boundaries are looked for first, and the counts of all groups and ranks
   come from the same partial aggregate;
2. per group the target ranks ``floor(h)``, ``ceil(h)`` with
   ``h = (n - 1) * p`` each get the value range ``[a, b]`` of the cell holding
   them and the number of the group's values below it;
3. a target cell of more than ``max_rank_rows`` values is counted again by the
   image's next bits, over its own rows only (joined to the table of open
   targets, at most two rows a group, which Spark broadcasts when its bytes
   allow it): twice at most, then all bits are used and a cell is one value;
4. a cell of equal values answers directly; the others (at most
   ``max_rank_rows`` rows each) are ranked with ``row_number`` plus the count
   below the cell, and the two order statistics interpolate:
   ``v_lo + (h - lo) * (v_hi - v_lo)``.

Two passes over the values unless a cell is heavy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featureflow.functions.lookup import join_null_safe
from featureflow.session import ensure_checkpoint_dir

CELL = "__q_lead"   # column of a cell's leading bits
_V = "__q_v"
LEAD_BITS = 20      # sign, exponent and 8 bits of the fraction: cells 0.4 % wide
NEXT_BITS = 22      # of each further count
_ALL = "__q_all"
# A target row is (group..., __q_r: the rank, __q_a/__q_b: its value range,
# __q_before: the group's values below __q_a, __q_c: values in the range)
# plus the per-group interpolation columns:
_H = ["__q_h", "__q_lo", "__q_hi"]


def _in_range(r: Column, before: Column, c: Column) -> Column:
    return (before <= r) & (r < before + c)


def _targets_from_ranges(ranges: DataFrame, groups: list[str], part: list[str], order: str) -> DataFrame:
    """From ``(groups..., part..., order, __q_cnt, __q_min, __q_max, __q_base, ranks...)``
    ranges (ordered by ``order`` within ``groups + part``), the range holding
    each wanted rank ``__q_want`` as a new target row."""
    prior = Window.partitionBy(*groups, *part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__q_base") + F.coalesce(F.sum("__q_cnt").over(prior), F.lit(0))
    r = ranges.select("*", before.alias("__q_bf"))
    hit = r.where(_in_range(F.col("__q_want"), F.col("__q_bf"), F.col("__q_cnt")))
    return hit.select(*groups, F.col("__q_want").alias("__q_r"), F.col("__q_min").alias("__q_a"),
                      F.col("__q_max").alias("__q_b"), F.col("__q_bf").cast("long").alias("__q_before"),
                      F.col("__q_cnt").cast("long").alias("__q_c"), *_H)


def ordered_bits(value: Column) -> Column:
    """A long that orders like the double: equal for equal values (0.0 and -0.0 are), NaN last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF)))


def lead(value: Column, bits: int = LEAD_BITS) -> Column:
    """The leading bits of the value's image."""
    return F.shiftright(ordered_bits(value), 64 - bits)


def _rows_in(vals: DataFrame, targets: DataFrame, groups: list[str]) -> DataFrame:
    """Value rows of each target's range, by a join on the group (null is a
    group). The single global group has at most two targets: their ranges become
    literal conditions, with no join."""
    if groups == [_ALL]:
        cols = [c for c in targets.columns if c != _ALL]
        stype = targets.select(F.struct(*cols)).schema[0].dataType
        picked = [F.when((F.col(_V) >= F.lit(t["__q_a"])) & (F.col(_V) <= F.lit(t["__q_b"])),
                         F.struct(*[F.lit(t[c]).cast(targets.schema[c].dataType).alias(c) for c in cols]))
                  for t in targets.collect()] or [F.lit(None).cast(stype)]
        m = vals.select("*", F.explode(F.array_compact(F.array(*picked))).alias("__q_t"))
        return m.select(*vals.columns, "__q_t.*")
    j = join_null_safe(vals, targets, groups)
    return j.where((F.col(_V) >= F.col("__q_a")) & (F.col(_V) <= F.col("__q_b")))


def exact_percentile(df: DataFrame, value: str, p: float, group_cols: Sequence[str] = (),
                     name: str = "percentile", lead_bits: int = LEAD_BITS, max_rank_rows: int = 1_000_000) -> DataFrame:
    """``(group cols..., name)``; null is a group, groups with no non-null value
    are absent. ``max_rank_rows`` bounds what one task ranks."""
    vals = df.select(*group_cols, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    cells = vals.groupBy(*group_cols, lead(F.col(value), lead_bits).alias(CELL)).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return percentile_of_cells(vals, cells, value, p, group_cols, name, lead_bits, max_rank_rows)


def percentile_of_cells(vals: DataFrame, cells: DataFrame, value: str, p: float, group_cols: Sequence[str] = (),
                        name: str = "percentile", lead_bits: int = LEAD_BITS, max_rank_rows: int = 1_000_000) -> DataFrame:
    """``exact_percentile`` of ``vals`` (no nulls in ``value``) whose cells ``(group cols..., CELL, n, low, high)`` by
    ``lead`` are counted already."""
    groups = list(group_cols)
    if not groups:
        vals, cells = vals.withColumn(_ALL, F.lit(0)), cells.withColumn(_ALL, F.lit(0))
        groups = [_ALL]
    vals = vals.select(*groups, F.col(value).alias(_V))
    stats = cells.select(*groups, CELL, F.col("n").alias("__q_cnt"), F.col("low").alias("__q_min"), F.col("high").alias("__q_max"))
    n = F.sum("__q_cnt").over(Window.partitionBy(*groups))
    h = (n - 1).cast("double") * F.lit(float(p))
    stats = stats.select("*", h.alias("__q_h")).select(
        "*", F.floor("__q_h").cast("long").alias("__q_lo"), F.ceil("__q_h").cast("long").alias("__q_hi"),
        F.lit(0).cast("long").alias("__q_base"))
    stats = stats.select("*", F.explode(F.array_distinct(F.array("__q_lo", "__q_hi"))).alias("__q_want"))
    ensure_checkpoint_dir(vals.sparkSession)
    targets = _targets_from_ranges(stats, groups, ["__q_want"], CELL).checkpoint(eager=True)

    bits = lead_bits
    while bits < 64:  # cells that are still large are counted by the next bits
        is_open = (F.col("__q_a") < F.col("__q_b")) & (F.col("__q_c") > max_rank_rows)
        open_t = targets.where(is_open)
        if open_t.isEmpty():
            break
        bits = min(64, bits + NEXT_BITS)
        rows = _rows_in(vals, open_t, groups)
        ranges = rows.groupBy(*groups, "__q_r", "__q_before", *_H, lead(F.col(_V), bits).alias("__q_sub")).agg(
            F.count(F.lit(1)).alias("__q_cnt"), F.min(_V).alias("__q_min"), F.max(_V).alias("__q_max"))
        ranges = ranges.select("*", F.col("__q_before").alias("__q_base"), F.col("__q_r").alias("__q_want"))
        narrowed = _targets_from_ranges(ranges.drop("__q_before", "__q_r"), groups, ["__q_want"], "__q_sub")
        targets = targets.where(~is_open).unionByName(narrowed).checkpoint(eager=True)

    # values at the target ranks: equal-valued ranges directly, the rest ranked
    const = targets.where(F.col("__q_a") == F.col("__q_b")).select(
        *groups, "__q_r", F.col("__q_a").alias("__q_val"))
    ranged = targets.where(F.col("__q_a") < F.col("__q_b"))
    rows = _rows_in(vals, ranged.select(*groups, "__q_r", "__q_a", "__q_b", "__q_before"), groups)
    w = Window.partitionBy(*groups, "__q_r").orderBy(_V)
    ranked = rows.withColumn("__q_k", F.row_number().over(w) - 1 + F.col("__q_before")) \
        .where(F.col("__q_k") == F.col("__q_r")).select(*groups, "__q_r", F.col(_V).alias("__q_val"))
    at = join_null_safe(const.unionByName(ranked), targets.select(*groups, "__q_r", *_H), [*groups, "__q_r"])
    ends = at.groupBy(*groups).agg(
        F.max(F.when(F.col("__q_r") == F.col("__q_lo"), F.col("__q_val"))).alias("vlo"),
        F.max(F.when(F.col("__q_r") == F.col("__q_hi"), F.col("__q_val"))).alias("vhi"),
        F.max("__q_h").alias("h"), F.max("__q_lo").alias("lo"))
    between = F.col("vlo") + (F.col("h") - F.col("lo")) * (F.col("vhi") - F.col("vlo"))
    out = ends.select(*groups, F.when(F.col("vlo") == F.col("vhi"), F.col("vlo")).otherwise(between).alias(name))
    if groups == [_ALL]:
        return out.drop(_ALL)
    return out
