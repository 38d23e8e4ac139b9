"""Feature store operators over a declared feature view.

* ``asof_join`` — point-in-time join: for every spine row the newest
  feature row of the same key with ``ts - ttl <= event_ts <= ts`` (ties on
  event time → newest created time); no match → nulls; each spine row once.
* ``latest_features`` — newest row per key within ``[start, end]``.
* ``lookup_latest`` — values for a list of keys, null when unknown or older
  than the TTL at ``as_of``.

The as-of join never builds candidate pairs. Spine and feature rows are
unioned and a running ``last(..., ignorenulls)`` window carries the newest
feature forward. The window is partitioned by ``(key, time cell)`` rather
than by key, so one hot key is split over many tasks; the newest feature
of *earlier* cells comes from a small per-``(key, cell)`` table
(one row each, forward-filled per key), so results are exact for any cells
and any TTL. Cells are 2^32 microseconds wide; cells with too many rows are
cut again, down to one microsecond.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from featureflow.functions.lookup import ntz
from featureflow.session import written
from featureflow.sources.versions import replace_table

CELL_BITS = (32, 26, 20, 14, 8, 2, 0)   # cells are 2**bits microseconds wide
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


@dataclass
class FeatureView:
    name: str
    key: str
    event_ts: str
    features: Sequence[str]
    created_ts: str | None = None
    ttl: dt.timedelta | None = None
    as_float: bool = True            # fields are Float32 through the view (P5)
    tiebreak: Sequence[str] = field(default_factory=tuple)


def _micros(c: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{c}`)")


def _values(view: FeatureView, prefix: str = "") -> list[Column]:
    out = []
    for f in view.features:
        c = F.col(f"{prefix}{f}")
        out.append((c.cast("float") if view.as_float else c).alias(f))
    return out


def hot_cells(rows: DataFrame, max_cell_rows: int) -> list[DataFrame]:
    """For each cell width in turn, the cells ``(__k, __c)`` of ``rows(__k,
    __us)`` with more than ``max_cell_rows`` rows; ends at the first width
    without any. Only rows of hot cells are counted again, and a list has at
    most one entry per ``max_cell_rows`` rows."""
    levels = []
    for bits in CELL_BITS[:-1]:
        cells = rows.withColumn("__c", F.shiftright("__us", bits))
        hot = written(cells.groupBy("__k", "__c").agg(F.count(F.lit(1)).alias("n"))
                      .where(F.col("n") > max_cell_rows).select("__k", "__c"), "hot-cells")
        if hot.isEmpty():
            break
        levels.append(hot)
        rows = cells.join(hot, ["__k", "__c"], "left_semi").select("__k", "__us")
    return levels


def with_cell(rows: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """``rows(__k, __us, ...)`` with ``__b``, the first microsecond of the
    row's cell: the widest cell that is not hot."""
    def start(bits: int) -> Column:
        return F.shiftleft(F.shiftright("__us", bits), bits)

    cell = start(CELL_BITS[len(levels)])
    for bits, hot in reversed(list(zip(CELL_BITS, levels))):
        c, h = f"__c{bits}", f"__h{bits}"
        rows = rows.withColumn(c, F.shiftright("__us", bits)).join(
            hot.select("__k", F.col("__c").alias(c), F.lit(True).alias(h)), ["__k", c], "left")
        cell = F.when(F.col(h), cell).otherwise(start(bits))
    return rows.withColumn("__b", cell)


def asof_join(spine: DataFrame, features: DataFrame, view: FeatureView, spine_ts: str,
              bucket: dt.timedelta | None = None, max_cell_rows: int = 1_000_000) -> DataFrame:
    """Spine columns + the view's feature values + ``feature_timestamp``.

    A key's rows are cut into time cells of about 72 minutes, and only a cell
    with more than ``max_cell_rows`` rows is cut further, so a hot key is spread
    over many tasks while the other keys keep wide cells. Results do not
    depend on the cells; ``bucket`` fixes one width for all. A null key or time matches nothing; such spine rows
    are kept without features."""
    key = view.key
    created = F.col(view.created_ts) if view.created_ts else F.lit(None).cast("timestamp_ntz")
    feat_struct = F.struct(F.col(view.event_ts).alias("__ets"), created.alias("__cts"),
                           *[F.col(f).alias(f) for f in view.features])
    spine_struct = F.struct(*[F.col(c) for c in spine.columns])
    feat_type = features.select(feat_struct).schema[0].dataType
    tb = [F.col(c) for c in view.tiebreak]
    tb_null = [F.lit(None).cast(features.schema[c].dataType).alias(f"__tb{i}") for i, c in enumerate(view.tiebreak)]

    matchable = F.col(key).isNotNull() & F.col(spine_ts).isNotNull()
    s_rows = spine.where(matchable).select(
        F.col(key).alias("__k"), _micros(spine_ts).alias("__us"), F.col(spine_ts).alias("__t"),
        F.lit(1).alias("__is_spine"), F.lit(None).cast("timestamp_ntz").alias("__c"), *tb_null,
        spine_struct.alias("__s"), F.lit(None).cast(feat_type).alias("__f"))
    f_rows = features.where(F.col(key).isNotNull() & F.col(view.event_ts).isNotNull()).select(
        F.col(key).alias("__k"), _micros(view.event_ts).alias("__us"), F.col(view.event_ts).alias("__t"),
        F.lit(0).alias("__is_spine"), created.alias("__c"), *[c.alias(f"__tb{i}") for i, c in enumerate(tb)],
        F.lit(None).cast(spine.select(spine_struct).schema[0].dataType).alias("__s"), feat_struct.alias("__f"))
    if bucket is not None:
        fixed = F.floor(F.col("__us") / F.lit(bucket // dt.timedelta(microseconds=1))).cast("long")
        s_rows, f_rows = s_rows.withColumn("__b", fixed), f_rows.withColumn("__b", fixed)
    else:
        levels = hot_cells(s_rows.select("__k", "__us").unionByName(f_rows.select("__k", "__us")), max_cell_rows)
        s_rows, f_rows = with_cell(s_rows, levels), with_cell(f_rows, levels)
    order = ["__t", "__is_spine", "__c", *[f"__tb{i}" for i in range(len(tb))]]
    w = Window.partitionBy("__k", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    u = s_rows.unionByName(f_rows)
    hit = u.withColumn("__hit", F.last("__f", ignorenulls=True).over(w)).where(F.col("__is_spine") == 1) \
        .select("__k", "__b", "__s", "__hit")

    # newest feature row of every (key, cell), forward-filled over the
    # key's cells: gives the newest feature strictly before a cell. A key has
    # one row per cell here, about one per max_cell_rows rows if it is hot.
    last_in_cell = f_rows.groupBy("__k", "__b").agg(
        F.max_by("__f", F.struct(*order)).alias("__last"), F.lit(0).alias("__need"))
    needed = s_rows.select("__k", "__b").distinct().select(
        "__k", "__b", F.lit(None).cast(last_in_cell.schema["__last"].dataType).alias("__last"),
        F.lit(1).alias("__need"))
    k = needed.unionByName(last_in_cell).groupBy("__k", "__b").agg(
        F.max("__need").alias("__need"), F.max("__last").alias("__last"))
    wk = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    prev = k.withColumn("__prev", F.last("__last", ignorenulls=True).over(wk)) \
        .where(F.col("__need") == 1).select("__k", "__b", "__prev")

    j = hit.join(prev, on=["__k", "__b"], how="left")
    f = F.coalesce(F.col("__hit"), F.col("__prev"))
    valid = f.isNotNull()
    if view.ttl is not None:
        us = int(view.ttl.total_seconds() * 1_000_000)
        valid = valid & (f["__ets"] >= F.timestamp_add("MICROSECOND", F.lit(-us), F.col(f"__s.{spine_ts}")))
    j = j.select("__s", F.when(valid, f).alias("__m")).unionByName(
        spine.where(~matchable).select(spine_struct.alias("__s"), F.lit(None).cast(feat_type).alias("__m")))
    return j.select("__s.*", *_values(view, "__m."), F.col("__m.__ets").alias("feature_timestamp"))


def latest_features(features: DataFrame, view: FeatureView, start=None, end=None) -> DataFrame:
    """Newest ``(event_ts, created_ts)`` row per key with the event time in
    ``[start, end]`` (both inclusive). ``max_by`` is a partial aggregate, so a
    hot key is combined map-side."""
    f = features
    if start is not None:
        f = f.where(F.col(view.event_ts) >= ntz(start))
    if end is not None:
        f = f.where(F.col(view.event_ts) <= ntz(end))
    created = F.col(view.created_ts) if view.created_ts else F.lit(None).cast("timestamp_ntz")
    order = F.struct(F.col(view.event_ts), created, *[F.col(c) for c in view.tiebreak])
    vals = F.struct(F.col(view.event_ts).alias("event_timestamp"), *[F.col(c) for c in view.features])
    latest = f.groupBy(view.key).agg(F.max_by(vals, order).alias("__v"))
    return latest.select(view.key, "__v.event_timestamp", *_values(view, "__v."))


def materialize(latest: DataFrame, path: str) -> None:
    """Replace the online table with the latest values (S2 sink); lookups read the
    old values until the new ones are complete."""
    replace_table(latest, path)


def lookup_latest(keys: DataFrame, latest: DataFrame, view: FeatureView, as_of) -> DataFrame:
    """Left join of requested keys to the latest values (S3); unknown keys and
    values older than the TTL at ``as_of`` give nulls. Both sides are keyed
    tables, so this is a plain shuffle join on the key."""
    j = keys.join(latest, on=view.key, how="left")
    if view.ttl is None:
        return j
    us = int(view.ttl.total_seconds() * 1_000_000)
    fresh = F.col("event_timestamp") >= F.timestamp_add("MICROSECOND", F.lit(-us), ntz(as_of))
    return j.select(*keys.columns, *[F.when(fresh, F.col(c)).alias(c) for c in ["event_timestamp", *view.features]])
