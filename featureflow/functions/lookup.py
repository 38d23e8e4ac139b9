"""Code → name maps (F3) and the lookup join (J3); time literals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session time zone."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def map_values(col, mapping: dict, strict: bool = False) -> Column:
    """Series.map(dict): unmapped (or null) keys give null; with ``strict`` an
    unmapped non-null key fails the job. The map is a literal, so this stays a
    codegen'd expression (for maps that are model metadata, not data)."""
    c = F.col(col) if isinstance(col, str) else col
    if not mapping:
        return F.lit(None)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    val = m[c]
    if strict:
        return F.when(c.isNotNull() & val.isNull(),
                      F.raise_error(F.concat(F.lit("unmapped key: "), c.cast("string")))).otherwise(val)
    return val


def index_of(col, values: Sequence) -> Column:
    """Position of ``col`` in ``values`` (0-based), null when absent."""
    return map_values(col, {v: i for i, v in enumerate(values)})


def name_by_index(col, names: Sequence[str]) -> Column:
    """``names[i]`` with Python list semantics: an index outside
    ``[-len, len)`` fails the job (the reference raises IndexError)."""
    c = F.col(col) if isinstance(col, str) else col
    n = len(names)
    arr = F.array(*[F.lit(x) for x in names])
    pos = F.when(c < 0, c + n).otherwise(c)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(
        (pos < 0) | (pos >= n),
        F.raise_error(F.concat(F.lit("list index out of range: "), c.cast("string"))).cast("string"),
    ).otherwise(F.element_at(arr, (pos + 1).cast("int")))


def lookup_join(df: DataFrame, lookup: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join to a lookup table (J3). No hint: Spark broadcasts the lookup
    side when its measured size is within the session's byte threshold."""
    return df.join(lookup, on=on, how="left")


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key; keeps left's keys."""
    other = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    equal = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in on])
    return left.join(other, equal, how).drop(*[f"__right_{c}" for c in on])
