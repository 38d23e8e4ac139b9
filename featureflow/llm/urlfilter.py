"""URL rules through a Bloom filter cascade.

Rules are (host, path prefix, verdict). A url's candidate keys are every suffix
of its host at label borders with every prefix of its path that has the length
of some rule's path. Level 0 of the cascade encodes the rules' keys; level 1
encodes the keys of the corpus that level 0 wrongly accepts, level 2 the rules'
keys that level 1 wrongly accepts, and so on until no wrong key is left. Over
the whole corpus (the universe it was built from) membership is then exact,
without a join and without the list itself.

All levels are sized from the number of rules and grow with it alone: level 0
takes about log2(universe / rules) bits a rule, later levels about 1.44 bits
per key. Levels are built from distributed bit sets, merged by bitwise or.

Null urls and urls without `://` have empty host and path and fit no rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.words import raw
from featureflow.session import written

MAX_LEVELS = 64


class Level:
    """One Bloom filter: k bits of m per key."""

    def __init__(self, number: int, keys: int, rate: float):
        self.number, self.k = number, max(1, round(-log(rate, 2)))
        self.m = max(64, ceil(-max(keys, 1) * log(rate) / log(2) ** 2))
        self.bits = np.zeros(self.m, bool)

    def places(self, digests: np.ndarray) -> np.ndarray:
        """(keys, k) bit numbers from pairs of 64-bit digests."""
        step = np.arange(self.k, dtype=np.uint64)
        one, two = digests[:, :1] + np.uint64(self.number) * np.uint64(0x9E3779B97F4A7C15), digests[:, 1:] | np.uint64(1)
        h = one + step * two
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        return (h % np.uint64(self.m)).astype(np.int64)

    def has(self, digests: np.ndarray) -> np.ndarray:
        return self.bits[self.places(digests)].all(axis=1)

    def add(self, digests: np.ndarray) -> None:
        self.bits[self.places(digests)] = True


def digests(keys: pa.Array) -> np.ndarray:
    """(distinct keys, 2) digests of a string array."""
    buf, offs = raw(keys)
    data = buf.tobytes()
    out = [xxhash.xxh3_128_intdigest(data[a:b]) for a, b in zip(offs[:-1], offs[1:])]
    return np.array([(x >> 64, x & (2**64 - 1)) for x in out], np.uint64).reshape(-1, 2)


def accepted(levels: list[Level], d: np.ndarray) -> np.ndarray:
    """Number of leading levels that accept each key."""
    n, alive = np.zeros(len(d), np.int64), np.arange(len(d))
    for level in levels:
        alive = alive[level.has(d[alive])] if len(alive) else alive
        n[alive] += 1
    return n


class Cascade:
    """Exact membership of `listed` among the universe's keys."""

    def __init__(self, listed: list[str], universe: DataFrame, column: str):
        """universe: one string column of keys, repeats allowed."""
        own = digests(pa.array(sorted(set(listed)), pa.string()))
        n_keys = universe.count()
        rate = min(0.5, max(1e-12, len(own) * 0.5 ** 0.5 / max(n_keys, 1)))
        self.levels = [Level(0, len(own), rate)]
        self.levels[0].add(own)
        listed_left, known = own, self.levels
        own_digests = {tuple(x) for x in own.tolist()}
        while len(self.levels) < MAX_LEVELS and len(own):
            wrong = self._count_wrong(universe, column, own_digests)
            if not wrong:
                break
            level = Level(len(self.levels), wrong, 0.5)
            level.bits = self._bits(universe, column, own_digests, level)
            self.levels.append(level)
            listed_left = listed_left[level.has(listed_left)]
            if not len(listed_left):
                break
            level = Level(len(self.levels), len(listed_left), 0.5)
            level.add(listed_left)
            self.levels.append(level)
        else:
            if len(own) and self._count_wrong(universe, column, own_digests):
                raise RuntimeError("the cascade did not close")

    def _wrong(self, keys: pa.Array, own: set) -> np.ndarray:
        """Digests of unlisted keys that every level so far accepts (an odd number of levels)."""
        d = digests(keys.unique())
        d = d[accepted(self.levels, d) == len(self.levels)]
        return np.array([x for x in d.tolist() if tuple(x) not in own], np.uint64).reshape(-1, 2)

    def _count_wrong(self, universe: DataFrame, column: str, own: set) -> int:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = self._wrong(batch.column(0), own)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].view(np.int64)), pa.array(d[:, 1].view(np.int64))], ["a", "b"])
        return universe.select(column).mapInArrow(count, "a long, b long").distinct().count()

    def _bits(self, universe: DataFrame, column: str, own: set, level: Level) -> np.ndarray:
        """The level's bits over all wrong keys: distinct bit numbers, of which there are at most level.m."""
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(level.places(self._wrong(batch.column(0), own)))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["at"])
        bits = np.zeros(level.m, bool)
        for row in universe.select(column).mapInArrow(places, "at long").distinct().toLocalIterator():
            bits[row["at"]] = True
        return bits

    def contains(self, keys: Column) -> Column:
        """Boolean array column: which keys of an array column are listed."""
        levels = self.levels

        @F.pandas_udf("array<boolean>")
        def member(keys):
            arr = pa.array(keys, pa.list_(pa.string()))
            flat = arr.flatten().dictionary_encode()
            hit = accepted(levels, digests(flat.dictionary.cast(pa.string()))) % 2 == 1
            flags = hit[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, bool)
            ends = np.cumsum([len(k) for k in keys])
            import pandas as pd
            return pd.Series([x.tolist() for x in np.split(flags, ends[:-1])] if len(keys) else [], dtype=object)

        return member(keys)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without `://`."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    none = F.coalesce(at == 0, F.lit(True))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(none, "").otherwise(lower), F.when(none, "").otherwise(path)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Distinct "suffix of the host + prefix of the path" strings, at the given path lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]),
                        lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow",
               url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; the longest fitting rule wins, without one the default. A column of
    pages that has one of these four names gives way to the result."""
    host, path = host_path(F.col(url_col).cast("string"))
    lengths = sorted({len(p) for _, p, _ in rules})
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = written(rows.select(F.explode("__keys").alias("key")).distinct(), "url-keys")  # read once per level
    verdicts = sorted({v for _, _, v in rules})
    # one cascade per verdict: its levels answer "is this key a rule with that verdict"
    rule_of, length_of = F.lit(None).cast("string"), F.lit(-1)
    verdict = F.lit(default)
    names = {}
    for v in verdicts:
        cascade = Cascade([h + p for h, p, x in rules if x == v], universe, "key")
        names[v] = f"__{v}"
        hits = F.filter(F.arrays_zip(F.col("__keys").alias("k"), cascade.contains(F.col("__keys")).alias("in")), lambda x: x["in"])
        longest = F.aggregate(hits, F.lit(""), lambda best, x: F.when(F.length(x["k"]) > F.length(best), x["k"]).otherwise(best))
        rows = rows.withColumn(names[v], longest)
    for v in verdicts:
        best = F.col(names[v])
        wins = (F.length(best) > length_of) & (best != "")
        rule_of, verdict = F.when(wins, best).otherwise(rule_of), F.when(wins, v).otherwise(verdict)
        length_of = F.greatest(length_of, F.length(best))
    out = rows.withColumns({"rule": rule_of, "verdict": verdict})
    return out.drop("__keys", *names.values())
