"""Substring dedup with prefix-partitioned suffix trees.

A window is `window` consecutive words of one row; it is a repeat when the
same words also start in a row with a smaller id. The suffixes of all texts
are split into groups by a prefix, a subtree is grown top-down in each group,
and its internal nodes at word depth `window` are the repeats.

* Sparse suffixes. A suffix is anchored at the smallest of the 4-word prefixes
  that its window holds, so equal windows always meet under the same prefix,
  and consecutive windows with one anchor travel as a single run of words.
* Variable-length prefixes. A pass over all texts counts every window under its
  4-word prefix, in CELLS counters by the prefix's hash; the prefixes of a cell
  that could overfill a group are extended to the whole window. A counter is never
  below the windows of one of its prefixes, so no prefix that needs it is missed,
  and the table of heavy cells has one size for any corpus.
* Pre-aggregation. Within a slice of rows only the first of equal windows in
  the smallest row travels; windows of larger rows are already known to be
  repeats, and other places in rows of the smallest id travel as positions that
  share the first one's verdict. A passage that a third of all rows hold
  reaches its group once per slice.
* A subtree refines classes of suffixes word by word on exact words and drops
  leaves (classes within one row) at every step.

Rows with a null id have no order: they keep all words and match nothing.
Null or empty texts have no words. Rows that share an id never remove each
other's words (a 24-bit digest of the text tells them apart). A text shorter than the window is kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.words import POS_BASE, U64, cut, find_words, grams, mix, slices, word_hashes

PREFIX = 4          # words of a short prefix
GROUP_WINDOWS = 2_000_000  # suffixes that a group should hold at most
SLICE_BYTES = 2 << 20
CELLS = 1 << 18     # counters of prefixes
I64_MIN = np.iinfo(np.int64).min


class Anchored:
    """The windows of a slice with their anchors."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.words = find_words(batch.column("text"))
        self.hashes = word_hashes(self.words)
        counts = self.words.counts()
        valid = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        n_windows = np.where(valid, np.maximum(counts - window + 1, 0), 0)
        rows = np.repeat(np.arange(len(counts)), n_windows)
        first = np.cumsum(n_windows) - n_windows
        #: word index of each window's first word, and its row
        self.at = np.arange(len(rows)) - np.repeat(first - self.words.rows[:-1], n_windows)
        self.row = rows
        g = grams(self.hashes, PREFIX)
        self.gram = g
        if len(self.at):
            best, arg = g[self.at], np.zeros(len(self.at), np.int64)
            for j in range(1, window - PREFIX + 1):
                other = g[self.at + j]
                less = other < best
                best = np.where(less, other, best)
                arg[less] = j
            self.anchor, self.prefix = self.at + arg, best
        else:
            self.anchor, self.prefix = self.at, np.empty(0, U64)

    def runs(self, keep: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first window, number of windows) of maximal runs of kept windows with one anchor;
        windows in `single` stand alone."""
        kept = np.flatnonzero(keep)
        if not len(kept):
            return kept, kept
        new = np.ones(len(kept), bool)
        a, b = kept[1:], kept[:-1]
        new[1:] = (a != b + 1) | (self.anchor[a] != self.anchor[b]) | (self.row[a] != self.row[b]) | single[a]
        starts = np.flatnonzero(new)
        return kept[starts], np.diff(np.append(starts, len(kept)))


def _count_prefixes(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)  # of the task
        for batch in slices(batches, "text", SLICE_BYTES):
            a = Anchored(batch, window)
            total += np.bincount((a.prefix % U64(CELLS)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])
    return count


def _local(a: Anchored, window: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows known to be repeats of a smaller row of the slice, windows that must travel, and the
    other places of travelling windows in rows of the same id with the window that each one follows."""
    h1, h2 = grams(a.hashes, window, 1)[a.at], grams(mix(a.hashes), window, 2, POS_BASE)[a.at]
    own = ids[a.row]
    order = np.lexsort((a.at, own, h1))
    s1, s2, sid = h1[order], h2[order], own[order]
    new = np.ones(len(order), bool)
    new[1:] = s1[1:] != s1[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = s2 == s2[head]  # a second, independent hash; on a clash the window travels
    repeat = np.zeros(len(order), bool)
    travel = np.zeros(len(order), bool)
    repeat[order] = same & (sid > sid[head])
    travel[order] = new | ~same
    other = same & ~new & (sid == sid[head])
    return repeat, travel, order[other], order[head[other]]


def _places(a: Anchored, row_key: np.ndarray, at_row: np.ndarray, first: np.ndarray, other: np.ndarray,
            follows: np.ndarray) -> pa.ListArray:
    """For each run (first windows, ascending): the other places (step in the run, row_key, start, n) of its
    windows; places of one window in a row of words merge to one with n of them."""
    run = np.searchsorted(first, follows, side="right") - 1
    order = np.lexsort((other, follows))
    other, follows, run = other[order], follows[order], run[order]
    new = np.ones(len(other), bool)
    new[1:] = (follows[1:] != follows[:-1]) | (other[1:] != other[:-1] + 1) | (a.row[other[1:]] != a.row[other[:-1]])
    heads = np.flatnonzero(new)
    n = np.diff(np.append(heads, len(other)))
    other, follows, run = other[heads], follows[heads], run[heads]
    cols = [follows - first[run], row_key[a.row[other]], at_row[other], n]
    places = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in cols], ["step", "row_key", "start", "n"])
    offsets = np.append(0, np.cumsum(np.bincount(run, minlength=len(first)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), places)


def _ship(window: int, groups: int, heavy: np.ndarray):
    """Rows (grp >= 0: packed runs for a group; grp < 0: repeats found within the slice)."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            a = Anchored(batch, window)
            if not len(a.at):
                continue
            ids = batch.column("id").fill_null(I64_MIN).to_numpy()
            keys = batch.column("row_key").to_numpy()
            repeat, travel, other, follows = _local(a, window, ids)
            at_row = a.at - a.words.rows[a.row]
            none = np.zeros(len(a.at), bool)
            long = heavy[(a.prefix % U64(CELLS)).astype(np.int64)]
            out_group, out_data = [], []
            first, n = a.runs(repeat, none)
            if len(first):
                out_group.append(-1)
                out_data.append(_pack([ids[a.row[first]], keys[a.row[first]], at_row[first], n]))
            first, n = a.runs(travel, long)
            if len(first):
                places = _places(a, keys, at_row, first, other, follows)
                route = a.prefix[first]
                if long.any():
                    full = grams(a.hashes, window, 1)[a.at[first]]
                    route = np.where(long[first], full, route)
                group = (route % U64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                first, n, group, route = first[order], n[order], group[order], route[order]
                places = places.take(pa.array(order))
                text = cut(a.words.buf, a.words.starts[a.at[first]], a.words.ends[a.at[first] + n + window - 2])
                tag = (route >> U64(32)).astype(np.uint32)
                edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
                cols = [ids[a.row[first]], keys[a.row[first]], at_row[first], n]
                for lo, hi in zip(edges[:-1], edges[1:]):
                    out_group.append(int(group[lo]))
                    out_data.append(_pack([c[lo:hi] for c in cols], tag[lo:hi], text.slice(lo, hi - lo),
                                          places.slice(lo, hi - lo)))
            if out_group:
                yield pa.RecordBatch.from_arrays([pa.array(out_group, pa.int64()), pa.array(out_data, pa.binary())],
                                                 ["grp", "data"])
    return ship


def _pack(cols: list[np.ndarray], tag: np.ndarray | None = None, text: pa.Array | None = None,
          places: pa.ListArray | None = None) -> bytes:
    arrays = [pa.array(cols[0].astype(np.int64))] + [pa.array(c.astype(np.int32)) for c in cols[1:]]
    names = ["id", "row_key", "start", "n"]
    if tag is not None:
        arrays, names = [*arrays, pa.array(tag), text, places], [*names, "tag", "text", "places"]
    batch = pa.RecordBatch.from_arrays(arrays, names)
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5), use_threads=False)
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for chunk in data.chunks for x in chunk)


SPANS = pa.schema([("id", pa.int64()), ("row_key", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])


def _within(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For dense group numbers: smallest and largest id of each group."""
    size = int(groups.max()) + 1
    low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, I64_MIN)
    np.minimum.at(low, groups, ids)
    np.maximum.at(high, groups, ids)
    return low, high


def repeats_of_group(runs: pa.Table, window: int) -> pa.Table:
    """Grow the subtree of one prefix group; its nodes at depth `window` give the repeated windows."""
    ids = runs["id"].to_numpy()
    _, cls = np.unique(runs["tag"].to_numpy(), return_inverse=True)
    low, high = _within(cls, ids)
    runs = runs.take(np.flatnonzero((low < high)[cls]))
    if not runs.num_rows:
        return SPANS.empty_table()
    ids, n, start = (runs[c].to_numpy() for c in ("id", "n", "start"))
    text = runs["text"].combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks)
    w = find_words(text.cast(pa.large_string()))
    code = cut(w.buf, w.starts, w.ends).dictionary_encode()
    words, vocabulary = code.indices.to_numpy().astype(np.int64), len(code.dictionary)
    first = np.cumsum(n) - n
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - first[run]
    at, alive, cls = w.rows[run] + step, np.arange(len(run)), np.zeros(len(run), np.int64)
    low = high = None
    for depth in range(window):
        key = cls * vocabulary + words[at[alive] + depth]
        _, cls = np.unique(key, return_inverse=True)
        low, high = _within(cls, ids[run[alive]])
        inner = (low < high)[cls]
        alive, cls = alive[inner], cls[inner]
        if not len(alive):
            return SPANS.empty_table()
    found = np.sort(alive[ids[run[alive]] > low[cls]])
    if not len(found):
        return SPANS.empty_table()
    repeated = np.zeros(len(run), bool)
    repeated[found] = True
    lists = runs["places"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    of, places = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy()), lists.flatten()
    hit = np.flatnonzero(repeated[first[of] + places.field("step").to_numpy()])
    others = places.take(pa.array(hit))
    others = pa.table([pa.array(ids[of[hit]]), *(others.field(c) for c in SPANS.names[1:])], SPANS)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (run[found[1:]] != run[found[:-1]])
    heads = np.flatnonzero(new)
    lead = found[heads]
    own = pa.table({"id": pa.array(ids[run[lead]]), "row_key": runs["row_key"].take(pa.array(run[lead])),
                    "start": pa.array((start[run[lead]] + step[lead]).astype(np.int32)),
                    "n": pa.array(np.diff(np.append(heads, len(found))).astype(np.int32))})
    return pa.concat_tables([own, others])


def repeated_spans(rows: DataFrame, window: int, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Spans (id, row_key, start, n): n consecutive windows from word `start` are repeats."""
    rows = rows.select("id", "row_key", "text").filter("id is not null and text is not null")
    counts = rows.mapInArrow(_count_prefixes(window), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counted = counts.toArrow()  # CELLS rows at most
    total, heavy = int(counted["n"].to_numpy().sum()), np.zeros(CELLS, bool)
    heavy[counted["cell"].to_numpy()[counted["n"].to_numpy() > group_windows // 2]] = True
    groups = max(1, -(-total // group_windows))
    shipped = rows.mapInArrow(_ship(window, groups, heavy), "grp long, data binary")

    def subtree(table):
        runs = _unpack(table["data"])
        if table["grp"][0].as_py() < 0:
            return runs.select(SPANS.names)
        return repeats_of_group(runs, window)

    # repeats found within a slice need no tree; they are spread by content
    part = F.when(F.col("grp") >= 0, F.col("grp")).otherwise(-1 - F.pmod(F.xxhash64("data"), F.lit(groups)))
    return shipped.withColumn("grp", part).groupBy("grp").applyInArrow(
        subtree, "id long, row_key int, start int, n int")


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle that brings them to their spans."""
    zstd = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data = [None if t is None else zstd.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row_key"), pa.array(data, pa.binary())],
                                         ["id", "row_key", "data"])


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in slices(batches, "data"):
            n_words, n_removed, kept_text = [], [], []
            for data, spans in zip(batch.column("data"), batch.column("spans")):
                words = zstd.decompress(data.as_py()).split() if data.is_valid else []
                n_words.append(len(words))
                if spans.is_valid:
                    drop = np.zeros(len(words) + 1, np.int32)
                    pairs = spans.values
                    first = pairs.field("start").to_numpy()
                    np.add.at(drop, first, 1)
                    np.add.at(drop, first + pairs.field("n").to_numpy() + window - 1, -1)
                    keep = np.cumsum(drop[:-1]) == 0
                    words = list(compress(words, keep))
                n_removed.append(n_words[-1] - len(words))
                kept_text.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept_text, pa.string())], ["id", "n_words", "n_removed", "kept_text"])
    return remove


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                             group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text) for every row: words covered by a window that also starts
    in a row with a smaller id are removed; kept words are joined by one space."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row_key", F.pmod(F.xxhash64("text"), F.lit(1 << 24)).cast("int"))
    spans = repeated_spans(rows, window, group_windows).groupBy("id", "row_key").agg(
        F.collect_list(F.struct("start", "n")).alias("spans"))
    texts = rows.mapInArrow(_squeeze, "id long, row_key int, data binary")
    joined = texts.join(spans, ["id", "row_key"], "left").select("id", "data", "spans")
    out = joined.mapInArrow(_remove(window), "id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)
