"""SimHash near-duplicates with BK-trees.

1. Fingerprints. A text's 3-word shingles (A-Z lower-cased, repeats count) are
   hashed with XXH64 (seed 42); a bit of the fingerprint is 1 if it is set in
   over half of the hashes. Equal fingerprints become one node.
2. Shards. Two fingerprints with at most `radius` (2) differing bits agree on
   one of radius + 1 parts of the bits, so a node joins one shard for each
   part. A shard of more than `capacity` nodes is cut again by the parts of
   its free bits, and so on; after LEVELS cuts at most 2^13 fingerprints can
   share a shard, so no shard is unbounded and nothing is dropped.
3. Trees. The task that owns a shard builds its BK-tree: a node's children are
   keyed by their Hamming distance to it. Each of the shard's fingerprints
   descends the tree, from a node at distance d only along the edges d - radius
   to d + radius. A task emits a spanning forest of its links, never all pairs.
4. Components of the forests' edges, by rounds of written tables.

A text of one or two words is one shingle; a text without words (null, empty)
has fingerprint zero and is linked like any other. Rows with equal or null ids
get a result each; the component's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from featureflow.llm.nearjoin import components, spanning_links
from featureflow.llm.words import NON_SPACE, U64, find_words, ranges, slices
from featureflow.session import scratch_path

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
CAPACITY = 2048         # fingerprints of a shard
LEVELS = 4              # cuts of a shard: 64 bits, 43, 29, 20, 14 free
PART_ROWS = 10_000      # rows of a task's shards
SLICE_BYTES = 2 << 20
AT_ONCE = 1 << 16       # shingles hashed, and (fingerprint, tree node) visits, at a time
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def fingerprints(text: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    w = find_words(text, NON_SPACE, FOLD)
    counts = w.counts()
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))  # shingles of each row
    first = np.cumsum(many) - many
    start = ranges(w.rows[:-1], many)
    length = np.repeat(np.minimum(counts, size), many)
    ones = np.zeros((len(counts), BITS), np.int64)
    for at in range(0, len(start), AT_ONCE):
        s, k = start[at:at + AT_ONCE], length[at:at + AT_ONCE]
        lo, hi = int(s[0]), int(s[-1] + k[-1])
        lens = w.ends[lo:hi] - w.starts[lo:hi]
        place = np.cumsum(lens + 1) - (lens + 1)  # words joined by one space
        joined = np.full(int((lens + 1).sum()), 0x20, np.uint8)
        joined[ranges(place, lens)] = w.buf[ranges(w.starts[lo:hi], lens)]
        view = memoryview(joined.tobytes())
        begin, end = place[s - lo], (place + lens)[s - lo + k - 1]
        hashes = np.array([xxh64_intdigest(view[b:e], SEED) for b, e in zip(begin.tolist(), end.tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = np.searchsorted(first, np.arange(at, at + len(s)), side="right") - 1
        edges = np.flatnonzero(np.diff(rows, prepend=-1))
        ones[rows[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    set_bits = (2 * ones > many[:, None]).astype(U64)
    return (set_bits << np.arange(BITS, dtype=U64)).sum(axis=1, dtype=U64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(batch.column("text")).view(np.int64))],
                                         ["id", "node"])


class Trees:
    """BK-trees of groups of distinct fingerprints: roots, and edges sorted by (node, distance)."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.prints = prints
        _, first, self.tree = np.unique(group, return_index=True, return_inverse=True)
        self.root = first
        waiting = np.ones(len(prints), bool)
        waiting[first] = False
        waiting = np.flatnonzero(waiting)
        at, keys, children = first[self.tree[waiting]], [], []
        while len(waiting):
            key = at * (BITS + 1) + np.bitwise_count(prints[waiting] ^ prints[at])
            key, first, own = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[first]  # the first to come along an edge becomes its node
            keys.append(key)
            children.append(child)
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            waiting, at = waiting[rest], child[own[rest]]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.children = np.concatenate(children)[order] if keys else self.keys

    def near(self, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius: every fingerprint descends its own tree."""
        everyone = np.arange(len(self.prints))
        todo = [(everyone[i:i + AT_ONCE], self.root[self.tree[i:i + AT_ONCE]]) for i in range(0, len(everyone), AT_ONCE)]
        while todo:
            asks, node = todo.pop()
            far = np.bitwise_count(self.prints[asks] ^ self.prints[node]).astype(np.int64)
            hit = (far <= radius) & (asks < node)
            yield asks[hit], node[hit]
            lo = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(far - radius, 0))
            hi = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(far + radius, BITS), side="right")
            asks, node = np.repeat(asks, hi - lo), self.children[ranges(lo, hi - lo)]
            todo += [(asks[i:i + AT_ONCE], node[i:i + AT_ONCE]) for i in range(0, len(asks), AT_ONCE)]


def masks(radius: int = RADIUS, levels: int = LEVELS) -> list[list[int]]:
    """By level, the fixed bits of each kind of shard; kind k is cut into the kinds (radius + 1) * k, ... of the next level."""
    out, fixed = [], [0]
    for _ in range(levels):
        fixed = [m | sum(1 << int(b) for b in part) for m in fixed
                 for part in np.array_split([b for b in range(BITS) if not m >> b & 1], radius + 1)]
        out.append(fixed)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(radius: int):
    def links(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        found = list(Trees(node.view(U64), table["shard"].to_numpy()).near(radius))
        a, b = spanning_links(node, [x for x, _ in found], [y for _, y in found])
        return pa.table({"a": a, "b": b})
    return links


def shard_links(nodes: DataFrame, path: str, radius: int = RADIUS, capacity: int = CAPACITY) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `node` within the radius."""
    spark = nodes.sparkSession
    rows, edges = nodes.select("node", F.lit(0).alias("kind")), None
    for level, fixed in enumerate(masks(radius)):
        parts = radius + 1
        kinds = F.explode(F.sequence(F.col("kind") * parts, F.col("kind") * parts + (parts - 1)))
        mask = F.element_at(F.array(*[F.lit(_signed(m)) for m in fixed]), F.col("kind") + 1)
        rows = rows.select("node", kinds.alias("kind"))
        rows = rows.withColumn("key", F.col("node").bitwiseAND(mask)).withColumn("shard", F.xxhash64("kind", "key"))
        sizes = rows.groupBy("kind", "key").agg(F.count("*").alias("size")).filter("size > 1")
        rows.join(sizes, ["kind", "key"]).write.parquet(f"{path}/shards{level}")
        shards = spark.read.parquet(f"{path}/shards{level}")
        last = level == LEVELS - 1
        fits = shards if last else shards.filter(F.col("size") <= capacity)
        parts = max(1, -(-fits.count() // PART_ROWS))
        own = fits.select("node", "shard", F.pmod("shard", F.lit(parts)).alias("part"))
        own.groupBy("part").applyInArrow(_forest(radius), "a long, b long").write.parquet(f"{path}/edges{level}")
        found = spark.read.parquet(f"{path}/edges{level}")
        edges = found if edges is None else edges.unionByName(found)
        rows = shards.filter(F.col("size") > capacity).select("node", "kind")
        if last or rows.isEmpty():
            return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    capacity: int = CAPACITY) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id) for every row of docs."""
    spark = docs.sparkSession
    path = scratch_path(spark, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(_sketch, "id long, node long").write.parquet(f"{path}/prints")
    prints = spark.read.parquet(f"{path}/prints")
    prints.groupBy("node").agg(F.min("id").alias("first")).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    linked = components(shard_links(nodes, path, radius, capacity), f"{path}/components")
    least = linked.join(nodes, "node").groupBy("root").agg(F.min("first").alias("least"))
    component = nodes.join(linked, "node", "left").join(least, "root", "left").select(
        "node", F.coalesce("least", "first").alias("component_id"))
    return prints.join(component, "node").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
