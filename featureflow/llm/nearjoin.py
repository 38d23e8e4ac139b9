"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of 5-word shingles; two texts are linked when the Jaccard
similarity of their sets reaches the threshold (0.8).

1. Sketch. Every text gets 96 MinHash values (16 bits each) and a 128-bit key
   of its word sequence. Copies collapse to one node per key: a 64-bit number,
   which texts of different keys never share.
2. Candidates. Nodes that agree on 4 consecutive values (one of 24 bands) meet
   in a bucket. Large buckets are cut into blocks and each pair of blocks is a
   task of its own; a pair is looked at in its first common band only.
3. Pruning. Matches are counted in steps of 16 values; a pair is dropped as
   soon as the posterior probability (uniform prior) that its similarity
   reaches the threshold falls below `tolerance`. The others join their nodes'
   candidate groups; only a spanning forest leaves the task, so no task emits
   all pairs of a group.
4. Verification. Each candidate group is laid out in blocks again; its pairs that
   the posterior does not drop are verified on the shingle sets (64-bit hashes of
   the shingles), with their links counted. A dropped pair is never verified and
   is no link. Classes are the connected components of verified links.

Texts of fewer than 5 words are one shingle of all their words; texts without
words (null, empty) and rows with a null id are linked to nothing and are their
own class. Copies (equal word sequences) are always linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.exactdedup import one_of_equal
from featureflow.llm.words import U64, NON_SPACE, find_words, grams, mix, ranges, slices, word_hashes
from featureflow.session import scratch_path

SHINGLE = 5
BANDS, WIDTH = 24, 4
HASHES = BANDS * WIDTH
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512             # nodes of a block
PART_ROWS = 20_000      # rows of a task's input
PAIRS = 1 << 20         # pairs compared at a time
MULTIPLIERS = np.random.default_rng(96).integers(1, 2**63, HASHES).astype(U64) * U64(2) + U64(1)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets by row, two 64-bit keys of each row's word sequence)."""
    w = find_words(text, NON_SPACE)
    h, counts = word_hashes(w), w.counts()
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    offsets = np.append(0, np.cumsum(n))
    out = np.empty(offsets[-1], U64)
    full = counts >= SHINGLE
    g = grams(h, SHINGLE)
    at = ranges(w.rows[:-1][full], n[full])
    out[ranges(offsets[:-1][full], n[full])] = g[at]
    for r in np.flatnonzero((counts > 0) & ~full):
        out[offsets[r]] = mix(np.array([len(h[w.rows[r]:w.rows[r + 1]])], U64) + grams(h[w.rows[r]:w.rows[r + 1]], int(counts[r])))[0]
    keys = np.zeros((2, len(counts)), U64)
    some = counts > 0
    if some.any():
        place = (np.arange(len(h)) - np.repeat(w.rows[:-1], counts)).astype(U64)
        for i, salt in enumerate((U64(0x632BE59BD9B4E019), U64(0xE220A8397B1DCDAF))):
            keys[i, some] = np.add.reduceat(mix((h + salt) ^ mix(place * salt + salt)), w.rows[:-1][some])
    return out, offsets, mix(keys[0] + counts.astype(U64)), mix(keys[1] + counts.astype(U64))


def min_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, HASHES) 16-bit MinHash values; zeros for rows without shingles."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint16)
    some = np.diff(offsets) > 0
    if some.any():
        for i, a in enumerate(MULTIPLIERS):
            out[some, i] = mix(np.minimum.reduceat(values * a, offsets[:-1][some])) & U64(0xFFFF)
    return out


def fixed(rows: np.ndarray) -> pa.Array:
    """Binary array of the rows of a contiguous 2-d array."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def signatures(column: pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    offs = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset:arr.offset + len(arr) + 1]
    return np.frombuffer(arr.buffers()[2], np.uint8)[offs[0]:offs[-1]].view(np.uint16).reshape(-1, HASHES)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, offsets, k1, k2 = shingles(batch.column("text"))
        valid = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        some = (np.diff(offsets) > 0) & valid
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(k1.view(np.int64), mask=~some), pa.array(k2.view(np.int64), mask=~some),
             fixed(min_hashes(values, offsets)), pa.array(k1.view(np.int64), mask=~some)], ["id", "node", "key2", "sig", "k1"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = signatures(batch.column("sig")).reshape(-1, BANDS, WIDTH).astype(U64)
        key = np.zeros(sig.shape[:2], U64)
        for j in range(WIDTH):
            key = (key << U64(16)) | sig[:, :, j]
        key = mix(key + mix(np.arange(1, BANDS + 1).astype(U64))[None, :] * U64(3))
        n = len(sig)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)),
             batch.column("node").take(pa.array(np.repeat(np.arange(n), BANDS)))], ["key", "band", "node"])


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values: the fewest matches m with
    P(similarity >= threshold | m of n match) >= tolerance under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray | None, least: list[int]) -> np.ndarray:
    """Indexes of the pairs that are in their first common band and not pruned."""
    alive = np.arange(len(a))
    if band is not None:
        same = (sig[a] == sig[b]).reshape(len(a), BANDS, WIDTH).all(axis=2)
        alive = alive[same.argmax(axis=1) == band]
    matches = np.zeros(len(alive), np.int64)
    for step, need in enumerate(least):
        cols = slice(step * STEP, (step + 1) * STEP)
        matches += (sig[a[alive], cols] == sig[b[alive], cols]).sum(axis=1)
        go = matches >= need
        alive, matches = alive[go], matches[go]
    return alive


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member number of each member's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            break
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def blocked(members: DataFrame, group: str, size: str, block: int = BLOCK) -> DataFrame:
    """members once for every task (group, low, high) of block pairs that holds them, with their own block `mine`."""
    n = F.ceil(F.col(size) / block).cast("int")
    rows = members.withColumn("__n", n).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("__n")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return rows.withColumns({"low": F.least("mine", "__other"), "high": F.greatest("mine", "__other")}).drop("__n", "__other")


def tasks(rows: DataFrame, group: str, size: str, part_rows: int, block: int = BLOCK) -> DataFrame:
    """Blocked rows with a task name and a part: parts hold about part_rows rows in whole tasks."""
    total = rows.agg(F.sum(F.ceil(F.col(size) / block)).alias("n")).first()["n"] or 0
    out = blocked(rows, group, size, block)
    task = F.xxhash64(group, "low", "high")
    parts = max(1, -(-int(total) // part_rows))
    return out.withColumns({"task": task, "part": F.pmod(task, F.lit(parts))})


def pairs_of_tasks(task: np.ndarray, mine: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of row pairs (i < j) within each task, rows sorted by task; a task of two different
    blocks pairs across them only."""
    n = len(task)
    end = np.searchsorted(task, task, side="right")
    many = end - np.arange(n) - 1
    at = 0
    done = np.cumsum(many)
    while at < n:
        before = done[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(done, before + PAIRS, side="right")))
        i = np.repeat(np.arange(at, to), many[at:to])
        j = ranges(np.arange(at, to) + 1, many[at:to])
        cross = (low[i] == high[i]) | (mine[i] != mine[j])
        yield i[cross], j[cross]
        at = to


def spanning_links(node: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of pairs of rows, as (node, root node)."""
    names, dense = np.unique(node, return_inverse=True)
    if not a:
        return names[:0], names[:0]
    root = forest(len(names), dense[np.concatenate(a)], dense[np.concatenate(b)])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b), by min-label
    propagation with pointer jumping; every round is a written table."""
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both.write.parquet(f"{path}/edges")
    both = spark.read.parquet(f"{path}/edges")
    both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")).write.parquet(f"{path}/round0")
    i = 0
    while True:
        labels = spark.read.parquet(f"{path}/round{i}")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        best = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = best.alias("x").join(labels.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        i += 1
        jump.select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old").write.parquet(f"{path}/round{i}")
        done = spark.read.parquet(f"{path}/round{i}")
        if done.filter("root <> old").isEmpty():
            return done.select("node", "root")


def separate(sketch: DataFrame, path: str) -> DataFrame:
    """sketch with a number of its own for every (node, key2): where different texts share a node number, it is drawn
    again from both keys."""
    spark = sketch.sparkSession
    shared = sketch.filter("node is not null").groupBy("node").agg(F.min("key2").alias("low"), F.max("key2").alias("high"))
    shared.filter("low <> high").select("node", F.lit(True).alias("shared")).write.parquet(f"{path}/shared")
    shared = spark.read.parquet(f"{path}/shared")
    if shared.isEmpty():
        return sketch
    again = F.when(F.col("shared"), F.xxhash64("node", "key2")).otherwise(F.col("node"))
    return sketch.join(shared, "node", "left").select("id", again.alias("node"), "key2", "sig", "k1")


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                     tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(id_col, class_id, n_links) for every row: the smallest id of its class, and the number of other rows
    whose shingle sets reach the threshold with its own."""
    spark = docs.sparkSession
    path = scratch_path(spark, "near-join")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(_sketch, "id long, node long, key2 long, sig binary, k1 long").write.parquet(f"{path}/sketch")
    sketch = separate(spark.read.parquet(f"{path}/sketch"), path)
    sketch.filter("node is not null").groupBy("node", "key2", "k1").agg(
        F.min("id").alias("id"), F.count("*").alias("copies")).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    # one sketch a node: the first row's; ids may repeat, and a node is one key pair
    reps = sketch.join(nodes.select("id", "node", "key2"), ["id", "node", "key2"], "left_semi").select(
        "node", "sig").dropDuplicates(["node"])
    reps.write.parquet(f"{path}/reps")
    reps = spark.read.parquet(f"{path}/reps")

    bands = reps.mapInArrow(_bands, "key long, band int, node long")
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    bands.join(shared, "key").write.parquet(f"{path}/buckets")
    members = spark.read.parquet(f"{path}/buckets").join(reps, "node")
    least = least_matches(threshold, tolerance)

    def candidates(table):
        table = table.sort_by([("task", "ascending")])
        task, mine, low, high, node = (table[c].to_numpy() for c in ("task", "mine", "low", "high", "node"))
        band, sig = table["band"].to_numpy(), signatures(table["sig"])
        a, b = [], []
        for i, j in pairs_of_tasks(task, mine, low, high):
            keep = surviving(sig, i, j, band[i], least)
            a.append(i[keep])
            b.append(j[keep])
        x, y = spanning_links(node, a, b)
        return pa.table({"a": x, "b": y})

    edges = tasks(members, "key", "size", PART_ROWS, block).groupBy("part").applyInArrow(candidates, "a long, b long")
    groups = components(edges, f"{path}/candidates")
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    grouped = groups.join(sizes, "root").join(nodes, "node").join(reps, "node").select(
        "node", "k1", "key2", "id", "copies", "root", "size", "sig")

    def exact_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, offsets, k1, k2 = shingles(batch.column("text"))
            own = np.flatnonzero((k1.view(np.int64) == batch.column("k1").to_numpy())
                                 & (k2.view(np.int64) == batch.column("key2").to_numpy()))
            sets = [np.unique(values[offsets[r]:offsets[r + 1]]).tobytes() for r in own]
            kept = batch.select(["node", "root", "size", "copies", "sig"]).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())],
                                             ["node", "root", "size", "copies", "sig", "set"])

    texts = rows.join(grouped, "id").mapInArrow(
        exact_sets, "node long, root long, size long, copies long, sig binary, `set` binary").dropDuplicates(["node"])
    texts.write.parquet(f"{path}/sets")
    texts = spark.read.parquet(f"{path}/sets")

    def verified(table):
        table = table.sort_by([("task", "ascending")])
        task, mine, low, high, node, copies = (table[c].to_numpy() for c in ("task", "mine", "low", "high", "node", "copies"))
        sets, sig = [np.frombuffer(x.as_buffer(), U64) for x in table["set"]], signatures(table["sig"])
        edges = np.append(np.flatnonzero(np.diff(task, prepend=task[0] - 1 if len(task) else 0)), len(task))
        a, b, links = [], [], np.zeros(len(task), np.int64)
        for s, e in zip(edges[:-1], edges[1:]):
            i, j = np.triu_indices(e - s, 1)
            cross = (low[s] == high[s]) | (mine[s + i] != mine[s + j])
            i, j = i[cross], j[cross]
            kept = surviving(sig[s:e], i, j, None, least)
            i, j = linked_pairs(sets[s:e], i[kept], j[kept], threshold)
            i, j = s + i, s + j
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            a.append(i)
            b.append(j)
        x, y = spanning_links(node, a, b)
        some = links > 0
        return pa.table({"a": np.append(x, node[some]), "b": np.append(y, node[some]),
                         "links": np.append(np.zeros(len(x), np.int64), links[some])})

    tasks(texts, "root", "size", PART_ROWS // 8, block).groupBy("part").applyInArrow(
        verified, "a long, b long, links long").write.parquet(f"{path}/links")
    found = spark.read.parquet(f"{path}/links")
    classes = components(found.filter("a <> b"), f"{path}/classes")
    first = classes.join(nodes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("class_id"))
    links = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    about = nodes.join(classes.join(first, "root").select("node", "class_id"), "node", "left").join(links, "node", "left").select(
        "node", "key2", F.coalesce("class_id", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    all_rows = sketch.select("id", "key2", "node")
    linked = all_rows.filter("node is not null").join(about, ["node", "key2"], "left").select("id", "class_id", "n_links")
    alone = all_rows.filter("node is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)


def linked_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of sets with Jaccard similarity >= threshold, from blockwise exact intersection counts."""
    if not len(i):
        return i, j
    used, at = np.unique(np.append(i, j), return_inverse=True)  # sets of dropped pairs only are not looked at
    n, a, b = len(used), at[:len(i)], at[len(i):]
    sets = [sets[k] for k in used.tolist()]
    lens = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), lens)
    shared = count[code] > 1  # a value of one set alone is in no intersection
    values, owner = code[shared], owner[shared]
    _, values = np.unique(values, return_inverse=True)
    both = np.zeros((n, n), np.float64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    width = max(256, (1 << 22) // n)
    for start in range(0, int(values[-1]) + 1 if len(values) else 0, width):
        lo, hi = np.searchsorted(values, [start, start + width])
        present = np.zeros((n, min(width, int(values[-1]) + 1 - start)), np.float32)
        present[owner[lo:hi], values[lo:hi] - start] = 1
        both += present @ present.T
    common = np.rint(both[a, b])
    linked = common >= threshold * (lens[a] + lens[b] - common) - 1e-9
    return i[linked], j[linked]


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their class, with all their columns; rows with a null id stay.
    Of rows with equal id and text (null ids are equal, a null text is empty) one stays."""
    classes = similarity_links(docs, id_col, text_col)
    others = classes.filter(F.col(id_col) != F.col("class_id")).select(id_col).distinct()
    kept = docs.join(others, id_col, "left_anti").withColumn(
        "__text", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    return one_of_equal(kept, docs, id_col, "__text")
