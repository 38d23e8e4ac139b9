"""Random forests grown by Spark aggregates, for the grid search.

MLlib draws its bootstrap inside the fit, so the rows of a node's bag cannot be
counted apart from their draws, and its ``rawCount`` counts draws. Here a row's
weight in a tree is a Poisson(1) draw from a hash of the row's key and the
tree's number: a rerun, a lost executor or another partitioning gives the same
bags, and ``n``, the distinct rows of a node's bag, is counted as such. Both
sample limits of the search apply to it.

Rows of the same bins, label and fold take the same way through every tree, so
they are put together first: a unit holds their draws and their drawn rows by
tree. The rows are read and drawn once; there are at most as many units as places
in the grid of the bins, however many rows there are.

All trees of all folds and leaf limits grow together, a level at a time, and share
a node as long as their splits above it are the same: every task routes its units
through the broadcast nodes and counts (node, left-out fold, feature, bin) cells,
Spark sums the cells, running sums over a feature's bins give every split's
impurity, and the best splits of each node come to the driver (a row per open node,
fold and leaf limit: model metadata). Growth below a node depends neither on a depth
limit nor on a split limit, nor on later trees, so one forest of the largest size
without these limits holds all candidates of its leaf limit: a candidate uses the
first trees, cut at its depth and at nodes of too few rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from featureflow.session import written

MAX_BINS = 32
MAX_DEPTH = 30
AT_ONCE = 1 << 20       # (row, tree) places routed at a time
CDF = np.cumsum([exp(-1) / factorial(k) for k in range(12)])  # of Poisson(1)
UNIT_FROM = 4           # fewer rows are not put together: their keys take less room than their draws
UNIT_ROWS = 1 << 24     # rows of a unit at most (draws are 32-bit numbers)
AT_ONCE_CELLS = 1 << 22  # numbers of a table of cells in a task
U64 = np.uint64
# draws by the first 12 bits of a hash, where these decide them
DRAWS, _LAST = (np.searchsorted(CDF, x / float(1 << 53), side="right") for x in
                (np.arange(1 << 12) << 41, (np.arange(1, (1 << 12) + 1) << 41) - 1))
CLEAR = DRAWS == _LAST


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(29))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def bag(keys: np.ndarray, n_trees: int, seed: int, first: int = 0) -> np.ndarray:
    """How often each row is drawn for each tree from the first to n_trees - 1, (rows, trees)."""
    trees = _mix(np.arange(first + 1, n_trees + 1).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    h = _mix(keys.view(U64)[:, None] ^ trees[None, :])
    start = (h >> U64(52)).astype(np.int64)
    drawn = DRAWS[start]
    unclear = np.nonzero(~CLEAR[start])
    drawn[unclear] = np.searchsorted(CDF, (h[unclear] >> U64(11)) / float(1 << 53), side="right")
    return drawn


def feature_subset(tree: np.ndarray, path: np.ndarray, n_features: int, size: int, seed: int) -> np.ndarray:
    """The features a node may split on, drawn by a hash of its tree and its place in it, (nodes, size)."""
    h = _mix(_mix(tree.astype(U64) + U64(seed)) + path.astype(U64))
    order = _mix(h[:, None] + np.arange(1, n_features + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :size], axis=1)


@dataclass
class Nodes:
    """Growing trees of all groups; a group is one (leaf limit, fold left out). Nodes are shared by all groups whose
    splits above are the same. Where these differ on a node's split it gets a twin for each further split: the twins
    are a chain from the node that the parent knows, and each has its own groups. A leaf's children are itself."""
    n_trees: int
    n_classes: int
    leaf_limit: np.ndarray      # by group
    left_out: np.ndarray        # by group; -1: no fold is left out
    n_features: int
    size: int                   # features a node may split on
    seed: int

    def __post_init__(self) -> None:
        k, self.folds = self.n_trees, np.unique(self.left_out)
        self.limits, self.limit_at = np.unique(self.leaf_limit, return_inverse=True)
        self.fold_at = np.searchsorted(self.folds, self.left_out)
        self.tree, self.path, self.depth = np.arange(k), np.ones(k, np.int64), np.zeros(k, np.int64)
        self.feature, self.bin = np.zeros(k, np.int64), np.zeros(k, np.int64)
        self.left, self.right, self.twin = np.arange(k), np.arange(k), np.full(k, -1)
        self.mine = np.ones((k, len(self.left_out)), bool)                  # groups that have the node
        self.weights = np.zeros((k, len(self.folds), self.n_classes))       # draws by fold left out and class
        self.n = np.zeros((k, len(self.folds)), np.int64)                   # distinct rows by fold left out
        self.open = self.mine.copy()                                        # groups that may split it

    def subset(self, nodes: np.ndarray) -> np.ndarray:
        return feature_subset(self.tree[nodes], self.path[nodes], self.n_features, self.size, self.seed)

    def _add(self, **more: np.ndarray) -> None:
        for name, values in more.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))

    def split(self, found: dict[str, np.ndarray]) -> None:
        """Give each open node its counts and its groups' splits (found by column, as `_found` gives them)."""
        slot, f = found["slot"], found["fold"]
        roots = slot < self.n_trees
        self.weights[slot[roots], f[roots]], self.n[slot[roots], f[roots]] = found["weights"][roots], found["n"][roots]
        # a number for every (node, split); 0 for none
        row_of = np.full((len(self.tree), len(self.folds), len(self.limits)), -1)
        row_of[slot, f, found["leaf_limit"]] = np.arange(len(slot))
        node, group = np.nonzero(self.open)
        self.open[:] = False
        row = row_of[node, self.fold_at[group], self.limit_at[group]]
        has = (row >= 0) & (found["n_left"][row] > 0 if len(slot) else False)
        node, group, row = node[has], group[has], row[has]
        if not len(node):
            return
        same = np.stack([node, found["feature"][row], found["bin"][row]], axis=1)
        kinds, kind = np.unique(same, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        # the groups without a split keep the node; the others get twins of it, unless all have the same split
        alone = np.bincount(kind) == self.mine[kinds[:, 0]].sum(axis=1)
        at, first = kinds[:, 0].copy(), len(self.tree)
        at[~alone] = first + np.arange((~alone).sum())
        of = kinds[~alone, 0]
        self._add(**{c: getattr(self, c)[of] for c in ("tree", "path", "depth", "feature", "bin", "weights", "n", "twin")},
                  left=at[~alone], right=at[~alone], mine=np.zeros((len(of), len(self.left_out)), bool),
                  open=np.zeros((len(of), len(self.left_out)), bool))
        for old, new in zip(of.tolist(), at[~alone].tolist()):  # into the chain behind the node
            self.twin[new], self.twin[old] = self.twin[old], new
        self.mine[node, group] = False
        self.mine[at[kind], group] = True
        self.feature[at], self.bin[at] = kinds[:, 1], kinds[:, 2]
        first = len(self.tree)
        self.left[at], self.right[at] = first + 2 * np.arange(len(at)), first + 2 * np.arange(len(at)) + 1
        lw, ln = np.zeros((len(at), *self.weights.shape[1:])), np.zeros((len(at), len(self.folds)), np.int64)
        lw[kind, self.fold_at[group]], ln[kind, self.fold_at[group]] = found["left"][row], found["n_left"][row]
        pair = lambda a, b: np.stack([a, b], axis=1).reshape(2 * len(at), *a.shape[1:])
        both, here = np.repeat(at, 2), first + np.arange(2 * len(at))
        weights, n, depth = pair(lw, self.weights[at] - lw), pair(ln, self.n[at] - ln), self.depth[both] + 1
        mixed = ((weights > 0).sum(axis=2) > 1)[:, self.fold_at]
        may = self.mine[both] & (n[:, self.fold_at] >= np.maximum(2, 2 * self.leaf_limit)) & mixed & (depth < MAX_DEPTH)[:, None]
        self._add(tree=self.tree[both], path=pair(2 * self.path[at], 2 * self.path[at] + 1), depth=depth,
                  feature=np.zeros(len(both), np.int64), bin=np.zeros(len(both), np.int64), left=here, right=here,
                  twin=np.full(len(both), -1), mine=self.mine[both], weights=weights, n=n, open=may)

    def above_open(self) -> np.ndarray:
        """Nodes that have an open node below them."""
        here = self.open.any(axis=1)
        above = np.zeros(len(here), bool)
        inner = self.left != np.arange(len(here))
        for depth in range(int(self.depth.max()) - 1, -1, -1):
            at = np.flatnonzero(inner & (self.depth == depth))
            for child in (self.left[at], self.right[at]):
                while len(child):
                    above[at] |= above[child] | here[child]
                    more = self.twin[child] >= 0
                    at, child = at[more], self.twin[child[more]]
                at = np.flatnonzero(inner & (self.depth == depth))
        return above

    def reach(self, bins: np.ndarray, row: np.ndarray, node: np.ndarray, above: np.ndarray,
              is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The open nodes that rows (numbers in bins) get to from the roots: row and node of each place."""
        out = []
        while len(row):
            rows, nodes = [row], [node]
            while True:
                node = self.twin[node]
                more = node >= 0
                if not more.any():
                    break
                row, node = row[more], node[more]
                rows.append(row)
                nodes.append(node)
            row, node = (np.concatenate(rows), np.concatenate(nodes)) if len(rows) > 1 else (rows[0], nodes[0])
            there = is_open[node]
            if there.any():
                out.append((row[there], node[there]))
            go = above[node]
            row, node = row[go], node[go]
            node = np.where(bins[row, self.feature[node]] <= self.bin[node], self.left[node], self.right[node])
        return (np.concatenate([r for r, _ in out]), np.concatenate([n for _, n in out])) if out else (row, node)

    def unfolded(self) -> Trees:
        """Each group's trees with nodes of their own."""
        groups = len(self.left_out)
        node, group = np.tile(np.arange(self.n_trees), groups), np.repeat(np.arange(groups), self.n_trees)
        of, groups_of, lefts, rights, first = [], [], [], [], 0
        while len(node):
            while not (mine := self.mine[node, group]).all():
                node = np.where(mine, node, self.twin[node])
            of.append(node)
            groups_of.append(group)
            own = first + np.arange(len(node))
            first += len(node)
            inner = self.left[node] != node
            left, right = own.copy(), own.copy()
            left[inner], right[inner] = first + 2 * np.arange(inner.sum()), first + 2 * np.arange(inner.sum()) + 1
            lefts.append(left)
            rights.append(right)
            node, group = np.stack([self.left[node[inner]], self.right[node[inner]]], axis=1).reshape(-1), np.repeat(group[inner], 2)
        of, group = np.concatenate(of), np.concatenate(groups_of)
        fold = self.fold_at[group]
        return Trees(self.n_trees, self.leaf_limit, self.left_out, self.n_features, self.size, self.seed, self.tree[of], group,
                     self.path[of], self.depth[of], self.feature[of], self.bin[of], np.concatenate(lefts), np.concatenate(rights),
                     self.weights[of, fold], self.n[of, fold], np.zeros(len(of), bool))


@dataclass
class Trees:
    """Nodes of all trees of all groups in one numbering; node i < groups * n_trees is the root of tree i.

    A group is one (leaf limit, fold left out); a leaf's children are itself."""
    n_trees: int
    leaf_limit: np.ndarray      # by group
    left_out: np.ndarray        # by group; -1: no fold is left out
    n_features: int
    size: int                   # features a node may split on
    seed: int
    tree: np.ndarray            # 0 .. n_trees - 1
    group: np.ndarray
    path: np.ndarray            # 1 for a root, 2p and 2p + 1 for the children of p
    depth: np.ndarray
    feature: np.ndarray
    bin: np.ndarray             # bins up to it go left
    left: np.ndarray
    right: np.ndarray
    weights: np.ndarray         # draws by class
    n: np.ndarray               # distinct rows
    open: np.ndarray            # none is left

    def subset(self, nodes: np.ndarray) -> np.ndarray:
        return feature_subset(self.tree[nodes], self.path[nodes], self.n_features, self.size, self.seed)

    def children(self) -> np.ndarray:
        """Which nodes have children."""
        return self.left != np.arange(len(self.left))

    def cut(self, depth: int, split_limit: int) -> np.ndarray:
        """Where a row that gets to each node stops under the limits: the node or one above it."""
        stop, inner, at = (self.depth >= depth) | (self.n < split_limit), self.children(), np.arange(len(self.left))
        for d in range(int(self.depth.max())):
            node = np.flatnonzero(inner & (self.depth == d))
            node = node[stop[node] | (at[node] != node)]
            at[self.left[node]] = at[self.right[node]] = at[node]
        return at

    def descend(self, bins: np.ndarray, row: np.ndarray, at: np.ndarray, go_on: np.ndarray, steps: int) -> np.ndarray:
        """Where rows (numbers in bins) get to from the nodes `at` in so many steps; only nodes marked in go_on are left."""
        at, moving = at.copy(), np.flatnonzero(go_on[at])
        for _ in range(steps):
            if not len(moving):
                break
            node = at[moving]
            node = np.where(bins[row[moving], self.feature[node]] <= self.bin[node], self.left[node], self.right[node])
            at[moving] = node
            moving = moving[go_on[node]]
        return at


def thresholds(data: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Per feature at most max_bins - 1 values to split at: its quantiles."""
    shares = [(i + 1) / max_bins for i in range(max_bins - 1)]
    row = data.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 100_000).alias(f"q{i}")
                     for i, c in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in row]


def binned(data: DataFrame, features: Sequence[str], label_col: str, fold_col: str | None, key_cols: Sequence[str],
           cuts: list[list[float]]) -> DataFrame:
    """(key, label, fold, b0, b1, ...): every feature as the number of its values to split at that are below it."""
    def position(c: str, q: list[float]) -> Column:
        x = F.col(f"`{c}`").cast("double")
        place = F.size(F.filter(F.array(*[F.lit(v) for v in q]), lambda v: v < x)) if q else F.lit(0)
        return F.when(x.isNull(), F.raise_error(F.lit(f"null in feature {c}"))).otherwise(place).cast("int")
    fold = F.coalesce(F.col(fold_col).cast("int"), F.lit(-2)) if fold_col else F.lit(-2)
    return data.select(F.xxhash64(*key_cols).alias("key"), F.col(label_col).cast("int").alias("label"), fold.alias("fold"),
                       *[position(c, q).alias(f"b{i}") for i, (c, q) in enumerate(zip(features, cuts))])


def _columns(batch: pa.RecordBatch, n_features: int):
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    bins = np.stack([get(f"b{i}") for i in range(n_features)], axis=1).astype(np.int64)
    return get("label").astype(np.int64), get("fold"), bins


def task_count(rows: DataFrame) -> int:
    """Tasks that rows are dealt to: all cores, and more for much data, as the session says."""
    conf, sc = rows.sparkSession.conf, rows.sparkSession.sparkContext
    return max(sc.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))


def _place(n_features: int) -> list[str]:
    return [*(f"b{i}" for i in range(n_features)), "label", "fold"]


def _together(n_trees: int, n_features: int, seed: int):
    """Units of rows that come sorted by place: draws and drawn rows by tree, or, of few rows, each row by its key."""
    names = _place(n_features)

    def unit(place: tuple, w: np.ndarray, n: np.ndarray) -> tuple:
        return (*place, None, w.astype(np.int32).tobytes(), n.astype(np.int32).tobytes())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int32()) for c in names), ("key", pa.int64()), ("w", pa.binary()), ("n", pa.binary())])
        last = None     # the unit that the next batch may go on with: its place, draws, drawn rows and rows
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            place = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            start = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)])
            size = np.diff(np.r_[start, len(key)])
            goes_on = last is not None and last[0] == tuple(place[0].tolist()) and last[3] < UNIT_ROWS
            many = size >= UNIT_FROM
            many[0] |= goes_on
            out = []
            if last is not None and not goes_on:
                out.append(unit(*last[:3]))
                last = None
            few = np.flatnonzero(~np.repeat(many, size))
            out += [(*p, k, None, None) for p, k in zip(place[few].tolist(), key[few].tolist())]
            rows = np.flatnonzero(np.repeat(many, size))
            if len(rows):
                drawn = bag(key[rows], n_trees, seed)
                first = np.r_[0, np.cumsum(size[many])[:-1]]
                w, n = np.add.reduceat(drawn, first), np.add.reduceat((drawn > 0).astype(np.int64), first)
                made = [(tuple(p), a, b, c) for p, a, b, c in zip(place[start[many]].tolist(), w, n, size[many].tolist())]
                if goes_on:
                    made[0] = (last[0], last[1] + made[0][1], last[2] + made[0][2], last[3] + made[0][3])
                last = made.pop() if many[-1] else None
                out += [unit(*u[:3]) for u in made]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if last is not None:
            out = unit(*last[:3])
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(out, schema)], schema=schema)
    return together


def units(rows: DataFrame, n_trees: int, n_features: int, seed: int) -> DataFrame:
    """Rows of the same bins, label and fold put together for the first n_trees trees: the place, and their draws and
    drawn rows by tree (32-bit numbers); rows of thinly filled places by their key. Cut by place and then by key, so
    that a place of very many rows is dealt to several tasks (and gives several units)."""
    names = _place(n_features)
    # also a small input is dealt to all cores
    sorted_ = rows.repartitionByRange(task_count(rows), *names, "key").sortWithinPartitions(*names)
    schema = ", ".join(f"{c} int" for c in names) + ", key long, w binary, n binary"
    return written(sorted_.mapInArrow(_together(n_trees, n_features, seed), schema).repartition(task_count(rows), *names, "key"),
                   "units")


def _draws(batch: pa.RecordBatch, first: int, n_trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws and drawn rows of each unit by tree from the first to n_trees - 1."""
    key = batch.column("key")
    many = np.flatnonzero(key.is_null().to_numpy(zero_copy_only=False))
    w = bag(key.fill_null(0).to_numpy(), n_trees, seed, first)
    n = (w > 0).astype(np.int64)
    for out, c in ((w, "w"), (n, "n")):
        if len(many):
            held = b"".join(batch.column(c).drop_null().to_pylist())
            out[many] = np.frombuffer(held, np.int32).reshape(len(many), -1)[:, first:n_trees]
    return w, n


def _cells(shared, at_once: int = AT_ONCE_CELLS):
    """Draws by class and distinct rows by (node, fold left out, feature, bin); limits: a bit per leaf limit to split for."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Nodes = shared.value
        is_open, above, classes = m.open.any(axis=1), m.above_open(), m.n_classes
        nodes = np.flatnonzero(is_open)
        number, subset = np.full(len(is_open), -1), m.subset(nodes)
        number[nodes] = np.arange(len(nodes))
        limits = np.zeros((len(nodes), len(m.folds)), np.int64)
        for g in range(len(m.left_out)):
            limits[:, m.fold_at[g]] |= m.open[nodes, g].astype(np.int64) << m.limit_at[g]
        # cells by the row's fold: the last place is for the folds that are never left out
        shape = (m.size, MAX_BINS, classes, len(m.folds) + 1)
        window = max(1, at_once // int(np.prod(shape)))
        few = len(nodes) <= window
        held = np.zeros((2, len(nodes) if few else 0, *shape), np.int64)
        trees = np.unique(m.tree[nodes])  # the others are grown

        def out(low: int, w: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = n.sum(axis=3)
            w_all, n_all = w.sum(axis=4), n.sum(axis=3)
            for f in range(len(m.folds)):
                rest, rows = w_all - w[..., f], n_all - n[..., f]
                rows[limits[low:low + len(w), f] == 0] = 0
                slot, j, b = np.nonzero(rows)
                if len(slot):
                    named = {"slot": nodes[slot + low], "fold": np.full(len(slot), f), "limits": limits[slot + low, f],
                             "feature": subset[slot + low, j], "bin": b, "n": rows[slot, j, b],
                             **{f"w{c}": rest[slot, j, b, c] for c in range(classes)}}
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in named.values()], list(named))

        for batch in batches:
            label, fold, bins = _columns(batch, m.n_features)
            fold_at = np.searchsorted(m.folds, fold).clip(max=len(m.folds) - 1)
            fold_at = np.where(m.folds[fold_at] == fold, fold_at, len(m.folds))
            low_tree = int(trees[0])
            drawn, rows = _draws(batch, low_tree, int(trees[-1]) + 1, m.seed)
            many = max(1, AT_ONCE // max(1, len(label)))
            for t in range(0, len(trees), many):
                row, tree = np.nonzero(drawn[:, trees[t:t + many] - low_tree])
                row, node = m.reach(bins, row, trees[t + tree], above, is_open)
                slot, tree = number[node], m.tree[node] - low_tree
                w, n = drawn[row, tree], rows[row, tree]
                if few:
                    pieces = [(0, len(nodes), slice(None))]
                else:
                    order = np.argsort(slot, kind="stable")
                    cut = np.searchsorted(slot[order], np.arange(0, len(nodes) + window, window))
                    pieces = [(k * window, min(window, len(nodes) - k * window), order[a:b])
                              for k, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
                for low, count, at in pieces:
                    r = row[at]
                    table = held if few else np.zeros((2, count, *shape), np.int64)
                    for j in range(m.size):
                        cell = (((slot[at] - low) * MAX_BINS + bins[r, subset[slot[at], j]]) * classes + label[r]) * shape[3] + fold_at[r]
                        for k, x in enumerate((w, n)):
                            table[k][:, j] += np.bincount(cell, x[at], count * MAX_BINS * classes * shape[3]).astype(np.int64) \
                                .reshape(count, *shape[1:])
                    if not few:
                        yield from out(low, *table)
        if few:
            yield from out(0, *held)
    return cells


def best_splits(cells: DataFrame, n_classes: int, leaf_limits: Sequence[int]) -> DataFrame:
    """One row per node, fold left out and leaf limit (its number): draws by class, distinct rows and the best split
    that leaves each child as many distinct rows as the leaf limit (null if there is none)."""
    classes, keys = range(n_classes), ["slot", "fold", "limits"]
    per_bin = cells.groupBy(*keys, "feature", "bin").agg(*[F.sum(f"w{c}").alias(f"w{c}") for c in classes], F.sum("n").alias("n"))
    feature = Window.partitionBy("slot", "fold", "feature")
    up_to = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = per_bin.select(*keys, "feature", "bin", *[F.sum(f"w{c}").over(up_to).alias(f"l{c}") for c in classes],
                          *[F.sum(f"w{c}").over(feature).alias(f"t{c}") for c in classes],
                          F.sum("n").over(up_to).alias("n_left"), F.sum("n").over(feature).alias("n"))

    def impurity(parts: list[Column], whole: Column) -> Column:
        return F.lit(1.0) - sum(((p / whole) * (p / whole) for p in parts), F.lit(0.0))

    lefts, alls = [F.col(f"l{c}") for c in classes], [F.col(f"t{c}") for c in classes]
    rights = [t - x for t, x in zip(alls, lefts)]
    lw, tw, rw = (sum(x[1:], x[0]) for x in (lefts, alls, rights))
    gain = F.when(rw > 0, impurity(alls, tw) - lw / tw * impurity(lefts, lw) - rw / tw * impurity(rights, rw))
    split = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "feature", "bin",
                     F.array(*lefts).alias("left"), "n_left")

    def best(number: int, limit: int) -> Column:
        allowed = (F.col("n_left") >= limit) & (F.col("n") - F.col("n_left") >= limit) & (F.col("gain") > 1e-12)
        return F.struct(F.lit(number).alias("leaf_limit"), F.max(F.when(allowed, split)).alias("best"))

    per_node = sums.withColumn("gain", gain).groupBy(*keys).agg(
        F.first(F.array(*alls)).alias("weights"), F.first("n").alias("n"),
        F.array(*[best(i, int(x)) for i, x in enumerate(leaf_limits)]).alias("bests"))
    return per_node.select("slot", "fold", "limits", "weights", "n", F.inline("bests")) \
        .where("(limits & shiftleft(1L, leaf_limit)) != 0")


def _found(splits: DataFrame, n_classes: int) -> dict[str, np.ndarray]:
    """The best splits on the driver by column; n_left is 0 where there is none."""
    flat = splits.select("slot", "fold", "leaf_limit", "n",
                         *[F.col("weights")[c].cast("double").alias(f"w{c}") for c in range(n_classes)],
                         *[F.coalesce(F.col("best")[c], F.lit(0)).cast("long").alias(c) for c in ("feature", "bin", "n_left")],
                         *[F.coalesce(F.col("best.left")[c], F.lit(0)).cast("double").alias(f"l{c}") for c in range(n_classes)])
    got = {c: a.to_numpy() for c, a in zip(flat.columns, flat.toArrow().columns)}
    both = {name: np.stack([got[f"{p}{c}"] for c in range(n_classes)], axis=1) for name, p in (("weights", "w"), ("left", "l"))}
    return {**got, **both}


def grow(rows: DataFrame, n_trees: int, leaf_limits: Sequence[int], folds: Sequence[int], n_classes: int, n_features: int,
         seed: int, size: int | None = None) -> Trees:
    """Grow n_trees trees for every leaf limit and every fold left out (-1: none); rows as `binned` gives them."""
    bagged = units(rows, n_trees, n_features, seed)
    spark = rows.sparkSession
    groups = [(limit, fold) for limit in leaf_limits for fold in folds]
    nodes = Nodes(n_trees, n_classes, np.array([g[0] for g in groups]), np.array([g[1] for g in groups]), n_features,
                  size or max(1, int(n_features ** 0.5)), seed)
    columns = ["slot", "fold", "limits", "feature", "bin", "n", *(f"w{c}" for c in range(n_classes))]
    while nodes.open.any():
        shared = spark.sparkContext.broadcast(nodes)  # the model so far
        cells = bagged.mapInArrow(_cells(shared), ", ".join(f"{c} long" for c in columns))
        nodes.split(_found(best_splits(cells, n_classes, nodes.limits), n_classes))
        shared.destroy()
    return nodes.unfolded()


def _votes(shared, depths: list[int], split_limits: list[int], sizes: list[int], n_classes: int):
    """Right answers of every candidate on the rows of each group's fold."""
    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Trees = shared.value
        share = m.weights / np.maximum(m.weights.sum(axis=1, keepdims=True), 1)
        go_on, steps = m.children(), int(m.depth.max())
        # candidates that differ in size only, or whose limits cut no node differently, share their places
        cuts: dict[bytes, tuple[np.ndarray, list]] = {}
        for limit in sorted(set(split_limits)):
            for depth in sorted(set(depths)):
                cut = m.cut(depth, limit)
                cuts.setdefault(cut.tobytes(), (share[cut], []))[1].append((depth, limit))
        for batch in batches:
            label, fold, bins = _columns(batch, m.n_features)
            n_rows = batch.column("rows").to_numpy()
            out = []
            for g, left_out in enumerate(m.left_out):
                rows = np.flatnonzero(fold == left_out)
                many = max(1, AT_ONCE // max(1, m.n_trees))
                for at in range(0, len(rows), many):
                    own = rows[at:at + many]
                    row, roots = np.repeat(own, m.n_trees), np.tile(g * m.n_trees + np.arange(m.n_trees), len(own))
                    place = m.descend(bins, row, roots, go_on, steps)
                    for shares, limits in cuts.values():
                        leaves = shares[place].reshape(len(own), m.n_trees, n_classes)
                        total, done = np.zeros((len(own), n_classes)), 0
                        for size in sorted(set(sizes)):
                            total += leaves[:, done:size].sum(axis=1)
                            done = size
                            right = int(n_rows[own[total.argmax(axis=1) == label[own]]].sum())
                            out += [(g, size, *both, right, int(n_rows[own].sum())) for both in limits]
            if out:
                names = ["group", "num_trees", "max_depth", "min_samples_split", "correct", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
    return votes


def fold_scores(rows: DataFrame, trees: Trees, depths: list[int], split_limits: list[int], sizes: list[int],
                n_classes: int) -> dict[tuple, dict[int, float]]:
    """{(num_trees, depth, split limit, leaf limit): {fold: accuracy}} of all candidates that the trees hold."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # the model
    names = _place(trees.n_features)  # rows of the same bins, label and fold have the same votes
    places = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("rows")).repartition(task_count(rows), *names)
    counts = places.mapInArrow(_votes(shared, depths, split_limits, sizes, n_classes),
                             "group long, num_trees long, max_depth long, min_samples_split long, correct long, n long")
    keys = ["group", "num_trees", "max_depth", "min_samples_split"]
    out: dict[tuple, dict[int, float]] = {}
    for r in counts.groupBy(*keys).agg((F.sum("correct") / F.sum("n")).alias("accuracy")).collect():  # candidates x folds
        key = (r["num_trees"], r["max_depth"], r["min_samples_split"], int(trees.leaf_limit[r["group"]]))
        out.setdefault(key, {})[int(trees.left_out[r["group"]])] = r["accuracy"]
    return out


def node_rows(trees: Trees, group: int, cuts: list[list[float]], depth: int, split_limit: int,
              n_trees: int | None = None) -> list[tuple]:
    """(tree, node, feature, threshold, left, right, weights, n) of a group's first n_trees trees (None: of all), cut at
    the limits; nodes in pre-order from 0, -1 for a leaf's feature and children."""
    out = []
    for t in range(n_trees or trees.n_trees):
        todo, own, number = [group * trees.n_trees + t], [], {}
        while todo:
            i = todo.pop()
            number[i] = len(own)
            leaf = trees.left[i] == i or trees.depth[i] >= depth or trees.n[i] < split_limit
            own.append((i, leaf))
            if not leaf:
                todo += [int(trees.right[i]), int(trees.left[i])]
        for i, leaf in own:
            f = -1 if leaf else int(trees.feature[i])
            out.append((t, number[i], f, None if leaf else cuts[f][trees.bin[i]], -1 if leaf else number[int(trees.left[i])],
                        -1 if leaf else number[int(trees.right[i])], [float(w) for w in trees.weights[i]], int(trees.n[i])))
    return out


def prepare(data: DataFrame, features: Sequence[str], label_col: str, fold_col: str | None,
            key_cols: Sequence[str]) -> tuple[DataFrame, list[list[float]]]:
    """Binned rows as a written table, and the values to split at."""
    cuts = thresholds(data, features)
    rows = binned(data, features, label_col, fold_col, key_cols, cuts)
    return written(rows, "binned"), cuts
