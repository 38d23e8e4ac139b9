"""Forests grown by aggregates, and the search over them, against plain-Python versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureflow.functions.forest import Forest, forest_proba, node_arrays
from featureflow.operators import growth
from featureflow.operators.train import grid_search

FEATURES = ["a", "b", "c"]
CLASSES = ["x", "y"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        a, b, c = (float(v) for v in rng.integers(0, 12, 3))
        rows.append((i, a, b, c, CLASSES[int((a > 5) != (b > 7) or rng.random() < 0.1)], i % 3))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label string, fold int").cache()


def binned(data):
    from featureflow.operators.train import LABEL, with_label_index
    return growth.prepare(with_label_index(data, "label", CLASSES), FEATURES, LABEL, "fold", ["id"])


def routed(trees, row, root):
    """Nodes on a row's way from a root to its leaf."""
    way = [root]
    while trees.left[way[-1]] != way[-1]:
        i = way[-1]
        way.append(int(trees.left[i] if row[f"b{trees.feature[i]}"] <= trees.bin[i] else trees.right[i]))
    return way


def test_node_counts_are_distinct_rows_of_the_bag(spark, data):
    rows, _ = binned(data)
    trees = growth.grow(rows, 5, [1, 6], range(3), 2, 3, 7)
    local = rows.collect()
    drawn = growth.bag(np.array([r["key"] for r in local]), 5, 7)
    assert drawn.min() == 0 and 0.8 < drawn.mean() < 1.2
    n, weights = np.zeros(len(trees.n), int), np.zeros(trees.weights.shape)
    for g, out in enumerate(trees.left_out):
        for t in range(5):
            for r, times in zip(local, drawn[:, t]):
                if times and r["fold"] != out:
                    for i in routed(trees, r, g * 5 + t):
                        n[i] += 1
                        weights[i, r["label"]] += times
    assert (n == trees.n).all() and (weights == trees.weights).all()
    inner = np.flatnonzero(trees.children())
    limit = trees.leaf_limit[trees.group[inner]]
    assert (trees.n[trees.left[inner]] >= limit).all() and (trees.n[trees.right[inner]] >= limit).all()
    assert len(inner) > 50 and not trees.open.any()


def test_every_split_is_the_best_allowed(spark, data):
    rows, _ = binned(data)
    trees = growth.grow(rows, 3, [4], [-1], 2, 3, 11)
    local = rows.collect()
    drawn = growth.bag(np.array([r["key"] for r in local]), 3, 11)
    label = np.array([r["label"] for r in local])
    bins = np.array([[r[f"b{j}"] for j in range(3)] for r in local])

    def gini(w):
        return 1 - ((w / w.sum()) ** 2).sum()

    for i in range(len(trees.n)):
        here = np.array([i in routed(trees, r, int(trees.tree[i])) for r in local]) & (drawn[:, trees.tree[i]] > 0)
        w = drawn[here, trees.tree[i]]
        best = None
        for f in trees.subset(np.array([i]))[0]:
            for b in range(growth.MAX_BINS):
                left = bins[here, f] <= b
                if left.sum() < 4 or (~left).sum() < 4:
                    continue
                parts = [np.bincount(label[here][m], w[m], 2) for m in (left, ~left)]
                total = parts[0] + parts[1]
                gain = gini(total) - sum(p.sum() / total.sum() * gini(p) for p in parts)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, b)
        grown = trees.left[i] != i
        assert grown == (best is not None and trees.n[i] >= 8 and (trees.weights[i] > 0).all())
        if grown:
            assert (trees.feature[i], trees.bin[i]) == best[1:]


def test_search_scores_every_candidate_by_its_limits(spark, data):
    grid = {"num_trees": [2, 4], "max_depth": [2, None], "min_samples_split": [2, 20], "min_samples_leaf": [1, 5]}
    model, cand = grid_search(data, FEATURES, "label", CLASSES, "fold", 3, grid, 7, "id")
    got = {(r["num_trees"], r["max_depth"], r["min_samples_split"], r["min_samples_leaf"]): r["mean_accuracy"] for r in cand.collect()}
    assert len(got) == 16 and cand.where("is_best").count() == 1
    rows, cuts = binned(data)
    local = rows.collect()
    trees = growth.grow(rows, 4, [1, 5], range(3), 2, 3, 7)
    for (size, depth, split, leaf), mean in got.items():
        scores = []
        for fold in range(3):
            g = [1, 5].index(leaf) * 3 + fold
            right = total = 0
            for r in (r for r in local if r["fold"] == fold):
                votes = np.zeros(2)
                for t in range(size):
                    way = routed(trees, r, g * 4 + t)
                    stop = next(k for k, i in enumerate(way) if k == depth or trees.n[i] < split or i == way[-1])
                    votes += trees.weights[way[stop]] / trees.weights[way[stop]].sum()
                right += int(votes.argmax() == r["label"])
                total += 1
            scores.append(right / total)
        assert abs(mean - np.mean(scores)) < 1e-12
    best = cand.where("is_best").first()
    first = min(r["candidate"] for r in cand.collect() if r["mean_accuracy"] == max(got.values()))
    assert best["candidate"] == first and best["mean_accuracy"] == max(got.values())
    # the model handed over scores like its nodes
    own = growth.grow(rows, best["num_trees"], [best["min_samples_leaf"]], [-1], 2, 3, 7)
    nodes = growth.node_rows(own, 0, cuts, best["max_depth"], best["min_samples_split"])
    forest = Forest(tuple(CLASSES), tuple((*n[:6], [w / sum(n[6]) for w in n[6]]) for n in nodes))
    from pyspark.ml.functions import vector_to_array
    gap = model.transform(data).select(F.array_max(F.zip_with(
        vector_to_array("probability"), forest_proba(forest, FEATURES), lambda x, y: F.abs(x - y))).alias("gap"))
    assert gap.agg(F.max("gap")).first()[0] < 1e-9
    assert sum(model.stages[-1].featureImportances.toArray()) == pytest.approx(1)


def test_growth_does_not_depend_on_partitions(spark, data):
    rows, _ = binned(data)
    a = growth.grow(rows.repartition(1), 3, [1], [0, -1], 2, 3, 5)
    b = growth.grow(rows.repartition(9), 3, [1], [0, -1], 2, 3, 5)
    assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.n == b.n).all()


def test_growth_rejects_nulls_and_empty_folds(spark, data):
    holes = data.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    with pytest.raises(Exception, match="null in feature a"):
        binned(holes)
    with pytest.raises(ValueError, match="every fold"):
        grid_search(data, FEATURES, "label", CLASSES, "fold", 4, {"num_trees": [2], "max_depth": [2]}, 7, "id")


def test_large_forest_as_expression(spark, data):
    rng = np.random.default_rng(2)
    nodes = []
    for t in range(200):  # deep trees: one long way each
        for k in range(0, 60, 2):
            nodes += [(t, k, int(rng.integers(0, 3)), float(rng.integers(0, 12)), k + 1, k + 2, None),
                      (t, k + 1, -1, None, -1, -1, [p := float(rng.random()), 1 - p])]
        nodes.append((t, 60, -1, None, -1, -1, [0.25, 0.75]))
    forest = Forest(tuple(CLASSES), tuple(nodes))
    assert node_arrays(forest).depth == 30 and len(forest.nodes) == 200 * 61
    by = {(n[0], n[1]): n for n in nodes}
    for r in data.limit(20).select(*FEATURES, forest_proba(forest, FEATURES).alias("p")).collect():
        total = np.zeros(2)
        for t in range(200):
            n = by[t, 0]
            while n[2] >= 0:
                n = by[t, n[4] if r[FEATURES[n[2]]] <= n[3] else n[5]]
            total += n[6]
        assert np.allclose(r["p"], total / 200, atol=1e-12, rtol=0)


def test_one_leaf_forest_and_nulls_go_right(spark):
    lone = Forest(("x", "y"), ((0, 0, -1, None, -1, -1, [0.5, 0.5]),))
    split = Forest(("x", "y"), ((0, 0, 0, 1.0, 1, 2, None), (0, 1, -1, None, -1, -1, [1.0, 0.0]), (0, 2, -1, None, -1, -1, [0.0, 1.0])))
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "a double")
    got = df.select(forest_proba(lone, ["a"]).alias("l"), forest_proba(split, ["a"]).alias("s")).collect()
    assert [r["l"] for r in got] == [[0.5, 0.5]] * 3 and [r["s"] for r in got] == [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]


def test_equal_binned_rows_are_one_unit(spark, monkeypatch):
    # 3,000 rows in 24 places, one of them with half of the rows, and 3 rows in places of their own
    where = [(i % 2, 0, 0) if i % 4 else (0, i % 12 // 4, 1 + i % 5 // 3) for i in range(3000)] + [(5, 5, k) for k in range(3)]
    raw = [(7919 * i + 1, p[2] % 2, i % 2, *p) for i, p in enumerate(where)]
    rows = spark.createDataFrame(raw, "key long, label int, fold int, b0 int, b1 int, b2 int").repartition(4)
    monkeypatch.setattr(growth, "UNIT_ROWS", 400)
    made = growth.units(rows, 6, 3, 9).collect()
    places = {(r[3:], r[1], r[2]) for r in raw}
    assert len(made) < len(places) + 40 < 100
    want, got = {}, {}
    for r in raw:
        w = growth.bag(np.array([r[0]]), 6, 9)[0]
        want[r[3:], r[1], r[2]] = want.get((r[3:], r[1], r[2]), 0) + np.stack([w, w > 0])
    for u in made:
        if u["key"] is None:
            both = np.stack([np.frombuffer(u[c], np.int32) for c in ("w", "n")])
        else:
            w = growth.bag(np.array([u["key"]]), 6, 9)[0]
            both = np.stack([w, w > 0])
        place = ((u["b0"], u["b1"], u["b2"]), u["label"], u["fold"])
        got[place] = got.get(place, 0) + both
    assert set(got) == set(want) and all((got[p] == want[p]).all() for p in want)
    assert sum(u["key"] is not None for u in made) < 50


def test_forests_share_nodes_until_their_splits_differ(spark, data, monkeypatch):
    rows, _ = binned(data)
    seen = []
    unfolded = growth.Nodes.unfolded
    monkeypatch.setattr(growth.Nodes, "unfolded", lambda self: seen.append(len(self.tree)) or unfolded(self))
    trees = growth.grow(rows, 4, [1, 5], [0, 1, 2, -1], 2, 3, 7)
    assert seen[0] < len(trees.n)
    for g in (2, 7):  # a group alone gives the same trees
        limit, out = trees.leaf_limit[g], trees.left_out[g]
        alone = growth.grow(rows, 4, [int(limit)], [int(out)], 2, 3, 7)
        cuts = [[float(i) for i in range(growth.MAX_BINS)]] * 3
        assert growth.node_rows(trees, g, cuts, 30, 2) == growth.node_rows(alone, 0, cuts, 30, 2)


def test_wide_levels_are_counted_in_windows(spark, data, monkeypatch):
    rows, cuts = binned(data)
    at_once = growth.grow(rows, 3, [1, 4], [0, -1], 2, 3, 5)
    cells = growth._cells
    monkeypatch.setattr(growth, "_cells", lambda shared: cells(shared, 1))
    windows = growth.grow(rows, 3, [1, 4], [0, -1], 2, 3, 5)
    assert (windows.n == at_once.n).all() and (windows.weights == at_once.weights).all()


def test_draws_are_the_poisson_quantiles_of_the_hash():
    keys = np.random.default_rng(1).integers(-2**62, 2**62, 20000)
    trees = growth._mix(np.arange(1, 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(3))
    u = (growth._mix(keys.view(np.uint64)[:, None] ^ trees[None, :]) >> np.uint64(11)) / float(1 << 53)
    want = np.searchsorted(growth.CDF, u, side="right")
    assert (growth.bag(keys, 5, 3) == want).all() and (growth.bag(keys, 5, 3, 2) == want[:, 2:]).all()
