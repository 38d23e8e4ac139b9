"""A tree ensemble as a SQL expression (M4) and probability helpers.

The forest's node table becomes a few literal arrays (feature, threshold,
children, leaf fractions). Every tree is descended by an ``aggregate`` of as
many steps as the deepest tree has levels, which looks one node up per step;
a leaf stays where it is. The forest averages the leaves' class fractions.
The expression has the same few operators for any number of trees and nodes,
so it compiles at once, and there is no Python worker and no shuffle. It gives
the same probabilities as the ensemble's own ``predict_proba`` / MLlib
``transform`` (mean over trees of leaf class fractions).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),      # -1 for a leaf
    T.StructField("threshold", T.DoubleType()),     # value <= threshold goes left
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("probs", T.ArrayType(T.DoubleType())),  # leaf class fractions
])


@dataclass(frozen=True)
class Forest:
    classes: tuple              # class labels in probability order
    nodes: tuple                # rows of NODE_SCHEMA; node 0 of each tree is its root

    @property
    def n_trees(self) -> int:
        return len({n[0] for n in self.nodes})


def forest_from_node_table(df: DataFrame, classes: Sequence) -> Forest:
    """Build from a node table (model metadata: one row per tree node; it
    grows with the model, not with the data)."""
    rows = [tuple(r) for r in df.select(*[f.name for f in NODE_SCHEMA.fields]).collect()]
    return Forest(tuple(classes), tuple(rows))


def forest_from_mllib(spark: SparkSession, model_path: str, classes: Sequence) -> Forest:
    """Read a saved MLlib tree-ensemble classifier's node data.

    A split sends ``value <= threshold`` left, as here; a leaf's class
    fractions are its impurity statistics normalised, which is what MLlib
    averages in ``predictRaw``.
    """
    data = spark.read.parquet(f"{model_path.rstrip('/')}/data")
    nd = data.select(
        F.col("treeID").cast("int").alias("tree"),
        F.col("nodeData.id").cast("int").alias("node"),
        F.when(F.col("nodeData.leftChild") < 0, F.lit(-1))
        .otherwise(F.col("nodeData.split.featureIndex")).cast("int").alias("feature"),
        F.when(F.col("nodeData.leftChild") < 0, F.lit(None).cast("double"))
        .otherwise(F.element_at("nodeData.split.leftCategoriesOrThreshold", 1)).alias("threshold"),
        F.col("nodeData.leftChild").cast("int").alias("left"),
        F.col("nodeData.rightChild").cast("int").alias("right"),
        F.when(F.col("nodeData.leftChild") < 0,
               F.transform("nodeData.impurityStats",
                           lambda x: x / F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, b: a + b)))
        .alias("probs"),
    )
    # MLlib numbers nodes in pre-order with the root as id 0 per tree
    return forest_from_node_table(nd, classes)


@dataclass(frozen=True)
class NodeArrays:
    """All nodes of a forest in one numbering; a leaf's children are itself."""
    feature: list               # 0-based; 0 for a leaf
    threshold: list
    left: list
    right: list
    probs: list                 # class fractions, one block of n_classes per node
    roots: list
    depth: int                  # edges from a root to its deepest leaf
    n_classes: int


def node_arrays(forest: Forest) -> NodeArrays:
    place = {(n[0], n[1]): i for i, n in enumerate(forest.nodes)}
    k = len(forest.classes)
    feature, threshold, left, right, probs = [], [], [], [], []
    for i, (tree, _, f, t, lo, hi, p) in enumerate(forest.nodes):
        leaf = f is None or f < 0
        feature.append(0 if leaf else int(f))
        threshold.append(0.0 if leaf else float(t))
        left.append(i if leaf else place[tree, lo])
        right.append(i if leaf else place[tree, hi])
        probs += [float(x) for x in p] if leaf else [0.0] * k
    roots = [place[t, 0] for t in sorted({n[0] for n in forest.nodes})]
    depth, level = 0, roots
    while level := [c for i in level if left[i] != i for c in (left[i], right[i])]:
        depth += 1
    return NodeArrays(feature, threshold, left, right, probs, roots, depth, k)


def _literal(values: list, kind: str) -> Column:
    """An array literal of any length as one expression (constant-folded)."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast(f"array<{kind}>")


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def forest_proba(forest: Forest, feats: Sequence) -> Column:
    """Averaged class probabilities, ``array<double>`` in ``forest.classes`` order.

    ``value <= threshold`` goes left, anything else (null too) right. Trees
    are summed in their order and divided by the tree count.
    """
    m = node_arrays(forest)
    feature, left, right = (_literal(x, "int") for x in (m.feature, m.left, m.right))
    threshold, probs = (_literal(x, "double") for x in (m.threshold, m.probs))
    values = F.array(*[(F.col(f) if isinstance(f, str) else f).cast("double") for f in feats])

    def leaf(x: Column, root: Column) -> Column:
        if not m.depth:
            return root
        step = lambda at, _: F.when(F.get(x, F.get(feature, at)) <= F.get(threshold, at), F.get(left, at)) \
            .otherwise(F.get(right, at))
        return F.aggregate(F.sequence(F.lit(1), F.lit(m.depth)), root, step)

    def average(leaves: Column, c: int) -> Column:
        return F.aggregate(leaves, F.lit(0.0), lambda total, at: total + F.get(probs, at * m.n_classes + c)) / float(len(m.roots))

    leaves = _with(values, lambda x: F.transform(_literal(m.roots, "int"), lambda root: leaf(x, root)))
    return _with(leaves, lambda found: F.array(*[average(found, c) for c in range(m.n_classes)]))


def argmax_index(proba: Column) -> Column:
    """Index of the largest probability; ties go to the lowest index."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def confidence(proba: Column) -> Column:
    """Largest class probability."""
    return F.array_max(proba)


def probability_map(proba: Column, names: Sequence[str]) -> Column:
    """Class name → probability, keys in class order."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), proba)


def probability_columns(proba: Column, names: Sequence[str], prefix: str = "p_") -> list[Column]:
    """The same probabilities as one flat column per class."""
    return [F.element_at(proba, i + 1).alias(f"{prefix}{n}") for i, n in enumerate(names)]


# A hand-written three-tree forest over the four stand-in
# measures (0: largest quantity, 1: largest price, 2: largest discount,
# 3: largest tax) and the classes F, O, P. Used by the registered scoring
# queries so that an independent SQL CASE can check them.
STANDIN_FOREST = Forest(
    classes=("F", "O", "P"),
    nodes=(
        (0, 0, 2, 0.07, 1, 2, None),
        (0, 1, -1, None, -1, -1, [0.5, 0.3, 0.2]),
        (0, 2, 0, 42.0, 3, 4, None),
        (0, 3, -1, None, -1, -1, [0.2, 0.5, 0.3]),
        (0, 4, -1, None, -1, -1, [0.3, 0.2, 0.5]),
        (1, 0, 1, 87000.0, 1, 2, None),
        (1, 1, 3, 0.06, 3, 4, None),
        (1, 2, -1, None, -1, -1, [0.2, 0.3, 0.5]),
        (1, 3, -1, None, -1, -1, [0.6, 0.2, 0.2]),
        (1, 4, -1, None, -1, -1, [0.25, 0.5, 0.25]),
        (2, 0, 3, 0.04, 1, 2, None),
        (2, 1, -1, None, -1, -1, [0.4, 0.4, 0.2]),
        (2, 2, 2, 0.09, 3, 4, None),
        (2, 3, -1, None, -1, -1, [0.3, 0.4, 0.3]),
        (2, 4, -1, None, -1, -1, [0.1, 0.3, 0.6]),
    ),
)
