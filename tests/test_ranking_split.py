import math

import pytest
from hypothesis import assume, given, settings, strategies as st
from pyspark.sql import functions as F

from featureflow.operators.ranking import exact_rank, row_index
from featureflow.operators.split import stratified_folds, stratified_split


def _balanced(spark, n_per_class=50, classes=(0, 1, 2)):
    rows = [(i * 7 + 3, c) for c in classes for i in range(c * n_per_class, (c + 1) * n_per_class)]
    return spark.createDataFrame(rows, "id long, label int")


def test_row_index_is_permutation_with_many_buckets(spark):
    df = spark.range(0, 2000).select((F.col("id") * 37 % 2003).alias("k"))
    idx = row_index(df, "k", buckets=13).collect()
    by_key = sorted((r["k"], r["row_index"]) for r in idx)
    assert [i for _, i in by_key] == list(range(2000))


def test_row_index_bucket_count_from_the_data(spark):
    # bucket count derived from the row count: boundaries thinned from the
    # coarse pass, or a second finer pass when the coarse ones are too few
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).alias("k"))
    expect = list(range(3000))
    for kw in ({}, {"rows_per_bucket": 7}, {"rows_per_bucket": 3, "coarse_buckets": 64},
               {"rows_per_bucket": 100, "coarse_buckets": 16}):
        got = sorted((r["k"], r["row_index"]) for r in row_index(df, "k", **kw).collect())
        assert [i for _, i in got] == expect, kw


def test_exact_rank_global_with_per_partition_columns(spark):
    df = spark.range(0, 300).select((F.col("id") * 13 % 301).alias("k"))
    out = exact_rank(df, ["k"], (F.col("k") / 40).cast("int"), name="r",
                     per_partition=lambda sizes: sizes.select(F.col("n").alias("total")))
    rows = sorted((r["k"], r["r"], r["total"]) for r in out.collect())
    assert [r for _, r, _ in rows] == list(range(300)) and {t for _, _, t in rows} == {300}


def test_row_index_independent_of_partitioning(spark):
    df = spark.range(0, 500).select((F.col("id") * 11 % 501).alias("k"))
    a = {r["k"]: r["row_index"] for r in row_index(df.repartition(1), "k", buckets=5).collect()}
    b = {r["k"]: r["row_index"] for r in row_index(df.repartition(17), "k", buckets=5).collect()}
    assert a == b


def test_row_index_string_keys(spark):
    keys = ["b", "a", "ab", "é", "zz", "a0", ""]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["row_index"] for r in row_index(df, "k", buckets=3).collect()}
    expect = {k: i for i, k in enumerate(sorted(keys, key=lambda s: s.encode()))}
    assert got == expect


def test_row_index_duplicate_key_fails(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    with pytest.raises(Exception, match="not unique"):
        row_index(df, "k", buckets=1).collect()


def test_split_counts_150_balanced(spark):
    sp = stratified_split(_balanced(spark), "id", "label", 0.2, 42).cache()
    assert sp.where("split = 'train'").count() == 120
    per_class = {r["label"]: r["count"] for r in sp.where("split = 'test'").groupBy("label").count().collect()}
    assert per_class == {0: 10, 1: 10, 2: 10}


def test_split_largest_remainder(spark):
    # F 4859 / O 4884 / P 5000 of 14743 → train 3887 / 3907 / 4000
    rows = [(i, "F") for i in range(4859)] + [(10000 + i, "O") for i in range(4884)] + \
           [(20000 + i, "P") for i in range(5000)]
    sp = stratified_split(spark.createDataFrame(rows, "id long, label string"), "id", "label", 0.2, 42)
    got = {r["label"]: r["count"] for r in sp.where("split = 'train'").groupBy("label").count().collect()}
    assert got == {"F": 3887, "O": 3907, "P": 4000}


def test_split_disjoint_complete_and_partition_invariant(spark):
    df = _balanced(spark, 40)
    a = {r["id"]: r["split"] for r in stratified_split(df.repartition(1), "id", "label").collect()}
    b = {r["id"]: r["split"] for r in stratified_split(df.repartition(17), "id", "label").collect()}
    assert a == b and len(a) == 120


def test_split_single_member_class_fails(spark):
    rows = [(i, 0) for i in range(10)] + [(100, 1)]
    with pytest.raises(Exception, match="fewer than 2 members"):
        stratified_split(spark.createDataFrame(rows, "id long, label int"), "id", "label").collect()


def test_folds_balanced_within_one(spark):
    sp = stratified_folds(stratified_split(_balanced(spark, 53), "id", "label"), 5)
    counts = sp.where("split = 'train'").groupBy("label", "fold").count().collect()
    by_class = {}
    for r in counts:
        by_class.setdefault(r["label"], []).append(r["count"])
    for sizes in by_class.values():
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert sp.where("split = 'test' and fold is not null").count() == 0


def _brute_split(rows, test_size, seed):
    """Plain-Python reference: largest-remainder train counts per class, the
    first ranks of md5(id:seed) within each class are train."""
    import hashlib
    import math

    by_class: dict = {}
    for i, c in rows:
        by_class.setdefault(c, []).append(i)
    n = len(rows)
    n_train = n - math.ceil(test_size * n)
    fl = {c: len(v) * n_train // n for c, v in by_class.items()}
    rem = {c: len(v) * n_train - fl[c] * n for c, v in by_class.items()}
    extra = sorted(by_class, key=lambda c: (-rem[c], c))[: n_train - sum(fl.values())]
    out = {}
    for c, ids in by_class.items():
        k = fl[c] + (1 if c in extra else 0)
        ranked = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))
        out.update({i: ("train" if r < k else "test") for r, i in enumerate(ranked)})
    return out


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(min_value=6, max_value=60), min_size=2, max_size=4),
       test_size=st.sampled_from([0.1, 0.2, 0.33]), seed=st.integers(min_value=0, max_value=10**6))
def test_split_matches_brute_force(spark, sizes, test_size, seed):
    rows = [(c * 1000 + j, c) for c, m in enumerate(sizes) for j in range(m)]
    n = len(rows)
    assume(math.ceil(test_size * n) >= len(sizes) and n - math.ceil(test_size * n) >= len(sizes))
    df = spark.createDataFrame(rows, "id long, label int")
    got = {r["id"]: r["split"] for r in stratified_split(df, "id", "label", test_size, seed, cell_rows=5).collect()}
    assert got == _brute_split(rows, test_size, seed)


def test_split_rejects_rows_without_a_label(spark):
    from featureflow.operators.split import stratified_split
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "id int, label int")
    with pytest.raises(Exception, match="no label"):
        stratified_split(df, "id", "label").collect()


def test_keys_with_a_long_shared_prefix_are_spread_over_buckets(spark):
    from featureflow.operators.ranking import row_index, with_quantile_bucket

    df = spark.range(2000).selectExpr("concat('order-', lpad(cast(id AS string), 12, '0')) AS k")
    assert with_quantile_bucket(df, "k", "b", 8).select("b").distinct().count() == 8
    got = [r["k"] for r in row_index(df, "k", buckets=8).orderBy("row_index").collect()]
    assert got == sorted(got)
    empty = row_index(df.where("k IS NULL"), "k", buckets=8)
    assert empty.count() == 0


def test_an_outlier_key_does_not_spoil_the_buckets(spark):
    from featureflow.operators.ranking import text_splitters, with_quantile_bucket

    df = spark.range(20_000).selectExpr("concat('order-', lpad(cast(id AS string), 9, '0')) AS k").union(
        spark.createDataFrame([("zz",)], "k string"))
    sizes = [r["count"] for r in with_quantile_bucket(df, "k", "b", 16).groupBy("b").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 4 * 20_001 / 16
    assert len(text_splitters(df, "k", 1, 20_001)) == 0
    got = [r["k"] for r in row_index(df, "k", rows_per_bucket=900).orderBy("row_index").collect()]
    assert got == sorted(got)
    raw = df.selectExpr("cast(k AS binary) AS k")
    assert with_quantile_bucket(raw, "k", "b", 8).select("b").distinct().count() >= 6


def test_heavy_parts_are_cut_again(spark, monkeypatch):
    from featureflow.operators import ranking

    df = spark.range(4000).selectExpr("concat('k', lpad(cast(id AS string), 6, '0')) AS k")
    first = ranking.key_splitters
    calls = []

    def poor(frame, col, need, n):  # the first sample sees the start only
        calls.append(need)
        return ["k000001", "k000002"] if len(calls) == 1 else first(frame, col, need, n)

    monkeypatch.setattr(ranking, "key_splitters", poor)
    cuts = ranking.text_splitters(df, "k", 20, 4000)
    assert len(calls) > 1
    sizes = [r["count"] for r in df.groupBy(ranking.splitter_bucket("k", cuts)).count().collect()]
    assert max(sizes) <= 4 * 200 and sum(sizes) == 4000


def test_hash_trie_deepens_heavy_cells_only(spark):
    from featureflow.operators.ranking import hash_trie
    from featureflow.operators.split import split_hash

    df = spark.range(3000).select("id", F.when(F.col("id") < 2900, "big").when(F.col("id") < 2990, "small").alias("c"))
    cells = hash_trie(df.withColumn("h", split_hash("id", 42)), "h", ["c"], "cell", cell_rows=50).collect()
    sizes = {}
    for r in cells:
        sizes[r["c"], r["cell"]] = sizes.get((r["c"], r["cell"]), 0) + 1
    assert max(sizes.values()) <= 50 and len(sizes) < 400
    assert len([k for k in sizes if k[0] == "small"]) <= 16 and len([k for k in sizes if k[0] is None]) <= 10
    for c in ("big", "small", None):
        own = sorted((r["h"], r["cell"]) for r in cells if r["c"] == c)
        assert [x for _, x in own] == sorted(x for _, x in own)
