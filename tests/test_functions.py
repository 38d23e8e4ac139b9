import math

import pytest
from pyspark.sql import functions as F

from featureflow.functions.arith import ieee_div
from featureflow.functions.forest import Forest, forest_proba
from featureflow.functions.lookup import map_values, name_by_index
from featureflow.operators.features import derived_features


def test_golden_ratios_and_area(spark):
    # reference sample inputs and their hand-computed features
    df = spark.createDataFrame([(5.1, 3.5, 1.4, 0.2), (6.2, 2.8, 4.8, 1.8)],
                               "sepal_length double, sepal_width double, petal_length double, petal_width double")
    rows = derived_features(df).orderBy("sepal_length").collect()
    assert rows[0]["sepal_ratio"] == pytest.approx(1.457142857142857, abs=1e-15)
    assert rows[0]["petal_ratio"] == pytest.approx(6.999999999999999, abs=1e-15)
    assert rows[0]["total_area"] == pytest.approx(18.13, abs=1e-12)
    assert rows[1]["sepal_ratio"] == pytest.approx(2.2142857142857144, abs=1e-15)
    assert rows[1]["petal_ratio"] == pytest.approx(2.6666666666666665, abs=1e-15)
    assert rows[1]["total_area"] == pytest.approx(26.0, abs=1e-12)


def test_ieee_division_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 0.0), (1.0, -0.0),
                                (3.0, 2.0)], "a double, b double")
    out = [r[0] for r in df.select(ieee_div("a", "b")).collect()]
    assert out[0] == math.inf and out[1] == -math.inf
    assert math.isnan(out[2]) and math.isnan(out[3])
    assert out[4] == -math.inf
    assert out[5] == 1.5


def test_null_mode_division(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert df.select(ieee_div("a", "b", mode="null")).first()[0] is None


def test_map_values_and_strict(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    got = [r[0] for r in df.select(map_values("c", {"a": 1})).collect()]
    assert got == [1, None, None]
    with pytest.raises(Exception, match="unmapped key"):
        df.select(map_values("c", {"a": 1}, strict=True)).collect()


def test_name_by_index_list_semantics(spark):
    df = spark.createDataFrame([(0,), (2,), (-1,)], "i int")
    assert [r[0] for r in df.select(name_by_index("i", ["x", "y", "z"])).collect()] == ["x", "z", "z"]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(3,)], "i int").select(name_by_index("i", ["x", "y", "z"])).collect()


def test_no_python_udf_in_feature_plan(spark):
    df = spark.createDataFrame([(5.1, 3.5, 1.4, 0.2)],
                               "sepal_length double, sepal_width double, petal_length double, petal_width double")
    plan = derived_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert F is not None


def test_lookup_join_leaves_the_broadcast_to_spark(spark):
    from featureflow.functions.lookup import lookup_join

    df = spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, code int")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "code int, name string")
    expect = {i: {0: "a", 1: "b", 2: "c"}.get(i % 4) for i in range(40)}   # unmapped code 3 -> null
    out = lookup_join(df, names, "code")
    assert {r["id"]: r["name"] for r in out.collect()} == expect
    assert "broadcast" not in out._jdf.queryExecution().logical().toString().lower()


def test_forest_of_more_than_four_thousand_nodes_is_an_expression(spark):
    leaf = [(t, n, -1, None, -1, -1, [1.0, 0.0] if n == 1 else [0.0, 1.0]) for t in range(1400) for n in (1, 2)]
    forest = Forest(("a", "b"), tuple(leaf + [(t, 0, 0, 0.5, 1, 2, None) for t in range(1400)]))
    expr = forest_proba(forest, ["x"])
    assert len(forest.nodes) == 4200 and forest.n_trees == 1400 and expr is not None


def test_null_keys_meet_in_the_null_safe_join(spark):
    from featureflow.functions.lookup import join_null_safe

    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    got = {(r["k"], r["a"], r["b"]) for r in join_null_safe(a, b, ["k"], "left").collect()}
    assert got == {(None, 1, 10), ("x", 2, None)}
