import pytest
from pyspark.sql import functions as F

from featureflow.functions import requests as R
from featureflow.functions.forest import STANDIN_FOREST
from featureflow.operators.serving import ServingModel, score_batch_requests, score_requests

MODEL = ServingModel(forest=STANDIN_FOREST, class_names=["finished", "open", "partial"])

SINGLE = [
    ('{"features":[5.1,3.5,1.4,0.2]}', 200, None, None),
    ('{"features":[1,2]}', 400, R.BAD_LENGTH, 2),
    ('{"features":[]}', 400, R.BAD_LENGTH, 0),
    ("{}", 400, R.MISSING, None),
    ("null", 400, R.MISSING, None),
    ('{"x":1}', 400, R.MISSING, None),
    ("[]", 400, R.MISSING, None),
    ("0", 400, R.MISSING, None),
    ('""', 400, R.MISSING, None),
    ("false", 400, R.MISSING, None),
    ("nope", 500, R.NOT_JSON, None),
    ("7", 500, R.NOT_CONTAINER, None),
    ("true", 500, R.NOT_CONTAINER, None),
    ('"has features in it"', 500, R.NOT_CONTAINER, None),
    ('"abc"', 400, R.MISSING, None),
    ('["features"]', 500, R.NOT_CONTAINER, None),
    ('["other"]', 400, R.MISSING, None),
    ('{"features":null}', 500, R.NO_LENGTH, None),
    ('{"features":7}', 500, R.NO_LENGTH, None),
    ('{"features":"abcd"}', 500, R.NOT_NUMERIC, None),
    ('{"features":"abc"}', 400, R.BAD_LENGTH, 3),
    ('{"features":{"a":1,"b":2,"c":3,"d":4}}', 500, R.NOT_NUMERIC, None),
    ('{"features":["a",1,2,3]}', 500, R.NOT_NUMERIC, None),
    ('{"features":["5.1",1,2,3]}', 500, R.NOT_NUMERIC, None),
    ('{"features":[null,1,2,3]}', 500, R.NOT_NUMERIC, None),
    ('{"features":[[1],1,2,3]}', 500, R.NOT_NUMERIC, None),
    ('{"features":[true,1,2,3]}', 200, None, None),
]


def test_single_request_rules(spark):
    df = spark.createDataFrame([(i, b) for i, (b, *_rest) in enumerate(SINGLE)], "req_id long, body string")
    out = {r["req_id"]: r for r in score_requests(df, MODEL).collect()}
    for i, (body, status, error, received) in enumerate(SINGLE):
        r = out[i]
        assert (r["status"], r["error"], r["received"]) == (status, error, received), body
        assert r["success"] == (status == 200)
        assert (r["prediction"] is not None) == (status == 200)


def test_single_success_values(spark):
    df = spark.createDataFrame([(1, '{"features":[5.1,3.5,1.4,0.2]}')], "req_id long, body string")
    r = score_requests(df, MODEL, as_of="2024-01-01T00:00:00").first()
    assert (r["in_sepal_length"], r["in_petal_width"]) == (5.1, 0.2)
    probs = [r["p_finished"], r["p_open"], r["p_partial"]]
    assert sum(probs) == pytest.approx(1.0)
    assert r["confidence"] == max(probs) and r["prediction"] == probs.index(max(probs))
    assert r["timestamp"] == "2024-01-01T00:00:00"


BATCH = [
    ('{"features":[[5.1,3.5,1.4,0.2],[6.2,2.8,4.8,1.8]]}', 200, None, 2),
    ('{"features":[[5.1,3.5,1.4,0.2],[1]]}', 400, "Sample 1: Expected 4 features, got 1", None),
    ('{"features":[]}', 200, None, 0),
    ('{"features":[["x",1,2,3],[1]]}', 500, R.NOT_NUMERIC, None),
    ('{"features":[[1,2,3,4],null]}', 500, R.NOT_NUMERIC, None),
    ('{"features":"ab"}', 400, "Sample 0: Expected 4 features, got 1", None),
    ('{"features":""}', 200, None, 0),
    ('{"features":{"abc":1}}', 400, "Sample 0: Expected 4 features, got 3", None),
    ('{"features":{"abcd":1}}', 500, R.NOT_NUMERIC, None),
    ('{"features":null}', 500, R.NOT_ITERABLE, None),
    ("{}", 400, R.MISSING, None),
]


def test_batch_request_rules_and_no_partial_output(spark):
    df = spark.createDataFrame([(i, b) for i, (b, *_r) in enumerate(BATCH)], "req_id long, body string")
    summary, preds = score_batch_requests(df, MODEL)
    got = {r["req_id"]: r for r in summary.collect()}
    for i, (body, status, error, total) in enumerate(BATCH):
        assert (got[i]["status"], got[i]["error"], got[i]["total_samples"]) == (status, error, total), body
    p = preds.collect()
    assert sorted((r["req_id"], r["sample_id"]) for r in p) == [(0, 0), (0, 1)]
    assert {r["sample_id"]: r["in_sepal_length"] for r in p} == {0: 5.1, 1: 6.2}


def test_scaler_applied_in_serving(spark):
    sc = spark.createDataFrame([(n, 1.0, 2.0) for n in ["sepal_length", "sepal_width", "petal_length",
                                                        "petal_width"]], "feature string, mean double, scale double")
    m = ServingModel(forest=STANDIN_FOREST, class_names=["a", "b", "c"], scaler=sc)
    df = spark.createDataFrame([(1, '{"features":[5.0,3.0,1.0,0.2]}')], "req_id long, body string")
    r = score_requests(df, m).first()
    # echoed inputs are the raw values; the forest sees (x - 1) / 2
    assert r["in_sepal_length"] == 5.0 and r["status"] == 200
    assert F is not None


def test_spread_is_the_callers_choice(spark):
    from featureflow.operators.serving import spread

    one = spark.createDataFrame([(i, "{}") for i in range(50)], "req_id long, body string").coalesce(1)
    assert spread(one, None) is one
    assert sorted(r["req_id"] for r in spread(one, 7).collect()) == list(range(50))   # same rows, none lost


def test_bodies_that_only_the_reference_parser_takes(spark):
    from featureflow.functions.requests import batch_request, single_request
    single = {  # body -> (status, received, features)
        '{"features":[1,2],"features":[1,2,3,4]}': (200, None, [1.0, 2.0, 3.0, 4.0]),
        '{"features":[1,2,3,4],"features":[1,2]}': (400, 2, None),
        '{"features":[1,2,3,4],"features":null}': (500, None, None),
        '{"a":1,"a":2}': (400, None, None),
        '{"features":[1,NaN,3,4]}': (500, None, None),
        '{"features":[1,-Infinity,3]}': (400, 3, None),
        '{"note":NaN,"features":[1,2,3,4]}': (200, None, [1.0, 2.0, 3.0, 4.0]),
        '{"note":"NaN","x":Infinity,"x":"\\"Infinity","features":[1,2,3,4]}': (200, None, [1.0, 2.0, 3.0, 4.0]),
        'NaN': (500, None, None), 'Infinity': (500, None, None), '[NaN]': (400, None, None),
        '-NaN': (500, None, None), '{"features":[1,INF,3,4]}': (500, None, None), '{"features":[1,+Infinity,3,4]}': (500, None, None),
        '{"features":[1,NaNa,3,4]}': (500, None, None),
    }
    import json
    df = spark.createDataFrame([(b,) for b in single], "body string")
    for r in single_request(df).collect():
        assert (r["status"], r["received"], r["features"]) == single[r["body"]], r["body"]
        try:
            json.loads(r["body"])
        except ValueError:
            assert r["error"] == "Invalid JSON body"
        else:
            assert r["error"] != "Invalid JSON body"
    batch = {'{"features":[[1]],"features":[[1,2,3,4]]}': (200, None), '{"features":[[1,2,3,4],[1,2,Infinity,4],[1]]}': (500, "features must be numbers"),
             '{"features":[[1,2,NaN],[1,2,3,4]]}': (400, "Sample 0: Expected 4 features, got 3"), '{"features":[],"features":NaN}': (500, "features is not iterable")}
    for r in batch_request(spark.createDataFrame([(b,) for b in batch], "body string")).collect():
        assert (r["status"], r["error"]) == batch[r["body"]], r["body"]


def test_batch_documents_inside_the_row_equal_the_joined_ones(spark):
    from featureflow.functions.forest import STANDIN_FOREST
    from featureflow.operators import serving as S
    from featureflow.schema import FEATURE_MEASURES
    from featureflow.sources.standins import OBS_CLASS_NAMES
    scaler = spark.createDataFrame([(n, 1.0 + i, 2.0) for i, n in enumerate(FEATURE_MEASURES)], "feature string, mean double, scale double")
    bodies = ['{"features":[[1,2,0.3,4],[50,90000,0.01,0.02]]}', '{"features":[]}', '{"features":[[1]]}', "nope", "{}", '{"features":""}']
    df = spark.createDataFrame(list(enumerate(bodies)), "req_id int, body string")
    for sc in (None, scaler):
        model = S.ServingModel(STANDIN_FOREST, OBS_CLASS_NAMES, sc)
        own = S.batch_documents(df, model, "now")
        joined = S._joined_documents(*S.score_batch_requests(df, model), model, "now")
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, joined.collect()))
        plan = own._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.replace("BroadcastExchange", "") or sc is not None
