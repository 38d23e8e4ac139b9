import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featureflow.operators.quantile import exact_percentile
from featureflow.operators.requestlog import latency_flags, latency_summary
from featureflow.operators.store import FeatureView, asof_join, hot_cells, latest_features, lookup_latest


def test_exact_percentile_matches_numpy_with_many_buckets(spark):
    rnd = random.Random(7)
    rows = [(g, rnd.choice([rnd.random() * 10, 3.0, 3.0])) for g in ("a", "b", "c") for _ in range(400)]
    rows += [("one", 4.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["p"] for r in exact_percentile(df, "v", 0.95, ["g"], "p", lead_bits=13).collect()}
    for g in ("a", "b", "c", "one"):
        vals = [v for gg, v in rows if gg == g]
        assert got[g] == pytest.approx(float(np.percentile(vals, 95)), abs=1e-12)
    whole = exact_percentile(df, "v", 0.5, [], "p", lead_bits=12).first()["p"]
    assert whole == pytest.approx(float(np.percentile([v for _, v in rows], 50)), abs=1e-12)


def test_exact_percentile_narrowing_on_hot_group(spark):
    # one group holds most rows; a tiny rank budget forces several narrowing
    # rounds
    rnd = random.Random(11)
    rows = [("hot", rnd.expovariate(1.0) ** 3 if i % 4 else 2.0) for i in range(3000)]
    rows += [("cold", rnd.choice([rnd.random(), 0.5])) for _ in range(300)] + [("pair", 1.0), ("pair", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for kw in (dict(lead_bits=2, max_rank_rows=1), dict(lead_bits=14, max_rank_rows=10)):
        for p in (0.95, 0.5, 1.0):
            got = {r["g"]: r["p"] for r in exact_percentile(df, "v", p, ["g"], "p", **kw).collect()}
            for g in ("hot", "cold", "pair"):
                exp = float(np.percentile([v for gg, v in rows if gg == g], p * 100))
                assert got[g] == pytest.approx(exp, rel=1e-12, abs=1e-12), (kw, p, g)


def test_exact_percentile_narrows_ranges_wider_than_a_double(spark):
    big = 1.7e308
    vals = [-big, big, 0.0, 5e-324, 1.0, 2.0, 3.0, big / 2, -1.0, 1e-300] * 3 + [float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = exact_percentile(df, "v", p, [], "p", lead_bits=2, max_rank_rows=1).first()["p"]
        assert got == sorted(vals)[int(p * (len(vals) - 1))], p                     # 31 values: whole ranks


def test_null_group_has_its_percentile(spark):
    rows = [(i, 200, float(i), True, 0.0, None, None if i % 2 else "p") for i in range(1, 12)]
    got = {r["phase"]: r["p95_response_time"] for r in latency_summary(_log(spark, rows), ["phase"]).collect()}
    for phase, odd in ((None, 1), ("p", 0)):
        want = float(np.percentile([float(i) for i in range(1, 12) if i % 2 == odd], 95))
        assert got[phase] == pytest.approx(want, abs=1e-12)
    plain = latency_summary(_log(spark, rows), ["phase"], p=None)
    assert plain.where("p95_response_time IS NOT NULL").count() == 0 and plain.count() == 2


def _log(spark, rows):
    return spark.createDataFrame(rows, "request_id long, status_code int, response_time double, success boolean, "
                                       "timestamp double, error string, phase string")


def test_latency_summary_semantics(spark):
    rows = [(i, 200, 0.1 * (i + 1), True, 100.0 + i, None, "p1") for i in range(10)]
    rows += [(10, 0, 7.0, False, 105.0, "boom", "p1")]
    s = latency_summary(_log(spark, rows), ["phase"]).first()
    assert (s["total_requests"], s["successful_requests"], s["failed_requests"]) == (11, 10, 1)
    assert s["success_rate"] == pytest.approx(100 * 10 / 11)
    assert s["total_time"] == pytest.approx(112.0 - 100.0)  # last end (105 + 7) - first start
    assert s["requests_per_second"] == pytest.approx(11 / 12.0)  # failures count for throughput
    assert s["max_response_time"] == pytest.approx(1.0)        # latencies: successes only
    assert s["p95_response_time"] == pytest.approx(float(np.percentile([0.1 * (i + 1) for i in range(10)], 95)))
    assert s["has_failures"] is True and s["high_latency"] is False and s["timeout_issues"] is False


def test_latency_block_empty_without_success(spark):
    rows = [(0, 0, 1.0, False, 1.0, "x", "p")]
    s = latency_summary(_log(spark, rows), ["phase"]).first()
    assert s["avg_response_time"] is None and s["p95_response_time"] is None and s["high_latency"] is None
    assert latency_flags(latency_summary(_log(spark, rows), ["phase"]), ["phase"]).count() == 0


def _ts(h, m=0, s=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m, seconds=s)


def _brute_asof(spine, feats, ttl):
    out = {}
    for sid, key, t in spine:
        cands = [f for f in feats if f[0] == key and f[1] <= t and (ttl is None or f[1] >= t - ttl)]
        best = max(cands, key=lambda f: (f[1], f[2], f[3])) if cands else None
        out[sid] = None if best is None else best[4]
    return out


def test_asof_join_matches_brute_force_with_hot_key(spark):
    rnd = random.Random(3)
    feats = []
    for i in range(600):
        key = 0 if i < 300 else rnd.randint(1, 20)          # key 0 holds half of the rows
        t = _ts(rnd.randint(0, 200), rnd.randint(0, 59))
        created = t + dt.timedelta(seconds=rnd.choice([0, 1, 2]))
        feats.append((key, t, created, i, float(i)))
    spine = [(j, 0 if j % 2 == 0 else rnd.randint(1, 25), _ts(rnd.randint(0, 210), rnd.randint(0, 59)))
             for j in range(400)]
    spine += [(1000, feats[0][0], feats[0][1])]              # equal timestamps: feature counts
    ttl = dt.timedelta(hours=5)
    sdf = spark.createDataFrame(spine, "sid long, key long, ts timestamp_ntz")
    fdf = spark.createDataFrame(feats, "key long, ets timestamp_ntz, cts timestamp_ntz, fid long, val double")
    # fixed widths, the data-driven width, and a tiny cell budget that makes
    # the hot key's cells a few minutes wide
    for bucket, cell in ((dt.timedelta(hours=1), None), (dt.timedelta(days=30), None), (None, 1_000_000),
                         (None, 2)):
        for t in (ttl, None):
            view = FeatureView("v", "key", "ets", ["val"], created_ts="cts", ttl=t, as_float=False,
                               tiebreak=["fid"])
            kw = {"max_cell_rows": cell} if cell else {}
            got = {r["sid"]: r["val"] for r in asof_join(sdf, fdf, view, "ts", bucket=bucket, **kw).collect()}
            assert got == _brute_asof(spine, feats, t), (bucket, cell, t)


def test_only_hot_cells_are_cut(spark):
    # key 0: 100 rows in one microsecond range of a second; key 1: one row an hour
    rows = spark.range(100).selectExpr("0L AS __k", "7 * id AS __us").unionByName(
        spark.range(100).selectExpr("1L AS __k", "3600000000 * id AS __us"))
    assert hot_cells(rows, 1000) == []
    levels = hot_cells(rows, 50)      # all of key 0 stays in one cell down to 2**14 microseconds
    assert [[tuple(r) for r in level.collect()] for level in levels] == [[(0, 0)]] * 4


def test_asof_join_with_a_dense_microsecond_and_negative_times(spark):
    old = dt.datetime(1960, 1, 1)
    feats = [(i % 2, old + dt.timedelta(microseconds=i // 4), old, i, float(i)) for i in range(200)]
    spine = [(j, j % 3, old + dt.timedelta(microseconds=j)) for j in range(-5, 60)]
    spine += [(100, None, old), (101, 0, None)]
    sdf = spark.createDataFrame(spine, "sid long, key long, ts timestamp_ntz")
    fdf = spark.createDataFrame(feats, "key long, ets timestamp_ntz, cts timestamp_ntz, fid long, val double")
    view = FeatureView("v", "key", "ets", ["val"], created_ts="cts", as_float=False, tiebreak=["fid"])
    expect = _brute_asof([s for s in spine if s[0] < 100], feats, None) | {100: None, 101: None}
    for cell in (1, 3, 1000):
        assert {r["sid"]: r["val"] for r in asof_join(sdf, fdf, view, "ts", max_cell_rows=cell).collect()} == expect


def test_asof_ttl_bound_is_inclusive(spark):
    sdf = spark.createDataFrame([(1, 1, _ts(10))], "sid long, key long, ts timestamp_ntz")
    fdf = spark.createDataFrame([(1, _ts(9), 2.5)], "key long, ets timestamp_ntz, val double")
    view = FeatureView("v", "key", "ets", ["val"], ttl=dt.timedelta(hours=1))
    r = asof_join(sdf, fdf, view, "ts").first()
    assert r["val"] == 2.5 and isinstance(r["val"], float)
    view2 = FeatureView("v", "key", "ets", ["val"], ttl=dt.timedelta(minutes=59))
    assert asof_join(sdf, fdf, view2, "ts").first()["val"] is None


def test_latest_and_lookup(spark):
    fdf = spark.createDataFrame([(1, _ts(1), _ts(1), 1.0), (1, _ts(3), _ts(3), 3.0), (1, _ts(3), _ts(4), 4.0),
                                 (2, _ts(2), _ts(2), 2.0), (1, _ts(50), _ts(50), 9.0)],
                                "key long, ets timestamp_ntz, cts timestamp_ntz, val double")
    view = FeatureView("v", "key", "ets", ["val"], created_ts="cts", ttl=dt.timedelta(hours=2))
    latest = latest_features(fdf, view, _ts(0), _ts(10))
    got = {r["key"]: r["val"] for r in latest.collect()}
    assert got == {1: 4.0, 2: 2.0}
    keys = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    look = {r["key"]: r["val"] for r in lookup_latest(keys, latest, view, _ts(4)).collect()}
    assert look == {1: 4.0, 2: 2.0, 3: None}      # 2 hours old: still inside the inclusive TTL
    look = {r["key"]: r["val"] for r in lookup_latest(keys, latest, view, _ts(4, 30)).collect()}
    assert look == {1: 4.0, 2: None, 3: None}
    assert F is not None


def test_no_nested_loop_or_cartesian_joins(spark):
    # the global percentile, the grouped percentile, the as-of join and the
    # exact rank must stay equi-joins or literal filters
    from featureflow.operators.ranking import row_index
    from featureflow.operators.split import stratified_split

    vals = spark.createDataFrame([(g, float(i % 37)) for g in ("a", "b") for i in range(200)], "g string, v double")
    spine = spark.createDataFrame([(1, 1, _ts(5))], "sid long, key long, ts timestamp_ntz")
    feats = spark.createDataFrame([(1, _ts(4), 1.0)], "key long, ets timestamp_ntz, val double")
    ids = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, label int")
    frames = [exact_percentile(vals, "v", 0.95, [], "p", max_rank_rows=5),
              exact_percentile(vals, "v", 0.95, ["g"], "p", max_rank_rows=5),
              asof_join(spine, feats, FeatureView("v", "key", "ets", ["val"], ttl=dt.timedelta(hours=2)), "ts"),
              stratified_split(ids, "id", "label"), row_index(ids, "id")]
    for df in frames:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, plan


def test_asof_null_keys_match_nothing_at_any_bucket_width(spark):
    from datetime import datetime, timedelta
    from featureflow.operators.store import FeatureView, asof_join
    at = datetime(2024, 1, 1)
    feats = spark.createDataFrame([(None, at, at, 7.0), (1, at, at, 8.0)],
                                  "k int, ts timestamp_ntz, created timestamp_ntz, x double")
    spine = spark.createDataFrame([(None, at + timedelta(minutes=30)), (1, at + timedelta(minutes=30))], "k int, t timestamp_ntz")
    view = FeatureView(name="v", key="k", features=["x"], event_ts="ts", created_ts="created")
    got = {r.k: r.x for r in asof_join(spine, feats, view, "t").collect()}
    assert got == {None: None, 1: 8.0}


def test_latest_lookup_reads_the_materialized_table(spark):
    from conftest import SF0001
    from featureflow.plans.catalog import LATEST_END, LATEST_START, LOOKUP_AS_OF, QUERIES, VIEW
    from featureflow.operators.store import latest_features, lookup_latest
    from featureflow.session import table
    from featureflow.sources.standins import feature_events

    got = QUERIES["latest_lookup"](spark, SF0001)
    assert any("online-latest" in f for f in got.inputFiles())
    keys = table(spark, SF0001, "customer").selectExpr("c_custkey AS user_id")
    want = lookup_latest(keys, latest_features(feature_events(spark, SF0001), VIEW, LATEST_START, LATEST_END), VIEW, LOOKUP_AS_OF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_materialize_overwrites(spark, tmp_path):
    from featureflow.operators.store import materialize
    from featureflow.sources.versions import read_table

    for n in (5, 2):
        materialize(spark.range(n), str(tmp_path / "online"))
    assert read_table(spark, str(tmp_path / "online")).count() == 2


def test_a_failed_load_leaves_the_old_rows(spark, tmp_path):
    from featureflow.sources.files import load_table, write_csv
    from featureflow.sources.versions import read_table, replace_table

    good, target = str(tmp_path / "good"), str(tmp_path / "table")
    schema = spark.range(1).selectExpr("id AS k", "cast(id AS double) AS v").schema
    write_csv(spark.range(40).selectExpr("id AS k", "cast(id AS double) AS v"), good)
    assert load_table(spark, good, schema, target) == 40
    before = read_table(spark, target)
    (tmp_path / "bad").mkdir()  # many good rows, then a malformed one: the write fails half way
    (tmp_path / "bad" / "a.csv").write_text("k,v\n" + "".join(f"{i},{i}.5\n" for i in range(500)))
    (tmp_path / "bad" / "b.csv").write_text("k,v\n1,x\n")
    with pytest.raises(Exception):
        load_table(spark, str(tmp_path / "bad"), schema, target)
    with pytest.raises(Exception):  # columns that do not conform
        replace_table(spark.range(3), target, schema)
    assert read_table(spark, target).agg(F.sum("v")).first()[0] == sum(range(40))
    replace_table(spark.range(3).selectExpr("id AS k", "1.0D AS v"), target, schema)
    assert read_table(spark, target).count() == 3 and before.count() == 40  # a reader of the old version keeps it
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none"))


def test_catalog_table_points_to_the_new_version(spark, tmp_path):
    from featureflow.sources.files import load_table, write_csv

    schema, name = spark.range(1).schema, "versions_" + tmp_path.name.replace("-", "_")
    for n in (7, 4):
        write_csv(spark.range(n), str(tmp_path / "csv"))
        assert load_table(spark, str(tmp_path / "csv"), schema, str(tmp_path / "t"), name) == n
    assert spark.table(name).count() == 4
    spark.sql(f"DROP TABLE {name}")


def test_load_table_infers_on_request(spark, tmp_path):
    from featureflow.sources.files import load_table, write_csv

    src, target = str(tmp_path / "csv"), str(tmp_path / "table")
    write_csv(spark.createDataFrame([(1, 2.5, "a"), (2, 3.5, "b")], "k long, v double, s string"), src)
    assert load_table(spark, src, None, target, infer=True) == 2
    from featureflow.sources.versions import read_table
    assert dict(read_table(spark, target).dtypes) == {"k": "int", "v": "double", "s": "string"}
    with pytest.raises(ValueError):
        load_table(spark, src, None, target)


def test_ordered_bits_order_like_the_values(spark):
    from featureflow.operators.quantile import lead, ordered_bits
    vals = [float("-inf"), -1.7e308, -2.0, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 3.0, 1.7e308, float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v double")
    got = [(r["b"], r["l"]) for r in df.select("i", ordered_bits(F.col("v")).alias("b"), lead(F.col("v"), 3).alias("l")).orderBy("i").collect()]
    bits, leads = [b for b, _ in got], [x for _, x in got]
    assert bits == sorted(bits) and leads == sorted(leads) and len(set(bits)) == len(vals) - 1 and bits[5] == bits[6]


def test_percentile_of_latencies_takes_two_passes(spark):
    # cells of the one aggregate name the rows to rank: no pass looks for boundaries
    log = spark.range(4000).selectExpr("id AS request_id", "cast(id % 997 AS double) / 10 AS response_time", "id % 7 <> 0 AS success",
                                       "cast(id AS double) AS timestamp", "cast(id % 3 AS int) AS phase")
    log = log.unionByName(log.where("request_id < 5").selectExpr("request_id", "response_time", "success", "timestamp", "cast(null AS int) AS phase"))
    rows = log.collect()
    for r in latency_summary(log, ["phase"]).collect():
        good = [x["response_time"] for x in rows if x["phase"] == r["phase"] and x["success"]]
        own = [x for x in rows if x["phase"] == r["phase"]]
        assert r["p95_response_time"] == pytest.approx(float(np.percentile(good, 95)), abs=1e-12)
        assert r["avg_response_time"] == pytest.approx(np.mean(good)) and r["total_requests"] == len(own)
        assert (r["min_response_time"], r["max_response_time"]) == (min(good), max(good))
    approx = latency_summary(log, [], approx=True).first()
    assert approx["p95_response_time"] == pytest.approx(float(np.percentile([x["response_time"] for x in rows if x["success"]], 95)), abs=0.2)
    empty = latency_summary(log.limit(0)).first()
    assert empty["total_requests"] == 0 and empty["p95_response_time"] is None and empty["high_latency"] is None
