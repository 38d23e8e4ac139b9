"""Independent DuckDB SQL for each registered query (tables are views named
after the driver's parquet files). Written by hand from the operator
semantics, not generated from the Spark code."""

from __future__ import annotations

OBS = """
obs AS (
  SELECT l.obs_id, l.f1, l.f2, l.f3, l.f4, o.o_orderstatus AS label, o.o_orderdate AS ts
  FROM (SELECT l_orderkey AS obs_id, max(l_quantity) AS f1, max(l_extendedprice) AS f2,
               max(l_discount) AS f3, max(l_tax) AS f4
        FROM lineitem GROUP BY l_orderkey) l
  JOIN orders o ON o.o_orderkey = l.obs_id
)"""

ORACLE: dict[str, str] = {}

ORACLE["feature_ratios"] = f"""
WITH {OBS}
SELECT obs_id, f1 AS sepal_length, f2 AS sepal_width, f3 AS petal_length, f4 AS petal_width,
       f1 / f2 AS sepal_ratio, f3 / f4 AS petal_ratio, f1 * f2 + f3 * f4 AS total_area, label
FROM obs
"""

ORACLE["row_index"] = f"""
WITH {OBS}, r AS (SELECT obs_id, row_number() OVER (ORDER BY obs_id) - 1 AS row_index FROM obs)
SELECT obs_id, row_index,
       TIMESTAMP '2024-06-01 00:00:00' - row_index * INTERVAL 1 HOUR AS event_timestamp
FROM r
"""

ORACLE["label_lookup"] = f"""
WITH {OBS}
SELECT obs_id, f1 AS "sepal length (cm)", f2 AS "sepal width (cm)", f3 AS "petal length (cm)",
       f4 AS "petal width (cm)",
       CAST(CASE label WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS INTEGER) AS target,
       CASE label WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS target_name,
       TIMESTAMP '2024-06-01 12:00:00' AS "timestamp"
FROM obs
"""

ORACLE["snapshot_head"] = f"""
WITH {OBS}
SELECT obs_id, f1 AS "sepal length (cm)", f2 AS "sepal width (cm)", f3 AS "petal length (cm)",
       f4 AS "petal width (cm)",
       CAST(CASE label WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS INTEGER) AS target,
       CASE label WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS target_name,
       TIMESTAMP '2024-06-01 12:00:00' AS "timestamp"
FROM obs ORDER BY obs_id LIMIT 5
"""

ORACLE["snapshot_shape"] = f"""
WITH {OBS}
SELECT count(*) AS "rows", CAST(8 AS INTEGER) AS "columns" FROM obs
"""

ORACLE["feature_table"] = f"""
WITH {OBS}, r AS (SELECT *, row_number() OVER (ORDER BY obs_id) - 1 AS idx FROM obs)
SELECT CAST(idx AS VARCHAR) AS entity_id, f1 AS sepal_length, f2 AS sepal_width,
       f3 AS petal_length, f4 AS petal_width, f1 / f2 AS sepal_ratio, f3 / f4 AS petal_ratio,
       f1 * f2 + f3 * f4 AS total_area,
       TIMESTAMP '2024-06-01 00:00:00' - idx * INTERVAL 1 HOUR AS event_timestamp,
       TIMESTAMP '2024-06-01 12:00:00' AS created_timestamp
FROM r
"""

SPLIT = """
h AS (SELECT *, md5(CAST(obs_id AS VARCHAR) || ':42') AS hsh FROM obs),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hsh, obs_id) - 1 AS class_rank FROM h),
c AS (SELECT label, count(*) AS n_c FROM obs GROUP BY label),
t AS (SELECT CAST(sum(n_c) AS BIGINT) AS n,
             CAST(sum(n_c) AS BIGINT) - CAST(ceil(CAST(0.2 AS DOUBLE) * CAST(sum(n_c) AS DOUBLE)) AS BIGINT) AS n_train
      FROM c),
a AS (SELECT c.label, (CAST(c.n_c AS HUGEINT) * t.n_train) // t.n AS fl,
             (CAST(c.n_c AS HUGEINT) * t.n_train) % t.n AS rem, t.n_train FROM c, t),
b AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= n_train - sum(fl) OVER ()
                              THEN 1 ELSE 0 END AS n_train_c FROM a),
sp AS (SELECT r.*, CASE WHEN r.class_rank < b.n_train_c THEN 'train' ELSE 'test' END AS split
       FROM r JOIN b USING (label))"""

ORACLE["stratified_split"] = f"""
WITH {OBS}, {SPLIT}
SELECT obs_id, label, split, class_rank FROM sp
"""

ORACLE["stratified_folds"] = f"""
WITH {OBS}, {SPLIT}
SELECT obs_id, label, CAST(class_rank % 5 AS INTEGER) AS fold FROM sp WHERE split = 'train'
"""

_EPS = "2.220446049250313e-16"


def _scale_sql(c: str) -> str:
    return (f"CASE WHEN var_pop({c}) <= count(*) * {_EPS} * var_pop({c}) + power(count(*) * avg({c}) * {_EPS}, 2) "
            f"THEN 1.0 ELSE sqrt(var_pop({c})) END")


STATS = "st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, {_scale_sql(c)} AS s_{c}" for c in ["f1", "f2", "f3", "f4"]
) + " FROM sp WHERE split = 'train')"

ORACLE["scaler_stats"] = f"""
WITH {OBS}, {SPLIT}, {STATS}
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS scale FROM st"
    for c in ["f1", "f2", "f3", "f4"])

SCALED = "sc AS (SELECT sp.obs_id, sp.split, sp.label, " + ", ".join(
    f"(sp.{c} - st.m_{c}) / st.s_{c} AS {c}" for c in ["f1", "f2", "f3", "f4"]) + " FROM sp, st)"

ORACLE["scaled_rows"] = f"""
WITH {OBS}, {SPLIT}, {STATS}, {SCALED}
SELECT obs_id, split, label, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, round(f4, 6) AS f4
FROM sc
"""

ORACLE["align_features_labels"] = """
SELECT f.obs_id, f.f1, f.f2, f.f3, f.f4, o.o_orderstatus AS label
FROM (SELECT l_orderkey AS obs_id, max(l_quantity) AS f1, max(l_extendedprice) AS f2,
             max(l_discount) AS f3, max(l_tax) AS f4 FROM lineitem GROUP BY l_orderkey) f
JOIN orders o ON o.o_orderkey = f.obs_id
"""

ORACLE["alignment_report"] = """
WITH f AS (SELECT l_orderkey AS obs_id, count(*) AS nf FROM lineitem GROUP BY l_orderkey),
     l AS (SELECT o_orderkey AS obs_id, count(*) AS nl FROM orders GROUP BY o_orderkey),
     j AS (SELECT f.nf, l.nl FROM f FULL OUTER JOIN l ON f.obs_id = l.obs_id)
SELECT count(*) FILTER (WHERE nf IS NOT NULL AND nl IS NOT NULL) AS matched_keys,
       count(*) FILTER (WHERE nl IS NULL) AS features_only_keys,
       count(*) FILTER (WHERE nf IS NULL) AS labels_only_keys,
       count(*) FILTER (WHERE nf > 1) AS repeated_feature_keys,
       count(*) FILTER (WHERE nl > 1) AS repeated_label_keys,
       CAST(coalesce(sum(nf * nl), 0) AS BIGINT) AS joined_rows
FROM j
"""

_VF = """
vf AS (SELECT obs_id, f1 AS sepal_length, f2 AS sepal_width, f3 AS petal_length, f4 AS petal_width,
              f1 / f2 AS sepal_ratio, f3 / f4 AS petal_ratio, f1 * f2 + f3 * f4 AS total_area, label FROM obs)"""
_VCOLS = ["obs_id", "sepal_length", "sepal_width", "petal_length", "petal_width",
          "sepal_ratio", "petal_ratio", "total_area", "label"]
_MEAS = ["sepal_length", "sepal_width", "petal_length", "petal_width"]


def _nullcond(c: str) -> str:
    return f"{c} IS NULL" if c in ("obs_id", "label") else f"({c} IS NULL OR isnan({c}))"


_vrows = [f"SELECT 'required_column' AS rule, '{c}' AS \"column\", 1.0::DOUBLE AS observed, "
          f"1.0::DOUBLE AS threshold, true AS passed" for c in [*_MEAS, "label"]]
_vrows.append("SELECT 'column_count', '*', 9.0, 9.0, true")
_vrows.append("SELECT 'row_count', '*', (SELECT count(*) FROM vf)::DOUBLE, (SELECT count(*) FROM orders)::DOUBLE, "
              "(SELECT count(*) FROM vf) = (SELECT count(*) FROM orders)")
for _c in _VCOLS:
    _vrows.append(f"SELECT 'null_count', '{_c}', count(*) FILTER (WHERE {_nullcond(_c)})::DOUBLE, 0.0, "
                  f"count(*) FILTER (WHERE {_nullcond(_c)}) = 0 FROM vf")
_tot = " + ".join(f"count(*) FILTER (WHERE {_nullcond(c)})" for c in _VCOLS)
_vrows.append(f"SELECT 'null_count', '*', ({_tot})::DOUBLE, 0.0, ({_tot}) = 0 FROM vf")
_vrows.append("SELECT 'distinct_count', 'label', count(DISTINCT label)::DOUBLE, 3.0, count(DISTINCT label) = 3 FROM vf")
for _c in ["sepal_ratio", "petal_ratio"]:
    _vrows.append(f"SELECT 'infinite_count', '{_c}', count(*) FILTER (WHERE abs({_c}) = 'infinity'::DOUBLE)::DOUBLE, "
                  f"0.0, count(*) FILTER (WHERE abs({_c}) = 'infinity'::DOUBLE) = 0 FROM vf")
for _c in _MEAS:
    _vrows.append(f"SELECT 'std_positive', '{_c}', round(stddev_samp({_c}), 6), 0.0, "
                  f"coalesce(stddev_samp({_c}) > 0, false) FROM vf")
for _c in _MEAS:
    _vrows.append(f"SELECT 'min_non_negative', '{_c}', min({_c}), 0.0, coalesce(min({_c}) >= 0, false) FROM vf")

ORACLE["validation_report"] = f"WITH {OBS}, {_VF}\n" + "\nUNION ALL\n".join(_vrows)

_drows = ["SELECT 'same_columns' AS rule, '*' AS \"column\", 1.0::DOUBLE AS observed, 1.0::DOUBLE AS threshold, "
          "true AS passed"]
for _c in ["f1", "f2", "f3", "f4"]:
    _gap = f"abs(avg({_c}) FILTER (WHERE split = 'train') - avg({_c}) FILTER (WHERE split = 'test'))"
    _drows.append(f"SELECT 'mean_gap', '{_c}', round({_gap}, 6), 1.0, coalesce({_gap} < 1.0, false) FROM sc")
ORACLE["split_drift"] = f"WITH {OBS}, {SPLIT}, {STATS}, {SCALED}\n" + "\nUNION ALL\n".join(_drows)

# Hand-written CASE form of the three-tree stand-in forest (classes F, O, P)
# over columns f1..f4 of ``src``; adds p0..p2, prediction, predicted_label, conf.
def forest_ctes(src: str, out: str = "sc", trees: int = 3) -> str:
    mean = [" + ".join(f"{t}{i}" for t in "abc"[:trees]) for i in range(3)]
    return f"""
{out}_tr AS (SELECT *,
  CASE WHEN f3 <= 0.07::DOUBLE THEN 0.5::DOUBLE WHEN f1 <= 42.0::DOUBLE THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS a0,
  CASE WHEN f3 <= 0.07::DOUBLE THEN 0.3::DOUBLE WHEN f1 <= 42.0::DOUBLE THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS a1,
  CASE WHEN f3 <= 0.07::DOUBLE THEN 0.2::DOUBLE WHEN f1 <= 42.0::DOUBLE THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS a2,
  CASE WHEN f2 <= 87000.0::DOUBLE THEN (CASE WHEN f4 <= 0.06::DOUBLE THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END)
       ELSE 0.2::DOUBLE END AS b0,
  CASE WHEN f2 <= 87000.0::DOUBLE THEN (CASE WHEN f4 <= 0.06::DOUBLE THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END)
       ELSE 0.3::DOUBLE END AS b1,
  CASE WHEN f2 <= 87000.0::DOUBLE THEN (CASE WHEN f4 <= 0.06::DOUBLE THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END)
       ELSE 0.5::DOUBLE END AS b2,
  CASE WHEN f4 <= 0.04::DOUBLE THEN 0.4::DOUBLE WHEN f3 <= 0.09::DOUBLE THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS c0,
  CASE WHEN f4 <= 0.04::DOUBLE THEN 0.4::DOUBLE WHEN f3 <= 0.09::DOUBLE THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS c1,
  CASE WHEN f4 <= 0.04::DOUBLE THEN 0.2::DOUBLE WHEN f3 <= 0.09::DOUBLE THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS c2
  FROM {src}),
{out}_pr AS (SELECT *, ({mean[0]}) / {trees}::DOUBLE AS p0, ({mean[1]}) / {trees}::DOUBLE AS p1,
              ({mean[2]}) / {trees}::DOUBLE AS p2 FROM {out}_tr),
{out}_fs AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction
             FROM {out}_pr),
{out} AS (SELECT *, CASE prediction WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS predicted_label,
              greatest(p0, p1, p2) AS conf FROM {out}_fs)"""


FOREST = forest_ctes("obs")

ORACLE["forest_score"] = f"""
WITH {OBS}, {FOREST}
SELECT obs_id, label, CAST(prediction AS INTEGER) AS prediction, predicted_label,
       round(p0, 6) AS p_F, round(p1, 6) AS p_O, round(p2, 6) AS p_P, round(conf, 6) AS confidence
FROM sc
"""

PAIRS = """
cls AS (SELECT label AS c FROM sc UNION SELECT predicted_label FROM sc),
pairs AS (SELECT label AS actual, predicted_label AS predicted, count(*) AS n FROM sc GROUP BY 1, 2),
cm AS (SELECT a.c AS actual, b.c AS predicted, coalesce(p.n, 0) AS n
       FROM cls a CROSS JOIN cls b LEFT JOIN pairs p ON p.actual = a.c AND p.predicted = b.c),
st AS (SELECT c AS cls,
              (SELECT coalesce(sum(n), 0) FROM pairs WHERE actual = c) AS support,
              (SELECT coalesce(sum(n), 0) FROM pairs WHERE predicted = c) AS pred_n,
              (SELECT coalesce(sum(n), 0) FROM pairs WHERE actual = c AND predicted = c) AS tp FROM cls),
mt AS (SELECT cls, support, tp,
              CASE WHEN pred_n = 0 THEN 0.0 ELSE tp::DOUBLE / pred_n END AS prec,
              CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS rec,
              CASE WHEN support + pred_n = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (support + pred_n) END AS f1
       FROM st)"""

ORACLE["metric_gates"] = f"""
WITH {OBS}, {FOREST}, {PAIRS}, acc AS (SELECT sum(tp)::DOUBLE / sum(support) AS a FROM mt)
SELECT 'accuracy' AS metric, round(a, 6) AS observed, 0.85::DOUBLE AS threshold,
       CASE WHEN a > 0.85 THEN 'passed' ELSE 'failed' END AS status
FROM acc
UNION ALL
SELECT 'cv_score', NULL::DOUBLE, 0.80::DOUBLE, 'skipped'
"""

ORACLE["class_name_join"] = f"""
WITH {OBS}
SELECT obs_id, label,
       CASE label WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS class_name
FROM obs
"""

ORACLE["confusion_matrix"] = f"""
WITH {OBS}, {FOREST}, {PAIRS}
SELECT actual, predicted, CAST(n AS BIGINT) AS n FROM cm
"""

ORACLE["confusion_matrix_lines"] = f"""
WITH {OBS}, {FOREST}, {PAIRS}
SELECT actual, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY predicted) AS line FROM cm GROUP BY actual
"""

ORACLE["classification_report"] = f"""
WITH {OBS}, {FOREST}, {PAIRS}
SELECT cls AS label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM mt
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 6), CAST(sum(support) AS BIGINT) FROM mt
UNION ALL
SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM mt
UNION ALL
SELECT 'weighted avg', round(sum(support * prec) / sum(support), 6), round(sum(support * rec) / sum(support), 6),
       round(sum(support * f1) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM mt
"""

ORACLE["evaluation_report"] = f"""
WITH {OBS}, {FOREST}, {PAIRS}
SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
       round(sum(support * prec) / sum(support), 6) AS precision,
       round(sum(support * rec) / sum(support), 6) AS recall,
       round(sum(support * f1) / sum(support), 6) AS f1_score
FROM mt
"""

REQ = """
ev AS (SELECT event_id AS req_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value
       FROM events),
x AS (SELECT req_id, event_type, k, CAST(k AS DOUBLE) / 2.0::DOUBLE AS x1, value * 300.0::DOUBLE AS x2,
             CAST(k % 11 AS DOUBLE) / 100.0::DOUBLE AS x3, CAST(k % 9 AS DOUBLE) / 100.0::DOUBLE AS x4 FROM ev)"""

_MISSING = "'Missing features in request body'"
_BADLEN = "'Expected 4 features (sepal_length, sepal_width, petal_length, petal_width)'"
_NOTJSON = "'Invalid JSON body'"
_NOLEN = "'features has no length'"
_NOTNUM = "'features must be numbers'"

REQUEST_RULES = f"""
{REQ},
q AS (SELECT req_id,
   CASE WHEN event_type = 'view' THEN 200 WHEN event_type IN ('click', 'signup') THEN 400
        WHEN event_type = 'error' THEN 500
        ELSE CASE k % 4 WHEN 0 THEN 500 WHEN 1 THEN 400 WHEN 2 THEN 500 ELSE 200 END END AS status,
   CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN {_BADLEN}
        WHEN event_type = 'signup' THEN {_MISSING}
        WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN {_NOTJSON} ELSE {_NOLEN} END
        ELSE CASE k % 4 WHEN 0 THEN {_NOTNUM} WHEN 1 THEN {_BADLEN} WHEN 2 THEN {_NOTNUM} ELSE NULL END END AS error,
   CASE WHEN event_type = 'click' THEN 2 WHEN event_type = 'purchase' AND k % 4 = 1 THEN 5 END AS received,
   CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE x1 END AS f1, x2 AS f2, x3 AS f3, x4 AS f4
   FROM x)"""

ORACLE["request_score"] = f"""
WITH {REQUEST_RULES},
ok AS (SELECT * FROM q WHERE status = 200),
{forest_ctes("ok", "sc")}
SELECT q.req_id, CAST(q.status AS INTEGER) AS status, q.error, CAST(q.received AS INTEGER) AS received,
       q.status = 200 AS success,
       sc.f1 AS in_sepal_length, sc.f2 AS in_sepal_width, sc.f3 AS in_petal_length, sc.f4 AS in_petal_width,
       CAST(sc.prediction AS INTEGER) AS prediction,
       CASE sc.prediction WHEN 0 THEN 'finished' WHEN 1 THEN 'open' WHEN 2 THEN 'partial' END AS class_name,
       round(sc.p0, 6) AS p_finished, round(sc.p1, 6) AS p_open, round(sc.p2, 6) AS p_partial,
       round(sc.conf, 6) AS confidence
FROM q LEFT JOIN sc ON sc.req_id = q.req_id
"""

ORACLE["request_batch_score"] = f"""
WITH {REQ}
SELECT req_id,
   CAST(CASE WHEN event_type IN ('view', 'signup') THEN 200 WHEN event_type = 'click' THEN 400 ELSE 500 END
        AS INTEGER) AS status,
   CASE WHEN event_type IN ('view', 'signup') THEN NULL
        WHEN event_type = 'click' THEN 'Sample 1: Expected 4 features, got 1' ELSE {_NOTNUM} END AS error,
   event_type IN ('view', 'signup') AS success,
   CAST(CASE WHEN event_type = 'view' THEN 2 WHEN event_type = 'signup' THEN 0 END AS INTEGER) AS total_samples
FROM x
"""

ORACLE["request_batch_predictions"] = f"""
WITH {REQ},
s AS (SELECT req_id, 0 AS sample_id, x1 AS f1, x2 AS f2, x3 AS f3, x4 AS f4 FROM x WHERE event_type = 'view'
      UNION ALL
      SELECT req_id, 1, x4, x3, x2, x1 FROM x WHERE event_type = 'view'),
{forest_ctes("s", "sc")}
SELECT req_id, CAST(sample_id AS INTEGER) AS sample_id,
       f1 AS in_sepal_length, f2 AS in_sepal_width, f3 AS in_petal_length, f4 AS in_petal_width,
       CAST(prediction AS INTEGER) AS prediction,
       CASE prediction WHEN 0 THEN 'finished' WHEN 1 THEN 'open' WHEN 2 THEN 'partial' END AS class_name,
       round(p0, 6) AS p_finished, round(p1, 6) AS p_open, round(p2, 6) AS p_partial, round(conf, 6) AS confidence
FROM sc
"""

LOG = """
lg AS (SELECT event_id AS request_id, CAST(CASE WHEN event_type <> 'error' THEN 200 ELSE 500 END AS INTEGER) AS status_code,
              value AS response_time, event_type <> 'error' AS success,
              epoch_us(ts) / 1000000.0::DOUBLE AS "timestamp",
              CASE WHEN event_type <> 'error' THEN NULL ELSE 'server error' END AS error,
              strftime(ts, '%Y-%m-%d') AS phase
       FROM events)"""


def _latency_sql(group: str) -> str:
    sel = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    ok = "FILTER (WHERE success)"
    wall = '(max("timestamp" + response_time) - min("timestamp"))'
    return f"""
WITH {LOG}
SELECT {sel}count(*) AS total_requests, count(*) {ok} AS successful_requests,
       count(*) FILTER (WHERE NOT success) AS failed_requests,
       round(100.0::DOUBLE * count(*) {ok} / count(*), 6) AS success_rate,
       round({wall}, 6) AS total_time,
       round(CASE WHEN {wall} > 0 THEN count(*) / {wall} END, 6) AS requests_per_second,
       round(avg(response_time) {ok}, 6) AS avg_response_time,
       round(min(response_time) {ok}, 6) AS min_response_time,
       round(max(response_time) {ok}, 6) AS max_response_time,
       round(quantile_cont(response_time, 0.95) {ok}, 6) AS p95_response_time,
       CASE WHEN count(*) {ok} > 0 THEN avg(response_time) {ok} > 1.0 END AS high_latency,
       CASE WHEN count(*) {ok} > 0 THEN count(*) FILTER (WHERE NOT success) > 0 END AS has_failures,
       CASE WHEN count(*) {ok} > 0 THEN max(response_time) {ok} > 5.0 END AS timeout_issues
FROM lg {gb}
"""


ORACLE["latency_summary"] = _latency_sql("")
ORACLE["latency_by_phase"] = _latency_sql("phase")

ORACLE["latency_flags"] = f"""
WITH {LOG},
s AS (SELECT phase, avg(response_time) FILTER (WHERE success) AS a, max(response_time) FILTER (WHERE success) AS mx,
             count(*) FILTER (WHERE NOT success) AS nf, count(*) FILTER (WHERE success) AS ns
      FROM lg GROUP BY phase)
SELECT phase, 'high_latency' AS flag, round(a, 6) AS observed, 1.0::DOUBLE AS threshold, a > 1.0 AS raised FROM s WHERE ns > 0
UNION ALL
SELECT phase, 'failed_requests', round(nf::DOUBLE, 6), 0.0::DOUBLE, nf > 0 FROM s WHERE ns > 0
UNION ALL
SELECT phase, 'timeout_issues', round(mx, 6), 5.0::DOUBLE, mx > 5.0 FROM s WHERE ns > 0
"""

ORACLE["request_log_roundtrip"] = f"""
WITH {LOG}
SELECT * FROM lg
"""

FV = """
sp AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
fv AS (SELECT user_id, ts AS event_timestamp, ts AS created_timestamp, event_id AS feature_event_id,
              value AS view_value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS view_k
       FROM events WHERE event_type = 'view')"""

ORACLE["asof_features"] = f"""
WITH {FV},
j AS (SELECT sp.event_id, sp.user_id, sp.ts, fv.event_timestamp AS fts, fv.view_value, fv.view_k
      FROM sp ASOF LEFT JOIN fv ON sp.user_id = fv.user_id AND sp.ts >= fv.event_timestamp)
SELECT event_id, user_id, ts,
       CASE WHEN fts >= ts - INTERVAL 1 DAY THEN CAST(view_value AS FLOAT) END AS view_value,
       CASE WHEN fts >= ts - INTERVAL 1 DAY THEN CAST(view_k AS FLOAT) END AS view_k,
       CASE WHEN fts >= ts - INTERVAL 1 DAY THEN fts END AS feature_timestamp
FROM j
"""

LATEST = """
lt AS (SELECT user_id, event_timestamp, view_value, view_k FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id
                                      ORDER BY event_timestamp DESC, created_timestamp DESC, feature_event_id DESC) AS rn
         FROM fv WHERE event_timestamp >= TIMESTAMP '2024-01-10 00:00:00'
                   AND event_timestamp <= TIMESTAMP '2024-01-20 00:00:00') WHERE rn = 1)"""

ORACLE["latest_features"] = f"""
WITH {FV}, {LATEST}
SELECT user_id, event_timestamp, CAST(view_value AS FLOAT) AS view_value, CAST(view_k AS FLOAT) AS view_k FROM lt
"""

ORACLE["latest_lookup"] = f"""
WITH {FV}, {LATEST}
SELECT c.c_custkey AS user_id,
       CASE WHEN lt.event_timestamp >= TIMESTAMP '2024-01-19 12:00:00' THEN lt.event_timestamp END AS event_timestamp,
       CASE WHEN lt.event_timestamp >= TIMESTAMP '2024-01-19 12:00:00' THEN CAST(lt.view_value AS FLOAT) END AS view_value,
       CASE WHEN lt.event_timestamp >= TIMESTAMP '2024-01-19 12:00:00' THEN CAST(lt.view_k AS FLOAT) END AS view_k
FROM customer c LEFT JOIN lt ON lt.user_id = c.c_custkey
"""

ORACLE["csv_roundtrip"] = "SELECT * FROM part"

ORACLE["metrics_roundtrip"] = f"""
WITH {OBS}, {FOREST}, {PAIRS},
ln AS (SELECT actual, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY predicted) AS line FROM cm GROUP BY actual)
SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
       round(sum(support * prec) / sum(support), 6) AS precision,
       round(sum(support * rec) / sum(support), 6) AS recall,
       round(sum(support * f1) / sum(support), 6) AS f1_score,
       (SELECT string_agg(line, ';' ORDER BY actual) FROM ln) AS confusion_matrix
FROM mt
"""

ORACLE["stream_score"] = ORACLE["request_score"]


# Model queries: rows, supports and names are plain SQL; the property columns
# must be true for any right model.
RULE_SPLIT = f"""
{OBS.replace("obs AS", "raw_obs AS")},
obs AS (SELECT * REPLACE (CASE WHEN f1 < 40 THEN 'low' WHEN f3 < 0.08::DOUBLE THEN 'mid' ELSE 'high' END AS label)
        FROM raw_obs),
{SPLIT}"""

ORACLE["train_predict"] = f"""
WITH {RULE_SPLIT}
SELECT label, count(*) AS support, true AS in_range, NULL::BOOLEAN AS gate_passed FROM sp WHERE split = 'test' GROUP BY label
UNION ALL
SELECT name, (SELECT count(*) FROM sp WHERE split = 'test'), true, gate
FROM (VALUES ('accuracy', true), ('macro avg', NULL), ('weighted avg', NULL)) AS v(name, gate)
"""

ORACLE["forest_score_trained"] = f"""
WITH {RULE_SPLIT}
SELECT obs_id, true AS agrees, true AS total_is_one, CAST(100 AS INTEGER) AS n_trees FROM sp WHERE split = 'test'
"""

ORACLE["feature_importance"] = f"""
WITH {OBS}
SELECT feature, CAST("index" AS INTEGER) AS "index", true AS in_range, true AS total_is_one
FROM (VALUES ('f1', 0), ('f2', 1), ('f3', 2), ('f4', 3)) AS v(feature, "index")
WHERE EXISTS (SELECT 1 FROM obs)
"""

# the reference's 108 candidates, numbered by depth, leaf limit, split limit and size
ORACLE["grid_search"] = f"""
WITH {OBS}
SELECT CAST(27 * d.i + 9 * l.i + 3 * s.i + t.i AS INTEGER) AS candidate, CAST(t.v AS INTEGER) AS num_trees,
       CAST(d.v AS INTEGER) AS max_depth, CAST(s.v AS INTEGER) AS min_samples_split,
       CAST(l.v AS INTEGER) AS min_samples_leaf, true AS in_range, true AS above_gate, CAST(1 AS BIGINT) AS n_best
FROM (VALUES (0, 3), (1, 5), (2, 7), (3, 30)) AS d(i, v), (VALUES (0, 1), (1, 2), (2, 4)) AS l(i, v),
     (VALUES (0, 2), (1, 5), (2, 10)) AS s(i, v), (VALUES (0, 50), (1, 100), (2, 200)) AS t(i, v)
WHERE EXISTS (SELECT 1 FROM obs)
"""

ORACLE["batch_predict_file"] = f"""
WITH {RULE_SPLIT}
SELECT obs_id, true AS in_range, true AS label_fits, true AS confidence_is_max, '2024-06-01 12:00:00' AS "timestamp"
FROM sp WHERE split = 'test'
"""


def _run_sql(trees: int) -> str:
    return f"""(WITH {OBS}, {forest_ctes("obs", "sc", trees)}, {PAIRS}
SELECT 'standin_forest' AS experiment, '{trees}' AS n_trees, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
       round(sum(support * f1) / sum(support), 6) AS f1_score FROM mt)"""


ORACLE["run_log"] = f"SELECT * FROM ({_run_sql(3)} UNION ALL {_run_sql(2)}) ORDER BY accuracy DESC LIMIT 1"

_TRUE_IF_OK = ", ".join(f"CASE WHEN {{ok}} THEN true END AS {c}" for c in
                        ["in_range", "name_fits", "confidence_is_max", "total_is_one"])

ORACLE["request_score_loaded"] = f"""
WITH {REQUEST_RULES}
SELECT req_id, CAST(status AS INTEGER) AS status, error, CAST(received AS INTEGER) AS received, status = 200 AS success,
       CASE WHEN status = 200 THEN f1 END AS in_sepal_length, CASE WHEN status = 200 THEN f2 END AS in_sepal_width,
       CASE WHEN status = 200 THEN f3 END AS in_petal_length, CASE WHEN status = 200 THEN f4 END AS in_petal_width,
       {_TRUE_IF_OK.format(ok="status = 200")}
FROM q
"""

ORACLE["request_batch_loaded"] = f"""
WITH {REQ}
SELECT req_id, CAST(0 AS INTEGER) AS sample_id, x1 AS in_sepal_length, x2 AS in_sepal_width, x3 AS in_petal_length,
       x4 AS in_petal_width, {_TRUE_IF_OK.format(ok="true")} FROM x WHERE event_type = 'view'
UNION ALL
SELECT req_id, 1, x4, x3, x2, x1, true, true, true, true FROM x WHERE event_type = 'view'
"""

_ANSWERED = "CASE WHEN status = 200 THEN '2024-06-01 12:00:00' END"

ORACLE["response_documents"] = f"""
SELECT req_id, status, CASE status WHEN 200 THEN true WHEN 500 THEN false END AS success, error, received,
       CASE WHEN error = {_MISSING} THEN '5.1 3.5 1.4 0.2' END AS expected, prediction, class_name,
       p_finished, p_open, p_partial, confidence,
       in_sepal_length, in_sepal_width, in_petal_length, in_petal_width, {_ANSWERED} AS "timestamp"
FROM ({ORACLE["request_score"]})
"""

ORACLE["batch_documents"] = f"""
WITH s AS ({ORACLE["request_batch_score"]}), p AS ({ORACLE["request_batch_predictions"]})
SELECT s.req_id, status, CASE status WHEN 200 THEN true WHEN 500 THEN false END AS success, error, total_samples,
       CASE WHEN status = 200 THEN CAST((SELECT count(*) FROM p WHERE p.req_id = s.req_id) AS INTEGER) END AS n_predictions,
       l.confidence AS last_confidence, l.in_sepal_length AS last_first_input, {_ANSWERED} AS "timestamp"
FROM s LEFT JOIN p l ON l.req_id = s.req_id AND l.sample_id = s.total_samples - 1
"""

ORACLE["workflow_run"] = f"""
WITH {OBS}
SELECT v.artifact, v."check", true AS passed,
       CASE n WHEN -1 THEN (SELECT count(*) FROM obs) ELSE CAST(n AS BIGINT) END AS "rows"
FROM (VALUES ('metrics', 'accuracy', NULL), ('metrics_tuned', 'accuracy', NULL), ('metrics_tuned', 'cv_score', NULL),
             ('feature_table', 'artifact_exists', -1), ('split', 'artifact_exists', -1), ('scaler', 'artifact_exists', 4),
             ('model', 'artifact_exists', NULL), ('evaluation_report', 'artifact_exists', NULL),
             ('confusion_matrix', 'artifact_exists', NULL), ('feature_importance', 'artifact_exists', 4),
             ('runs', 'artifact_exists', 1)) AS v(artifact, "check", n)
"""
