"""Request-body rules (F8) as staged Spark SQL projections over VARIANT.

The reference's service decides each request's outcome in this order:
1. body is not JSON → 500;
2. body is falsy (``null``, ``false``, ``0``, ``""``, ``[]``, ``{}``) or has
   no ``features`` → 400 "Missing features in request body"; the membership
   test itself fails (→ 500) for ``true``/non-zero numbers and for a string
   or array that *contains* "features" (indexing it then fails);
3. single: ``len(features)`` fails for null/bool/number (→ 500); a length
   other than 4 → 400 with the received length; a length-4 value that is
   not four numbers → 500 (the model rejects it);
4. batch: samples in order, the first offending one decides the request
   (wrong length → 400 ``Sample i: ...``, anything else → 500).

``from_json`` cannot separate these cases (it nulls all of them), so the
body is parsed once with ``try_parse_json`` and inspected by kind.
Booleans count as numbers (1/0), as numpy converts them.

The reference's parser also takes ``NaN``, ``Infinity`` and ``-Infinity`` as
numbers and keeps the last of a repeated key; Spark's takes neither. Bodies
that the strict parse rejects get a second reading: these three words, outside
strings, become a number without a finite value (no model takes one), and the
entries of a body with repeated keys are read in order, of which the last
``features`` counts. Keys repeated inside a nested object are still rejected.

Each step is its own projection over the previous step's columns: the
parsed body and its type string are computed once per row, and Catalyst
does not inline a non-trivial expression that is used more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Response texts.
MISSING = "Missing features in request body"
BAD_LENGTH = "Expected 4 features (sepal_length, sepal_width, petal_length, petal_width)"
NOT_JSON = "Invalid JSON body"
NO_LENGTH = "features has no length"
NOT_NUMERIC = "features must be numbers"
NOT_CONTAINER = "request body is not an object"
NOT_ITERABLE = "features is not iterable"
N_FEATURES = 4

_NUMBER_TYPES = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"]
# an array whose merged element type is one numeric (or boolean) type holds
# only numbers or nulls
_NUMERIC_ARRAY = r"^ARRAY<(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\(\d+,\d+\))>$"


def kind_of(t: Column) -> Column:
    """Kind from a ``schema_of_variant`` string: 'null' | 'bool' | 'number' |
    'string' | 'array' | 'object' (SQL null for a SQL-null value)."""
    return (F.when(t == "VOID", F.lit("null"))
            .when(t == "BOOLEAN", F.lit("bool"))
            .when(t.isin(_NUMBER_TYPES) | t.startswith("DECIMAL"), F.lit("number"))
            .when(t == "STRING", F.lit("string"))
            .when(t.startswith("ARRAY"), F.lit("array"))
            .when(t.startswith("OBJECT"), F.lit("object"))
            .otherwise(F.lit("other")))


def kind(v: Column) -> Column:
    return kind_of(F.schema_of_variant(v))


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _nkeys(v: Column) -> Column:
    return F.size(F.try_variant_get(v, "$", "map<string,variant>"))


def _length(k: Column, v: Column) -> Column:
    """Python ``len()`` of a JSON value of kind ``k``; null where it raises."""
    return (F.when(k == "string", F.char_length(_string(v)))
            .when(k == "array", F.size(_array(v)))
            .when(k == "object", _nkeys(v)))


def _doubles(arr: Column) -> Column:
    return F.transform(arr, lambda e: F.try_variant_get(e, "$", "double"))


def _four_numbers(t: Column, arr: Column, doubles: Column | None = None) -> Column:
    """True when a 4-element array (type string ``t``, elements ``arr``) holds
    only finite numbers/booleans: a homogeneous numeric type needs only a null
    and infinity check (on ``doubles``, the elements as doubles, when already
    computed); a mixed array is checked element by element."""
    infinite = F.lit(float("inf"))
    values = _doubles(arr) if doubles is None else doubles
    no_null = ~F.exists(values, lambda x: x.isNull() | (F.abs(x) == infinite))
    finite = ~F.exists(values, lambda x: F.coalesce(F.abs(x) == infinite, F.lit(False)))
    mixed_ok = F.forall(arr, lambda e: kind(e).isin("number", "bool")) & finite
    return F.when(t.rlike(_NUMERIC_ARRAY), no_null).otherwise(mixed_ok)


# a string, or what stands between strings
_TOKEN = r'"(?:[^"\\]|\\.)*"|[^"]+|"'
_NOT_FINITE = r"(?<![\w.+-])(?:NaN|-?Infinity)(?![\w.])"


def _finite_words(body: Column) -> Column:
    """The body with NaN and infinities outside strings written as an overflowing number."""
    tokens = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0))
    plain = F.transform(tokens, lambda t: F.when(t.startswith('"'), t).otherwise(F.regexp_replace(t, _NOT_FINITE, "1e999")))
    return F.array_join(plain, "")


def _entries(text: Column) -> Column:
    """The entries of an object in order, repeated keys included; null for anything else."""
    return F.map_entries(F.from_json(text, "map<string,variant>", {"allowNonNumericNumbers": "false"}))


def _envelope(df: DataFrame, body: str) -> DataFrame:
    """Adds ``__f`` (the ``features`` value), ``__ft`` (its type string) and
    ``__pre_status``/``__pre_error`` (decided before ``features`` is read;
    null when it is present)."""
    df = df.withColumn("__v", F.try_parse_json(F.col(body)))
    df = df.withColumn("__again", F.when(F.col("__v").isNull(), _finite_words(F.col(body))))
    df = df.withColumn("__v", F.coalesce("__v", F.try_parse_json("__again")))
    df = df.withColumn("__entries", F.when(F.col("__v").isNull(), _entries(F.col("__again"))))
    named = F.filter("__entries", lambda e: e["key"] == "features")
    last = F.when(F.size(named) > 0, F.element_at(named, -1)["value"])
    df = df.withColumns({"__vt": F.schema_of_variant("__v"),
                         "__f": F.coalesce(F.try_variant_get("__v", "$.features", "variant"), last)})
    df = df.withColumns({"__k": F.when(F.col("__entries").isNotNull(), "object").otherwise(kind_of(F.col("__vt"))),
                         "__ft": F.schema_of_variant("__f")})
    v, k = F.col("__v"), F.col("__k")
    num = F.try_variant_get(v, "$", "double")
    falsy = ((k == "null") | (k.isin("bool", "number") & (num == 0))
             | ((k == "string") & (F.char_length(_string(v)) == 0))
             | ((k == "array") & (F.size(_array(v)) == 0))
             | ((k == "object") & (F.col("__vt") == "OBJECT<>")))  # '{}' is the only empty object
    string_elems = F.transform(_array(v), lambda e: F.when(kind(e) == "string", _string(e)))
    member_fails = (k.isin("bool", "number")
                    | ((k == "string") & (F.instr(_string(v), "features") > 0))
                    | ((k == "array") & F.coalesce(F.array_contains(string_elems, "features"), F.lit(False))))
    feats_absent = F.col("__f").isNull()
    df = df.withColumn("__pre", F.when(v.isNull() & F.col("__entries").isNull(),
                                     F.struct(F.lit(500).alias("s"), F.lit(NOT_JSON).alias("e")))
                       .when(falsy, F.struct(F.lit(400).alias("s"), F.lit(MISSING).alias("e")))
                       .when(k != "object", F.when(member_fails, F.struct(F.lit(500).alias("s"),
                                                                          F.lit(NOT_CONTAINER).alias("e")))
                             .otherwise(F.struct(F.lit(400).alias("s"), F.lit(MISSING).alias("e"))))
                       .when(feats_absent, F.struct(F.lit(400).alias("s"), F.lit(MISSING).alias("e"))))
    return df.select("*", F.col("__pre.s").alias("__pre_status"), F.col("__pre.e").alias("__pre_error")) \
        .drop("__v", "__vt", "__k", "__pre", "__again", "__entries")


_TEMP = ["__f", "__ft", "__fk", "__farr", "__n", "__code", "__pre_status", "__pre_error"]


def single_request(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``status int, error string, received int, features array<double>``
    for single-prediction bodies (M6)."""
    df = _envelope(df, body)
    df = df.withColumn("__fk", kind_of(F.col("__ft")))
    df = df.withColumn("__farr", F.when(F.col("__fk") == "array", _array(F.col("__f"))))
    fk, f, arr = F.col("__fk"), F.col("__f"), F.col("__farr")
    df = df.withColumns({"__n": F.when(fk == "array", F.size(arr)).otherwise(_length(fk, f)),
                         "__fd": F.when(F.size(arr) == N_FEATURES, _doubles(arr))})
    n = F.col("__n")
    df = df.withColumn("__code", F.when(n.isNull(), F.lit(500)).when(n != N_FEATURES, F.lit(400))
                       .when((fk == "array") & _four_numbers(F.col("__ft"), arr, F.col("__fd")), F.lit(0))
                       .otherwise(F.lit(500)))
    code, pre = F.col("__code"), F.col("__pre_status")
    status = F.coalesce(pre, F.when(code == 0, F.lit(200)).otherwise(code)).cast("int")
    error = F.coalesce(F.col("__pre_error"), F.when(code == 0, F.lit(None).cast("string"))
                       .when(n.isNull(), F.lit(NO_LENGTH))
                       .when(code == 400, F.lit(BAD_LENGTH))
                       .otherwise(F.lit(NOT_NUMERIC)))
    df = df.withColumns({"status": status, "error": error,
                         "received": F.when(pre.isNull() & (code == 400), n).cast("int")})
    df = df.withColumn("features", F.when(F.col("status") == 200, F.col("__fd")))
    return df.drop(*_TEMP, "__fd")


def _sample_codes(samples: Column) -> Column:
    """Per sample ``struct<code, len>``: 0 = valid, 400 = wrong length, 500 = error."""
    typed = F.transform(samples, lambda e: F.struct(e.alias("v"), F.schema_of_variant(e).alias("t")))

    def code(s: Column) -> Column:
        k = kind_of(s["t"])
        n = _length(k, s["v"])
        c = (F.when(n.isNull(), F.lit(500)).when(n != N_FEATURES, F.lit(400))
             .when((k == "array") & _four_numbers(s["t"], _array(s["v"])), F.lit(0)).otherwise(F.lit(500)))
        return F.struct(c.alias("code"), n.alias("len"))

    return F.transform(typed, code)


def batch_request(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``status int, error string, samples array<array<double>>`` for
    batch bodies (M7): the first offending sample decides; no partial output."""
    df = _envelope(df, body)
    df = df.withColumn("__fk", kind_of(F.col("__ft")))
    df = df.withColumn("__farr", F.when(F.col("__fk") == "array", _array(F.col("__f"))))
    df = df.withColumn("__codes", _sample_codes(F.col("__farr")))
    df = df.withColumn("__first", F.array_position(F.transform("__codes", lambda c: c["code"] != 0), True))
    fk, first = F.col("__fk"), F.col("__first")
    bad = F.element_at("__codes", first.cast("int"))
    arr_status = F.when(first == 0, F.lit(200)).otherwise(bad["code"])
    # iterating a string yields 1-character samples; an object yields its
    # keys in document order (taken from the JSON text)
    s_len = F.char_length(_string(F.col("__f")))
    keys = F.json_object_keys(F.get_json_object(F.col(body), "$.features"))
    first_key_len = F.char_length(F.element_at(keys, 1))
    outcome = (
        F.when(fk.isin("null", "bool", "number"), F.struct(F.lit(500).alias("s"), F.lit(NOT_ITERABLE).alias("e")))
        .when(fk == "string", F.when(s_len == 0, F.struct(F.lit(200).alias("s"), F.lit(None).cast("string").alias("e")))
              .otherwise(F.struct(F.lit(400).alias("s"),
                                  F.lit(f"Sample 0: Expected {N_FEATURES} features, got 1").alias("e"))))
        .when(fk == "object", F.when(F.size(keys) == 0, F.struct(F.lit(200).alias("s"),
                                                                 F.lit(None).cast("string").alias("e")))
              .when(first_key_len != N_FEATURES, F.struct(F.lit(400).alias("s"), F.concat(
                  F.lit(f"Sample 0: Expected {N_FEATURES} features, got "), first_key_len.cast("string")).alias("e")))
              .otherwise(F.struct(F.lit(500).alias("s"), F.lit(NOT_NUMERIC).alias("e"))))
        .when(arr_status == 400, F.struct(F.lit(400).alias("s"), F.concat(
            F.lit("Sample "), (first - 1).cast("string"), F.lit(f": Expected {N_FEATURES} features, got "),
            bad["len"].cast("string")).alias("e")))
        .when(arr_status == 500, F.struct(F.lit(500).alias("s"), F.lit(NOT_NUMERIC).alias("e")))
        .otherwise(F.struct(F.lit(200).alias("s"), F.lit(None).cast("string").alias("e"))))
    df = df.withColumn("__out", F.when(F.col("__pre_status").isNotNull(),
                                       F.struct(F.col("__pre_status").alias("s"), F.col("__pre_error").alias("e")))
                       .otherwise(outcome))
    df = df.withColumns({"status": F.col("__out.s").cast("int"), "error": F.col("__out.e")})
    ok = F.col("status") == 200
    df = df.withColumn("samples", F.when(ok & (fk == "array"), F.transform("__farr", lambda e: _doubles(_array(e))))
                       .when(ok, F.array().cast("array<array<double>>")))
    return df.drop(*_TEMP, "__codes", "__first", "__out")
