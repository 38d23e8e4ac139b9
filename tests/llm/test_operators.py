"""The training-data operators against brute force, on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import re

import numpy as np
import pytest

LONG = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
ROWS = [
    (1, LONG, "en", "s1"), (2, "zz " + LONG, "en", "s2"), (3, None, None, None), (4, "", "fr", "s1"),
    (5, LONG.upper(), "en", "s1"), (6, "le la les une des " * 8, "fr", "s2"), (7, "12 34 !!", "fr", "s3"),
    (8, LONG, "en", "s1"), (8, LONG, "en", "s1"), (9, "x " * 400, "en", "s3"), (10, "the of and the of", "en", None),
    (11, "le la une", "fr", "s2"),
]
SCHEMA = "doc_id long, text string, lang string, source string, id string, row_key int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substrings(docs, nothing):
    from featureflow.llm.substrings import remove_repeated_passages
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_passages(docs).collect())
    first = {}
    for i, t, *_ in ROWS:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(i, first.get(key, i))
    want = []
    for i, t, *_ in ROWS:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)
    small_groups = remove_repeated_passages(docs, group_windows=8)  # long prefixes
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in small_groups.collect()) == sorted(want)
    assert remove_repeated_passages(nothing).count() == 0


def test_substrings_repeated_within_a_row(spark):
    from featureflow.llm.substrings import remove_repeated_passages
    w, fill = " ".join(f"w{k}" for k in range(16)), " ".join(f"f{k}" for k in range(34))
    parts = [[(1, w), (3, "y " * 60 + "end")],  # a partition, so a slice, each
             [(2, f"{w} {fill} {w}"), (2, f"other {w} text {w}"), (4, "y " * 50), (5, f"p q r {w} p q r {w}"), (6, "z v u " * 30)],
             [(7, "z v u " * 20 + w), (7, "v u " + "z v u " * 9)]]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(parts, 3).flatMap(list), "doc_id long, text string")
    rows, first = [r for p in parts for r in p], {}
    for i, t in rows:
        for k in range(len(words(t)) - 12):
            key = tuple(words(t)[k:k + 13])
            first[key] = min(i, first.get(key, i))
    want = []
    for i, t in rows:
        x = words(t)
        gone = {k + j for k in range(len(x) - 12) if first[tuple(x[k:k + 13])] < i for j in range(13)}
        want.append((i, len(x), len(gone), " ".join(y for k, y in enumerate(x) if k not in gone)))
    for bounds in ({}, {"group_windows": 8}):
        got = remove_repeated_passages(docs, **bounds).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)


def test_targets_and_mix(docs, nothing):
    from featureflow.llm.mixing import Mix, targets
    assert [float(t) for t in targets([10, 100, 100], [3, 1, 1])] == [30, 90, 90]
    assert targets([0, 0], [1, 2]) == [0, 0]
    rows = Mix(docs, block=16).taken().collect()
    again = Mix(docs, block=16).taken().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(ROWS)
    source = {r[0]: r[3] for r in ROWS}
    taken = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken.setdefault(source[r.doc_id], [0, r.target])[0] += r.taken
    assert all(k == int(t) for k, t in taken.values())
    assert Mix(docs).documents().columns == docs.columns
    assert Mix(nothing).taken().count() == 0 and Mix(nothing).documents().count() == 0


def test_mix_with_any_column_names(docs):
    from pyspark.sql import functions as F
    from featureflow.llm.mixing import Mix
    names = ["size", "target", "quota", "source_no", "start", "row", "slot", "block", "epoch", "__source", "first"]
    more = docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    plain = sorted(map(tuple, Mix(docs, block=16).taken().collect()), key=str)
    assert sorted(map(tuple, Mix(more, block=16).taken().collect()), key=str) == plain
    got = Mix(more, block=16).documents()
    assert got.columns == more.columns and all(r["quota"] == 2 and r["slot"] == 6 for r in got.collect())
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in Mix(docs, block=16).documents().collect())


def test_mix_against_plain_targets_and_schedule(spark):
    """Targets by bisection on the level, and the order of the mix by its own stretches."""
    from featureflow.llm.mixing import Mix
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 5}" if i % 5 else None) for i, n in enumerate(rng.integers(0, 120, 2500))]
    rows.append((9999, "w " * 20_000, "s1"))  # a very long text
    mix = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=32)
    names, sizes = [*sorted({r[2] for r in rows if r[2]}), None], {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    weight = {s: [1, 2, 3][k % 3] for k, s in enumerate(names)}
    low, high = 0.0, float(sum(sizes.values()))
    for _ in range(200):  # the level at which capped shares add up to all sizes
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 3 * sizes[s]) for s in names) < sum(sizes.values()) else (low, level)
    target = {s: min(low * weight[s], 3 * sizes[s]) for s in names}
    source = {r[0]: r[2] for r in rows}
    got = mix.taken().collect()
    words_taken, first = {s: 0 for s in names}, []
    for r in got:
        s = source[r.doc_id]
        assert abs(r.target - target[s]) < 1e-3 and r.taken <= 3 * r["size"]
        words_taken[s] += r.taken
        assert (r.slot is None) == (r.taken == 0)
    assert all(abs(words_taken[s] - target[s]) <= 1 for s in names)
    slots = mix.schedule().orderBy("slot").collect()
    order = [r.source_no for r in slots]
    share = np.array([target[s] for s in names]) / sum(target.values())
    for n in range(200, len(order) - 200, 97):  # every stretch from the start is near the shares
        assert np.abs(np.bincount(order[:n], minlength=len(names)) / n - share).max() < 0.02
    place = {(r.source_no, r.block): r.slot for r in slots}
    lines = mix.lines("doc_id").collect()
    first = {r["row"]["doc_id"]: place[r.source_no, r.start // 32] for r in lines if r["size"] and (r.source_no, r.start // 32) in place}
    assert all(first[r.doc_id] >= r.slot for r in got if r.doc_id in first and r.slot is not None)
    assert len({r.slot for r in got}) > 500


def test_sums_before(spark):
    from featureflow.llm.mixing import sums_before
    rows = [(g, i, i + 1) for g in ("a", None) for i in range(0, 60, 2)]
    got = sums_before(spark.createDataFrame(rows, "g string, at long, v long"), "g", "at", "v", span=7).collect()
    assert {(r.g, r.at): r["__before"] for r in got} == {(g, at): sum(v for h, a, v in rows if h == g and a < at) for g, at, _ in rows}


def test_language(docs, nothing):
    from featureflow.llm.langid import identify, keep_identified
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[7].lang_pred == "und" and got[3].score == 0
    assert got[11].lang_pred == "fr" and 0 < got[11].score <= 1
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 6, 8, 9, 10, 11}
    assert identify(nothing).count() == 0


def test_language_held_out_accuracy(spark):
    from conftest import SF001
    from featureflow.llm.langid import identify
    from featureflow.session import table
    docs = table(spark, SF001, "documents")
    rows = identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98


def test_language_rare_languages_ties_and_long_texts(spark):
    from featureflow.llm.langid import identify, keep_identified
    rows = [(i, "the cat and the dog sit on the mat " * (1 + i % 5), "en") for i in range(400)]
    rows += [(1000 + i, "kissa ja koira istuvat matolla yhdessä", "fi") for i in range(12)]  # few rows keep their words
    rows += [(5000, "koira istuvat kissa", None), (5001, "dog on mat the", None), (5002, "zzqq", None), (5003, "the dog " * 150_000, None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words=8, grams=20).collect()}
    assert (got[5000].lang_pred, got[5001].lang_pred, got[5003].lang_pred) == ("fi", "en", "en")
    twins = [(i, t, lang) for i in range(0, 40, 2) for t, lang in (("same words here", "aa"), ("same words here", "bb"))]
    twins = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(twins)], "doc_id long, text string, lang string")
    tied = identify(twins).collect()  # equal languages: the first by name
    assert {r.lang_pred for r in tied} <= {"aa", "bb"} and all(0.3 < r.score <= 1 for r in tied)
    assert keep_identified(twins, least_score=1.1).count() == 0 and keep_identified(twins, least_score=0.0).count() == 40


def test_language_stage_without_labels(docs, nothing):
    from pyspark.sql import functions as F
    from featureflow.llm.langid import keep_identified
    kept = keep_identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 8, 8, 9, 10, 11]
    assert keep_identified(nothing).count() == 0


def test_pieces(spark):
    import public_tokenizers
    import sentencepiece
    from featureflow.llm.pieces import encode
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", " ", "a  b\n c", " lead", "trail ", "x" * 3000, "é▁x\x00y", "日本語 \t 🙂🙂", "The end.\r\n" * 40,
             "word " * 50, "▁▁", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbbb"]
    rows = encode(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), path).collect()
    for r in rows:
        ids = sp.encode(texts[r.n] or "", add_eos=True)
        assert r.ids == ids, texts[r.n]
        assert r.decoded == sp.decode(ids), texts[r.n]
    assert len(rows) == len(texts)


def test_licenses(spark, docs, nothing):
    from featureflow.llm.licenses import scan_licenses
    text = "Under the MIT License. x under the-mit\nlicense; CC BY-NC 4.0 Apache License, Version 2.0 éunder the mit license"
    got = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_base, got.first_word, got.base_labels) == (4, 0, "apache-2,cc-by-nc,mit") and got.last_word == 14
    assert 0 < got.score <= 1 and set(got.base_labels.split(",")) <= set(got.labels.split(","))
    none = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert none[3].n_words == 0 and none[3].first_word is None and none[3].labels == "" and none[3].score == 0
    assert scan_licenses(nothing).count() == 0


def test_licenses_against_plain_search(spark):
    from math import log
    from featureflow.llm.licenses import TEMPLATES, scan_licenses
    rng = np.random.default_rng(12)
    pool = sorted({w for t in TEMPLATES for w in t[1].split()}) + ["other", "words", "été"]
    texts = [None, "", "!!", "under the mit licens", "MIT license under the mit license under the mit license"]
    for _ in range(150):
        parts = [" ".join(rng.choice(pool, int(rng.integers(0, 9)))) if rng.random() < 0.5 else TEMPLATES[rng.integers(len(TEMPLATES))][int(
            rng.integers(1, 3))] for _ in range(int(rng.integers(1, 6)))]
        texts.append("; ".join(parts).upper() if rng.random() < 0.3 else ", ".join(parts))
    texts.append("filler " * 60_000 + "Apache License, Version 2 " + "filler " * 60_000)
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    rows = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    vocabulary = {w for t in TEMPLATES for w in f"{t[1]} {t[2]}".split()}
    idf = {w: log(1 + len(rows) / (1 + sum(w in set(r) for r in rows))) for w in vocabulary}
    for i, ws in enumerate(rows):
        places, base, labels, score = [], set(), set(), 0.0
        for label, text, key, is_base in TEMPLATES:
            text, key = text.split(), key.split()
            offset = next(k for k in range(len(text)) if text[k:k + len(key)] == key)
            for at in range(len(ws) - len(key) + 1):
                if ws[at:at + len(key)] == key:
                    labels.add(label)
                    if is_base:
                        places.append(at)
                        base.add(label)
                    found = sum(idf[w] for k, w in enumerate(text) if 0 <= at - offset + k < len(ws) and ws[at - offset + k] == w)
                    score = max(score, found / sum(idf[w] for w in text))
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(ws), len(places), ",".join(sorted(base)), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert abs(r.score - score) < 1e-9


def test_grams_of_another_base_are_independent():
    from featureflow.llm.words import GRAM_BASE, POS_BASE, U64, grams, mix
    h = np.random.default_rng(1).integers(0, 2**63, 6).astype(U64)
    g = h.copy()  # other words with the same hash: trade the first for the second
    with np.errstate(over="ignore"):
        g[0], g[1] = h[0] + U64(1), h[1] - GRAM_BASE
    assert (h != g).any() and grams(h, 2)[0] == grams(g, 2)[0] and grams(h, 2, 1)[0] == grams(g, 2, 1)[0]
    assert grams(mix(h), 2, 2, POS_BASE)[0] != grams(mix(g), 2, 2, POS_BASE)[0]


def test_top_k(spark):
    from pyspark.sql import functions as F
    from featureflow.llm.topk import quantised, top_k
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 0.2]) for i in range(900)]
    data += [(900 + i, data[5][1]) for i in range(30)]  # ties
    data += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("vector", quantised(F.col("embedding")))
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, shard=300, block=4).orderBy("query_id", "rank").collect()]
    v = {i: np.floor(np.array(e) * 1024).astype(int) for i, e in data[:930]}
    want = []
    for q in sorted(i for i in v if i % 100 == 0):
        best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_index_decides_the_members(spark):
    """Shards above and below the index's threshold, ties, and few possible members left by the proof."""
    from featureflow.llm.topk import FEW, Shard, search
    rng = np.random.default_rng(9)
    for n, d in ((3000, 16), (900, 64), (12, 4)):
        v = rng.integers(-900, 900, (n, d))
        v[n // 2:n // 2 + min(40, n // 4)] = v[3]  # ties
        ids, asked = np.arange(n) * 7, rng.integers(-900, 900, (9, d))
        asked[0] = v[3]
        for few in (0, FEW):
            got = search(ids, v, np.arange(9) * 7, asked, 10, few).to_pandas()
            for q in range(9):
                best = sorted(((-int(v[i] @ asked[q]), int(ids[i])) for i in range(n) if ids[i] != q * 7))[:10]
                own = got[got["query_id"] == q * 7]
                assert [(-s, i) for s, i in zip(own["score"], own["vec_id"])] == best
        if n == 3000:
            left = [len(Shard(v).top(q, 10, np.arange(n), 0)[0]) for q in asked]
            assert min(left) < n / 2  # the proof drops members before any rescoring
    with pytest.raises(OverflowError):
        search(np.arange(2), np.full((2, 2), 2**40), np.arange(1), np.full((1, 2), 2**40), 1)


def test_exact_dedup(docs, nothing):
    from featureflow.llm.exactdedup import drop_copies, exact_dedup
    got = {r.doc_id: r for r in exact_dedup(docs, capacity=1).collect()}
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (8, 4, False) and got[8].kept
    assert (got[3].keep_id, got[3].group_size) == (4, 2)
    assert got[1].digest == hashlib.sha256(LONG.encode()).hexdigest()
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 4, 6, 7, 8, 9, 10, 11}
    assert exact_dedup(nothing).count() == 0


def test_exact_dedup_buckets_split_and_chains_compare_texts(spark):
    from pyspark.sql import functions as F
    from featureflow.llm.exactdedup import build_index, directory, exact_dedup
    rows = [(i, f"text {i % 300} " + "y" * (i % 4)) for i in range(3000)] + [(5000 + i, "THE SAME Text") for i in range(2000)]
    rows += [(9000, "word " * 100_000), (9001, "Word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    last, size = {}, {}
    for i, t in rows:
        last[t.lower()], size[t.lower()] = max(i, last.get(t.lower(), -1)), size.get(t.lower(), 0) + 1
    want = {i: (last[t.lower()], size[t.lower()]) for i, t in rows}
    few = lambda t: F.length(t).cast("long")  # noqa: E731  many texts under one key
    for kw in ({"capacity": 8}, {"capacity": 8, "key": few}):
        got = exact_dedup(df, **kw).collect()
        assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
        chains = {(r.bucket, r.digest): r.chain for r in got}
        assert (max(chains.values()) > 50) == ("key" in kw)
    plain = df.select(F.col("doc_id").alias("id"), F.lower("text").alias("text")).withColumn("key", F.xxhash64("text"))
    index, cells, depth = build_index(plain, 8)
    loads = {r.bucket: r["count"] for r in index.groupBy("bucket").count().collect()}
    assert max(loads.values()) <= 8 and len(loads) > 40 and depth > 4
    assert cells.select("local_depth").distinct().count() > 1  # fuller buckets were split more often
    skewed = spark.range(64).select(F.col("id").alias("key"))  # equal leading bits: the directory doubles to its end
    assert directory(skewed, 8)[1] == 60


def test_dedup_stages_keep_one_row_of_equal_id_and_text(spark):
    from featureflow.llm.exactdedup import drop_copies
    from featureflow.llm.nearjoin import keep_one_of_each_class
    rows = [(8, LONG, "a")] * 5 + [(8, LONG, "b"), (3, LONG, "c"), (9, "other text", "d"), (9, "more words", "e"),
                                   (None, "no id", "f"), (None, "no id", "f"), (7, None, "g"), (7, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string").withColumn("m", map_column())
    exact = [(r.doc_id, r.text) for r in drop_copies(df).collect()]
    assert sorted(exact, key=str) == sorted({(8, LONG), (9, "other text"), (9, "more words"), (None, "no id"), (7, dict(exact)[7])}, key=str)
    near = [(r.doc_id, r.text) for r in keep_one_of_each_class(df).collect()]
    assert sorted(near, key=str) == sorted({(3, LONG), (9, "other text"), (9, "more words"), (None, "no id"), (7, dict(near)[7])}, key=str)
    assert drop_copies(df).columns == keep_one_of_each_class(df).columns == df.columns
    tags = {r.tag for _ in range(3) for r in drop_copies(df.repartition(3)).collect() if r.doc_id == 8}
    assert len(tags) == 1  # reruns agree


def map_column():
    from pyspark.sql import functions as F
    return F.create_map(F.lit("k"), F.lit(1))


def test_urls(spark):
    from featureflow.llm.queries import URL_RULES
    from featureflow.llm.urlfilter import judge_urls
    urls = {None: (None, "allow"), "": (None, "allow"), "no scheme": (None, "allow"), "http://A.NET/x": ("net/", "block"),
            "http://example.net/en/1": ("example.net/en/", "allow"), "http://example.net/de/": ("net/", "block"),
            "http://b.example.com/de/?q": ("example.com/de/", "block"), "http://xexample.com/de/": (None, "allow"),
            "http://x.org/fr/": ("org/fr/", "allow"), "http://x.net?y=/": (None, "allow"), "http://net": (None, "allow")}
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, other string")
    got = {r.url: (r.rule, r.verdict) for r in judge_urls(df, URL_RULES).collect()}
    assert got == urls
    assert judge_urls(df.limit(0), URL_RULES).count() == 0
    clash = df.selectExpr("*", "'mine' AS host", "'mine' AS rule", "'mine' AS `key`")
    again = {r.url: (r.rule, r.verdict) for r in judge_urls(clash, URL_RULES).collect()}
    assert again == urls and {r.key for r in judge_urls(clash, URL_RULES).collect()} == {"mine"}
    long = spark.createDataFrame([(1, "http://" + "a." * 400 + "net/" + "p" * 20_000)], "page_id long, url string")
    assert judge_urls(long, URL_RULES).first().rule == "net/"


def test_near_join(spark, nothing):
    from featureflow.llm.nearjoin import keep_one_of_each_class, similarity_links
    rng = np.random.default_rng(5)
    rows, vocabulary = [], [f"w{i}" for i in range(3000)]
    for g in range(6):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(25):
            own = list(base)
            for at in rng.choice(120, rng.integers(0, 4), replace=False):
                own[at] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(own)))
    rows += [(200, None), (201, ""), (202, "two words"), (203, "two words"), (204, "other words"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in similarity_links(df, block=8).collect() if r.doc_id is not None}
    sets = {}
    for i, t in rows[:-1]:
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    want = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = (min(seen), len(links[i]))
    assert got == want
    assert similarity_links(nothing).count() == 0
    kept = keep_one_of_each_class(df)
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in want.values()} | {None}


def test_near_join_finds_planted_similarities(spark):
    """Recall by similarity: groups of texts with known Jaccard similarities around the threshold."""
    from featureflow.llm.nearjoin import similarity_links
    rng = np.random.default_rng(21)
    rows, pairs = [], {}
    for g in range(220):  # pairs that differ in one word every so often
        n, changes = int(rng.integers(60, 200)), int(rng.integers(0, 5))
        base = [f"g{g}w{k}" for k in range(n)]
        own = list(base)
        for at in rng.choice(n, changes, replace=False):
            own[at] += "x"
        a, b = ({tuple(t[k:k + 5]) for k in range(n - 4)} for t in (base, own))
        pairs[2 * g] = len(a & b) / len(a | b)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
    rows.append((9998, "long " + "tail of words " * 40_000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {r.doc_id: r.n_links for r in similarity_links(df).collect()}
    assert sum(0.8 <= s < 0.85 for s in pairs.values()) > 5 and sum(s < 0.8 for s in pairs.values()) > 20
    assert all(linked[i] == linked[i + 1] == int(s >= 0.8 - 1e-12) for i, s in pairs.items())
    # the posterior decides what is verified: with a high tolerance it drops pairs, and they are no links
    strict = {r.doc_id: r.n_links for r in similarity_links(df, tolerance=0.999).collect()}
    assert sum(strict.values()) < sum(linked.values()) and all(strict[i] <= linked[i] for i in linked)


def test_near_join_tells_clashing_keys_apart(spark, tmp_path):
    from featureflow.llm.nearjoin import separate
    rows = [(1, 7, 1, b"a", 7), (2, 7, 2, b"b", 7), (3, 7, 2, b"b", 7), (4, 8, 1, b"c", 8), (5, None, None, b"d", None)]
    df = spark.createDataFrame(rows, "id long, node long, key2 long, sig binary, k1 long")
    got = {r.id: r.node for r in separate(df, str(tmp_path)).collect()}
    assert got[1] != got[2] == got[3] and got[4] == 8 and got[5] is None and len({*got.values()}) == 4


def test_least_matches():
    from featureflow.llm.nearjoin import STEP, least_matches
    least = least_matches(0.8, 1e-6)
    assert all(0 < m < (k + 1) * STEP for k, m in enumerate(least)) and least == sorted(least)


def test_chat(spark):
    from pyspark.sql import functions as F
    from featureflow.llm.chat import format_chat, read_back
    kind = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:int>>"
    tricky = "\\### Assistant: </turn>\n <image 1.2> \\b \\l"
    rows = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 64), ("text", tricky, None, None)]),
            (1, 1, "assistant", [("text", tricky, None, None)]), (1, None, None, None), (2, 0, "a>\\b", [("audio", None, "b", 5)])]
    out = format_chat(spark.createDataFrame(rows, kind)).withColumn("back", read_back(F.col("formatted"), F.col("loss")))
    got = {r.conv_id: r for r in out.collect()}
    one = got[1]
    assert [(b.role, b.text) for b in one.back][1:] == [("assistant", tricky), ("", "")]
    assert [tuple(a) for a in one.attachments] == [("<image 1.2>", "image", "a.png", 64)]
    spans = [one.formatted[s["from"]:s["to"]] for s in one.loss_spans]
    assert len(spans) == 1 and "<" not in spans[0] and "#" not in spans[0]
    assert got[2].back[0].role == "a>\\b" and got[2].expanded_tokens == 5
    assert format_chat(spark.createDataFrame([], kind)).count() == 0


def test_chat_with_all_types_of_parts(spark):
    from pyspark.sql import functions as F
    from featureflow.llm.chat import format_chat, read_back
    kind = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:int>>"
    parts = [("text", "two words", None, None), ("image", None, "a.png", 64), ("document", "ignored", "b.pdf", 900),
             (None, "untyped is text", None, None), ("audio", None, None, None), ("vi<deo", None, "c", 3)]
    long = "<word>\\# " * 60_000
    rows = [(1, 1, "user", parts), (1, 1, "user", parts), (1, 2, "assistant", [("text", long, None, None)]), (2, 5, "user", None),
            (2, 5, None, []), (None, 1, "user", parts[:1])]
    df = spark.createDataFrame(rows, kind).withColumns({c: F.lit(1) for c in ("conv", "no", "body", "head", "files", "formatted", "loss")})
    out = format_chat(df).withColumn("back", read_back(F.col("formatted"), F.col("loss")))
    got = {r.conv_id: r for r in out.collect()}
    own = [("image", "a.png", 64), ("document", "b.pdf", 900), ("audio", None, 0), ("vi<deo", "c", 3)]
    assert [tuple(a)[1:] for a in got[1].attachments] == own * 2  # equal rows are two turns
    marks = [a.placeholder for a in got[1].attachments]
    assert marks[:3] == ["<image 1.2>", "<document 1.3>", "<audio 1.5>"] and marks[4] == "<image 2.2>" and "vi\\ldeo" in marks[3]
    assert [got[1].formatted.count(m) for m in marks] == [1] * 8
    assert got[1].expanded_tokens == 2 * (2 + 64 + 900 + 3 + 0 + 3) + 60_000
    assert got[1].back[2].text == long and [b.loss for b in got[1].back] == [False, False, True]
    assert got[1].formatted[got[1].loss_spans[0]["from"]:got[1].loss_spans[0]["to"]].count("<") == 0
    assert got[2].expanded_tokens == 0 and len(got[2].back) == 2 and got[None].expanded_tokens == 2
