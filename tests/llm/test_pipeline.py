"""The pipeline end to end against a plain-Python version of its filtering and tokenizing stages."""

import hashlib
import re

import numpy as np


def test_pipeline_matches_brute_force(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("one", "two", "ere", "ing", "ous")]
    rows = [(i, " ".join(rng.choice(vocabulary, 90)), "en", f"s{i % 3}") for i in range(12)]
    rows += [(20, rows[0][1].upper(), "en", "s0"), (21, rows[1][1] + " end", "en", "s1"), (22, None, "en", "s1"),
             (23, "", None, "s1"), (24, "12 !!", "fr", None), (25, "short text", "fr", None)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    text = {i: t for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    last = {}
    for i, t in sorted(text.items()):
        last[t.lower()] = i
    kept = sorted(last.values())

    def shingles(t):
        w = t.split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    classes = {}
    for i in kept:  # pairs only here: no chains in these rows
        near = [j for j in kept if j < i and len(shingles(text[i]) & shingles(text[j])) >= 0.8 * len(shingles(text[i]) | shingles(text[j]))]
        if not near:
            classes[i] = text[i]
    source = {i: s for i, _, _, s, _ in rows}
    size = {i: len(t.split()) for i, t in classes.items()}
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(classes) and max(copies.values()) <= 3
    total = sum(size.values())
    names = sorted({source[i] for i in classes if source[i]}) + [None]
    sizes = [sum(size[i] for i in classes if source[i] == s) for s in names]
    from featureflow.llm.mixing import targets
    for s, target in zip(names, targets(sizes, [1, 2, 3, 1])):
        words = sum(copies.get(i, 0) * size[i] for i in classes if source[i] == s)
        assert abs(words - target) <= max(size[i] for i in classes if source[i] == s)
    assert total == sum(sizes)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        ids = sp.encode(classes[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0


def test_pipeline_with_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    import corpus_pipeline
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("one", "two", "ere", "ing", "ous")]
    rows = [(i, " ".join(rng.choice(vocabulary, 70)), "en", f"s{i % 2}", 1) for i in range(8)]
    rows += [rows[0]] * 6 + [(None, rows[1][1] + " own words of a row without id", None, None, None), (50, "long " + "tail of it " * 30_000, "en", "s0", 9)]
    clash = ["id", "text_", "row", "size", "target", "quota", "source_no", "start", "slot", "block", "key", "cell", "bucket", "node", "sig",
             "lang_pred", "score", "ids", "decoded", "fold", "first", "__source", "k1"]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("mine") for c in clash})
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    stages, kept = corpus_pipeline.STAGES, docs
    for name, stage in stages[:-1]:  # every filtering stage returns the columns as they were
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert {r[0] for r in kept.select("lang_pred").distinct().collect()} <= {"mine"}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= {*range(8), 50, None} and max(copies.values()) <= 3
    assert len(got) == kept.count()
