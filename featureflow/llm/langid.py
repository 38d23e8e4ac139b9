"""Language identification with a word-first backoff model.

Known words score by their log frequency in each language. A word the model
does not know falls back to the character 4-grams of the word (with border
marks), and, if none of them is known, to 3-, 2- and 1-grams. A document's
language has the largest sum; its score is the posterior under equal priors.

The model is fitted on a sample of labelled rows of at most about
`docs_a_language` documents per language, chosen by a hash of the id, and
keeps the `words` most frequent words and, of each order, the `grams` most
frequent n-grams of every language, so a language of few rows keeps its own.
All three bounds are parameters, so the broadcast model is bounded.

Null texts, and texts without a letter, are `und` with score 0; so is
everything when no labelled row exists. Ties go to the first language by name.
The pipeline's stage (keep_identified) drops documents that are `und` or whose
best language has less than `least_score` (0.5) of the posterior: such a text
fits no language better than the others together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.llm.words import slices
from featureflow.session import written

UNKNOWN = "und"
ORDERS = (4, 3, 2, 1)
SMOOTH = 0.5
CACHE = 100_000
SLICE_BYTES = 4 << 20


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters, and the offsets of each row's words."""
    letters = pc.replace_substring_regex(pc.utf8_lower(text.fill_null("")), r"[^\p{L}]+", " ")
    lists = pc.ascii_split_whitespace(pc.utf8_trim(letters, " "))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    if len(empty):  # a row without letters gives one empty word
        flat = flat.filter(pc.not_equal(pc.binary_length(flat), 0))
        offsets = offsets - np.searchsorted(empty, offsets)
    return flat, offsets


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        flat, offsets = words_of(batch.column("text"))
        if not len(flat):
            continue
        lang = batch.column("lang").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets))))
        counts = pa.table({"lang": lang, "word": flat}).group_by(["lang", "word"]).aggregate([([], "count_all")])
        yield from counts.rename_columns(["lang", "word", "n"]).to_batches()


def _char_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, str], int] = {}
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for order in ORDERS:
                for gram in grams_of(word, order):
                    total[lang, gram] = total.get((lang, gram), 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()),
             pa.array(list(total.values()), pa.int64())], ["lang", "gram", "n"])


def grams_of(word: str, order: int) -> list[str]:
    marked = f"^{word}$" if order > 1 else word
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


class Table:
    """Log frequencies by language: a row number for each key, and the rows."""

    def __init__(self, rows: list[dict], langs: list[str], kind: str):
        """rows (kind, lang, n); n-grams are normalised within their order."""
        at = {lang: i for i, lang in enumerate(langs)}
        self.row = {k: i for i, k in enumerate(dict.fromkeys(r[kind] for r in rows))}
        counts = np.zeros((len(self.row), len(langs)))
        for r in rows:
            counts[self.row[r[kind]], at[r["lang"]]] += r["n"]
        order = np.array([0 if kind == "word" else len(k) for k in self.row], int)
        self.log = np.zeros(counts.shape, np.float32)
        for o in np.unique(order):
            own = order == o
            self.log[own] = np.log((counts[own] + SMOOTH) / (counts[own].sum(axis=0) + SMOOTH * own.sum()))


class Model:
    """Log frequencies by language of known words and n-grams."""

    def __init__(self, langs: list[str], words: Table, grams: Table):
        self.langs, self.words, self.grams = langs, words, grams

    def unseen(self, word: str) -> np.ndarray:
        for order in ORDERS:
            known = [r for r in (self.grams.row.get(x) for x in grams_of(word, order)) if r is not None]
            if known:
                return self.grams.log[known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def scores(self, words: list[str], cache: dict[str, np.ndarray]) -> np.ndarray:
        """A row per word; scores of unseen words are kept in the cache while it has room."""
        at = np.array([self.words.row.get(w, -1) for w in words])
        out = self.words.log[at] if len(self.words.row) else np.zeros((len(words), len(self.langs)), np.float32)
        for i in np.flatnonzero(at < 0).tolist():
            row = cache.get(words[i])
            if row is None:
                row = self.unseen(words[i])
                if len(cache) < CACHE:
                    cache[words[i]] = row
            out[i] = row
        return out


def fit(labelled: DataFrame, docs_a_language: int = 5000, words: int = 15_000, grams: int = 4000) -> Model:
    """Fit on rows (id, text, lang) with non-null lang."""
    labelled = labelled.filter("lang is not null and text is not null and id is not null")
    per_lang = labelled.groupBy("lang").count().collect()  # one row per language
    langs = sorted(r["lang"] for r in per_lang)
    if not langs:
        return Model([], Table([], [], "word"), Table([], [], "gram"))
    share = F.lit(0.0)
    for r in per_lang:
        share = F.when(F.col("lang") == r["lang"], min(1.0, docs_a_language / r["count"])).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col("id").cast("string")), F.lit(1 << 30)) < share * (1 << 30)
    sample = labelled.filter(drawn).select("lang", "text")
    counted = sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))
    pieces = counted.mapInArrow(_char_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))

    def most_frequent(df: DataFrame, kind: str, order: Column, limit: int) -> list:
        # a window holds the words, or n-grams of an order, of one language's sample
        rank = F.row_number().over(Window.partitionBy("lang", order).orderBy(F.desc("n"), kind))
        top = df.withColumn("rank", rank).filter(F.col("rank") <= limit).select(kind).distinct()
        return df.join(top, kind, "left_semi").orderBy(kind, "lang").collect()

    counted, pieces = written(counted, "language-words"), written(pieces, "language-grams")
    return Model(langs, Table(most_frequent(counted, "word", F.lit(0), words), langs, "word"),
                 Table(most_frequent(pieces, "gram", F.length("gram"), grams), langs, "gram"))


def _beside(batches: Iterator[pa.RecordBatch], field: str | None) -> Iterator[pa.RecordBatch]:
    """Batches with the named field of the struct `row` as their column text; its bytes are not copied."""
    for batch in batches:
        if field is None:
            yield batch
        else:
            row = batch.column("row")
            yield batch.append_column("text", row.field(row.type.get_field_index(field)))


def _predict(shared, field: str | None = None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        cache: dict[str, np.ndarray] = {}
        for batch in slices(_beside(batches, field), "text", SLICE_BYTES):
            flat, offsets = words_of(batch.column("text"))
            n = batch.num_rows
            best, score = np.zeros(n, np.int64), np.zeros(n)
            spoken = np.diff(offsets) > 0
            if len(flat) and model.langs:
                coded = flat.dictionary_encode()
                table = model.scores(coded.dictionary.to_pylist(), cache)
                sums = np.zeros((n, len(model.langs)))
                sums[spoken] = np.add.reduceat(table[coded.indices.to_numpy()].astype(np.float64), offsets[:-1][spoken], axis=0)
                sums = sums - sums.max(axis=1, keepdims=True)
                best, score = sums.argmax(axis=1), 1 / np.exp(sums).sum(axis=1)
            known = spoken & bool(model.langs)
            names = np.array([*model.langs, UNKNOWN], object)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"),
                 pa.array(names[np.where(known, best, len(model.langs))], pa.string()),
                 pa.array(np.where(known, score, 0.0))], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])
    return predict


def predict(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """rows without the text, plus lang_pred and score; a column of rows with one of these names gives way."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most words + 4 * grams entries a language
    kept = [f for f in rows.schema.fields if f.name not in (text_col, "text", "lang_pred", "score")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    rows = rows.select(*[f"`{f.name}`" for f in kept], F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(shared), schema)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5: 0 is held out."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row; the model learns from labelled rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), fold(F.col(id_col)).alias("fold"))
    model = fit(rows.filter("fold <> 0").select("id", "text", "lang"), **bounds)
    held_out = F.coalesce(F.col("fold") == 0, F.lit(False))
    return predict(rows.select("id", held_out.alias("held_out"), "text"), model).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    least_score: float = 0.5) -> DataFrame:
    """The rows of docs that have a language, with all their columns: those whose prediction is not `und` and has
    least_score at least. Where no labelled row gives a model, those whose text holds a letter."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), fold(F.col(id_col)).alias("fold"))
    model = fit(rows.filter("fold <> 0").select("id", "text", "lang"))
    if not model.langs:
        return docs.filter(F.col(text_col).cast("string").rlike(r"\p{L}"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if docs.schema[text_col].dataType.simpleString() == "string" and docs.columns.count(text_col) == 1:  # the text travels once
        shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as in predict
        judged = packed.mapInArrow(_predict(shared, text_col), T.StructType(list(packed.schema.fields)).add("lang_pred", "string").add(
            "score", "double"))
    else:
        judged = predict(packed.withColumn("text", F.col("row")[text_col].cast("string")), model)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
