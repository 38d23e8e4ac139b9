"""Spelling variant grouping with a relational trie frontier.

1. Words are counted over the corpus; a word takes part with `least_length`
   code points and `least_count` occurrences at least.
2. Two tries, of the words and of the words reversed, are tables. A node is a
   hash of its prefix; nodes with one way on and no word's end are passed over,
   so an edge (node, label, child) carries a stretch of characters and a word
   of any length has few levels.
3. Frontier. States (word, position, node, edits) start on each word's own path
   behind half of its characters and join the edge table on the node, level by
   level, until no state is left. A state without an edit goes on along its own
   characters, or spends the edit: a label that differs in its first character
   is taken as a replaced or inserted one, or behind a deleted one. A state that
   has spent it must match. One edit leaves the first or the last half of a word
   as it is, so the two tries find all pairs, and as a word's half is a long
   prefix, few labels fit: no state visits the crowded top of a trie.
4. States at a word's end with one edit are neighbours, verified on the words
   themselves, so equal hashes of different prefixes add or lose nothing.
5. A word's form is its most frequent neighbour, if it is `ratio` times as
   frequent; counts grow along forms, so roots need few rounds of doubling.

Words are counted as whole texts have them: null texts have none, a null id
counts as an empty one. Ties go to the smallest form in code-point order. The
alphabet has 90 characters, which bounds a node's edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featureflow.llm.exactdedup import ascii_lower
from featureflow.llm.words import BYTE_CODE, POS_BASE, U64, mix, ranges
from featureflow.session import scratch_path

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
DROP_ONE_IN = 31        # of the occurrences, so many lose a character by the contract of the query
SIDES = (U64(0x632BE59BD9B4E019), U64(0xE220A8397B1DCDAF))
WORDS_AT_ONCE = 20_000


def dropped(run: Column, key: Column) -> Column:
    """run without one character where 31 divides the crc32 of `key:run`."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(DROP_ONE_IN)) == 0, short).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts that take part; the last character drop makes the query's variants."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))  # shorter runs give no word
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    words = docs.select(key.alias("key"), F.explode(runs).alias("run")).select("key", ascii_lower(F.col("run")).alias("run"))
    words = words.select(dropped(F.col("run"), F.col("key")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(
        F.col("n") >= least_count)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, word, at, node, step): the nodes of each word from one character before its half on; an empty step
    is the word's end. All characters are below U+0100, so a Latin-1 byte is a character."""
    for batch in batches:
        for start in range(0, batch.num_rows, WORDS_AT_ONCE):
            part = batch.slice(start, WORDS_AT_ONCE)
            words, side = part.column("word"), part.column("side").to_numpy()
            coded = [w.encode("latin-1") for w in words.to_pylist()]
            lens = np.array([len(w) for w in coded], np.int64)
            chars = np.frombuffer(b"".join(coded), np.uint8)
            first = np.cumsum(lens) - lens
            place = np.arange(len(chars)) - np.repeat(first, lens)
            powers = np.cumprod(np.full(int(lens.max()), POS_BASE, U64))
            sums = np.append(U64(0), np.cumsum(BYTE_CODE[chars] * powers[place]))  # wraps around
            low = np.where(side == 0, (lens - 1) // 2, lens // 2)
            many = lens - low + 1
            row = np.repeat(np.arange(len(lens)), many)
            at = ranges(low, many)
            prefix = sums[first[row] + at] - sums[first[row]]
            node = mix((prefix + at.astype(U64)) ^ np.array(SIDES)[side[row]])
            inside = at < lens[row]
            letters = np.frombuffer(b"".join(coded) + b"\0", np.uint8)[np.where(inside, first[row] + at, -1)]
            step = pa.array([chr(c) for c in range(256)]).take(pa.array(letters))
            step = pc.if_else(pa.array(inside), step, "")
            yield pa.RecordBatch.from_arrays(
                [pa.array(side[row]), words.take(pa.array(row)), pa.array(at.astype(np.int32)),
                 pa.array(node.view(np.int64)), step], ["side", "word", "at", "node", "step"])


def bloom(suffix: Column) -> list[Column]:
    """Two masks of one bit each that stand for a suffix."""
    h = F.xxhash64(suffix)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int")) for x in (h, F.shiftright(h, 6))]


def half(word: Column, side: Column) -> Column:
    """Where a word's states start."""
    return F.when(side == 0, F.floor(F.length(word) / 2)).otherwise(F.ceil(F.length(word) / 2)).cast("int")


def build_tries(words: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges (node, label, child, m0, m1), ends (node, word), start states) of both tries of `word`."""
    spark = words.sparkSession
    both = words.select(F.lit(0).alias("side"), "word").unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("word")))
    both.mapInArrow(_paths, "side int, word string, at int, node long, step string").write.parquet(f"{path}/paths")
    paths = spark.read.parquet(f"{path}/paths")
    below = [F.bit_or(m).alias(f"m{i}") for i, m in enumerate(bloom(F.substring(F.col("word"), F.col("at") + 1, F.length("word"))))]
    stops = paths.groupBy("node").agg(F.min("step").alias("low"), F.max("step").alias("high"), *below).filter(
        (F.col("low") != F.col("high")) | (F.col("low") == "")).drop("low", "high")
    own = F.array_sort(F.collect_list(F.struct("at", "node", "m0", "m1")))  # one word's own path
    paths.join(stops, "node").groupBy("side", "word").agg(own.alias("path")).write.parquet(f"{path}/stops")
    stops = spark.read.parquet(f"{path}/stops")
    hop = F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"),
                                 F.slice("path", F.lit(2), F.size("path") - 1).alias("b")))
    label = F.substring(F.col("word"), F.col("hop.a.at") + 1, F.col("hop.b.at") - F.col("hop.a.at"))
    stops.select("word", hop.alias("hop")).select(
        F.col("hop.a.node").alias("node"), label.alias("label"), F.col("hop.b.node").alias("child"), "hop.b.m0", "hop.b.m1").distinct().write.parquet(f"{path}/edges")
    last = F.element_at("path", -1)
    ends = stops.select(last["node"].alias("node"), "side", F.col("word").alias("other"))
    begin = F.element_at(F.filter("path", lambda p: p["at"] >= half(F.col("word"), F.col("side"))), 1)
    starts = stops.select("side", "word", begin["at"].alias("pos"), begin["node"].alias("node"), F.lit(0).alias("edits"))
    return spark.read.parquet(f"{path}/edges"), ends, starts


def advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level on."""
    word, pos, label, n = F.col("word"), F.col("pos"), F.col("label"), F.length("label")
    from_ = lambda start, many: F.substring(word, start + 1, many)  # noqa: E731  characters from position start
    other = (F.col("edits") == 0) & (F.substring(label, 1, 1) != from_(pos, F.lit(1)))
    left, tail = pos < F.length(word), F.substring(label, F.lit(2), n)
    moves = [(from_(pos, n) == label, pos + n, F.col("edits")),
             (other & left & (from_(pos + 1, n - 1) == tail), pos + n, F.lit(1)),       # replaced
             (other & (from_(pos, n - 1) == tail), pos + n - 1, F.lit(1)),              # inserted
             (other & left & (from_(pos + 1, n) == label), pos + n + 1, F.lit(1))]      # deleted
    some = moves[0][0]
    for fits, _, _ in moves[1:]:
        some = some | fits
    steps = F.array(*[F.when(fits, F.struct(at.cast("int").alias("pos"), edits.alias("edits"))) for fits, at, edits in moves])
    went = states.join(edges, "node").filter(some).select("side", "word", F.explode(steps).alias("to"), F.col("child").alias("node"), "m0", "m1")
    went = went.filter("to is not null").select("side", "word", F.col("to.pos").alias("pos"), "node", F.col("to.edits").alias("edits"), "m0", "m1")
    rest = bloom(F.substring(word, pos + 1, F.length(word)))
    admits = (F.col("m0").bitwiseAND(rest[0]) != 0) & (F.col("m1").bitwiseAND(rest[1]) != 0)
    return went.filter((F.col("edits") == 0) | admits).drop("m0", "m1")


def neighbours(words: DataFrame, path: str) -> DataFrame:
    """(word, near): all ordered pairs of words that differ by one inserted, deleted or replaced character."""
    spark = words.sparkSession
    edges, ends, states = build_tries(words, path)
    done = F.col("pos") == F.length("word")
    found, level = None, 0
    while True:
        states.write.parquet(f"{path}/level{level}")
        here = spark.read.parquet(f"{path}/level{level}")
        last = here.filter(((F.col("edits") == 1) & done) | ((F.col("edits") == 0) & (F.col("pos") == F.length("word") - 1)))
        last = last.select("side", "word", "node")  # at a word's end, or with the last character deleted
        found = last if found is None else found.unionByName(last)
        open_ = here.filter((F.col("edits") == 0) | ~done)
        if open_.isEmpty():
            break
        states, level = advance(open_, edges), level + 1
    met = found.join(ends, ["side", "node"]).filter(F.levenshtein("word", "other", 1) == 1)
    right = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    return met.select(right("word").alias("word"), right("other").alias("near")).distinct()


def roots(forms: DataFrame, path: str) -> DataFrame:
    """(word, root) of every word with a form: form after form to the last, in rounds of doubling."""
    spark = forms.sparkSession
    forms.select("word", F.col("form").alias("root")).write.parquet(f"{path}/roots0")
    i = 0
    while True:
        now = spark.read.parquet(f"{path}/roots{i}")
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        i += 1
        now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")
                                            ).write.parquet(f"{path}/roots{i}")
        now = spark.read.parquet(f"{path}/roots{i}")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every counted word (word, n); words are distinct runs of LETTERS."""
    spark = words.sparkSession
    path = scratch_path(spark, "spelling")
    words.select("word", "n").write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    near = neighbours(words.select("word"), path).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    form = F.when(-F.col("best.n") >= F.col("n") * ratio, F.col("best.near"))
    words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("best.n")).alias("form_n")).write.parquet(f"{path}/forms")
    out = spark.read.parquet(f"{path}/forms")
    ends = roots(out.filter("form is not null"), path)
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
