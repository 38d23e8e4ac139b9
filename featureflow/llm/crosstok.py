"""Cross-tokenizer alignment on Arrow columns.

Two tokenizers cut the same bytes, space + text, in two ways. Side A is a
byte-level BPE file of the tokenizers library (encoded with tiktoken, which
takes its entries as ranks and gives the same ids), side B a sentencepiece
vocabulary.

1. Tokens. Each slice of an Arrow batch is encoded by both sides; a text whose
   joined token bytes differ from space + text on either side has no tokens.
2. Alignment, a slice of id lists at a time: flattened lists with parent
   indices, segmented cumulative sums of the byte lengths, and an Acero hash
   join on (document, end), which gives the offsets where tokens of both sides
   end. Two tokens overlap on one stretch between neighbouring ends, so every
   distinct end names exactly one link and no pair is tried in vain. Links are
   written once, a row's as packed ids of both sides, in the shared folder.
3. Counts. `Table.group_by` counts the id pairs of a slice of links, Spark sums
   these partial counts over the corpus.
4. Look-up. The most frequent pairs, `frequent` at most (a parameter, so the
   broadcast is bounded), reach all tasks; links of the other pairs are
   counted by row and joined with the count table, so every link is looked up.

Null and empty texts, and texts whose bytes do not come back (e.g. U+2581 in
the text), have zeros and an empty group string. Equal rows, equal ids and null
ids get a result each. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.words import ranges, raw, slices
from featureflow.session import scratch_path

SLICE_BYTES = 1 << 19
TOKENS = 200_000        # tokens of side A, or links, that are worked on together (one row at least)
FREQUENT = 1 << 20      # pairs in the broadcast at most
OCTAVE = 8              # steps of the count histogram in a doubling
# how byte-level BPE files cut texts before merging (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Side:
    """A vocabulary's entries as bytes, and its encoder (list of texts -> list of id lists)."""

    def __init__(self, entries: list[bytes], encode):
        self.encode = encode
        self.lens = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def returned(self, ids: np.ndarray, counts: np.ndarray, want: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which rows' joined token bytes are the bytes want[offsets[r]:offsets[r + 1]]."""
        lens = self.lens[ids]
        ends = np.append(0, np.cumsum(lens))[np.append(0, np.cumsum(counts))]
        n = np.diff(offsets)
        same = np.diff(ends) == n
        rows = np.flatnonzero(same & (n > 0))
        if len(rows):
            got = self.data[ranges(self.starts[ids], lens)]
            equal = got[ranges(ends[:-1][rows], n[rows])] == want[ranges(offsets[:-1][rows], n[rows])]
            same[rows] = np.logical_and.reduceat(equal, np.cumsum(n[rows]) - n[rows])
        return same


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level entries: visible Latin-1 characters stand for
    themselves, the other bytes take the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_bpe(data: str) -> Side:
    """A byte-level BPE file of the tokenizers library; texts are encoded behind a space.

    Ids grow with the order of the merges (checked), so a pair's merged id is its rank. A pair that joins to an
    entry has that entry's own last merge: between borders that no earlier merge has crossed, an entry's bytes
    merge as they do alone."""
    import tiktoken
    file = json.loads(data)
    vocab, cut = file["model"]["vocab"], file["pre_tokenizer"]
    if cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or file["normalizer"]:
        raise ValueError("a byte-level file without a normalizer or a prefix space is needed")
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    merged = [vocab[left + right] for left, right in merges]
    if merged != sorted(set(merged)):
        raise ValueError("ids have to grow with the order of the merges")
    byte = byte_level()
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    entries = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in {**vocab, **special}.items():
        entries[i] = bytes(byte[c] for c in token)
    ranks = {entries[i]: i for token, i in vocab.items() if token not in special}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(entries, lambda texts: [encoding.encode_ordinary(" " + x) for x in texts])


def piece_bpe(data: bytes) -> Side:
    """A sentencepiece model, which adds the space itself."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    entries = []
    for i in range(len(sp)):
        piece = sp.id_to_piece(i)
        plain = b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace("▁", " ").encode()
        entries.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else plain)
    return Side(entries, lambda texts: sp.encode(texts, num_threads=1))


_sides: dict[tuple, tuple[Side, Side]] = {}


def sides(model: tuple[str, bytes]) -> tuple[Side, Side]:
    """Both sides, built once in a Python worker."""
    key = (hash(model[0]), hash(model[1]))
    if key not in _sides:
        _sides[key] = byte_bpe(model[0]), piece_bpe(model[1])
    return _sides[key]


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values))


class Alignment:
    """Tokens of both sides of some rows, the places where both end, and the links."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, both: tuple[Side, Side]):
        self.rows = len(a)
        self.ids, self.row, self.ends, self.counts = [], [], [], []
        tables = []
        for arr, side, name in ((a, both[0], "i"), (b, both[1], "j")):
            ids = pc.list_flatten(arr).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(arr).to_numpy(zero_copy_only=False)
            ends = pc.cumulative_sum(pa.array(side.lens[ids])).to_numpy(zero_copy_only=False)
            counts = np.bincount(row, minlength=self.rows)
            first = np.cumsum(counts) - counts  # a segment's sums start behind the rows before it
            before = np.append(0, ends)[first]
            tables.append(pa.table({"row": row, "end": ends - before[row], name: np.arange(len(ids))}))
            self.ids.append(ids)
            self.row.append(row)
            self.ends.append(ends)
            self.counts.append(counts)
        common = tables[0].join(tables[1], ["row", "end"], join_type="inner", use_threads=False).sort_by("i")
        self.i, self.j = (common[c].to_numpy() for c in ("i", "j"))  # the last tokens of each group
        self.groups = np.bincount(self.row[0][self.i], minlength=self.rows)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, A id, B id) of every link, in row order."""
        (ea, eb), (ia, ib) = self.ends, self.ids
        alone = np.ones(len(ib), bool)
        alone[self.j] = False
        alone = np.flatnonzero(alone)  # B tokens that end inside an A token
        left = np.append(np.arange(len(ia)), np.searchsorted(ea, eb[alone]))
        right = np.append(np.searchsorted(eb, ea), alone)
        row = self.row[0][left]
        order = np.argsort(row, kind="stable")
        return row[order], ia[left[order]], ib[right[order]]

    def strings(self, digits: "Digits") -> list[bytes]:
        """Each row's groups as `a1,a2|b1;a3|b2`."""
        na, nb = len(self.ids[0]), len(self.ids[1])
        if not na:
            return [b""] * self.rows
        # a token stands behind its own side's earlier tokens and the other side's tokens of earlier groups
        group_a = np.searchsorted(self.i, np.arange(na))
        group_b = np.searchsorted(self.j, np.arange(nb))
        at_a = np.arange(na) + np.append(0, self.j + 1)[group_a]
        at_b = np.arange(nb) + (self.i + 1)[group_b]
        ids, ends = np.empty(na + nb, np.int64), np.full(na + nb, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.ids[0], self.ids[1]
        ends[at_a[self.i]], ends[at_b[self.j]] = ord("|"), ord(";")
        text, stops = digits.joined(ids, ends)
        stops = np.append(0, stops)[np.append(0, np.cumsum(self.counts[0] + self.counts[1]))]
        return [text[s:max(s, e - 1)] for s, e in zip(stops[:-1].tolist(), stops[1:].tolist())]


class Digits:
    """Decimal texts of small numbers, each with room for one more character."""

    def __init__(self, n: int):
        self.lens = np.array([len(str(i)) + 1 for i in range(n)], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer("".join(f"{i} " for i in range(n)).encode(), np.uint8)

    def joined(self, numbers: np.ndarray, closing: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The numbers' texts, each followed by its closing character, and where each ends."""
        lens = self.lens[numbers]
        out = self.data[ranges(self.starts[numbers], lens)]
        stops = np.cumsum(lens)
        out[stops - 1] = closing
        return out.tobytes(), stops


def _pieces(batch: pa.RecordBatch, many: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Cut a batch whose rows hold so many values into row ranges of about TOKENS values."""
    ends, at = np.append(0, np.cumsum(many, dtype=np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1)
        yield batch.slice(at, to - at), many[at:to]
        at = to


def kind_of(both: tuple[Side, Side]) -> str:
    """The packed type of an id."""
    return "<u2" if max(len(s.lens) for s in both) <= 1 << 16 else "<u4"


def packed(left: np.ndarray, right: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """Each row's A ids followed by its B ids, as bytes."""
    ends = np.cumsum(counts)
    starts = ends - counts
    place = np.arange(len(left)) + np.repeat(starts, counts)  # behind both sides of the rows before
    data = np.empty(2 * len(left), kind)
    data[place], data[place + np.repeat(counts, counts)] = left, right
    offsets = np.append(0, 2 * ends * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(batch: pa.RecordBatch, kind: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(some rows, their numbers of links, A id * width + B id of every link)."""
    size = 2 * np.dtype(kind).itemsize
    many = (pc.binary_length(batch.column("links")).to_numpy(zero_copy_only=False) // size).astype(np.int64)
    for part, counts in _pieces(batch, many):
        data = raw(part.column("links"))[0].view(kind)
        starts = np.cumsum(counts) - counts
        place = np.arange(int(counts.sum())) + np.repeat(starts, counts)
        yield part, counts, data[place].astype(np.int64) * width + data[place + np.repeat(counts, counts)]


def _encoded(batch: pa.RecordBatch, both: tuple[Side, Side]) -> pa.RecordBatch:
    """(id, a, b): the id lists of a batch's texts; empty where the bytes do not come back."""
    text = batch.column("text")
    full = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(text), 0), False).to_numpy(zero_copy_only=False))
    said = text.take(pa.array(full))
    want, offsets = raw(pc.binary_join_element_wise(" ", said, ""))
    texts, good, found = said.to_pylist(), np.ones(len(full), bool), []
    for side in both:
        encoded = side.encode(texts)
        counts = np.array([len(x) for x in encoded], np.int64)
        ids = np.fromiter(chain.from_iterable(encoded), np.int32, int(counts.sum()))
        good &= side.returned(ids, counts, want, offsets)
        found.append((ids, counts))
    out = []
    for ids, counts in found:
        own = np.zeros(batch.num_rows, np.int64)
        own[full] = np.where(good, counts, 0)
        out.append(lists(ids[np.repeat(good, counts)], own))
    return pa.RecordBatch.from_arrays([batch.column("id"), *out], ["id", "a", "b"])


def _align(shared):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(shared.value)
        digits, kind = Digits(max(len(s.lens) for s in both)), kind_of(both)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = _encoded(batch, both)
            for part, _ in _pieces(ids, ids.column("a").value_lengths().to_numpy(zero_copy_only=False)):
                found = Alignment(part.column("a"), part.column("b"), both)
                row, left, right = found.links()
                n_links = np.bincount(row, minlength=part.num_rows)
                digest = [hashlib.sha256(s).hexdigest() if s else "" for s in found.strings(digits)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(c.astype(np.int64)) for c in (*found.counts, found.groups, n_links)),
                     pa.array(digest, pa.string()), packed(left, right, n_links, kind)],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
    return align


def _count(kind: str, width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, pair in _unpacked(batch, kind, width):
                partial = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
                yield from partial.rename_columns(["pair", "n"]).to_batches()
    return count


def _look_up(known, kind: str, width: int):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            for part, counts, pair in _unpacked(batch, kind, width):
                row = np.repeat(np.arange(len(counts)), counts)
                coded = pa.array(pair).dictionary_encode()
                names, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                at = np.searchsorted(pairs, names)
                hit = at < len(pairs)
                hit[hit] = pairs[at[hit]] == names[hit]
                times, top = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                times[hit], top[hit] = n[at[hit]], best[at[hit]]
                sums, bests = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                some = np.flatnonzero(counts)
                first = (np.cumsum(counts) - counts)[some]
                if len(some):
                    sums[some], bests[some] = np.add.reduceat(times[code], first), np.add.reduceat(top[code], first)
                rare = ~hit[code]
                rest = pa.table({"row": row[rare], "pair": pair[rare]}).group_by(["row", "pair"], use_threads=False).aggregate(
                    [([], "count_all")]).sort_by([("row", "ascending"), ("pair", "ascending")])
                many = np.bincount(rest["row"].to_numpy(), minlength=part.num_rows)
                kept = [c for c in part.schema.names if c != "links"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(bests), pa.array(sums), lists(rest["pair"].to_numpy(), many),
                     lists(rest["count_all"].to_numpy(), many)], [*kept, "n_best", "count_sum", "rare", "rare_n"])
    return look_up


def frequent_pairs(counts: DataFrame, limit: int) -> DataFrame:
    """The pairs of the largest counts: those above a step of the count histogram, `limit` at most."""
    step = F.floor(F.log2("n") * OCTAVE)
    left, least = limit, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred rows
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    return counts.filter(step >= least) if least is not None else counts.limit(0)


def align(docs: DataFrame, byte_bpe_path: str, piece_bpe_path: str, id_col: str = "doc_id", text_col: str = "text",
          frequent: int = FREQUENT) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs."""
    spark = docs.sparkSession
    path = scratch_path(spark, "cross-tokenizer")
    with open(byte_bpe_path, encoding="utf-8") as f, open(piece_bpe_path, "rb") as g:
        model = f.read(), g.read()
    shared = spark.sparkContext.broadcast(model)  # the two vocabulary files
    both = sides(model)
    width, packing = len(both[1].lens), kind_of(both)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    rows.mapInArrow(_align(shared), f"{kind}, links binary").write.option("compression", "zstd").parquet(f"{path}/links")
    links = spark.read.parquet(f"{path}/links")

    partial = links.select("links").mapInArrow(_count(packing, width), "pair long, n long")
    partial.groupBy("pair").agg(F.sum("n").alias("n")).write.parquet(f"{path}/sums")
    sums = spark.read.parquet(f"{path}/sums").withColumn("b", F.col("pair") % width)
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    sums.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")

    top = frequent_pairs(counts, frequent).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    links.withColumn("place", F.monotonically_increasing_id()).mapInArrow(
        _look_up(known, packing, width), f"{kind}, place long, n_best long, count_sum long, rare array<long>, rare_n array<long>").write.parquet(f"{path}/rows")
    found = spark.read.parquet(f"{path}/rows")
    rare = found.select("place", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select(
        "place", F.col("x.rare").alias("pair"), F.col("x.rare_n").alias("times"))
    more = rare.join(counts, "pair").groupBy("place").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"),
                                                          F.sum(F.col("times") * F.col("best")).alias("more_best"))
    full = found.join(more, "place", "left")
    plus = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return full.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"),
                       plus("count_sum", "more_sum"), "groups_sha256")
