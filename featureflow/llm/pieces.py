"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding works on an agenda of adjacent symbol pairs: the pair whose merged
piece has the best score goes first, ties from the left, until no pair is in
the vocabulary; symbols that are no piece become bytes. No piece of a usable
vocabulary has the space mark after another character, so merges never cross
into a new word, and each distinct word is encoded once per slice of an Arrow
batch; words of earlier slices are kept, as flat arrays of ids, until there are
`CACHE` of them, when only the current slice's stay. The agendas of short words
of similar length advance together, one merge per step; long words use a heap.
Every newly encoded word is checked against the sentencepiece library in the
same batch; a difference raises.

Null texts count as empty: they have the end id only.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.words import ranges, slices

SPACE = "▁"
SHORT = 24       # longest word (characters) encoded in the common agenda
CACHE = 200_000   # words kept between slices
TOGETHER = 20_000 # words whose agendas advance together
END, UNKNOWN = -3, -4   # symbols: past a word's end; UNKNOWN - c: character c, which is no piece
SLICE_BYTES = 2 << 20
NO_PAIR = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces, and for each pair of adjacent symbols the piece it merges to."""

    def __init__(self, model: bytes):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(len(sp))
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        normal = {sp.id_to_piece(i): i for i in ids
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in normal) or len(self.byte) != 256:
            raise ValueError("the vocabulary needs byte pieces and space marks at piece starts only")
        self.normal, self.eos, self.size = normal, sp.eos_id(), len(sp)
        self.symbol = UNKNOWN - np.arange(0x110000, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        text = {i: p.replace(SPACE, " ").encode() for p, i in normal.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.text_lens = np.array([len(text.get(i, b"")) for i in ids], np.int64)
        self.text_starts = np.cumsum(self.text_lens) - self.text_lens
        self.text = np.frombuffer(b"".join(text.get(i, b"") for i in ids), np.uint8)
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        pairs = sorted((normal[p[:k]] * self.size + normal[p[k:]], i, order[sp.get_score(i)])
                       for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal)
        self.keys, self.merged, self.rank = (np.array(x, np.int64) for x in zip(*pairs))
        self.pair = {k: (r, m) for k, m, r in pairs}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; NO_PAIR where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NO_PAIR).astype(np.int32), np.where(hit, self.merged[at], -1).astype(np.int32)

    def together(self, points: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode words given by their code points and lengths, one merge per word and step: flat ids, and their counts."""
        wide, n = int(lens.max()), len(lens)
        columns = np.arange(wide)
        sym = np.full((n, wide + 1), END, np.int32)
        sym[:, :-1][columns[None, :] < lens[:, None]] = self.symbol[points]
        rank, to = self.look_up(sym[:, :-1], sym[:, 1:])
        live = np.arange(n)
        while len(live):
            j = rank[live].argmin(axis=1)
            go = rank[live, j] < NO_PAIR
            live, j = live[go], j[go]
            if not len(live):
                break
            s, a, b = sym[live], rank[live], to[live]
            s[np.arange(len(live)), j] = b[np.arange(len(live)), j]
            after = columns[None, :] > j[:, None]
            s[:, :-1] = np.where(after, s[:, 1:], s[:, :-1])
            s[:, -1] = END
            after = columns[None, :-1] >= j[:, None]
            a[:, :-1] = np.where(after, a[:, 1:], a[:, :-1])
            b[:, :-1] = np.where(after, b[:, 1:], b[:, :-1])
            a[:, -1], b[:, -1] = NO_PAIR, -1
            rows = np.arange(len(live))
            a[rows, j], b[rows, j] = self.look_up(s[rows, j], s[rows, j + 1])
            inner = j > 0
            r, k = rows[inner], j[inner]
            a[r, k - 1], b[r, k - 1] = self.look_up(s[r, k - 1], s[r, k])
            sym[live], rank[live], to[live] = s, a, b
        there = sym != END
        flat, counts = sym[there], there.sum(axis=1)
        return self.as_bytes(flat, counts) if (flat < 0).any() else (flat, counts)

    def as_bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with the unknown characters replaced by the pieces of their bytes."""
        odd = np.flatnonzero(flat < 0)
        parts = [[self.byte[b] for b in chr(UNKNOWN - s).encode()] for s in flat[odd].tolist()]
        lens = np.ones(len(flat), np.int64)
        lens[odd] = [len(p) for p in parts]
        out = np.repeat(flat, lens)
        out[ranges((np.cumsum(lens) - lens)[odd], lens[odd])] = np.fromiter(chain.from_iterable(parts), np.int32)
        return out, np.add.reduceat(lens, np.cumsum(counts) - counts)

    def alone(self, word: str) -> list[int]:
        """Encode one word of any length with a heap."""
        sym = [self.normal.get(ch, -1) for ch in word]
        n = len(sym)
        left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (found := self.pair.get(sym[i] * self.size + sym[j])):
                heapq.heappush(heap, (found[0], i, j, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            push(i)
        gone = [False] * n
        while heap:
            _, i, j, a, b, merged = heapq.heappop(heap)
            if gone[i] or gone[j] or right[i] != j or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], right[i] = merged, True, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        out, i = [], 0
        while 0 <= i < n:
            out += [sym[i]] if sym[i] >= 0 else [self.byte[b] for b in word[i].encode()]
            i = right[i]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words (each starts with a space mark), and their counts, checked against the library."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(lens) - lens
        flats, counts = [], np.zeros(len(words), np.int64)
        n_short = int(np.searchsorted(lens[order], SHORT, side="right"))
        for at in range(0, n_short, TOGETHER):
            part = order[at:min(at + TOGETHER, n_short)]
            flat, counts[part] = self.together(points[ranges(starts[part], lens[part])], lens[part])
            flats.append(flat)
        for i in order[n_short:].tolist():
            ids = self.alone(words[i])
            counts[i] = len(ids)
            flats.append(np.array(ids, np.int32))
        flat = np.concatenate(flats)
        place = np.empty(len(words), np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        flat = flat[ranges(place, counts)]
        expected = self.library.encode([w[1:].replace(SPACE, " ") for w in words], num_threads=1)
        alone = [i for i, e in enumerate(expected) if not e]  # a space mark alone: the library sees an empty text
        for i in alone:
            expected[i] = flat[counts[:i].sum():counts[:i + 1].sum()].tolist() if words[i] == SPACE else []
        same = np.fromiter(map(len, expected), np.int64, len(expected)) == counts
        if not same.all() or (np.fromiter(chain.from_iterable(expected), np.int32, len(flat)) != flat).any():
            differ = next(w for w, e, k in zip(words, expected, np.cumsum(counts).tolist()) if e != flat[k - len(e):k].tolist())
            raise RuntimeError(f"agenda and library differ on {differ[:80]!r}")
        return flat, counts


class Known:
    """Encoded words: their numbers, and their ids in one flat array. Number 0 is the end of a text."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.keep({}, np.array([v.eos], np.int32), np.ones(1, np.int64))

    def keep(self, numbers: dict[str, int], flat: np.ndarray, counts: np.ndarray) -> None:
        self.numbers, self.flat, self.counts = numbers, flat, counts
        self.starts = np.cumsum(counts) - counts

    def look_up(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words; new ones are encoded."""
        found = np.fromiter((self.numbers.get(w, 0) for w in words), np.int64, len(words))
        new = np.flatnonzero(found == 0).tolist()
        if new:
            if len(self.numbers) + len(new) > CACHE:  # only this slice's words stay
                old = [i for i, k in enumerate(found.tolist()) if k]
                used = np.append(0, found[old])
                self.keep({words[i]: k + 1 for k, i in enumerate(old)}, self.flat[ranges(self.starts[used], self.counts[used])],
                          self.counts[used])
                found[old] = np.arange(1, len(old) + 1)
            flat, counts = self.v.encode_words([words[i] for i in new])
            found[new] = len(self.counts) + np.arange(len(new))
            self.numbers.update((words[i], k) for i, k in zip(new, found[new].tolist()))
            self.keep(self.numbers, np.append(self.flat, flat), np.append(self.counts, counts))
        return found


def words_of(text: str) -> list[str]:
    """Words of a text, each with the space marks before it."""
    return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE)) if text else []


_vocabularies: dict[int, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    key = hash(model)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(model)
    return _vocabularies[key]


def _encode(model: bytes):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        known = Known(v)
        for batch in slices(batches, "text", SLICE_BYTES):
            text = batch.column("text").fill_null("")
            lists = pc.split_pattern(text, " ")
            flat, rows = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            rows = rows - rows[0]
            coded = flat.dictionary_encode()
            distinct, index = [SPACE + w for w in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64)
            # rows with repeated, leading or trailing spaces or space marks are split one by one
            odd = pc.or_(pc.equal(pc.binary_length(flat), 0), pc.match_substring(flat, SPACE)).to_numpy(zero_copy_only=False)
            odd_rows = np.unique(np.searchsorted(rows, np.flatnonzero(odd), side="right") - 1)
            if len(odd_rows):
                places = {w: i for i, w in enumerate(distinct)}
                parts, at = [], 0
                counts = np.diff(rows)
                for r in odd_rows.tolist():
                    parts.append(index[at:rows[r]])
                    own = words_of(text[r].as_py())
                    parts.append(np.array([places.setdefault(w, len(places)) for w in own], np.int64))
                    counts[r], at = len(own), rows[r + 1]
                parts.append(index[at:])
                index, distinct = np.concatenate(parts), list(places)
                rows = np.append(0, np.cumsum(counts))
            used = np.unique(index)
            number = np.zeros(len(distinct) + 1, np.int64)  # the last one closes each row
            number[used] = known.look_up([distinct[i] for i in used.tolist()])
            index = np.insert(index, rows[1:], len(distinct))
            rows = rows + np.arange(len(rows))
            ids, id_rows = _gather(known.flat, known.starts, known.counts, number[index], rows)
            decoded, text_rows = _gather(v.text, v.text_starts, v.text_lens, ids, id_rows)
            decoded = decoded.tobytes()
            # the first space mark of a text is the encoder's own
            texts = [decoded[a + 1:b].decode("utf-8", "replace") for a, b in zip(text_rows[:-1].tolist(), text_rows[1:].tolist())]
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.ListArray.from_arrays(pa.array(id_rows, pa.int32()), pa.array(ids)),
                 pa.array(texts, pa.string())], [*others, "ids", "decoded"])
    return encode


def _gather(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the entries of data that index names; returns the data and each row's offsets in it."""
    taken = lens[index]
    return data[ranges(starts[index], taken)], np.append(0, np.cumsum(taken))[rows]


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs without the text, plus ids (end id included) and the text decoded from them. A column of docs with one of
    these two names gives way to the result."""
    with open(model_path, "rb") as f:
        model = f.read()
    kept = [f for f in docs.schema.fields if f.name not in (text_col, "text", "ids", "decoded")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids array<int>", "decoded string"])
    rows = docs.select(*[f"`{f.name}`" for f in kept], F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(model), schema)
