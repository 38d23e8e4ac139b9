"""License scan with a positional rare-token index.

The index is a table of postings (word, template, position). IDF weights come
from the document frequencies of the templates' words over all texts. In a file,
the words that are the highest-IDF word of some key phrase are looked up; each
place, minus the posting's position, is a possible alignment of the posting's
template. Alignments are intersected with the phrase's next rarest word at the
same relative position, and the whole mandatory key phrase is verified word by
word. Every occurrence of a key phrase holds its rarest word, so none is missed.
The score of a file is its best alignment's share of the template's IDF weight
that is found in place.

A-Z are lower-cased; words are runs of letters, digits and non-ASCII
characters. Null or empty texts have no words, no places and score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.llm.words import find_words, ranges, slices, word_hashes

# label, template text, mandatory key phrase, base (fixed values)
TEMPLATES = [
    ("mit", "under the mit license", "under the mit license", True),
    ("apache-2", "apache license version 2", "apache license version 2", True),
    ("cc-by-nc", "cc by nc", "cc by nc", True),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files", "permission is hereby granted free of charge", False),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
     " with the license", "you may not use this file except in compliance with the license", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the"
     " following conditions are met", "redistribution and use in source and binary forms", False),
    ("gpl-2", "gnu general public license version 2", "gnu general public license version 2", False),
    ("gpl-3", "gnu general public license version 3", "gnu general public license version 3", False),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license", False),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted", "permission to use copy modify and or distribute this software", False),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software", False),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal", False),
]

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


class Index:
    """Template words with their codes, and their hashes sorted for look-up."""

    def __init__(self, templates: list[tuple[str, str, str, bool]]):
        self.templates = templates
        self.words = sorted({w for _, text, key, _ in templates for w in f"{text} {key}".split()})
        self.code = {w: i for i, w in enumerate(self.words)}
        hashes = word_hashes(find_words(pa.array(self.words), WORD_BYTES))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def codes(self, batch_text: pa.Array):
        """The words of the texts and their codes (-1: no template word)."""
        w = find_words(batch_text, WORD_BYTES, FOLD)
        h = word_hashes(w)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return w, np.where(self.hashes[at] == h, self.order[at], -1)

    def plan(self, idf: np.ndarray) -> "Plan":
        return Plan(self, idf)


class Plan:
    """Templates as padded arrays, and the postings of each key phrase's highest-IDF word."""

    def __init__(self, index: Index, idf: np.ndarray):
        codes = lambda text: [index.code[x] for x in text.split()]
        texts, phrases = ([codes(t[k]) for t in index.templates] for k in (1, 2))
        self.label, self.base = [t[0] for t in index.templates], np.array([t[3] for t in index.templates])
        self.offset = np.array([next(i for i in range(len(x)) if x[i:i + len(p)] == p) for x, p in zip(texts, phrases)])
        self.words, self.phrase = self.padded(texts), self.padded(phrases)
        self.length = np.array([len(p) for p in phrases])
        self.weight = np.where(self.words >= 0, idf[self.words], 0.0)
        rarest = [sorted(range(len(p)), key=lambda i: (-idf[p[i]], i)) for p in phrases]
        self.second = np.array([r[min(1, len(r) - 1)] for r in rarest])
        postings = sorted((p[r[0]], t, r[0]) for t, (p, r) in enumerate(zip(phrases, rarest)))
        self.word, self.template, self.position = (np.array(c) for c in zip(*postings))

    @staticmethod
    def padded(rows: list[list[int]]) -> np.ndarray:
        out = np.full((len(rows), max(map(len, rows))), -2)
        for i, r in enumerate(rows):
            out[i, :len(r)] = r
        return out

    def alignments(self, code: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, first word of its key phrase, row) of every verified place."""
        low, high = (np.searchsorted(self.word, code, side=s) for s in ("left", "right"))
        hit = np.flatnonzero((high > low) & (code >= 0))
        many = (high - low)[hit]
        at, posting = np.repeat(hit, many), ranges(low[hit], many)
        t, start = self.template[posting], at - self.position[posting]
        row = np.searchsorted(rows, at, side="right") - 1
        fits = (start >= rows[row]) & (start + self.length[t] <= rows[row + 1])
        t, start, row = t[fits], start[fits], row[fits]
        fits = code[start + self.second[t]] == self.phrase[t, self.second[t]]
        t, start, row = t[fits], start[fits], row[fits]
        for i in range(self.phrase.shape[1]):
            fits = (i >= self.length[t]) | (code[np.minimum(start + i, len(code) - 1)] == self.phrase[t, i])
            t, start, row = t[fits], start[fits], row[fits]
        return t, start, row

    def scores(self, code: np.ndarray, rows: np.ndarray, t: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Each alignment's share of its template's weight."""
        found = np.zeros(len(t))
        for i in range(self.words.shape[1]):
            at = start - self.offset[t] + i
            inside = (at >= rows[row]) & (at < rows[row + 1])
            same = inside & (code[np.clip(at, 0, len(code) - 1)] == self.words[t, i])
            found += np.where(same, self.weight[t, i], 0.0)
        return np.minimum(1.0, found / self.weight.sum(axis=1)[t])


def _frequencies(index: Index):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w, code = index.codes(batch.column("text"))
            hit = np.flatnonzero(code >= 0)
            pairs = np.unique(np.searchsorted(w.rows, hit, side="right") * len(index.words) + code[hit])
            df = np.bincount(pairs % len(index.words), minlength=len(index.words))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.append(batch.num_rows, df))],
                                             ["code", "n"])
    return count


def _scan(index: Index, plan: Plan):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w, code = index.codes(batch.column("text"))
            n, none = batch.num_rows, np.iinfo(np.int64).max
            t, start, row = plan.alignments(code, w.rows) if len(code) else (np.empty(0, int),) * 3
            score, n_base = np.zeros(n), np.zeros(n, np.int64)
            first, last = np.full(n, none), np.full(n, -1)
            base, labels = [set() for _ in range(n)], [set() for _ in range(n)]
            if len(t):
                np.maximum.at(score, row, plan.scores(code, w.rows, t, start, row))
                own = plan.base[t]
                at = start - w.rows[row]
                np.add.at(n_base, row[own], 1)
                np.minimum.at(first, row[own], at[own])
                np.maximum.at(last, row[own], at[own])
                for r, k in set(zip(row.tolist(), t.tolist())):
                    labels[r].add(plan.label[k])
                    if plan.base[k]:
                        base[r].add(plan.label[k])
            empty = n_base == 0
            join = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(w.counts()), pa.array(n_base), pa.array(first, mask=empty),
                 pa.array(last, mask=empty), join(base), join(labels), pa.array(score)],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None) -> DataFrame:
    """Per row: words, places and labels of the base phrases, all labels, and the best alignment's score."""
    index = Index(templates or TEMPLATES)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.select("text").mapInArrow(_frequencies(index), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    n = {r["code"]: r["n"] for r in counted.collect()}  # one row per template word
    idf = np.array([log(1 + n.get(-1, 0) / (1 + n.get(c, 0))) for c in range(len(index.words))])
    idf = idf if idf.any() else np.ones(len(idf))  # no texts
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan(index, index.plan(idf)), f"id {id_type}, n_words long, n_base long, first_word long,"
                           " last_word long, base_labels string, labels string, score double").withColumnRenamed("id", id_col)
