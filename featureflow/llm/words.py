"""Byte-level word finding and hashing on Arrow string arrays (numpy, no per-word Python).

Words are maximal runs of "word bytes". Both word classes used here exclude
only ASCII characters, so working on UTF-8 bytes gives the same words as
working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240601)
BYTE_CODE = _RNG.integers(1, 2**63, 256).astype(U64) * U64(2) + U64(1)
GRAM_BASE = U64(0x9E3779B97F4A7C15)
POS_BASE = U64(0xD6E8FEB86659FD93)

#: every byte but space and \t \n \v \f \r
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False


class Words:
    """Words of a string array: byte ranges in `buf`, and `rows[i]:rows[i+1]` = words of row i."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray):
        self.buf, self.starts, self.ends, self.rows = buf, starts, ends, rows

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string/binary array without nulls; offsets start at 0."""
    if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type):
        dtype = np.int64
    else:
        dtype = np.int32
    _, off, data = text.buffers()
    n = len(text)
    if n == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, dtype)[text.offset:text.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def find_words(text: pa.Array, word_bytes: np.ndarray = NON_SPACE, fold: np.ndarray | None = None) -> Words:
    """Words of each row; nulls count as empty. `fold` maps bytes first (e.g. A-Z to a-z)."""
    buf, offs = raw(text.fill_null("") if text.null_count else text)
    if fold is not None:
        buf = fold[buf]
    if not len(buf):
        e = np.empty(0, np.int64)
        return Words(buf, e, e, np.zeros(len(offs), np.int64))
    m = word_bytes[buf]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offs))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a fresh array)."""
    h = h ^ (h >> U64(31))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every batch."""
    if not len(w.starts):
        return np.empty(0, U64)
    lens = w.ends - w.starts
    at = ranges(w.starts, lens)
    first = np.cumsum(lens) - lens
    powers = np.cumprod(np.full(int(lens.max()), POS_BASE, U64))
    codes = BYTE_CODE[w.buf[at]]
    codes *= powers[at - np.repeat(w.starts, lens)]
    return mix(np.add.reduceat(codes, first))


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated aranges start..start+len."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = starts - (np.cumsum(lens) - lens)
    small = total < 2**31 and int(starts[-1] + lens[-1]) < 2**31 and int(shift.max()) < 2**31
    kind = np.int32 if small else np.int64
    out = np.repeat(shift.astype(kind), lens)
    out += np.arange(total, dtype=kind)
    return out


def cut(w_buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array of the byte ranges."""
    lens = (ends - starts).astype(np.int64)
    data = w_buf[ranges(starts.astype(np.int64), lens)]
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens),
                                            [None, pa.py_buffer(offs), pa.py_buffer(data)])


def grams(hashes: np.ndarray, k: int, salt: int = 0, base: np.uint64 = GRAM_BASE) -> np.ndarray:
    """Hash of each k consecutive words (crossing rows; callers mask), length n - k + 1. Hashes with another
    base are independent; the salt alone only renames them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.full(n, U64(salt), U64)
    for j in range(k):
        h *= base
        h += hashes[j:j + n]
    return mix(h)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into row ranges of at most about max_bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        _, offs = raw(text.fill_null(b"" if pa.types.is_binary(text.type) else "") if text.null_count else text)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
