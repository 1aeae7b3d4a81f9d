"""Whole-batch text primitives on byte arrays: words, hashes and per-document ragged helpers.

A word is ``[^\\x20\\x09-\\x0D]+``; in UTF-8 the separators are single bytes, so all work is done on bytes. Hashes
are 64-bit polynomials over a fixed random byte table, reduced by wrap-around and finished by a mixing step; two
given different words meet with a probability of about 2**-55 at worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; temporaries are some 40 times that.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse
UNBASE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Some documents: ``data`` their bytes one after the other, document i is data[starts[i]:starts[i+1]]."""

    data: np.ndarray
    starts: np.ndarray
    first: int  # row of the batch at which this slice begins

    def __len__(self) -> int:
        return len(self.starts) - 1


def texts(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of whole documents, each of about ``most`` bytes (one longer document stands alone). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each document (one entry more than documents)."""
    n = len(t.data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64)
    inside = ~SPACE[t.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = t.starts[1:-1]
    cuts = cuts[cuts < n]
    begins[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    stops[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, t.starts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(BASE, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(UNBASE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values, as uint64 (len(values) - width + 1 of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(BASE)
        out += values[k : k + n]
    return mix(out)


def shingles(word_hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``width``-word shingle hashes of each document, one after the other, and where each begins.
    Fewer words: the whole sequence is one shingle. No word: none."""
    counts = np.diff(before)
    docs = len(counts)
    runs = rolling(word_hashes, width)
    many = np.maximum(counts - width + 1, 0)
    parts: list[np.ndarray] = []
    for i in range(docs):
        if many[i]:
            part = np.sort(runs[before[i] : before[i] + many[i]])
            if len(part) > 1:
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
        elif counts[i]:
            part = rolling(word_hashes[before[i] : before[i + 1]], int(counts[i])) + np.uint64(counts[i])
        else:
            part = np.zeros(0, np.uint64)
        parts.append(part)
    at = np.zeros(docs + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), at


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start:start+length] of every pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def per_document(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the values of each document; ``before`` as words() returns it."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[before[1:]] - sums[before[:-1]]


def distinct(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings among data[edges[i]:edges[i+1]], and for each its place among them."""
    cells = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = cells.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def repeated_cells(t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings among spans that tile part of ``t.data`` in order, and for each span its place among
    them. Spans must touch: ends[i] == starts[i+1]."""
    return distinct(t.data, np.append(starts, ends[-1:] if len(ends) else [0]))


def chunks(t: Texts, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts every document in front of each run of separators: a chunk is ``separators? word?``, and the chunks of
    a document joined are the document. Returns start, end and the number of chunks before each document."""
    n = len(t.data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64)
    blank = space[t.data]
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    marks = t.starts[:-1]
    begins[marks[marks < n]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, t.starts)


class Remembered:
    """Strings and their ids: ``index`` numbers them, the ids of number i are flat[at[i]:at[i+1]]."""

    def __init__(self, index: dict):
        self.index, self.n = index, 0
        self.flat, self.at, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def add(self, new: list, ids: list[np.ndarray], lengths: np.ndarray) -> None:
        self.index.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        ids = np.concatenate(ids) if ids else self.flat[:0]
        end = int(self.at[self.n])
        if end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:end], np.zeros(2 * (end + len(ids)), np.uint32)])
        if self.n + len(new) >= len(self.at):
            self.at = np.concatenate([self.at[: self.n + 1], np.zeros(2 * (self.n + len(new)), np.int64)])
        self.flat[end : end + len(ids)] = ids
        self.at[self.n + 1 : self.n + 1 + len(new)] = end + np.cumsum(lengths)
        self.n += len(new)

    def used(self, numbers: np.ndarray) -> None:
        """Counts a use of each of the (distinct) numbers, for forget()."""
        if self.n > len(self.uses):
            self.uses = np.concatenate([self.uses, np.zeros(2 * self.n - len(self.uses), np.int32)])
        self.uses[numbers] += 1

    def forget(self) -> None:
        """Drops what was used least, half of all strings at least; the counts of the others are halved."""
        uses = self.uses[: self.n]
        keep = np.sort(np.argsort(-uses, kind="stable")[: self.n // 2])
        keep = keep[uses[keep] > 1]
        words = list(self.index)
        lengths = self.at[keep + 1] - self.at[keep]
        self.flat = gather(self.flat, self.at[keep], lengths)
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.uses = uses[keep] // 2
        self.index = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.n = len(keep)
