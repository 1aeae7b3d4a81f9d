"""Token counts under a sentence-piece BPE model by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens between which no piece of the vocabulary can reach; distinct pre-tokens are laid out
as one ragged array of symbols, and in every round each sequence merges its lowest-ranked adjacent pair, all
sequences at once. What is left per sequence is its count.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from . import textkernel as K

MARK = "▁"  # stands for a space
#: Pre-tokens whose counts a worker remembers; the table is emptied when full.
REMEMBERED = 600_000


class Model:
    """Vocabulary of a BPE model with byte fallback: characters, pair ranks and which characters may touch."""

    def __init__(self, file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in ids}
        order = sorted(ids, key=lambda i: (-sp.get_score(i), i))
        score = {i: sp.get_score(i) for i in ids}
        ranks, last = {}, None
        rank = -1
        for i in order:  # equal scores share a rank
            if score[i] != last:
                rank, last = rank + 1, score[i]
            ranks[i] = rank
        self.pieces = pieces
        self.none = sp.get_piece_size()  # symbol of a character outside the vocabulary
        size = self.none + 1
        pairs = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                a, b = pieces.get(piece[:k]), pieces.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = (ranks[i], i)
        keys = np.array(sorted(pairs), np.int64)
        self.size = size
        self.worst = np.int32(2**31 - 1)
        # open addressing, so that a look-up is a few gathers
        self.slots = 1 << (int(len(keys) * 4).bit_length())
        self.table = np.full(self.slots, -1, np.int64)
        self.rank = np.full(self.slots, self.worst, np.int32)
        self.result = np.zeros(self.slots, np.int32)
        self.reach = 1
        for key in keys.tolist():
            at = self._slot(np.array([key]))[0]
            step = 1
            while self.table[at] >= 0:
                at, step = (at + 1) % self.slots, step + 1
            self.reach = max(self.reach, step)
            self.table[at] = key
            self.rank[at], self.result[at] = pairs[key]
        touching = {piece[k : k + 2] for piece in pieces for k in range(len(piece) - 1)}
        self.char_id = np.full(0x110000, self.none, np.int32)
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
        self.touching = np.sort(np.array([(ord(x[0]) << 21) | ord(x[1]) for x in touching], np.int64))
        self.small = np.zeros((256, 256), bool)
        for x in touching:
            if ord(x[0]) < 256 and ord(x[1]) < 256:
                self.small[ord(x[0]), ord(x[1])] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (self.slots.bit_length() - 1))).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the worst if it merges to nothing) and its slot."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slot(keys)
        found = self.table[at]
        for _ in range(self.reach - 1):
            off = np.flatnonzero((found != keys) & (found >= 0))
            if not len(off):
                break
            at[off] = (at[off] + 1) % self.slots
            found[off] = self.table[at[off]]
        return np.where(found == keys, self.rank[at], self.worst), at

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Whether a pre-token ends behind each code point but the last."""
        a, b = points[:-1], points[1:]
        near = (a < 256) & (b < 256)
        out = np.empty(len(a), bool)
        out[near] = ~self.small[a[near], b[near]]
        rest = np.flatnonzero(~near)
        pairs = (a[rest].astype(np.int64) << 21) | b[rest]
        at = np.searchsorted(self.touching, pairs)
        at[at == len(self.touching)] = 0
        out[rest] = self.touching[at] != pairs
        return out

    def count(self, strings: list[str]) -> np.ndarray:
        """Tokens of each string, taken as it is (spaces already marks)."""
        joined = "".join(strings)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        if not len(points):
            return np.zeros(len(strings), np.int64)
        owner = np.repeat(np.arange(len(strings)), lengths)
        symbols = self.char_id[points]
        unknown = symbols == self.none
        counts = np.bincount(owner[unknown], (1 + (points[unknown] >= 0x80) + (points[unknown] >= 0x800) + (points[unknown] >= 0x10000)), len(strings)).astype(np.int64)
        new = np.ones(len(points), bool)
        new[1:] = (owner[1:] != owner[:-1]) | self.cuts(points)
        return counts + np.bincount(owner, self._left(symbols, new, unknown), len(strings)).astype(np.int64)

    def _left(self, symbols: np.ndarray, new: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """1 at each place at which a symbol is left after merging (characters outside the vocabulary: 0)."""
        out = np.zeros(len(symbols), np.int64)
        place = np.arange(len(symbols))
        sequence = np.cumsum(new) - 1
        symbols, sequence = symbols.copy(), sequence
        ranks, slots = self._pairs(symbols, sequence)
        while len(symbols):
            begins = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
            best = np.minimum.reduceat(ranks, begins)
            lengths = np.diff(np.append(begins, len(symbols)))
            live = best < self.worst
            if not live.all():  # finished sequences leave
                stay = np.repeat(live, lengths)
                out[place[~stay]] = 1
                symbols, sequence, place, ranks, slots = symbols[stay], sequence[stay], place[stay], ranks[stay], slots[stay]
                best, lengths = best[live], lengths[live]
                if not len(symbols):
                    break
            chosen = ranks == np.repeat(best, lengths)
            twins = chosen[1:] & chosen[:-1]
            if twins.any():  # of overlapping equal pairs the leftmost merges, then every second
                at = np.flatnonzero(chosen)
                starts = np.concatenate([[True], np.diff(at) != 1])
                first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                chosen[at[(np.arange(len(at)) - first) % 2 == 1]] = False
            at = np.flatnonzero(chosen)
            symbols[at] = self.result[slots[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, sequence, place, ranks, slots = symbols[stay], sequence[stay], place[stay], ranks[stay], slots[stay]
            at = at - np.arange(len(at))
            near = np.zeros(len(symbols), bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            touched = np.flatnonzero(near)
            ranks[touched], slots[touched] = self._pairs_at(symbols, sequence, touched)
        out[unknown] = 0
        return out

    def _pairs(self, symbols: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pairs_at(symbols, sequence, np.arange(len(symbols)))

    def _pairs_at(self, symbols: np.ndarray, sequence: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ranks, slots = np.full(len(at), self.worst, np.int32), np.zeros(len(at), np.int64)
        inner = at < len(symbols) - 1
        inner[inner] = sequence[at[inner]] == sequence[at[inner] + 1]
        ranks[inner], slots[inner] = self.look_up(symbols[at[inner]], symbols[at[inner] + 1])
        return ranks, slots


@functools.lru_cache(2)
def model(file: str) -> Model:
    return Model(file)


_known: dict[str, dict[bytes, int]] = {}
_blank = np.zeros(256, bool)
_blank[0x20] = True


def count_tokens(column: pa.Array, file: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of every text of the column; null is empty."""
    m = model(file)
    known = _known.setdefault(file, {})
    n_bytes, n_tokens = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for t in K.texts(column, shared.BATCH_BYTES):
        starts, ends, before = K.chunks(t, _blank)
        cells, places = K.repeated_cells(t, starts, ends)
        cells = cells.to_pylist()
        if len(known) > REMEMBERED:
            known.clear()
        fresh = [c for c in cells if c not in known]
        known.update(zip(fresh, m.count([c.decode().replace(" ", MARK) for c in fresh]).tolist(), strict=True))
        counts = np.fromiter(map(known.__getitem__, cells), np.int64, len(cells))[places] if cells else np.zeros(0, np.int64)
        # the library puts a mark in front of a text, which only the first chunk of a document meets
        filled = np.flatnonzero(before[1:] > before[:-1])
        at = before[filled]
        counts[at] = m.count([MARK + cells[places[i]].decode().replace(" ", MARK) for i in at.tolist()])
        n_bytes[t.first : t.first + len(t)] = np.diff(t.starts)
        n_tokens[t.first : t.first + len(t)] = K.per_document(counts, before)
        if (whole := bytes(t.data)).find(MARK.encode()) >= 0:  # a mark in the text itself joins with spaces beside it
            for i in range(len(t)):
                if MARK in (part := whole[t.starts[i] : t.starts[i + 1]].decode()):
                    n_tokens[t.first + i] = m.count([MARK + part.replace(" ", MARK)])[0]
    return n_bytes, n_tokens


def with_token_counts(docs: DataFrame, file: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit. Null and empty texts have 0 bytes and 0 tokens; texts of any
    length are counted whole; rows that repeat are counted each; columns with the results' names are replaced.
    ``file`` is the model's path, the same on every machine."""

    def make(batch: pa.RecordBatch) -> list:
        n_bytes, n_tokens = count_tokens(batch.column(text), file)
        return [pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)]

    return shared.mapped(docs, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, make)
