"""Byte-level BPE encoding and decoding by a traversal of the words' trie.

The encoding of a string ends in one token only, and what stands before that token is the encoding of the shorter
string. So each prefix needs a single state, its last token; a depth-first walk over the distinct words in sorted
order, which is the walk over their trie, keeps the states of the current path and computes those of a shared prefix
once. A token may follow another if the two, merged from bytes, come out as themselves.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import shared
from . import textkernel as K

# Fixed value: the splitting pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII's, in UTF-8: texts that hold it are split whole instead of by chunk.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
#: Chunks and words whose ids a worker remembers, and pairs of tokens whose standing it does.
REMEMBERED, PAIRS = 150_000, 500_000


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in such vocabularies: printable ones for themselves, then from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        model = told["model"]
        self.ids = {plain(s): i for s, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.texts = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (plain(s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.starts = {b[:k]: -1 for b in self.ids for k in range(1, len(b))} | self.ids  # what a token may begin with
        self.single = [self.ids[bytes((b,))] for b in range(256)]
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.odd = re.compile(b"|".join([re.escape(s.encode()) for s in self.special] + [_WIDE_SPACE.pattern]))
        top = max(self.texts) + 1
        sizes = np.zeros(top, np.int64)
        for i, b in self.texts.items():
            sizes[i] = len(b)
        self.sizes, self.offsets = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.texts.get(i, b"") for i in range(top)), np.uint8)
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.words = K.Remembered({})
        self.chunks = K.Remembered({})

    def merged(self, data: bytes) -> list[int]:
        """Tokens by merging from bytes, lowest rank first: what the walk's rules are judged by."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min((self.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges) if any(p in self.merges for p in zip(ids, ids[1:])) else None
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b may stand behind token a (a < 0: at the start of a word)."""
        key = (a + 1) << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.merged(self.texts[b]) == [b] if a < 0 else self.merged(self.texts[a] + self.texts[b]) == [a, b]
            self.pairs[key] = known
        return known

    def walk(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Tokens of the sorted words one after the other, and the number of each word's tokens."""
        find, known = self.starts.get, self.pairs
        deepest = max(map(len, words), default=0) + 1
        # per depth of the path: last token, where it begins, and the first place from which a token may run on
        last, begin, reach = [-1] * deepest, [0] * deepest, [0] * deepest
        flat, counts, before = [], [], b""
        for word in words:
            n, depth = len(word), 0
            top = min(n, len(before))
            if word[:top] == before[:top]:
                depth = top
            else:
                while word[depth] == before[depth]:
                    depth += 1
            for i in range(depth + 1, n + 1):
                j = reach[i - 1]
                token = find(word[j:i])
                while token is None:  # no token begins like this: none that ends later can start here
                    j += 1
                    token = find(word[j:i])
                reach[i] = j
                while True:
                    if token is not None and token >= 0:
                        ok = known.get((last[j] + 1) << 20 | token)
                        if ok or ok is None and self.may_follow(last[j], token):
                            last[i], begin[i] = token, j
                            break
                    j += 1
                    token = find(word[j:i])
            tokens, i = [], n
            while i:
                tokens.append(last[i])
                i = begin[i]
            flat.extend(reversed(tokens))
            counts.append(len(tokens))
            before = word
        return flat, counts

    def learn(self, words: list[str]) -> None:
        """Walks words that aren't known yet."""
        fresh = sorted((w.encode(), w) for w in words if w not in self.words.index)
        if fresh:
            flat, counts = self.walk([b for b, _ in fresh])
            self.words.add([w for _, w in fresh], [np.array(flat, np.uint32)], np.array(counts, np.int64))

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words one after the other, and the number of ids of each."""
        index = np.fromiter(map(self.words.index.__getitem__, words), np.int64, len(words))
        lengths = self.words.at[index + 1] - self.words.at[index]
        return K.gather(self.words.flat, self.words.at[index], lengths), lengths

    def learn_chunks(self, chunks: list[bytes]) -> None:
        found = list(map(self.pattern.findall, [c.decode() for c in chunks]))
        words = list(chain.from_iterable(found))
        self.learn(list(dict.fromkeys(words)))
        flat, lengths = self._ids_of(words)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        self.chunks.add(chunks, [flat], K.per_document(lengths, edges))

    def encode_whole(self, text: str) -> np.ndarray:
        """Ids of a text with special tokens or wide spaces in it."""
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32))
            elif part:
                words = self.pattern.findall(part)
                self.learn(list(dict.fromkeys(words)))
                out.append(self._ids_of(words)[0])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of the slice, and the number of ids of each."""
        if len(self.words.index) > REMEMBERED:
            self.clear()
        elif len(self.chunks.index) > REMEMBERED:
            self.chunks = K.Remembered({})
        starts, ends, before = K.chunks(t)
        cells, places = K.repeated_cells(t, starts, ends)
        cells, known = cells.to_pylist(), self.chunks
        if fresh := [c for c in cells if c not in known.index]:
            self.learn_chunks(fresh)
        index = np.fromiter(map(known.index.__getitem__, cells), np.int64, len(cells))[places] if cells else np.zeros(0, np.int64)
        begin, size = known.at[index], known.at[index + 1] - known.at[index]
        ids, counts = K.gather(known.flat, begin, size), K.per_document(size, before)
        if self.odd.search(whole := bytes(t.data)):
            edges = np.concatenate([[0], np.cumsum(counts)])
            parts = [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]
            for i in range(len(t)):
                if self.odd.search(part := whole[t.starts[i] : t.starts[i + 1]]):
                    parts[i] = self.encode_whole(part.decode())
                    counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all documents one after the other, and where each begins (one entry more than documents)."""
        sizes = self.sizes[ids]
        edges = np.concatenate([[0], np.cumsum(counts)])
        return K.gather(self.bytes, self.offsets[ids], sizes).tobytes(), np.concatenate([[0], np.cumsum(K.per_document(sizes, edges))])


@functools.lru_cache(2)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


def text_of(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def encoded(docs: DataFrame, file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text (null: none) as an array of ints; a column of that name is
    replaced. Special tokens inside texts are found; nothing is added, cut or padded."""

    def make(batch: pa.RecordBatch) -> list:
        v, parts, edges = vocabulary(file), [], [np.zeros(1, np.int64)]
        for t in K.texts(batch.column(text)):
            flat, counts = v.encode(t)
            parts.append(flat)
            edges.append(edges[-1][-1] + np.cumsum(counts))
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(edges).astype(np.int32)), pa.array(np.concatenate(parts).astype(np.int32)))]

    return shared.mapped(docs, {ids: "array<int>"}, make)


def decoded(docs: DataFrame, file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the token ids (null: empty); bytes that aren't UTF-8 become U+FFFD."""

    def make(batch: pa.RecordBatch) -> list:
        v, out = vocabulary(file), []
        for row in batch.column(ids):
            own = np.array(row.values.to_numpy(zero_copy_only=False) if row.is_valid else [], np.int64)
            out.append(text_of(v.decode(own, np.array([len(own)]))[0]))
        return [pa.array(out, pa.string())]

    return shared.mapped(docs, {text: "string"}, make)


def round_trips(docs: DataFrame, file: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256
    (of the text decoded from the ids), so that neither ids nor texts need leave the workers; ``ids`` names a column
    for the ids themselves. Null and empty texts have no ids; columns with the results' names are replaced."""

    def make(batch: pa.RecordBatch) -> list:
        v, n, a, b, flat = vocabulary(file), [], [], [], []
        for t in K.texts(batch.column(text)):
            found, counts = v.encode(t)
            flat.append(found)
            packed, edges = found.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts)]) * 4
            back, cuts = v.decode(found, counts)
            n.append(counts)
            a += [hashlib.sha256(packed[x:y]).hexdigest() for x, y in zip(edges.tolist(), edges[1:].tolist())]
            b += [hashlib.sha256(text_of(back[x:y]).encode()).hexdigest() for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
        out = [pa.array(np.concatenate(n)), pa.array(a), pa.array(b)]
        if ids:
            ends = np.concatenate([[0], np.cumsum(np.concatenate(n))]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).astype(np.int32))))
        return out

    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return shared.mapped(docs, fields | ({ids: "array<int>"} if ids else {}), make)
