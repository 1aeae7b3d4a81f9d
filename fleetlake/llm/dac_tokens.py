"""Token ids in directly addressable codes: files from which any token is read without decoding a block.

An id is cut into chunks of ``CHUNK`` bits, lowest first. Level 0 holds the lowest chunk of every token, level k
the k-th chunk of the tokens that have one. A continuation bitmap per level says which tokens go on, and a rank
directory (ones before every ``STRIDE`` bits) turns a place on one level into a place on the next.

File: 8 bytes ``FLDAC01`` and a zero, then little-endian int64: documents, tokens, levels, bytes of labels; per level
its entries; document starts (documents + 1); per level the chunks (a byte each), the bitmap (bits from the lowest),
the directory; the labels (here the documents' keys as an Arrow stream).
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkernel as K

MAGIC = b"FLDAC01\0"
CHUNK, STRIDE = 8, 512
#: Tokens of one file; a partition is written as several files when it has more.
FILE_TOKENS = 2 << 20
#: Words whose ids a worker remembers.
REMEMBERED = 500_000


def pack(ids: np.ndarray, starts: np.ndarray, labels: bytes = b"") -> bytes:
    """The file of documents ids[starts[i]:starts[i+1]]."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(CHUNK)
        on = more > 0
        ones = np.zeros(len(rest) // STRIDE + 1, np.int64)
        sums = np.add.reduceat(on, np.arange(0, len(on), STRIDE), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        ones[1:] = np.cumsum(sums)[: len(ones) - 1]
        levels.append(((rest & np.uint32(255)).astype(np.uint8), np.packbits(on, bitorder="little"), ones))
        if not on.any():
            break
        rest = more[on]
    head = np.array([len(starts) - 1, len(ids), len(levels), len(labels), *(len(x[0]) for x in levels)], np.int64)
    body = [b for chunk, bits, ones in levels for b in (chunk.tobytes(), bits.tobytes(), ones.tobytes())]
    return b"".join([MAGIC, head.tobytes(), starts.astype(np.int64).tobytes(), *body, labels])


class Reader:
    """Access to a packed file held as bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        documents, self.tokens, n, label_bytes = np.frombuffer(data, np.int64, 4, 8).tolist()
        sizes = np.frombuffer(data, np.int64, n, 40)
        at = 40 + 8 * int(n)
        self.labels = data[len(data) - label_bytes :]
        self.starts = np.frombuffer(data, np.int64, int(documents) + 1, at)
        at += 8 * (int(documents) + 1)
        self.levels = []
        for size in sizes.tolist():
            chunk = np.frombuffer(data, np.uint8, size, at)
            at += size
            bits = np.frombuffer(data, np.uint8, -(-size // 8), at)
            at += len(bits)
            ones = np.frombuffer(data, np.int64, size // STRIDE + 1, at)
            at += 8 * len(ones)
            self.levels.append((chunk, bits, ones))

    def _rank(self, level: int, place: int) -> int:
        """Ones of the level's bitmap before a place."""
        _, bits, ones = self.levels[level]
        block = place // STRIDE
        within = np.unpackbits(bits[block * STRIDE // 8 : -(-place // 8)], bitorder="little")[: place - block * STRIDE]
        return int(ones[block]) + int(within.sum())

    def token(self, i: int) -> int:
        """The i-th token of the file."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def span(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end (exclusive)."""
        out = np.zeros(max(0, end - start), np.uint32)
        where, lo, hi = np.arange(len(out)), start, end
        for k, (chunk, bits, _) in enumerate(self.levels):
            if hi <= lo:
                break
            out[where] |= chunk[lo:hi].astype(np.uint32) << np.uint32(CHUNK * k)
            on = np.unpackbits(bits[lo >> 3 : -(-hi // 8)], bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)
            lo = self._rank(k, lo)
            where = where[on]
            hi = lo + len(where)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.starts[i + 1]))


@functools.lru_cache(2)
def _tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


#: What the tokenizer's own splitting goes by, for each byte of lower-cased Latin-1 text in UTF-8 (ASCII by itself, the
#: rest by its second byte): separators, letters, numbers (each a word of its own) and all else.
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds(code_points: range) -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    return np.array([kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in code_points], np.uint8)


_ASCII = np.full(256, _OTHER, np.uint8)
_ASCII[:128] = _kinds(range(128))
_ASCII[K.SPACE] = _BLANK
#: By second byte, of those that begin with C2 and with C3.
_SECOND = {0xC2: np.concatenate([np.zeros(128, np.uint8), _kinds(range(0x80, 0xC0)), np.zeros(64, np.uint8)]), 0xC3: np.concatenate([np.zeros(128, np.uint8), _kinds(range(0xC0, 0x100)), np.zeros(64, np.uint8)])}
#: Endings that the tokenizer takes off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def split_words(t: K.Texts, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts as the tokenizer does: bytes without separators, lower-cased; starts of the words in them (and the end);
    words before each document; and whether a word is a whole chunk between separators, in its own bytes, that only
    the library can split: those with code points above U+00FF, other white space or special tokens."""
    raw, n = t.data, len(t.data)
    kind, low = _ASCII[raw], K.LOWER[raw]
    odd = (raw >= 0xC4) | ((raw >= 0x1C) & (raw <= 0x1F))
    for lead, second in _SECOND.items():
        at = np.flatnonzero(raw == lead)
        behind = raw[at + 1]
        kind[at] = kind[at + 1] = second[behind]
        if lead == 0xC2:
            odd[at[(behind == 0x85) | (behind == 0xA0)]] = True
        else:
            up = (behind <= 0x9E) & (behind != 0x97)
            low[at[up] + 1] += 0x20
    begins = np.ones(n, bool)
    begins[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == _NUMBER) & ((raw[1:] & 0xC0) != 0x80))
    heads = t.starts[:-1][t.starts[:-1] < n]
    begins[heads] = True
    quotes = np.flatnonzero(raw == 0x27)
    quotes = quotes[begins[quotes]]
    if len(quotes):  # an ending stays with its apostrophe, and letters behind it begin a word
        end = t.starts[np.searchsorted(t.starts, quotes, "right")]
        for ending in ENDINGS:
            hit = quotes + len(ending) < end
            for k, letter in enumerate(ending.encode(), 1):
                hit[hit] = low[quotes[hit] + k] == letter
            at, behind = quotes[hit], quotes[hit] + len(ending) + 1
            begins[at + 1] = False
            begins[behind[behind < end[hit]]] = True
    starts, ends, _ = K.words(t)
    whole = bytes(raw) if special else b""
    for mark in special:
        k = whole.find(mark)
        while k >= 0:
            odd[k] = True
            k = whole.find(mark, k + 1)
    chunk = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
    inside = kind != _BLANK
    if len(chunk):
        a, b = starts[chunk], ends[chunk]
        within = K.gather(np.arange(n), a, b - a)
        begins[within] = False
        begins[a] = True
        low[within] = raw[within]
        inside[within] = True
    places = np.flatnonzero(begins & inside)
    strange = np.zeros(len(places), bool)
    strange[np.searchsorted(places, starts[chunk])] = True
    kept = low[inside]
    return kept, np.append(np.flatnonzero(begins[inside]), len(kept)), np.searchsorted(places, t.starts), strange


class Encoder:
    """Ids of texts under a tokenizer that lower-cases, drops white space and never joins words across it.

    Texts are cut into words here, and the library's model encodes the distinct ones, thousands in one call; chunks
    that split_words() leaves alone go through the whole tokenizer. Words are remembered up to a bound, the ones that
    came again longest.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = _tokenizer(file)
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [x.content.encode() for x in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # of the tokens that end a word
        self.last[[k for token, k in vocabulary.items() if token.endswith(self.whole.model.end_of_word_suffix)]] = True
        self.known = K.Remembered({})

    def learn(self, words: list[bytes], strange: set[bytes]) -> None:
        plain = [w for w in words if w not in strange] if strange else words
        joined = [b"\n".join(plain[k : k + 5000]).decode() for k in range(0, len(plain), 5000)]
        found = [np.array(x.ids, np.uint32) for x in self.words.encode_batch_fast(joined, add_special_tokens=False)]
        if plain:
            ids = np.concatenate(found)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("the tokenizer doesn't end every word with a token of its own")
            self.known.add(plain, [ids], np.diff(ends, prepend=0))
        if strange:
            rest = [w for w in words if w in strange]
            out = [np.array(x.ids, np.uint32) for x in self.whole.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)]
            self.known.add(rest, out, np.fromiter(map(len, out), np.int64, len(out)))

    def encode(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of the slice, and the number of ids of each."""
        data, edges, before, strange = split_words(t, self.special)
        if len(edges) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(t), np.int64)
        cells, places = K.distinct(data, edges)
        known = self.known
        if known.n > REMEMBERED:
            known.forget()
        words = cells.to_numpy(zero_copy_only=False).tolist()
        index = np.fromiter(map(known.index.get, words, repeat(-1)), np.int64, len(words))
        if len(fresh := np.flatnonzero(index < 0)):
            new = [words[k] for k in fresh.tolist()]
            odd = {words[k] for k in np.unique(places[strange]).tolist()} if strange.any() else set()
            self.learn(new, odd & set(new) if odd else odd)
            index[fresh] = np.fromiter(map(known.index.__getitem__, new), np.int64, len(new))
        known.used(index)
        index = index[places]
        begin, size = known.at[index], known.at[index + 1] - known.at[index]
        return K.gather(known.flat, begin, size), K.per_document(size, before)


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def _labels(keys: list[pa.Array]) -> bytes:
    table = pa.table({"key": pa.chunked_array(keys)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def write(docs: DataFrame, file: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the token ids of ``docs`` (each text whole, ``end_id`` behind it) in ascending key order to files in
    ``folder`` (default: a new one in the shared folder) and returns the list of files: path, documents, tokens and
    before (tokens of all files before it).

    Documents are range-partitioned by key, null keys first, rows of one key ordered by text; null texts are empty.
    A file is closed once it holds FILE_TOKENS. A task that runs again writes the same files. Columns other than key
    and text aren't kept. An empty table gives no file.
    """
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    shared.ship(spark)
    folder = folder or shared.fresh_path(spark, "tokens")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(parts, F.col("key").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("key").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file)
        ids, counts, keys, part, piece, held = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            path = f"{folder}/part-{part:06d}-{piece:04d}.dac"
            shared.put_file(path, pack(np.concatenate(ids), starts, _labels(keys)))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([path]), pa.array([len(starts) - 1]), pa.array([int(starts[-1])])], names=["part", "piece", "path", "documents", "tokens"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for t in K.texts(batch.column("text"), shared.BATCH_BYTES):
                flat, n = encode.encode(t)
                with_end = np.full(len(flat) + len(n), end_id, np.uint32)
                inside = np.ones(len(with_end), bool)
                inside[np.cumsum(n + 1) - 1] = False
                with_end[inside] = flat
                ids.append(with_end)
                counts.append(n + 1)
                keys.append(batch.column("key").slice(t.first, len(t)))
                held += len(with_end)
                if held >= FILE_TOKENS:
                    yield flush()
                    ids, counts, keys, piece, held = [], [], [], piece + 1, 0
        if ids:
            yield flush()

    found = shared.arrow_map(ordered, run, "part int, piece int, path string, documents long, tokens long").collect()  # a row per file
    rows, before = [], 0
    for _, _, path, documents, tokens in sorted(found):
        rows.append((path, documents, tokens, before))
        before += tokens
    # as a written table its size is known, so that the join in read() sends it to all while it is small
    return shared.written(spark, spark.createDataFrame(rows, "path string, documents long, tokens long, before long").coalesce(1), "token-files")


def _opened(spark: SparkSession, files: DataFrame) -> DataFrame | None:
    """Contents of the files, each with the number of tokens before it. Files are read in whatever store they are."""
    shared.bounded_batches(spark)
    shared.ship(spark)
    content = shared.listed_content(spark, files.select("path", "before"), "*.dac")
    return None if content is None else content.select("content", "before")


def _readers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Reader, pa.Array, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            reader = Reader(batch.column("content")[i].as_buffer().to_pybytes())
            keys = pa.ipc.open_stream(reader.labels).read_all().column("key").combine_chunks()
            yield reader, keys, batch.column("before")[i].as_py()


def read(spark: SparkSession, files: DataFrame, key_type: str = "long") -> DataFrame:
    """Documents of the files that write() listed, from the files: key, start (ids of all documents before it),
    n_tokens and ids. No files: an empty table."""
    schema = f"key {key_type}, start long, n_tokens long, ids array<long>"
    content = _opened(spark, files)
    if content is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reader, keys, before in _readers(batches):
            for lo in range(0, len(keys), 200):
                starts = reader.starts[lo : min(lo + 200, len(keys)) + 1]
                ids = reader.span(int(starts[0]), int(starts[-1])).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, len(starts) - 1), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), lists], names=["key", "start", "n_tokens", "ids"])

    return shared.arrow_map(content, run, schema)


def read_checksums(spark: SparkSession, files: DataFrame, key_type: str = "long") -> DataFrame:
    """Like read(), with the CRC-32 of each document's ids (as little-endian unsigned 32-bit integers) in place of the
    ids, which then needn't leave the workers: key, start, n_tokens, ids_crc32."""
    schema = f"key {key_type}, start long, n_tokens long, ids_crc32 long"
    content = _opened(spark, files)
    if content is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reader, keys, before in _readers(batches):
            whole = reader.span(0, reader.tokens).astype("<u4").tobytes()
            edges = (reader.starts * 4).tolist()
            crc = [zlib.crc32(whole[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([keys, pa.array(reader.starts[:-1] + before), pa.array(np.diff(reader.starts)), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return shared.arrow_map(content, run, schema)
