"""Passages that stand in more than one place, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``depth`` symbols (bytes or words), by passes over wide digits, most significant
first; a suffix that is alone after a pass leaves, and groups that are equal through the whole depth are exactly the
repeated windows. Three things keep this small:

* the first pass sorts one suffix in about a hundred: of every window of ``depth`` symbols the digit (a run of
  ``digit`` symbols) with the least hash, its anchor. Equal windows have equal anchors at equal places;
* the windows of an anchor are one row, from ``first`` to ``last`` start. The second pass sorts rows by all symbols
  that their windows cover. Rows that are equal there are repeated as a whole;
* only what shares an anchor and differs around it goes through the last pass, window by window.

Symbols are compared by 64-bit hashes of their runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from . import textkernel as K

#: Rows of one anchor that one task sorts, some 2 MB of bodies; anchors with more are sorted by a shuffle of their windows.
ANCHOR_ROWS = 4_000
#: Symbols that a task sorts at once (whole anchors, at most ANCHOR_ROWS rows more).
SORTED_BYTES = 4 << 20


def _codes(t: K.Texts, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit code of every symbol, symbols before each document, and each symbol's first byte and end.

    A word's bytes run to the next word of its document, so that words removed leave no separators behind."""
    if unit == "byte":
        return K.BYTE_CODES[t.data], t.starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, before = K.words(t)
    stops = np.empty_like(starts)
    stops[:-1] = starts[1:]
    filled = before[1:] > before[:-1]
    stops[before[1:][filled] - 1] = t.starts[1:][filled]
    return K.span_hashes(t.data, starts, ends), before, starts, stops


def _sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * K.powers(K.BASE, len(codes)), out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = (sums[ends] - sums[starts]) * K.powers(K.UNBASE, len(sums))[starts]
    return K.mix(raw + (ends - starts).astype(np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values."""
    n = len(x)
    if n < width:
        return x[:0]
    grid = np.concatenate([x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(codes: np.ndarray, before: np.ndarray, depth: int, digit: int) -> dict[str, np.ndarray]:
    """The anchors of all windows: document, hash of the digit, hash of all that the windows cover, first and last
    window start, ``one`` (last start of the first window set) and how many equal sets in a row the entry stands
    for (more than one where one symbol repeats). Places count from the document's start."""
    n, width = len(codes), depth - digit + 1
    if n < depth:
        return {k: np.zeros(0, np.int64) for k in ("doc", "digit", "around", "first", "one", "last", "times")}
    sums = _sums(codes)
    at = np.arange(n - digit + 1)
    digits = _hashes(sums, at, at + digit)
    least = _least((digits & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64), width)  # of equal ones the leftmost
    lengths = np.diff(before)
    windows = np.maximum(lengths - depth + 1, 0)
    s = K.gather(np.arange(n), before[:-1], windows)
    doc = np.repeat(np.arange(len(lengths)), windows)
    if not len(s):
        return {k: np.zeros(0, np.int64) for k in ("doc", "digit", "around", "first", "one", "last", "times")}
    p = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])]))
    ends = np.append(begins[1:], len(s)) - 1
    first, last, doc, p = s[begins], s[ends], doc[begins], p[begins]
    around = K.mix(_hashes(sums, first, last + depth) + (p - first).astype(np.uint64))
    same = np.zeros(len(first), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (around[1:] == around[:-1]) & (digits[p[1:]] == digits[p[:-1]]) & (first[1:] == last[:-1] + 1)
    head = np.flatnonzero(~same)
    tail = np.append(head[1:], len(first)) - 1
    base = before[doc[head]]
    return {"doc": doc[head], "digit": digits[p[head]].astype(np.int64), "around": around[head].astype(np.int64), "first": first[head] - base, "one": last[head] - base, "last": last[tail] - base, "times": tail - head + 1}


def _repeated_windows(bodies: list[np.ndarray], depth: int, group: np.ndarray) -> list[np.ndarray]:
    """For each body the window starts that occur in another body of its group (the last pass of the sort)."""
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    flat = np.concatenate(bodies)
    sums = _sums(K.BYTE_CODES[flat] if flat.dtype == np.uint8 else flat)
    before = np.cumsum(lengths) - lengths
    windows = lengths - depth + 1
    s = K.gather(np.arange(len(flat)), before, windows)
    owner = np.repeat(np.arange(len(bodies)), windows)
    hashes = K.mix(_hashes(sums, s, s + depth) + group[owner].astype(np.uint64))
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order[1:]] == hashes[order[:-1]]
    hit = np.zeros(len(s), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    edges = np.cumsum(windows)
    return [np.flatnonzero(hit[a:b]) for a, b in zip(edges - windows, edges)]


def _runs(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if len(places):
        cut = np.flatnonzero(np.diff(places) != 1)
        yield from zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.append(cut, len(places) - 1)].tolist())


ROW = ["digit", "around", "first", "one", "last", "times"]


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("print"), body.alias("text"))


def _anchor_rows(ids: DataFrame, depth: int, digit: int, unit: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.texts(batch.column("text"), K.SLICE_BYTES // 2):
                codes, before, _, _ = _codes(t, unit)
                found = anchors(codes, before, depth, digit)
                if len(found["doc"]):
                    at = pa.array(found["doc"] + t.first)
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("print").take(at), *(pa.array(found[c].astype(np.int64)) for c in ROW[:2]), *(pa.array(found[c].astype(np.int32)) for c in ROW[2:])], ["key", "print", *ROW])

    schema = T.StructType([T.StructField("key", ids.schema["key"].dataType), T.StructField("print", T.LongType())] + [T.StructField(c, T.LongType() if c in ROW[:2] else T.IntegerType()) for c in ROW])
    return shared.arrow_map(ids, run, schema)


def _bodies(ids: DataFrame, asked: DataFrame, depth: int, unit: str) -> DataFrame:
    """digit, key, print, first, needed, body: the symbols that the asked rows' windows cover, cut from their texts."""
    lists = asked.groupBy("key", "print").agg(F.collect_list(F.struct("digit", "first", "one", "needed")).alias("rows"))
    met = ids.join(lists.withColumnsRenamed({"key": "__key", "print": "__print"}), F.col("key").eqNullSafe(F.col("__key")) & (F.col("print") == F.col("__print")))
    met = met.select("key", "print", "text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.texts(batch.column("text"), K.SLICE_BYTES // 2):
                symbols, before = (t.data, t.starts) if unit == "byte" else _codes(t, unit)[:2]
                out: list[tuple] = []
                owner: list[int] = []
                held = 0
                for i in range(len(t)):
                    own = symbols[before[i] : before[i + 1]]
                    for row in batch.column("rows")[t.first + i].as_py():
                        out.append((row["digit"], row["first"], row["needed"], own[row["first"] : row["one"] + depth].tobytes()))
                        owner.append(t.first + i)
                        held += len(out[-1][-1])
                    if out and (held >= shared.BATCH_BYTES or i == len(t) - 1):
                        at = pa.array(owner)
                        cols = [pa.array(x, y) for x, y in zip(zip(*out), (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("print").take(at), *cols], ["key", "print", "digit", "first", "needed", "body"])
                        out, owner, held = [], [], 0

    schema = T.StructType([T.StructField("key", ids.schema["key"].dataType), T.StructField("print", T.LongType()), T.StructField("digit", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("needed", T.BooleanType()), T.StructField("body", T.BinaryType())])
    return shared.arrow_map(met, run, schema)


def _last_pass(bodies: DataFrame, depth: int, unit: str) -> DataFrame:
    """key, print, first, last of the runs of repeated windows in the bodies that need them; anchors are sorted whole,
    as many at a time as fit."""
    kind = np.uint8 if unit == "byte" else np.uint64
    ordered = bodies.repartition("digit").sortWithinPartitions("digit")
    schema = T.StructType([bodies.schema["key"], T.StructField("print", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sort(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if not rows.num_rows:
                return
            needed = rows.column("needed").to_pylist()
            body = [np.frombuffer(x.as_buffer(), kind) for x in rows.column("body")]
            first = rows.column("first").to_pylist()
            out, owner = [], []
            for i, places in enumerate(_repeated_windows(body, depth, rows.column("digit").to_numpy())):
                if needed[i]:
                    for a, b in _runs(places):
                        out.append((first[i] + a, first[i] + b))
                        owner.append(i)
            if out:
                at = pa.array(owner)
                ids = [rows.column(c).take(at).combine_chunks() for c in ("key", "print")]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x, pa.int32()) for x in zip(*out))], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) < SORTED_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            digit = rows.column("digit").to_numpy()
            changes = np.flatnonzero(digit[1:] != digit[:-1])
            if len(changes):  # the last anchor may go on
                cut = int(changes[-1]) + 1
                yield from sort(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield from sort(pa.Table.from_batches(held))

    return shared.arrow_map(ordered, run, schema)


def _by_windows(bodies: DataFrame, depth: int, unit: str) -> DataFrame:
    """The same for anchors with too many rows for one task: their windows are sorted by a shuffle."""
    kind = np.uint8 if unit == "byte" else np.uint64
    schema = T.StructType([bodies.schema["key"], T.StructField("print", T.LongType()), T.StructField("needed", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("window", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                body = [np.frombuffer(x.as_buffer(), kind) for x in part.column("body")]
                lengths = np.fromiter(map(len, body), np.int64, len(body))
                flat = np.concatenate(body)
                sums = _sums(K.BYTE_CODES[flat] if unit == "byte" else flat)
                windows, before = lengths - depth + 1, np.cumsum(lengths) - lengths
                s = K.gather(np.arange(len(flat)), before, windows)
                owner = np.repeat(np.arange(len(body)), windows)
                hashes = K.mix(_hashes(sums, s, s + depth) + part.column("digit").to_numpy()[owner].astype(np.uint64))
                at = pa.array(owner)
                start = part.column("first").to_numpy()[owner] + s - before[owner]
                yield pa.RecordBatch.from_arrays([part.column("key").take(at), part.column("print").take(at), part.column("needed").take(at), pa.array(start.astype(np.int32)), pa.array(hashes.astype(np.int64))], schema.names)

    rows = shared.arrow_map(bodies, run, schema)
    twice = rows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return rows.where("needed").join(twice, "window").select("key", "print", F.col("start").alias("first"), F.col("start").alias("last"))


def repeated_spans(docs: DataFrame, key: str, text: str, depth: int, digit: int, unit: str) -> DataFrame:
    """key, print (hash of the text) and spans (first and last start of runs of repeated windows) of every text
    that has some."""
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    shared.ship(spark)
    ids = _identified(docs, key, text)
    rows = shared.written(spark, _anchor_rows(ids, depth, digit, unit), "anchors")
    twice = rows.groupBy("digit").agg(F.sum("times").alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    twice = twice.where("n > 1").select("digit", (F.col("low") != F.col("high")).alias("mixed"))
    met = shared.written(spark, rows.join(twice, "digit"), "repeated")
    shared.remove(spark, rows.shared_path)
    whole = met.where(~F.col("mixed")).select("key", "print", "first", "last")

    mixed = met.where("mixed")
    place = F.struct("key", "print", "first")
    kinds = mixed.groupBy("digit", "around").agg(F.sum("times").alias("n"), F.min(place).alias("speaker"))
    size = kinds.groupBy("digit").agg(F.count(F.lit(1)).alias("kinds"))
    told = shared.written(spark, mixed.join(kinds, ["digit", "around"]).join(size, "digit").withColumn("speaks", place.eqNullSafe(F.col("speaker"))).drop("speaker", "mixed"), "mixed")
    whole = whole.unionByName(told.where("n > 1").select("key", "print", "first", "last"))
    asked = told.where("n = 1 OR speaks").withColumn("needed", F.col("n") == 1)
    bodies = shared.written(spark, _bodies(ids, asked.where(F.col("kinds") <= ANCHOR_ROWS), depth, unit), "bodies")
    parts = [whole, _last_pass(bodies, depth, unit)]
    if not (large := asked.where(F.col("kinds") > ANCHOR_ROWS)).isEmpty():
        parts.append(_by_windows(shared.written(spark, _bodies(ids, large, depth, unit), "large"), depth, unit))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("key", "print").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _removed(spans: list[dict], depth: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols that the windows cover."""
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"] + depth) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 400, digit: int | None = None, unit: str = "byte", kept: str = "kept") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), spans (removed byte ranges, start and end) and ``kept``, the remaining bytes.

    A byte goes when a string of ``depth`` symbols that covers it starts anywhere else too, in the same text or
    another; strings are judged on the input. ``unit`` is "byte" or "word"; a word then takes the separators behind
    it along. Null and empty texts keep nothing and lose nothing; shorter texts than ``depth`` stay whole; rows that
    repeat are repeats of each other. Columns with the results' names are replaced. Bytes cut within a character
    leave ``kept`` without valid UTF-8; text_of() makes text of it.
    """
    spark = docs.sparkSession
    digit = digit or max(1, depth * 2 // 5)
    found = shared.written(spark, repeated_spans(docs, key, text, depth, digit, unit), "spans")
    results = {"n_bytes", "spans", kept}
    columns = [c for c in docs.columns if c not in results or c == text]
    found = found.withColumnsRenamed({"key": "__key", "print": "__print", "spans": "__spans"})
    here = docs.select(*columns).withColumn("__text_print", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    met = here.join(found, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__text_print") == F.col("__print")), "left").drop("__key", "__print", "__text_print")

    def make(batch: pa.RecordBatch) -> list:
        sizes, spans, rest = [], [], []
        listed = batch.column("__spans")
        for t in K.texts(batch.column(text)):
            whole = bytes(t.data)
            cells = None
            for i in range(len(t)):
                body = whole[t.starts[i] : t.starts[i + 1]]
                sizes.append(len(body))
                if not listed[t.first + i].is_valid:
                    spans.append([])
                    rest.append(body)
                    continue
                gone = _removed(listed[t.first + i].as_py(), depth)
                if unit == "word":
                    _, before, starts, stops = cells = cells or _codes(t, unit)
                    base, lo = int(before[i]), int(t.starts[i])
                    gone = [(int(starts[base + a]) - lo, int(stops[base + b - 1]) - lo) for a, b in gone]
                spans.append([{"start": a, "end": b} for a, b in gone])
                edges = [0, *(x for pair in gone for x in pair), len(body)]
                rest.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return [pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(rest, pa.binary())]

    return shared.mapped(met, {"n_bytes": "long", "spans": "array<struct<start:int,end:int>>", kept: "binary"}, make, keep=columns)
