"""Exact n-gram Jaccard self-join: size-banded tiles, bitmap signatures, exact intersection.

Documents with equal shingle sets are one node. Nodes fall into bands of sizes such that linked nodes are in one band
or in neighbouring ones; a tile is a band together with the next. Two linked nodes of a tile differ in at most H
shingles, so when hash ranges cut every set of the tile into H + 1 + spare cells, at least spare + 1 cells are equal
in both: a tile is split by the contents of its cells, and only nodes that share a whole cell meet. Empty cells
don't count, unless a node has more of them than are spare.

Nodes of a cell are compared with its least node first and links joined to components; only then do nodes that are
not yet in one component meet in blocks. Each pair must pass the bound from the bit counts of signatures of 512 bits,
in blocks 2048 (bits that differ are shingles that differ), before the sorted arrays of shingle hashes are intersected.

Shingles are compared as 64-bit hashes; all counts and decisions about links are exact for these.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from . import textkernel as K
from .components import components

#: Words of 64 bits in a signature, and bytes of the wide one that large groups need.
WORDS, WIDE = 8, 256
BITS = [f"b{k}" for k in range(WORDS)]
#: Nodes of a block, members that one copy of a hub's set meets, and partners of one list.
BLOCK, MEMBERS, LIST = 8192, 2000, 1024
#: Nodes that a task remembers having met, and partners that a tile gathers before they leave.
SEEN, GATHERED = 500_000, 500_000


class Bands:
    """Size bands and cell counts for links with den * |x & y| >= num * |x | y|."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        self.differ: list[int] = []
        self.cells: list[int] = []
        self.spare: list[int] = []

    def _extend(self) -> None:
        low = self.edges[-1]
        high = low * self.den // self.num  # the largest size of the band
        self.edges.append(high + 1)
        union = high * self.den // self.num
        differ = (self.den - self.num) * union // self.den
        spare = 0
        while True:  # spare cells for the empty ones that the smallest sets will have
            cells = differ + 1 + spare
            empty = cells * math.exp(-low / cells)
            if spare >= empty + 4 * math.sqrt(empty) or spare > cells // 2:
                break
            spare += 1
        self.differ.append(differ)
        self.cells.append(differ + 1 + spare)
        self.spare.append(spare)

    def of(self, n: int) -> int:
        while self.edges[-1] <= n:
            self._extend()
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Keys of the cells of a node (sorted distinct hashes) in both of its tiles."""
        n = len(shingles)
        band = self.of(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(K.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        out = []
        for tile in (band, band - 1):
            if tile < 0 or self.differ[tile] == 0:  # without a difference, linked sets are equal
                continue
            cells = self.cells[tile]
            edges = np.empty(cells + 1, np.int64)
            edges[1:-1] = np.searchsorted(shingles, _cuts(cells))
            edges[0], edges[-1] = 0, n
            number = np.arange(cells)
            full = np.diff(edges) > 0
            if cells - int(full.sum()) <= self.spare[tile]:
                number = number[full]
            content = sums[edges[number + 1]] - sums[edges[number]]
            out.append(K.mix(content + (number + (tile << 32)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


@functools.lru_cache(4096)
def _cuts(cells: int) -> np.ndarray:
    """Where the 64-bit range is cut into equal cells."""
    return np.array([(k << 64) // cells for k in range(1, cells)], np.uint64)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every text of the column, lower-cased."""
    for t in K.texts(column, K.SLICE_BYTES // 2):
        low = K.Texts(K.LOWER[t.data], t.starts, t.first)
        starts, ends, before = K.words(low)
        flat, at = K.shingles(K.span_hashes(low.data, starts, ends), before, width)
        for i in range(len(t)):
            yield t.first + i, flat[at[i] : at[i + 1]]


def _node(shingles: np.ndarray) -> int:
    """A node's name: a hash of its set, as a signed 64-bit integer."""
    total = K.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(K.mix(np.array([total]))[0].astype(np.int64))


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, n_shingles, node and the signature of every document, as a written table."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType())] + [T.StructField(b, T.LongType()) for b in BITS] + [T.StructField("wide", T.BinaryType())])
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    shared.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, bits, wide = [], [], [], []
            for _, shingles in _sets(batch.column("text"), width):
                n.append(len(shingles))
                node.append(_node(shingles))
                mask = np.zeros(8 * WIDE, bool)
                mask[(shingles & np.uint64(8 * WIDE - 1)).astype(np.int64)] = True
                wide.append(np.packbits(mask, bitorder="little").tobytes())
                mask = np.logical_or.reduce(mask.reshape(-1, 64 * WORDS))
                bits.append(np.packbits(mask, bitorder="little").view(np.int64))
            if n:
                table = np.stack(bits)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(WORDS)), pa.array(wide, pa.binary())], schema.names)

    return shared.written(spark, shared.arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema), "signatures")


def cells(docs: DataFrame, text: str, width: int, num: int, den: int) -> DataFrame:
    """cell, node: a row for every cell key of every node. Of copies that one task meets soon after each other one
    counts; rows may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            keys, nodes, counts = [], [], []
            for _, shingles in _sets(batch.column("text"), width):
                if not len(shingles) or (node := _node(shingles)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                own = bands.keys(shingles)
                keys.append(own)
                nodes.append(node)
                counts.append(len(own))
            if keys:
                flat = np.concatenate(keys).astype(np.int64)
                owner = np.repeat(np.array(nodes, np.int64), counts)
                for k in range(0, len(flat), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(flat[k : k + 200_000]), pa.array(owner[k : k + 200_000])], ["cell", "node"])

    return shared.arrow_map(docs.select(F.col(text).alias("text")), run, "cell long, node long")


def passes_for(num: int, den: int) -> int:
    """As many passes as there are times the cells of a join at 0.9: (den - num) / num for each shingle."""
    return max(1, -(-9 * (den - num) // num))


def meetings(found: DataFrame, passes: int) -> DataFrame:
    """cell, node, hub (its least node) of all cells with several nodes, which few have. Each pass takes one share of the
    cells whole, so that no more than that share's rows are in shuffle files at a time."""
    spark, parts = found.sparkSession, []
    for k in range(passes):
        share = found.where(F.pmod("cell", F.lit(passes)) == k)
        hubs = share.groupBy("cell").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").drop("top")
        parts.append(shared.written(spark, share.join(hubs, "cell").distinct(), "cells"))
    return functools.reduce(DataFrame.unionByName, parts)


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """The bound: with d bits different at least d shingles are, so the overlap is at most (n + m - d) / 2."""
    differ = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in BITS), F.lit(0))
    total = F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")
    overlap = F.least(F.floor((total - differ) / 2), F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles"))
    return den * overlap >= num * (total - overlap)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b of nodes) that are links, by intersecting their sorted shingle arrays; a written table.

    A set moves once to each hub (b) that it is compared with. A hub's set is copied for every MEMBERS members, so
    that a hub with very many of them spreads over tasks.
    """
    spark = docs.sparkSession
    hubs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(hubs, "b").select(F.col("a").alias("node"), F.struct(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role")).alias("to"))
    copies = hubs.select(F.col("b").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("node", F.struct(F.col("node").alias("hub"), "part", F.lit(0).alias("role")).alias("to"))
    wanted = members.unionByName(copies)
    many = wanted.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("lists")).where("lists > 1")
    wanted = wanted.join(many, "node", "left").withColumn("list", F.pmod(F.xxhash64("to"), F.coalesce("lists", F.lit(1))))
    wanted = wanted.groupBy("node", "list").agg(F.collect_list("to").alias("to")).drop("list")  # about LIST each
    wanted = wanted.join(classes.select("node", "rep"), "node")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, F.col("key").eqNullSafe(F.col("rep"))).select("text", "node", "to")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, to = batch.column("node").to_pylist(), batch.column("to")
            rows, held = [], 0
            for i, shingles in _sets(batch.column("text"), width):
                if _node(shingles) != nodes[i]:  # another text under the same key
                    continue
                body = shingles.tobytes()
                for one in to[i].as_py():
                    rows.append((one["hub"], one["part"], one["role"], nodes[i], body))
                    held += len(body)
                    if held >= shared.BATCH_BYTES:
                        yield _sent(rows)
                        rows, held = [], 0
            if rows:
                yield _sent(rows)

    sent = shared.arrow_map(texts, send, "hub long, part int, role int, node long, body binary")
    ordered = sent.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            columns = (batch.column(c).to_pylist() for c in ("hub", "part", "role", "node"))
            for i, (h, part, role, node) in enumerate(zip(*columns, strict=True)):
                other = np.frombuffer(batch.column("body")[i].as_buffer(), np.uint64)
                if role == 0:
                    hub, own = (h, part), np.array(other)
                elif hub == (h, part):
                    small, large = (own, other) if len(own) < len(other) else (other, own)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum())
                    if den * both >= num * (len(own) + len(other) - both):
                        a.append(node)
                        b.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return shared.written(spark, shared.arrow_map(ordered, meet, "a long, b long").distinct(), "verified")


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), kinds, strict=True)], ["hub", "part", "role", "node", "body"])


def rest_pairs(met: DataFrame, comp: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes that share a cell, aren't in one component and weren't compared with its hub, if their
    signatures allow a link. Cells are cut into blocks of about BLOCK nodes and every pair of blocks is a tile, so no
    task holds all pairs of a cell; in a tile all nodes outside its largest component meet all others. A node's
    partners leave as lists, some before the tile is done, and lists of several cells are united before they become
    pairs. Cells are judged by aggregates and met by a join, which can be split where a cell has very many nodes."""
    rows = met.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_cells = rows.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    rows = rows.join(open_cells.where("low <> high AND size > 2").select("cell", "size"), "cell").where("node <> hub")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = rows.join(classes.select("node", "n_shingles", "wide"), "node").withColumn("other", F.explode(other))
    rows = rows.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("left"), "node", "component", "n_shingles", "wide")
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def met_in(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            column = {c: rows.column(c).to_numpy() for c in ("cell", "i", "j", "left", "node", "component", "n_shingles")}
            bits = np.frombuffer(b"".join(x.as_buffer() for x in rows.column("wide")), np.uint64).reshape(-1, WIDE // 8)
            changes = np.zeros(rows.num_rows, bool)
            changes[0] = True
            for c in ("cell", "i", "j"):
                changes[1:] |= column[c][1:] != column[c][:-1]
            starts = np.flatnonzero(changes)
            out: dict[int, set[int]] = {}
            held = 0

            def told() -> pa.RecordBatch:
                lists = [(node, *x) for node, partners in out.items() for x in _lists(partners)]
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*lists), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["b", "part", "partners"])

            for a, b in zip(starts, np.append(starts[1:], rows.num_rows)):
                if b - a < 2:
                    continue
                for node, partners in _tile({c: x[a:b] for c, x in column.items()}, bits[a:b], num, den):
                    out.setdefault(node, set()).update(partners)
                    held += len(partners)
                    if held >= GATHERED:
                        yield told()
                        held = 0
            if out:
                yield told()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 2 * BLOCK:
                continue
            rows = pa.Table.from_batches(held)
            cell = rows.column("cell").to_numpy()
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (rows.column("i").to_numpy()[1:] != rows.column("i").to_numpy()[:-1]) | (rows.column("j").to_numpy()[1:] != rows.column("j").to_numpy()[:-1]))
            if len(cuts):  # the last tile may go on
                yield from met_in(rows.slice(0, int(cuts[-1]) + 1))
                held = rows.slice(int(cuts[-1]) + 1).combine_chunks().to_batches()
        if held:
            yield from met_in(pa.Table.from_batches(held))

    found = shared.arrow_map(rows, run, "b long, part long, partners array<long>")
    united = found.groupBy("b", "part").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    return united.select(F.explode("partners").alias("a"), "b").distinct()


def _lists(partners: set[int]) -> Iterator[tuple[int, list[int]]]:
    """Partners as lists of about LIST at most, with a number that tells which partners belong in such a list: lists
    of one node and number are united, those of a node with very many partners don't all meet."""
    split = 1
    while len(partners) > LIST * split:
        split *= 8
    parts: dict[int, list[int]] = {}
    for x in partners:
        parts.setdefault(x % split, []).append(x)
    for k, part in parts.items():
        yield split << 32 | k, part


def _tile(column: dict[str, np.ndarray], bits: np.ndarray, num: int, den: int) -> Iterator[tuple[int, list[int]]]:
    """The tile's nodes outside its largest component that have partners, with these."""
    node, component, n, left = column["node"], column["component"], column["n_shingles"], column["left"]
    names, counts = np.unique(component, return_counts=True)
    main = names[np.argmax(counts)]
    crossing = column["i"][0] != column["j"][0]
    for q in np.flatnonzero(component != main):
        rest = component != component[q]
        rest &= (component == main) | (node > node[q])  # pairs of two such nodes once
        if crossing:
            rest &= left != left[q]
        at = np.flatnonzero(rest)
        differ = np.bitwise_count(bits[at] ^ bits[q]).sum(axis=1, dtype=np.int64)
        total = n[at] + n[q]
        overlap = np.minimum(np.minimum((total - differ) // 2, n[at]), n[q])
        at = at[den * overlap >= num * (total - overlap)]
        if len(at):
            yield int(node[q]), node[at].tolist()


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """key, n_shingles and component_id of every document: the smallest key reachable over links.

    Two documents link when den * |x & y| >= num * |x | y| for their sets of distinct ``width``-word shingles, words
    lower-cased in A-Z; with fewer words the whole sequence is the one shingle. Texts without words (null, empty)
    link with nothing and are their own component. Rows that repeat a key are judged each; a null key is never
    the smallest unless there is no other.
    """
    spark = docs.sparkSession
    sig = signatures(docs, key, text, width)
    classes = sig.where("n_shingles > 0").groupBy("node").agg(F.min("key").alias("rep"), F.max("n_shingles").alias("n_shingles"), *(F.max(b).alias(b) for b in BITS), F.max("wide").alias("wide"))
    classes = shared.written(spark, classes, "classes")
    found = shared.written(spark, cells(docs, text, width, num, den), "all-cells")
    met = meetings(found, passes_for(num, den))
    shared.remove(spark, found.shared_path)
    stars = met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    small = classes.select("node", "n_shingles", *BITS)
    stars = stars.join(small.alias("x"), F.col("a") == F.col("x.node")).join(small.alias("y"), F.col("b") == F.col("y.node")).where(_may_link("x", "y", num, den)).select("a", "b")
    stars = shared.written(spark, stars, "stars")
    links = verified(stars, classes, docs, key, text, width, num, den)
    comp = components(links)
    rest = shared.written(spark, rest_pairs(met, comp, classes, num, den), "rest")
    if not rest.isEmpty():
        links = links.unionByName(verified(rest, classes, docs, key, text, width, num, den))
        comp = components(links)
    groups = classes.select("node", "rep").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = groups.select("node", "component").join(names, "component").select("node", "component_id")
    kept = sig.select("key", "n_shingles", "node").join(names, "node", "left")
    return kept.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "key")).otherwise(F.col("key")).alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component of joined(): the one whose key is the component's, and of rows
    that repeat key and text one. Texts without words all stay, but for such repeats."""
    found = joined(docs, key, text, **options)
    stay = shared.written(docs.sparkSession, found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(key).distinct(), "representatives")
    names = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__name"), F.col(key).isNull().alias("__null")]
    met = docs.select("*", *names, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__print")).join(stay.select(*names), ["__name", "__null"], "left_semi")
    return met.dropDuplicates(["__name", "__null", "__print"]).select(*docs.columns)
