"""Bytes as TIFF pages and back: image directories, strips and tiles, PackBits, LZW or deflate, predictors.

``encode`` writes grey 8-bit pages of a fixed width; ``pages`` walks the directories of any such file (either byte
order; grey 8-bit, one or more samples a pixel), decodes strips or tiles, undoes the horizontal predictor and gives
one image per page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from . import textkernel as K

# Fixed values of the TIFF 6.0 format: tags, field types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 317, 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

LINE = 192
#: Rows of a page and of a strip as with_media() writes them: a page holds at most 384 KB.
PAGE_ROWS, STRIP_ROWS = 2048, 512


def packbits(data: bytes) -> bytes:
    """Run-length form: runs of 3 or more equal bytes as repeats, the rest as literals."""
    out, at, literal = bytearray(), 0, bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            out.append(len(literal[k : k + 128]) - 1)
            out.extend(literal[k : k + 128])
        literal.clear()

    while at < len(data):
        end = at + 1
        while end < len(data) and end - at < 128 and data[end] == data[at]:
            end += 1
        if end - at >= 3:
            flush()
            out += bytes((257 - (end - at), data[at]))
        else:
            literal += data[at:end]
        at = end
    flush()
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += head + 2
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the highest bit, widened one code early; 256 clears, 257 ends."""
    bits, width, held, n_held = bytearray(), 9, 0, 0

    def put(code: int) -> None:
        nonlocal held, n_held
        held, n_held = held << width | code, n_held + width
        while n_held >= 8:
            n_held -= 8
            bits.append(held >> n_held & 255)
        held &= (1 << n_held) - 1

    put(256)
    table, prefix = {}, b""
    for value in data:
        longer = prefix + bytes((value,))
        if len(longer) == 1 or longer in table:
            prefix = longer
            continue
        put(table[prefix] if len(prefix) > 1 else prefix[0])
        table[longer] = 258 + len(table)
        prefix = longer[-1:]
        if 258 + len(table) == 4095:
            put(256)
            table, width = {}, 9
        elif 258 + len(table) >= 1 << width:
            width += 1
    if prefix:
        put(table[prefix] if len(prefix) > 1 else prefix[0])
        # the reader has caught up with the table here and widens by its own count
        if 258 + len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if n_held:
        bits.append(held << (8 - n_held) & 255)
    return bytes(bits)


def unlzw(data: bytes) -> bytes:
    out, table, width, held, n_held, previous = bytearray(), [], 9, 0, 0, None
    for value in data:
        held, n_held = (held << 8 | value) & 0xFFFFFF, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code = held >> n_held & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, previous = [], 9, None
            continue
        if code < 256:
            entry = bytes((code,))
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif previous is not None and code - 258 == len(table):
            entry = previous + previous[:1]
        else:
            raise ValueError("broken LZW data")
        out += entry
        if previous is not None:
            table.append(previous + entry[:1])
            if 258 + len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        previous = entry
    return bytes(out)


def _compressed(data: bytes, scheme: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme == PACKBITS:
        return packbits(data)
    return lzw(data) if scheme == LZW else zlib.compress(data, 1)


def _plain(data: bytes, scheme: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme == PACKBITS:
        return unpackbits(data)
    if scheme == LZW:
        return unlzw(data)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {scheme} isn't known")


def encode(images: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: int = 0) -> bytes:
    """A little-endian TIFF of grey 8-bit pages; ``tile`` over 0 (a multiple of 16) cuts tiles instead of strips."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for image in images:
        height, width = image.shape
        if tile:
            parts = []
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    cell = np.zeros((tile, tile), np.uint8)
                    part = image[y : y + tile, x : x + tile]
                    cell[: part.shape[0], : part.shape[1]] = part
                    parts.append(cell)
        else:
            parts = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            body = _compressed(part.tobytes(), scheme)
            offsets.append(len(out))
            sizes.append(len(body))
            out += body
        fields = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [scheme]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        fields += [(TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILE_OFFSETS, offsets), (TILE_SIZES, sizes)] if tile else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [strip_rows]), (STRIP_SIZES, sizes)]
        entries = bytearray()
        for tag, values in sorted(fields):
            body = struct.pack(f"<{len(values)}I", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                body, at = struct.pack("<I", len(out)), body
                out += at
            entries += struct.pack("<HHI", tag, 4, len(values)) + body
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def pages(data: bytes) -> Iterator[np.ndarray]:
    """Every page's samples as an array of rows. Raises ValueError where the file isn't whole."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    end = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(end + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    seen: set[int] = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("broken directory chain")
        seen.add(at)
        (count,) = struct.unpack_from(end + "H", data, at)
        tags: dict[int, tuple] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            form = f"{end}{n}{TYPES[kind]}"
            where = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(end + "I", data, where)
            tags[tag] = struct.unpack_from(form, data, where)
        yield _page(data, tags)
        (at,) = struct.unpack_from(end + "I", data, at + 2 + 12 * count)


def _page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, scheme, predictor, samples = one(WIDTH, 0), one(HEIGHT, 0), one(COMPRESSION, 1), one(PREDICTOR, 1), one(SAMPLES, 1)
    if set(tags.get(BITS, (1,))) != {8} or predictor not in (1, 2):
        raise ValueError("only 8-bit samples with no or the horizontal predictor are read")
    if TILE_OFFSETS in tags:
        across, down, offsets, sizes = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_OFFSETS], tags[TILE_SIZES]
    else:
        across, down, offsets, sizes = width, min(one(ROWS_PER_STRIP, height), height), tags[STRIP_OFFSETS], tags[STRIP_SIZES]
    image = np.zeros((height, width * samples), np.uint8)
    per_row = -(-width // across) if across else 1
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // per_row * down, k % per_row * across
        rows = down if TILE_OFFSETS in tags else min(down, height - y)
        part = np.frombuffer(_plain(data[offset : offset + size], scheme), np.uint8)
        part = part[: rows * across * samples].reshape(rows, across * samples)
        if predictor == 2:
            part = np.cumsum(part.reshape(rows, across, samples), axis=1, dtype=np.uint8).reshape(rows, -1)
        spot = image[y : y + rows, x * samples : (x + across) * samples]
        spot[:] = part[: spot.shape[0], : spot.shape[1]]
    return image


def payload(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of LINE bytes."""
    return text + b" " * (max(LINE, -(-len(text) // LINE) * LINE) - len(text))


def stored(body: bytes) -> bytes:
    """A payload as a TIFF: deflated strips with the horizontal predictor, pages of PAGE_ROWS rows."""
    grid = np.frombuffer(body, np.uint8).reshape(-1, LINE)
    return encode([grid[k : k + PAGE_ROWS] for k in range(0, len(grid), PAGE_ROWS)], DEFLATE, 2)


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with n_bytes (of the text in UTF-8) and its payload as a TIFF file in a binary column. Null and empty
    texts give one row of spaces; a long text gives several pages. Columns with the results' names are replaced."""

    def make(batch: pa.RecordBatch) -> list:
        sizes, files = [], []
        for t in K.texts(batch.column(text)):
            whole = bytes(t.data)
            for a, b in zip(t.starts.tolist(), t.starts[1:].tolist()):
                sizes.append(b - a)
                files.append(stored(payload(whole[a:b])))
        return [pa.array(sizes, pa.int64()), pa.array(files, pa.binary())]

    return shared.mapped(docs, {"n_bytes": "long", media: "binary"}, make)


def page_rows(files: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """One row per page of every file: the columns ``keep`` of its row, page (from 0), n_pages, width, height and pixels (the
    samples, row by row). Pages of a file follow each other. A null or empty file has no page; a broken one raises."""
    spark = files.sparkSession
    shared.bounded_batches(spark)
    shared.ship(spark)
    from pyspark.sql import types as T

    new = [("page", T.IntegerType()), ("n_pages", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("pixels", T.BinaryType())]
    schema = T.StructType([files.schema[c] for c in keep if c not in dict(new)] + [T.StructField(n, t) for n, t in new])
    keep = [c for c in keep if c not in dict(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows, held = [], [], 0
            for i, file in enumerate(batch.column(media)):
                found = list(pages(file.as_buffer().to_pybytes())) if file.as_buffer() is not None and len(file.as_buffer()) else []
                for k, image in enumerate(found):
                    owner.append(i)
                    rows.append((k, len(found), image.shape[1], image.shape[0], image.tobytes()))
                    held += image.size
                if held > shared.BATCH_BYTES or i == batch.num_rows - 1:
                    if rows:
                        at = pa.array(owner)
                        cols = [pa.array(x, y) for x, y in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), *cols], schema.names)
                    owner, rows, held = [], [], 0

    return shared.arrow_map(files, run, schema)


def features(image: np.ndarray) -> tuple[np.ndarray, int]:
    """Histogram of the samples' upper four bits, and the sum of steps between neighbours in a row."""
    return np.bincount(image >> 4, minlength=16)[:16], int(np.abs(np.diff(image.astype(np.int16))).sum())


def read_back(files: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """Per file, from its pages: ``keep``, payload_bytes, payload_sha256, tail_crc32 (last 16 bytes), media_bytes,
    media_sha256 and feature (pages, rows, share of samples by upper four bits in percent, mean step between
    neighbours). Pages arrive in order within a partition, so nothing is shuffled."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    listed = page_rows(files.select(*keep, media, F.length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256")), [*keep, "media_bytes", "media_sha256"], media)
    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType())]
    kept = [*keep, "media_bytes", "media_sha256"]
    schema = T.StructType([listed.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, tail, size, rows, histogram, steps = hashlib.sha256(), b"", 0, 0, np.zeros(16, np.int64), 0
        for batch in batches:
            done, results = [], []
            pixels, page, n_pages, heights = batch.column("pixels"), batch.column("page").to_pylist(), batch.column("n_pages").to_pylist(), batch.column("height").to_pylist()
            for i in range(batch.num_rows):
                body = pixels[i].as_buffer()
                image = np.frombuffer(body, np.uint8)
                digest.update(body)
                tail, size, rows = (tail + bytes(image[-16:]))[-16:], size + len(image), rows + heights[i]
                counts, more = features(image)
                histogram, steps = histogram + counts, steps + more
                if page[i] == n_pages[i] - 1:
                    shares = ",".join(str(int(x)) for x in histogram * 100 // max(size, 1))
                    results.append((size, digest.hexdigest(), zlib.crc32(tail), f"pages={n_pages[i]};rows={rows};hist={shares};step={steps / max(size, 1):.4f}"))
                    done.append(i)
                    digest, tail, size, rows, histogram, steps = hashlib.sha256(), b"", 0, 0, np.zeros(16, np.int64), 0
            if done:
                cols = [pa.array(x, y) for x, y in zip(zip(*results), (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(done)) for c in kept), *cols], schema.names)

    return shared.arrow_map(listed, run, schema)
