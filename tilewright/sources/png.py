"""PNG images as pixel tables, read and written: files are decoded where Spark reads them, images are filtered and deflated in bands of rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.scalar import c, clamp, idiv
from tilewright.sources.files import write_files

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: channels of each colour type, depths it may have, and the seven passes of an interlaced image (first row, first column, steps).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
#: Rows that are filtered and deflated together when an image is written; pixels in an Arrow batch when one is read.
BAND, _PIXELS = 64, 1 << 16


class ImageError(ValueError):
    """A file that is no image that can be taken; code says why."""

    def __init__(self, code: str, what: str, width: int | None = None, height: int | None = None, channels: int | None = None):
        super().__init__(f"{code}: {what}")
        self.code, self.size = code, (width, height, channels)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ImageError("INVALID_IMAGE", "no PNG signature")
    at = 8
    while at + 12 <= len(data):
        (size,), tag = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise ImageError("INVALID_IMAGE", f"cut inside {tag!r}")
        if zlib.crc32(tag + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ImageError("INVALID_IMAGE", f"checksum of {tag!r}")
        yield tag, body
        if tag == b"IEND":
            return
        at += 12 + size
    raise ImageError("INVALID_IMAGE", "no end")


class Header:
    """What a file says before its pixels."""

    def __init__(self, body: bytes):
        self.width, self.height, self.depth, self.kind, method, filters, self.interlace = struct.unpack(">IIBBBBB", body)
        if self.kind not in CHANNELS or self.depth not in DEPTHS[self.kind] or method or filters or self.interlace > 1 or not self.width or not self.height:
            raise ImageError("INVALID_IMAGE", "a header that the format does not have")
        self.step = max(1, CHANNELS[self.kind] * self.depth // 8)

    def row_bytes(self, width: int) -> int:
        return -(-width * CHANNELS[self.kind] * self.depth // 8)

    def parts(self) -> list[tuple[int, int, int, int]]:
        """(first row, first column, row step, column step) of each pass that has pixels."""
        every = PASSES if self.interlace else ((0, 0, 1, 1),)
        return [p for p in every if p[0] < self.height and p[1] < self.width]


def _predicted(kind: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What the five filters predict from the neighbours; kind: (rows, 1)."""
    by_left, by_up, by_both = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    nearest = np.where((by_left <= by_up) & (by_left <= by_both), left, np.where(by_up <= by_both, up, corner))
    return np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of scanlines (a filter's number first): rows that lean on their left or the row above only are summed up a row at a time, others
    a diagonal at a time, since a byte's three neighbours lie on the two diagonals before its own."""
    kinds, raw = lines[:, 0], lines[:, 1:]
    if (kinds > 4).any():
        raise ImageError("INVALID_IMAGE", "a filter that the format does not have")
    rows, size = raw.shape
    wide = -(-size // step)
    cells = np.zeros((rows, wide * step), np.uint8)
    cells[:, :size] = raw
    cells = cells.reshape(rows, wide, step)
    if (kinds <= 2).all():
        for y in range(rows):
            if kinds[y] == 1:
                cells[y] = np.cumsum(cells[y], axis=0, dtype=np.uint8)
            elif kinds[y] == 2 and y:
                cells[y] += cells[y - 1]
    else:
        out = np.zeros((rows + 1, wide + 1, step), np.int16)
        for d in range(rows + wide - 1):
            y = np.arange(max(0, d - wide + 1), min(rows - 1, d) + 1)
            x = d - y
            guess = _predicted(kinds[y, None], out[y + 1, x], out[y, x + 1], out[y, x])
            out[y + 1, x + 1] = (cells[y, x] + guess) & 255
        cells = out[1:, 1:].astype(np.uint8)
    return cells.reshape(rows, wide * step)[:, :size]


def _samples(line_bytes: np.ndarray, header: Header, width: int) -> np.ndarray:
    """(rows, width, channels) of the file's own samples."""
    rows, n = len(line_bytes), CHANNELS[header.kind]
    if header.depth == 16:
        return line_bytes.reshape(rows, width, n, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if header.depth == 8:
        return line_bytes.reshape(rows, width, n)
    bits = np.unpackbits(line_bytes, axis=1).reshape(rows, -1, header.depth)
    return (bits @ (1 << np.arange(header.depth)[::-1]).astype(np.uint8))[:, :width, None]


def inflated(data: bytes) -> tuple[Header, dict[bytes, bytes], bytes]:
    """The header, palette and transparency of a file, and its filtered scanlines."""
    header, other, packed = None, {}, []
    for tag, body in _chunks(data):
        if header is None:
            if tag != b"IHDR" or len(body) != 13:
                raise ImageError("INVALID_IMAGE", "no header")
            header = Header(body)
        elif tag == b"IDAT":
            packed.append(body)
        elif tag in (b"PLTE", b"tRNS"):
            other[tag] = body
    if header is None:
        raise ImageError("INVALID_IMAGE", "no header")
    size = sum((header.row_bytes(-(-(header.width - x) // dx)) + 1) * -(-(header.height - y) // dy) for y, x, dy, dx in header.parts())
    try:
        lines = zlib.decompressobj().decompress(b"".join(packed), size)  # no more than the header asks for
    except zlib.error as error:
        raise ImageError("INVALID_IMAGE", str(error)) from None
    if len(lines) < size:
        raise ImageError("INVALID_IMAGE", "too few scanlines")
    return header, other, lines


def decode_png(data: bytes, multiple: int = 8) -> np.ndarray:
    """(height, width, channels) of a file, 8 bits each: 16 bits lose their lower half, palettes are looked up, a transparent colour becomes
    an alpha channel. ImageError for what is no PNG, is broken, or has a side that is no multiple of multiple."""
    header, other, lines = inflated(data)
    n = CHANNELS[header.kind]
    if header.width % multiple or header.height % multiple:
        raise ImageError("INVALID_SIZE", f"{header.width} x {header.height} is no multiple of {multiple}", header.width, header.height, 3 + (b"tRNS" in other) if header.kind == 3 else n + (b"tRNS" in other))
    image, at = np.zeros((header.height, header.width, n), np.uint16), 0
    for y, x, dy, dx in header.parts():
        rows, wide = -(-(header.height - y) // dy), -(-(header.width - x) // dx)
        size = header.row_bytes(wide) + 1
        part = np.frombuffer(lines, np.uint8, rows * size, at).reshape(rows, size)
        at += rows * size
        image[y::dy, x::dx] = _samples(unfilter(part, header.step), header, wide)
    clear = other.get(b"tRNS")
    if header.kind == 3:
        colors = np.zeros((256, 3 + (clear is not None)), np.uint8)
        table = np.frombuffer(other.get(b"PLTE", b""), np.uint8)
        if not len(table) or len(table) % 3 or int(image.max()) >= len(table) // 3:
            raise ImageError("INVALID_IMAGE", "a palette without the colours that are used")
        colors[: len(table) // 3, :3] = table.reshape(-1, 3)
        if clear is not None:
            colors[:, 3] = 255
            colors[: len(clear), 3] = np.frombuffer(clear, np.uint8)[:256]
        return colors[image[:, :, 0]]
    alpha = None
    if clear is not None and header.kind in (0, 2) and len(clear) >= 2 * n:
        alpha = np.where((image == np.frombuffer(clear, ">u2", n)).all(axis=2), 0, 255).astype(np.uint8)[:, :, None]
    eight = image >> 8 if header.depth == 16 else image * (255 // ((1 << header.depth) - 1))
    eight = eight.astype(np.uint8)
    return eight if alpha is None else np.concatenate([eight, alpha], axis=2)


PIXELS = "path string, width int, height int, channels int, y int, x int, r int, g int, b int, a int, error string"
_SCHEMA = pa.schema([("path", pa.string()), *[(k, pa.int32()) for k in ("width", "height", "channels", "y", "x", "r", "g", "b", "a")], ("error", pa.string())])


def read_png(spark: SparkSession, path: str, multiple: int = 8, glob: str = "*.png") -> DataFrame:
    """PIXELS of the files under a path, through Spark's own file systems: each file is decoded by the task that reads it.

    Grey images have their value in r, g and b; a is null where there is no alpha. A file that is refused (INVALID_SIZE) or broken (INVALID_IMAGE)
    is one row with its error and no pixel, and harms no other. An empty folder gives no rows; files of no bytes are not listed by Spark's reader."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    image = decode_png(content.as_buffer().to_pybytes(), multiple)
                except ImageError as error:
                    width, height, channels = error.size
                    yield pa.RecordBatch.from_pylist([{"path": name, "width": width, "height": height, "channels": channels, "error": str(error)}], _SCHEMA)
                    continue
                height, width, n = image.shape
                rows = max(1, _PIXELS // width)
                for top in range(0, height, rows):
                    band = image[top : top + rows]
                    flat = band.reshape(-1, n).astype(np.int32)
                    size, k = len(flat), 0 if n < 3 else 1
                    columns = [pa.array([name] * size, pa.string()), *[pa.array(np.full(size, v, np.int32)) for v in (width, height, n)]]
                    columns += [pa.array(np.repeat(np.arange(top, top + len(band), dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(band)))]
                    columns += [pa.array(np.ascontiguousarray(flat[:, j * k])) for j in range(3)]
                    columns += [pa.array(np.ascontiguousarray(flat[:, n - 1])) if n in (2, 4) else pa.nulls(size, pa.int32()), pa.nulls(size, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(decode, PIXELS)


def read_filters(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, y, filter): the filter of each scanline of files that are not interlaced."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                header, _, lines = inflated(content.as_buffer().to_pybytes())
                kinds = np.frombuffer(lines, np.uint8)[:: header.row_bytes(header.width) + 1].astype(np.int32)
                yield pa.RecordBatch.from_pydict({"path": [name] * len(kinds), "y": pa.array(np.arange(len(kinds), dtype=np.int32)), "filter": pa.array(kinds)})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(find, "path string, y int, filter int")


def filtered(rows: np.ndarray) -> np.ndarray:
    """Scanlines of a band (rows, width, channels): of each row the filter whose bytes, as signed numbers, have the least sum, of equals the first.

    A band's first row may not lean on the row above it, so bands do not need each other."""
    high, wide, n = rows.shape
    padded = np.zeros((high + 1, wide + 1, n), np.int16)
    padded[1:, 1:] = rows
    here, left, up, corner = padded[1:, 1:], padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    every = np.stack([(here - _predicted(np.full((1, 1, 1), k), left, up, corner)).astype(np.uint8) for k in range(5)]).reshape(5, high, wide * n)
    cost = np.minimum(every, 256 - every.astype(np.int64)).sum(axis=2)
    cost[2:, 0] = np.iinfo(np.int64).max
    best = cost.argmin(axis=0)
    return np.concatenate([best[:, None].astype(np.uint8), every[best, np.arange(high)]], axis=1)


def _deflated(lines: bytes, last: bool, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    return packer.compress(lines) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def _sums_joined(first: int, second: int, size: int) -> int:
    """The checksum of two runs of bytes together, size being that of the second."""
    prime = 65521
    a1, b1, a2, b2 = first & 65535, first >> 16, second & 65535, second >> 16
    return (a1 + a2 - 1) % prime | ((b1 + b2 + (a1 - 1) * size) % prime) << 16


def _chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


_PART = "name string, band int, width int, height int, data binary, checksum long, size long"
_PART_SCHEMA = pa.schema([("name", pa.string()), ("band", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary()), ("checksum", pa.int64()), ("size", pa.int64())])


def png_files(pixels: DataFrame, channels: list[str], signed: tuple[str, ...] = (), level: int = 6, band: int = BAND) -> DataFrame:
    """(name, data): a file for each name of pixels (name, y, x, <channels>), of 1 to 4 channels: grey, grey and alpha, colour, colour and alpha.

    128 is added to the signed channels, then all are cut to 0..255. An image is as large as its last row and column ask for; pixels that are
    missing or null are 0, of several at one place the one of the largest values stays. Bands of rows are filtered and deflated by themselves, wherever
    they are, and only their compressed bytes meet in a file. No pixels give no files."""
    values = [clamp(F.coalesce(c(k).cast("long"), F.lit(0)) + (128 if k in signed else 0), 0, 255).cast("int").alias(f"_{i}") for i, k in enumerate(channels)]
    kept = pixels.where("y >= 0 and x >= 0").select(F.col("name").cast("string").alias("name"), c("y").cast("int").alias("y"), c("x").cast("int").alias("x"), *values)
    sizes = kept.groupBy("name").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    n = len(channels)
    kinds = {1: 0, 2: 4, 3: 2, 4: 6}

    def pack(table: pa.Table) -> pa.Table:
        name, number, width, height = (table[k][0].as_py() for k in ("name", "band", "width", "height"))
        rows = np.zeros((min(band, height - number * band), width, n), np.uint8)
        columns = [table[k].to_numpy() for k in ("y", "x", *(f"_{i}" for i in range(n)))]
        order = np.lexsort(columns[2:][::-1])
        y, x, *cells = (v[order] for v in columns)
        rows[y - number * band, x] = np.stack(cells, axis=1)
        lines = filtered(rows).tobytes()
        made = _deflated(lines, number == (height - 1) // band, level)
        return pa.Table.from_pylist([{"name": name, "band": number, "width": width, "height": height, "data": made, "checksum": zlib.adler32(lines), "size": len(lines)}], _PART_SCHEMA)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, width, height, parts in zip(*(batch.column(k).to_pylist() for k in ("name", "width", "height", "parts")), strict=True):
                check = 1
                file = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kinds[n], 0, 0, 0)), _chunk(b"IDAT", b"\x78\x9c")]
                for p in parts:
                    file.append(_chunk(b"IDAT", p["data"]))
                    check = _sums_joined(check, p["checksum"], p["size"])
                out.append((f"{name}.png", b"".join([*file, _chunk(b"IDAT", struct.pack(">I", check)), _chunk(b"IEND", b"")])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["name", "data"])

    # every band of an image comes, also one without pixels: its first row's place stands for it
    bands = sizes.select("*", F.explode(F.sequence(F.lit(0), idiv(F.col("height") - 1, band).cast("int"))).alias("band"))
    marks = bands.select("name", (F.col("band") * band).cast("int").alias("y"), F.lit(0).alias("x"), *[F.lit(0).alias(f"_{i}") for i in range(n)])
    dealt = kept.unionByName(marks).withColumn("band", idiv("y", band).cast("int")).join(sizes, "name")
    parts = dealt.groupBy("name", "band").applyInArrow(pack, _PART)
    listed = parts.groupBy("name", "width", "height").agg(F.sort_array(F.collect_list(F.struct("band", "data", "checksum", "size"))).alias("parts"))
    return listed.mapInArrow(build, "name string, data binary")


def write_png(pixels: DataFrame, path: str, channels: list[str], signed: tuple[str, ...] = (), level: int = 6) -> None:
    """Write png_files to a folder; files appear when all are written."""
    write_files(png_files(pixels, channels, signed, level), path)


def name_of(path: Column | str) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(path, r"([^/]+)\.\w+$", 1)
