"""Whole images to containers and back: mask and alpha, gradients, point tables, then the one-dimensional quantiser for what is left."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.entropy import LEVELS_UP, zstd_search
from tilewright.functions.scalar import bitmap_position, c, compress, idiv, lut_word_parts, shl, shr, uncompress
from tilewright.operators import gradient, lut, palette, quant1d, streams
from tilewright.operators.gradient import checkpointed
from tilewright.operators.streams import RATE
from tilewright.sources.container import ALPHA, GRADIENT, MIP, RANGE, TABLE

RGB = ["r", "g", "b"]
_HEAD = "<BBBxIII"
_RANGE_HEAD = "<BxxxIII"
_TABLE_HEAD = "<12I12IBBxx"
_MIP_HEAD, _ALPHA_HEAD = "<4iIBBxx", "<4iIIBBxx"
#: log2 of the side of the mask's tiles.
_MIP_LEVEL = 4
#: Bytes of a piece of an alpha stream, and those that it has besides for a run of 16 values that begins in it.
_PIECE, _OVER = 256, 17


def _udf(f, kind: str):
    """An Arrow-batched function; made when it is used, as that takes a session."""
    return F.pandas_udf(f, kind)


def _log(n: int) -> int:
    return n.bit_length() - 1


def _size_code(tw: int, th: int) -> int:
    """log2 of the width and, three bits up, of the height."""
    return _log(tw) | _log(th) << 3


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=18).compress(data)


def _unzip(data: bytes) -> bytes:
    """All frames of a stream: blocks are compressed where they are made and follow each other in the file."""
    import io

    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()


def _zipped(data: pd.Series) -> pd.Series:
    return data.map(lambda b: _zip(bytes(b)))


def _packed(values: DataFrame, keys: list[str], levels=None) -> DataFrame:
    """(keys, parts, size): streams (keys, at, v) as compressed blocks in order; levels: those that are searched for each block."""
    packed = _udf(_zipped, "binary")("data") if levels is None else zstd_search(F.col("data"), levels)["packed"]
    each = streams.blocks(values, keys).select(*keys, "block", "size", packed.alias("data"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "data"))), lambda s: s["data"]).alias("parts"), F.sum("size").alias("size"))


def _gradient_bytes(size: pd.Series, rate: pd.Series, colors: pd.Series, bitmap: pd.Series, rgb: pd.Series) -> pd.Series:
    out = []
    for s, r, n, m, p in zip(size, rate, colors, bitmap, rgb, strict=True):
        m, p = _zip(bytes(m)), _zip(bytes(p))
        out.append(struct.pack(_HEAD, s, 7, r, len(m), len(p), n) + m + p)
    return pd.Series(out, dtype=object)


def _range_bytes(plane: pd.Series, pixels: pd.Series, symbols: pd.Series, params: pd.Series) -> pd.Series:
    out = []
    for k, n, s, p in zip(plane, pixels, symbols, params, strict=True):
        s, p = b"".join(map(bytes, s)), b"".join(map(bytes, p))
        out.append(struct.pack(_RANGE_HEAD, k, n, len(s), len(p)) + s + p)
    return pd.Series(out, dtype=object)


def _table_bytes(parts: pd.Series) -> pd.Series:
    """A chunk of tables from the streams that are there: (stream, size, parts). Counts are of colours' bytes, tiles and entries."""
    out = []
    for rows in parts:
        size, data = [0] * 12, [b""] * 12
        for r in rows:
            size[r["stream"]], data[r["stream"]] = r["size"], b"".join(map(bytes, r["parts"]))
        counts = [size[streams.BOXES], size[streams.WORDS] // 2, *size[:4]]
        packed = [len(data[k]) for k in (streams.WORDS, streams.BOXES, 0, 1, 2, 3)]
        out.append(struct.pack(_TABLE_HEAD, *counts, *packed, *size[6:], *map(len, data[6:]), 7, RATE) + b"".join(data))
    return pd.Series(out, dtype=object)


def _mip_bytes(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, places: pd.Series) -> pd.Series:
    out = []
    for x0, y0, wide, high, bits in zip(x, y, w, h, places, strict=True):
        data = bytearray((wide * high + 7) // 8)
        for p in bits:
            data[p >> 3] |= 1 << (p & 7)
        out.append(struct.pack(_MIP_HEAD, x0, y0, wide, high, len(data), 1, _MIP_LEVEL) + bytes(data))
    return pd.Series(out, dtype=object)


def _alpha_chunk(kind: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, size: pd.Series, parts: pd.Series) -> pd.Series:
    out = []
    for k, a, b, d, e, n, p in zip(kind, x0, y0, x1, y1, size, parts, strict=True):
        data = b"".join(map(bytes, p))
        out.append(struct.pack(_ALPHA_HEAD, a, b, d - a, e - b, len(data), n, 1, k) + data)
    return pd.Series(out, dtype=object)


def encode(pixels: DataFrame, width: int, height: int, bank: DataFrame | None = None, eight: Column | None = None) -> DataFrame:
    """Chunks (name, width, height, alpha, seq, tag, payload) of images (image_id, y, x, r, g, b and perhaps a) of one size.

    With alpha, tiles of 16 where none is seen are left out by a mask and the alpha is written as streams.alpha_plan says (in eight bits where
    the column eight is true). With a bank of point tables these take what gradients leave. Tiles, fits and symbols are spread over the
    cluster by image and tile, streams are compressed block by block; an image's compressed bytes meet in one row for each chunk, as in the file.
    Sizes without tiles give no chunk."""
    alpha = "a" in pixels.columns
    out, hidden = None, None
    if alpha:
        mask = checkpointed(streams.used_tiles(pixels))
        out, hidden = _alpha_chunks(pixels, mask, width, height, eight)
    tiles = checkpointed(gradient.cascade(pixels, RGB, width, height, taken=hidden))
    corners = checkpointed(gradient.corner_stream(tiles, pixels, RGB, width, height))
    place = streams.by_size(lambda tw, th: bitmap_position("ty", "tx", F.lit(width), tw, th), gradient.SIZES)
    placed = tiles.select("image_id", "pass", place.alias("pos"))
    byte = placed.groupBy("image_id", "pass", shr("pos", 3).cast("int").alias("byte")).agg(F.bit_or(shl(F.lit(1), (c("pos") % 8).cast("int"))).alias("v"))
    last = byte.groupBy("image_id", "pass").agg(F.max("byte").alias("n")).select("image_id", "pass", F.explode(F.sequence(F.lit(0), "n")).alias("byte"))
    whole = last.join(byte, ["image_id", "pass", "byte"], "left").na.fill(0, ["v"]).withColumnRenamed("byte", "at")
    digits = F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: F.lpad(F.hex(s["v"].cast("long")), 2, "0"))
    bitmap = whole.groupBy("image_id", "pass").agg(F.unhex(F.array_join(digits, "")).alias("bitmap"))
    stream = F.struct("image_id", "pass").alias("stream")
    number = F.row_number().over(Window.partitionBy("image_id", "pass").orderBy("pos", "side")) - 1
    colors = checkpointed(corners.select(F.to_json(stream).alias("stream"), "image_id", "pass", number.alias("n"), *[compress(k, RATE).cast("int").alias(k) for k in RGB]))
    names = colors.groupBy("stream", "image_id", "pass").agg(F.count("*").cast("int").alias("colors"))
    rgb = palette.encode(colors.select("stream", "n", *RGB)).join(names, "stream").select("image_id", "pass", "colors", F.col("data").alias("rgb"))
    sizes = F.element_at(F.array(*[F.lit(_size_code(tw, th)) for tw, th in gradient.SIZES]), c("pass") + 1)
    parts = bitmap.join(rgb, ["image_id", "pass"], "left").select("image_id", "pass", sizes.alias("size"), F.coalesce("colors", F.lit(0)).alias("colors"), "bitmap", F.coalesce("rgb", F.lit(b"")).alias("rgb"))
    first = parts.select("image_id", (F.col("pass") + 10).alias("at"), F.lit(GRADIENT).alias("tag"), _udf(_gradient_bytes, "binary")("size", F.lit(RATE), "colors", "bitmap", "rgb").alias("payload"))
    out = first if out is None else out.unionByName(first)

    taken = covered(tiles) if hidden is None else covered(tiles).unionByName(hidden.select("image_id", "y", "x")).distinct()
    if bank is not None:
        free = pixels.join(taken.select("image_id", "y", "x", F.lit(True).alias("_taken")), ["image_id", "y", "x"], "left")
        free = checkpointed(free.select("image_id", "y", "x", *RGB, F.col("_taken").isNull().alias("_free")))
        held = lut.cascade_entries(free, RGB, bank, F.col("_free"))
        packed = _packed(streams.table_streams(held, RGB, width, height), ["image_id", "stream"])
        listed = packed.groupBy("image_id").agg(F.collect_list(F.struct("stream", "size", "parts")).alias("parts"))
        out = out.unionByName(listed.select("image_id", F.lit(50).alias("at"), F.lit(TABLE).alias("tag"), _udf(_table_bytes, "binary")("parts").alias("payload")))
        left = free.where("_free").join(held.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti")
    else:
        left = pixels.join(taken.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti")

    planes = F.explode(F.array(*[F.struct(F.lit(k).alias("plane"), c(n).alias("value")) for k, n in enumerate(RGB)])).alias("p")
    long = left.select("image_id", "y", "x", planes).select(F.struct("image_id", "p.plane").alias("image_id"), "y", "x", "p.value")
    coded = checkpointed(quant1d.encode(long, "value").withColumn("tile", idiv("y", 8) * ((width + 7) // 8) + idiv("x", 8)))
    by_tile = coded.groupBy("image_id", "tile").agg(F.count("*").alias("n"), *[F.first(k).alias(k) for k in ("color0", "mn", "dl")])
    started = streams.offsets(by_tile, ["image_id"], "tile", "n").select("image_id", "tile", "before")
    within = F.row_number().over(Window.partitionBy("image_id", "tile").orderBy("y", "x")) - 1
    symbols = coded.withColumn("within", within).join(started, ["image_id", "tile"]).select("image_id", F.lit("symbols").alias("stream"), (F.col("before") + F.col("within")).alias("at"), F.col("sym").alias("v"))
    ends = F.posexplode(F.array("color0", "mn", "dl")).alias("k", "v")
    params = streams.offsets(by_tile, ["image_id"], "tile", F.lit(3)).select("image_id", "before", ends).select("image_id", F.lit("params").alias("stream"), (F.col("before") + F.col("k")).alias("at"), F.col("v").cast("int").alias("v"))
    both = _packed(symbols.unionByName(params), ["image_id", "stream"])
    one = lambda s, k: F.max(F.when(F.col("stream") == s, F.col(k)))
    rows = both.groupBy("image_id").agg(one("symbols", "size").alias("pixels"), one("symbols", "parts").alias("symbols"), one("params", "parts").alias("params"))
    made = _udf(_range_bytes, "binary")("image_id.plane", "pixels", "symbols", "params")
    out = out.unionByName(rows.select("image_id.image_id", (F.col("image_id.plane") + 100).alias("at"), F.lit(RANGE).alias("tag"), made.alias("payload")))
    return _named(out, width, height, alpha)


def _alpha_chunks(pixels: DataFrame, mask: DataFrame, width: int, height: int, eight: Column | None) -> tuple[DataFrame, DataFrame]:
    """The chunks (image_id, at, tag, payload) of masks and alpha, and the pixels (image_id, y, x) that the masks hide."""
    tiles = (width + 15) // 16 * ((height + 15) // 16)
    box = mask.groupBy("image_id").agg(F.min("mx").alias("x"), F.min("my").alias("y"), (F.max("mx") - F.min("mx") + 1).alias("w"), (F.max("my") - F.min("my") + 1).alias("h"), F.count("*").alias("n"))
    box = pixels.select("image_id").distinct().join(box, "image_id", "left").na.fill(0, ["x", "y", "w", "h", "n"]).where(F.col("n") < tiles)
    bits = mask.join(box.select("image_id", "x", "y", "w"), "image_id").groupBy("image_id").agg(F.collect_list(((F.col("my") - F.col("y")) * F.col("w") + F.col("mx") - F.col("x")).cast("int")).alias("places"))
    masks = box.join(bits, "image_id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    out = masks.select("image_id", F.lit(0).alias("at"), F.lit(MIP).alias("tag"), _udf(_mip_bytes, "binary")("x", "y", "w", "h", "places").alias("payload"))
    plan = checkpointed(streams.alpha_plan(pixels, mask, width, height, eight))
    packed = _packed(streams.alpha_bytes(streams.alpha_values(pixels, plan, mask)), ["image_id"], LEVELS_UP).join(plan, "image_id")
    chunk = _udf(_alpha_chunk, "binary")("kind", "x0", "y0", "x1", "y1", "size", "parts")
    out = out.unionByName(packed.select("image_id", F.lit(1).alias("at"), F.lit(ALPHA).alias("tag"), chunk.alias("payload")))
    marked = pixels.select("image_id", "y", "x", shr("y", 4).alias("my"), shr("x", 4).alias("mx"))
    return out, marked.join(mask, ["image_id", "my", "mx"], "left_anti").select("image_id", "y", "x")


def covered(tiles: DataFrame) -> DataFrame:
    """(image_id, y, x) of all tiles of a cascade."""
    parts = [gradient.covered(tiles.where(c("pass") == k), tw, th) for k, (tw, th) in enumerate(gradient.SIZES)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


_TILE = "array<struct<pos:int,tw:int,th:int>>"
_COLOR = "array<struct<n:int,r:int,g:int,b:int>>"


def _gradient_parts(payload: pd.Series) -> pd.DataFrame:
    rows = []
    for p in payload:
        p = bytes(p)
        size, _, _, m, r, n = struct.unpack_from(_HEAD, p)
        at = struct.calcsize(_HEAD)
        tw, th = 1 << (size & 7), 1 << (size >> 3)
        places = [{"pos": 8 * i + k, "tw": tw, "th": th} for i, b in enumerate(_unzip(p[at : at + m])) for k in range(8) if b >> k & 1]
        colors = palette.decode_bytes(_unzip(p[at + m : at + m + r]), n) if n else []
        rows.append((places, [{"n": i, "r": v[0], "g": v[1], "b": v[2]} for i, v in enumerate(colors)]))
    return pd.DataFrame(rows, columns=["tiles", "colors"])


def _range_parts(payload: pd.Series) -> pd.DataFrame:
    rows = []
    for p in payload:
        p = bytes(p)
        plane, _, s, q = struct.unpack_from(_RANGE_HEAD, p)
        at = struct.calcsize(_RANGE_HEAD)
        rows.append((plane, _unzip(p[at : at + s]), _unzip(p[at + s : at + s + q])))
    return pd.DataFrame(rows, columns=["plane", "symbols", "params"])


def _table_parts(payload: pd.Series) -> pd.DataFrame:
    """The twelve streams of a chunk of tables; ValueError where they are not as long as its head says."""
    rows = []
    for p in payload:
        p = bytes(p)
        head = struct.unpack_from(_TABLE_HEAD, p)
        at = struct.calcsize(_TABLE_HEAD)
        boxes, tiles, *entries = head[:6]
        sizes, packed = [*entries, 2 * tiles, boxes, *head[12:18]], [*head[8:12], head[6], head[7], *head[18:24]]
        found = []
        for n, k in zip(sizes, packed, strict=True):
            data = _unzip(p[at : at + k]) if k else b""
            if len(data) != n or boxes != 6 * tiles:
                raise ValueError("INVALID_TABLE_CHUNK: a stream is not as long as the chunk says")
            found.append(data)
            at += k
        rows.append((head[25], found))
    return pd.DataFrame(rows, columns=["rate", "streams"])


def _mask_parts(payload: pd.Series) -> pd.Series:
    out = []
    for p in payload:
        p = bytes(p)
        x, y, w, h, n, _, level = struct.unpack_from(_MIP_HEAD, p)
        data = p[struct.calcsize(_MIP_HEAD) :]
        if level != _MIP_LEVEL or n < (w * h + 7) // 8 or len(data) < n:
            raise ValueError("INVALID_MIPMAP_LEVEL: a mask of another size")
        out.append([{"my": y + i // w, "mx": x + i % w} for i in range(w * h) if data[i >> 3] >> (i & 7) & 1])
    return pd.Series(out, dtype=object)


def _alpha_parts(payload: pd.Series) -> pd.DataFrame:
    rows = []
    for p in payload:
        p = bytes(p)
        x, y, w, h, k, n, _, kind = struct.unpack_from(_ALPHA_HEAD, p)
        data = _unzip(p[struct.calcsize(_ALPHA_HEAD) :][:k])
        if kind not in (streams.ONE, streams.SIX - 1, streams.SIX, streams.SIX_ALL - 1, streams.SIX_ALL, streams.EIGHT) or len(data) != n:
            raise ValueError("INVALID_ALPHA_FORMAT: an alpha stream of another kind or size")
        rows.append((kind, x, y, x + w, y + h, data))
    return pd.DataFrame(rows, columns=["kind", "x0", "y0", "x1", "y1", "data"])



def _grid_blocks(names: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, by, bx): the blocks of 4 x 4 of images, from a row for each line of blocks."""
    lines = names.select("image_id", F.explode(F.sequence(F.lit(0), F.lit((height + 3) // 4 - 1))).alias("by")).repartition("image_id", "by")
    return lines.select("image_id", "by", F.explode(F.sequence(F.lit(0), F.lit((width + 3) // 4 - 1))).alias("bx"))


def _tile_blocks(tiles: DataFrame, *columns: str) -> DataFrame:
    """(image_id, by, bx, <columns>): the blocks of 4 x 4 that tiles (tw, th, ty, tx) hold."""
    down = F.explode(F.expr("sequence(0, th div 4 - 1)")).alias("j")
    across = F.explode(F.expr("sequence(0, tw div 4 - 1)")).alias("i")
    each = tiles.select("*", down).select("*", across)
    return each.select("image_id", (c("ty") * idiv("th", 4) + c("j")).cast("int").alias("by"), (c("tx") * idiv("tw", 4) + c("i")).cast("int").alias("bx"), *columns)


def _block_pixels(blocks: DataFrame, *columns: str) -> DataFrame:
    """(image_id, y, x, <columns>): the pixels of blocks of 4 x 4."""
    each = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return each.select("image_id", (c("by") * 4 + idiv("k", 4)).cast("int").alias("y"), (c("bx") * 4 + c("k") % 4).cast("int").alias("x"), *columns)


def _decoded_tables(keyed: DataFrame, used: DataFrame, factors: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Pixels (image_id, y, x, r, g, b) of chunks of tables, and the blocks that they hold (image_id, by, bx). Blocks in use already are left out:
    of a tile only the blocks that are free when its turn comes have entries in the file."""
    head = "rate int, streams array<binary>"
    read = checkpointed(keyed.where(c("tag") == TABLE).select("image_id", _udf(_table_parts, head)("payload").alias("s")).select("image_id", "s.*"))
    each = checkpointed(streams.bytes_of(read.select("image_id", "rate", F.posexplode("streams").alias("stream", "data")), ["image_id", "rate", "stream"], "data"))
    sizes = list(streams.MAPS)
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in sizes]), c("stream") - 5)
    bits = each.where("stream >= 6 and v > 0").select("image_id", (c("stream") - 6).alias("pass"), pick(0).alias("tw"), pick(1).alias("th"), "at", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    placed = bits.where(F.expr("shiftright(v, k) & 1 = 1")).select("image_id", "pass", "tw", "th", (c("at") * 8 + c("k")).alias("pos"))
    tiles = placed.select("*", streams.tile_of_place(width, sizes).alias("s")).select("image_id", "pass", "tw", "th", "s.*", (shl(c("pass").cast("long"), 40) + c("pos")).alias("place"))
    numbered = streams.offsets(tiles, ["image_id"], "place", F.lit(1), "n")
    word = each.where(c("stream") == streams.WORDS).groupBy("image_id", idiv("at", 2).alias("n")).agg(F.sum(F.when(c("at") % 2 == 1, c("v") * 256).otherwise(c("v"))).alias("word"))
    table, depth = lut_word_parts("word")
    word = word.select("image_id", "n", shr(table, 6).cast("int").alias("lut_id"), table.bitwiseAND(F.lit(63)).cast("int").alias("mode"), (depth + 3).cast("int").alias("depth"))
    ends = [f"{n}{k}" for k in (0, 1) for n in RGB]
    boxes = each.where(c("stream") == streams.BOXES).select("image_id", idiv("at", 6).alias("n"), (c("at") % 6).alias("k"), uncompress("v", "rate").cast("int").alias("v"))
    boxes = boxes.groupBy("image_id", "n").agg(*[F.max(F.when(c("k") == k, c("v"))).alias(e) for k, e in enumerate(ends)])
    known = checkpointed(numbered.join(streams.dealt(word), ["image_id", "n"]).join(streams.dealt(boxes), ["image_id", "n"]))
    owner = F.min_by(F.struct("place", "tw", "tx"), "place").alias("o")
    held = checkpointed(_tile_blocks(known, "place", "tw", "tx").join(streams.dealt(used), ["image_id", "by", "bx"], "left_anti").groupBy("image_id", "by", "bx").agg(owner).select("image_id", "by", "bx", "o.*"))
    sizes_of = held.groupBy("image_id", "place").agg((F.count("*") * 16).alias("pixels"))
    started = streams.offsets(known.join(streams.dealt(sizes_of), ["image_id", "place"], "left").na.fill(0, ["pixels"]), ["image_id", "depth"], "place", "pixels")
    pixels = _block_pixels(held, "place", "tw", "tx")
    within = F.row_number().over(Window.partitionBy("image_id", "place").orderBy(idiv(c("x") - c("tx") * c("tw"), 8), "y", "x")) - 1
    wanted = pixels.withColumn("within", within).drop("tw", "tx").join(streams.dealt(started.select("image_id", "place", "before", "lut_id", "mode", "depth", *ends)), ["image_id", "place"])
    wanted = wanted.withColumn("at", c("before") + c("within")).withColumn("stream", c("depth") - 3)
    entry = wanted.join(streams.dealt(each.where("stream < 4").drop("rate")), ["image_id", "stream", "at"]).withColumn("idx", idiv("v", 3).cast("int"))
    colors = lut.entry_colors(entry.join(F.broadcast(factors), ["lut_id", "depth", "idx"]), RGB, ["image_id", "y", "x"])
    return colors, held.select("image_id", "by", "bx")


def _decoded_alpha(keyed: DataFrame, mask: DataFrame) -> DataFrame:
    """(image_id, y, mx, left, run): the alpha inside the boxes of alpha chunks, an array for each line of each tile of the mask, from column left on.

    Such a run lies in one piece of its stream, so runs are joined to pieces, and no byte or pixel is joined by itself. Beyond a stream's end bytes are 0."""
    kind = "kind int, x0 int, y0 int, x1 int, y1 int, data binary"
    read = checkpointed(keyed.where(c("tag") == ALPHA).select("image_id", _udf(_alpha_parts, kind)("payload").alias("s")).select("image_id", "s.*"))
    lines = read.drop("data").select("*", F.explode(F.expr("if(y1 > y0, sequence(y0, y1 - 1), array())")).alias("y")).repartition("image_id", "y")
    across = F.explode(F.expr("if(x1 > x0, sequence(shiftright(x0, 4), shiftright(x1 - 1, 4)), array())")).alias("mx")
    runs = lines.select("image_id", "kind", "x0", "x1", "y", across).withColumn("left", F.greatest("x0", c("mx") * 16)).withColumn("n", F.least("x1", c("mx") * 16 + 16) - c("left"))
    marked = runs.withColumn("my", shr("y", 4)).join(streams.dealt(mask.withColumn("_used", F.lit(True))), ["image_id", "my", "mx"], "left")
    kept = marked.where(~c("kind").isin(streams.SIX, streams.SIX - 1) | F.col("_used")).select("image_id", "kind", "y", "mx", "left", "n")
    rows = streams.offsets(kept.groupBy("image_id", "y").agg(F.sum("n").alias("n")), ["image_id"], "y", "n").select("image_id", "y", "before")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("image_id", "y").orderBy("mx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bits = F.when(c("kind") == streams.ONE, 1).when(c("kind") == streams.EIGHT, 8).otherwise(6)
    placed = kept.withColumn("within", within).join(streams.dealt(rows), ["image_id", "y"]).withColumn("start", (c("before") + c("within")) * bits).withColumn("piece", idiv("start", 8 * _PIECE))
    cut = F.transform(F.expr(f"sequence(0L, (length(data) - 1) div {_PIECE})"), lambda k: F.substring("data", (k * _PIECE + 1).cast("int"), F.lit(_PIECE + _OVER)))
    pieces = read.where(F.length("data") > 0).select("image_id", F.posexplode(cut).alias("piece", "data"))
    both = placed.join(streams.dealt(pieces.withColumn("piece", c("piece").cast("long"))), ["image_id", "piece"], "left")
    byte = lambda k: F.coalesce(F.conv(F.hex(F.substring("data", (k + 1).cast("int"), F.lit(1))), 16, 10).cast("long"), F.lit(0))

    def value(k: Column) -> Column:
        start = c("start") - c("piece") * (8 * _PIECE) + k * bits
        at = idiv(start, 8)
        raw = F.call_function("shiftright", byte(at) + byte(at + 1) * 256, (start % 8).cast("int"))
        low6 = raw.bitwiseAND(F.lit(63))
        six = F.when(c("kind").isin(streams.SIX - 1, streams.SIX_ALL - 1), low6).otherwise(F.lit(63) - low6)  # as it is, or what is missing to 63
        return F.when(c("kind") == streams.ONE, raw.bitwiseAND(F.lit(1)) * 255).when(c("kind") == streams.EIGHT, raw.bitwiseAND(F.lit(255))).otherwise(shl(six, 2).bitwiseOR(shr(six, 4))).cast("int")

    return both.select("image_id", "y", "mx", "left", F.transform(F.sequence(F.lit(0), (c("n") - 1).cast("int")), value).alias("run"))


def decode(chunks: DataFrame, width: int, height: int, factors: DataFrame | None = None) -> DataFrame:
    """(name, y, x, r, g, b, a) from the chunks of encode, as a decoder gives them: a fold over the chunks in the order of the file, in which the
    blocks of 4 x 4 that a chunk has filled are in use for those after it.

    Corners of 6 bits and boxes are scaled back from their rate and blended with cut results; entries look their colours up in factors
    (lut_id, depth, idx, fx, fy, fz), which files with tables need; symbols go through the reciprocal. a is null in files without alpha, 255
    in those with the flag and no alpha chunk, 0 beyond the chunk's box. Pixels that the mask hides are 0 in all channels."""
    keyed = chunks.select(F.col("name").alias("image_id"), "alpha", "seq", "tag", "payload")
    read = checkpointed(keyed.where(c("tag") == GRADIENT).select("image_id", "seq", _udf(_gradient_parts, f"struct<tiles:{_TILE},colors:{_COLOR}>")("payload").alias("s")))
    tiles = read.select("image_id", F.col("seq").alias("pass"), F.explode("s.tiles").alias("t")).select("image_id", "pass", "t.*")
    tiles = checkpointed(tiles.select("*", streams.tile_of_place(width, gradient.SIZES).alias("s")).select("image_id", "pass", "pos", "tw", "th", "s.*"))
    # which corner each colour is: those not seen before, in the order they were written
    sides = F.explode(F.array(*[F.struct(F.lit(2 * j + i).alias("side"), F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)]))
    spread = tiles.select("image_id", "pass", "pos", "ty", "tx", "tw", "th", sides.alias("s"))
    spread = spread.select("image_id", "pass", "pos", F.col("s.side").alias("side"), ((c("ty") + F.col("s.j")) * c("th")).alias("cy"), ((c("tx") + F.col("s.i")) * c("tw")).alias("cx"))
    first = Window.partitionBy("image_id", "cy", "cx").orderBy("pass", "pos", "side")
    once = spread.withColumn("k", F.row_number().over(first)).where("k = 1")
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("image_id", "pass").orderBy("pos", "side")) - 1)
    colors = read.select("image_id", F.col("seq").alias("pass"), F.explode("s.colors").alias("q")).select("image_id", "pass", "q.*")
    corners = once.join(streams.dealt(colors), ["image_id", "pass", "n"]).select("image_id", "cy", "cx", *[uncompress(k, RATE).cast("int").alias(k) for k in RGB])
    smooth = gradient.decode(tiles, streams.dealt(checkpointed(corners)), RGB).select("image_id", c("y").cast("int").alias("y"), c("x").cast("int").alias("x"), *RGB)

    names = checkpointed(_files(keyed))  # a row for each file
    grid = _grid_blocks(names, width, height)
    masked = _masks(keyed)
    mask = masked.select("image_id", F.explode("s").alias("s")).select("image_id", "s.*")
    quarter = grid.withColumn("my", shr("by", 2)).withColumn("mx", shr("bx", 2))
    hidden = quarter.join(F.broadcast(masked.select("image_id")), "image_id", "left_semi").join(streams.dealt(mask), ["image_id", "my", "mx"], "left_anti").select("image_id", "by", "bx")
    used = checkpointed(_tile_blocks(tiles).distinct().unionByName(hidden))
    out = smooth.unionByName(_block_pixels(hidden).select("image_id", "y", "x", *[F.lit(0).alias(k) for k in RGB]))
    if factors is not None:
        table, held = _decoded_tables(keyed, used, factors, width)
        out, used = out.unionByName(table), checkpointed(used.unionByName(held))
    elif not keyed.where(c("tag") == TABLE).isEmpty():
        raise ValueError("INVALID_LUT: the files hold tiles of point tables and none are assigned")

    left = grid.join(streams.dealt(used), ["image_id", "by", "bx"], "left_anti").withColumn("tile", idiv("by", 2) * ((width + 7) // 8) + idiv("bx", 2))
    by_tile = left.groupBy("image_id", "tile").agg((F.count("*") * 16).alias("n"))
    numbers = streams.offsets(streams.offsets(by_tile, ["image_id"], "tile", "n"), ["image_id"], "tile", F.lit(1), "t")
    within = F.row_number().over(Window.partitionBy("image_id", "tile").orderBy("y", "x")) - 1
    placed = _block_pixels(left, "tile").withColumn("within", within).join(streams.dealt(numbers), ["image_id", "tile"]).select("image_id", "y", "x", "t", (c("before") + c("within")).alias("at"))
    coded = checkpointed(keyed.where(c("tag") == RANGE).select("image_id", _udf(_range_parts, "struct<plane:int,symbols:binary,params:binary>")("payload").alias("s")).select("image_id", "s.*"))
    symbols = streams.bytes_of(coded, ["image_id", "plane"], "symbols").withColumnRenamed("v", "sym")
    raw = streams.bytes_of(coded, ["image_id", "plane"], "params")
    params = raw.groupBy("image_id", "plane", idiv("at", 3).alias("t")).agg(*[F.max(F.when(c("at") % 3 == j, c("v"))).alias(n) for j, n in enumerate(("color0", "mn", "dl"))])
    both = placed.join(streams.dealt(symbols), ["image_id", "at"]).join(streams.dealt(params), ["image_id", "plane", "t"])
    values = quant1d.decode(both.withColumn("image_id", F.struct("image_id", "plane")))
    rest = values.groupBy(F.col("image_id.image_id").alias("image_id"), "y", "x").agg(*[F.max(F.when(c("image_id.plane") == k, c("v"))).alias(n) for k, n in enumerate(RGB)])
    out = out.unionByName(rest)

    whole = out.join(F.broadcast(names), "image_id")
    return _with_alpha(whole, keyed, mask).select(F.col("image_id").alias("name"), "y", "x", *RGB, "a")


def _files(keyed: DataFrame) -> DataFrame:
    """(image_id, alpha, clear): a row for each file; clear: it has an alpha chunk."""
    return keyed.groupBy("image_id", "alpha").agg(F.max(c("tag") == ALPHA).alias("clear"))


def _alpha_of() -> Column:
    """a of pixels (alpha, clear, x, left, run): null in files without alpha, 255 where no chunk has it, 0 beyond the chunk's box."""
    a = F.when(~F.col("alpha"), F.lit(None).cast("int")).when(F.col("clear"), F.coalesce(F.get("run", c("x") - F.col("left")), F.lit(0))).otherwise(255)
    return a.cast("int").alias("a")


def _with_alpha(pixels: DataFrame, keyed: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, alpha, clear, ...) with a."""
    if keyed.where(c("tag") == ALPHA).isEmpty():
        return pixels.withColumn("a", F.when(F.col("alpha"), 255))
    runs = streams.dealt(_decoded_alpha(keyed, mask))
    return pixels.withColumn("mx", shr("x", 4)).join(runs, ["image_id", "y", "mx"], "left").select(*pixels.columns, _alpha_of())


def encode_alpha(pixels: DataFrame, width: int, height: int, eight: Column | None = None) -> DataFrame:
    """The chunks of masks and alpha alone, of images (image_id, y, x, a)."""
    out, _ = _alpha_chunks(pixels, checkpointed(streams.used_tiles(pixels)), width, height, eight)
    return _named(out, width, height, True)


def _named(out: DataFrame, width: int, height: int, alpha: bool) -> DataFrame:
    """Chunks as the sink takes them, numbered in the order of the file."""
    seq = F.row_number().over(Window.partitionBy("image_id").orderBy("at")) - 1
    return out.select(F.concat(F.lit("image-"), F.col("image_id").cast("string")).alias("name"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(alpha).alias("alpha"), seq.cast("int").alias("seq"), "tag", "payload")


def decode_alpha(chunks: DataFrame, width: int, height: int) -> DataFrame:
    """(name, y, x, a) of files, from their masks and alpha alone."""
    keyed = chunks.select(F.col("name").alias("image_id"), "alpha", "seq", "tag", "payload")
    wide, high = (width + 3) // 4 * 4, (height + 3) // 4 * 4
    mask = _masks(keyed).select("image_id", F.explode("s").alias("s")).select("image_id", "s.*")
    lines = _files(keyed).select("*", F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("y")).repartition("image_id", "y")
    tiles = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit((wide - 1) >> _MIP_LEVEL))).alias("mx"))
    seen = tiles.join(streams.dealt(_decoded_alpha(keyed, mask)), ["image_id", "y", "mx"], "left")
    columns = F.explode(F.sequence(c("mx") * 16, F.least(c("mx") * 16 + 15, F.lit(wide - 1)))).alias("x")
    return seen.select("*", columns).select(F.col("image_id").alias("name"), "y", "x", _alpha_of())


def _masks(keyed: DataFrame) -> DataFrame:
    """(image_id, s): the used tiles of each file that has a mask."""
    spots = "array<struct<my:int,mx:int>>"
    return checkpointed(keyed.where(c("tag") == MIP).select("image_id", _udf(_mask_parts, spots)("payload").alias("s")))
