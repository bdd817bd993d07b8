"""Byte streams that are written in parallel: places by prefix sums in two levels, blocks that are gathered and compressed by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.scalar import BIG_TILE, bitmap_bytes, bitmap_position, by, c, compress, idiv, lut_word, shl, shr

#: Bytes of a stream that are gathered in one row; rows of a prefix sum in one group.
BLOCK, SPAN = 1 << 15, 4096
#: Corner colours and colour boxes are scaled from 0..255 to 0..RATE on the way to the file.
RATE = 250
#: The twelve streams of a chunk of tables in the order of the file: entries of 3 to 6 bits, tile words, colour boxes, bitmaps of the six sizes.
ENTRIES, WORDS, BOXES, MAPS = {3: 0, 4: 1, 5: 2, 6: 3}, 4, 5, {(16, 8): 6, (8, 16): 7, (8, 8): 8, (8, 4): 9, (4, 8): 10, (4, 4): 11}


def dealt(frame: DataFrame) -> DataFrame:
    """frame, to be joined by a shuffle. What is unpacked from files counts as large as their compressed bytes, so whole streams would be gathered by the
    driver and sent to all."""
    return frame.hint("merge")


def offsets(rows: DataFrame, keys: list[str], place: str, size: Column | str, name: str = "before") -> DataFrame:
    """rows with a column more: the sum of size over the rows of the same keys whose place is less.

    Places are whole numbers, one of each. Runs of SPAN places are summed up first, so that no window holds more rows of a key than a run or
    than there are runs."""
    marked = rows.withColumn("_run", idiv(place, SPAN)).withColumn("_size", c(size).cast("long"))
    sums = marked.groupBy(*keys, "_run").agg(F.sum("_size").alias("_sum"))
    ahead = lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*keys, "_run", ahead("_sum", Window.partitionBy(*keys).orderBy("_run")).alias("_start"))
    inner = marked.withColumn("_in", ahead("_size", Window.partitionBy(*keys, "_run").orderBy(place)))
    return inner.join(dealt(starts), [*keys, "_run"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_run", "_size", "_start", "_in")


def blocks(values: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, block, size, data): the bytes of streams (keys, at, v), block by block; at counts from 0."""
    digits = F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: F.lpad(F.hex(s["v"].cast("long")), 2, "0"))
    return values.groupBy(*keys, idiv("at", block).alias("block")).agg(F.count("*").alias("size"), F.unhex(F.array_join(digits, "")).alias("data"))


def bytes_of(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, at, v): the bytes of a binary column."""
    each = frame.where(F.length(column) > 0).select(*keys, F.posexplode(F.split(F.regexp_replace(F.hex(column), "(..)(?!$)", "$1,"), ",")).alias("at", "h"))
    return each.select(*keys, "at", F.conv("h", 16, 10).cast("int").alias("v"))


def by_size(make, sizes) -> Column:
    """make(tw, th) of the row's tile size."""
    out = None
    for tw, th in sizes:
        mine = (c("tw") == tw) & (c("th") == th)
        out = F.when(mine, make(tw, th)) if out is None else out.when(mine, make(tw, th))
    return out


def tile_of_place(width: int, sizes) -> Column:
    """struct(ty, tx) of a bitmap's place (pos) for tiles of the row's size: what bitmap_position goes back to."""

    def back(tw: int, th: int) -> Column:
        lx, ly = BIG_TILE[tw, th]
        across, down = (1 << lx) // tw, (1 << ly) // th
        big_row = -(-width // (1 << lx))
        big, inner = idiv("pos", across * down), c("pos") % (across * down)
        return F.struct((idiv(big, big_row) * down + idiv(inner, across)).cast("int").alias("ty"), (big % big_row * across + inner % across).cast("int").alias("tx"))

    return by_size(back, sizes)


def table_streams(taken: DataFrame, channels: list[str], width: int, height: int) -> DataFrame:
    """(stream, at, v) of a chunk of tables from the pixels that tables took (pass, tw, th, ty, tx, y, x, lut_id, mode, depth, idx, <channel>0/1 ...).

    Tiles go in the order of passes and bitmap places; a tile's pixels in columns of eight, rows, columns. Entries are written three
    times as large, as decoders index colours that lie interleaved; a word is the mode, the table and the depth; boxes are cut to RATE."""
    keys, sizes = by(taken), list(MAPS)
    pos = by_size(lambda tw, th: bitmap_position("ty", "tx", F.lit(width), tw, th), sizes)
    placed = taken.withColumn("pos", pos).withColumn("place", shl(F.col("pass").cast("long"), 40) + F.col("pos"))
    tile = ["pass", "tw", "th", "pos", "place", "lut_id", "mode", "depth"]
    boxes = [f"{n}{k}" for k in (0, 1) for n in channels]
    tiles = placed.groupBy(*keys, *tile).agg(F.count("*").alias("pixels"), *[F.first(b).alias(b) for b in boxes])
    started = offsets(tiles, [*keys, "depth"], "place", "pixels").select(*keys, "place", "before")
    within = F.row_number().over(Window.partitionBy(*keys, "place").orderBy(idiv(c("x") - c("tx") * c("tw"), 8), "y", "x")) - 1
    each = placed.withColumn("within", within).join(started, [*keys, "place"])
    entries = each.select(*keys, (F.col("depth") - 3).alias("stream"), (F.col("before") + F.col("within")).alias("at"), (F.col("idx") * 3).cast("int").alias("v"))

    numbered = offsets(tiles, keys, "place", F.lit(1), "n")
    word = lut_word("mode", "lut_id", F.col("depth") - 3)
    halves = F.posexplode(F.array(word.bitwiseAND(F.lit(255)), shr(word, 8))).alias("k", "v")
    words = numbered.select(*keys, "n", halves).select(*keys, F.lit(WORDS).alias("stream"), (F.col("n") * 2 + F.col("k")).alias("at"), F.col("v").cast("int").alias("v"))
    ends = F.posexplode(F.array(*[compress(b, RATE).cast("int") for b in boxes])).alias("k", "v")
    colors = numbered.select(*keys, "n", ends).select(*keys, F.lit(BOXES).alias("stream"), (F.col("n") * len(boxes) + F.col("k")).alias("at"), "v")

    number = by_size(lambda tw, th: F.lit(MAPS[tw, th]), sizes)
    bit = tiles.groupBy(*keys, number.alias("stream"), shr("pos", 3).alias("at")).agg(F.bit_or(shl(F.lit(1), (F.col("pos") % 8).cast("int"))).alias("v"))
    full = tiles.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.struct(F.lit(MAPS[s]).alias("stream"), bitmap_bytes(F.lit(width), F.lit(height), *s).alias("size")) for s in sizes])).alias("m"))
    every = full.select(*keys, "m.*").select(*keys, "stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("at"))
    maps = every.join(bit, [*keys, "stream", "at"], "left").select(*keys, "stream", "at", F.coalesce("v", F.lit(0)).cast("int").alias("v"))
    return entries.unionByName(words).unionByName(colors).unionByName(maps)


def alpha_plan(pixels: DataFrame, mask: DataFrame, width: int, height: int, eight: Column | None = None) -> DataFrame:
    """(image_id, kind, x0, y0, x1, y1): how the alpha (a) of each image is written; images that need none have no row.

    The box holds all pixels that are not 0 in 6 bits, its sides at steps of four columns. Where the box has nothing but 0 and 255, both of
    them, a bit does (ONE, sides at steps of eight); where all are equal, nothing is written; else six bits of what the mask (image_id, my, mx: tiles of
    16 that are used) leaves, SIX_ALL where it leaves all, or eight bits of the whole box where the image asks for eight."""
    seen = pixels.where(shr("a", 2) != 0).groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    box = seen.select("image_id", (shr("x0", 2) * 4).cast("int").alias("x0"), "y0", (shr(F.col("x1") + 4, 2) * 4).cast("int").alias("x1"), (F.col("y1") + 1).alias("y1"))
    inside = pixels.join(box, "image_id").where((c("x") >= F.col("x0")) & (c("x") < F.col("x1")) & (c("y") >= F.col("y0")) & (c("y") < F.col("y1")))
    want8 = F.lit(False) if eight is None else F.max(eight)
    kinds = inside.groupBy("image_id", "x0", "y0", "x1", "y1").agg(F.max(c("a").between(1, 254)).alias("analog"), F.max(c("a") == 0).alias("none"), F.max(c("a") == 255).alias("full"), want8.alias("eight"))
    tiles = F.lit((width + 15) // 16 * ((height + 15) // 16))
    used = mask.groupBy("image_id").agg((F.count("*") == tiles).alias("all"))
    six = F.when(F.coalesce("all", F.lit(False)), F.lit(SIX_ALL)).otherwise(F.lit(SIX))
    kind = F.when(F.col("analog"), F.when(F.col("eight"), EIGHT).otherwise(six)).when(F.col("none") & F.col("full"), ONE)
    out = kinds.join(used, "image_id", "left").withColumn("kind", kind).where("kind is not null")
    eights = lambda k, up: F.when(F.col("kind") == ONE, (shr(F.col(k) + up, 3) * 8).cast("int")).otherwise(F.col(k)).alias(k)
    return out.select("image_id", "kind", eights("x0", 0), "y0", eights("x1", 7), "y1")


#: How an alpha chunk is packed. Six bits are written as what is missing to 63.
ONE, SIX, SIX_ALL, EIGHT = 1, 3, 5, 6


def alpha_values(pixels: DataFrame, plan: DataFrame, mask: DataFrame) -> DataFrame:
    """(image_id, kind, pos, v): the values of each image's alpha stream: 0 or 1, 63 less six bits, or eight bits, in rows of the box; of SIX only where the
    mask is used."""
    inside = pixels.select("image_id", "y", "x", "a").join(plan, "image_id").where((c("x") >= F.col("x0")) & (c("x") < F.col("x1")) & (c("y") >= F.col("y0")) & (c("y") < F.col("y1")))
    marked = inside.withColumn("my", shr("y", 4)).withColumn("mx", shr("x", 4)).join(mask.withColumn("_used", F.lit(True)), ["image_id", "my", "mx"], "left")
    kept = marked.where((F.col("kind") != SIX) | F.col("_used"))
    value = F.when(F.col("kind") == ONE, c("a").bitwiseAND(F.lit(1))).when(F.col("kind") == EIGHT, c("a")).otherwise(F.lit(63) - shr("a", 2))
    rows = offsets(kept.groupBy("image_id", "y").agg(F.count("*").alias("n")), ["image_id"], "y", "n").select("image_id", "y", "before")
    within = F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x")) - 1
    placed = kept.withColumn("within", within).join(rows, ["image_id", "y"])
    return placed.select("image_id", "kind", (F.col("before") + F.col("within")).alias("pos"), value.cast("int").alias("v"))


def alpha_bytes(values: DataFrame) -> DataFrame:
    """(image_id, at, v): values packed by their kind, least bits first."""
    bits = F.when(F.col("kind") == ONE, 1).when(F.col("kind") == EIGHT, 8).otherwise(6)
    start = F.col("pos") * bits
    inner = (start % 8).cast("int")
    whole = F.call_function("shiftleft", F.col("v").cast("long"), inner)
    low = F.struct(idiv(start, 8).alias("at"), whole.bitwiseAND(F.lit(255).cast("long")).alias("b"))
    high = F.when(inner + bits > 8, F.struct((idiv(start, 8) + 1).alias("at"), shr(whole, 8).alias("b")))
    parts = values.select("image_id", F.explode(F.filter(F.array(low, high), lambda s: s.isNotNull())).alias("p"))
    return parts.groupBy("image_id", F.col("p.at").alias("at")).agg(F.bit_or("p.b").cast("int").alias("v"))


def used_tiles(pixels: DataFrame) -> DataFrame:
    """(image_id, my, mx): the tiles of 16 x 16 with alpha that is not 0 in six bits."""
    return pixels.where(shr("a", 2) != 0).select("image_id", shr("y", 4).alias("my"), shr("x", 4).alias("mx")).distinct()
