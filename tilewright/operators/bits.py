"""Bit, nibble and 6-bit streams: from rows of (stream, pos, v) to bytes and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import by, c, idiv, shl, shr


def pack(values: DataFrame, keys: list[str], bits: int, value: str = "v", pos: str = "pos") -> DataFrame:
    """(keys, byte, v): each byte of a little-endian stream of values of 1, 4 or 6 bits, numbered by pos from 0.

    A value of 6 bits may lie in two bytes; each byte is an or over the values that reach it."""
    start = c(pos).cast("long") * bits
    inside = (start % 8).cast("int")
    whole = shl(c(value).bitwiseAND(F.lit((1 << bits) - 1)).cast("long"), inside)
    low = F.struct(idiv(start, 8).alias("byte"), whole.bitwiseAND(F.lit(255).cast("long")).alias("v"))
    high = F.when(inside + bits > 8, F.struct((idiv(start, 8) + 1).alias("byte"), shr(whole, 8).alias("v")))
    parts = F.array(low, high) if 8 % bits else F.array(low)
    spread = values.select(*keys, F.explode(F.filter(parts, lambda s: s.isNotNull())).alias("_part"))
    return spread.groupBy(*keys, F.col("_part.byte").cast("int").alias("byte")).agg(F.bit_or("_part.v").cast("int").alias("v"))


def to_binary(packed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data): the bytes of each stream in order. A stream is gathered whole: streams are of tiles or lines."""
    digits = F.transform(F.sort_array(F.collect_list(F.struct("byte", "v"))), lambda s: F.lpad(F.hex(s["v"].cast("long")), 2, "0"))
    return packed.groupBy(*keys).agg(F.unhex(F.array_join(digits, "")).alias("data"))


def unpack(streams: DataFrame, keys: list[str], bits: int, data: str = "data") -> DataFrame:
    """(keys, pos, v) of every value in the streams, with what the last byte has left over."""
    n = idiv(F.length(c(data)) * 8, bits)
    byte = lambda i: F.conv(F.hex(F.substring(c(data), (i + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    each = streams.where(F.length(data) > 0).select(*keys, data, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("pos"))
    start = c("pos") * bits
    here = idiv(start, 8)
    both = byte(here) + F.when(here + 1 < F.length(data), shl(byte(here + 1), 8)).otherwise(0)
    return each.select(*keys, "pos", shr(both, (start % 8).cast("int")).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int").alias("v"))


def expand6(v) -> Column:
    """6 bits to 8, with the high bits again below."""
    return shl(c(v), 2).bitwiseOR(shr(c(v), 4))


def tile_bitmap(places: DataFrame, place: str = "pos") -> DataFrame:
    """(byte, v): a bit for each place."""
    return places.groupBy(*by(places), shr(place, 3).cast("int").alias("byte")).agg(F.bit_or(shl(F.lit(1), (c(place) % 8).cast("int"))).alias("v"))


def popcount(bitmap: DataFrame) -> DataFrame:
    """One row (tiles): the bits of whole words of four bytes."""
    words = bitmap.agg((idiv(F.max("byte") + 1, 4) * 4).alias("whole"))
    return bitmap.crossJoin(F.broadcast(words)).where("byte < whole").agg(F.coalesce(F.sum(F.bit_count("v")), F.lit(0)).cast("long").alias("tiles"))


def mip_bits(pixels: DataFrame, value: str, log_size: int = 4) -> DataFrame:
    """(ty, tx, used): whether a tile of 2**log_size pixels has any that is not zero."""
    n = 1 << log_size
    return pixels.groupBy(*by(pixels), idiv("y", n).cast("int").alias("ty"), idiv("x", n).cast("int").alias("tx")).agg(F.some(c(value) != 0).cast("int").alias("used"))


def mip_mask(tiles: DataFrame, log_size: int = 4) -> DataFrame:
    """(y, x, m): 255 on the pixels of used tiles, 0 elsewhere."""
    n = 1 << log_size
    rows = tiles.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select(*by(tiles), (c("ty") * n + c("dy")).alias("y"), (c("tx") * n + c("dx")).alias("x"), F.when(c("used") != 0, 255).otherwise(0).alias("m"))


def alpha_plane(values: DataFrame, box: tuple[int, int, int, int], canvas: DataFrame) -> DataFrame:
    """(y, x, v) over the canvas: values (pos, v) in rows of the box (x, y, w, h), 0 outside."""
    x0, y0, w, _ = box
    placed = values.select((idiv("pos", w) + y0).cast("int").alias("y"), (c("pos") % w + x0).cast("int").alias("x"), "v")
    return canvas.join(placed, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0)).alias("v"))
