"""Aggregates of masks, tiles and whole planes; per image where pixels have an image_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilewright.functions.scalar import by, c, idiv, shl


def tile(th: int, tw: int) -> list[Column]:
    return [idiv("y", th).cast("int").alias("ty"), idiv("x", tw).cast("int").alias("tx")]


def bounding_box(pixels: DataFrame, value: str) -> DataFrame:
    """(cnt, x, y, w, h) of the pixels that are not zero; all zero where there are none."""
    found = pixels.where(c(value) != 0).groupBy(*by(pixels)).agg(F.count("*").alias("cnt"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    zero = lambda e: F.coalesce(e, F.lit(0)).cast("int")
    return found.select(*by(pixels), "cnt", zero(F.col("x0")).alias("x"), zero(F.col("y0")).alias("y"), zero(F.col("x1") - F.col("x0") + 1).alias("w"), zero(F.col("y1") - F.col("y0") + 1).alias("h"))


def tile_range(pixels: DataFrame, value: str, valid: Column, th: int, tw: int) -> DataFrame:
    """(ty, tx, mn, mx, uniq) of the valid pixels of each tile; 0, 0, 0 where there are none."""
    v = F.when(valid, c(value))
    return pixels.groupBy(*by(pixels), *tile(th, tw)).agg(
        F.coalesce(F.min(v), F.lit(0)).alias("mn"), F.coalesce(F.max(v), F.lit(0)).alias("mx"), F.count_distinct(v).alias("uniq")
    )


def color_histogram(pixels: DataFrame, keep: Column | None = None) -> DataFrame:
    """(color, cnt) of the 24-bit colours of the pixels kept."""
    byte = lambda n: c(n).bitwiseAND(F.lit(255))
    kept = pixels if keep is None else pixels.where(keep)
    return kept.groupBy(*by(pixels), shl(byte("r"), 16).bitwiseOR(shl(byte("g"), 8)).bitwiseOR(byte("b")).alias("color")).agg(F.count("*").alias("cnt"))


def color_box(pixels: DataFrame, channels: list[str], free: Column, th: int, tw: int) -> DataFrame:
    """(ty, tx, <channel>0, <channel>1 ..., cnt, whole) of the free pixels of each tile; -1 where none is free.

    whole: the tile lies wholly inside the image."""
    ends = [f(F.when(free, c(n))) for n in channels for f in (F.min, F.max)]
    names = [f"{n}{k}" for n in channels for k in (0, 1)]
    return pixels.groupBy(*by(pixels), *tile(th, tw)).agg(
        *[F.coalesce(e, F.lit(-1)).cast("int").alias(n) for e, n in zip(ends, names, strict=True)],
        F.count_if(free).alias("cnt"), (F.count("*") == th * tw).alias("whole"),
    )


def tile_histogram(pixels: DataFrame, value: str, th: int, tw: int) -> DataFrame:
    return pixels.groupBy(*by(pixels), *tile(th, tw), c(value).alias("v")).agg(F.count("*").alias("cnt"))


def frequent_color(histogram: DataFrame) -> DataFrame:
    """(ty, tx, color0): the value with the highest count, of equals the larger, within 1..254."""
    top = F.max_by("v", F.struct("cnt", "v"))
    return histogram.groupBy(*by(histogram), "ty", "tx").agg(F.greatest(F.lit(1), F.least(F.lit(254), top)).cast("int").alias("color0"))


def remaining_range(histogram: DataFrame, colors: DataFrame) -> DataFrame:
    """(ty, tx, color0, mn, dl): least value and spread of what lies more than 1 away from color0; 0, 0 where nothing does."""
    rest = F.when(F.abs(F.col("v") - F.col("color0")) > 1, F.col("v"))
    keys = [*by(histogram), "ty", "tx"]
    return histogram.join(colors, keys).groupBy(*keys, "color0").agg(
        F.coalesce(F.min(rest), F.lit(0)).cast("int").alias("mn"), F.coalesce(F.max(rest) - F.min(rest), F.lit(0)).cast("int").alias("dl")
    )


def color_class(pixels: DataFrame, th: int, tw: int) -> DataFrame:
    """(ty, tx, colors, class): distinct colours of 6 bits a channel, in the classes 1, 2-4, 5-8, 9-11, 12-15 and more."""
    six = F.struct(*[F.shiftright(n, 2) for n in "rgb"])
    n = F.col("colors")
    kind = F.when(n <= 1, 0).when(n <= 4, 1).when(n <= 8, 2).when(n <= 11, 3).when(n <= 15, 4).otherwise(5)
    return pixels.groupBy(*by(pixels), *tile(th, tw)).agg(F.count_distinct(six).alias("colors")).select(*by(pixels), "ty", "tx", "colors", kind.alias("class"))


def alpha_kind(pixels: DataFrame, alpha: str) -> DataFrame:
    """One row (none, full, analog, x, y, w, h): whether all is 0, all 255, or something between; the box of v >> 2, to steps of 4 (8 where binary)."""
    a = c(alpha)
    six = F.shiftright(a, 2) != 0
    got = pixels.groupBy(*by(pixels)).agg(
        F.every(a == 0).alias("none"), F.every(a == 255).alias("full"), F.some((a > 0) & (a < 255)).alias("analog"),
        *[f(F.when(six, c(k))).alias(f"{k}{n}") for k in "xy" for n, f in ((0, F.min), (1, F.max))],
    )
    step = F.when(F.col("analog"), 4).otherwise(8)
    low = lambda k: idiv(F.coalesce(F.col(f"{k}0"), F.lit(0)), step) * step
    high = lambda k: idiv(F.coalesce(F.col(f"{k}1") + 1, F.lit(0)) + step - 1, step) * step
    return got.select(*by(pixels), "none", "full", "analog", *[low(k).cast("int").alias(k) for k in "xy"], *[(high(k) - low(k)).cast("int").alias(n) for k, n in (("x", "w"), ("y", "h"))])


def quadtree_empty(pixels: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, qy, qx, empty) for squares of 1, 2, 4 ... 2**levels pixels: level by level, from the one below."""
    keys = by(pixels)
    now = pixels.select(*keys, F.col("y").alias("qy"), F.col("x").alias("qx"), (c(value) == 0).alias("empty"))
    out = now.where(F.lit(False)).select(*keys, F.lit(0).alias("level"), "qy", "qx", "empty")
    for level in range(1, levels + 1):
        now = now.groupBy(*keys, idiv("qy", 2).cast("int").alias("qy"), idiv("qx", 2).cast("int").alias("qx")).agg(F.every("empty").alias("empty"))
        out = out.unionByName(now.select(*keys, F.lit(level).alias("level"), "qy", "qx", "empty"))
    return out


def delta_histogram(pixels: DataFrame, value: str, th: int, tw: int, reach: int = 7) -> DataFrame:
    """(ty, tx, dx, dy, cnt): joint counts of the differences to the left and upper pixel, cut to +-reach."""
    left = F.lag(c(value)).over(Window.partitionBy(*by(pixels), "y").orderBy("x"))
    up = F.lag(c(value)).over(Window.partitionBy(*by(pixels), "x").orderBy("y"))
    cut = lambda d: F.greatest(F.lit(-reach), F.least(F.lit(reach), F.coalesce(d, F.lit(0))))
    both = pixels.select(*by(pixels), "y", "x", cut(c(value) - left).alias("dx"), cut(c(value) - up).alias("dy"))
    return both.groupBy(*by(pixels), *tile(th, tw), "dx", "dy").agg(F.count("*").alias("cnt"))


def format_of_tile(pixels: DataFrame, value: str, th: int, tw: int) -> DataFrame:
    """(ty, tx, mask, uniq, mn, mx, natural, bits): the set of 6-bit values as a mask, and the bits an index or a masked rank takes."""
    six = F.shiftright(c(value), 2)
    one = shl(F.lit(1).cast("long"), six.cast("int"))
    got = pixels.groupBy(*by(pixels), *tile(th, tw)).agg(F.bit_or(one).alias("mask"), F.count_distinct(six).alias("uniq"), F.min(six).alias("mn"), F.max(six).alias("mx"))
    need = lambda n: F.greatest(F.lit(2), F.least(F.lit(6), F.length(F.bin(F.greatest(n - 1, F.lit(1)).cast("long")))))
    natural = F.col("mx") - F.col("mn") + 1
    return got.select(*by(pixels), "ty", "tx", "mask", "uniq", "mn", "mx", need(natural).cast("int").alias("natural"), need(F.col("uniq")).cast("int").alias("bits"))


def pass_totals(cells: DataFrame) -> DataFrame:
    """(technique, tile, tiles, pixels) with totals by rollup, from rows (technique, tile, pixels)."""
    totals = cells.select(F.col("technique").cast("string").alias("technique"), F.col("tile").cast("string").alias("tile"), "pixels").rollup("technique", "tile")
    return totals.agg(F.count("*").alias("tiles"), F.sum("pixels").alias("pixels")).na.fill("all", ["technique", "tile"])


def superset_masks(tiles: DataFrame, keys: list[str], order: str) -> DataFrame:
    """tiles (keys, order, mask) with slot: the first stored mask that covers it, in order; a mask that none covers is stored.

    What a mask finds depends on those before, so each stream of masks is one task; equal masks are merged before,
    as the later ones find what the first did."""
    import pandas as pd

    firsts = tiles.groupBy(*keys, "mask").agg(F.min(order).alias("_first"))
    schema = T.StructType([*(tiles.schema[k] for k in keys), tiles.schema["mask"], T.StructField("slot", T.IntegerType())])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        stored: list[int] = []
        slots = []
        for mask in frame.sort_values("_first")["mask"].tolist():
            slot = next((i for i, s in enumerate(stored) if mask & ~s == 0), len(stored))
            if slot == len(stored):
                stored.append(mask)
            slots.append(slot)
        return frame.sort_values("_first").assign(slot=slots)[[*keys, "mask", "slot"]].astype({"slot": "int32"})

    found = firsts.groupBy(*keys).applyInPandas(one, schema)
    return tiles.join(found, [*keys, "mask"])


def single_colors(pixels: DataFrame, least: int = 150, most: int = 84, bits: int = 7) -> DataFrame:
    """(color, cnt, rank) of the colours worth a map of their own: the most frequent first, at most most of them, while a
    colour's pixels cost more at bits each than its entry and the ends of its runs at 12 bits.

    The compressed size of the map is estimated by its runs; counts do not change as colours are taken, so the
    greedy order is the order of counts."""
    color = shl(c("r"), 16).bitwiseOR(shl(c("g"), 8)).bitwiseOR(c("b"))
    keys = by(pixels)
    colored = pixels.select(*keys, "y", "x", color.alias("color"))
    before = F.lag("color").over(Window.partitionBy(*keys, "y").orderBy("x"))
    starts = F.count_if(F.col("before").isNull() | (F.col("before") != F.col("color")))
    counted = colored.withColumn("before", before).groupBy(*keys, "color").agg(F.count("*").alias("cnt"), starts.alias("runs"))
    worth = counted.where((F.col("cnt") > least) & (F.col("cnt") * bits >= F.col("runs") * 12 + 24))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cnt"), "color"))
    return worth.select(*keys, "color", "cnt", rank.alias("rank")).where(F.col("rank") <= most)
