"""Tiles that the colours at their corners predict: fitting in a cascade of sizes, corner streams, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.scalar import bitmap_position, by, c, idiv, round6, round6_plus
from tilewright.sources.shared import shared_folder

#: The order of tile sizes, width and height.
SIZES = ((16, 16), (16, 8), (8, 16), (8, 8), (8, 4), (4, 8), (4, 4))
#: A pixel may be so far from the blend.
REJECT = 3
_HALF = (1 << 19) - 1
_ONE = 1 << 20


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, a temporary one where none is set."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def with_corners(pixels: DataFrame, channels: list[str], tw: int, th: int, width: int, height: int) -> DataFrame:
    """(ty, tx, tl, tr, bl, br): structs of channels at the tile's corner and at those of its neighbours, the edge beyond.

    Only pixels that are some tile's corner take part: each goes to the tiles that read it, one aggregation."""
    at_y, at_x = c("y"), c("x")
    last_y, last_x = (height - 1) // th, (width - 1) // tw

    def reads(k: Column, size: int, last: int, end: int) -> Column:
        """The tile indices and sides (0 near, 1 far) that read a line or column."""
        near = F.when(k % size == 0, F.struct(idiv(k, size).cast("int").alias("t"), F.lit(0).alias("far")))
        far = F.when((k % size == 0) & (k > 0), F.struct((idiv(k, size) - 1).cast("int").alias("t"), F.lit(1).alias("far")))
        edge = F.when((k == end - 1) & (F.lit((last + 1) * size) >= end), F.struct(F.lit(last).alias("t"), F.lit(1).alias("far")))
        return F.filter(F.array(near, far, edge), lambda s: s.isNotNull())

    corner = pixels.where(((at_y % th == 0) | (at_y == height - 1)) & ((at_x % tw == 0) | (at_x == width - 1)))
    keys = by(pixels)
    spread = corner.select(*keys, *channels, F.explode(reads(at_y, th, last_y, height)).alias("v"), at_x.alias("x")).select(*keys, *channels, "v", F.explode(reads(at_x, tw, last_x, width)).alias("h"))
    value = F.struct(*channels)
    pick = lambda fy, fx: F.max(F.when((F.col("v.far") == fy) & (F.col("h.far") == fx), value))
    return spread.groupBy(*keys, F.col("v.t").alias("ty"), F.col("h.t").alias("tx")).agg(pick(0, 0).alias("tl"), pick(0, 1).alias("tr"), pick(1, 0).alias("bl"), pick(1, 1).alias("br"))


def blend(corner: dict[str, Column], dy: Column, dx: Column, tw: int, th: int, rounded: bool) -> Column:
    """Two-way linear blend with weights in 1024ths."""
    lf, tf = F.lit(1024) - idiv(dx * 1024, tw), F.lit(1024) - idiv(dy * 1024, th)
    top = corner["tl"] * lf + corner["tr"] * (F.lit(1024) - lf)
    bottom = corner["bl"] * lf + corner["br"] * (F.lit(1024) - lf)
    whole = top.cast("long") * tf + bottom.cast("long") * (F.lit(1024) - tf)
    return idiv(whole + _HALF if rounded else whole, _ONE)


def fit(pixels: DataFrame, taken: DataFrame | None, channels: list[str], tw: int, th: int, width: int, height: int, reject: int = REJECT) -> DataFrame:
    """(ty, tx, err) of the tiles of one size that fit: the least over six ways of blending of the largest error.

    A tile is tried when it lies wholly inside and its top left pixel is free; blends are of the corners as they
    are, cut to 6 bits, and raised by one and cut, each rounded and not."""
    keys = [*by(pixels), "ty", "tx"]
    tiled = pixels.select(*by(pixels), "y", "x", *channels, idiv("y", th).cast("int").alias("ty"), idiv("x", tw).cast("int").alias("tx"))
    tried = tiled.where((F.col("ty") < height // th) & (F.col("tx") < width // tw))
    corners = with_corners(pixels, channels, tw, th, width, height)
    if taken is not None:
        at = taken.select(*by(pixels), idiv("y", th).cast("int").alias("ty"), idiv("x", tw).cast("int").alias("tx"), "y", "x").where((c("y") % th == 0) & (c("x") % tw == 0))
        corners = corners.join(at.select(*keys).distinct(), keys, "left_anti")
    both = tried.join(corners, keys)
    dy, dx = c("y") - c("ty") * th, c("x") - c("tx") * tw
    errors = []
    for k, cut in enumerate((lambda v: v, round6, round6_plus)):
        for rounded in (True, False):
            apart = [F.abs(c(n) - blend({q: cut(F.col(q)[n]) for q in ("tl", "tr", "bl", "br")}, dy, dx, tw, th, rounded)) for n in channels]
            errors.append(F.max(F.greatest(*apart, F.lit(0))).alias(f"e{k}{int(rounded)}"))
    worst = both.groupBy(*keys).agg(*errors)
    err = F.least(*[F.col(f"e{k}{r}") for k in range(3) for r in (0, 1)])
    return worst.select(*keys, err.alias("err")).where(F.col("err") <= reject)


def covered(tiles: DataFrame, tw: int, th: int) -> DataFrame:
    """(y, x) of the pixels of tiles."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(th - 1))).alias("dy")
    columns = F.explode(F.sequence(F.lit(0), F.lit(tw - 1))).alias("dx")
    keys = by(tiles)
    return tiles.select(*keys, "ty", "tx", rows).select(*keys, "ty", "tx", "dy", columns).select(*keys, (c("ty") * th + c("dy")).alias("y"), (c("tx") * tw + c("dx")).alias("x"))


def cascade(pixels: DataFrame, channels: list[str], width: int, height: int, sizes=SIZES, reject: int = REJECT, taken: DataFrame | None = None, observe=None) -> DataFrame:
    """(pass, tw, th, ty, tx, err) over all sizes, each trying what those before have left free; pixels that are taken (y, x) are not free from the start.

    The tiles of a size are checkpointed once; the pixels that they cover follow from that table whenever they are asked for. observe(tiles, pass, tw, th)
    may hang figures on a pass's own job."""
    out = None
    for k, (tw, th) in enumerate(sizes):
        fitted = fit(pixels, taken, channels, tw, th, width, height, reject)
        tiles = checkpointed(fitted if observe is None else observe(fitted, k, tw, th))
        named = tiles.select(*by(pixels), F.lit(k).alias("pass"), F.lit(tw).alias("tw"), F.lit(th).alias("th"), "ty", "tx", "err")
        out = named if out is None else out.unionByName(named)
        more = covered(tiles, tw, th)
        taken = more if taken is None else taken.select(*more.columns).unionByName(more)
    return out


def corner_stream(tiles: DataFrame, pixels: DataFrame, channels: list[str], width: int, height: int) -> DataFrame:
    """(pass, pos, side, cy, cx, <channels>): the 6-bit corners in the order of passes, bitmap places and sides
    (TL, TR, BL, BR), each corner only the first time."""
    place = None
    for tw, th in SIZES:
        p = bitmap_position("ty", "tx", F.lit(width), tw, th)
        match = (F.col("tw") == tw) & (F.col("th") == th)
        place = F.when(match, p) if place is None else place.when(match, p)
    sides = F.explode(F.array(*[F.struct(F.lit(2 * j + i).alias("side"), F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)]))
    keys = by(tiles)
    spread = tiles.select(*keys, "pass", place.alias("pos"), "ty", "tx", "tw", "th", sides.alias("s"))
    cy, cx = (c("ty") + F.col("s.j")) * c("th"), (c("tx") + F.col("s.i")) * c("tw")
    corners = spread.select(*keys, "pass", "pos", F.col("s.side").alias("side"), cy.alias("cy"), cx.alias("cx"))
    first = Window.partitionBy(*keys, "cy", "cx").orderBy("pass", "pos", "side")
    once = corners.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    source = pixels.select(*keys, F.col("y").alias("ky"), F.col("x").alias("kx"), *[round6(n).alias(n) for n in channels])
    keyed = once.withColumn("ky", F.least("cy", F.lit(height - 1))).withColumn("kx", F.least("cx", F.lit(width - 1)))
    return keyed.join(source, [*keys, "ky", "kx"]).drop("ky", "kx")


def decode(tiles: DataFrame, corners: DataFrame, channels: list[str]) -> DataFrame:
    """(y, x, <channels>) of tiles (pass, tw, th, ty, tx) from the corner map (cy, cx, <channels>): closed form of the
    blend, cut not rounded. Of tiles that overlap, the later pass stays."""
    keys, keyed = by(tiles), tiles
    for q, (j, i) in {"tl": (0, 0), "tr": (0, 1), "bl": (1, 0), "br": (1, 1)}.items():
        at = corners.select(*keys, F.col("cy").alias(f"cy_{q}"), F.col("cx").alias(f"cx_{q}"), F.struct(*channels).alias(q))
        keyed = keyed.withColumn(f"cy_{q}", (c("ty") + j) * c("th")).withColumn(f"cx_{q}", (c("tx") + i) * c("tw")).join(at, [*keys, f"cy_{q}", f"cx_{q}"])
    dense = keyed.withColumn("dy", F.explode(F.expr("sequence(0, th - 1)"))).withColumn("dx", F.explode(F.expr("sequence(0, tw - 1)")))
    dy, dx, th, tw = (c(k) for k in ("dy", "dx", "th", "tw"))

    def value(n: str) -> Column:
        left = F.col("tl")[n] * (th - dy) + F.col("bl")[n] * dy
        right = F.col("tr")[n] * (th - dy) + F.col("br")[n] * dy
        return idiv(left * (tw - dx) + right * dx, tw * th).cast("int")

    out = dense.select(*keys, "pass", (c("ty") * th + dy).alias("y"), (c("tx") * tw + dx).alias("x"), *[value(n).alias(n) for n in channels])
    return out.groupBy(*keys, "y", "x").agg(F.max_by(F.struct(*channels), "pass").alias("s")).select(*keys, "y", "x", "s.*")
