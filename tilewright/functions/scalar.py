"""Integer formulas of colour, range and bit arithmetic as Column expressions (truncating division throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the range codes: greatest base, least range, bits of each.
BASE_MAX, RANGE_MIN, BASE_BITS, RANGE_BITS = 224, 32, 6, 7
BASE_CODES, RANGE_CODES = (1 << BASE_BITS) - 1, (1 << RANGE_BITS) - 1
#: log2 of width and height of the big tile that bitmaps of each tile size are ordered by.
BIG_TILE = {(16, 16): (6, 6), (16, 8): (6, 6), (8, 16): (6, 6), (8, 8): (6, 6), (8, 4): (6, 5), (4, 8): (5, 6), (4, 4): (5, 5)}
#: The six axis orders, by number.
AXIS_ORDERS = ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx")


def c(value: Column | str | int) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def by(frame) -> list[str]:
    """The key of an image where the pixels are of many: image_id where there is such a column."""
    return [k for k in ("image_id",) if k in frame.columns]


def idiv(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer division that truncates toward zero, as BIGINT."""
    return F.call_function("div", c(a), c(b))


def shl(a: Column | str, n: int | Column) -> Column:
    return F.call_function("shiftleft", c(a), c(n))


def shr(a: Column | str, n: int | Column) -> Column:
    return F.call_function("shiftright", c(a), c(n))


def clamp(a: Column | str, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c(a)))


def rgb_to_ycocg(r, g, b) -> tuple[Column, Column, Column]:
    co = c(r) - c(b)
    t = c(b) + idiv(co, 2)
    cg = c(g) - t
    return t + idiv(cg, 2), idiv(co, 2), idiv(cg, 2)


def ycocg_to_rgb(y, co, cg) -> tuple[Column, Column, Column]:
    co2, cg2 = c(co) * 2, c(cg) * 2
    t = c(y) - idiv(cg2, 2)
    b = t - idiv(co2, 2)
    return b + co2, cg2 + t, b


def rgb_to_ycocg_pos(r, g, b) -> tuple[Column, Column, Column]:
    y, co, cg = rgb_to_ycocg(r, g, b)
    return y, co + 127, cg + 127


def ycocg_pos_to_rgb(y, co, cg) -> tuple[Column, Column, Column]:
    """Takes 127 from the luma too and doubles the result: not the inverse of rgb_to_ycocg_pos, kept as it is defined."""
    r, g, b = ycocg_to_rgb(c(y) - 127, c(co) - 127, c(cg) - 127)
    return r * 2, g * 2, b * 2


def round6(v) -> Column:
    q = shr(v, 2)
    return shl(q, 2).bitwiseOR(shr(q, 4))


def round6_plus(v) -> Column:
    return round6(F.least(c(v) + 1, F.lit(255)))


def compress(v, rate) -> Column:
    return idiv(c(v) * c(rate) + 127, 255)


def uncompress(v, rate) -> Column:
    inverse = F.when(c(rate) == 0, F.lit(255 << 16).cast("long")).otherwise(idiv(255 << 16, F.when(c(rate) != 0, c(rate))))
    return shr(c(v) * inverse, 16)


def base_encode(v) -> Column:
    return idiv(F.least(c(v), F.lit(BASE_MAX)) * BASE_CODES + BASE_MAX // 2, BASE_MAX)


def base_decode(code) -> Column:
    return idiv(c(code) * BASE_MAX, BASE_CODES)


def range_encode(diff, base) -> Column:
    scale = F.lit(255 - RANGE_MIN) - c(base)
    return idiv((F.greatest(c(diff), F.lit(RANGE_MIN)) - RANGE_MIN) * RANGE_CODES + scale - 1, scale)


def range_decode(code, base) -> Column:
    return idiv(c(code) * (F.lit(255 - RANGE_MIN) - c(base)), RANGE_CODES) + RANGE_MIN


def level_symbol(v, low, delta, steps: int) -> Column:
    """The index of v in steps over [low, low + delta]; 0 where delta is 0. v = low with delta = 1 gives -1."""
    return F.when(c(delta) == 0, F.lit(0).cast("long")).otherwise(
        idiv((c(v) - c(low)) * steps + (shr(delta, 1) - 1), F.when(c(delta) != 0, c(delta)))
    )


def level_value(index, low, delta, steps: int) -> Column:
    return c(low) + idiv(c(index) * c(delta), steps)


def level_value_fixed(index, low, delta, steps: int) -> Column:
    """level_value by a reciprocal in 24 bits, as a decoder computes it."""
    step = shr(c(delta).cast("long") * ((1 << 24) // steps), 8) + 1
    return c(low) + shr(c(index).cast("long") * step, 16)


def morton3(x, y, z) -> Column:
    out = F.lit(0).cast("long")
    for axis, v in enumerate((x, y, z)):
        for k in range(8):
            out = out.bitwiseOR(shl(shr(v, k).bitwiseAND(F.lit(1)).cast("long"), 3 * k + axis))
    return out


def morton2(x, y) -> Column:
    return morton3(x, y, F.lit(0))


def bitmap_layout(tw: int, th: int) -> tuple[int, int, int]:
    """Width and height of the big tile and its number of tiles, for tiles of tw x th."""
    lx, ly = BIG_TILE[tw, th]
    return 1 << lx, 1 << ly, ((1 << lx) // tw) * ((1 << ly) // th)


def bitmap_position(ty, tx, width, tw: int, th: int) -> Column:
    """The bit of tile (ty, tx): big tiles in rows, tiles in rows within."""
    bx, by, bits = bitmap_layout(tw, th)
    across, down = bx // tw, by // th
    big_row = idiv(c(width) + (bx - 1), bx)
    return ((idiv(ty, down) * big_row + idiv(tx, across)) * bits) + (c(ty) % down) * across + c(tx) % across


def bitmap_bytes(width, height, tw: int, th: int) -> Column:
    bx, by, bits = bitmap_layout(tw, th)
    return idiv(idiv(c(width) + (bx - 1), bx) * idiv(c(height) + (by - 1), by) * bits + 7, 8)


def linear_place(y, x, width) -> Column:
    return c(x) + c(y) * c(width)


def swizzle_place(y, x, width) -> Column:
    """Place of a pixel where blocks of 8 x 8 lie in rows, with rows of 8 inside."""
    inside = c(x).bitwiseAND(F.lit(7)).bitwiseOR(shl(c(y).bitwiseAND(F.lit(7)), 3))
    return inside.bitwiseOR(shl(shr(x, 3) + shr(y, 3) * shr(width, 3), 6))


def next_power(v) -> Column:
    """The least power of two that is v or more (0 for 0 or less)."""
    return F.when(c(v) <= 0, F.lit(0).cast("long")).otherwise(shl(F.lit(1).cast("long"), _bits(c(v) - 1).cast("int")))


def log2_floor(v) -> Column:
    return F.when(c(v) <= 0, F.lit(0)).otherwise(_bits(c(v)) - 1)


def _bits(v: Column) -> Column:
    return F.when(v <= 0, F.lit(0)).otherwise(F.length(F.bin(v.cast("long"))))


def swap_axes(number, x, y, z) -> Column:
    """struct(x, y, z) in the axis order of that number (0..5)."""
    axes = {"x": c(x), "y": c(y), "z": c(z)}
    out = None
    for k, order in enumerate(AXIS_ORDERS):
        made = F.struct(*[axes[a].alias(n) for a, n in zip(order, "xyz", strict=True)])
        out = F.when(c(number) == k, made) if out is None else out.when(c(number) == k, made)
    return out


def round_box(low, high, bits) -> tuple[Column, Column]:
    """The low end cut to whole steps of 2**bits, the high end to the last value of its step."""
    return shl(shr(low, bits), bits), shl(shr(high, bits), bits) + (shl(F.lit(1), bits) - 1)


def bit_total(v) -> Column:
    return F.bit_count(c(v))


def bit_rank(v, place) -> Column:
    """How many bits of v lie below a place."""
    return F.bit_count(c(v).bitwiseAND(shl(F.lit(1).cast("long"), place) - 1))


def only_bit(v) -> Column:
    """The place of the only bit that is set; -1 where not exactly one is."""
    return F.when(F.bit_count(c(v)) == 1, F.bit_count(c(v) - 1)).otherwise(-1)


def tile_type(t, r, b) -> Column:
    return shl(t, 13).bitwiseOR(shl(r, 7)).bitwiseOR(c(b))


def lut_word(mode, lut, depth) -> Column:
    return c(mode).bitwiseOR(shl(lut, 6)).bitwiseOR(shl(depth, 14))


def lut_word_parts(word) -> tuple[Column, Column]:
    """Table number (mode and lut) and depth of a tile word."""
    return c(word).bitwiseAND(F.lit(0x3FFF)), shr(word, 14)


def divide_up(v, n: int) -> Column:
    return shr(c(v) + ((1 << n) - 1), n)


def segment_distance(px, py, pz, a: tuple, b: tuple) -> tuple[Column, Column]:
    """Distance from a point to the segment a-b, and the parameter along it before it is clamped to 0..1."""
    p = [c(v).cast("double") for v in (px, py, pz)]
    d = [float(q - o) for o, q in zip(a, b, strict=True)]
    t = sum((v - float(o)) * s for v, o, s in zip(p, a, d, strict=True)) / float(sum(s * s for s in d))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(sum(((v - (inside * s + float(o))) * (v - (inside * s + float(o))) for v, o, s in zip(p, a, d, strict=True)), F.lit(0.0))), t


def level_table(low, span, steps: int) -> Column:
    """struct(linear, rising, falling): tables of steps values from low over span, by pos, pos**1.4 and 1-(1-pos)**1.4, in single precision."""
    power = F.lit(1.399999976158142)
    one = F.lit(1.0).cast("float")

    def made(shape):
        at = lambda i: (i / float(steps - 1)).cast("float")
        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: (c(low).cast("float") + shape(at(i)) * c(span).cast("float")).cast("int"))

    return F.struct(
        made(lambda p: p).alias("linear"),
        made(lambda p: F.pow(p.cast("double"), power).cast("float")).alias("rising"),
        made(lambda p: one - F.pow((one - p).cast("double"), power).cast("float")).alias("falling"),
    )
