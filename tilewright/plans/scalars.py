"""Queries of the scalar formulas, over every pixel of the three-channel image."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import scalar as S
from tilewright.sources.rasters import duck, event_image

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, columns: dict, sql: str) -> None:
    """A query over event_image: y, x and the columns; sql: the same columns for DuckDB, from evt."""

    def run(spark, sf_dir):
        made = columns() if callable(columns) else columns
        return event_image(spark, sf_dir).select("y", "x", *[v.alias(k) for k, v in made.items()])

    QUERIES[name] = run
    ORACLES[name] = duck("evt", f"\nSELECT y, x, {sql} FROM evt") if "FROM" not in sql else duck("evt", sql)


def _lists(*groups):
    return {n: v.cast("int") for names, values in groups for n, v in zip(names.split(), values, strict=True)}


_add(
    "op_s1_rgb_to_ycocg",
    lambda: _lists(("yy co cg", S.rgb_to_ycocg("r", "g", "b"))),
    "b + (r - b) // 2 + (g - b - (r - b) // 2) // 2 AS yy, (r - b) // 2 AS co, (g - b - (r - b) // 2) // 2 AS cg",
)
_add(
    "op_s2_ycocg_round_trip",
    lambda: _lists(("r2 g2 b2", S.ycocg_to_rgb(*S.rgb_to_ycocg("r", "g", "b")))),
    """,
a AS (SELECT *, (r - b) // 2 AS h, g - b - (r - b) // 2 AS cg0 FROM evt),
e AS (SELECT *, b + h + cg0 // 2 AS yy, 2 * h AS co, 2 * (cg0 // 2) AS cg FROM a),
f AS (SELECT *, yy - cg // 2 AS t FROM e)
SELECT y, x, (t - co // 2 + co)::INT AS r2, (cg + t)::INT AS g2, (t - co // 2)::INT AS b2 FROM f""",
)
_add(
    "op_s3_ycocg_positive",
    lambda: _lists(("yy co cg", S.rgb_to_ycocg_pos("r", "g", "b"))),
    "b + (r - b) // 2 + (g - b - (r - b) // 2) // 2 AS yy, (r - b) // 2 + 127 AS co, (g - b - (r - b) // 2) // 2 + 127 AS cg",
)
_add(
    "op_s4_ycocg_positive_back",
    lambda: _lists(("r2 g2 b2", S.ycocg_pos_to_rgb("r", "g", "b"))),
    """,
a AS (SELECT *, r - 127 AS yy, 2 * (g - 127) AS co, 2 * (b - 127) AS cg FROM evt),
f AS (SELECT *, yy - cg // 2 AS t FROM a)
SELECT y, x, (2 * (t - co // 2 + co))::INT AS r2, (2 * (cg + t))::INT AS g2, (2 * (t - co // 2))::INT AS b2 FROM f""",
)
_add(
    "op_s5_s6_round6",
    lambda: _lists(("r6 g6 b6", [S.round6(n) for n in "rgb"]), ("rp gp bp", [S.round6_plus(n) for n in "rgb"])),
    ", ".join(f"(({n} >> 2) << 2) | ({n} >> 6) AS {n}6, ((least({n} + 1, 255) >> 2) << 2) | (least({n} + 1, 255) >> 6) AS {n}p" for n in "rgb"),
)
_add(
    "op_s7_s8_rates",
    lambda: _lists(
        ("r250 g250 b255", [S.compress(n, k) for n, k in (("r", 250), ("g", 250), ("b", 255))]),
        ("ru gu bu", [S.uncompress(S.compress(n, k), k) for n, k in (("r", 250), ("g", 250), ("b", 255))]),
        ("r0", [S.uncompress("r", 0)]),
    ),
    "(r * 250 + 127) // 255 AS r250, (g * 250 + 127) // 255 AS g250, (b * 255 + 127) // 255 AS b255, "
    "(((r * 250 + 127) // 255) * (16711680 // 250)) >> 16 AS ru, (((g * 250 + 127) // 255) * (16711680 // 250)) >> 16 AS gu, "
    "(((b * 255 + 127) // 255) * (16711680 // 255)) >> 16 AS bu, ((r::BIGINT * 16711680) >> 16)::INT AS r0",
)
_add(
    "op_s9_range_codes",
    lambda: _lists(
        ("be bd", [S.base_encode("r"), S.base_decode(S.base_encode("r"))]),
        ("de dd", [S.range_encode("g", S.base_decode(S.base_encode("r"))), S.range_decode(S.range_encode("g", S.base_decode(S.base_encode("r"))), S.base_decode(S.base_encode("r")))]),
    ),
    """,
a AS (SELECT *, (least(r, 224) * 63 + 112) // 224 AS be FROM evt),
e AS (SELECT *, be * 224 // 63 AS bd FROM a),
f AS (SELECT *, ((greatest(g, 32) - 32) * 127 + (223 - bd) - 1) // (223 - bd) AS de FROM e)
SELECT y, x, be::INT AS be, bd::INT AS bd, de::INT AS de, (de * (223 - bd) // 127 + 32)::INT AS dd FROM f""",
)
_add(
    "op_s10_level_tables",
    lambda: {k: F.array_join(S.level_table("r", F.least(F.col("g"), F.lit(255) - F.col("r")), n)[t], ",") for k, n, t in (("l16", 16, "linear"), ("e16", 16, "rising"), ("f16", 16, "falling"), ("l8", 8, "linear"), ("e8", 8, "rising"), ("f8", 8, "falling"))},
    """,
a AS (SELECT y, x, r::FLOAT AS lo, least(g, 255 - r)::FLOAT AS span FROM evt)
SELECT y, x, """
    + ", ".join(
        f"array_to_string([trunc(lo + {shape} * span)::INT FOR i IN range({n})], ',') AS {k}{n}"
        for n in (16, 8)
        for k, shape in (
            ("l", f"(i::DOUBLE / {n - 1}.0)::FLOAT"),
            ("e", f"pow((i::DOUBLE / {n - 1}.0)::FLOAT::DOUBLE, 1.399999976158142)::FLOAT"),
            ("f", f"(1::FLOAT - pow((1::FLOAT - (i::DOUBLE / {n - 1}.0)::FLOAT)::DOUBLE, 1.399999976158142)::FLOAT)"),
        )
    )
    + " FROM a",
)
_add(
    "op_s11_s12_levels",
    lambda: {
        "sym": S.level_symbol(F.greatest("r", "g"), F.least("r", "g"), F.col("b") % 64, 15).cast("int"),
        "val": S.level_value(F.col("x") % 16, "g", "b", 15).cast("int"),
        "fix": S.level_value_fixed(F.col("x") % 16, "g", "b", 15).cast("int"),
    },
    "(CASE WHEN b % 64 = 0 THEN 0 ELSE ((greatest(r, g) - least(r, g)) * 15 + (((b % 64) >> 1) - 1)) // (b % 64) END)::INT AS sym, "
    "(g + (x % 16) * b // 15)::INT AS val, (g + (((x % 16) * (((b::BIGINT * 1118481) >> 8) + 1)) >> 16))::INT AS fix",
)
_add(
    "op_s13_morton",
    lambda: {"m3": S.morton3("r", "g", "b"), "m2": S.morton2("r", "g")},
    "(" + " + ".join(f"((({n} >> {k}) & 1)::BIGINT << {3 * k + a})" for a, n in enumerate("rgb") for k in range(8)) + ") AS m3, ("
    + " + ".join(f"((({n} >> {k}) & 1)::BIGINT << {3 * k + a})" for a, n in enumerate("rg") for k in range(8)) + ") AS m2",
)
_add(
    "op_s14_bitmap_places",
    lambda: {f"p{tw}x{th}": S.bitmap_position(S.idiv("y", th), S.idiv("x", tw), F.lit(64), tw, th).cast("int") for tw, th in S.BIG_TILE},
    ", ".join(
        f"((y // {th} // {by // th} * ((64 + {bx - 1}) // {bx}) + x // {tw} // {bx // tw}) * {(bx // tw) * (by // th)} + (y // {th}) % {by // th} * {bx // tw} + (x // {tw}) % {bx // tw})::INT AS p{tw}x{th}"
        for (tw, th), (bx, by) in {k: (1 << v[0], 1 << v[1]) for k, v in S.BIG_TILE.items()}.items()
    ),
)
_add(
    "op_s15_coordinates",
    lambda: {"lin": S.linear_place("y", "x", F.lit(64)).cast("int"), "swz": S.swizzle_place("y", "x", F.lit(64)).cast("int")},
    "x + y * 64 AS lin, ((x & 7) | ((y & 7) << 3) | (((x >> 3) + (y >> 3) * 8) << 6)) AS swz",
)
_add(
    "op_s16_powers",
    lambda: {"np": S.next_power("r").cast("int"), "lg": S.log2_floor("g").cast("int")},
    "(CASE WHEN r <= 0 THEN 0 ELSE (1 << ceil(log2(r))::INT) END)::INT AS np, (CASE WHEN g <= 0 THEN 0 ELSE floor(log2(g)) END)::INT AS lg",
)
_add(
    "op_s17_axis_orders",
    lambda: (lambda s: {k: s[k] for k in "xyz"} | {"n": F.col("x") % 6})(S.swap_axes(F.col("x") % 6, "r", "g", "b")) and {
        "ax": S.swap_axes(F.col("x") % 6, "r", "g", "b")["x"], "ay": S.swap_axes(F.col("x") % 6, "r", "g", "b")["y"], "az": S.swap_axes(F.col("x") % 6, "r", "g", "b")["z"]},
    "[r, r, g, g, b, b][x % 6 + 1] AS ax, [g, b, r, b, r, g][x % 6 + 1] AS ay, [b, g, b, r, g, r][x % 6 + 1] AS az",
)
_add(
    "op_s18_round_box",
    lambda: _lists(("lo hi", S.round_box(F.least("r", "g"), F.greatest("r", "g"), 2)), ("lo0 hi0", S.round_box("r", "g", 0))),
    "(least(r, g) >> 2) << 2 AS lo, ((greatest(r, g) >> 2) << 2) + 3 AS hi, r AS lo0, g AS hi0",
)
_add(
    "op_s19_bit_ranks",
    lambda: {"cnt": S.bit_total("r").cast("int"), "rank": S.bit_rank("r", F.col("x") % 8).cast("int"), "only": S.only_bit("g").cast("int")},
    "bit_count(r)::INT AS cnt, bit_count(r & ((1 << (x % 8)) - 1))::INT AS rank, (CASE WHEN bit_count(g) = 1 THEN bit_count(g - 1) ELSE -1 END)::INT AS only",
)
_add(
    "op_s20_s21_tile_words",
    lambda: {
        "tt": S.tile_type(F.col("x") % 8, F.col("r") % 64, F.col("b") % 128).cast("int"),
        "word": S.lut_word(F.col("x") % 48, F.col("g") % 64, F.col("b") % 4).cast("int"),
        "tbl": S.lut_word_parts(S.lut_word(F.col("x") % 48, F.col("g") % 64, F.col("b") % 4))[0].cast("int"),
        "dep": S.lut_word_parts(S.lut_word(F.col("x") % 48, F.col("g") % 64, F.col("b") % 4))[1].cast("int"),
    },
    "((x % 8) << 13) | ((r % 64) << 7) | (b % 128) AS tt, (x % 48) | ((g % 64) << 6) | ((b % 4) << 14) AS word, "
    "((x % 48) | ((g % 64) << 6)) AS tbl, b % 4 AS dep",
)
_add(
    "op_s22_segment_distance",
    lambda: (lambda d: {"dist": F.round(d[0], 6), "t": F.round(d[1], 6)})(S.segment_distance("r", "g", "b", (10, 20, 30), (200, 120, 60))),
    """,
a AS (SELECT *, ((r - 10.0::DOUBLE) * 190 + (g - 20.0::DOUBLE) * 100 + (b - 30.0::DOUBLE) * 30) / 47000.0::DOUBLE AS t0 FROM evt),
e AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, t0)) AS s FROM a)
SELECT y, x, round(sqrt((r - (s * 190 + 10)) ** 2 + (g - (s * 100 + 20)) ** 2 + (b - (s * 30 + 30)) ** 2), 6) AS dist, round(t0, 6) AS t FROM e""",
)
_add(
    "op_s25_power_arithmetic",
    lambda: {"up": S.divide_up("r", 3).cast("int"), "md": F.col("g").bitwiseAND(F.lit(7)), "dv": F.shiftright("b", 3), "ml": F.shiftleft("b", 3)},
    "(r + 7) >> 3 AS up, g & 7 AS md, b >> 3 AS dv, b << 3 AS ml",
)
