"""Queries of the tile encoders and decoders."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tilewright.functions.scalar import idiv, rgb_to_ycocg
from tilewright.operators import gradient, lut, quant1d, stats, streams
from tilewright.plans import pass_stats
from tilewright.sources import captures, png, tables
from tilewright.sources.files import write_files
from tilewright.sources.rasters import duck, embedding_plane, lut_bank, mixed_image, vector_bank
from tilewright.sources.shared import shared_folder

from .pixels import PARAMS

QUERIES: dict = {}
ORACLES: dict = {}
RGB = ["r", "g", "b"]
WIDTH = 64


def codec_scratch(spark) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex[:12]}"


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _height(image) -> int:
    return image.agg(F.max("y")).first()[0] + 1


# ---- the one-dimensional quantiser

_SYMBOLS = PARAMS + """,
s AS (SELECT y, x, v, color0, mn, dl, CASE WHEN abs(v - color0) <= 1 THEN 0 WHEN dl = 0 THEN 1 ELSE ((v - mn) * 15 + ((dl >> 1) - 1)) // dl + 1 END::INT AS sym
      FROM emb JOIN p ON ty = y // 8 AND tx = x // 8)"""


@query("op_e10_quantise", duck("emb", _SYMBOLS + "\nSELECT y, x, sym, color0, mn, dl FROM s"))
def _(spark, sf):
    return quant1d.encode(embedding_plane(spark, sf), "v")


@query("op_d10_dequantise", duck("emb", _SYMBOLS + "\nSELECT y, x, (CASE WHEN sym = 0 THEN color0 ELSE mn + (((sym - 1) * (((dl::BIGINT * (16777216 // 15)) >> 8) + 1)) >> 16) END)::INT AS v FROM s"))
def _(spark, sf):
    return quant1d.decode(quant1d.encode(embedding_plane(spark, sf), "v"))


def _table_sql(n: int, shape: str) -> str:
    return f"[trunc(base::FLOAT + {shape.format(p=f'(i::DOUBLE / {n - 1}.0)::FLOAT')} * span::FLOAT)::INT FOR i IN range({n})]"


_SHAPES = ("{p}", "pow({p}::DOUBLE, 1.399999976158142)::FLOAT", "(1::FLOAT - pow((1::FLOAT - {p})::DOUBLE, 1.399999976158142)::FLOAT)")


@query("op_e12_best_table", duck("emb", f""",
t AS (SELECT y // 8 AS ty, x // 8 AS tx, min(v) AS lo, max(v) AS hi FROM emb GROUP BY ALL),
a AS (SELECT *, ((least(lo, 224) * 63 + 112) // 224) * 224 // 63 AS base FROM t),
c AS (SELECT *, (((greatest(greatest(hi - least(lo, 224), 16), 32) - 32) * 127 + (223 - base) - 1) // (223 - base)) * (223 - base) // 127 + 32 AS span FROM a),
m AS ({" UNION ALL ".join(f"SELECT ty, tx, base, span, {k} AS mode, {_table_sql(n, s)} AS tbl FROM c" for k, (n, s) in enumerate((n, s) for n in (16, 8) for s in _SHAPES))}),
e AS (SELECT ty, tx, base, span, mode, sum(list_min([abs(q - v) FOR q IN tbl])) AS err FROM emb JOIN m ON ty = y // 8 AND tx = x // 8 GROUP BY ALL)
SELECT ty, tx, base::INT AS base, span::INT AS span, max(mode)::INT AS mode, min(err)::BIGINT AS err FROM (SELECT *, min(err) OVER (PARTITION BY ty, tx) AS best FROM e) WHERE err = best GROUP BY ty, tx, base, span"""))
def _(spark, sf):
    return quant1d.best_table(embedding_plane(spark, sf), "v")


# ---- gradients


def _cut(v: str, k: int) -> str:
    return v if k == 0 else f"((({v} >> 2) << 2) | ({v} >> 6))" if k == 1 else f"(((least({v} + 1, 255) >> 2) << 2) | (least({v} + 1, 255) >> 6))"


def _fit_sql(image: str, channels: str, tw: int, th: int, taken: str | None, width: str, height: str) -> str:
    """Rows (ty, tx, err) of the tiles of one size that fit."""
    corners = ", ".join(f"{q}.{n} AS {q}_{n}" for q in ("tl", "tr", "bl", "br") for n in channels)
    errors = []
    for k in range(3):
        for half in (524287, 0):
            apart = []
            for n in channels:
                tl, tr, bl, br = (_cut(f"{q}_{n}", k) for q in ("tl", "tr", "bl", "br"))
                top, bottom = f"({tl} * lf + {tr} * (1024 - lf))::BIGINT", f"({bl} * lf + {br} * (1024 - lf))::BIGINT"
                apart.append(f"abs({n} - ({top} * tf + {bottom} * (1024 - tf) + {half}) // 1048576)")
            errors.append(f"max(greatest({', '.join(apart)}))")
    free = f"WHERE NOT EXISTS (FROM {taken} k WHERE k.y = tl.y AND k.x = tl.x)" if taken else ""
    return f"""(WITH c AS MATERIALIZED (SELECT tl.y // {th} AS ty, tl.x // {tw} AS tx, {corners} FROM (FROM {image} WHERE y % {th} = 0 AND x % {tw} = 0 AND y + {th} <= {height} AND x + {tw} <= {width}) tl
  JOIN {image} tr ON tr.y = tl.y AND tr.x = least(tl.x + {tw}, {width} - 1) JOIN {image} bl ON bl.y = least(tl.y + {th}, {height} - 1) AND bl.x = tl.x
  JOIN {image} br ON br.y = least(tl.y + {th}, {height} - 1) AND br.x = least(tl.x + {tw}, {width} - 1) {free}),
 p AS (SELECT y // {th} AS ty, x // {tw} AS tx, {", ".join(channels)}, 1024 - (x % {tw}) * {1024 // tw} AS lf, 1024 - (y % {th}) * {1024 // th} AS tf FROM {image})
 SELECT ty, tx, least({", ".join(errors)})::BIGINT AS err FROM p JOIN c USING (ty, tx) GROUP BY ty, tx HAVING least({", ".join(errors)}) <= 3)"""


def _cascade_sql(image: str, channels: str, width: str, height: str) -> str:
    """CTEs g0..g6 (tiles of each size) and k0..k6 (pixels taken), and casc with all tiles."""
    parts = []
    for k, (tw, th) in enumerate(gradient.SIZES):
        parts.append(f"g{k} AS MATERIALIZED {_fit_sql(image, channels, tw, th, f'k{k - 1}' if k else None, width, height)}")
        cover = f"SELECT (ty * {th} + dy)::INT AS y, (tx * {tw} + dx)::INT AS x FROM g{k}, range({th}) a(dy), range({tw}) b(dx)"
        parts.append(f"k{k} AS MATERIALIZED ({cover}" + (f" UNION FROM k{k - 1})" if k else ")"))
    every = " UNION ALL ".join(f"SELECT {k} AS pass, {tw} AS tw, {th} AS th, ty, tx, err FROM g{k}" for k, (tw, th) in enumerate(gradient.SIZES))
    return ",\n" + ",\n".join(parts) + f",\ncasc AS MATERIALIZED ({every})"


_H = "(SELECT max(y) + 1 FROM mix)"


def _fit_query(tw: int, th: int, channels: str) -> None:
    def run(spark, sf):
        image = mixed_image(spark, sf)
        return gradient.fit(image, None, list(channels), tw, th, WIDTH, _height(image))

    name = f"op_e1_gradient_{tw}x{th}" if channels == "rgb" else f"op_e3_gradient_{channels}_{tw}x{th}"
    QUERIES[name], ORACLES[name] = run, duck("evt mix", ",\nm AS MATERIALIZED (FROM mix), f AS " + _fit_sql("m", channels, tw, th, None, "64", _H) + "\nSELECT ty, tx, err FROM f")


for _tw, _th in gradient.SIZES:
    _fit_query(_tw, _th, "rgb")
for _channels in ("rb", "rg", "gb", "r", "g", "b"):
    _fit_query(4, 4, _channels)


def _mix_cascade(spark, sf):
    image = mixed_image(spark, sf)
    return image, gradient.cascade(image, RGB, WIDTH, _height(image))


_MIX = ",\nm AS MATERIALIZED (FROM mix)" + _cascade_sql("m", "rgb", "64", _H)


@query("op_e2_gradient_cascade", duck("evt mix", _MIX + "\nSELECT pass, tw, th, ty, tx, err FROM casc"))
def _(spark, sf):
    return _mix_cascade(spark, sf)[1]


_PATCH = "x BETWEEN 9 AND 15 AND y % 32 BETWEEN 1 AND 7"


@query("op_p13_top_left_eligibility", duck("emb", f",\nm AS MATERIALIZED (SELECT y, x, r, r AS g, r AS b FROM (SELECT y, x, (CASE WHEN {_PATCH} THEN v ELSE 40 + 2 * x + y % 32 END)::INT AS r FROM emb WHERE x < 32))" + _cascade_sql("m", "rgb", "32", "(SELECT max(y) + 1 FROM m)") + "\nSELECT pass, tw, th, ty, tx, err FROM casc"))
def _(spark, sf):
    """Slopes of 32 columns with a patch of the plane's noise in each 32 rows, which tells top-left from whole-tile eligibility."""
    patch = F.expr(_PATCH)
    v = F.when(patch, F.col("v")).otherwise(F.col("x") * 2 + F.col("y") % 32 + 40).cast("int")
    image = embedding_plane(spark, sf).where("x < 32").select("y", "x", *[v.alias(n) for n in RGB])
    return gradient.cascade(image, RGB, 32, _height(image))


@query("op_u3_covered_pixels", duck("evt mix", _MIX + "\nSELECT y, x FROM k6"))
def _(spark, sf):
    image, tiles = _mix_cascade(spark, sf)
    parts = [gradient.covered(tiles.where(F.col("pass") == k), tw, th) for k, (tw, th) in enumerate(gradient.SIZES)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct().select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


@query("op_j2_tile_corners", duck("evt mix", f""",
c AS (SELECT DISTINCT y // 8 AS ty, x // 8 AS tx FROM mix)
SELECT ty, tx, {", ".join(f"{q}.{n} AS {q}_{n}" for q in ("tl", "tr", "bl", "br") for n in "rgb")} FROM c
JOIN mix tl ON tl.y = ty * 8 AND tl.x = tx * 8 JOIN mix tr ON tr.y = ty * 8 AND tr.x = least(tx * 8 + 8, 63)
JOIN mix bl ON bl.y = least(ty * 8 + 8, {_H} - 1) AND bl.x = tx * 8 JOIN mix br ON br.y = least(ty * 8 + 8, {_H} - 1) AND br.x = least(tx * 8 + 8, 63)"""))
def _(spark, sf):
    image = mixed_image(spark, sf)
    got = gradient.with_corners(image, RGB, 8, 8, WIDTH, _height(image))
    return got.select("ty", "tx", *[F.col(q)[n].alias(f"{q}_{n}") for q in ("tl", "tr", "bl", "br") for n in RGB])


def _place_sql(tw: int, th: int) -> str:
    from tilewright.functions.scalar import bitmap_layout

    bx, by, bits = bitmap_layout(tw, th)
    return f"((ty // {by // th} * ((64 + {bx - 1}) // {bx}) + tx // {bx // tw}) * {bits} + ty % {by // th} * {bx // tw} + tx % {bx // tw})"


_STREAM = ",\ncs AS (SELECT pass, CASE " + " ".join(f"WHEN tw = {tw} AND th = {th} THEN {_place_sql(tw, th)}" for tw, th in gradient.SIZES) + """ END AS pos, 2 * j + i AS side, (ty + j) * th AS cy, (tx + i) * tw AS cx
 FROM casc, range(2) a(j), range(2) b(i)),
co AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY cy, cx ORDER BY pass, pos, side) = 1),
st AS MATERIALIZED (SELECT pass, pos, side, cy, cx, """ + ", ".join(f"((m.{n} >> 2) << 2) | (m.{n} >> 6) AS {n}" for n in "rgb") + f" FROM co JOIN m ON m.y = least(cy, {_H} - 1) AND m.x = least(cx, 63))"


@query("op_w4_corner_stream", duck("evt mix", _MIX + _STREAM + "\nSELECT pass, pos, side, cy, cx, r, g, b FROM st"))
def _(spark, sf):
    image, tiles = _mix_cascade(spark, sf)
    return gradient.corner_stream(tiles, image, RGB, WIDTH, _height(image))


@query("op_d6_gradient_decode", duck("evt mix", _MIX + _STREAM + """,
de AS (SELECT casc.pass AS pass, ty * th + dy AS y, tx * tw + dx AS x, """ + ", ".join(
    f"((tl.{n} * (th - dy) + bl.{n} * dy) * (tw - dx) + (tr.{n} * (th - dy) + br.{n} * dy) * dx) // (tw * th) AS {n}" for n in "rgb") + """
 FROM casc JOIN st tl ON tl.cy = ty * th AND tl.cx = tx * tw JOIN st tr ON tr.cy = ty * th AND tr.cx = tx * tw + tw
 JOIN st bl ON bl.cy = ty * th + th AND bl.cx = tx * tw JOIN st br ON br.cy = ty * th + th AND br.cx = tx * tw + tw, range(16) a(dy), range(16) b(dx) WHERE dy < th AND dx < tw)
SELECT y::INT AS y, x::INT AS x, r::INT AS r, g::INT AS g, b::INT AS b FROM de QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY pass DESC) = 1"""))  # fmt: skip
def _(spark, sf):
    image, tiles = _mix_cascade(spark, sf)
    corners = gradient.checkpointed(gradient.corner_stream(tiles, image, RGB, WIDTH, _height(image)))
    got = gradient.decode(tiles, corners, RGB)
    return got.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *RGB)


def _subset_decode(channels: str) -> None:
    """4x4 tiles of some of the channels: fitted, their corners kept once, and decoded."""

    def run(spark, sf):
        image = mixed_image(spark, sf)
        height = _height(image)
        fitted = gradient.fit(image, None, list(channels), 4, 4, WIDTH, height)
        tiles = gradient.checkpointed(fitted.select(F.lit(0).alias("pass"), F.lit(4).alias("tw"), F.lit(4).alias("th"), "ty", "tx"))
        got = gradient.decode(tiles, gradient.corner_stream(tiles, image, list(channels), WIDTH, height), list(channels))
        return got.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *channels)

    corner = {q: (f"least(ty * 4 + {4 * j}, {_H} - 1)", f"least(tx * 4 + {4 * i}, 63)") for q, (j, i) in {"tl": (0, 0), "tr": (0, 1), "bl": (1, 0), "br": (1, 1)}.items()}
    value = lambda q, n: f"(({q}.{n} >> 2 << 2) | ({q}.{n} >> 6))"
    blend = lambda n: f"((({value('tl', n)} * (4 - dy) + {value('bl', n)} * dy) * (4 - dx) + ({value('tr', n)} * (4 - dy) + {value('br', n)} * dy) * dx) // 16)::INT AS {n}"
    joins = " ".join(f"JOIN m {q} ON {q}.y = {y} AND {q}.x = {x}" for q, (y, x) in corner.items())
    QUERIES[f"op_d7_gradient_decode_{channels}"] = run
    ORACLES[f"op_d7_gradient_decode_{channels}"] = duck("evt mix", ",\nm AS MATERIALIZED (FROM mix), f AS MATERIALIZED " + _fit_sql("m", channels, 4, 4, None, "64", _H)
        + f"\nSELECT (ty * 4 + dy)::INT AS y, (tx * 4 + dx)::INT AS x, {', '.join(map(blend, channels))} FROM f {joins}, range(4) a(dy), range(4) b(dx)")


for _channels in ("rg", "gb", "rb", "r", "g", "b"):
    _subset_decode(_channels)


@query("op_a14_pass_totals", duck("evt mix", _MIX + "\nSELECT coalesce(p, 'all') AS technique, coalesce(t, 'all') AS tile, count(*) AS tiles, sum(s)::BIGINT AS pixels FROM (SELECT pass::VARCHAR AS p, (tw * th)::VARCHAR AS t, tw * th AS s FROM casc) GROUP BY ROLLUP (p, t)"))
def _(spark, sf):
    tiles = _mix_cascade(spark, sf)[1]
    size = (F.col("tw") * F.col("th")).cast("long")
    return stats.pass_totals(tiles.select(F.col("pass").alias("technique"), size.cast("int").alias("tile"), size.alias("pixels")))


@query("op_io16_pass_stats", ORACLES["op_a14_pass_totals"])
def _(spark, sf):
    """Figures of the cascade's passes from their own jobs, appended to a folder and read back."""
    image, where = mixed_image(spark, sf), codec_scratch(spark)
    run = pass_stats.PassStats()
    gradient.cascade(image, RGB, WIDTH, _height(image), observe=run.observe)
    run.append(spark, where)
    return pass_stats.totals(pass_stats.read_stats(spark, where))


# ---- point tables

_FREE = "(r + g) % 5 > 0"
_PLACES = f""",
t AS (SELECT y // 8 AS ty, x // 8 AS tx, min(r) FILTER ({_FREE}) AS r0, max(r) FILTER ({_FREE}) AS r1, min(g) FILTER ({_FREE}) AS g0, max(g) FILTER ({_FREE}) AS g1,
      min(b) FILTER ({_FREE}) AS b0, max(b) FILTER ({_FREE}) AS b1, count(*) AS n, count(*) FILTER ({_FREE}) AS cnt FROM mix GROUP BY ALL),
pl AS MATERIALIZED (SELECT ty, tx, y, x, r, g, b, r0, r1, g0, g1, b0, b1, """ + ", ".join(
    f"trunc(((({n} - {n}0) * (CASE WHEN {n}1 > {n}0 THEN 1048576 // greatest({n}1 - {n}0, 1) ELSE 0 END))::FLOAT / 1048576.0::FLOAT)::FLOAT * 63.0::FLOAT)::INT AS i{k}" for n, k in zip("rgb", "xyz", strict=True)) + f"""
 FROM mix JOIN t ON ty = y // 8 AND tx = x // 8 WHERE {_FREE} AND n = 64 AND cnt > 0 AND (r1 > r0)::INT + (g1 > g0)::INT + (b1 > b0)::INT >= 2)"""  # fmt: skip
_FACTORS = """,
fa AS (SELECT lut_id, (6 - s)::INT AS depth, (idx // (1 << s))::INT AS idx, x * 128 // 63 AS fx, y * 128 // 63 AS fy, z * 128 // 63 AS fz FROM lut, range(4) t(s) WHERE idx % (1 << s) = 0)"""
_MODES = ",\nmo AS (SELECT * FROM (VALUES " + ", ".join(f"({m}, '{o}', {m & 1}, {m >> 1 & 1}, {m >> 2 & 1})" for m, o in enumerate(lut.SCORED_ORDER)) + ") v(mode, ord, f0, f1, f2))"


def _axis(order: str, k: int, names) -> str:
    """The k-th coordinate after swapping, by the letter of the order there."""
    return f"CASE substr({order}, {k + 1}, 1) WHEN 'x' THEN {names[0]} WHEN 'y' THEN {names[1]} ELSE {names[2]} END"


def _near(name: str, cells: str) -> str:
    """CTE with dist and the nearest entries of the cells of a relation (cx, cy, cz)."""
    d = "((c.cx - l.x) ** 2 + (c.cy - l.y) ** 2 + (c.cz - l.z) ** 2)::INT"
    parts = ", ".join(f"(min({d} * 64 + idx) FILTER (idx % {1 << s} = 0) % 64 // {1 << s})::INT AS i{6 - s}" for s in range(4))
    return f",\n{name} AS MATERIALIZED (SELECT lut_id, cx, cy, cz, (min({d} * 64 + idx) FILTER (idx % 8 = 0) // 64)::INT AS dist, {parts} FROM (SELECT DISTINCT cx, cy, cz FROM {cells}) c, lut l GROUP BY lut_id, cx, cy, cz)"


_SCORES = _MODES + """,
cn AS (SELECT ty, tx, ix, iy, iz, count(*) AS n FROM pl GROUP BY ALL),
tu AS (SELECT ty, tx, mode, n, f0, f1, f2, """ + ", ".join(f"{_axis('ord', k, ('ix', 'iy', 'iz'))} AS t{k}" for k in range(3)) + """ FROM cn, mo),
at_ AS MATERIALIZED (SELECT ty, tx, mode, n, """ + ", ".join(f"CASE WHEN f{k} = 1 THEN 63 - t{k} ELSE t{k} END AS c{a}" for k, a in enumerate("xyz")) + " FROM tu)" + _near("nd", "at_") + """,
su AS (SELECT ty, tx, lut_id, mode, sum(dist * n) AS score FROM at_ JOIN nd USING (cx, cy, cz) GROUP BY ALL),
sc AS MATERIALIZED (SELECT ty, tx, lut_id, mode, score::BIGINT AS score FROM su QUALIFY row_number() OVER (PARTITION BY ty, tx, lut_id ORDER BY score, mode) = 1)"""  # fmt: skip
_ORD = "(['xyz', 'xzy', 'yxz', 'yzx', 'zxy', 'zyx'])[(mode >> 3) + 1]"


def _turned_sql(source: str) -> str:
    rel = [f"((({n} - {n}0)::FLOAT / greatest({n}1 - {n}0, 1))::FLOAT * 63.0::FLOAT)" for n in "rgb"]
    flip = [f"trunc(CASE WHEN mode & {1 << k} <> 0 THEN 63.0::FLOAT - {v} ELSE {v} END)::INT" for k, v in enumerate(rel)]
    return f"""(SELECT ty, tx, y, x, r, g, b, r0, r1, g0, g1, b0, b1, lut_id, mode, depth, {", ".join(f"{_axis(_ORD, k, ('q0', 'q1', 'q2'))} AS c{a}" for k, a in enumerate("xyz"))}
 FROM (SELECT *, {", ".join(f"{v} AS q{k}" for k, v in enumerate(flip))} FROM {source}))"""


_SEARCH = _FACTORS + f",\ntp AS MATERIALIZED {_turned_sql('(SELECT pl.*, lut_id, mode, 0 AS depth FROM pl JOIN sc USING (ty, tx))')}" + _near("ne", "tp") + """,
lo AS (SELECT tp.* EXCLUDE (depth), d AS depth, CASE d WHEN 6 THEN i6 WHEN 5 THEN i5 WHEN 4 THEN i4 ELSE i3 END AS idx FROM tp JOIN ne USING (lut_id, cx, cy, cz), range(3, 7) t(d)),
fl AS (SELECT lo.*, """ + ", ".join(f"CASE WHEN mode & {1 << k} <> 0 THEN 128 - f{a} ELSE f{a} END AS e{k}" for k, a in enumerate("xyz")) + """ FROM lo JOIN fa USING (lut_id, depth, idx)),
er AS (SELECT *, greatest(""" + ", ".join(f"abs({n}0 + ({_axis(_ORD, k, ('e0', 'e1', 'e2'))}) * ({n}1 - {n}0) // 128 - {n})" for k, n in enumerate("rgb")) + """) AS e FROM fl),
dp AS (SELECT ty, tx, lut_id, mode, depth, count(*) FILTER (e > 5) AS bad, sum(e) AS err FROM er GROUP BY ALL),
sv AS (SELECT * FROM dp WHERE bad <= 3 QUALIFY row_number() OVER (PARTITION BY ty, tx, lut_id ORDER BY depth) = 1),
ch AS MATERIALIZED (SELECT ty, tx, lut_id, mode, depth::INT AS depth, err::BIGINT AS err FROM sv QUALIFY row_number() OVER (PARTITION BY ty, tx ORDER BY err, lut_id DESC) = 1)"""  # fmt: skip


def _places(spark, sf):
    return lut.normalised(mixed_image(spark, sf), RGB, (F.col("r") + F.col("g")) % 5 > 0, 8, 8)


_VECTORS = ",\nlut AS (FROM vbank)"


@query("op_e16_table_factors", duck("emb vbank", _VECTORS + _FACTORS + "\nSELECT lut_id, depth, idx, fx, fy, fz FROM fa"))
def _(spark, sf):
    return lut.factors(vector_bank(spark, sf))


@query("op_j6_nearest_entries", duck("evt mix lut", _PLACES + _near("n", "(SELECT ix AS cx, iy AS cy, iz AS cz FROM pl)") + "\nSELECT lut_id, cx, cy, cz, dist, i6, i5, i4, i3 FROM n"))
def _(spark, sf):
    """For every cell that a pixel of the image lies in."""
    wanted = _places(spark, sf).select(F.col("ix").alias("cx"), F.col("iy").alias("cy"), F.col("iz").alias("cz")).distinct()
    return lut.cells(lut_bank(spark), wanted)


@query("op_p14_table_places", duck("evt mix", _PLACES + "\nSELECT ty, tx, y, x, ix, iy, iz FROM pl"))
def _(spark, sf):
    return _places(spark, sf).select("ty", "tx", "y", "x", "ix", "iy", "iz")


@query("op_a13_cube_occupancy", duck("evt mix", _PLACES + "\nSELECT ix, iy, iz, count(*) AS cnt FROM pl GROUP BY ALL"))
def _(spark, sf):
    return lut.occupancy(_places(spark, sf))


@query("op_a10_mode_scores", duck("evt mix lut", _PLACES + _SCORES + "\nSELECT ty, tx, lut_id, mode, score FROM sc"))
def _(spark, sf):
    return lut.scores(_places(spark, sf), lut_bank(spark))


@query("op_e5_table_search", duck("evt mix lut", _PLACES + _SCORES + _SEARCH + "\nSELECT ty, tx, lut_id, mode, depth, err FROM ch"))
def _(spark, sf):
    return lut.search(_places(spark, sf), RGB, lut_bank(spark))


@query("op_d8_table_decode", duck("evt mix lut", _PLACES + _SCORES + _SEARCH + f",\ntd AS {_turned_sql('(SELECT pl.*, lut_id, mode, depth FROM pl JOIN ch USING (ty, tx))')}" + _near("nx", "td") + """,
xi AS (SELECT td.*, CASE depth WHEN 6 THEN i6 WHEN 5 THEN i5 WHEN 4 THEN i4 ELSE i3 END AS idx FROM td JOIN nx USING (lut_id, cx, cy, cz)),
sw AS (SELECT xi.*, """ + ", ".join(f"{_axis(_ORD, k, ('fx', 'fy', 'fz'))} AS s{k}" for k in range(3)) + """ FROM xi JOIN fa USING (lut_id, depth, idx))
SELECT y, x, """ + ", ".join(f"({n}0 + (((CASE WHEN mode & {1 << k} <> 0 THEN 128 - s{k} ELSE s{k} END) * ({n}1 - {n}0)) >> 7))::INT AS {n}" for k, n in enumerate("rgb")) + " FROM sw"))  # fmt: skip
def _(spark, sf):
    places, bank = _places(spark, sf), lut_bank(spark)
    return lut.decode(places, gradient.checkpointed(lut.search(places, RGB, bank)), RGB, bank)


def _streams_sql() -> str:
    from tilewright.functions.scalar import bitmap_layout
    from tilewright.operators.streams import BOXES, MAPS, RATE, WORDS

    two = "printf('%02X', {})".format
    scaled = " || ".join(two(f"({n}{k} * {RATE} + 127) // 255") for k in (0, 1) for n in "rgb")
    bits = {s: bitmap_layout(*s) for s in MAPS}
    sizes = {s: -(-64 // w) * -(-64 // h) * n // 8 for s, (w, h, n) in bits.items()}
    empty = ", ".join(f"({MAPS[s]}, {n})" for s, n in sizes.items() if s != (8, 8))
    return f""",
td AS {_turned_sql('(SELECT pl.*, lut_id, mode, depth FROM pl JOIN ch USING (ty, tx))')}""" + _near("nx", "td") + f""",
xi AS MATERIALIZED (SELECT td.*, CASE depth WHEN 6 THEN i6 WHEN 5 THEN i5 WHEN 4 THEN i4 ELSE i3 END AS idx, (ty // 8)::INT AS image_id, ty % 8 * 8 + tx AS pos FROM td JOIN nx USING (lut_id, cx, cy, cz)),
ts AS MATERIALIZED (SELECT DISTINCT image_id, pos, lut_id, mode, depth, r0, g0, b0, r1, g1, b1, mode + lut_id * 64 + (depth - 3) * 16384 AS word FROM xi),
im AS (SELECT DISTINCT image_id FROM ts),
mb AS (SELECT image_id, b AS byte, coalesce(sum(1 << (pos % 8)::INT) FILTER (pos // 8 = b), 0)::INT AS v FROM ts, range({sizes[8, 8]}) t(b) GROUP BY ALL)
SELECT image_id, (depth - 3)::INT AS stream, string_agg({two("idx * 3")}, '' ORDER BY pos, y, x) AS hex FROM xi GROUP BY image_id, depth
UNION ALL SELECT image_id, {WORDS}, string_agg({two("word & 255")} || {two("word >> 8")}, '' ORDER BY pos) FROM ts GROUP BY image_id
UNION ALL SELECT image_id, {BOXES}, string_agg({scaled}, '' ORDER BY pos) FROM ts GROUP BY image_id
UNION ALL SELECT image_id, {MAPS[8, 8]}, string_agg({two("v")}, '' ORDER BY byte) FROM mb GROUP BY image_id
UNION ALL SELECT image_id, k, repeat('00', n) FROM im, (VALUES {empty}) e(k, n)"""


@query("op_e4_table_streams", duck("evt mix lut", _PLACES + _SCORES + _SEARCH + _streams_sql()))
def _(spark, sf):
    """The twelve streams of a chunk of tables for images of 64 rows whose tiles of 8 x 8 take tables."""
    places, bank = _places(spark, sf), lut_bank(spark)
    held = lut.entries(places, gradient.checkpointed(lut.search(places, RGB, bank)), RGB, bank)
    named = held.select(
        idiv("ty", 8).cast("int").alias("image_id"), F.lit(2).alias("pass"), F.lit(8).alias("tw"), F.lit(8).alias("th"), (F.col("ty") % 8).alias("ty"), "tx", (F.col("y") % 64).alias("y"), "x",
        "lut_id", "mode", "depth", "idx", *[f"{n}{k}" for n in RGB for k in (0, 1)],
    )
    parts = streams.blocks(streams.table_streams(gradient.checkpointed(named), RGB, 64, 64), ["image_id", "stream"])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("block", "data"))), lambda s: F.hex(s["data"]))
    return parts.groupBy("image_id", "stream").agg(F.array_join(listed, "").alias("hex"))


@query("op_t3_palette_order", duck("emb vbank", """,
c AS (SELECT lut_id, x AS r, y AS g, z AS b, """ + " + ".join(f"((({n} >> {k}) & 1)::BIGINT << {3 * k + a})" for a, n in enumerate("xyz") for k in range(8)) + """ AS code FROM vbank)
SELECT lut_id, r, g, b, code, row_number() OVER (PARTITION BY lut_id ORDER BY code) - 1 AS idx FROM c"""))  # fmt: skip
def _(spark, sf):
    bank = vector_bank(spark, sf)
    return lut.palette_order(bank.select("lut_id", F.col("x").alias("r"), F.col("y").alias("g"), F.col("z").alias("b")), ["lut_id"])


@query("op_t4_palette_order_2d", duck("emb vbank", """,
c AS (SELECT lut_id, x, y, """ + " + ".join(f"((({n} >> {k}) & 1)::BIGINT << {3 * k + a})" for a, n in enumerate("xy") for k in range(8)) + """ AS code FROM vbank)
SELECT lut_id, x, y, code, row_number() OVER (PARTITION BY lut_id ORDER BY code) - 1 AS idx FROM c"""))  # fmt: skip
def _(spark, sf):
    return lut.palette_order_2d(vector_bank(spark, sf), ["x", "y"], ["lut_id"])


#: Tables of a file in the queries of files.
_FILE = 50


def _table_folder(spark, sf):
    """The folder of files that hold the tables of all vectors, _FILE in each."""
    where = codec_scratch(spark)
    scaled = lut.factors(vector_bank(spark, sf)).withColumn("file", idiv("lut_id", _FILE).cast("int")).withColumn("lut_id", (F.col("lut_id") % _FILE).cast("int"))
    write_files(tables.table_files(scaled), where)
    return where


@query("op_io8_table_file_modes", duck("emb vbank", _VECTORS + _FACTORS + ",\nmx AS (SELECT *, m::INT AS mode FROM fa, range(64) t(m)),\nsx AS (SELECT lut_id, depth, mode, idx, "
    + ", ".join(f"{_axis(_ORD, k, ('fx', 'fy', 'fz'))} AS s{k}" for k in range(3)) + " FROM mx),\nvx AS (SELECT lut_id, depth, mode, idx, "
    + ", ".join(f"(CASE WHEN mode >= 48 THEN 251 WHEN mode & {1 << k} <> 0 THEN 128 - s{k} ELSE s{k} END)::INT AS {a}" for k, a in enumerate("xyz")) + " FROM sx)\nSELECT lut_id, depth, mode, "
    + ", ".join(f"string_agg(printf('%02X', {a}), '' ORDER BY idx) AS {a}" for a in "xyz") + " FROM vx GROUP BY ALL"))
def _(spark, sf):
    """Files of the tables of all vectors, read and laid out under all modes: the runs of each axis."""
    read = tables.read_table_files(spark, _table_folder(spark, sf)).where("error is null")
    named = read.withColumn("lut_id", (F.regexp_extract("path", r"(\d+)\.lut$", 1).cast("int") * _FILE + F.col("lut_id")).cast("int")).drop("path", "error")
    return tables.expanded_runs(named)


@query("op_t9_reduce_points", duck("emb vbank", "\nSELECT lut_id, (idx * 20 // 64)::INT AS idx, (sum(x) // count(*))::INT AS x, (sum(y) // count(*))::INT AS y, (sum(z) // count(*))::INT AS z FROM vbank GROUP BY lut_id, idx * 20 // 64"))
def _(spark, sf):
    return lut.reduce_points(vector_bank(spark, sf).withColumn("size", F.lit(64)), "size", 20, ["lut_id"])


@query("op_io9_table_file_runs", duck("emb vbank", _VECTORS + _FACTORS + f""",
ru AS (SELECT lut_id // {_FILE} AS file, depth, lut_id, string_agg(printf('%02X', fx), '' ORDER BY idx) || string_agg(printf('%02X', fy), '' ORDER BY idx) || string_agg(printf('%02X', fz), '' ORDER BY idx) AS data FROM fa GROUP BY ALL)
SELECT file::VARCHAR AS file, '4C554C3000' || printf('%02X', count(DISTINCT lut_id) - 1) || '0100' || string_agg(data, '' ORDER BY depth, lut_id) AS hex FROM ru GROUP BY file"""))
def _(spark, sf):
    """The bytes of the files of the tables of all vectors, as they lie in the folder."""
    files = spark.read.format("binaryFile").load(_table_folder(spark, sf))
    return files.select(F.regexp_extract("path", r"(\d+)\.lut$", 1).alias("file"), F.hex("content").alias("hex"))


# ---- two channels, and the table cascade

_PLACES_2 = f""",
t2 AS (SELECT y // 8 AS ty, x // 8 AS tx, min(r) FILTER ({_FREE}) AS r0, max(r) FILTER ({_FREE}) AS r1, min(g) FILTER ({_FREE}) AS g0, max(g) FILTER ({_FREE}) AS g1, count(*) AS n FROM mix GROUP BY ALL),
pl AS MATERIALIZED (SELECT ty, tx, y, x, r, g, r0, r1, g0, g1, """ + ", ".join(
    f"trunc(((({n} - {n}0) * (1048576 // ({n}1 - {n}0)))::FLOAT / 1048576.0::FLOAT)::FLOAT * 63.0::FLOAT)::INT AS i{k}" for n, k in zip("rg", "xy", strict=True)) + f"""
 FROM mix JOIN t2 ON ty = y // 8 AND tx = x // 8 WHERE {_FREE} AND n = 64 AND r1 > r0 AND g1 > g0),
l2 AS (SELECT lut_id, idx, x, y FROM lut),
cn AS (SELECT ty, tx, ix, iy, count(*) AS n FROM pl GROUP BY ALL),
tu AS (SELECT ty, tx, n, m::INT AS mode, CASE WHEN m & 4 <> 0 THEN iy ELSE ix END AS a, CASE WHEN m & 4 <> 0 THEN ix ELSE iy END AS b FROM cn, range(8) q(m)),
at2 AS MATERIALIZED (SELECT ty, tx, n, mode, CASE WHEN mode & 1 <> 0 THEN 63 - a ELSE a END AS cx, CASE WHEN mode & 2 <> 0 THEN 63 - b ELSE b END AS cy FROM tu),
nd AS MATERIALIZED (SELECT lut_id, cx, cy, min((c.cx - l.x) * (c.cx - l.x) + (c.cy - l.y) * (c.cy - l.y)) FILTER (idx % 8 = 0) AS dist FROM (SELECT DISTINCT cx, cy FROM at2) c, l2 l GROUP BY ALL),
su AS (SELECT ty, tx, lut_id, mode, sum(dist * n) AS score FROM at2 JOIN nd USING (cx, cy) GROUP BY ALL),
sc AS MATERIALIZED (SELECT ty, tx, lut_id, mode, score::BIGINT AS score FROM su QUALIFY row_number() OVER (PARTITION BY ty, tx, lut_id ORDER BY score, mode) = 1)"""  # fmt: skip


def _places_2d(spark, sf):
    return lut.normalised_2d(mixed_image(spark, sf), ["r", "g"], (F.col("r") + F.col("g")) % 5 > 0, 8, 8)


@query("op_a11_mode_scores_2d", duck("evt mix lut", _PLACES_2 + "\nSELECT ty, tx, lut_id, mode, score FROM sc"))
def _(spark, sf):
    return lut.scores_2d(_places_2d(spark, sf), lut_bank(spark))


_N2 = ", ".join(f"(min(((c.cx - l.x) * (c.cx - l.x) + (c.cy - l.y) * (c.cy - l.y)) * 64 + idx) FILTER (idx % {1 << s} = 0) % 64 // {1 << s})::INT AS i{6 - s}" for s in range(4))


def _search_2d_sql(depths: str = "range(3, 7) t(d)", far: int = 6) -> str:
    return f""",
tp AS MATERIALIZED (SELECT ty, tx, r, g, r0, r1, g0, g1, lut_id, mode, CASE WHEN mode & 4 <> 0 THEN q ELSE p END AS cx, CASE WHEN mode & 4 <> 0 THEN p ELSE q END AS cy FROM (SELECT pl.*, lut_id, mode,
 trunc(CASE WHEN mode & 1 <> 0 THEN 63.0::FLOAT - ((r - r0)::FLOAT / (r1 - r0))::FLOAT * 63.0::FLOAT ELSE ((r - r0)::FLOAT / (r1 - r0))::FLOAT * 63.0::FLOAT END)::INT AS p,
 trunc(CASE WHEN mode & 2 <> 0 THEN 63.0::FLOAT - ((g - g0)::FLOAT / (g1 - g0))::FLOAT * 63.0::FLOAT ELSE ((g - g0)::FLOAT / (g1 - g0))::FLOAT * 63.0::FLOAT END)::INT AS q FROM pl JOIN sc USING (ty, tx))),
ne AS MATERIALIZED (SELECT lut_id, cx, cy, {_N2} FROM (SELECT DISTINCT cx, cy FROM tp) c, l2 l GROUP BY lut_id, cx, cy),
lo AS (SELECT tp.*, d AS depth, CASE d WHEN 6 THEN i6 WHEN 5 THEN i5 WHEN 4 THEN i4 ELSE i3 END AS idx FROM tp JOIN ne USING (lut_id, cx, cy), {depths}),
fa AS (SELECT lut_id, 6 - s AS depth, idx // (1 << s) AS idx, x * 128 // 63 AS fx, y * 128 // 63 AS fy FROM lut, range(4) t(s) WHERE idx % (1 << s) = 0),
fl AS (SELECT lo.*, CASE WHEN mode & 1 <> 0 THEN 128 - fx ELSE fx END AS ex, CASE WHEN mode & 2 <> 0 THEN 128 - fy ELSE fy END AS ey FROM lo JOIN fa USING (lut_id, depth, idx)),
er AS (SELECT *, greatest(abs(r0 + (CASE WHEN mode & 4 <> 0 THEN ey ELSE ex END) * (r1 - r0) // 128 - r), abs(g0 + (CASE WHEN mode & 4 <> 0 THEN ex ELSE ey END) * (g1 - g0) // 128 - g)) AS e FROM fl),
dp AS (SELECT ty, tx, lut_id, mode, depth, sum(e) AS err FROM er GROUP BY ALL HAVING max(e) <= {far}),
sv AS (SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY ty, tx, lut_id ORDER BY depth) = 1),
c2 AS MATERIALIZED (SELECT ty, tx, lut_id, mode, depth::INT AS depth, err::BIGINT AS err FROM sv QUALIFY row_number() OVER (PARTITION BY ty, tx ORDER BY err, lut_id DESC) = 1)"""


@query("op_e8_table_search_2d", duck("evt mix lut", _PLACES_2 + _search_2d_sql() + "\nSELECT ty, tx, lut_id, mode, depth, err FROM c2"))
def _(spark, sf):
    return lut.search_2d(_places_2d(spark, sf), ["r", "g"], lut_bank(spark))


@query("op_d9_table_decode_2d", duck("evt mix lut", _PLACES_2 + _search_2d_sql() + f""",
d1 AS (SELECT y, x, r0, r1, g0, g1, c2.lut_id, c2.mode, c2.depth, CASE WHEN c2.mode & 4 <> 0 THEN q ELSE p END AS cx, CASE WHEN c2.mode & 4 <> 0 THEN p ELSE q END AS cy FROM (SELECT pl.*, lut_id AS l, mode AS m, depth AS d,
 trunc(CASE WHEN mode & 1 <> 0 THEN 63.0::FLOAT - ((r - r0)::FLOAT / (r1 - r0))::FLOAT * 63.0::FLOAT ELSE ((r - r0)::FLOAT / (r1 - r0))::FLOAT * 63.0::FLOAT END)::INT AS p,
 trunc(CASE WHEN mode & 2 <> 0 THEN 63.0::FLOAT - ((g - g0)::FLOAT / (g1 - g0))::FLOAT * 63.0::FLOAT ELSE ((g - g0)::FLOAT / (g1 - g0))::FLOAT * 63.0::FLOAT END)::INT AS q FROM pl JOIN c2 USING (ty, tx)) JOIN c2 USING (ty, tx)),
d2 AS (SELECT d1.*, CASE depth WHEN 6 THEN i6 WHEN 5 THEN i5 WHEN 4 THEN i4 ELSE i3 END AS idx FROM d1 JOIN (SELECT lut_id, cx, cy, {_N2} FROM (SELECT DISTINCT cx, cy FROM d1) c, l2 l GROUP BY lut_id, cx, cy) USING (lut_id, cx, cy)),
d3 AS (SELECT d2.*, CASE WHEN mode & 4 <> 0 THEN fy ELSE fx END AS sx, CASE WHEN mode & 4 <> 0 THEN fx ELSE fy END AS sy FROM d2 JOIN fa USING (lut_id, depth, idx))
SELECT y, x, (r0 + (((CASE WHEN mode & 1 <> 0 THEN 128 - sx ELSE sx END) * (r1 - r0)) >> 7))::INT AS r, (g0 + (((CASE WHEN mode & 2 <> 0 THEN 128 - sy ELSE sy END) * (g1 - g0)) >> 7))::INT AS g FROM d3"""))
def _(spark, sf):
    places, bank = _places_2d(spark, sf), lut_bank(spark)
    return lut.decode_2d(places, gradient.checkpointed(lut.search_2d(places, ["r", "g"], bank)), ["r", "g"], bank)


_CHROMA = """,
ch_ AS (SELECT y, x, trunc((r - b) / 2)::INT AS r, g - (b + trunc((r - b) / 2)::INT) AS t FROM mix),
cc AS MATERIALIZED (SELECT y, x, r, trunc(t / 2)::INT AS g FROM ch_)""" + _PLACES_2.replace(_FREE, "true").replace("FROM mix", "FROM cc")


@query("op_e9_chroma_search", duck("evt mix lut", _CHROMA + _search_2d_sql("range(4, 7) t(d)", 3) + "\nSELECT ty, tx, lut_id, mode, least(depth, 5) AS depth, err FROM c2"))
def _(spark, sf):
    """Tiles of the two chroma planes: no pixel more than 3 off with 4, 5 or 6 bits; what needs 6 is named 5, as defined."""
    _, co, cg = rgb_to_ycocg("r", "g", "b")
    chroma = mixed_image(spark, sf).select("y", "x", co.cast("int").alias("co"), cg.cast("int").alias("cg"))
    places = lut.normalised_2d(chroma, ["co", "cg"], F.lit(True), 8, 8)
    return lut.search_2d(places, ["co", "cg"], lut_bank(spark), 3, (6, 5, 4)).withColumn("depth", F.least("depth", F.lit(5)))


def _cascade_pass_sql(k: int, tw: int, th: int) -> str:
    """The search of one size over the pixels that are free before it (fr{k}), as CTEs with names of their own, and the pixels that are free after it."""
    text = _PLACES.replace(_FREE, "free").replace("y // 8", f"y // {th}").replace("x // 8", f"x // {tw}").replace("n = 64", f"n = {tw * th}").replace("FROM mix", f"FROM fr{k}")
    text += _SCORES.replace(_MODES, "") + _SEARCH.replace(_FACTORS, "")
    for name in ("pl", "cn", "tu", "at_", "nd", "su", "sc", "tp", "ne", "lo", "fl", "er", "dp", "sv", "ch"):
        text = re.sub(rf"\b{name}\b", f"{name}{k}", text)
    text = text.replace("\nt AS (", f"\nt{k} AS MATERIALIZED (").replace("JOIN t ON", f"JOIN t{k} ON")
    return text + f""",
fr{k + 1} AS MATERIALIZED (SELECT f.y, f.x, r, g, b, free AND c.ty IS NULL AS free FROM fr{k} f LEFT JOIN ch{k} c ON c.ty = f.y // {th} AND c.tx = f.x // {tw})"""


_TABLE_CASCADE = ",\nfr0 AS MATERIALIZED (SELECT *, true AS free FROM mix)" + _MODES + _FACTORS + "".join(_cascade_pass_sql(k, tw, th) for k, (tw, th) in enumerate(lut.SIZES)) + "\n" + " UNION ALL ".join(
    f"SELECT {k} AS pass, {tw} AS tw, {th} AS th, ty, tx, lut_id, mode, depth, err FROM ch{k}" for k, (tw, th) in enumerate(lut.SIZES))


@query("op_e7_table_cascade", duck("evt mix lut", _TABLE_CASCADE))
def _(spark, sf):
    return lut.cascade(mixed_image(spark, sf), RGB, lut_bank(spark))


# ---- captured patterns

_ALL = _PLACES.replace(_FREE, "true").replace("x // 8", "x // 16").replace("n = 64", "n = 128")
_TILE = "(ty // 8)::INT::VARCHAR AS image_id, (tx * 16) || '-' || (ty % 8 * 8) AS name"


def _tile_places(spark, sf):
    """The normalised pixels of tiles of 16 x 8 of images of 64 rows."""
    places = lut.normalised(mixed_image(spark, sf), RGB, F.lit(True), 16, 8)
    return places.withColumn("image_id", idiv("ty", 8).cast("int")).withColumn("ty", F.col("ty") % 8).withColumn("y", F.col("y") % 64)


@query("op_io14_capture_files", duck("evt mix", _ALL + f"""
SELECT {_TILE}, printf('%02X', count(*)) || string_agg(printf('%02X', ix), '' ORDER BY y, x) || string_agg(printf('%02X', iy), '' ORDER BY y, x) || string_agg(printf('%02X', iz), '' ORDER BY y, x) AS hex FROM pl GROUP BY ty, tx"""))
def _(spark, sf):
    """Every tile worth a table as a file, as it lies in the folder."""
    where = codec_scratch(spark)
    captures.write_captures(_tile_places(spark, sf), where, 16, 8)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select("path", F.hex("content").alias("hex"))
    return captures.named(files)


_PATTERNS = _ALL + """,
mo AS (SELECT ty, tx, ix, iy, iz, """ + " + ".join(f"(((i{n} >> {k}) & 1)::BIGINT << {3 * k + a})" for a, n in enumerate("xyz") for k in range(8)) + """ AS code FROM pl),
rk AS (SELECT ty, tx, ix, iy, iz, row_number() OVER (PARTITION BY ty, tx ORDER BY code) - 1 AS n FROM mo)"""  # fmt: skip
_PATTERN_ROWS = f"\nSELECT {_TILE}, (n * 64 // 128)::INT AS idx, (sum(ix) // count(*))::INT AS x, (sum(iy) // count(*))::INT AS y, (sum(iz) // count(*))::INT AS z FROM rk GROUP BY ty, tx, n * 64 // 128"


@query("op_io10_captured_patterns", duck("evt mix", _PATTERNS + _PATTERN_ROWS))
def _(spark, sf):
    """The tables of all captured files: 128 points of each in the order of their bits, cut to 64."""
    where = codec_scratch(spark)
    captures.write_captures(_tile_places(spark, sf), where, 16, 8)
    return captures.named(captures.patterns(captures.read_captures(spark, where)))


@query("op_io13_folder_scan", duck("evt mix", _PATTERNS + _PATTERN_ROWS))
def _(spark, sf):
    """The same tables by two scans of a folder: files of even images are there at the first, the others come after it."""
    where, table, kept = codec_scratch(spark), codec_scratch(spark), codec_scratch(spark)
    places = gradient.checkpointed(_tile_places(spark, sf))
    for odd in (0, 1):
        captures.write_captures(places.where(F.col("image_id") % 2 == odd), where, 16, 8)
        found = captures.scan_captures(spark, where, table, kept)
    return captures.named(found.drop("batch"))


@query("op_io11_drawn_patterns", duck("emb", """,
k AS (SELECT y // 64 AS image_id, y % 64 AS py, x AS px, row_number() OVER (PARTITION BY y // 64 ORDER BY y, x) - 1 AS n FROM emb WHERE v >= 170),
s AS (SELECT *, """ + " + ".join(f"(((p{n} >> {k}) & 1)::BIGINT << {3 * k + a})" for a, n in enumerate("xy") for k in range(8)) + """ AS code FROM k WHERE n < 64)
SELECT image_id::VARCHAR AS image_id, (row_number() OVER (PARTITION BY image_id ORDER BY code) - 1)::INT AS idx, px AS x, py::INT AS y FROM s"""))  # fmt: skip
def _(spark, sf):
    """Images of 64 rows with the bright places of the plane drawn in, as patterns of two channels."""
    drawn = embedding_plane(spark, sf).select(idiv("y", 64).cast("string").alias("name"), (F.col("y") % 64).alias("y"), "x", F.when(F.col("v") >= 170, 255).otherwise(0).alias("v"))
    where = codec_scratch(spark)
    png.write_png(drawn, where, ["v"])
    found = captures.patterns(captures.image_patterns(png.read_png(spark, where).where("y is not null")), "xy")
    return found.select(png.name_of("path").alias("image_id"), "idx", "x", "y")


@query("op_io12_registered_banks", duck("evt mix", _PATTERNS + """,
pt AS (SELECT ty, tx, n * 64 // 128 AS idx, sum(ix) // count(*) AS x, sum(iy) // count(*) AS y, sum(iz) // count(*) AS z FROM rk GROUP BY ALL),
bk AS (SELECT (ty // 8)::INT::VARCHAR AS image_id, (dense_rank() OVER (PARTITION BY ty // 8 ORDER BY ty, tx) - 1)::INT AS lut_id, idx, x, y, z FROM pt)
SELECT image_id, lut_id, (6 - s)::INT AS depth, (idx // (1 << s))::INT AS idx, (x * 128 // 63)::INT AS fx, (y * 128 // 63)::INT AS fy, (z * 128 // 63)::INT AS fz FROM bk, range(4) t(s) WHERE idx % (1 << s) = 0"""))
def _(spark, sf):
    """The captured tiles of each image as its bank of tables, with their factors at all depths."""
    where = codec_scratch(spark)
    captures.write_captures(_tile_places(spark, sf), where, 16, 8)
    bank = captures.banks(captures.named(captures.patterns(captures.read_captures(spark, where))))
    whole = bank.withColumn("lut_id", F.struct("image_id", "lut_id"))
    return lut.factors(whole).select("lut_id.image_id", "lut_id.lut_id", "depth", "idx", "fx", "fy", "fz")


_CLOUD = "trunc(((({n} - {n}0) * (CASE WHEN {n}1 > {n}0 THEN 1048576 // greatest({n}1 - {n}0, 1) ELSE 0 END))::FLOAT / 1048576.0::FLOAT)::FLOAT * 255.0::FLOAT)::INT AS {a}_"


@query("op_io15_tile_clouds", duck("evt mix", _PLACES.replace(_FREE, "true") + ",\npc AS (SELECT ty, tx, y, x, r || ',' || g || ',' || b AS rgb, " + ", ".join(_CLOUD.format(n=n, a=a) for n, a in zip("rgb", "xyz", strict=True)) + " FROM pl),\nli AS (SELECT ty, tx, y, x, "
    + " || ".join(f"(x_ + {dx}) || ',' || (y_ + {dy}) || ',' || (z_ + {dz}) || ',' || rgb || chr(10)" for dy in (-1, 0, 1) for dx in (-1, 0, 1) for dz in (-1, 0, 1)) + " AS s FROM pc),\ntx_ AS (SELECT ty, tx, "
    + " || ".join(f"'{x},{y},{z},255,255,255' || chr(10)" for z in (0, 255) for y in (0, 255) for x in (0, 255)) + " || string_agg(s, '' ORDER BY y, x) AS t FROM li GROUP BY ty, tx)\n"
    + "SELECT (ty // 8)::INT::VARCHAR AS image_id, (tx * 8) || '-' || (ty % 8 * 8) AS name, strlen(t)::BIGINT AS bytes, md5(t) AS digest FROM tx_"))
def _(spark, sf):
    """The points of every tile worth a table as text files, as they lie in the folder: their lengths and digests."""
    places = lut.normalised(mixed_image(spark, sf), RGB, F.lit(True), 8, 8)
    places = places.withColumn("image_id", idiv("ty", 8).cast("int")).withColumn("ty", F.col("ty") % 8).withColumn("y", F.col("y") % 64)
    where = codec_scratch(spark)
    write_files(captures.cloud_files(places, RGB, 8, 8), where)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select("path", F.col("length").alias("bytes"), F.md5("content").alias("digest"))
    return captures.named(files)
