"""Queries of the PNG source and sink: images made of the given tables are written to a folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions.scalar import idiv, rgb_to_ycocg
from tilewright.plans.codec import scratch
from tilewright.sources import png
from tilewright.sources.rasters import duck, embedding_plane, mixed_image

QUERIES: dict = {}
ORACLES: dict = {}
#: Rows of an image; two bands of the writer.
TALL = 2 * png.BAND


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


def _cut(frame, *columns):
    """Pixels of images of TALL rows: image k holds rows TALL * k and on."""
    return frame.select(F.concat(F.lit("p"), idiv("y", TALL)).alias("name"), (F.col("y") % TALL).cast("int").alias("y"), "x", *columns)


_CUT = f"'p' || y // {TALL} AS name, (y % {TALL})::INT AS y, x"


def _pixels(spark, where):
    return png.read_png(spark, where).select(png.name_of("path").alias("name"), "width", "height", "channels", "y", "x", "r", "g", "b", "a")


def _round_trip(spark, pixels, channels, signed=()):
    where = scratch(spark)
    png.write_png(pixels, where, channels, signed)
    return _pixels(spark, where)


_SIZES = f", 64 AS width, least({TALL}, max(y) OVER () + 1 - y // {TALL} * {TALL})::INT AS height"


@query("op_io1_png_pixels", duck("evt mix", f"\nSELECT {_CUT}{_SIZES}, 4 AS channels, r, g, b, (255 - (x + y) % 256)::INT AS a FROM mix"))
def _(spark, sf):
    image = mixed_image(spark, sf).withColumn("a", (F.lit(255) - (F.col("x") + F.col("y")) % 256).cast("int"))
    return _round_trip(spark, _cut(image, "r", "g", "b", "a"), ["r", "g", "b", "a"])


@query("op_io3_plane_png", duck("emb", f"\nSELECT {_CUT}{_SIZES}, 1 AS channels, v AS r, v AS g, v AS b, NULL::INT AS a FROM emb"))
def _(spark, sf):
    return _round_trip(spark, _cut(embedding_plane(spark, sf), "v"), ["v"])


_YCOCG = """,
t AS (SELECT y AS row_, x, r - b AS co, r, g, b FROM mix), u AS (SELECT *, b + trunc(co / 2)::INT AS t FROM t), w AS (SELECT *, g - t AS cg FROM u)"""


@query("op_io4_ycocg_png", duck("evt mix", _YCOCG + f""",
z AS (SELECT row_ AS y, x, least(255, greatest(0, t + trunc(cg / 2)::INT))::INT AS r, least(255, greatest(0, trunc(co / 2)::INT + 128))::INT AS g, least(255, greatest(0, trunc(cg / 2)::INT + 128))::INT AS b FROM w)
SELECT {_CUT}{_SIZES}, 3 AS channels, r, g, b, NULL::INT AS a FROM z"""))  # fmt: skip
def _(spark, sf):
    """Luma and chroma in the three channels, chroma moved up by 128."""
    luma, co, cg = rgb_to_ycocg("r", "g", "b")
    planes = mixed_image(spark, sf).select("y", "x", luma.alias("l"), co.alias("co"), cg.alias("cg"))
    return _round_trip(spark, _cut(planes, "l", "co", "cg"), ["l", "co", "cg"], ("co", "cg"))


def _filters_sql() -> str:
    """The filter of each row: a CTE of the neighbours, what each filter leaves, and the least sum."""
    near = ", ".join(f"lag({k}, 1, 0) OVER a AS {k}l, CASE WHEN y % {png.BAND} = 0 THEN 0 ELSE lag({k}, 1, 0) OVER u END AS {k}u" for k in "rgb")
    corner = ", ".join(f"lag({k}u, 1, 0) OVER a AS {k}c" for k in "rgb")
    left, up, edge = "abs({k}u - {k}c)", "abs({k}l - {k}c)", "abs({k}l + {k}u - 2 * {k}c)"
    guess = [
        "0", "{k}l", "{k}u", "({k}l + {k}u) // 2",
        f"CASE WHEN {left} <= {up} AND {left} <= {edge} THEN {{k}}l WHEN {up} <= {edge} THEN {{k}}u ELSE {{k}}c END",
    ]
    rest = lambda f, k: f"(({k} - ({guess[f].format(k=k)})) & 255)"
    signed = lambda f: " + ".join(f"least({rest(f, k)}, 256 - {rest(f, k)})" for k in "rgb")
    cases = " UNION ALL ".join(f"SELECT y, {f} AS filter, sum({signed(f)}) AS cost FROM c3" + (f" WHERE y % {png.BAND} > 0" if f > 1 else "") + " GROUP BY y" for f in range(5))
    return f""",
c1 AS (SELECT * FROM mix),
c2 AS (SELECT y, x, r, g, b, {near} FROM c1 WINDOW a AS (PARTITION BY y ORDER BY x), u AS (PARTITION BY x ORDER BY y)),
c3 AS MATERIALIZED (SELECT *, {corner} FROM c2 WINDOW a AS (PARTITION BY y ORDER BY x)),
s AS ({cases})
SELECT 'p' || y // {TALL} AS name, (y % {TALL})::INT AS y, arg_min(filter, cost * 8 + filter)::INT AS filter FROM s GROUP BY s.y"""


@query("op_io2_png_filters", duck("evt mix", _filters_sql()))
def _(spark, sf):
    """The filter that each scanline of the written files has."""
    where = scratch(spark)
    png.write_png(_cut(mixed_image(spark, sf), "r", "g", "b"), where, ["r", "g", "b"])
    return png.read_filters(spark, where).select(png.name_of("path").alias("name"), "y", "filter")


_GROUP = 640


@query("op_io5_refused_sizes", f"""
WITH g AS (SELECT event_id // {_GROUP} AS k, event_id % {_GROUP} AS i FROM events),
s AS (SELECT k, (16 + k % 3 * 4)::INT AS width, max(i) AS last FROM g GROUP BY k),
z AS (SELECT k, (CASE WHEN last < width THEN last + 1 ELSE width END)::INT AS width, (last // width + 1)::INT AS height FROM s)
SELECT 'p' || k AS name, width, height, 1 AS channels, (width * height * (width % 8 = 0 AND height % 8 = 0)::INT)::BIGINT AS pixels,
       CASE WHEN width % 8 = 0 AND height % 8 = 0 THEN NULL ELSE 'INVALID_SIZE: ' || width || ' x ' || height || ' is no multiple of 8' END AS error FROM z""")  # fmt: skip
def _(spark, sf):
    """Images of three widths, a file for each 640 events; those with a side that is no multiple of 8 are refused, the others are read."""
    k, i = idiv("event_id", _GROUP), F.col("event_id") % _GROUP
    events = spark.read.parquet(f"{sf}/events.parquet").select(k.alias("k"), i.alias("i"), (F.floor("value") % 256).alias("v"))
    width = F.col("k") % 3 * 4 + 16
    pixels = events.select(F.concat(F.lit("p"), "k").alias("name"), idiv("i", width).alias("y"), (F.col("i") % width).alias("x"), "v")
    where = scratch(spark)
    png.write_png(pixels, where, ["v"])
    read = png.read_png(spark, where)
    return read.groupBy(png.name_of("path").alias("name"), "width", "height", "channels", "error").agg(F.count("y").alias("pixels"))
