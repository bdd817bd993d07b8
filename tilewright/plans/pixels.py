"""Queries of masks, statistics, windows, set operations and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions.scalar import idiv
from tilewright.operators import flatmaps, masks, resample, stats, windows
from tilewright.sources.rasters import blank_images, duck, embedding_plane, event_image, large_components_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


_SIGNS = {"EQ": "=", "NEQ": "<>", "LT": "<", "GT": ">", "LE": "<=", "GE": ">="}


#: Odd bands of 64 rows have a mask, the others have none.
@query("op_p16_default_mask", duck("emb", "\nSELECT (y // 64)::INT AS image_id, (y % 64)::INT AS y, x, CASE WHEN y // 64 % 2 = 0 OR v > 128 THEN 255 ELSE 0 END AS m FROM emb"))
def _(spark, sf):
    plane = embedding_plane(spark, sf).select(idiv("y", 64).cast("int").alias("image_id"), (F.col("y") % 64).cast("int").alias("y"), "x", "v")
    return masks.mask_or_all(plane, plane.where("image_id % 2 = 1").withColumn("m", masks.mask("v", "GT", 128)))


@query("op_p1_threshold_masks", duck("emb", "\nSELECT y, x, " + ", ".join(f"CASE WHEN v {s} 128 THEN 255 ELSE 0 END AS {k.lower()}" for k, s in _SIGNS.items()) + " FROM emb"))
def _(spark, sf):
    return embedding_plane(spark, sf).select("y", "x", *[masks.mask("v", k, 128).alias(k.lower()) for k in _SIGNS])


@query("op_p2_plane_compare", duck("evt", "\nSELECT y, x, " + ", ".join(f"CASE WHEN r {s} g THEN 255 ELSE 0 END AS {k.lower()}" for k, s in _SIGNS.items()) + ", CASE WHEN r <> 0 AND g <> 0 THEN 255 ELSE 0 END AS a FROM evt"))
def _(spark, sf):
    return event_image(spark, sf).select("y", "x", *[masks.mask("r", k, "g").alias(k.lower()) for k in _SIGNS], masks.mask("r", "AND", "g").alias("a"))


@query("op_p3_channel_masks", duck("evt", "\nSELECT y, x, CASE WHEN r > 100 AND g > 50 AND b > 20 THEN 255 ELSE 0 END AS every, CASE WHEN r > 100 OR g > 50 OR b > 20 THEN 255 ELSE 0 END AS some FROM evt"))
def _(spark, sf):
    return event_image(spark, sf).select("y", "x", *[masks.channel_mask(["r", "g", "b"], "GT", [100, 50, 20], k == "every").alias(k) for k in ("every", "some")])


@query("op_p4_remove_mask", duck("evt", "\nSELECT y, x, r FROM evt WHERE NOT g >= 128"))
def _(spark, sf):
    image = event_image(spark, sf)
    return masks.subtract(image.select("y", "x", "r"), image.where("g >= 128").select("y", "x"))


@query("op_p5_p6_fill", duck("emb", "\nSELECT y, x, CASE WHEN x BETWEEN 8 AND 39 AND y BETWEEN 16 AND 55 THEN 7 ELSE v END AS f, CASE WHEN x BETWEEN 8 AND 39 AND y BETWEEN 16 AND 55 THEN v ELSE 0 END AS o FROM emb"))
def _(spark, sf):
    return embedding_plane(spark, sf).select("y", "x", masks.fill("v", (8, 16, 32, 40), 7).alias("f"), masks.fill_outside("v", (8, 16, 32, 40)).alias("o"))


@query("op_p7_create_image", """
WITH s AS (SELECT s_suppkey::INT AS image_id, (8 + s_suppkey % 3 * 8)::INT AS width, (8 + s_nationkey % 2 * 8)::INT AS height, (s_suppkey % 256)::INT AS v FROM supplier)
SELECT image_id, h.i::INT AS y, w.i::INT AS x, v AS r, v AS g, v AS b FROM s, range(16) h(i), range(24) w(i) WHERE h.i < height AND w.i < width""")
def _(spark, sf):
    """An image of its own size and value for each supplier."""
    table = spark.read.parquet(f"{sf}/supplier.parquet")
    sizes = table.select(F.col("s_suppkey").cast("int").alias("image_id"), (F.col("s_suppkey") % 3 * 8 + 8).cast("int").alias("width"), (F.col("s_nationkey") % 2 * 8 + 8).cast("int").alias("height"), (F.col("s_suppkey") % 256).cast("int").alias("value"))
    return blank_images(sizes, ["r", "g", "b"])


@query("op_p8_clamped_read", duck("emb", """,
h AS (SELECT max(y) + 1 AS rows FROM emb),
w AS (SELECT ((i // 80) * 7 - 5)::INT AS y, (i % 80 - 8)::INT AS x, rows FROM (SELECT unnest(range(80 * (rows // 7 + 3))) AS i, rows FROM h))
SELECT w.y, w.x, v, NOT (w.y BETWEEN 0 AND rows - 1 AND w.x BETWEEN 0 AND 63) AS outside FROM w JOIN emb e ON e.y = greatest(0, least(rows - 1, w.y)) AND e.x = greatest(0, least(63, w.x))"""))
def _(spark, sf):
    """Every seventh line from above the whole plane to below it."""
    plane = embedding_plane(spark, sf)
    height = plane.agg((F.max("y") + 1).alias("rows")).first().rows or 0
    wanted = spark.range(80 * (height // 7 + 3)).select((idiv("id", 80) * 7 - 5).cast("int").alias("y"), (F.col("id") % 80 - 8).cast("int").alias("x"))
    return masks.clamped_read(plane, wanted, 64, height)


@query("op_p9_quarter_all", duck("emb", "\nSELECT y // 2 AS y, x // 2 AS x, CASE WHEN min(v >= 100) THEN 255 ELSE 0 END AS m FROM emb GROUP BY ALL"))
def _(spark, sf):
    return masks.quarter_all(embedding_plane(spark, sf).withColumn("m", (F.col("v") >= 100).cast("int")))


@query("op_p10_erosion", duck("emb", ",\nb AS MATERIALIZED (SELECT (y // 64)::INT AS image_id, (y % 64)::INT AS y, x, v >= 128 AS m FROM emb),\nsr AS (SELECT image_id, y, x FROM b WHERE m)," + large_components_sql("sr") + """
SELECT b.image_id, b.y, b.x, CASE WHEN keep.y IS NOT NULL THEN 255 ELSE 0 END AS m FROM b LEFT JOIN keep ON keep.image_id = b.image_id AND keep.y = b.y AND keep.x = b.x"""))
def _(spark, sf):
    """Bright places of the plane, as masks of 64 rows each. Lone pixels and pairs are components of at most 50, so what stays is what lies in larger ones."""
    plane = embedding_plane(spark, sf)
    bright = plane.select(idiv("y", 64).cast("int").alias("image_id"), (F.col("y") % 64).cast("int").alias("y"), "x", F.when(F.col("v") >= 128, 255).otherwise(0).alias("m"))
    return masks.erode(bright, ["image_id"])


@query("op_p11_components", duck("emb", """,
s AS MATERIALIZED (SELECT y, x, y * 64 + x AS k FROM emb WHERE v >= 150),
h AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON b.k = a.k + 64 UNION ALL SELECT a.k, b.k FROM s a JOIN s b ON b.k = a.k + 1 WHERE a.x < 63),
e AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
w AS (SELECT k, k AS l FROM s UNION SELECT e.b, w.l FROM w JOIN e ON e.a = w.k),
c AS (SELECT k, min(l) AS l FROM w GROUP BY k),
z AS (SELECT l, count(*) AS size FROM c GROUP BY l)
SELECT (k // 64)::INT AS y, (k % 64)::INT AS x, size FROM c JOIN z USING (l)"""))
def _(spark, sf):
    found = masks.labels(embedding_plane(spark, sf).select("y", "x", (F.col("v") >= 150).cast("int").alias("m")))
    return found.join(found.groupBy("label").agg(F.count("*").alias("size")), "label").select("y", "x", "size")


@query("op_p12_box_in_bounds", duck("evt", "\nSELECT y, x, (x + r % 40 <= 64 AND y + g % 40 <= 100) AS ok FROM evt"))
def _(spark, sf):
    return event_image(spark, sf).select("y", "x", masks.in_bounds("x", "y", F.col("r") % 40, F.col("g") % 40, 64, 100).alias("ok"))


@query("op_u_set_operations", duck("evt", """,
a AS (SELECT y, x FROM evt WHERE r >= 64), e AS (SELECT y, x FROM evt WHERE g >= 128)
SELECT y, x, bool_or(k = 1) AS i, bool_or(k = 2) AS d, bool_or(k = 3) AS u FROM (
 SELECT y, x, 1 AS k FROM a SEMI JOIN e USING (y, x) UNION ALL SELECT y, x, 2 FROM a ANTI JOIN e USING (y, x) UNION ALL (SELECT y, x, 3 FROM a UNION SELECT y, x, 3 FROM e)) GROUP BY y, x"""))
def _(spark, sf):
    image = event_image(spark, sf)
    a, b = image.where("r >= 64").select("y", "x"), image.where("g >= 128").select("y", "x")
    parts = [masks.intersect(a, b), masks.subtract(a, b), masks.union(a, b)]
    named = [p.withColumn("k", F.lit(k + 1)) for k, p in enumerate(parts)]
    both = named[0].unionByName(named[1]).unionByName(named[2])
    return both.groupBy("y", "x").agg(*[F.some(F.col("k") == k + 1).alias(n) for k, n in enumerate("idu")])


@query("op_u4_fork_mask", duck("evt", "\nSELECT y, x, plane::INT AS plane FROM evt, range(3) t(plane) WHERE r >= 200"))
def _(spark, sf):
    return masks.fork(event_image(spark, sf).where("r >= 200").select("y", "x"))


# ---- aggregates


@query("op_a1_bounding_box", duck("emb", "\nSELECT count(*) AS cnt, min(x)::INT AS x, min(y)::INT AS y, (max(x) - min(x) + 1)::INT AS w, (max(y) - min(y) + 1)::INT AS h FROM emb WHERE v >= 165"))
def _(spark, sf):
    return stats.bounding_box(embedding_plane(spark, sf).withColumn("m", (F.col("v") >= 165).cast("int")), "m")


@query("op_a2_tile_range", duck("evt", "\nSELECT y // 8 AS ty, x // 8 AS tx, coalesce(min(r) FILTER (g >= 128), 0) AS mn, coalesce(max(r) FILTER (g >= 128), 0) AS mx, count(DISTINCT r) FILTER (g >= 128) AS uniq FROM evt GROUP BY ALL"))
def _(spark, sf):
    return stats.tile_range(event_image(spark, sf), "r", F.col("g") >= 128, 8, 8)


@query("op_a3_color_histogram", duck("evt", "\nSELECT (r << 16) | (g << 8) | b AS color, count(*) AS cnt FROM evt WHERE x < 48 GROUP BY 1"))
def _(spark, sf):
    return stats.color_histogram(event_image(spark, sf), F.col("x") < 48)


def _box_sql(channels: str) -> str:
    ends = ", ".join(f"coalesce({f}({n}) FILTER (r % 3 > 0), -1) AS {n}{k}" for n in channels for k, f in enumerate(("min", "max")))
    return duck("evt", f"\nSELECT y // 4 AS ty, x // 4 AS tx, {ends}, count(*) FILTER (r % 3 > 0) AS cnt, count(*) = 16 AS whole FROM evt GROUP BY ALL")


@query("op_a4_color_box", _box_sql("rgb"))
def _(spark, sf):
    return stats.color_box(event_image(spark, sf), ["r", "g", "b"], F.col("r") % 3 > 0, 4, 4)


@query("op_a5_color_box_2", _box_sql("gb"))
def _(spark, sf):
    return stats.color_box(event_image(spark, sf), ["g", "b"], F.col("r") % 3 > 0, 4, 4)


@query("op_a6_tile_histogram", duck("emb", "\nSELECT y // 8 AS ty, x // 8 AS tx, v, count(*) AS cnt FROM emb GROUP BY ALL"))
def _(spark, sf):
    return stats.tile_histogram(embedding_plane(spark, sf), "v", 8, 8)


PARAMS = """,
h AS (SELECT y // 8 AS ty, x // 8 AS tx, v, count(*) AS cnt FROM emb GROUP BY ALL),
k AS (SELECT ty, tx, greatest(1, least(254, arg_max(v, cnt * 1000 + v))) AS color0 FROM h GROUP BY ALL),
p AS (SELECT ty, tx, color0, coalesce(min(v) FILTER (abs(v - color0) > 1), 0) AS mn,
      coalesce(max(v) FILTER (abs(v - color0) > 1) - min(v) FILTER (abs(v - color0) > 1), 0) AS dl FROM h JOIN k USING (ty, tx) GROUP BY ALL)"""


@query("op_a7_frequent_color", duck("emb", PARAMS + "\nSELECT ty, tx, color0 FROM k"))
def _(spark, sf):
    return stats.frequent_color(stats.tile_histogram(embedding_plane(spark, sf), "v", 8, 8))


@query("op_a8_remaining_range", duck("emb", PARAMS + "\nSELECT ty, tx, color0, mn, dl FROM p"))
def _(spark, sf):
    histogram = stats.tile_histogram(embedding_plane(spark, sf), "v", 8, 8)
    return stats.remaining_range(histogram, stats.frequent_color(histogram))


@query("op_a12_color_class", duck("mix".replace("mix", "evt mix"), """,
n AS (SELECT y // 8 AS ty, x // 8 AS tx, count(DISTINCT (r >> 2) * 4096 + (g >> 2) * 64 + (b >> 2)) AS colors FROM mix GROUP BY ALL)
SELECT ty, tx, colors, CASE WHEN colors <= 1 THEN 0 WHEN colors <= 4 THEN 1 WHEN colors <= 8 THEN 2 WHEN colors <= 11 THEN 3 WHEN colors <= 15 THEN 4 ELSE 5 END AS class FROM n"""))
def _(spark, sf):
    from tilewright.sources.rasters import mixed_image

    return stats.color_class(mixed_image(spark, sf), 8, 8)


@query("op_a15_alpha_kind", duck("emb", """,
a AS (SELECT y, x, CASE WHEN x BETWEEN 9 AND 50 AND y BETWEEN 18 AND 77 THEN v ELSE 0 END AS v FROM emb),
s AS (SELECT min(v = 0) AS none, min(v = 255) AS full, max(v > 0 AND v < 255) AS analog, min(x) FILTER ((v >> 2) <> 0) AS x0, max(x) FILTER ((v >> 2) <> 0) AS x1,
      min(y) FILTER ((v >> 2) <> 0) AS y0, max(y) FILTER ((v >> 2) <> 0) AS y1 FROM a)
SELECT none, "full", analog, x0 // 4 * 4 AS x, y0 // 4 * 4 AS y, (x1 + 1 + 3) // 4 * 4 - x0 // 4 * 4 AS w, (y1 + 1 + 3) // 4 * 4 - y0 // 4 * 4 AS h FROM s"""))
def _(spark, sf):
    plane = embedding_plane(spark, sf)
    return stats.alpha_kind(plane.withColumn("v", masks.fill_outside("v", (9, 18, 42, 60))), "v")


@query("op_a16_quadtree", duck("emb", "\n" + " UNION ALL ".join(f"SELECT {k} AS level, y // {1 << k} AS qy, x // {1 << k} AS qx, min(v < 140) AS empty FROM emb GROUP BY ALL" for k in range(1, 5))))
def _(spark, sf):
    return stats.quadtree_empty(embedding_plane(spark, sf).withColumn("m", (F.col("v") >= 140).cast("int")), "m", 4)


@query("op_a18_delta_histogram", duck("emb", """,
d AS (SELECT y, x, greatest(-7, least(7, coalesce(v - lag(v) OVER (PARTITION BY y ORDER BY x), 0))) AS dx, greatest(-7, least(7, coalesce(v - lag(v) OVER (PARTITION BY x ORDER BY y), 0))) AS dy FROM emb)
SELECT y // 4 AS ty, x // 4 AS tx, dx, dy, count(*) AS cnt FROM d GROUP BY ALL"""))
def _(spark, sf):
    return stats.delta_histogram(embedding_plane(spark, sf), "v", 4, 4)


@query("op_a20_tile_format", duck("emb", """,
t AS (SELECT y // 8 AS ty, x // 8 AS tx, bit_or(1::UBIGINT << (v >> 2))::UBIGINT AS mask, count(DISTINCT v >> 2) AS uniq, min(v >> 2) AS mn, max(v >> 2) AS mx FROM emb GROUP BY ALL)
SELECT ty, tx, CASE WHEN mask > 9223372036854775807 THEN (mask::HUGEINT - 18446744073709551616)::BIGINT ELSE mask::BIGINT END AS mask, uniq, mn, mx,
 greatest(2, least(6, length(bin(greatest(mx - mn, 1)))))::INT AS natural, greatest(2, least(6, length(bin(greatest(uniq - 1, 1)))))::INT AS bits FROM t"""))
def _(spark, sf):
    return stats.format_of_tile(embedding_plane(spark, sf), "v", 8, 8)


# ---- windows


@query("op_w1_deltas", duck("emb", "\nSELECT y, x, v - coalesce(lag(v) OVER (PARTITION BY y ORDER BY x), 0) AS lr, v - coalesce(lag(v) OVER (PARTITION BY x ORDER BY y), 0) AS td FROM emb"))
def _(spark, sf):
    return embedding_plane(spark, sf).select("y", "x", windows.delta("v").alias("lr"), windows.delta("v", windows.TOP_DOWN).alias("td"))


@query("op_w1_undo_deltas", duck("emb", "\nSELECT y, x, v FROM emb"))
def _(spark, sf):
    plane = embedding_plane(spark, sf).select("y", "x", windows.delta("v").alias("d"))
    return plane.select("y", "x", windows.undo_delta("d").alias("v"))


@query("op_w2_parsing_orders", duck("emb", """\nSELECT y, x, 'lr' AS o, y - 8 AS line, x - 4 AS place, x = 4 AS is_start FROM emb WHERE x BETWEEN 4 AND 23 AND y BETWEEN 8 AND 19
UNION ALL SELECT y, x, 'td', x - 4, y - 8, y = 8 FROM emb WHERE x BETWEEN 4 AND 23 AND y BETWEEN 8 AND 19"""))
def _(spark, sf):
    plane = embedding_plane(spark, sf)
    made = [windows.parsing_order(plane, o, (4, 8, 20, 12)).withColumn("o", F.lit(n)) for n, o in (("lr", windows.LEFT_RIGHT), ("td", windows.TOP_DOWN))]
    return made[0].unionByName(made[1]).select("y", "x", "o", "line", "place", "is_start")


@query("op_w3_smooth_mask", duck("evt mix", "\nSELECT y, x, CASE WHEN greatest(abs(r - coalesce(lag(r) OVER (PARTITION BY y ORDER BY x), r)), abs(r - coalesce(lag(r) OVER (PARTITION BY x ORDER BY y), r))) < 4 THEN 255 ELSE 0 END AS m FROM mix"))
def _(spark, sf):
    from tilewright.sources.rasters import mixed_image

    return mixed_image(spark, sf).select("y", "x", windows.smooth_mask("r").alias("m"))


@query("op_w6_spans", duck("emb", """,
u AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS i FROM emb WHERE v >= 110)
SELECT y, min(x) AS start, count(*) AS len FROM u GROUP BY y, i"""))
def _(spark, sf):
    return windows.spans(embedding_plane(spark, sf), F.col("v") >= 110)


@query("op_w8_ordinals", duck("emb", "\nSELECT y // 8 AS ty, x // 8 AS tx, y, x, row_number() OVER (PARTITION BY y // 8, x // 8 ORDER BY y, x) - 1 AS ord FROM emb WHERE v % 3 > 0"))
def _(spark, sf):
    return windows.ordinals(embedding_plane(spark, sf), F.col("v") % 3 > 0, 8, 8)


@query("op_w5_offsets", duck("emb", """,
t AS (SELECT y // 8 AS ty, x // 8 AS tx, count(*) FILTER (v % 3 > 0) AS n FROM emb GROUP BY ALL)
SELECT ty, tx, n, coalesce(sum(n) OVER (PARTITION BY ty ORDER BY tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM t"""))
def _(spark, sf):
    sized = embedding_plane(spark, sf).groupBy(*stats.tile(8, 8)).agg(F.count_if(F.col("v") % 3 > 0).alias("n"))
    return windows.offsets(sized, ["tx"], ["ty"])


# ---- resampling

_AXES = {"xy": (True, True), "x": (True, False), "y": (False, True)}
_NB = """,
n AS (SELECT y, x, v AS a, coalesce(lead(v) OVER (PARTITION BY y ORDER BY x), v) AS b FROM emb),
o AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY x ORDER BY y), a) AS c, coalesce(lead(b) OVER (PARTITION BY x ORDER BY y), b) AS d FROM n)
"""
_DOWN = {
    "NEAREST_TL": {"xy": "a", "x": "a", "y": "a"},
    "NEAREST_BR": {"xy": "d", "x": "c", "y": "b"},
    "AVERAGE_BOX": {"xy": "(a + b + c + d) // 4", "x": "(a + b) // 2", "y": "(a + c) // 2"},
    "MAX_BOX": {"xy": "greatest(a, b, c, d)", "x": "greatest(a, c)", "y": "greatest(a, b)"},
    "MIN_BOX": {"xy": "least(a, b, c, d)", "x": "least(a, c)", "y": "least(a, b)"},
}


def _down_query(mode: str):
    def run(spark, sf):
        plane, parts = embedding_plane(spark, sf), []
        for axes, (hx, hy) in _AXES.items():
            parts.append(resample.down(plane, "v", mode, hx, hy).select(F.lit(axes).alias("axes"), "y", "x", "v"))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    sql = " UNION ALL ".join(
        f"SELECT '{k}' AS axes, y // {1 + hy} AS y, x // {1 + hx} AS x, ({_DOWN[mode][k]})::INT AS v FROM o WHERE y % {1 + hy} = 0 AND x % {1 + hx} = 0" for k, (hx, hy) in _AXES.items()
    )
    QUERIES[f"op_r1_down_{mode.lower()}"], ORACLES[f"op_r1_down_{mode.lower()}"] = run, duck("emb", _NB + sql)


for _mode in resample.MODES:
    _down_query(_mode)


def _up_query(smooth: bool):
    def run(spark, sf):
        plane = embedding_plane(spark, sf)
        parts = [resample.up(plane, "v", dx, dy, smooth).select(F.lit(k).alias("axes"), "y", "x", "v") for k, (dx, dy) in _AXES.items()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    cells = []
    for k, (hx, hy) in _AXES.items():
        for dy in range(1 + hy):
            for dx in range(1 + hx):
                v = "a" if not smooth or not (dx or dy) else "(a + b + c + d) // 4" if dx and dy else "(a + b) // 2" if dx else "(a + c) // 2"
                cells.append(f"SELECT '{k}' AS axes, y * {1 + hy} + {dy} AS y, x * {1 + hx} + {dx} AS x, ({v})::INT AS v FROM o")
    name = f"op_r2_up_{'bilinear' if smooth else 'nearest'}"
    QUERIES[name], ORACLES[name] = run, duck("emb", _NB + " UNION ALL ".join(cells))


_up_query(True)
_up_query(False)


@query("op_r4_chroma_half", duck("evt", """,
h AS (SELECT y, x, (r - b) // 2 AS co, (g - b - (r - b) // 2) // 2 AS cg FROM evt),
n AS (SELECT y, x, co AS a1, cg AS a2, coalesce(lead(co) OVER w, co) AS b1, coalesce(lead(cg) OVER w, cg) AS b2 FROM h WINDOW w AS (PARTITION BY y ORDER BY x))
SELECT y, x // 2 AS x, (a1 + b1) // 2 AS co, (a2 + b2) // 2 AS cg FROM n WHERE x % 2 = 0"""))
def _(spark, sf):
    from tilewright.functions.scalar import rgb_to_ycocg

    _, co, cg = rgb_to_ycocg("r", "g", "b")
    chroma = event_image(spark, sf).select("y", "x", co.alias("co"), cg.alias("cg"))
    half = [resample.down(chroma, n, "AVERAGE_BOX", True, False).withColumnRenamed("v", n) for n in ("co", "cg")]
    return half[0].join(half[1], ["y", "x"])


def _between_query(axes: str):
    dx, dy = "x" in axes, "y" in axes

    def run(spark, sf):
        return resample.fill_between(embedding_plane(spark, sf), "v", F.col("v") >= 140, dx, dy)

    sx, sy = 1 + dx, 1 + dy
    read = lambda j, i: f"(SELECT v FROM emb q WHERE q.y = least(last, e.y + {j}) AND q.x = least(63, e.x + {i}))"
    spots = [(0, 1, f"(v + {read(0, sx)}) // 2")] * dx + [(1, 0, f"(v + {read(sy, 0)}) // 2")] * dy + [(1, 1, f"(v + {read(0, sx)} + {read(sy, 0)} + {read(sy, sx)}) // 4")] * (dx and dy)
    made = " UNION ALL ".join(f"SELECT y + {j} AS y, x + {i} AS x, ({v})::INT AS new FROM e" for j, i, v in spots)
    name = f"op_r3_fill_between_{axes}"
    QUERIES[name] = run
    ORACLES[name] = duck("emb", f""",
e AS (SELECT *, (SELECT max(y) FROM emb) AS last FROM emb WHERE x % {sx} = 0 AND y % {sy} = 0 AND v < 140), f AS ({made})
SELECT k.y, k.x, coalesce(new, v) AS v FROM emb k LEFT JOIN f ON f.y = k.y AND f.x = k.x""")


for _axes in ("xy", "x", "y"):
    _between_query(_axes)


@query("op_r3_fill_back", duck("emb", """,
e AS MATERIALIZED (SELECT (y // 2)::INT AS j, (x // 2)::INT AS i, v AS old, v >= 140 AS keep FROM emb WHERE y % 2 = 0 AND x % 2 = 0),
w AS (
  SELECT 0 AS d, 0 AS i, old AS v, old AS up FROM e WHERE j = 0 AND i = 0
  UNION ALL
  SELECT n.d, n.i, (CASE WHEN keep THEN old ELSE trunc((CASE WHEN j = 0 THEN coalesce(l, old) WHEN n.i = 0 THEN u ELSE lu END + coalesce(u, old) + coalesce(l, old) + old) / 4.0) END)::INT, coalesce(u, old)
  FROM (SELECT e.j + e.i AS d, e.j, e.i, old, keep, a.v AS u, b.v AS l, b.up AS lu FROM (SELECT max(d) AS d FROM w) q JOIN e ON e.j + e.i = q.d + 1 LEFT JOIN w a ON a.i = e.i AND e.j > 0 LEFT JOIN w b ON b.i = e.i - 1) n),
g AS MATERIALIZED (SELECT d - i AS j, i, v FROM w),
r AS (SELECT e.j, e.i, old, coalesce(a.v, old) AS u, CASE WHEN e.j = 0 THEN coalesce(l.v, old) WHEN e.i = 0 THEN coalesce(a.v, old) ELSE f.v END AS far, g.v AS me
  FROM e JOIN g ON g.j = e.j AND g.i = e.i LEFT JOIN g a ON a.j = e.j - 1 AND a.i = e.i LEFT JOIN g f ON f.j = e.j - 1 AND f.i = e.i - 1 LEFT JOIN g l ON l.j = e.j AND l.i = e.i - 1 WHERE NOT keep),
p AS (SELECT 2 * j AS y, 2 * i AS x, me AS new FROM r UNION ALL SELECT 2 * j, 2 * i + 1, (u + old) // 2 FROM r UNION ALL SELECT 2 * j + 1, 2 * i, (far + u) // 2 FROM r UNION ALL SELECT 2 * j + 1, 2 * i + 1, old FROM r)
SELECT emb.y, emb.x, coalesce(new, v)::INT AS v FROM emb LEFT JOIN p ON p.y = emb.y AND p.x = emb.x"""))  # fmt: skip
def _(spark, sf):
    plane = embedding_plane(spark, sf)
    height = (plane.agg(F.max("y")).first()[0] or -1) + 1
    return resample.fill_back(plane, "v", F.col("v") >= 140, 64, max(2, height))


@query("op_e13_single_colors", duck("evt mix", """,
f AS (SELECT y, x, CASE WHEN x < 48 THEN (r >> 5) * 131072 + (g >> 5) * 512 + 7 ELSE (r << 16) | (g << 8) | b END AS color FROM mix),
l AS (SELECT *, lag(color) OVER (PARTITION BY y ORDER BY x) AS before FROM f),
n AS (SELECT color, count(*) AS cnt, count(*) FILTER (before IS NULL OR before <> color) AS runs FROM l GROUP BY color)
SELECT color, cnt, row_number() OVER (ORDER BY cnt DESC, color) AS rank FROM n WHERE cnt > 150 AND cnt * 7 >= runs * 12 + 24 QUALIFY rank <= 84"""))
def _(spark, sf):
    from tilewright.sources.rasters import mixed_image

    flat = F.col("x") < 48
    image = mixed_image(spark, sf).select(
        "y", "x", F.when(flat, F.shiftright("r", 5) * 2).otherwise(F.col("r")).alias("r"), F.when(flat, F.shiftright("g", 5) * 2).otherwise(F.col("g")).alias("g"), F.when(flat, 7).otherwise(F.col("b")).alias("b")
    )
    return stats.single_colors(image)


@query("op_a21_superset_masks", duck("emb", """,
t AS (SELECT y // 4 AS ty, x // 4 AS tx, bit_or(1::UBIGINT << (v >> 2))::UBIGINT AS um FROM emb GROUP BY ALL),
n AS MATERIALIZED (SELECT (ty // 16)::INT AS image_id, (ty * 16 + tx)::INT AS place, um FROM t),
f AS MATERIALIZED (SELECT image_id, um, xor(um, 18446744073709551615::UBIGINT) AS none, min(place) AS first FROM n GROUP BY ALL),
st AS MATERIALIZED (SELECT image_id, none, first, row_number() OVER (PARTITION BY image_id ORDER BY first) - 1 AS slot FROM f a
  WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.image_id = a.image_id AND b.first < a.first AND (a.um & b.none) = 0)),
q AS (SELECT f.image_id, f.um, min(slot)::INT AS slot FROM f JOIN st s ON s.image_id = f.image_id AND s.first <= f.first AND (f.um & s.none) = 0 GROUP BY ALL)
SELECT image_id, place AS "at", CASE WHEN um > 9223372036854775807 THEN (um::HUGEINT - 18446744073709551616)::BIGINT ELSE um::BIGINT END AS mask, slot FROM n JOIN q USING (image_id, um)"""))
def _(spark, sf):
    """A stream of masks for each 64 rows of the plane."""
    tiles = stats.format_of_tile(embedding_plane(spark, sf), "v", 4, 4).withColumn("image_id", idiv("ty", 16).cast("int")).withColumn("at", F.col("ty") * 16 + F.col("tx"))
    return stats.superset_masks(tiles.select("image_id", "at", "mask"), ["image_id"], "at")


@query("op_j8_semi_anti", duck("evt", "\nSELECT y, x, r, EXISTS (FROM evt m WHERE m.g >= 200 AND m.y = e.y AND m.x = e.x) AS masked FROM evt e"))
def _(spark, sf):
    image = event_image(spark, sf)
    keys = image.where("g >= 200").select("y", "x")
    parts = [f(image.select("y", "x", "r"), keys).withColumn("masked", F.lit(v)) for f, v in ((masks.intersect, True), (masks.subtract, False))]
    return parts[0].unionByName(parts[1])


@query("op_j9_aligned_boxes", duck("emb", "\nSELECT y, x, CASE WHEN m >= 120 THEN v ELSE 0 END AS v FROM (SELECT y, x, v, lead(v) OVER (PARTITION BY y % 4, x - 2 * y ORDER BY y) AS m FROM emb) WHERE m IS NOT NULL"))
def _(spark, sf):
    """All pixels that have one 4 below and 8 to the right."""
    plane = embedding_plane(spark, sf)
    mask = plane.select((F.col("y") - 4).alias("y"), (F.col("x") - 8).alias("x"), (F.col("v") >= 120).alias("m"))
    return plane.join(mask, ["y", "x"]).select("y", "x", F.when(F.col("m"), F.col("v")).otherwise(0).alias("v"))


@query("op_e13_single_color_maps", None)
def _(spark, sf):
    """Images of 64 rows in few colours: what their maps of single colours take, by coded size."""
    from tilewright.sources.rasters import mixed_image

    few = lambda n: F.when(F.col("x") < 48, F.shiftright(n, 6) * 40).otherwise(F.col(n))
    image = mixed_image(spark, sf).select(idiv("y", 64).cast("int").alias("image_id"), (F.col("y") % 64).alias("y"), "x", few("r").alias("r"), few("g").alias("g"), F.when(F.col("x") < 48, 7).otherwise(F.col("b")).alias("b"))
    return flatmaps.single_color_maps(image, 64, 64)


@query("op_f3_own_orders", duck("emb", """,
o AS (SELECT 'snake' AS o, y AS line, CASE WHEN y % 2 = 0 THEN x ELSE 63 - x END AS place, y, x, v FROM emb UNION ALL SELECT 'slope', y + x, least(y, 63 - x), y, x, v FROM emb)
SELECT o, y, x, line::INT AS line, place::INT AS place, place = 0 AS is_start, (v - coalesce(lag(v) OVER (PARTITION BY o, line ORDER BY place), 0))::INT AS dv FROM o"""))
def _(spark, sf):
    """Differences along a caller's own orders of the whole plane: rows back and forth, and slopes."""
    plane = embedding_plane(spark, sf)
    height = (plane.agg(F.max("y")).first()[0] or -1) + 1
    orders = {"snake": lambda y, x: (y, F.when(y % 2 == 0, x).otherwise(F.lit(63) - x)), "slope": lambda y, x: (y + x, F.least(y, F.lit(63) - x))}
    out = None
    for name, order in orders.items():
        placed = windows.parsing_order(plane, order, (0, 0, 64, height)).join(plane, ["y", "x"])
        made = placed.select(F.lit(name).alias("o"), "y", "x", "line", "place", "is_start", windows.delta("v", ("line", "place")).cast("int").alias("dv"))
        out = made if out is None else out.unionByName(made)
    return out
