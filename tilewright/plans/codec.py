"""Queries of bit packing, palettes, compression and the container."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.entropy import LEVELS_DOWN, LEVELS_UP, zstd_compress, zstd_decompress, zstd_search
from tilewright.functions.scalar import bitmap_position, idiv, shr
from tilewright.operators import bits, gradient, masks, palette, stats, streams, windows
from tilewright.plans import images
from tilewright.sources import container
from tilewright.sources.rasters import WIDTH, duck, embedding_plane, event_image, grid, large_components_sql, mixed_image
from tilewright.sources.shared import shared_folder
from tilewright.streaming import chunks as chunk_order

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def scratch(spark) -> str:
    """A folder of its own in the shared folder, a temporary one where none is set."""
    return f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex[:12]}"


# ---- bits


@query("op_b1_pack_bits", duck("emb", "\nSELECT y, printf('%02X', b) AS hex FROM (SELECT y, x // 8 AS byte, sum((v >= 128)::INT << (x % 8))::INT AS b FROM emb GROUP BY ALL) WHERE false UNION ALL SELECT y, string_agg(printf('%02X', b), '' ORDER BY byte) FROM (SELECT y, x // 8 AS byte, sum((v >= 128)::INT << (x % 8))::INT AS b FROM emb GROUP BY ALL) GROUP BY y"))
def _(spark, sf):
    values = embedding_plane(spark, sf).select("y", F.col("x").alias("pos"), (F.col("v") >= 128).cast("int").alias("v"))
    return bits.to_binary(bits.pack(values, ["y"], 1), ["y"]).select("y", F.hex("data").alias("hex"))


@query("op_b1_pack_bits_masked", duck("emb", """,
k AS (SELECT y, v & 1 AS b, row_number() OVER (PARTITION BY y ORDER BY x) - 1 AS pos FROM emb WHERE v >= 120)
SELECT y, (pos // 8)::INT AS byte, sum(b << (pos % 8))::INT AS v FROM k GROUP BY ALL"""))
def _(spark, sf):
    plane = embedding_plane(spark, sf)
    kept = windows.ordinals(plane, F.col("v") >= 120, 1, 64).select("y", "x", F.col("ord").alias("pos")).join(plane, ["y", "x"])
    return bits.pack(kept.select("y", "pos", F.col("v").bitwiseAND(F.lit(1)).alias("v")), ["y"], 1)


@query("op_b2_pack_6_bits", duck("emb", """,
q AS (SELECT y, x // 4 AS k, x % 4 AS i, v >> 2 AS s FROM emb),
p AS (SELECT y, k, sum(s::INT << (6 * i)::INT)::INT AS w FROM q GROUP BY ALL)
SELECT y, string_agg(printf('%02X%02X%02X', w & 255, (w >> 8) & 255, (w >> 16) & 255), '' ORDER BY k) AS hex FROM p GROUP BY y"""))
def _(spark, sf):
    values = embedding_plane(spark, sf).select("y", F.col("x").alias("pos"), shr("v", 2).alias("v"))
    return bits.to_binary(bits.pack(values, ["y"], 6), ["y"]).select("y", F.hex("data").alias("hex"))


@query("op_b4_nibbles", duck("emb", """,
p AS (SELECT y, x // 2 AS k, sum((v & 15) << (4 * (x % 2)))::INT AS b FROM emb GROUP BY ALL)
SELECT y, string_agg(printf('%02X', b), '' ORDER BY k) AS hex FROM p GROUP BY y"""))
def _(spark, sf):
    values = embedding_plane(spark, sf).select("y", F.col("x").alias("pos"), F.col("v").bitwiseAND(F.lit(15)).alias("v"))
    return bits.to_binary(bits.pack(values, ["y"], 4), ["y"]).select("y", F.hex("data").alias("hex"))


@query("op_d2_unpack_bits", duck("emb", "\nSELECT y, x::BIGINT AS pos, CASE WHEN v >= 128 THEN 255 ELSE 0 END AS v FROM emb"))
def _(spark, sf):
    values = embedding_plane(spark, sf).select("y", F.col("x").alias("pos"), (F.col("v") >= 128).cast("int").alias("v"))
    return bits.unpack(bits.to_binary(bits.pack(values, ["y"], 1), ["y"]), ["y"], 1).select("y", "pos", (F.col("v") * 255).alias("v"))


def _six(inverse: bool):
    def run(spark, sf):
        six = shr("v", 2)
        values = embedding_plane(spark, sf).select("y", F.col("x").alias("pos"), (F.lit(63) - six if inverse else six).alias("v"))
        got = bits.unpack(bits.to_binary(bits.pack(values, ["y"], 6), ["y"]), ["y"], 6)
        return got.select("y", "pos", bits.expand6(F.lit(63) - F.col("v") if inverse else F.col("v")).cast("int").alias("v"))

    return run


for _inverse in (False, True):
    _name = "op_d3_unpack_6_bits" + ("_inverse" if _inverse else "")
    QUERIES[_name], ORACLES[_name] = _six(_inverse), duck("emb", "\nSELECT y, x::BIGINT AS pos, ((v >> 2) << 2) | (v >> 6) AS v FROM emb")


_MIP = ",\nt AS (SELECT y // 16 AS ty, x // 16 AS tx, max((v >= 170)::INT) AS used FROM emb GROUP BY ALL)"


@query("op_a17_mip_tiles", duck("emb", _MIP + "\nSELECT ty, tx, used FROM t"))
def _(spark, sf):
    return bits.mip_bits(embedding_plane(spark, sf).withColumn("m", (F.col("v") >= 170).cast("int")), "m")


@query("op_d1_mip_mask", duck("emb", _MIP + "\nSELECT y::INT AS y, x::INT AS x, CASE WHEN used > 0 THEN 255 ELSE 0 END AS m FROM (SELECT ty * 16 + dy AS y, tx * 16 + dx AS x, used FROM t, range(16) a(dy), range(16) b(dx))"))
def _(spark, sf):
    tiles = bits.mip_bits(embedding_plane(spark, sf).withColumn("m", (F.col("v") >= 170).cast("int")), "m")
    return bits.mip_mask(tiles).select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "m")


@query("op_d4_masked_alpha", duck("emb", "\nSELECT y, x, (CASE WHEN v >= 100 THEN ((v >> 2) << 2) | (v >> 6) ELSE 0 END)::INT AS v FROM emb"))
def _(spark, sf):
    """An alpha stream for each 64 rows of the plane."""
    plane = embedding_plane(spark, sf)
    ordered = windows.ordinals(plane, F.col("v") >= 100, 64, 64).select(F.col("ty").alias("s"), "y", "x", F.col("ord").alias("pos"))
    stream = bits.to_binary(bits.pack(ordered.join(plane, ["y", "x"]).select("s", "pos", shr("v", 2).alias("v")), ["s"], 6), ["s"])
    got = bits.unpack(stream, ["s"], 6).select("s", "pos", bits.expand6("v").cast("int").alias("a"))
    placed = ordered.join(got, ["s", "pos"]).select("y", "x", "a")
    return plane.select("y", "x").join(placed, ["y", "x"], "left").select("y", "x", F.coalesce("a", F.lit(0)).alias("v"))


@query("op_d5_alpha_box", duck("emb", "\nSELECT y, x, CASE WHEN x BETWEEN 8 AND 47 AND y BETWEEN 12 AND (SELECT max(y) - 12 FROM emb) THEN v ELSE 0 END AS v FROM emb"))
def _(spark, sf):
    """A box 40 wide that leaves out 12 rows at either end of the plane."""
    plane = embedding_plane(spark, sf)
    height = (plane.agg(F.max("y")).first()[0] or -1) + 1
    box = (8, 12, 40, max(0, height - 24))
    inside = plane.where(masks.inside(*box)).select(((F.col("y") - 12) * 40 + F.col("x") - 8).alias("pos"), "v")
    return bits.alpha_plane(inside, box, grid(spark, height, 64))


_BITMAP = ",\np AS (SELECT DISTINCT y // 8 AS ty, x // 8 AS tx FROM emb WHERE v >= 160),\nq AS (SELECT (ty // 8 * 64 + ty % 8 * 8 + tx) AS pos FROM p),\nm AS (SELECT (pos >> 3)::INT AS byte, sum(1 << (pos % 8))::INT AS v FROM q GROUP BY 1)"


def _bitmap(spark, sf):
    tiles = embedding_plane(spark, sf).where("v >= 160").select(*stats.tile(8, 8)).distinct()
    return bits.tile_bitmap(tiles.select(bitmap_position("ty", "tx", F.lit(64), 8, 8).alias("pos")))


@query("op_b3_tile_bitmap", duck("emb", _BITMAP + "\nSELECT byte, v FROM m"))
def _(spark, sf):
    return _bitmap(spark, sf)


@query("op_a19_tile_count", duck("emb", _BITMAP + "\nSELECT coalesce(sum(bit_count(v)), 0)::BIGINT AS tiles FROM m WHERE byte < (SELECT (max(byte) + 1) // 4 * 4 FROM m)"))
def _(spark, sf):
    return bits.popcount(_bitmap(spark, sf))


# ---- palettes


def _streams(spark, sf):
    """A colour stream of 6 bits for each band of 8 rows of the mixed image, all columns."""
    n = (F.col("y") % 8) * WIDTH + F.col("x")
    return mixed_image(spark, sf).select(idiv("y", 8).cast("int").alias("stream"), n.cast("int").alias("n"), *[shr(k, 2).alias(k) for k in "rgb"])


_STREAMS = """,
s AS MATERIALIZED (SELECT y // 8 AS stream, y % 8 * 64 + x AS n, r >> 2 AS r, g >> 2 AS g, b >> 2 AS b FROM mix),
d AS (SELECT a.stream, a.n, p.n AS prev, (a.r - p.r) ** 2 + (a.g - p.g) ** 2 + (a.b - p.b) ** 2 AS dist, (a.r - p.r) & 255 AS dr, (a.g - p.g) & 255 AS dg, (a.b - p.b) & 255 AS db
      FROM s a JOIN s p ON p.stream = a.stream AND p.n BETWEEN a.n - 64 AND a.n - 1),
nd AS MATERIALIZED (SELECT stream, n, dr, dg, db FROM d QUALIFY row_number() OVER (PARTITION BY stream, n ORDER BY dist, prev) = 1),
cb AS (SELECT stream, dr, dg, db, count(*) - 1 AS ref, min(n) AS first FROM nd GROUP BY ALL),
bk AS MATERIALIZED (SELECT st.stream, 0 AS idx, 0 AS dr, 0 AS dg, 0 AS db, coalesce(ref + 1, 0) AS ref FROM (SELECT DISTINCT stream FROM nd) st LEFT JOIN cb ON cb.stream = st.stream AND dr = 0 AND dg = 0 AND db = 0
 UNION ALL SELECT * FROM (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY ref DESC, first) AS idx, dr, dg, db, ref FROM cb WHERE dr + dg + db > 0) WHERE idx < 128)"""


@query("op_a9_code_book", duck("evt mix", _STREAMS + "\nSELECT stream, idx::INT AS idx, dr, dg, db, ref FROM bk"))
def _(spark, sf):
    return palette.code_book(palette.nearest_deltas(_streams(spark, sf)))


@query("op_j7_nearest_deltas", duck("evt mix", _STREAMS + "\nSELECT stream, n, dr, dg, db FROM nd"))
def _(spark, sf):
    return palette.nearest_deltas(_streams(spark, sf))


_HEX = "printf('%02X', {})".format
_CODES = _STREAMS + """,
h AS (SELECT a.stream, a.n, a.n - p.n - 2 AS back, k.idx FROM s a JOIN s p ON p.stream = a.stream AND p.n BETWEEN a.n - 65 AND a.n - 1
      JOIN bk k ON k.stream = a.stream AND k.idx < 64 AND k.dr = ((a.r - p.r) & 255) AND k.dg = ((a.g - p.g) & 255) AND k.db = ((a.b - p.b) & 255)),
f AS (SELECT stream, n, min(idx) FILTER (back = -1) AS near, min(idx * 100 + back) FILTER (back BETWEEN 0 AND 63) AS far FROM h GROUP BY ALL),
e AS (SELECT stream, n, r, g, b, r - lag(r) OVER w AS sr, g - lag(g) OVER w AS sg, b - lag(b) OVER w AS sb FROM s WINDOW w AS (PARTITION BY stream ORDER BY n)),
co AS MATERIALIZED (SELECT e.stream, e.n, CASE WHEN near IS NOT NULL THEN """ + _HEX("near") + " WHEN far IS NOT NULL THEN " + _HEX("192 + far % 100") + " || " + _HEX("far // 100") + """
  ELSE """ + _HEX("128 + (sr <> 0)::INT + 2 * (sg <> 0)::INT + 4 * (sb <> 0)::INT") + " || " + " || ".join(f"CASE WHEN s{k} <> 0 THEN {_HEX(f's{k} & 255')} ELSE '' END" for k in "rgb") + """ END AS code
  FROM e LEFT JOIN f USING (stream, n) WHERE e.n > 0)"""  # fmt: skip


@query("op_z3_palette_codes", duck("evt mix", _CODES + "\nSELECT stream, n, code FROM co"))
def _(spark, sf):
    streams = gradient.checkpointed(_streams(spark, sf))
    return palette.codes(streams, gradient.checkpointed(palette.code_book(palette.nearest_deltas(streams))))


@query("op_z3_palette_encode", duck("evt mix", _CODES + """,
hd AS (SELECT stream, """ + _HEX("count(*)") + " || string_agg(" + " || ".join(_HEX(f"d{k}") for k in "rgb") + """, '' ORDER BY idx) AS h FROM bk GROUP BY stream),
bd AS (SELECT stream, string_agg(code, '' ORDER BY n) AS c FROM co GROUP BY stream)
SELECT stream, h || """ + " || ".join(_HEX(k) for k in "rgb") + " || c AS hex FROM s JOIN hd USING (stream) JOIN bd USING (stream) WHERE n = 0"))  # fmt: skip
def _(spark, sf):
    return palette.encode(gradient.checkpointed(_streams(spark, sf))).select("stream", F.hex("data").alias("hex"))


@query("op_z4_palette_decode", duck("evt mix", _STREAMS + "\nSELECT stream, n, r, g, b FROM s"))
def _(spark, sf):
    streams = gradient.checkpointed(_streams(spark, sf))
    sizes = streams.groupBy("stream").agg(F.count("*").alias("colors"))
    return palette.decode(palette.encode(streams).join(sizes, "stream"))


@query("op_t5_frequent_colors", duck("evt mix", "\nSELECT (r << 16) | (g << 8) | b AS color, count(*) AS cnt FROM mix GROUP BY 1 ORDER BY cnt DESC, color LIMIT 10"))
def _(spark, sf):
    return stats.color_histogram(mixed_image(spark, sf)).orderBy(F.desc("cnt"), "color").limit(10)


# ---- compression and containers


@query("op_z1_z2_zstd_round_trip", duck("emb", "\nSELECT y, 64 AS n, true AS same FROM emb GROUP BY y"))
def _(spark, sf):
    values = embedding_plane(spark, sf).select("y", F.col("x").alias("byte"), "v")
    streams = bits.to_binary(values, ["y"]).withColumn("packed", zstd_compress(F.col("data")))
    back = streams.withColumn("back", zstd_decompress(F.col("packed"), F.length("data")))
    return back.select("y", F.length("back").alias("n"), (F.col("back") == F.col("data")).alias("same"))


@query("op_t8_level_search", None)
def _(spark, sf):
    """Bands of 16 rows: the level that each search takes, its size, and whether the band comes back."""
    values = embedding_plane(spark, sf).select(idiv("y", 16).cast("int").alias("band"), ((F.col("y") % 16) * WIDTH + F.col("x")).alias("byte"), "v")
    out = bits.to_binary(values, ["band"])
    for name, levels in (("up", LEVELS_UP), ("down", LEVELS_DOWN)):
        out = out.withColumn(name, zstd_search(F.col("data"), levels))
    same = [(zstd_decompress(F.col(f"{n}.packed"), F.length("data")) == F.col("data")).alias(f"same_{n}") for n in ("up", "down")]
    return out.select("band", *[F.col(f"{n}.level").alias(f"level_{n}") for n in ("up", "down")], *[F.length(f"{n}.packed").alias(f"size_{n}") for n in ("up", "down")], *same)


def _chunk_rows(spark, sf):
    """The whole embedding plane: a chunk for each band of 16 rows, a file for each five, the last ones as long as they are."""
    values = embedding_plane(spark, sf).select(idiv("y", 16).cast("int").alias("k"), ((F.col("y") % 16) * WIDTH + F.col("x")).alias("byte"), "v")
    tags = F.array(*map(F.lit, (container.MIP, container.ALPHA, container.GRADIENT, container.TABLE, container.RANGE)))
    made = bits.to_binary(values, ["k"]).withColumn("file", idiv("k", 5))
    height = F.sum(idiv(F.length("data"), WIDTH)).over(Window.partitionBy("file")).cast("int")
    name = F.concat(F.lit("image-"), F.col("file").cast("string"))
    return made.select(name.alias("name"), F.lit(WIDTH).alias("width"), height.alias("height"), F.lit(False).alias("alpha"), (F.col("k") % 5).alias("seq"), F.element_at(tags, F.col("k") % 5 + 1).alias("tag"), F.col("data").alias("payload"))


_CHUNK = """,
c AS (SELECT y // 16 AS k, (y % 16) * 64 + x AS byte, v FROM emb),
h AS (SELECT k, string_agg(printf('%02X', v), '' ORDER BY byte) AS hex, count(*) AS n FROM c GROUP BY k)
SELECT 'image-' || (k // 5) AS name, (sum(n // 64) OVER (PARTITION BY k // 5))::INT AS height, (k % 5)::INT AS seq, ['MIPM', 'ALPM', 'GTIL', '3DTL', '1DTL'][k % 5 + 1] AS tag, (n + 3) // 4 * 4 AS length"""


@query("op_io6_io7_container_round_trip", duck("emb", _CHUNK + ", hex || repeat('00', ((n + 3) // 4 * 4 - n)::INT) AS hex FROM h"))
def _(spark, sf):
    where = scratch(spark)
    container.write_containers(_chunk_rows(spark, sf), where)
    got = container.read_containers(spark, where)
    return got.select(F.regexp_extract("path", r"(image-\d+)\.tile", 1).alias("name"), "height", "seq", "tag", "length", F.hex("payload").alias("hex"))


@query("op_io7_chunk_listing", duck("emb", _CHUNK + " FROM h"))
def _(spark, sf):
    where = scratch(spark)
    container.write_containers(_chunk_rows(spark, sf), where)
    got = container.read_containers(spark, where, payloads=False)
    return got.select(F.regexp_extract("path", r"(image-\d+)\.tile", 1).alias("name"), "height", "seq", "tag", "length")


_TAGS = (container.MIP, container.ALPHA, container.GRADIENT, container.TABLE, container.RANGE, "XXXX")


@query("op_io_chunk_order", """
WITH c AS (SELECT (o_orderkey // 8)::VARCHAR AS path, (o_orderkey % 8)::INT AS seq, (["""
    + ", ".join(f"'{t}'" for t in _TAGS) + """])[(o_custkey + o_orderkey % 8 * 7) % 6 + 1] AS tag FROM orders),
s AS (SELECT *, CASE tag """ + " ".join(f"WHEN '{t}' THEN {n}" for t, n in container.STATES.items()) + """ END AS state FROM c),
r AS (SELECT *, max(state) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s)
SELECT path, seq, tag, CASE WHEN state IS NULL THEN 'unknown tag' ELSE 'wrong order' END AS error FROM r WHERE state IS NULL OR state < reached""")  # fmt: skip
def _(spark, sf):
    """Orders as chunks: eight of them are a file, the customer and the place give the tag."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), ((F.col("o_custkey") + F.col("o_orderkey") % 8 * 7) % 6 + 1).cast("int"))
    return chunk_order.order_errors(orders.select(idiv("o_orderkey", 8).cast("string").alias("path"), (F.col("o_orderkey") % 8).cast("int").alias("seq"), tag.alias("tag")))


@query("op_e14_smooth_map", duck("evt mix", """,
sm AS MATERIALIZED (SELECT (y // 64)::INT AS image_id, (y % 64)::INT AS y, x, greatest(greatest(abs(r - coalesce(lag(r) OVER a, r)), abs(r - coalesce(lag(r) OVER d, r))), greatest(abs(g - coalesce(lag(g) OVER a, g)), abs(g - coalesce(lag(g) OVER d, g))), greatest(abs(b - coalesce(lag(b) OVER a, b)), abs(b - coalesce(lag(b) OVER d, b)))) < 4 AS m FROM mix WINDOW a AS (PARTITION BY y ORDER BY x), d AS (PARTITION BY x ORDER BY y)),
sr AS (SELECT image_id, y, x FROM sm WHERE m),""" + large_components_sql("sr") + """
SELECT sm.image_id, (sm.y // 2)::INT AS y, (sm.x // 2)::INT AS x, CASE WHEN bool_and(keep.y IS NOT NULL) THEN 255 ELSE 0 END AS m
FROM sm LEFT JOIN keep ON keep.image_id = sm.image_id AND keep.y = sm.y AND keep.x = sm.x GROUP BY ALL"""))
def _(spark, sf):
    """Smooth places of the image, in masks of 64 rows each."""
    image = mixed_image(spark, sf)
    smooth = image.select("y", "x", *[windows.smooth_mask(n).alias(n) for n in "rgb"])
    both = smooth.select(idiv("y", 64).cast("int").alias("image_id"), (F.col("y") % 64).alias("y"), "x", F.when((F.col("r") > 0) & (F.col("g") > 0) & (F.col("b") > 0), 255).otherwise(0).alias("m"))
    return masks.quarter_all(masks.erode(both, ["image_id"]))


@query("op_io17_interleaved_rows", duck("evt", "\nSELECT y, string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY x) AS hex FROM evt GROUP BY y"))
def _(spark, sf):
    two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    cells = F.transform(F.sort_array(F.collect_list(F.struct("x", "r", "g", "b"))), lambda s: F.concat(two(s["r"]), two(s["g"]), two(s["b"])))
    return event_image(spark, sf).groupBy("y").agg(F.array_join(cells, "").alias("hex"))


@query("op_io2_signed_planes", duck("evt", "\nSELECT y, x, least(255, greatest(0, r)) AS r, least(255, greatest(0, (r - b) // 2 + 128)) AS co FROM evt"))
def _(spark, sf):
    from tilewright.functions.scalar import clamp

    return event_image(spark, sf).select("y", "x", clamp("r", 0, 255).alias("r"), clamp(idiv(F.col("r") - F.col("b"), 2) + 128, 0, 255).cast("int").alias("co"))


#: Rows that a file's head can count, a multiple of 8; only a taller image becomes several files.
TALLEST = 65_528


def image_round_trip(spark, image, tallest: int = TALLEST):
    """(name, y, x, r, g, b) of an image (y, x, r, g, b) of whole bands of 8 rows, by way of containers: a file where it has at most tallest
    rows, else files of tallest rows each, and one of what is left in a folder of its own, as the files of a folder have one size."""
    from tilewright.api import TileEngine

    engine = TileEngine(spark)
    height = image.agg((F.max("y") + 1).alias("rows")).first().rows or 0
    whole = height // tallest * tallest
    out = image.where("false").select(F.lit("").alias("name"), "y", "x", *"rgb")
    for part, rows in ((F.col("y") < whole, tallest * (whole > 0)), (F.col("y") >= whole, height - whole)):
        if rows:
            where = scratch(spark)
            engine.encode(image.where(part).select(idiv("y", tallest).cast("int").alias("image_id"), (F.col("y") % tallest).alias("y"), "x", *"rgb"), WIDTH, rows, where)
            out = out.unionByName(engine.decode(where).drop("a"))
    return out


@query("op_io6_image_round_trip", None)
def _(spark, sf):
    return image_round_trip(spark, mixed_image(spark, sf))


# ---- alpha


def _alpha_images(spark, sf):
    """Images of 64 rows of the plane with alpha of five kinds in turn: analog, two values, analog in eight bits, full, analog in one corner."""
    k, corner = idiv("y", 64) % 5, (F.col("x") < 32) & (F.col("y") % 64 < 40)
    v = F.col("v")
    a = F.when(k == 0, F.when(v >= 90, v).otherwise(0)).when(k == 1, F.when(v >= 128, 255).otherwise(0)).when(k == 2, v).when(k == 3, 255).otherwise(F.when(corner, v).otherwise(0))
    return embedding_plane(spark, sf).select(idiv("y", 64).cast("int").alias("image_id"), (F.col("y") % 64).cast("int").alias("y"), "x", a.cast("int").alias("a"), (k == 2).alias("eight"))


_ALPHA = """,
al AS MATERIALIZED (SELECT (y // 64)::INT AS image_id, (y % 64)::INT AS y, x, (CASE y // 64 % 5 WHEN 0 THEN CASE WHEN v >= 90 THEN v ELSE 0 END WHEN 1 THEN CASE WHEN v >= 128 THEN 255 ELSE 0 END WHEN 2 THEN v WHEN 3 THEN 255
  ELSE CASE WHEN x < 32 AND y % 64 < 40 THEN v ELSE 0 END END)::INT AS a FROM emb),
mk AS (SELECT image_id, y // 16 AS my, x // 16 AS mx FROM al GROUP BY ALL HAVING max(a) >= 4),
bx AS (SELECT image_id, min(x) // 4 * 4 AS x0, min(y) AS y0, (max(x) + 4) // 4 * 4 AS x1, max(y) + 1 AS y1 FROM al WHERE a >= 4 GROUP BY image_id),
ky AS (SELECT image_id, x0, y0, x1, y1, bool_or(a BETWEEN 1 AND 254) AS analog, min(a) = 0 AND max(a) = 255 AS both_ FROM al JOIN bx USING (image_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL),
kk AS (SELECT *, CASE WHEN analog THEN CASE WHEN image_id % 5 = 2 THEN 6 WHEN (SELECT count(*) FROM mk WHERE mk.image_id = ky.image_id) = 16 THEN 5 ELSE 3 END WHEN both_ THEN 1 END AS kind FROM ky),
pn AS MATERIALIZED (SELECT image_id, kind, (CASE WHEN kind = 1 THEN x0 // 8 * 8 ELSE x0 END)::INT AS x0, y0, (CASE WHEN kind = 1 THEN (x1 + 7) // 8 * 8 ELSE x1 END)::INT AS x1, y1 FROM kk WHERE kind IS NOT NULL),
vs AS MATERIALIZED (SELECT image_id, y, x, a, kind FROM al JOIN pn USING (image_id) LEFT JOIN mk ON mk.image_id = al.image_id AND my = y // 16 AND mx = x // 16
  WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND (kind <> 3 OR my IS NOT NULL))"""


@query("op_e15_alpha_streams", duck("emb", _ALPHA + """,
nb AS (SELECT image_id, kind, CASE kind WHEN 1 THEN 1 WHEN 6 THEN 8 ELSE 6 END AS bits, CASE kind WHEN 1 THEN a & 1 WHEN 6 THEN a ELSE 63 - (a >> 2) END AS v, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS pos FROM vs),
bt AS (SELECT image_id, pos * bits + i AS p, (v >> i) & 1 AS bit FROM nb, range(8) t(i) WHERE i < bits),
by_ AS (SELECT image_id, p // 8 AS byte, sum(bit << (p % 8))::INT AS b FROM bt GROUP BY ALL),
hx AS (SELECT image_id, string_agg(printf('%02X', b), '' ORDER BY byte) AS hex FROM by_ GROUP BY image_id)
SELECT image_id, kind, x0, y0, x1, y1, hex FROM pn JOIN hx USING (image_id)"""))
def _(spark, sf):
    """How each image's alpha is written, and its stream before compression."""
    images_ = _alpha_images(spark, sf)
    mask = gradient.checkpointed(streams.used_tiles(images_))
    plan = gradient.checkpointed(streams.alpha_plan(images_, mask, WIDTH, 64, F.col("eight")))
    return _whole(streams.alpha_bytes(streams.alpha_values(images_, plan, mask)), ["image_id"]).join(plan, "image_id")


def _whole(values, keys):
    """(keys, hex): whole streams (keys, at, v)."""
    parts = streams.blocks(values, keys)
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "data"))), lambda s: F.hex(s["data"])), "").alias("hex"))


@query("op_e15_alpha_round_trip", duck("emb", _ALPHA + """
SELECT 'image-' || al.image_id AS name, al.y, al.x, (CASE WHEN pn.kind IS NULL THEN 255 WHEN vs.kind IS NULL THEN 0 WHEN pn.kind = 1 THEN (al.a & 1) * 255 WHEN pn.kind = 6 THEN al.a ELSE ((al.a >> 2) << 2) | (al.a >> 6) END)::INT AS a
FROM al LEFT JOIN pn USING (image_id) LEFT JOIN vs ON vs.image_id = al.image_id AND vs.y = al.y AND vs.x = al.x"""))
def _(spark, sf):
    """The alpha of those images through files and back: chunks of masks and alpha, the last image as long as it is."""
    pixels = _alpha_images(spark, sf)
    height = (pixels.groupBy("image_id").agg((F.max("y") + 1).alias("rows")).agg(F.collect_set("rows").alias("rows")).first().rows) or []
    out = None
    for rows in sorted(height):
        where = scratch(spark)
        mine = pixels.join(pixels.groupBy("image_id").agg((F.max("y") + 1).alias("rows")).where(F.col("rows") == rows).select("image_id"), "image_id", "left_semi")
        chunks = images.encode_alpha(mine, WIDTH, rows, F.col("eight"))
        flat = mine.select(F.concat(F.lit("image-"), "image_id").alias("name")).distinct().join(chunks.select("name").distinct(), "name", "left_anti")
        empty = flat.select("name", F.lit(WIDTH).alias("width"), F.lit(rows).alias("height"), F.lit(True).alias("alpha"), F.lit(0).alias("seq"), F.lit(container.RANGE).alias("tag"), F.lit(b"").alias("payload"))
        container.write_containers(chunks.unionByName(empty), where)
        read = container.read_containers(spark, where).withColumn("name", F.regexp_extract("path", r"(image-\d+)\.tile", 1))
        got = images.decode_alpha(read, WIDTH, rows)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else pixels.select(F.lit("").alias("name"), "y", "x", "a")
