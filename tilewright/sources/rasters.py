"""Raster views over the test tables, and small planes from range(): pixels (y, x, ...), integer channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.scalar import idiv

WIDTH = 64


def embedding_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): a row for each component of each vector, scaled to 0..255; whole bands of 8 rows only."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.agg((idiv(F.count("*"), 8) * 8).alias("rows"))
    bytes_ = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255.0).cast("int"))))
    kept = table.crossJoin(F.broadcast(rows)).where("vec_id < rows")
    return kept.select(F.col("vec_id").cast("int").alias("y"), F.posexplode(bytes_).alias("x", "v"))


def event_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, r, g, b): three noisy channels, 64 pixels wide; whole bands of 8 rows only."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    size = table.agg((idiv(idiv(F.count("*"), WIDTH), 8) * 8 * WIDTH).alias("pixels"))
    return (
        table.crossJoin(F.broadcast(size))
        .where("event_id < pixels")
        .select(
            idiv("event_id", WIDTH).cast("int").alias("y"),
            (F.col("event_id") % WIDTH).cast("int").alias("x"),
            (F.floor("value") % 256).cast("int").alias("r"),
            (F.col("user_id") % 256).cast("int").alias("g"),
            (F.col("event_id") * 37 % 256).cast("int").alias("b"),
        )
    )


def mixed_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_image with a smooth left half whose steps ask for several tile sizes."""
    y, x = F.col("y"), F.col("x")
    smooth = x < 32
    return event_image(spark, sf_dir).select(
        "y",
        "x",
        F.when(smooth, x + 40 + y % 64).otherwise(F.col("r")).alias("r"),
        F.when(smooth, F.lit(200) - x - y % 32).otherwise(F.col("g")).alias("g"),
        F.when(smooth, F.lit(90)).otherwise(F.col("b")).alias("b"),
    )


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(y, x) of a plane."""
    return spark.range(height * width).select(idiv("id", width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def overlap_plane(spark: SparkSession) -> DataFrame:
    """32 x 32 with a patch of noise that tells top-left from whole-tile eligibility."""
    y, x = F.col("y"), F.col("x")
    noise = x.between(9, 15) & y.between(1, 7)
    v = F.when(noise, (x * 7 + y * 3) % 2 * 255).otherwise(x * 2 + y + 40).cast("int")
    return grid(spark, 32, 32).select("y", "x", v.alias("r"), v.alias("g"), v.alias("b"))


def island_mask(spark: SparkSession) -> DataFrame:
    """(y, x, m): lone pixels, pairs, a component of 51 and one of 50 pixels."""
    y, x = F.col("y"), F.col("x")
    on = (
        ((y == 1) & (x == 1)) | ((y == 3) & x.between(5, 6)) | ((x == 20) & y.between(2, 3))
        | (y.between(8, 10) & x.between(2, 18)) | (y.between(16, 20) & x.between(2, 11)) | ((y == 30) & x.between(0, 2))
    )
    return grid(spark, 32, 32).select("y", "x", on.cast("int").alias("m"))


def lut_bank(spark: SparkSession, points: int = 64) -> DataFrame:
    """(lut_id, idx, x, y, z): four deterministic point sequences in a cube of side 64."""
    i = F.col("idx")
    curves = [
        (i, i, i),
        (i, i, idiv(i * i, 63)),
        (i, F.when(i < 32, i * 2).otherwise(F.lit(63)), F.when(i < 32, F.lit(0)).otherwise((i - 32) * 2 + 1)),
        (i, F.lit(63) - idiv((F.lit(63) - i) * (F.lit(63) - i), 63), idiv(i * i, 63)),
    ]
    base = spark.range(points).select(F.col("id").cast("int").alias("idx"))
    parts = [base.select(F.lit(k).alias("lut_id"), "idx", *[v.cast("int").alias(n) for v, n in zip(curve, "xyz", strict=True)]) for k, curve in enumerate(curves)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vector_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lut_id, idx, x, y, z): a table of 64 points for each three vectors, which are its three axes; vectors without two others are left out."""
    plane = embedding_plane(spark, sf_dir)
    axis = lambda k: F.max(F.when(F.col("y") % 3 == k, F.shiftright("v", 2))).alias("xyz"[k])
    found = plane.groupBy(idiv("y", 3).cast("int").alias("lut_id"), F.col("x").alias("idx")).agg(*map(axis, range(3)), F.count("*").alias("n"))
    return found.where("n = 3").drop("n")


def blank_images(sizes: DataFrame, channels: list[str]) -> DataFrame:
    """(image_id, y, x, <channels>): images of one value from (image_id, width, height, value); sizes of 0 give no pixels."""
    span = lambda k: F.explode(F.expr(f"if({k} > 0, sequence(0, {k} - 1), array())"))
    lines = sizes.select("image_id", "width", "value", span("height").alias("y"))
    return lines.select("image_id", "y", span("width").alias("x"), *[F.col("value").alias(c) for c in channels])


#: The same views in DuckDB.
DUCK = {
    "vbank": """vbank AS MATERIALIZED (SELECT (y // 3)::INT AS lut_id, x AS idx, max(v >> 2) FILTER (y % 3 = 0) AS x, max(v >> 2) FILTER (y % 3 = 1) AS y, max(v >> 2) FILTER (y % 3 = 2) AS z
  FROM emb GROUP BY ALL HAVING count(*) = 3)""",
    "emb": """emb AS MATERIALIZED (SELECT vec_id::INT AS y, (i - 1)::INT AS x,
  least(255, greatest(0, floor((embedding[i]::DOUBLE + 0.5) * 255.0)::INT))::INT AS v
  FROM embeddings, range(1, 65) t(i) WHERE vec_id < (SELECT count(*) // 8 * 8 FROM embeddings))""",
    "evt": """evt AS MATERIALIZED (SELECT (event_id // 64)::INT AS y, (event_id % 64)::INT AS x, (floor(value)::BIGINT % 256)::INT AS r,
  (user_id % 256)::INT AS g, (event_id * 37 % 256)::INT AS b
  FROM events WHERE event_id < (SELECT count(*) // 64 // 8 * 8 * 64 FROM events))""",
    "mix": """mix AS MATERIALIZED (SELECT y, x, CASE WHEN x < 32 THEN 40 + x + y % 64 ELSE r END AS r,
  CASE WHEN x < 32 THEN 200 - x - y % 32 ELSE g END AS g, CASE WHEN x < 32 THEN 90 ELSE b END AS b FROM evt)""",
    "over": """over_ AS (SELECT y, x, CASE WHEN x BETWEEN 9 AND 15 AND y BETWEEN 1 AND 7 THEN (7 * x + 3 * y) % 2 * 255 ELSE 40 + 2 * x + y END AS v
  FROM (SELECT (i // 32)::INT AS y, (i % 32)::INT AS x FROM range(1024) t(i)))""",
    "isl": """isl AS (SELECT y, x, (y = 1 AND x = 1 OR y = 3 AND x BETWEEN 5 AND 6 OR x = 20 AND y BETWEEN 2 AND 3 OR y BETWEEN 8 AND 10 AND x BETWEEN 2 AND 18
  OR y BETWEEN 16 AND 20 AND x BETWEEN 2 AND 11 OR y = 30 AND x BETWEEN 0 AND 2)::INT AS m
  FROM (SELECT (i // 32)::INT AS y, (i % 32)::INT AS x FROM range(1024) t(i)))""",
    "lut": """lut AS (SELECT 0 AS lut_id, i::INT AS idx, i::INT AS x, i::INT AS y, i::INT AS z FROM range(64) t(i)
  UNION ALL SELECT 1, i, i, i, i * i // 63 FROM range(64) t(i)
  UNION ALL SELECT 2, i, i, CASE WHEN i < 32 THEN 2 * i ELSE 63 END, CASE WHEN i < 32 THEN 0 ELSE 2 * (i - 32) + 1 END FROM range(64) t(i)
  UNION ALL SELECT 3, i, i, 63 - (63 - i) * (63 - i) // 63, i * i // 63 FROM range(64) t(i))""",
}


def duck(names: str, body: str) -> str:
    """A DuckDB query whose WITH list has these views; further CTEs of body follow a leading comma."""
    parts = [DUCK[n] for n in names.split()]
    return "WITH RECURSIVE " + ",\n".join(parts) + body


def large_components_sql(source: str, least: int = 50) -> str:
    """CTEs for DuckDB: keep (image_id, y, x), the pixels of source (image_id, y, x) in 4-connected components of more than least."""
    return f"""
ps AS MATERIALIZED (SELECT image_id, y, x, image_id * 4096 + y * 64 + x AS k FROM {source}),
ph AS (SELECT a.k AS a, b.k AS b FROM ps a JOIN ps b ON b.k = a.k + 64 AND b.image_id = a.image_id UNION ALL SELECT a.k, b.k FROM ps a JOIN ps b ON b.k = a.k + 1 WHERE a.x < 63),
pe AS MATERIALIZED (SELECT a, b FROM ph UNION ALL SELECT b, a FROM ph),
pw AS (SELECT k, k AS l FROM ps UNION SELECT pe.b, pw.l FROM pw JOIN pe ON pe.a = pw.k),
pc AS MATERIALIZED (SELECT k, min(l) AS l FROM pw GROUP BY k),
pz AS (SELECT l FROM pc GROUP BY l HAVING count(*) > {least}),
keep AS MATERIALIZED (SELECT image_id, y, x FROM ps JOIN pc USING (k) SEMI JOIN pz USING (l))"""
