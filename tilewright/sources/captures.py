"""Captured patterns: the normalised colours of tiles as files, and files as point tables, all at once or as they come into a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.scalar import c, idiv, morton2, morton3
from tilewright.operators import lut
from tilewright.sources.files import qualified, write_files

#: Points that a file can count; points that a pattern keeps; pixels that a tile must have to be captured.
COUNTED, KEPT, LEAST = 255, 64, 64


def capture_files(places: DataFrame, tw: int, th: int) -> DataFrame:
    """(name, data) of tiles (image_id, ty, tx, y, x, ix, iy, iz) with LEAST pixels or more: a count, then the X, the Y and the Z run of 0..63, in rows of the
    tile. A file for each tile, in a folder for each image. Tiles have at most COUNTED pixels."""
    run = lambda a: F.array_join(F.transform("p", lambda s: F.lpad(F.hex(s[a].cast("long")), 2, "0")), "")
    listed = F.sort_array(F.collect_list(F.struct("y", "x", "ix", "iy", "iz"))).alias("p")
    tiles = places.groupBy("image_id", "ty", "tx").agg(listed).where(F.size("p").between(LEAST, COUNTED))
    name = F.concat(F.lit("image="), "image_id", F.lit("/tile-"), F.col("tx") * tw, F.lit("-"), F.col("ty") * th, F.lit(".lut"))
    return tiles.select(name.alias("name"), F.unhex(F.concat(F.lpad(F.hex(F.size("p").cast("long")), 2, "0"), run("ix"), run("iy"), run("iz"))).alias("data"))


def write_captures(places: DataFrame, path: str, tw: int, th: int) -> None:
    write_files(capture_files(places, tw, th), path)


def points_of(files: DataFrame, axes: str = "xyz") -> DataFrame:
    """(path, size, n, <axes>, error) of binary files (path, content): a row for each point; a file that is not as long as its count says is one row
    with INVALID_LUT. Works on a stream of files as well."""
    byte = lambda at: F.conv(F.hex(F.substring("content", at, F.lit(1))), 16, 10).cast("int")
    sized = files.where(F.length("content") > 0).select("path", "content", byte(F.lit(1)).alias("size"))
    whole = F.length("content") == F.col("size") * len(axes) + 1
    each = sized.withColumn("n", F.explode(F.when(whole & (F.col("size") > 0), F.sequence(F.lit(0), F.col("size") - 1)).otherwise(F.array(F.lit(None).cast("int")))))
    values = [byte((F.col("n") + F.col("size") * k + 2).cast("int")).alias(a) for k, a in enumerate(axes)]
    return each.select("path", "size", "n", *values, F.when(~whole, F.lit("INVALID_LUT: the file is not as long as its count says")).alias("error"))


def read_captures(spark: SparkSession, path: str, axes: str = "xyz") -> DataFrame:
    """points_of all files *.lut under a path, its folders included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lut").option("recursiveFileLookup", "true").load(path)
    return points_of(files.select("path", "content"), axes)


def patterns(points: DataFrame, axes: str = "xyz") -> DataFrame:
    """(path, idx, <axes>): the points of each file in the order of their interleaved bits, more than KEPT of them cut to KEPT by the mean of each bucket."""
    code = morton3(*axes) if len(axes) == 3 else morton2(*axes)
    order = Window.partitionBy("path").orderBy(code, "n")
    ranked = points.where("n is not null").select("path", "size", *axes, (F.row_number().over(order) - 1).alias("idx"))
    full = ranked if len(axes) == 3 else ranked.withColumn("z", F.lit(0))
    return lut.reduce_points(full, "size", KEPT, ["path"]).select("path", "idx", *axes)


def image_patterns(pixels: DataFrame) -> DataFrame:
    """(path, size, n, x, y) of images (path, y, x, r) drawn as patterns: the first KEPT pixels, row by row, that are not 0; their coordinates are the points."""
    order = Window.partitionBy("path").orderBy("y", "x")
    lit = pixels.where(c("r") != 0).select("path", "y", "x", (F.row_number().over(order) - 1).alias("n")).where(F.col("n") < KEPT)
    return lit.select("path", F.count("*").over(Window.partitionBy("path")).alias("size"), "n", "x", "y")


def scan_captures(spark: SparkSession, path: str, table: str, checkpoint: str) -> DataFrame:
    """The patterns of a folder's files, in a table that grows: files that have come since the scan before are read, each once.

    What has been read is kept by the file source in checkpoint. A batch is a folder of the table and is written over when it is repeated after
    a failure, so no file counts twice. path, table and checkpoint are shared by the driver and all executors."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.lut").option("recursiveFileLookup", "true").load(path)
    where = qualified(spark, table)

    def keep(batch: DataFrame, number: int) -> None:
        patterns(points_of(batch.select("path", "content"))).write.mode("overwrite").parquet(f"{where}/batch={number}")

    files.writeStream.foreachBatch(keep).option("checkpointLocation", qualified(spark, checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, idx int, x int, y int, z int, batch int").parquet(where)


def named(frame: DataFrame) -> DataFrame:
    """path as image_id and the tile's place (name)."""
    name = F.regexp_extract("path", r"image=([^/]+)/tile-(\d+-\d+)", 2)
    return frame.withColumn("image_id", F.regexp_extract("path", r"image=([^/]+)/", 1)).withColumn("name", name).drop("path")




def banks(found: DataFrame) -> DataFrame:
    """(image_id, lut_id, idx, x, y, z): the patterns (image_id, name, idx, ...) of each image as its bank, tables numbered in rows of tiles. Banks of more
    than lut.MOST_TABLES are refused when they are used."""
    left, top = F.regexp_extract("name", r"(\d+)-", 1).cast("int"), F.regexp_extract("name", r"-(\d+)", 1).cast("int")
    number = F.dense_rank().over(Window.partitionBy("image_id").orderBy(top, left)) - 1
    return found.select("image_id", number.alias("lut_id"), "idx", *"xyz")


def cloud_files(pixels: DataFrame, channels: list[str], tw: int, th: int) -> DataFrame:
    """(name, data): a text file of points for each tile (image_id, ty, tx, y, x, <channels>, <channel>0/1 ...): the corners of a cube of side 255 in white, then
    for each pixel, row by row, the 27 places around its own in the cube, with its colour."""
    corners = "".join(f"{x},{y},{z},255,255,255\n" for z in (0, 255) for y in (0, 255) for x in (0, 255))

    def place(n: str):
        span = F.col(f"{n}1") - F.col(f"{n}0")
        step = F.when(span > 0, idiv(F.lit(1 << 20), F.when(span > 0, span))).otherwise(0)
        part = (((c(n) - F.col(f"{n}0")) * step).cast("float") / float(1 << 20)).cast("float")
        return (part * F.lit(255.0).cast("float")).cast("int")

    around = [(dx, dy, dz) for dy in (-1, 0, 1) for dx in (-1, 0, 1) for dz in (-1, 0, 1)]
    color = F.concat_ws(",", *channels)
    lines = F.concat(*[F.concat(F.concat_ws(",", *[F.col(f"_{a}") + d for a, d in zip("xyz", step, strict=True)]), F.lit(","), F.col("_c"), F.lit("\n")) for step in around])
    placed = pixels.select("image_id", "ty", "tx", "y", "x", *[place(n).alias(f"_{a}") for n, a in zip(channels, "xyz", strict=True)], color.alias("_c"))
    listed = F.sort_array(F.collect_list(F.struct("y", "x", "s")))
    tiles = placed.withColumn("s", lines).groupBy("image_id", "ty", "tx").agg(F.concat(F.lit(corners), F.array_join(F.transform(listed, lambda p: p["s"]), "")).alias("text"))
    name = F.concat(F.lit("image="), "image_id", F.lit("/tile-"), F.col("tx") * tw, F.lit("-"), F.col("ty") * th, F.lit(".xyz"))
    return tiles.select(name.alias("name"), F.col("text").cast("binary").alias("data"))
