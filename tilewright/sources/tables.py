"""Files of point tables: a header, then the X, Y and Z runs of every table by depth, and the modes a decoder makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.scalar import swap_axes
from tilewright.operators import lut
from tilewright.sources.container import ContainerError

#: The tags of three- and two-channel tables, header bytes, bytes of a table's axis over all depths, tables in a file.
TAGS, HEADER, AXIS, MOST = {3: b"LUL", 2: b"LU2"}, 8, 64 + 32 + 16 + 8, 256
#: Modes of a table and their places in memory; places without a mode hold FILLER.
MODES, PLACES, FILLER = 48, 64, 251


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_tables(bank: DataFrame, path: str, channels: int = 3) -> None:
    """Write (lut_id, idx, x, y, z) as one file, tables in the order of lut_id; two-channel files hold no z. At most MOST tables of AXIS bytes an axis,
    so it is made on the driver. Repeated rows, no table and more than MOST are INVALID_LUT."""
    write_factors(lut.factors(bank), path, channels)


def write_factors(scaled: DataFrame, path: str, channels: int = 3) -> None:
    """write_tables of (lut_id, depth, idx, fx, fy, fz)."""
    spark = scaled.sparkSession
    runs = lut.pack_runs(scaled, "xyz"[:channels]).limit(4 * MOST + 1).collect()
    tables = sorted({r.lut_id for r in runs})
    whole = {(r.depth, r.lut_id): bytes(r.data) for r in runs}
    if not 1 <= len(tables) <= MOST or len(whole) != 4 * len(tables) or any(len(data) != channels << depth for (depth, _), data in whole.items()):
        raise ContainerError("INVALID_LUT", f"a file has 1 to {MOST} tables of 64 points")
    head = TAGS[channels] + b"0" + bytes([0, len(tables) - 1, 1, 0])
    where, store = _path(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(head + b"".join(whole[depth, t] for depth in (3, 4, 5, 6) for t in tables)))
    finally:
        out.close()


def read_tables(spark: SparkSession, path: str, channels: int = 3) -> DataFrame:
    """(lut_id, depth, idx, fx, fy, fz) of a file, lut_id counted from 0; fz is 0 in two-channel files. INVALID_LUT where the tag is another one or the
    size is not that of the tables that the header counts."""
    file = spark.read.format("binaryFile").load(path).select("length", "content")
    found = file.select("length", F.substring("content", 1, HEADER).alias("head")).limit(2).collect()
    if len(found) != 1 or found[0].length < HEADER or bytes(found[0]["head"])[:3] != TAGS[channels]:
        raise ContainerError("INVALID_LUT", f"not a file of tables of {channels} channels")
    many = found[0]["head"][5] + 1
    if found[0].length != HEADER + many * AXIS * channels:
        raise ContainerError("INVALID_LUT", f"{many} tables take {HEADER + many * AXIS * channels} bytes, not {found[0].length}")
    depth = F.explode(F.array(*[F.lit(d) for d in (3, 4, 5, 6)])).alias("depth")
    each = file.select("content", depth).select("*", F.expr("shiftleft(1, depth)").alias("n"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("lut_id"))
    # the runs of the depths before take channels * many * (n - 8) bytes
    start = F.col("n") * channels * F.col("lut_id") + (F.col("n") - 8) * (channels * many) + HEADER
    runs = each.withColumn("s", start)
    runs = runs.select("lut_id", "depth", "n", *[F.hex(F.expr(f"substring(content, s + {k} * n + 1, n)")).alias(f"h{k}") for k in range(channels)])
    points = runs.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("idx"))
    axis = lambda k: F.conv(F.expr(f"substring(h{k}, 2 * idx + 1, 2)"), 16, 10).cast("int") if k < channels else F.lit(0)
    return points.select("lut_id", "depth", "idx", *[axis(k).alias(f"f{a}") for k, a in enumerate("xyz")])


def points_of(scaled: DataFrame) -> DataFrame:
    """(lut_id, idx, x, y, z) of factors: the points of 0..63 that scale to those of the greatest depth."""
    back = lambda k: F.ceil(F.col(f"f{k}") * (lut.SIDE - 1) / lut.FACTOR).cast("int").alias(k)
    return scaled.where("depth = 6").select("lut_id", "idx", *[back(k) for k in "xyz"])


def expanded(factors: DataFrame) -> DataFrame:
    """(lut_id, depth, mode, idx, x, y, z): each table under all PLACES, axes swapped and then flipped in 0..128."""
    top = F.lit(lut.FACTOR)
    each = factors.select("*", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("mode"))
    each = each.withColumn("t", swap_axes(F.expr("shiftright(mode, 3)"), "fx", "fy", "fz"))

    def value(k: int, a: str):
        moved = F.when(F.expr(f"mode & {1 << k}") != 0, top - F.col("t")[a]).otherwise(F.col("t")[a])
        return F.when(F.col("mode") < MODES, moved).otherwise(FILLER).cast("int").alias(a)

    return each.select("lut_id", "depth", "mode", "idx", *[value(k, a) for k, a in enumerate("xyz")])


def expanded_runs(factors: DataFrame) -> DataFrame:
    """(lut_id, depth, mode, x, y, z): the runs of expanded as hexadecimal digits, in the order of idx. A mode takes each axis of a table whole, as it is or
    flipped, so the six runs of a table and depth are written once and picked from; only they are gathered."""
    top = F.lit(lut.FACTOR)
    points = F.sort_array(F.collect_list(F.struct("idx", "fx", "fy", "fz"))).alias("points")
    two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    run = lambda f: F.array_join(F.transform("points", lambda s: two(f(s))), "")
    own = [run(lambda s, k=k: s[f"f{k}"]).alias(f"h{k}") for k in "xyz"]
    flipped = [run(lambda s, k=k: top - s[f"f{k}"]).alias(f"g{k}") for k in "xyz"]
    filler = run(lambda s: F.lit(FILLER)).alias("filler")
    each = factors.groupBy("lut_id", "depth").agg(points).select("lut_id", "depth", *own, *flipped, filler)
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("mode"))
    order = F.expr("shiftright(mode, 3)")
    each = each.withColumn("t", swap_axes(order, "hx", "hy", "hz")).withColumn("u", swap_axes(order, "gx", "gy", "gz"))
    axis = lambda k, a: F.when(F.col("mode") >= MODES, F.col("filler")).when(F.expr(f"mode & {1 << k}") != 0, F.col("u")[a]).otherwise(F.col("t")[a]).alias(a)
    return each.select("lut_id", "depth", "mode", *[axis(k, a) for k, a in enumerate("xyz")])


def table_files(scaled: DataFrame, channels: int = 3) -> DataFrame:
    """(name, data): a file for each file of (file, lut_id, depth, idx, fx, fy, fz), lut_id counting from 0 in each. As write_factors, but made by the
    cluster: of a file only its bytes, at most 92 KB, meet in a row. Files of more than MOST tables are left out."""
    runs = lut.pack_runs(scaled, "xyz"[:channels], ("file",))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "lut_id", F.hex("data").alias("h")))), lambda s: s["h"]), "")
    whole = runs.groupBy("file").agg(F.count_distinct("lut_id").alias("many"), body.alias("body")).where(F.col("many") <= MOST)
    head = F.concat(F.lit((TAGS[channels] + b"0\0").hex()), F.lpad(F.hex((F.col("many") - 1).cast("long")), 2, "0"), F.lit("0100"))
    return whole.select(F.concat(F.col("file").cast("string"), F.lit(".lut")).alias("name"), F.unhex(F.concat(head, "body")).alias("data"))


def read_table_files(spark: SparkSession, path: str, channels: int = 3) -> DataFrame:
    """(path, lut_id, depth, idx, fx, fy, fz, error) of all files *.lut of a folder; a file with another tag or size is one row with INVALID_LUT."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lut").load(path).select("path", "length", "content")
    byte = lambda at: F.conv(F.hex(F.substring("content", at, F.lit(1))), 16, 10).cast("int")
    many = byte(F.lit(6)) + 1
    good = (F.col("length") >= HEADER) & (F.hex(F.substring("content", 1, 3)) == TAGS[channels].hex().upper()) & (F.col("length") == many * AXIS * channels + HEADER)
    sized = files.withColumn("many", F.coalesce(F.when(good, many), F.lit(0)))
    each = sized.withColumn("lut_id", F.explode(F.when(F.col("many") > 0, F.sequence(F.lit(0), F.col("many") - 1)).otherwise(F.array(F.lit(None).cast("int")))))
    each = each.withColumn("depth", F.explode(F.when(F.col("many") > 0, F.array(*map(F.lit, (3, 4, 5, 6)))).otherwise(F.array(F.lit(None).cast("int")))))
    each = each.withColumn("n", F.expr("shiftleft(1, depth)")).withColumn("s", F.col("n") * channels * F.col("lut_id") + (F.col("n") - 8) * (F.col("many") * channels) + HEADER)
    runs = each.select("path", "lut_id", "depth", "n", *[F.hex(F.expr(f"substring(content, s + {k} * n + 1, n)")).alias(f"h{k}") for k in range(channels)])
    points = runs.withColumn("idx", F.explode(F.coalesce(F.expr("sequence(0, n - 1)"), F.array(F.lit(None).cast("int")))))
    axis = lambda k: F.conv(F.expr(f"substring(h{k}, 2 * idx + 1, 2)"), 16, 10).cast("int") if k < channels else F.lit(0)
    error = F.when(F.col("idx").isNull(), "INVALID_LUT: another tag or size")
    return points.select("path", "lut_id", "depth", "idx", *[axis(k).alias(f"f{a}") for k, a in enumerate("xyz")], error.alias("error"))
