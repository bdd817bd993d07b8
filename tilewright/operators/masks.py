"""Per-pixel predicates, masks and set operations on pixel keys."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import by, c, clamp, idiv
from tilewright.sources.shared import shared_folder

OPERATORS = {
    "EQ": lambda a, b: a == b,
    "NEQ": lambda a, b: a != b,
    "LT": lambda a, b: a < b,
    "GT": lambda a, b: a > b,
    "LE": lambda a, b: a <= b,
    "GE": lambda a, b: a >= b,
    "AND": lambda a, b: (a != 0) & (b != 0),
}


def mask(a, op: str, b) -> Column:
    """255 where the comparison holds, else 0; AND is the logical one."""
    return F.when(OPERATORS[op](c(a), c(b)), 255).otherwise(0)


def mask_or_all(pixels: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """(y, x, m): the mask (y, x, m) of the images that have one, 255 everywhere on the others; without image_id there is one image."""
    keys = by(pixels)
    everywhere = pixels.select(*keys, "y", "x", F.lit(255).alias("m"))
    if masks is None:
        return everywhere
    own = masks.select(*keys, "y", "x", "m")
    return own.unionByName(everywhere.join(own.select(*keys).distinct(), keys, "left_anti")) if keys else own


def channel_mask(channels: list, op: str, values: list[int], every: bool) -> Column:
    tests = [OPERATORS[op](c(a), c(b)) for a, b in zip(channels, values, strict=True)]
    return F.when(reduce(lambda p, q: (p & q) if every else (p | q), tests), 255).otherwise(0)


def inside(x0: int, y0: int, w: int, h: int) -> Column:
    return F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)


def fill(value, rect: tuple[int, int, int, int], v: int) -> Column:
    return F.when(inside(*rect), v).otherwise(c(value))


def fill_outside(value, rect: tuple[int, int, int, int]) -> Column:
    """Zero beyond the rectangle."""
    return F.when(inside(*rect), c(value)).otherwise(0)


def in_bounds(x, y, w, h, width: int, height: int) -> Column:
    return (c(x) >= 0) & (c(y) >= 0) & (c(x) + c(w) <= width) & (c(y) + c(h) <= height)


def clamped_read(pixels: DataFrame, wanted: DataFrame, width: int, height: int, value: str = "v") -> DataFrame:
    """wanted (y, x, ...) with the value at the nearest pixel of the plane, and whether the place lay outside."""
    at = wanted.withColumn("ky", clamp("y", 0, height - 1)).withColumn("kx", clamp("x", 0, width - 1))
    source = pixels.select(F.col("y").alias("ky"), F.col("x").alias("kx"), F.col(value))
    out = (F.col("ky") != F.col("y")) | (F.col("kx") != F.col("x"))
    return at.join(source, ["ky", "kx"]).select("y", "x", value, out.alias("outside"))


def quarter_all(pixels: DataFrame, value: str = "m") -> DataFrame:
    """Half the size in both directions: 255 where all four pixels are set."""
    full = F.min(F.when(c(value) != 0, 1).otherwise(0)) == 1
    return pixels.groupBy(*by(pixels), idiv("y", 2).cast("int").alias("y"), idiv("x", 2).cast("int").alias("x")).agg(F.when(full, 255).otherwise(0).alias("m"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, [*by(a), "y", "x"], "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, [*by(a), "y", "x"], "left_anti")


def union(*masks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [m.select(*by(m), "y", "x") for m in masks]).distinct()


def fork(mask_: DataFrame, planes: int = 3) -> DataFrame:
    """The mask once for each plane."""
    return mask_.withColumn("plane", F.explode(F.array(*map(F.lit, range(planes)))))


def labels(pixels: DataFrame) -> DataFrame:
    """(y, x, label) of the set pixels of mask m: the least linear key of the 4-connected component.

    Each round takes the least label of the neighbours and then the label of that label; rounds end when
    nothing changes, and are checkpointed to the shared folder."""
    spark = pixels.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    key = lambda y, x: (F.col(y).cast("long") * (1 << 31) + F.col(x)).alias("key")
    nodes = pixels.where("m <> 0").select("y", "x", key("y", "x"))
    around = F.explode(F.array(*[F.col("key") + d for d in (1 << 31, -(1 << 31), 1, -1)]))
    edges = nodes.select("key", around.alias("other")).join(nodes.select(F.col("key").alias("other")), "other", "left_semi").checkpoint()
    now = nodes.select("key", F.col("key").alias("label")).checkpoint()
    while True:
        near = edges.join(now.select(F.col("key").alias("other"), "label"), "other").groupBy("key").agg(F.min("label").alias("near"))
        least = now.join(near, "key", "left").select("key", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jumped = least.join(least.select(F.col("key").alias("new"), F.col("new").alias("far")), "new").select("key", "label", F.least("new", "far").alias("new")).checkpoint()
        now = jumped.select("key", F.col("new").alias("label"))
        if jumped.where("new <> label").isEmpty():
            return nodes.join(now, "key").select("y", "x", "label")


def erode(pixels: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """keys, y, x, m of whole masks: lone pixels and pairs go, in raster order and in place, then components of at most least pixels."""
    schema = pixels.select(*keys, "y", "x", "m").schema

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        h, w = int(frame.y.max()) + 1, int(frame.x.max()) + 1
        m = np.zeros((h, w), bool)
        m[frame.y, frame.x] = frame.m.to_numpy() != 0

        def at(y: int, x: int) -> bool:
            return bool(m[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])

        shapes = [[(0, 0)], [(0, 0), (0, 1)], [(0, 0), (1, 0)]]
        for shape in shapes:
            ring = {(y + dy, x + dx) for y, x in shape for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))} - set(shape)
            for y, x in zip(*np.nonzero(m.copy()), strict=True):
                # beyond the edge a read gives the edge, so a shape there counts itself among its neighbours
                if all(at(y + dy, x + dx) for dy, dx in shape) and not any(at(y + dy, x + dx) for dy, dx in ring):
                    for dy, dx in shape:
                        if y + dy < h and x + dx < w:
                            m[y + dy, x + dx] = False
        seen = np.zeros_like(m)
        for y, x in zip(*np.nonzero(m), strict=True):
            if seen[y, x]:
                continue
            stack, part = [(y, x)], []
            seen[y, x] = True
            while stack:
                cy, cx = stack.pop()
                part.append((cy, cx))
                for ny, nx in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                    if 0 <= ny < h and 0 <= nx < w and m[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        stack.append((ny, nx))
            if len(part) <= least:
                for cy, cx in part:
                    m[cy, cx] = False
        return frame.assign(m=np.where(m[frame.y, frame.x], 255, 0).astype(frame.m.dtype))[[*keys, "y", "x", "m"]]

    return pixels.select(*keys, "y", "x", "m").groupBy(*keys).applyInPandas(one, schema)
