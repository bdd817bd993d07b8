"""Ordered neighbours: differences, parsing orders, spans, ordinals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.scalar import by, c, idiv

#: Parsing orders: line and place in the line.
LEFT_RIGHT, TOP_DOWN = ("y", "x"), ("x", "y")


def along(order: tuple[str, str], keys=()) -> Window:
    """keys: those of an image, where there are many."""
    return Window.partitionBy(*keys, order[0]).orderBy(order[1])


def delta(value, order: tuple[str, str] = LEFT_RIGHT, keys=()) -> Column:
    """The difference to the pixel before; the first of a line keeps its value."""
    return c(value) - F.coalesce(F.lag(c(value)).over(along(order, keys)), F.lit(0))


def undo_delta(value, order: tuple[str, str] = LEFT_RIGHT, keys=()) -> Column:
    return F.sum(c(value)).over(along(order, keys).rowsBetween(Window.unboundedPreceding, 0)).cast("int")


def parsing_order(pixels: DataFrame, order: tuple[str, str] | Callable[[Column, Column], tuple[Column, Column]], box: tuple[int, int, int, int]) -> DataFrame:
    """(y, x, line, place, is_start) of the pixels of a box (x, y, w, h) in an order; is_start marks a line's first.

    An order is a pair of axes, or a caller's function of a pixel's row and column in the box that gives its line and its place there, from 0."""
    x0, y0, w, h = box
    kept = pixels.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))
    if callable(order):
        line, place = order(c("y") - y0, c("x") - x0)
    else:
        low = {"x": x0, "y": y0}
        line, place = (c(k) - low[k] for k in order)
    return kept.select(*by(pixels), "y", "x", line.alias("line"), place.alias("place"), (place == 0).alias("is_start"))


def smooth_mask(value, least: int = 4, keys=()) -> Column:
    """255 where the differences to the left and upper pixel are both below least; missing neighbours differ by 0."""
    apart = [F.abs(c(value) - F.coalesce(F.lag(c(value)).over(along(o, keys)), c(value))) for o in (LEFT_RIGHT, TOP_DOWN)]
    return F.when(F.greatest(*apart) < least, 255).otherwise(0)


def spans(pixels: DataFrame, used: Column, line: str = "y", place: str = "x") -> DataFrame:
    """(line, start, len) of the runs of used pixels in each line."""
    keys = [*by(pixels), line]
    kept = pixels.where(used).select(*keys, place)
    island = c(place) - F.row_number().over(Window.partitionBy(*keys).orderBy(place))
    return kept.withColumn("island", island).groupBy(*keys, "island").agg(F.min(place).alias("start"), F.count("*").alias("len")).drop("island")


def ordinals(pixels: DataFrame, free: Column, th: int, tw: int) -> DataFrame:
    """(ty, tx, y, x, ord): free pixels numbered within their tile, in rows."""
    within = Window.partitionBy(*by(pixels), "ty", "tx").orderBy("y", "x")
    kept = pixels.where(free).select(*by(pixels), idiv("y", th).cast("int").alias("ty"), idiv("x", tw).cast("int").alias("tx"), "y", "x")
    return kept.withColumn("ord", F.row_number().over(within) - 1)


def offsets(sized: DataFrame, order: list[str], groups: list[str]) -> DataFrame:
    """sized (n, ...) with at, the running start of each row's entries."""
    before = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
