"""The one-dimensional tile quantiser: a frequent value, and steps over the range of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import by, c, level_symbol, level_value, level_value_fixed

from . import stats

STEPS = 15


def encode(pixels: DataFrame, value: str, free: Column | None = None, th: int = 8, tw: int = 8, steps: int = STEPS) -> DataFrame:
    """(y, x, sym, color0, mn, dl) of the free pixels: symbol 0 within 1 of the tile's frequent value, else 1 + step.

    Where the range is 1 and the value is its least, the step is -1 and the symbol 0 as well."""
    kept = pixels if free is None else pixels.where(free)
    histogram = stats.tile_histogram(kept, value, th, tw)
    params = stats.remaining_range(histogram, stats.frequent_color(histogram))
    keys = by(pixels)
    tiled = kept.select(*keys, "y", "x", c(value).alias("v"), *stats.tile(th, tw))
    step = level_symbol("v", "mn", "dl", steps)
    symbol = F.when(F.abs(F.col("v") - F.col("color0")) <= 1, 0).otherwise(step + 1).cast("int")
    return tiled.join(params, [*keys, "ty", "tx"]).select(*keys, "y", "x", symbol.alias("sym"), "color0", "mn", "dl")


def decode(symbols: DataFrame, fixed: bool = True, steps: int = STEPS) -> DataFrame:
    """(y, x, v) from encode's rows."""
    value = (level_value_fixed if fixed else level_value)(F.col("sym") - 1, "mn", "dl", steps)
    return symbols.select(*by(symbols), "y", "x", F.when(F.col("sym") == 0, F.col("color0")).otherwise(value).cast("int").alias("v"))


def best_table(pixels: DataFrame, value: str, th: int = 8, tw: int = 8) -> DataFrame:
    """(ty, tx, base, span, mode, err): of six tables (linear, rising, falling, of 16 and 8 steps) the one with the
    least total error, of equals the last; tables span the tile's coded base and range."""
    from tilewright.functions.scalar import base_decode, base_encode, level_table, range_decode, range_encode

    keys = [*by(pixels), "ty", "tx"]
    box = pixels.groupBy(*by(pixels), *stats.tile(th, tw)).agg(F.min(c(value)).alias("lo"), F.max(c(value)).alias("hi"))
    base = box.withColumn("base", base_decode(base_encode("lo")).cast("int"))
    span = range_decode(range_encode(F.greatest(F.col("hi") - F.least(F.col("lo"), F.lit(224)), F.lit(16)), "base"), "base")
    coded = base.withColumn("span", span.cast("int")).withColumn("t16", level_table("base", "span", 16)).withColumn("t8", level_table("base", "span", 8))
    tables = [F.col(f"t{n}")[k] for n in (16, 8) for k in ("linear", "rising", "falling")]
    tiled = pixels.select(*by(pixels), c(value).alias("v"), *stats.tile(th, tw)).join(coded.select(*keys, "base", "span", F.array(*tables).alias("tables")), keys)
    error = F.transform("tables", lambda t: F.array_min(F.transform(t, lambda q: F.abs(q - F.col("v")))))
    sums = tiled.select(*keys, "base", "span", F.posexplode(error).alias("mode", "e")).groupBy(*keys, "base", "span", "mode").agg(F.sum("e").alias("err"))
    best = F.min(F.struct("err", (-F.col("mode")).alias("m"))).alias("best")
    return sums.groupBy(*keys, "base", "span").agg(best).select(*keys, "base", "span", (-F.col("best.m")).alias("mode"), F.col("best.err").alias("err"))
