"""Maps of single colours: which colours of an image are worth a map, by the coded size of the map with each of them."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.scalar import by, c, shl, swizzle_place

#: A colour has more than LEAST pixels; a map has MOST colours; a pixel costs BITS elsewhere; gaps of GAP bytes or more are left out of the map.
LEAST, MOST, BITS, GAP = 150, 84, 7, 16
LEVEL = 15


def map_runs(filled: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the parts of a map between its gaps of GAP bytes or more that hold nothing."""
    edges = np.flatnonzero(np.diff(np.concatenate([[1], (filled != 0).astype(np.int8), [1]])))
    out, at = [], 0
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - start >= GAP:
            if start > at:
                out.append((at, start - at))
            at = end
    if at < len(filled):
        out.append((at, len(filled) - at))
    return out


def coded(filled: np.ndarray) -> tuple[bytes, bytes]:
    """The map's bytes between its gaps, and the runs (steps from start to start, lengths), both compressed."""
    import zstandard

    runs = map_runs(filled)
    steps, last = [], 0
    for start, length in runs:
        steps.append(struct.pack("<II", start - last, length))
        last = start
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return pack(b"".join(filled[s : s + n].tobytes() for s, n in runs)), pack(b"".join(steps))


def restored(stream: bytes, runs: bytes, size: int) -> np.ndarray:
    """The map that coded() made these of; ValueError where they do not fit each other or the size."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    data, steps = np.frombuffer(unpack(stream), np.uint8), unpack(runs)
    filled, start, at = np.zeros(size, np.uint8), 0, 0
    for step, length in struct.iter_unpack("<II", steps):
        start += step
        if start + length > size or at + length > len(data):
            raise ValueError("a run beyond the map")
        filled[start : start + length] = data[at : at + length]
        at += length
    if at != len(data):
        raise ValueError("more bytes than the runs take")
    return filled


def choose(places: list[np.ndarray], size: int) -> list[tuple[int, int, int]]:
    """(candidate, stream bytes, run bytes) of the candidates that a map of size bytes takes, most pixels first.

    Each is put into the map and coded with those before. The first that makes all pixels of the map cost more than BITS a pixel ends the
    search; one that costs more than BITS for each of its own pixels is taken out again."""
    filled, taken, pixels, before = np.zeros(size, np.uint8), [], 0, 0
    for k, place in enumerate(places):
        number = len(taken) + 1
        if number > MOST:
            break
        filled[place] = number
        stream, runs = coded(filled)
        total = len(stream) + len(runs)
        if (pixels + len(place)) * BITS < total * 8 + number * 24:
            break
        if (total + 3 * number - before) * 8 > BITS * len(place):
            filled[place] = 0
            continue
        taken.append((k, len(stream), len(runs)))
        pixels, before = pixels + len(place), total
        if not np.array_equal(restored(stream, runs, size), filled):
            raise ValueError("a map that does not come back")
    return taken


MAPS = "image_id int, number int, color int, cnt long, stream int, runs int"


def single_color_maps(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """MAPS: the colours of each image (image_id, y, x, r, g, b) that are worth a place in its map of single colours, with their number there, their
    pixels, and the bytes that the map's stream and its runs take once they are in it.

    Colours are tried from the most frequent on (of equals the least), as taking one leaves the counts of others. The map lies in blocks of 8 x 8.
    Only pixels of colours with more than LEAST meet, and an image's map is one task: as many bytes as it has pixels, as in its file. Images without such
    colours give no row. The width and height are multiples of 8."""
    image = pixels if by(pixels) else pixels.withColumn("image_id", F.lit(0))
    color = shl(c("r"), 16).bitwiseOR(shl(c("g"), 8)).bitwiseOR(c("b")).cast("int")
    colored = image.select(c("image_id").cast("int").alias("image_id"), swizzle_place("y", "x", F.lit(width)).cast("int").alias("place"), color.alias("color"))
    counted = colored.groupBy("image_id", "color").agg(F.count("*").alias("cnt")).where(F.col("cnt") > LEAST)
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("cnt"), "color")))
    size = width * height

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        groups = [g for _, g in frame.groupby("rank", sort=True)]
        found = choose([g.place.to_numpy() for g in groups], size)
        rows = [(int(frame.image_id.iloc[0]), n, int(groups[k].color.iloc[0]), len(groups[k]), stream, runs) for n, (k, stream, runs) in enumerate(found, 1)]
        return pd.DataFrame(rows, columns=["image_id", "number", "color", "cnt", "stream", "runs"])

    return colored.join(ranked, ["image_id", "color"]).select("image_id", "rank", "color", "place").groupBy("image_id").applyInPandas(one, MAPS)
