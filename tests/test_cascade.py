"""The table cascade and the round trip of images: whole images, against plain Python."""

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tilewright.operators import gradient, lut, quant1d
from tilewright.plans import codec, images, tiles
from tilewright.sources.rasters import lut_bank, mixed_image

RGB = ["r", "g", "b"]
ROWS = 24


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """A folder with an events table of ROWS rows of pixels, that of sf0.01 cut short."""
    folder = tmp_path_factory.mktemp("events")
    table = pq.read_table("/root/testdata/sf0.01/events.parquet")
    pq.write_table(table.filter(pc.less(table["event_id"], ROWS * 64)), folder / "events.parquet")
    return str(folder)


def swapped(number, v):
    x, y, z = v
    return ((x, y, z), (x, z, y), (y, x, z), (y, z, x), (z, x, y), (z, y, x))[number]


def brute_cascade(image, bank):
    """image: (rows, 64, 3); bank: {lut_id: (64, 3)}."""
    free, out, one = np.ones(image.shape[:2], bool), set(), np.float32(63)
    for k, (tw, th) in enumerate(lut.SIZES):
        found = []
        for ty in range(image.shape[0] // th):
            for tx in range(64 // tw):
                spot = np.s_[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw]
                v = image[spot][free[spot]].astype(np.int64)
                if not len(v):
                    continue
                low, span = v.min(0), v.max(0) - v.min(0)
                if (span > 0).sum() < 2:
                    continue
                step = np.where(span > 0, (1 << 20) // np.maximum(span, 1), 0)
                i = ((((v - low) * step).astype(np.float32) / float(1 << 20)).astype(np.float32) * one).astype(int)
                rel = ((v - low).astype(np.float32).astype(np.float64) / np.maximum(span, 1)).astype(np.float32) * one
                best = None
                for lut_id, points in bank.items():
                    chosen = None
                    for mode in range(48):
                        number = ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx").index(lut.SCORED_ORDER[mode])
                        c = np.stack(swapped(number, i.T), 1)
                        c = np.where([mode >> a & 1 for a in range(3)], 63 - c, c)
                        score = ((c[:, None] - points[None, ::8]) ** 2).sum(2).min(1).sum()
                        chosen = min(chosen or (score, mode), (score, mode))
                    mode = chosen[1]
                    bits = np.array([mode >> a & 1 for a in range(3)], bool)
                    c = np.stack(swapped(mode >> 3, np.where(bits, one - rel, rel).astype(int).T), 1)
                    for depth in (3, 4, 5, 6):
                        kept = points[:: 1 << (6 - depth)]
                        near = ((c[:, None] - kept[None]) ** 2).sum(2).argmin(1)
                        f = kept[near] * 128 // 63
                        back = np.stack(swapped(mode >> 3, np.where(bits, 128 - f, f).T), 1)
                        e = np.abs(low + back * span // 128 - v).max(1)
                        if (e > lut.FAR).sum() <= lut.WRONG:
                            best = min(best or (e.sum(), -lut_id, mode, depth), (e.sum(), -lut_id, mode, depth))
                            break
                if best:
                    out.add((k, tw, th, ty, tx, -best[1], best[2], best[3], int(best[0])))
                    found.append(spot)
        for spot in found:
            free[spot] = False
    return out


def test_cascade_of_the_whole_image(spark, events):
    image = np.zeros((ROWS, 64, 3), np.int64)
    for r in mixed_image(spark, events).collect():
        image[r.y, r.x] = r.r, r.g, r.b
    bank = {k: np.zeros((64, 3), np.int64) for k in range(4)}
    for r in lut_bank(spark).collect():
        bank[r.lut_id][r.idx] = r.x, r.y, r.z
    got = tiles.QUERIES["op_e7_table_cascade"](spark, events)
    names = ("pass", "tw", "th", "ty", "tx", "lut_id", "mode", "depth", "err")
    rows = [tuple(r[n] for n in names) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_cascade(image, bank)
    assert max((r[3] + 1) * r[2] for r in rows) == ROWS  # beyond the first 16 rows, to the last


def test_round_trip_of_the_whole_image(spark, events):
    """One file of the whole image; two where it is taller than a file, the last one shorter."""
    source = mixed_image(spark, events).cache()
    for tallest in (codec.TALLEST, 16):
        got = (codec.QUERIES["op_io6_image_round_trip"](spark, events) if tallest == codec.TALLEST else codec.image_round_trip(spark, source, tallest)).collect()
        tall = min(tallest, ROWS)
        assert sorted((r.name, r.y, r.x) for r in got) == sorted((f"image-{y // tall}", y % tall, x) for y in range(ROWS) for x in range(64))
        values = {(int(r.name[6:]) * tall + r.y, r.x): r for r in got}
        for at in range(0, ROWS, tall):
            rows = min(tall, ROWS - at)
            part = source.where(F.col("y").between(at, at + rows - 1)).withColumn("y", F.col("y") - at).withColumn("image_id", F.lit(0))
            taken = images.covered(gradient.cascade(part, RGB, 64, rows)).cache()
            smooth = {(r.y, r.x) for r in taken.collect()}
            free = part.join(taken, ["image_id", "y", "x"], "left_anti")
            want = {n: {(r.y, r.x): r.v for r in quant1d.decode(quant1d.encode(free, n)).collect()} for n in RGB}
            for r in part.collect():
                v = values[r.y + at, r.x]
                if (r.y, r.x) in smooth:
                    assert max(abs(v[n] - r[n]) for n in RGB) <= 3 + 3 + 2
                else:
                    assert [v[n] for n in RGB] == [want[n][r.y, r.x] for n in RGB]
