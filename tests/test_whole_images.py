"""Images with a mask, alpha and point tables through files: streams, chunks and pixels against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.api import TileEngine
from tilewright.operators import gradient, lut, quant1d, streams
from tilewright.plans import images
from tilewright.sources.container import read_containers
from tilewright.sources.rasters import lut_bank, mixed_image

SF = "/root/testdata/sf0.001"
RGB = ["r", "g", "b"]
WIDE, HIGH = 64, 32


@pytest.fixture(scope="module")
def pixels(spark):
    """Two images: noise that tables may take and smooth parts; alpha with a corner that is not seen, and alpha of two values."""
    base = mixed_image(spark, SF).where("y < 8")
    tall = base.select("x", *RGB, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "y").select((F.col("k") * 8 + F.col("y")).cast("int").alias("y"), "x", *RGB)
    line = (F.col("x") % 8) * 3 + (F.col("y") * 7 + F.col("x") * 5) % 11 * 9
    near = tall.select("y", "x", *[F.when(F.col("x") >= 40, 60 + line + 8 * k).otherwise(F.col(n)).cast("int").alias(n) for k, n in enumerate(RGB)])
    seen = (F.col("y") >= 16) | (F.col("x") < 48)
    first = near.select(F.lit(0).alias("image_id"), "y", "x", *RGB, F.when(seen, 20 + F.col("x") * 3).otherwise(0).cast("int").alias("a"))
    second = near.select(F.lit(1).alias("image_id"), "y", "x", *[n for n in RGB], F.when(F.col("x").between(9, 50), 255).otherwise(0).alias("a"))
    return first.unionByName(second).cache()


def rows_of(frame):
    return {(int(r.name[6:]), r.y, r.x): r for r in frame.collect()}


def test_mask_alpha_and_tables_round_trip(spark, pixels, tmp_path):
    bank = lut_bank(spark)
    with TileEngine(spark) as engine:
        engine.assign_bank(bank)
        engine.save_bank(f"file://{tmp_path}/tables.lut")
        engine.encode(pixels, WIDE, HIGH, str(tmp_path / "out"), tables=True)
    tags = {(r.name, r.seq): r.tag for r in read_containers(spark, str(tmp_path / "out")).select(F.regexp_extract("path", r"(image-\d)\.tile", 1).alias("name"), "seq", "tag").collect()}
    assert [tags["image-0", k] for k in (0, 1, 2)] == ["MIPM", "ALPM", "GTIL"] and {"3DTL", "1DTL"} <= set(tags.values())
    assert list(dict.fromkeys(t for _, t in sorted(tags.items()))) == ["MIPM", "ALPM", "GTIL", "3DTL", "1DTL"]

    with TileEngine(spark) as other:
        with pytest.raises(Exception, match="INVALID_LUT"):
            other.decode(str(tmp_path / "out"))
        other.assign_file(f"file://{tmp_path}/tables.lut")
        got = rows_of(other.decode(str(tmp_path / "out")))
    assert len(got) == 2 * WIDE * HIGH

    source = {(r.image_id, r.y, r.x): r for r in pixels.collect()}
    hidden = {k for k, r in source.items() if k[0] == 0 and k[1] < 16 and k[2] >= 48}
    for (i, y, x), r in source.items():
        if i == 0:
            want = 0 if (i, y, x) in hidden else (r.a >> 2) << 2 | r.a >> 6
        else:
            want = r.a
        assert got[i, y, x].a == want, (i, y, x)
    masked = spark.createDataFrame(sorted(hidden), "image_id int, y int, x int")
    tiles = gradient.cascade(pixels, RGB, WIDE, HIGH, taken=masked)
    smooth = {(r.image_id, r.y, r.x) for r in images.covered(tiles).collect()}
    used = spark.createDataFrame(sorted(smooth | hidden), "image_id int, y int, x int").withColumn("held", F.lit(True))
    free = pixels.join(used, ["image_id", "y", "x"], "left").select("image_id", "y", "x", *RGB, F.col("held").isNull().alias("free")).cache()
    held = lut.cascade_entries(free, RGB, bank, F.col("free")).collect()
    points = {}
    for r in bank.collect():
        points.setdefault(r.lut_id, {})[r.idx] = (r.x, r.y, r.z)
    table = {}
    back = lambda v: ((v * 250 + 127) // 255 * ((255 << 16) // 250)) >> 16
    for r in held:
        f = [v * 128 // 63 for v in points[r.lut_id][r.idx << (6 - r.depth)]]
        order = ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx")[r["mode"] >> 3]
        moved = [dict(zip("xyz", f, strict=True))[a] for a in order]
        color = []
        for k, n in enumerate(RGB):
            low, high = back(r[f"{n}0"]), back(r[f"{n}1"])
            color.append(low + (((128 - moved[k] if r["mode"] >> k & 1 else moved[k]) * (high - low)) >> 7))
        table[r.image_id, r.y, r.x] = color
    assert smooth and table and not smooth & table.keys()
    left = free.where("free").join(spark.createDataFrame(sorted(table), "image_id int, y int, x int"), ["image_id", "y", "x"], "left_anti")
    range_ = {}
    for n in RGB:
        for r in quant1d.decode(quant1d.encode(left, n)).collect():
            range_.setdefault((r.image_id, r.y, r.x), {})[n] = r.v
    for k, r in got.items():
        color = [r[n] for n in RGB]
        if k in hidden:
            assert color == [0, 0, 0]
        elif k in smooth:
            assert max(abs(r[n] - source[k][n]) for n in RGB) <= 3 + 3 + 2
        elif k in table:
            assert color == table[k]
        else:
            assert color == [range_[k][n] for n in RGB]


def test_offsets_of_many_places(spark, monkeypatch):
    """Against running sums, with runs of three places and gaps between them."""
    monkeypatch.setattr(streams, "SPAN", 3)
    rng = random.Random(1)
    rows = [(k, p, rng.randrange(9)) for k in "ab" for p in rng.sample(range(1 << 41), 40)] + [("c", 5, 2)]
    got = {(r.k, r.p): r.before for r in streams.offsets(spark.createDataFrame(rows, "k string, p long, n int"), ["k"], "p", "n").collect()}
    want = {}
    for k in "abc":
        total = 0
        for _, p, n in sorted(r for r in rows if r[0] == k):
            want[k, p] = total
            total += n
    assert got == want


def test_blocks_and_bytes(spark, monkeypatch):
    values = [("s", i, i * 7 % 256) for i in range(1000)] + [("t", 0, 9)]
    frame = spark.createDataFrame(values, "s string, at long, v int")
    parts = streams.blocks(frame, ["s"], 64)
    assert {(r.s, r.block): bytes(r.data) for r in parts.collect()} == {**{("s", b): bytes(v for _, i, v in values[:1000] if i // 64 == b) for b in range(16)}, ("t", 0): b"\x09"}
    whole = spark.createDataFrame([("s", bytes(v for _, _, v in values[:1000])), ("e", b"")], "s string, data binary")
    assert sorted(tuple(r) for r in streams.bytes_of(whole, ["s"], "data").collect()) == [v for v in values if v[0] == "s"]
    assert images._unzip(images._zip(b"a" * 99) + images._zip(b"") + images._zip(b"bc")) == b"a" * 99 + b"bc"


def test_alpha_that_needs_no_chunk(spark):
    """All seen, nothing seen, and no pixel beyond 3 of 255; an image whose box has one value only."""
    rows = [(i, y, x, a) for i, a in enumerate((255, 0, 3, 200)) for y in range(16) for x in range(32)]
    pixels = spark.createDataFrame(rows, "image_id int, y int, x int, a int")
    mask = streams.used_tiles(pixels)
    plan = {r.image_id: r.kind for r in streams.alpha_plan(pixels, mask, 32, 16).collect()}
    assert plan == {3: streams.SIX_ALL}
    plan = {r.image_id: r.kind for r in streams.alpha_plan(pixels, mask, 32, 16, F.lit(True)).collect()}
    assert plan == {3: streams.EIGHT}
    chunks = images.encode_alpha(pixels, 32, 16)
    assert sorted((r.name, r.tag) for r in chunks.collect()) == [("image-1", "MIPM"), ("image-2", "MIPM"), ("image-3", "ALPM")]


def test_broken_chunks_are_refused():
    import struct

    import pandas as pd

    head = struct.pack(images._TABLE_HEAD, 6, 1, 0, 0, 0, 0, *[0] * 18, 7, 250)
    with pytest.raises(ValueError, match="INVALID_TABLE_CHUNK"):
        images._table_parts(pd.Series([head]))
    with pytest.raises(ValueError, match="INVALID_MIPMAP_LEVEL"):
        images._mask_parts(pd.Series([struct.pack(images._MIP_HEAD, 0, 0, 9, 9, 1, 1, 4) + b"\0"]))
    with pytest.raises(ValueError, match="INVALID_ALPHA_FORMAT"):
        images._alpha_parts(pd.Series([struct.pack(images._ALPHA_HEAD, 0, 0, 8, 8, 0, 0, 1, 0)]))


def test_images_without_tiles_or_tables(spark, tmp_path):
    """Noise that no gradient and no table takes, and a constant image, in one folder."""
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 256, (8, 16, 3))
    rows = [(0, y, x, *map(int, noise[y, x])) for y in range(8) for x in range(16)] + [(1, y, x, 9, 9, 9) for y in range(8) for x in range(16)]
    frame = spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int")
    engine = TileEngine(spark)
    engine.assign_bank(lut_bank(spark))
    engine.encode(frame, 16, 8, str(tmp_path / "out"), tables=True)
    got = rows_of(engine.decode(str(tmp_path / "out")))
    assert len(got) == 256 and all(r.a is None for r in got.values())
    assert all(max(abs(got[1, y, x][n] - 9) for n in RGB) <= 3 for y in range(8) for x in range(16))
