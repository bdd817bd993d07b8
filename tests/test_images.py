"""Whole images through containers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.api import ContainerError, TileEngine
from tilewright.operators import gradient, quant1d
from tilewright.plans import images
from tilewright.sources.rasters import lut_bank, mixed_image

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pixels(spark):
    image = mixed_image(spark, SF).where("y < 8")
    tall = image.select("x", *[F.col(n) for n in "rgb"], F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "y").select((F.col("k") * 8 + F.col("y")).cast("int").alias("y"), "x", *"rgb")
    both = [tall.select(F.lit(i).alias("image_id"), "y", "x", *[((F.col(n) + 40 * i) % 256).cast("int").alias(n) for n in "rgb"]) for i in range(2)]
    return both[0].unionByName(both[1]).cache()


def test_two_images_go_as_they_would_alone(spark, pixels):
    together = {tuple(r) for r in gradient.cascade(pixels, ["r", "g", "b"], 64, 32).collect()}
    alone = set()
    for i in range(2):
        mine = pixels.where(F.col("image_id") == i).drop("image_id")
        alone |= {(i, *r) for r in gradient.cascade(mine, ["r", "g", "b"], 64, 32).collect()}
    assert together == alone and together
    both = {tuple(r) for r in quant1d.encode(pixels, "r").collect()}
    assert both == {(i, *r) for i in range(2) for r in quant1d.encode(pixels.where(F.col("image_id") == i).drop("image_id"), "r").collect()}


def test_encode_write_read_decode(spark, pixels, tmp_path):
    with TileEngine(spark) as engine:
        engine.assign_bank(lut_bank(spark))
        engine.encode(pixels, 64, 32, str(tmp_path))
        assert sorted((r.width, r.height, r.alpha) for r in engine.headers(f"file://{tmp_path}").collect()) == [(64, 32, False)] * 2
        got = engine.decode(f"file://{tmp_path}").withColumn("image_id", F.substring("name", 7, 9).cast("int"))
        rows = got.collect()
    assert len(rows) == 2 * 64 * 32 == len({(r.image_id, r.y, r.x) for r in rows})
    tiles = gradient.cascade(pixels, ["r", "g", "b"], 64, 32)
    smooth = {(r.image_id, r.y, r.x) for r in images.covered(tiles).collect()}
    assert smooth
    free = pixels.join(images.covered(tiles), ["image_id", "y", "x"], "left_anti")
    want = {}
    for n in "rgb":
        for r in quant1d.decode(quant1d.encode(free, n)).collect():
            want.setdefault((r.image_id, r.y, r.x), {})[n] = r.v
    source = {(r.image_id, r.y, r.x): r for r in pixels.collect()}
    for r in rows:
        key = (r.image_id, r.y, r.x)
        if key in smooth:
            assert max(abs(r[n] - source[key][n]) for n in "rgb") <= 3 + 3 + 2  # blend, 6 bits, scaling
        else:
            assert {n: r[n] for n in "rgb"} == want[key]


def test_errors_stay_until_asked_for(spark, tmp_path):
    engine = TileEngine(spark)
    with pytest.raises(ContainerError):
        engine.encode(spark.createDataFrame([], "image_id int, y int, x int, r int, g int, b int"), 63, 8, str(tmp_path))
    with pytest.raises(ContainerError):
        engine.assign_bank(lut_bank(spark).withColumn("x", F.col("x") + 9))
    assert engine.last_error() == "INVALID_SIZE" and engine.last_error() is None
    assert np.isfinite(1.0)
