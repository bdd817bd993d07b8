"""Files of point tables and the passes over tiles that use tables."""

import numpy as np
import pytest

from tilewright.api import TileEngine
from tilewright.operators import lut, masks
from tilewright.sources import tables
from tilewright.sources.container import ContainerError
from tilewright.sources.rasters import lut_bank


def test_a_file_gives_the_factors_back(spark, tmp_path):
    bank, path = lut_bank(spark), str(tmp_path / "bank.lut")
    with TileEngine(spark) as engine:
        engine.assign_bank(bank)
        engine.save_bank(path)
        data = open(path, "rb").read()
        assert data[:6] == b"LUL0\x00\x03" and len(data) == 8 + 4 * 360
        assert sorted(tables.read_tables(spark, path).collect()) == sorted(lut.factors(bank).select("lut_id", "depth", "idx", "fx", "fy", "fz").collect())
        got = {(r.lut_id, r.depth, r["mode"], r.idx): (r.x, r.y, r.z) for r in engine.assign_file(path).collect()}
    x, y, z = (bank.where("lut_id = 3 and idx = 40").first()[a] * 128 // 63 for a in "xyz")
    assert len(got) == 4 * 64 * 120
    assert got[3, 6, 0, 40] == (x, y, z) and got[3, 6, 8 * 3 + 5, 40] == (128 - y, z, 128 - x) and got[3, 6, 48, 40] == (251, 251, 251)


def test_a_file_that_is_assigned_stays(spark, tmp_path):
    """Its tables are kept: saved again they are the same file, and its points are those it was made of."""
    bank = lut_bank(spark)
    tables.write_tables(bank, str(tmp_path / "a.lut"))
    engine = TileEngine(spark)
    engine.assign_file(str(tmp_path / "a.lut"))
    engine.save_bank(str(tmp_path / "b.lut"))
    assert (tmp_path / "a.lut").read_bytes() == (tmp_path / "b.lut").read_bytes()
    assert sorted(engine.bank.select("lut_id", "idx", "x", "y", "z").collect()) == sorted(bank.select("lut_id", "idx", "x", "y", "z").collect())


def test_two_channel_files(spark, tmp_path):
    bank, path = lut_bank(spark), str(tmp_path / "two.lut")
    tables.write_tables(bank, path, 2)
    data = open(path, "rb").read()
    assert data[:6] == b"LU20\x00\x03" and len(data) == 8 + 4 * 240
    want = {(r.lut_id, r.depth, r.idx): (r.fx, r.fy, 0) for r in lut.factors(bank).collect()}
    assert {(r.lut_id, r.depth, r.idx): (r.fx, r.fy, r.fz) for r in tables.read_tables(spark, path, 2).collect()} == want
    with pytest.raises(ContainerError):
        tables.read_tables(spark, path)


@pytest.mark.parametrize("data", [b"", b"LUL0", b"XUL0" + bytes(4 + 360), b"LU20" + bytes(4 + 240), b"LUL0" + bytes(4 + 359), b"LUL0" + bytes([0, 1, 0, 0]) + bytes(360)])
def test_other_files_are_refused(spark, tmp_path, data):
    path = tmp_path / "bad.lut"
    path.write_bytes(data)
    engine = TileEngine(spark)
    with pytest.raises(ContainerError):
        engine.assign_file(str(path))
    assert engine.last_error() == "INVALID_LUT" and engine.last_error() is None


def test_a_bank_is_bounded(spark):
    many = spark.range(65 * 64).selectExpr("int(id div 64) lut_id", "int(id % 64) idx", "int(id % 64) x", "int(id % 64) y", "int(id % 64) z")
    with pytest.raises(ValueError):
        lut.tables_of(many)
    with pytest.raises(ContainerError):
        tables.write_tables(many.where("idx < 63"), "/tmp/never.lut")


def test_field_is_the_distance_to_the_nearest_of_every_eighth_point():
    rng = np.random.default_rng(5)
    points = np.c_[np.arange(64), rng.integers(0, 64, (64, 3))]
    at = rng.integers(0, 64, (200, 3))
    want = ((at[:, None] - points[None, ::8, 1:]) ** 2).sum(2).min(1)
    assert (lut._field(points)[(at[:, 0] * 64 + at[:, 1]) * 64 + at[:, 2]] == want).all()


def test_no_tiles_give_no_scores(spark):
    none = spark.createDataFrame([], "ty int, tx int, y int, x int, r int, g int, b int, r0 int, r1 int, g0 int, g1 int, b0 int, b1 int, ix int, iy int, iz int")
    assert lut.scores(none, lut_bank(spark)).count() == 0 and lut.search(none, ["r", "g", "b"], lut_bank(spark)).count() == 0


def test_images_without_a_mask_are_free_everywhere(spark):
    pixels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 0, 1)], "image_id int, y int, x int")
    own = spark.createDataFrame([(2, 0, 0, 0), (2, 0, 1, 255)], "image_id int, y int, x int, m int")
    assert sorted(map(tuple, masks.mask_or_all(pixels, own).collect())) == [(1, 0, 0, 255), (1, 0, 1, 255), (2, 0, 0, 0), (2, 0, 1, 255)]
    assert {r.m for r in masks.mask_or_all(pixels).collect()} == {255}


def test_runs_of_all_modes_are_those_of_the_expanded_tables(spark):
    """The runs picked for each mode against every entry under every mode; the modes are made after the only shuffle."""
    from tilewright.operators import lut
    from tilewright.sources import rasters, tables

    factors = lut.factors(rasters.lut_bank(spark))
    want = {}
    for r in sorted(tables.expanded(factors).collect(), key=lambda r: r.idx):
        for a in "xyz":
            want[r.lut_id, r.depth, r.mode, a] = want.get((r.lut_id, r.depth, r.mode, a), "") + f"{r[a]:02X}"
    runs = tables.expanded_runs(factors)
    assert {(r.lut_id, r.depth, r.mode, a): r[a] for r in runs.collect() for a in "xyz"} == want
    assert "mode" not in "".join(line for line in runs._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
