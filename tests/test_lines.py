"""Poly-lines and the filling that reads what it has written, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import polylines, resample

LINES = {
    "bend": [(0, 0, 0), (63, 0, 0), (63, 63, 63), (10, 60, 5)],
    "doubled": [(5, 5, 5), (5, 5, 5), (9, 40, 2), (9, 40, 2)],
    "turn": [(3, 3, 3), (60, 8, 20), (12, 50, 3)],
    "place": [(7, 7, 7), (7, 7, 7)],
    "lone": [(1, 2, 3)],
}


@pytest.fixture(scope="module")
def lines(spark):
    return polylines.segments(spark.createDataFrame([(n, k, *p) for n, points in LINES.items() for k, p in enumerate(points)], "line string, k int, x int, y int, z int"))


def parts(points):
    out = []
    for a, b in zip(points, points[1:], strict=False):
        if a != b:
            out.append((a, b, round(math.dist(a, b) * 1e6)))
    return out


def test_resampling(lines):
    got = {(r.line, r.depth, r.idx): (r.fx, r.fy, r.fz) for r in polylines.resample(lines).collect()}
    want = {}
    for name, points in LINES.items():
        segments = parts(points)
        total = sum(s for _, _, s in segments)
        for depth, n in polylines.COUNTS.items():
            for i in range(n) if segments else ():
                before = 0
                for a, b, size in segments:
                    if i * total <= (n - 1) * (before + size):
                        break
                    before += size
                local = (i * total - (n - 1) * before) / ((n - 1) * size) + 0.00001
                want[name, depth, i] = tuple(int((p + (q - p) * local) / 64 * 128) for p, q in zip(a, b, strict=True))
    assert got == want
    assert got["bend", 3, 0] == (0, 0, 0) and got["doubled", 6, 63] == (18, 80, 3)


@pytest.mark.parametrize("dims", [2, 3])
def test_distance_field_of_all_cells(lines, dims):
    """Every cell against every segment."""
    got = {}
    for r in polylines.field(lines, dims).collect():
        got.setdefault(r.line, {})[tuple(r[a] for a in "xyz"[:dims])] = (r.dist, r.i6, r.i5, r.i4, r.i3)
    assert got.keys() == {n for n, p in LINES.items() if parts(p)}
    grid = np.stack(np.meshgrid(*[np.arange(64.0)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    for name, cells in got.items():
        segments = parts(LINES[name])
        total, before = sum(s for _, _, s in segments), 0
        best, at = np.full(len(grid), np.inf), np.zeros(len(grid))
        for a, b, size in segments:
            a, d = np.array(a[:dims], float), np.array(b[:dims], float) - np.array(a[:dims], float)
            if d.any():
                foot = (grid - a) @ d / (d @ d)
                dist = np.sqrt(((grid - a - np.clip(foot, 0, 1)[:, None] * d) ** 2).sum(axis=1))
                closer = dist < best - 1e-12
                at = np.where(closer, (before + foot * size) / total, at)
                best = np.where(closer, dist, best)
            before += size
        assert len(cells) == len(grid)
        value = ((best + 1) ** 2 - 1) * 1024
        for k, (cell, v) in enumerate(zip(map(tuple, grid.astype(int)), value, strict=True)):
            found = cells[cell]
            assert abs(found[0] - v) < 1.001
            for i, n in zip(found[1:], (64, 32, 16, 8), strict=True):
                assert abs(i - at[k] * (n - 1)) <= 0.5 + 1e-6 or i == 0 and at[k] < 0 or i == n - 1 and at[k] > 1


def brute_fill_back(plane, keep):
    out = plane.copy()
    high, wide = plane.shape
    read = lambda y, x: int(out[min(high - 1, max(0, y)), min(wide - 1, max(0, x))])
    cut = lambda v, n: int(v / n)
    for y in range(0, high, 2):
        for x in range(0, wide, 2):
            if not keep[y, x]:
                a, b, c, d = read(y - 2, x - 2), read(y - 2, x), read(y, x - 2), read(y, x)
                out[y, x], out[y, x + 1] = cut(a + b + c + d, 4), cut(b + d, 2)
                out[y + 1, x], out[y + 1, x + 1] = cut(a + b, 2), d
    return out


@pytest.mark.parametrize("block", [2, 5, 256])
def test_filling_from_what_was_written(spark, block):
    """Two images, values below 0, blocks smaller than the plane."""
    rng = np.random.default_rng(block)
    planes = {i: rng.integers(-200, 200, (14, 22)) for i in (1, 2)}
    rows = [(i, y, x, int(p[y, x])) for i, p in planes.items() for y in range(14) for x in range(22)]
    frame = spark.createDataFrame(rows, "image_id int, y int, x int, v int")
    got = {(r.image_id, r.y, r.x): r.v for r in resample.fill_back(frame, "v", F.col("v") % 5 == 0, 22, 14, block).collect()}
    for i, p in planes.items():
        want = brute_fill_back(p, np.fmod(p, 5) == 0)
        assert all(got[i, y, x] == want[y, x] for y in range(14) for x in range(22))


def test_no_points_and_no_pixels(spark):
    none = spark.createDataFrame([], "line int, k int, x int, y int, z int")
    assert polylines.resample(polylines.segments(none)).collect() == [] and polylines.field(polylines.segments(none)).collect() == []
    assert resample.fill_back(spark.createDataFrame([], "y int, x int, v int"), "v", F.lit(False), 2, 2).collect() == []


@pytest.mark.parametrize("dims", [2, 3])
def test_blocks_are_summed_where_cells_are_measured(lines, dims):
    """The sums by block are those of all cells, of the distance's own and of a caller's segments; no cell is sorted or sent to another task."""
    axes = "xyz"[:dims]
    start = lambda place, seg: (np.maximum.reduce([np.abs(v - seg[f"{a}0"]) + 0 * sum(place.values()) for a, v in place.items()]), 0.0)
    for apart in (None, start):
        want = {}
        for r in polylines.field(lines, dims, apart).collect():
            sums = want.setdefault((r.line, *[r[a] // polylines.BLOCK for a in axes]), [0] * 5)
            for k, v in enumerate((r.dist, r.i6, r.i5, r.i4, r.i3)):
                sums[k] += v
        blocks = polylines.field_blocks(lines, dims, apart)
        assert {(r.line, *[r[f"b{a}"] for a in axes]): [r.dist, r.i6, r.i5, r.i4, r.i3] for r in blocks.collect()} == want
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "cell" not in plan


@pytest.mark.parametrize("axes", ["xy", "x", "y"])
def test_filling_between_orders_no_whole_line(spark, axes):
    """Images of even and odd size against reads of the plane's edge; the plan has no window, whose lines were as long as the table."""
    dx, dy = "x" in axes, "y" in axes
    sx, sy = 1 + dx, 1 + dy
    rng = np.random.default_rng(7)
    for high, wide in ((14, 22), (13, 9)):
        planes = {i: rng.integers(-200, 200, (high, wide)) for i in (1, 2)}
        frame = spark.createDataFrame([(i, y, x, int(p[y, x])) for i, p in planes.items() for y in range(high) for x in range(wide)], "image_id int, y int, x int, v int")
        filled = resample.fill_between(frame, "v", F.col("v") % 5 == 0, dx, dy)
        assert "Window" not in filled._jdf.queryExecution().executedPlan().toString()
        assert filled.dtypes == [("image_id", "int"), ("y", "int"), ("x", "int"), ("v", "int")]
        got = {(r.image_id, r.y, r.x): r.v for r in filled.collect()}
        for i, p in planes.items():
            read = lambda y, x: int(p[min(high - 1, y), min(wide - 1, x)])  # noqa: E731, B023
            for y in range(high):
                for x in range(wide):
                    ey, ex, v = y - y % sy, x - x % sx, read(y, x)
                    own = read(ey, ex)
                    if own % 5 and (y, x) != (ey, ex):
                        v = int((own + read(ey, ex + sx)) / 2) if y == ey else int((own + read(ey + sy, ex)) / 2) if x == ex else int((own + read(ey, ex + sx) + read(ey + sy, ex) + read(ey + sy, ex + sx)) / 4)
                    assert got[i, y, x] == v
            assert sum(k[0] == i for k in got) == high * wide


@pytest.mark.parametrize("kept", [3, 1000])
def test_filling_takes_few_rounds_where_places_are_kept(spark, monkeypatch, kept):
    """A tall plane of 40 blocks: what is kept ends the reach of the lines above, so few rounds do; where nothing is, the result is the same loop's."""
    from tilewright.operators import gradient

    rounds, checkpointed = [], gradient.checkpointed
    monkeypatch.setattr(gradient, "checkpointed", lambda frame: rounds.append(1) or checkpointed(frame))
    plane = np.random.default_rng(kept).integers(0, 256, (160 if kept == 3 else 40, 6))
    frame = spark.createDataFrame([(y, x, int(v)) for (y, x), v in np.ndenumerate(plane)], "y int, x int, v int")
    got = {(r.y, r.x): r.v for r in resample.fill_back(frame, "v", F.col("v") % kept == 0, 6, len(plane), 4 if kept == 3 else 2).collect()}
    want = brute_fill_back(plane, plane % kept == 0)
    assert all(got[k] == v for k, v in np.ndenumerate(want)) and len(got) == plane.size
    assert kept != 3 or len(rounds) < 15
