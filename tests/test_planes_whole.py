"""Filling, masked alpha, clamped reads and aligned boxes over the whole embedding plane against plain Python."""

import pytest

from tests.conftest import SF_ORACLE
from tilewright.plans import codec, pixels
from tilewright.sources.rasters import embedding_plane


@pytest.fixture(scope="module")
def plane(spark):
    return {(r.y, r.x): r.v for r in embedding_plane(spark, SF_ORACLE).collect()}


def got(spark, name):
    rows = (codec.QUERIES | pixels.QUERIES)[name](spark, SF_ORACLE).collect()
    out = {(r.y, r.x): r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("axes", ["xy", "x", "y"])
def test_fill_between(spark, plane, axes):
    dx, dy = "x" in axes, "y" in axes
    last, want = max(y for y, _ in plane), dict(plane)
    assert last > 63
    at = lambda y, x: plane[min(last, y), min(63, x)]
    for (y, x), v in plane.items():
        if x % (1 + dx) == 0 and y % (1 + dy) == 0 and v < 140:
            r, b, rb = at(y, x + 1 + dx), at(y + 1 + dy, x), at(y + 1 + dy, x + 1 + dx)
            if dx:
                want[y, x + 1] = (v + r) // 2
            if dy:
                want[y + 1, x] = (v + b) // 2
            if dx and dy:
                want[y + 1, x + 1] = (v + r + b + rb) // 4
    assert {k: r.v for k, r in got(spark, f"op_r3_fill_between_{axes}").items()} == want


def test_masked_alpha(spark, plane):
    want = {k: (v >> 2) << 2 | v >> 6 if v >= 100 else 0 for k, v in plane.items()}
    assert {k: r.v for k, r in got(spark, "op_d4_masked_alpha").items()} == want


def test_clamped_read(spark, plane):
    last = max(y for y, _ in plane)
    rows = got(spark, "op_p8_clamped_read")
    assert min(rows) == (-5, -8) and max(rows)[0] > last and {x for _, x in rows} == set(range(-8, 72))
    for (y, x), r in rows.items():
        assert (r.v, r.outside) == (plane[min(last, max(0, y)), min(63, max(0, x))], (y, x) not in plane)


def test_aligned_boxes(spark, plane):
    want = {(y, x): v if plane[y + 4, x + 8] >= 120 else 0 for (y, x), v in plane.items() if (y + 4, x + 8) in plane}
    assert {k: r.v for k, r in got(spark, "op_j9_aligned_boxes").items()} == want
