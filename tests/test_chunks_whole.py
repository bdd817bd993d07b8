"""The whole embedding plane in containers."""

from tests.conftest import SF_ORACLE
from tilewright.plans import codec
from tilewright.sources.rasters import embedding_plane


def test_every_row_is_in_a_chunk(spark):
    plane = {(r.y, r.x): r.v for r in embedding_plane(spark, SF_ORACLE).collect()}
    rows = max(y for y, _ in plane) + 1
    tags, want = ("MIPM", "ALPM", "GTIL", "3DTL", "1DTL"), {}
    for k in range(-(-rows // 16)):
        data = bytes(plane[y, x] for y in range(16 * k, min(rows, 16 * k + 16)) for x in range(64))
        want[f"image-{k // 5}", k % 5] = (min(80, rows - k // 5 * 80), tags[k % 5], len(data), data.hex().upper())
    assert rows > 240
    whole = codec.QUERIES["op_io6_io7_container_round_trip"](spark, SF_ORACLE).collect()
    assert {(r.name, r.seq): (r.height, r.tag, r.length, r.hex) for r in whole} == want and len(whole) == len(want)
    listed = codec.QUERIES["op_io7_chunk_listing"](spark, SF_ORACLE).collect()
    assert {(r.name, r.seq): (r.height, r.tag, r.length) for r in listed} == {k: v[:3] for k, v in want.items()} and len(listed) == len(want)
