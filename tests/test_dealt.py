"""What is unpacked from files is joined by shuffles, and alpha is read by runs that lie in one piece of a stream."""

import random
import re
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from tilewright.plans import images
from tilewright.sources.container import ALPHA, MIP, pack_file, read_containers


def broadcast_explodes(frame) -> list[str]:
    """Lines of the plan that explode rows below a broadcast: what the driver would gather whole."""
    held, inside = [], None
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[\s:|+-]*", line).group())
        if inside is not None and depth <= inside:
            inside = None
        if inside is None and "BroadcastExchange" in line:
            inside = depth
        elif inside is not None and "Generate" in line:
            held.append(line)
    return held


def test_unpacked_streams_are_not_broadcast(spark, tmp_path):
    """Nor is a bitmap or a mask; the pixels of a file of one colour, seen in the left half."""
    zipped = zstandard.ZstdCompressor().compress
    symbols, params, alpha = zipped(bytes(256)), zipped(bytes([50, 0, 0]) * 4), zipped(bytes(range(128)))
    planes = [(k + 2, "1DTL", struct.pack("<BxxxIII", k, 256, len(symbols), len(params)) + symbols + params) for k in range(3)]
    kept = [(0, MIP, struct.pack("<4iIBBxx", 0, 0, 2, 1, 1, 1, 4) + b"\3"), (1, ALPHA, struct.pack("<4iIIBBxx", 0, 0, 16, 8, len(alpha), 128, 1, 6) + alpha)]
    (tmp_path / "image-0.tile").write_bytes(pack_file(32, 8, True, [c[1:] for c in kept + planes]))
    chunks = read_containers(spark, str(tmp_path)).withColumn("name", F.lit("image-0"))
    frame, seen = images.decode(chunks, 32, 8), images.decode_alpha(chunks, 32, 8)
    assert broadcast_explodes(frame) == [] and broadcast_explodes(seen) == []
    alpha_at = {(y, x): y * 16 + x if x < 16 else 0 for y in range(8) for x in range(32)}
    assert {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in frame.collect()} == {at: (50, 50, 50, a) for at, a in alpha_at.items()}
    assert {(r.y, r.x): r.a for r in seen.collect()} == alpha_at


@pytest.mark.parametrize("kind,bits", [(1, 1), (2, 6), (3, 6), (4, 6), (5, 6), (6, 8)])
def test_alpha_of_many_pieces(spark, kind, bits):
    """A box that begins and ends inside tiles, a stream of many pieces, and one that ends early."""
    wide, high, (x0, y0, w, h) = 200, 40, (12, 3, 181, 35)
    used = {(my, mx) for my in range(3) for mx in range(13) if (my + mx) % 3}
    places = [my * 13 + mx for my, mx in used]
    mask = bytearray(5)
    for p in places:
        mask[p >> 3] |= 1 << (p & 7)
    spots = [(y, x) for y in range(y0, y0 + h) for x in range(x0, x0 + w) if kind not in (2, 3) or (y >> 4, x >> 4) in used]
    size = (len(spots) * bits + 7) // 8
    rows, want = [], {}
    for name, n in (("image-0", size), ("image-1", size // 3)):
        data = random.Random(kind).randbytes(n)
        whole = int.from_bytes(data, "little")
        packed = zstandard.ZstdCompressor().compress(data)
        rows.append((name, True, 0, MIP, struct.pack("<4iIBBxx", 0, 0, 13, 3, 5, 1, 4) + bytes(mask)))
        rows.append((name, True, 1, ALPHA, struct.pack("<4iIIBBxx", x0, y0, w, h, len(packed), n, 1, kind) + packed))
        for k, at in enumerate(spots):
            v = whole >> k * bits & (1 << bits) - 1
            six = v if kind in (2, 4) else 63 - v
            want[name, *at] = v * 255 if kind == 1 else v if kind == 6 else six << 2 | six >> 4
    chunks = spark.createDataFrame(rows, "name string, alpha boolean, seq int, tag string, payload binary")
    got = {(r.name, r.y, r.x): r.a for r in images.decode_alpha(chunks, wide, high).collect()}
    assert got == {(n, y, x): want.get((n, y, x), 0) for n in ("image-0", "image-1") for y in range(high) for x in range(wide)}
