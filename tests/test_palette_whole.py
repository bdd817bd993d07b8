"""Palettes over the whole mixed image against plain Python."""

from collections import defaultdict

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from tilewright.operators import palette
from tilewright.plans import codec
from tilewright.sources.rasters import mixed_image

ROWS = 72


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    table = pq.read_table("/root/testdata/sf0.01/events.parquet")
    pq.write_table(table.filter(pc.less(table["event_id"], ROWS * 64)), folder / "events.parquet")
    return str(folder)


def test_every_pixel_is_in_a_stream(spark, events):
    streams = defaultdict(dict)
    for r in mixed_image(spark, events).collect():
        streams[r.y // 8][r.y % 8 * 64 + r.x] = (r.r >> 2, r.g >> 2, r.b >> 2)
    run = lambda name: codec.QUERIES[f"{name}"](spark, events).collect()
    assert len(streams) == ROWS // 8 and all(len(s) == 512 for s in streams.values())
    deltas, books = {}, {}
    for k, s in streams.items():
        seen = defaultdict(list)
        for n in range(1, 512):
            prev = min(range(max(0, n - 64), n), key=lambda p: (sum((a - b) ** 2 for a, b in zip(s[n], s[p], strict=True)), p))
            d = tuple((a - b) & 255 for a, b in zip(s[n], s[prev], strict=True))
            deltas[k, n] = d
            seen[d].append(n)
        zero = len(seen.pop((0, 0, 0), []))
        ranked = sorted((1 - len(v), v[0], d) for d, v in seen.items())
        books[k] = {(0, 0, 0, 0, zero)} | {(i + 1, *d, -ref) for i, (ref, _, d) in enumerate(ranked[: palette.BOOK - 1])}
    assert {(r.stream, r.n): (r.dr, r.dg, r.db) for r in run("op_j7_nearest_deltas")} == deltas
    book = defaultdict(set)
    for r in run("op_a9_code_book"):
        book[r.stream].add((r.idx, r.dr, r.dg, r.db, r.ref))
    assert book == books
    data = {r.stream: bytes.fromhex(r.hex) for r in run("op_z3_palette_encode")}
    assert {k: dict(enumerate(palette.decode_bytes(v, 512))) for k, v in data.items()} == streams
    parts = {(r.stream, r.n): r.code for r in run("op_z3_palette_codes")}
    for k, v in data.items():
        assert "".join(parts[k, n] for n in range(1, 512)) == v[1 + 3 * v[0] + 3 :].hex().upper()
    assert {(r.stream, r.n): (r.r, r.g, r.b) for r in run("op_z4_palette_decode")} == {(k, n): v for k, s in streams.items() for n, v in s.items()}


def test_a_stream_of_several_runs(spark):
    """Streams longer than a run, of one colour more than a run, and of one colour, against plain Python; colours are not joined to those before them."""
    import random

    pick = random.Random(3)
    longest = 2 * palette.RUN + 70
    streams = {k: [tuple(pick.choice((0, 1, 5, 40, 255)) for _ in "rgb") for _ in range(n)] for k, n in (("long", longest), ("more", palette.RUN + 1), ("one", 1))}
    frame = spark.createDataFrame([(k, n, *v) for k, s in streams.items() for n, v in enumerate(s)], "stream string, n int, r int, g int, b int")
    deltas = palette.nearest_deltas(frame)
    assert "Join" not in deltas._jdf.queryExecution().executedPlan().toString()
    got = {(r.stream, r.n): (r.dr, r.dg, r.db) for r in deltas.collect()}
    assert len(got) == longest + palette.RUN - 1
    for k, s in streams.items():
        for n in [*range(1, 70), *range(palette.RUN - 3, min(len(s), palette.RUN + 70)), *range(max(1, len(s) - 75), len(s))]:
            if n < len(s):
                prev = min(range(max(0, n - 64), n), key=lambda p: (sum((a - b) ** 2 for a, b in zip(s[n], s[p], strict=True)), p))  # noqa: B023
                assert got[k, n] == tuple((a - b) & 255 for a, b in zip(s[n], s[prev], strict=True))
    data = {r.stream: bytes(r.data) for r in palette.encode(frame).collect()}
    assert {k: palette.decode_bytes(v, len(streams[k])) for k, v in data.items()} == streams
    book = palette.code_book(deltas)
    whole = {}
    for r in sorted(palette.codes(frame, book).collect(), key=lambda r: r.n):
        whole[r.stream] = whole.get(r.stream, "") + r.code
    assert {k: v[1 + 3 * v[0] + 3 :].hex().upper() for k, v in data.items() if k != "one"} == whole
