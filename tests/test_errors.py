"""Every code that a session may have, each brought about, and broken files among good ones."""

import struct
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tilewright.api import ContainerError, TileEngine
from tilewright.plans import images, verify
from tilewright.sources import shared
from tilewright.sources.container import END, pack_file
from tilewright.sources.rasters import lut_bank


def zipped(data):
    return images._zip(data)


def gradient_chunk(bits=b"\0"):
    m, p = zipped(bits), b""
    return struct.pack(images._HEAD, 4 | 4 << 3, 7, 250, len(m), len(p), 0) + m + p


def range_chunk(plane=0, n=128, symbols=None, params=bytes([9, 9, 0]) * 2):
    s, p = zipped(bytes(n) if symbols is None else symbols), zipped(params)
    return struct.pack(images._RANGE_HEAD, plane, n, len(s), len(p)) + s + p


def table_chunk(component=7, types=0):
    return struct.pack(images._TABLE_HEAD, 6 * types, types, *[0] * 22, component, 250)


def alpha_chunk(kind, data=bytes(128), n=None):
    z = zipped(data)
    return struct.pack(images._ALPHA_HEAD, 0, 0, 16, 8, len(z), len(data) if n is None else n, 1, kind) + z


def mip_chunk(level=4):
    return struct.pack(images._MIP_HEAD, 0, 0, 1, 1, 1, 1, level) + b"\1"


RANGES = [("1DTL", range_chunk(k)) for k in range(3)]


def files():
    good = pack_file(16, 8, False, RANGES)
    broken = bytearray(range_chunk())
    broken[-8:] = b"\xff" * 8
    made = {
        "good": (good, None),
        "good2": (pack_file(16, 8, True, [("MIPM", mip_chunk()), ("ALPM", alpha_chunk(6)), ("GTIL", gradient_chunk()), *RANGES]), None),
        "good3": (pack_file(16, 8, True, [("MIPM", mip_chunk()), ("ALPM", alpha_chunk(2, bytes(96))), *RANGES]), None),
        "stream": (good[:9], "INVALID_STREAM"), "end": (good[:-4], "INVALID_STREAM"), "header": (b"ABCD" + good[4:], "INVALID_HEADER"),
        "zip": (pack_file(16, 8, False, [("1DTL", bytes(broken)), *RANGES[1:]]), "INVALID_DECOMPRESSION"), "short": (pack_file(16, 8, False, [("1DTL", range_chunk(symbols=b"\0"))]), "INVALID_DECOMPRESSION"),
        "mip": (pack_file(16, 8, True, [("MIPM", mip_chunk(5)), *RANGES]), "INVALID_MIPMAP_LEVEL"), "impossible": (pack_file(16, 8, True, [("ALPM", alpha_chunk(3)), *RANGES]), "ALPHA_FORMAT_IMPOSSIBLE"),
        "alpha": (pack_file(16, 8, True, [("ALPM", alpha_chunk(7)), *RANGES]), "INVALID_ALPHA_FORMAT"), "unsupported": (pack_file(16, 8, True, [("MIPM", mip_chunk()), ("ALPM", alpha_chunk(0)), *RANGES]), "ALPHA_UNSUPPORTED_YET"),
        "tag": (pack_file(16, 8, False, [("XXXX", b""), *RANGES]), "INVALID_TAG_ID"), "order": (pack_file(16, 8, False, [*RANGES, ("GTIL", gradient_chunk())]), "INVALID_TAG_ID"),
        "beyond": (good[:12] + b"1DTL" + struct.pack("<I", 1 << 20) + struct.pack("<I", END), "INVALID_TAG_ID"), "plane": (pack_file(16, 8, False, [("1DTL", range_chunk(3))]), "INVALID_PLANE_ID"),
        "component": (pack_file(16, 8, False, [("3DTL", table_chunk(3)), *RANGES]), "INVALID_PLANE_ID"), "tables": (pack_file(16, 8, False, [("3DTL", table_chunk()), *RANGES]), "INVALID_LUT"),
    }
    return made


def test_broken_files_harm_no_other(spark, tmp_path):
    made = files()
    for name, (data, _) in made.items():
        (tmp_path / f"{name}.tile").write_bytes(data)
    engine = TileEngine(spark)
    got = {r.path.rpartition("/")[2][:-5]: r.code for r in engine.check(str(tmp_path)).collect()}
    want = {k: code for k, (_, code) in made.items()} | {"component": "INVALID_LUT"}
    assert got == want and engine.last_error() is None
    engine.assign_bank(lut_bank(spark))
    got = {r.path.rpartition("/")[2][:-5]: r.code for r in engine.check(str(tmp_path)).collect()}
    assert got == {k: code for k, (_, code) in made.items()} | {"tables": None}
    rows = engine.decode(str(tmp_path), permissive=True).collect()
    assert {r.name for r in rows} == {"good", "good2", "good3", "tables"} and len(rows) == 4 * 128
    assert {r.a for r in rows if r.name == "good3"} == {0} and {r.a for r in rows if r.name == "good"} == {None}
    assert engine.last_error() == "INVALID_ALPHA_FORMAT" and engine.last_error() is None  # of alpha.tile, the first by path


def raised(call):
    with pytest.raises(Exception) as caught:
        call()
    return caught.value


def test_codes_of_sessions(spark, tmp_path):
    """Those that no file brings about; with those of the files all codes there are."""
    codes = {code for _, code in files().values()} - {None}
    for call, code in ((lambda: TileEngine(None), "INIT_FAIL"), (lambda: TileEngine(spark, slots=0), "INVALID_CONTEXT_COUNT")):
        assert raised(call).code == code
        codes.add(code)
    one, other = tmp_path / "one", tmp_path / "other"
    for folder in (one, other):
        folder.mkdir()
        (folder / "good.tile").write_bytes(files()["good"][0])
    engine = TileEngine(spark, slots=1)

    def kept(call, code):
        raised(call)
        assert engine.last_error() == code
        codes.add(code)

    opened = engine.open(str(one))
    assert engine.decode(opened).count() == 128
    kept(lambda: engine.open(str(other)), "NO_EMPTYDECODE_SLOT")
    (one / "more.tile").write_bytes(files()["good"][0])
    kept(lambda: engine.decode(opened), "DECIMG_DIFFSTREAM")
    engine.close(opened)
    kept(lambda: engine.decode(opened), "DECIMG_INVALIDCTX")
    kept(lambda: engine.decode_into(str(other), None), "DECIMG_BUFFERNOTSET")
    into = []
    engine.decode_into(str(other), lambda rows: into.append(rows.count()))
    assert into == [128]

    def fails(what):
        def run(batches):
            for batch in batches:
                if len(batch):
                    raise what
                yield batch

        return lambda: spark.range(1).mapInPandas(run, "id long").count()

    kept(lambda: engine.action(fails(MemoryError("no more"))), "MALLOC_FAIL")
    kept(lambda: engine.action(fails(ModuleNotFoundError("No module named 'zstandard'"))), "DECOMPRESSION_CREATE_FAIL")
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://cluster"))
    kept(lambda: engine.action(lambda: shared.shared_folder(cluster)), "INVALID_CONTEXT_MEMALLOCATOR")
    (other / "bad.tile").write_bytes(files()["zip"][0])
    kept(lambda: engine.action(lambda: engine.decode(str(other)).count()), "INVALID_DECOMPRESSION")
    engine.release()
    assert engine.last_error() is None
    kept(lambda: engine.headers(str(one)), "INVALID_LIBRARYCTX")
    engine.release()
    assert engine.last_error() == "RELEASE_EMPTY_LIBRARY"
    codes.add("RELEASE_EMPTY_LIBRARY")
    assert codes == set(verify.CODES[1:])


def test_the_first_error_stays(spark, tmp_path):
    engine = TileEngine(spark)
    raised(lambda: engine.encode(spark.range(0).select(F.lit(0).alias("image_id")), 9, 8, str(tmp_path)))
    raised(lambda: engine.save_bank(str(tmp_path / "x")))
    assert engine.last_error() == "INVALID_SIZE" and engine.last_error() is None
    assert isinstance(raised(lambda: engine.save_bank(str(tmp_path / "x"))), ContainerError) and engine.last_error() == "INVALID_LUT"


def test_a_callers_builder_gets_the_rows(spark):
    rows = spark.createDataFrame([("i", 0, x, x, 10 + x, 20 + x, None) for x in range(3)], "name string, y int, x int, r int, g int, b int, a int")
    lines = TileEngine(spark).transform_output(rows, lambda df: df.groupBy("name", "y").agg(F.sort_array(F.collect_list(F.struct("x", "b", "g", "r"))).alias("p")))
    assert [[(q.b, q.g, q.r) for q in r.p] for r in lines.collect()] == [[(20, 10, 0), (21, 11, 1), (22, 12, 2)]]
