"""PNG files: every kind of file made here by hand, broken files, and a second decoder (that of the JVM) for what is written."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.sources import png
from tilewright.sources.files import qualified


def chunk(tag, body):
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def predict(kind, a, b, c):
    if kind == 4:
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
    return (0, a, b, (a + b) // 2)[kind]


def scanlines(samples, depth, rng):
    """Bytes of rows (rows, width, channels) packed by depth and filtered at random, one byte at a time."""
    rows, width, n = samples.shape
    step, out, above = max(1, n * depth // 8), b"", None
    for y in range(rows):
        bits = "".join(f"{v:0{depth}b}" for v in samples[y].ravel().tolist())
        line = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
        kind = int(rng.integers(0, 5))
        up = above or [0] * len(line)
        made = []
        for i, v in enumerate(line):
            a, c = (line[i - step], up[i - step]) if i >= step else (0, 0)
            made.append((v - predict(kind, a, up[i], c)) % 256)
        out += bytes([kind, *made])
        above = line
    return out


def file_of(samples, kind, depth, interlace, rng, palette=None, clear=None):
    high, wide, _ = samples.shape
    passes = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if interlace else ((0, 0, 1, 1),)
    lines = b"".join(scanlines(samples[y::dy, x::dx], depth, rng) for y, x, dy, dx in passes if y < high and x < wide)
    packed = zlib.compress(lines)
    parts = [png.SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, depth, kind, 0, 0, interlace)), chunk(b"tEXt", b"a\0b")]
    parts += [chunk(b"PLTE", palette)] if palette else []
    parts += [chunk(b"tRNS", clear)] if clear else []
    cut = len(packed) // 2
    return b"".join([*parts, chunk(b"IDAT", packed[:cut]), chunk(b"IDAT", packed[cut:]), chunk(b"IEND", b"")])


KINDS = [(k, d) for k, depths in png.DEPTHS.items() for d in depths]


@pytest.mark.parametrize("interlace", [0, 1])
@pytest.mark.parametrize(("kind", "depth"), KINDS)
def test_every_kind_of_file(kind, depth, interlace):
    rng = np.random.default_rng(kind * 100 + depth)
    for high, wide in ((8, 16), (24, 8), (1, 1), (5, 3), (13, 9)):
        samples = rng.integers(0, 1 << depth, (high, wide, png.CHANNELS[kind]))
        palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if kind == 3 else None
        clear = bytes([7, 200]) if kind == 3 and depth > 1 else None
        if kind in (0, 2) and interlace:
            clear = b"".join(struct.pack(">H", int(v)) for v in samples[0, 0])
        data = file_of(samples, kind, depth, interlace, rng, palette.tobytes() if palette is not None else None, clear)
        if kind == 3:
            want = palette[samples[:, :, 0]]
            if clear:
                alpha = np.array([7, 200, *[255] * 254])[samples[:, :, 0]]
                want = np.dstack([want, alpha])
        else:
            want = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
            if clear:
                want = np.dstack([want, np.where((samples == samples[0, 0]).all(axis=2), 0, 255)])
        assert (png.decode_png(data, 1) == want).all()
        if high % 8 or wide % 8:
            with pytest.raises(png.ImageError, match="INVALID_SIZE"):
                png.decode_png(data)


def broken():
    rng = np.random.default_rng(1)
    good = file_of(rng.integers(0, 256, (8, 8, 3)), 2, 8, 0, rng)
    short = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 20)) + chunk(b"IEND", b"")
    head = lambda *v: png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *v)) + chunk(b"IEND", b"")
    index = file_of(np.full((8, 8, 1), 3), 3, 8, 0, rng, b"\1\2\3")
    wrong = zlib.compress(bytes([9, *[0] * 24] * 8))
    filters = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", wrong) + chunk(b"IEND", b"")
    huge = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (8 * 25 + 10**6))) + chunk(b"IEND", b"")
    return {
        "good": (good, None), "huge": (huge, None), "stub": (b"\x89", "INVALID_IMAGE"), "text": (b"no image at all", "INVALID_IMAGE"), "cut": (good[:-30], "INVALID_IMAGE"), "flipped": (good[:60] + bytes([good[60] ^ 1]) + good[61:], "INVALID_IMAGE"),
        "short": (short, "INVALID_IMAGE"), "zero": (head(0, 8, 8, 2, 0, 0, 0), "INVALID_IMAGE"), "kind": (head(8, 8, 8, 5, 0, 0, 0), "INVALID_IMAGE"), "depth": (head(8, 8, 4, 2, 0, 0, 0), "INVALID_IMAGE"), "index": (index, "INVALID_IMAGE"),
        "filters": (filters, "INVALID_IMAGE"), "odd": (file_of(rng.integers(0, 256, (8, 12, 4)), 6, 8, 0, rng), "INVALID_SIZE"),
    }


def test_broken_files_among_good_ones(spark, tmp_path):
    """Each broken or refused file is a row with its error; the others are read."""
    files = broken()
    for name, (data, _) in files.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    (tmp_path / "note.txt").write_text("other")
    rows = png.read_png(spark, str(tmp_path)).select(png.name_of("path").alias("name"), "width", "height", "channels", "y", "error").collect()
    errors = {r.name: r.error for r in rows if r.error}
    assert {k: v.partition(":")[0] for k, v in errors.items()} == {k: code for k, (_, code) in files.items() if code}
    assert all(r.y is None for r in rows if r.error)
    assert sum(r.name == "good" for r in rows) == 64 and [(r.width, r.height, r.channels) for r in rows if r.name == "odd"] == [(12, 8, 4)]


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_written_files_through_two_decoders(spark, tmp_path, channels):
    """Smooth and noisy images of several bands, values out of range, missing and repeated pixels."""
    rng = np.random.default_rng(channels)
    names, rows, want = "abcd"[:channels], [], {}
    for k, (high, wide) in enumerate(((8, 8), (200, 24), (136, 16))):
        image = rng.integers(-40, 300, (high, wide, channels)) if k else np.add.outer(np.arange(high) * 3, np.arange(wide))[:, :, None] + np.arange(channels)
        want[f"i{k}"] = np.clip(image, 0, 255)
        rows += [(f"i{k}", y, x, *map(int, image[y, x])) for y in range(high) for x in range(wide) if not (k == 1 and 64 <= y < 140 and (y, x) != (64, 3))]
    want["i1"][64:140] = 0
    want["i1"][64, 3] = np.clip(rows[8 * 8 + 64 * 24][3:], 0, 255)
    rows.append(("i2", 5, 5, *[-5] * channels))
    pixels = spark.createDataFrame(rows, "name string, y int, x int, " + ", ".join(f"{n} int" for n in names)).repartition(5)
    png.write_png(pixels, str(tmp_path / "out"), list(names))
    got = {}
    for r in png.read_png(spark, str(tmp_path / "out")).withColumn("name", png.name_of("path")).collect():
        assert r.error is None
        got.setdefault(r.name, np.zeros_like(want[r.name]))[r.y, r.x] = {1: [r.r], 2: [r.r, r.a], 3: [r.r, r.g, r.b], 4: [r.r, r.g, r.b, r.a]}[channels]
        assert channels > 2 or r.r == r.g == r.b
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    other = {r.origin.rpartition("/")[2][:-4]: r for r in spark.read.format("image").load(str(tmp_path / "out")).select("image.*").collect()}
    assert other.keys() == want.keys()
    for k, r in other.items():
        flat = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
        if channels == 1:
            assert (flat[:, :, 0] == want[k][:, :, 0]).all()
        elif channels > 2:
            assert (flat[:, :, 2::-1] == want[k][:, :, :3]).all() and (channels < 4 or (flat[:, :, 3] == want[k][:, :, 3]).all())


def test_signed_channels_and_empty_tables(spark, tmp_path):
    rows = [("s", y, x, x - 200 * y, y) for y in range(8) for x in range(8)]
    pixels = spark.createDataFrame(rows, "name string, y int, x int, v int, w int")
    png.write_png(pixels, str(tmp_path / "out"), ["v", "w", "w"], ("v",))
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in png.read_png(spark, str(tmp_path / "out")).collect()}
    assert got == {(y, x): (min(255, max(0, v + 128)), w, w) for _, y, x, v, w in rows}
    assert png.png_files(pixels.limit(0), ["v"]).collect() == []


def test_filters_have_the_least_sum():
    rng = np.random.default_rng(3)
    rows = np.cumsum(rng.integers(0, 9, (20, 11, 3)), axis=1) % 256
    lines = png.filtered(rows)
    assert len(set(lines[:, 0].tolist())) > 1 and lines[0, 0] < 2
    assert (png.unfilter(lines, 3).reshape(rows.shape) == rows).all()
    for y in range(20):
        costs = []
        for kind in range(5 if y else 2):
            cost = 0
            for x in range(11):
                for k in range(3):
                    a, b, c = (int(rows[y, x - 1, k]) if x else 0), (int(rows[y - 1, x, k]) if y else 0), (int(rows[y - 1, x - 1, k]) if x and y else 0)
                    v = (int(rows[y, x, k]) - predict(kind, a, b, c)) % 256
                    cost += min(v, 256 - v)
            costs.append(cost)
        assert lines[y, 0] == costs.index(min(costs))


def test_paths_without_a_scheme_are_sparks(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"


def test_an_aborted_write_leaves_no_files(spark, tmp_path):
    from tilewright.sources.files import write_files

    bad = spark.range(4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") < 3, F.lit(b"x")).otherwise(F.raise_error(F.lit("no"))).cast("binary").alias("data")).repartition(1)
    with pytest.raises(Exception, match="no"):
        write_files(bad, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.suffix != ".crc" and not p.name.startswith(".")] if (tmp_path / "out").exists() else True
