"""Maps of single colours against a plain loop that codes every candidate map from scratch."""

import struct
from collections import Counter

import numpy as np
import pytest
import zstandard

from tilewright.operators import flatmaps


def pack(data):
    return zstandard.ZstdCompressor(level=15).compress(data)


def brute_coded(filled):
    """Byte by byte: gaps of 16 or more are left out."""
    runs, at, i, n = [], 0, 0, len(filled)
    while i < n:
        j = i
        while j < n and filled[j] == 0:
            j += 1
        if j - i >= 16:
            if i > at:
                runs.append((at, i - at))
            at = j
        i = max(j, i + 1)
    if at < n:
        runs.append((at, n - at))
    steps, last = b"", 0
    for s, length in runs:
        steps += struct.pack("<II", s - last, length)
        last = s
    return pack(b"".join(bytes(filled[s : s + k]) for s, k in runs)), pack(steps)


def brute_maps(image):
    high, wide = image.shape[:2]
    place = {(y, x): (x & 7) | (y & 7) << 3 | ((x >> 3) + (y >> 3) * (wide >> 3)) << 6 for y in range(high) for x in range(wide)}
    colors = {k: int(image[k][0]) << 16 | int(image[k][1]) << 8 | int(image[k][2]) for k in place}
    counts = Counter(colors.values())
    filled, taken, valid, prev, prev_size = [0] * (high * wide), [], 0, 0, 0
    for color, cnt in sorted(counts.items(), key=lambda t: (-t[1], t[0])):
        number = len(taken) + 1
        if cnt <= 150 or number >= 85:
            break
        for k, v in colors.items():
            if v == color:
                filled[place[k]] = number
        valid = prev + cnt
        stream, runs = (len(b) for b in brute_coded(filled))
        if valid * 7 < stream * 8 + number * 24 + runs * 8:
            break
        if (stream + runs + number * 3 - prev_size) * 8.0 / cnt > 7.0:
            for k, v in colors.items():
                if v == color:
                    filled[place[k]] = 0
            continue
        taken.append((number, color, cnt, stream, runs))
        prev, prev_size = valid, stream + runs
    return taken


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maps_of_small_images(spark, seed):
    """Flat areas, scattered colours that cost too much, many colours, noise only."""
    rng = np.random.default_rng(seed)
    images = {0: rng.integers(0, 256, (48, 64, 3)), 1: np.zeros((48, 64, 3), int), 2: rng.integers(0, 2, (48, 64, 1)) * np.array([200, 30, 60]), 3: rng.integers(0, 256, (48, 64, 3))}
    images[3][:20, :40] = (9, 9, 9)
    images[3][30:, 20:] = (200, 1, 1)
    images[3][20:30][rng.random((10, 64)) < 0.5] = (7, 0, 0)
    images[4] = np.repeat(np.repeat(rng.integers(0, 6, (6, 8, 1)), 8, axis=0), 8, axis=1) * np.array([40, 3, 1])
    images[4][rng.random((48, 64)) < 0.1] = (1, 2, 3)
    rows = [(i, y, x, *map(int, v[y, x])) for i, v in images.items() for y in range(48) for x in range(64)]
    got = {}
    for r in flatmaps.single_color_maps(spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int").repartition(3), 64, 48).collect():
        got.setdefault(r.image_id, []).append((r.number, r.color, r.cnt, r.stream, r.runs))
    want = {i: brute_maps(v) for i, v in images.items()}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert len(want[1]) == 1 and not want[0] and want[3] and len(want[4]) > 2


def test_runs_of_maps():
    rng = np.random.default_rng(5)
    for _ in range(200):
        filled = np.repeat(rng.integers(0, 3, 12), rng.integers(0, 40, 12)).astype(np.uint8)
        assert flatmaps.coded(filled) == brute_coded(filled.tolist())
        assert (flatmaps.restored(*flatmaps.coded(filled), len(filled)) == filled).all()
    stream, runs = flatmaps.coded(np.arange(1, 60, dtype=np.uint8))
    for bad in ((stream, runs, 58), (pack(b"1"), runs, 59), (pack(b"1" * 80), runs, 59)):
        with pytest.raises(ValueError, match="run beyond|more bytes"):
            flatmaps.restored(*bad)
    assert flatmaps.map_runs(np.zeros(0, np.uint8)) == [] and flatmaps.map_runs(np.zeros(99, np.uint8)) == []


def test_no_images(spark):
    assert flatmaps.single_color_maps(spark.createDataFrame([], "image_id int, y int, x int, r int, g int, b int"), 8, 8).collect() == []
