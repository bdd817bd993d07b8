"""The search for a compression level, against every level in turn."""

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tilewright.functions.entropy import LEVELS_DOWN, LEVELS_UP, zstd_search
from tilewright.plans import codec


def walk(data, levels):
    sizes = [len(zstandard.ZstdCompressor(level=n).compress(data)) for n in levels]
    upto = next((k for k in range(len(sizes)) if k and sizes[k] > min(sizes[:k])), len(sizes))
    least = min(sizes[:upto])
    return levels[sizes.index(least)], least


def test_levels_are_those_of_the_walk(spark):
    rng = np.random.default_rng(3)
    data = [b"", b"a", b"ab" * 5000, rng.integers(0, 256, 3000, np.uint8).tobytes(), rng.integers(0, 3, 20000, np.uint8).tobytes(), (b"the same again " * 90 + rng.integers(0, 9, 400, np.uint8).tobytes()) * 7]
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)] + [(99, None)], "i int, data binary")
    for levels in (LEVELS_UP, LEVELS_DOWN):
        got = {r.i: r for r in rows.select("i", zstd_search(F.col("data"), levels).alias("s")).select("i", "s.level", F.length("s.packed").alias("n")).collect()}
        assert got[99].level is None and got[99].n is None
        for i, d in enumerate(data):
            assert (got[i].level, got[i].n) == walk(d, levels)


def test_whole_bands_come_back(spark):
    rows = codec.QUERIES["op_t8_level_search"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.same_up and r.same_down and 5 <= r.level_up <= 21 and 11 <= r.level_down <= 21 for r in rows)
