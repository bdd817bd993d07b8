"""Zstandard compression of binary columns, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def zstd_compress(data: Column, level: int = 18) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        import zstandard

        return s.map(lambda b: None if b is None else zstandard.ZstdCompressor(level=level).compress(bytes(b)))

    return run(data)


def zstd_decompress(data: Column, expected: Column) -> Column:
    """None for empty data; an error where the length is not the expected one."""

    @F.pandas_udf("binary")
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        import zstandard

        out = []
        for b, size in zip(s, n, strict=True):
            got = None if b is None or not len(b) else zstandard.ZstdDecompressor().decompress(bytes(b), max_output_size=max(1, int(size)))
            if got is not None and len(got) != size:
                raise ValueError(f"{len(got)} bytes where {size} were expected")
            out.append(got)
        return pd.Series(out, dtype=object)

    return run(data, expected)


#: Levels of the two searches: up for alpha streams, down for maps of single colours.
LEVELS_UP, LEVELS_DOWN = range(5, 22), range(21, 10, -1)


def zstd_search(data: Column, levels=LEVELS_UP) -> Column:
    """struct(level, packed): the levels are tried in turn until one gives more than the least so far; of equal sizes the
    first level stays. Null where data is null; empty data is compressed as any other."""

    @F.pandas_udf("level int, packed binary")
    def run(s: pd.Series) -> pd.DataFrame:
        import zstandard

        found = []
        for b in s:
            best, level = None, None
            for n in () if b is None else levels:
                packed = zstandard.ZstdCompressor(level=n).compress(bytes(b))
                if best is None or len(packed) < len(best):
                    best, level = packed, n
                elif len(packed) > len(best):
                    break
            found.append((level, best))
        return pd.DataFrame({"level": pd.array([x for x, _ in found], "Int32"), "packed": pd.Series([p for _, p in found], dtype=object)})

    return run(data)
