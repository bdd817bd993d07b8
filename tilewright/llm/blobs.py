"""Arrays packed into binary columns, and groups streamed from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers, as differences with equal bytes side by side."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_array(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    return squeeze(values.view(np.uint8).reshape(-1, width).T.tobytes())


def unpack_array(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(expand(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(key, rows) for each run of equal keys; rows must be used up before the next key is asked for."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(key).to_pylist(), *(c.to_pylist() for c in batch.columns), strict=True)

    source = rows()
    ahead = next(source, None)

    def run(now) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[0] == now:
            yield ahead[1:]
            ahead = next(source, None)

    while ahead is not None:
        now = ahead[0]
        mine = run(now)
        yield now, mine
        for _ in mine:
            pass


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several (keys, counts), with the sums of their counts."""
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
