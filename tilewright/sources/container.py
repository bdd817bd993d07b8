"""Chunked container files: a magic, a header, tagged chunks padded to four bytes, an end tag."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources.files import write_files

#: Tags of chunks, the end tag, and the order their states may come in.
MIP, ALPHA, GRADIENT, TABLE, RANGE = "MIPM", "ALPM", "GTIL", "3DTL", "1DTL"
END = 0xDEADBEEF
STATES = {MIP: 1, ALPHA: 2, GRADIENT: 4, TABLE: 5, RANGE: 5}
#: The file's first four bytes: a parameter of the source and the sink.
MAGIC = b"TILW"
_HEADER = "<4sHHHH"


class ContainerError(ValueError):
    """A file or stream that cannot be read; code says why."""

    def __init__(self, code: str, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


def pack_file(width: int, height: int, alpha: bool, chunks: list[tuple[str, bytes]], magic: bytes = MAGIC) -> bytes:
    parts = [struct.pack(_HEADER, magic, 1, width, height, int(alpha))]
    for tag, payload in chunks:
        padded = payload + b"\0" * (-len(payload) % 4)
        parts += [tag.encode("ascii"), struct.pack("<I", len(padded)), padded]
    return b"".join([*parts, struct.pack("<I", END)])


def split_file(data: bytes, magic: bytes = MAGIC, payloads: bool = True) -> Iterator[tuple]:
    """(width, height, alpha, seq, tag, length, payload) for each chunk; payload None where not asked for."""
    if len(data) < struct.calcsize(_HEADER):
        raise ContainerError("INVALID_STREAM", "shorter than a header")
    found, version, width, height, info = struct.unpack_from(_HEADER, data)
    if found != magic or version != 1:
        raise ContainerError("INVALID_HEADER", "not a container of this version")
    at, seq = struct.calcsize(_HEADER), 0
    while True:
        if at + 4 > len(data):
            raise ContainerError("INVALID_STREAM", "no end tag")
        if struct.unpack_from("<I", data, at)[0] == END:
            return
        if at + 8 > len(data):
            raise ContainerError("INVALID_STREAM", "cut inside a chunk's head")
        tag, (length,) = data[at : at + 4].decode("latin-1"), struct.unpack_from("<I", data, at + 4)
        if at + 8 + length > len(data):
            raise ContainerError("INVALID_STREAM", f"chunk {tag} goes beyond the file")
        yield width, height, bool(info & 1), seq, tag, length, data[at + 8 : at + 8 + length] if payloads else None
        at, seq = at + 8 + length, seq + 1


_COLUMNS = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("alpha", pa.bool_()), ("seq", pa.int32()), ("tag", pa.string()), ("length", pa.int64()), ("payload", pa.binary())])
CHUNKS = "path string, width int, height int, alpha boolean, seq int, tag string, length long, payload binary"


def chunks_of(files: DataFrame, magic: bytes = MAGIC, payloads: bool = True) -> DataFrame:
    """CHUNKS of binary files (path, content); works on a stream of files as well."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = [(path, *r) for r in split_file(content.as_py(), magic, payloads)]
                columns = list(zip(*rows, strict=True)) or [[] for _ in _COLUMNS]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _COLUMNS, strict=True)], schema=_COLUMNS)

    return files.select("path", "content").mapInArrow(split, CHUNKS)


def read_containers(spark: SparkSession, path: str, magic: bytes = MAGIC, payloads: bool = True) -> DataFrame:
    """CHUNKS of the container files under a path, through Spark's own file systems."""
    return chunks_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.tile").load(path), magic, payloads)


def write_containers(chunks: DataFrame, path: str, magic: bytes = MAGIC) -> None:
    """Write chunks (name, width, height, alpha, seq, tag, payload) as one file for each name; a file's chunks meet in one task."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "tag", "payload"))).alias("chunks")
    files = chunks.groupBy("name", "width", "height", "alpha").agg(ordered)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in ("name", "width", "height", "alpha", "chunks")), strict=True)
            made = [(f"{n}.tile", pack_file(w, h, a, [(x["tag"], x["payload"]) for x in parts], magic)) for n, w, h, a, parts in rows]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], ["name", "data"])

    write_files(files.mapInArrow(build, "name string, data binary"), path)
