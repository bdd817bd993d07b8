"""What is wrong with files, as codes: every file is looked through by the task that reads it, and a broken one harms no other."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tilewright.plans import images
from tilewright.sources.container import _COLUMNS, ALPHA, CHUNKS, GRADIENT, MAGIC, MIP, RANGE, STATES, TABLE, ContainerError, split_file

#: The codes that a session may have, in the order of their numbers.
CODES = (
    "NO_ERROR INVALID_LIBRARYCTX MALLOC_FAIL INVALID_CONTEXT_COUNT INIT_FAIL RELEASE_EMPTY_LIBRARY INVALID_STREAM INVALID_HEADER NO_EMPTYDECODE_SLOT DECIMG_INVALIDCTX DECIMG_DIFFSTREAM"
    " DECIMG_BUFFERNOTSET INVALID_CONTEXT_MEMALLOCATOR INVALID_DECOMPRESSION INVALID_LUT DECOMPRESSION_CREATE_FAIL INVALID_MIPMAP_LEVEL ALPHA_FORMAT_IMPOSSIBLE INVALID_ALPHA_FORMAT"
    " ALPHA_UNSUPPORTED_YET INVALID_TAG_ID INVALID_PLANE_ID"
).split()
_CODE = re.compile(r"\b(" + "|".join([*CODES[1:], "INVALID_SIZE", "INVALID_IMAGE", "INVALID_TABLE_CHUNK"]) + r")\b")
#: What other failures of a plan mean.
_SIGNS = (
    (r"OutOfMemoryError|MemoryError|std::bad_alloc", "MALLOC_FAIL"),
    (r"No module named '?zstandard", "DECOMPRESSION_CREATE_FAIL"),
    (r"set spark\.checkpoint\.dir|checkpoint directory has not been set", "INVALID_CONTEXT_MEMALLOCATOR"),
    (r"ZstdError|zstd", "INVALID_DECOMPRESSION"),
)


def code_of(error: BaseException) -> str:
    """The code of a failure, also of one that comes from a task: named in its text, or told by what went wrong."""
    if found := getattr(error, "code", None):
        if isinstance(found, str):
            return found
    text = f"{type(error).__name__}: {error}"
    if m := _CODE.search(text):
        return m[1]
    return next((code for sign, code in _SIGNS if re.search(sign, text)), "FAILED")


def _payload_code(tag: str, payload: bytes, masked: bool, tables: bool) -> str | None:
    """What is wrong with a chunk's payload. masked: a mask came before; tables: point tables are assigned."""
    one = pd.Series([payload])
    if tag == MIP:
        images._mask_parts(one)
    elif tag == ALPHA:
        kind = struct.unpack_from(images._ALPHA_HEAD, payload)[7] & 7
        if kind in (0, 2, 3) and not masked:
            return "ALPHA_FORMAT_IMPOSSIBLE"
        if kind == 0:
            return "ALPHA_UNSUPPORTED_YET"
        images._alpha_parts(one)
    elif tag == GRADIENT:
        images._gradient_parts(one)
    elif tag == TABLE:
        if not tables:
            return "INVALID_LUT"
        if struct.unpack_from(images._TABLE_HEAD, payload)[24] != 7:
            return "INVALID_PLANE_ID"
        images._table_parts(one)
    elif tag == RANGE:
        plane, pixels, *_ = struct.unpack_from(images._RANGE_HEAD, payload)
        if plane > 2:
            return "INVALID_PLANE_ID"
        if len(images._range_parts(one).symbols[0]) != pixels:
            return "INVALID_DECOMPRESSION"
    return None


def file_code(data: bytes, magic: bytes = MAGIC, tables: bool = True) -> tuple[str | None, list[tuple]]:
    """The first thing that is wrong with a file (None: nothing), and its chunks."""
    rows: list[tuple] = []
    try:
        rows = list(split_file(data, magic))
    except ContainerError as error:
        return ("INVALID_TAG_ID" if "beyond the file" in str(error) else error.code), []
    reached, masked = 0, False
    for *_, tag, _, payload in rows:
        if tag not in STATES or STATES[tag] < reached or tag in (MIP, ALPHA) and STATES[tag] == reached:
            return "INVALID_TAG_ID", rows
        reached = STATES[tag]
        try:
            if code := _payload_code(tag, payload, masked, tables):
                return code, rows
        except struct.error:
            return "INVALID_STREAM", rows
        except Exception as error:
            code = code_of(error)
            return ("INVALID_DECOMPRESSION" if code in ("FAILED", "INVALID_TABLE_CHUNK") else code), rows
        masked |= tag == MIP
    return None, rows


def checked_chunks(files: DataFrame, magic: bytes = MAGIC, tables: bool = True, seen: Observation | None = None) -> DataFrame:
    """CHUNKS and code of binary files (path, content): the chunks of good files with code null, a row for each bad file with its code and no chunk.

    seen gathers, in the job that reads the files, how many are bad (bad) and the code of the first by path (code)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_COLUMNS, pa.field("code", pa.string())])
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                code, rows = file_code(content.as_buffer().to_pybytes(), magic, tables)
                made = [(path, *r, None) for r in rows] if code is None else [(path, *[None] * (len(_COLUMNS) - 1), code)]
                columns = list(zip(*made, strict=True)) or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    found = files.select("path", "content").mapInArrow(look, f"{CHUNKS}, code string")
    if seen is None:
        return found
    return found.observe(seen, F.count("code").alias("bad"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("path"))).alias("code"))
