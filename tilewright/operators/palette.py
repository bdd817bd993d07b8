"""Colour streams as deltas to earlier colours, with a code book of the most frequent ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.scalar import c, idiv

#: Entries written, entries searched, colours looked back on for the book and for the codes.
BOOK, SEARCHED, BOOK_REACH, REACH = 128, 64, 64, 65
CODE, JUMP, RELATIVE, ABSOLUTE = 0x00, 0xC0, 0x80, 0x88
#: Colours of a stream that are looked through together.
RUN = 4096


def _runs(streams: DataFrame, reach: int) -> DataFrame:
    """streams with run: RUN colours each, with the reach colours before them."""
    run, ahead = idiv("n", RUN), idiv(c("n") + reach, RUN)
    each = F.explode(F.when(run == ahead, F.array(run)).otherwise(F.array(run, ahead))).alias("run")
    return streams.select("stream", "n", *"rgb", each)


def _plain(names: pd.Series) -> pd.Series:
    """Names as plain objects: pandas' own strings come in pieces after a selection, which Arrow does not take in a struct."""
    return pd.Series(names.to_numpy(), dtype=object)


def _back(frame: pd.DataFrame, reach: int):
    """The run's own rows in order, how far each of the reach colours before lies in r, g and b (the last column is the one just before), and which are there."""
    frame = frame.sort_values("n")
    n, run = frame.n.to_numpy(), int(frame.run.iloc[0])
    first = n[0] - reach
    values, there = np.zeros((n[-1] - first + 1, 3), np.int32), np.zeros(n[-1] - first + 1, bool)
    values[n - first], there[n - first] = frame[list("rgb")].to_numpy(np.int32), True
    mine = frame[n // RUN == run]
    at = mine.n.to_numpy() - first
    before = np.lib.stride_tricks.sliding_window_view(values, reach, axis=0)[at - reach]
    return mine, values[at][:, :, None] - before, np.lib.stride_tricks.sliding_window_view(there, reach)[at - reach]


def nearest_deltas(streams: DataFrame) -> DataFrame:
    """(stream, n, dr, dg, db) modulo 256 to the nearest of the BOOK_REACH colours before, of equals the first. A run of a stream is one group."""
    kind, place = streams.schema["stream"].dataType.simpleString(), streams.schema["n"].dataType.simpleString()

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        mine, apart, there = _back(frame, BOOK_REACH)
        dist = np.where(there, (apart.astype(np.int64) ** 2).sum(axis=1), np.iinfo(np.int64).max)
        best = dist.argmin(axis=1)
        deltas = apart[np.arange(len(mine)), :, best] & 255
        out = pd.DataFrame({"stream": _plain(mine.stream), "n": mine.n.to_numpy(), **{f"d{k}": deltas[:, i] for i, k in enumerate("rgb")}})
        return out[there.any(axis=1)]

    return _runs(streams, BOOK_REACH).groupBy("stream", "run").applyInPandas(near, f"stream {kind}, n {place}, dr int, dg int, db int")


def code_book(deltas: DataFrame, most: int = BOOK) -> DataFrame:
    """(stream, idx, dr, dg, db, ref): entry 0 is no change; then by frequency, of equals the first that came.

    Only the top of each stream's book is ranked together, a bounded number of rows."""
    # no change counts once more than it comes, as all streams have it
    own = F.struct(*[c(f"d{k}").cast("int").alias(f"d{k}") for k in "rgb"], c("n").cast("long").alias("n"))
    none = F.struct(*[F.lit(0).alias(f"d{k}") for k in "rgb"], F.lit(None).cast("long").alias("n"))
    each = deltas.select("stream", F.explode(F.array(own, none)).alias("d")).select("stream", "d.*")
    zero = (c("dr") == 0) & (c("dg") == 0) & (c("db") == 0)
    counted = each.groupBy("stream", "dr", "dg", "db").agg(F.count("n").alias("many"), F.min("n").alias("first"))
    refs = counted.select("stream", "dr", "dg", "db", (F.col("many") - F.when(zero, 0).otherwise(1)).alias("ref"), "first", F.when(zero, 0).otherwise(1).alias("moves"))
    ranked = refs.withColumn("idx", F.row_number().over(Window.partitionBy("stream").orderBy("moves", F.desc("ref"), "first"))).where(F.col("idx") <= most)
    return ranked.select("stream", (F.col("idx") - 1).alias("idx"), "dr", "dg", "db", "ref")


def _code_bytes(frame: pd.DataFrame, book: pd.DataFrame):
    """The rows after a stream's first of a run, up to four bytes of code for each, and which of them are written."""
    mine, apart, there = _back(frame, REACH)
    later = mine.n.to_numpy() > 0
    mine, apart, there = mine[later], apart[later], there[later]
    book = book.sort_values("idx")
    listed = (book.dr.to_numpy(np.int64) << 16) | (book.dg.to_numpy(np.int64) << 8) | book.db.to_numpy(np.int64)
    order = np.argsort(listed, kind="stable")
    near, far = np.full(len(mine), SEARCHED), np.full(len(mine), SEARCHED * 64)
    if len(book):
        bytes_ = apart & 255
        delta = (bytes_[:, 0].astype(np.int64) << 16) | (bytes_[:, 1].astype(np.int64) << 8) | bytes_[:, 2]
        at = order[np.minimum(np.searchsorted(listed[order], delta), len(book) - 1)]
        idx = np.where(there & (listed[at] == delta), book.idx.to_numpy(np.int64)[at], SEARCHED)
        near = idx[:, -1]
        # back by 0 to 63 beyond the colour before: the least code, of equals the nearest
        far = (idx[:, :-1] * 64 + np.arange(REACH - 2, -1, -1)).min(axis=1)
    step, value = apart[:, :, -1], mine[list("rgb")].to_numpy(np.int32)
    moved = step != 0
    small = ((step >= -128) & (step <= 127)).all(axis=1)
    head = np.where(small, RELATIVE, ABSOLUTE) + moved @ np.array([1, 2, 4])
    data, written = np.zeros((len(mine), 4), np.uint8), np.ones((len(mine), 4), bool)
    data[:, 0], data[:, 1:], written[:, 1:] = head, np.where(small[:, None], step, value) & 255, moved
    jump = far < SEARCHED * 64
    data[jump, 0], data[jump, 1], written[jump, 1:] = JUMP + far[jump] % 64, far[jump] // 64, [True, False, False]
    one = near < SEARCHED
    data[one, 0], written[one, 1:] = near[one], False
    return mine, data, written


def _coded(streams: DataFrame, book: DataFrame, made, columns: str) -> DataFrame:
    """made(run's rows, bytes, written) of each run of a stream, next to the searched part of its book."""
    searched = book.where(c("idx") < SEARCHED).select("stream", "idx", "dr", "dg", "db")
    runs = streams.groupBy("stream").agg(F.max("n").alias("last")).select("stream", F.explode(F.sequence(F.lit(0).cast("long"), idiv("last", RUN))).alias("run"))
    kind = streams.schema["stream"].dataType.simpleString()
    none = [f.split()[0] for f in ("stream", *columns.split(", "))]

    def code(frame: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        return made(*_code_bytes(frame, entries)) if len(frame) else pd.DataFrame(columns=none)

    left, right = _runs(streams, REACH).groupBy("stream", "run"), searched.join(runs, "stream").groupBy("stream", "run")
    return left.cogroup(right).applyInPandas(code, f"stream {kind}, {columns}")


def codes(streams: DataFrame, book: DataFrame) -> DataFrame:
    """(stream, n, code) for colours after the first: the bytes of each, as hexadecimal digits.

    A code of the book to the colour before; else the least code to one of those further back, of equals the
    nearest; else the difference to the colour before, or its bytes where that is beyond a signed byte."""

    def rows(mine, data, written) -> pd.DataFrame:
        ends = 2 * written.sum(axis=1).cumsum()
        whole = data[written].tobytes().hex().upper()
        return pd.DataFrame({"stream": _plain(mine.stream), "n": mine.n.to_numpy(), "code": pd.Series([whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)], dtype=object)})

    return _coded(streams, book, rows, f"n {streams.schema['n'].dataType.simpleString()}, code string")


def encode(streams: DataFrame) -> DataFrame:
    """(stream, data): number of book entries, the book, the first colour, the codes. Streams are of 0-based n."""
    from .gradient import checkpointed

    book = checkpointed(code_book(nearest_deltas(streams)))
    two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "dr", "dg", "db"))), lambda s: F.concat(two(s["dr"]), two(s["dg"]), two(s["db"]))), "")
    heads = book.groupBy("stream").agg(F.concat(two(F.count("*")), listed).alias("head"))
    first = streams.where("n = 0").select("stream", F.concat(*[two(c(k)) for k in "rgb"]).alias("first"))

    def whole(mine, data, written) -> pd.DataFrame:
        return pd.DataFrame({"stream": _plain(mine.stream)[:1], "run": mine.n.to_numpy()[:1] // RUN, "code": pd.Series([data[written].tobytes()] * min(1, len(mine)), dtype=object)})

    parts = _coded(streams, book, whole, "run long, code binary")
    body = parts.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", F.hex("code").alias("code")))), lambda s: s["code"]), "").alias("body"))
    lone = F.lit("01000000")
    return first.join(heads, "stream", "left").join(body, "stream", "left").select("stream", F.unhex(F.concat(F.coalesce("head", lone), "first", F.coalesce("body", F.lit("")))).alias("data"))


def decode_bytes(data: bytes, count: int) -> list[tuple[int, int, int]]:
    """The colours of one stream; ValueError where it is broken."""
    if not data:
        raise ValueError("an empty palette stream")
    size = data[0]
    at = 1 + 3 * size
    if at + 3 > len(data):
        raise ValueError("the code book goes beyond the stream")
    book = [data[1 + 3 * i : 4 + 3 * i] for i in range(size)]
    out = [tuple(data[at : at + 3])]
    at, last = at + 3, 0
    while len(out) < count:
        if at >= len(data):
            raise ValueError("the stream ends before its colours")
        code = data[at]
        at += 1
        if code < 0x80:
            if code >= size:
                raise ValueError("a code beyond the book")
            out.append(tuple((a + b) & 255 for a, b in zip(out[last], book[code], strict=True)))
        elif code >= 0xC0:
            last = len(out) - (code & 63) - 2
            if last < 0:
                raise ValueError("a reference before the first colour")
            continue
        else:
            kind = code >> 3 & 7
            if kind > 1:
                raise ValueError("an unknown code")
            new = []
            for i, base in enumerate(out[last]):
                if code >> i & 1:
                    if at >= len(data):
                        raise ValueError("the stream ends inside a code")
                    new.append((base + data[at]) & 255 if kind == 0 else data[at])
                    at += 1
                else:
                    new.append(base)
            out.append(tuple(new))
        last = len(out) - 1
    return out


def decode(encoded: DataFrame) -> DataFrame:
    """(stream, n, r, g, b) from (stream, data, colors). Each stream is a fold over its bytes, in one task."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for stream, data, count in zip(frame.stream, frame.data, frame.colors, strict=True):
            got = pd.DataFrame(decode_bytes(bytes(data), int(count)), columns=list("rgb"))
            parts.append(got.assign(stream=stream, n=range(len(got))))
        return pd.concat(parts)[["stream", "n", *"rgb"]]

    kind = encoded.schema["stream"].dataType.simpleString()
    return encoded.groupBy("stream").applyInPandas(one, f"stream {kind}, n int, r int, g int, b int")
