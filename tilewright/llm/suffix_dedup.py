"""Repeated passages by deep-shallow suffix sorting: every byte of a 100-byte string that starts earlier too goes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import batch, expand, groups, pack_sorted, squeeze, unpack_sorted
from .jaccard import mix
from .shared import Workspace, arrow_rows, load, text_or_empty

#: Length of a repeated string, and of the grams whose smallest hash in it is its anchor.
LENGTH, GRAM = 100, 24
_LEFT = LENGTH - GRAM
#: Bytes of text that travel together, and that are hashed at a time.
CHUNK, _PIECE = 16 << 20, 2 << 20
#: Words of eight bytes that multikey quicksort looks at; groups alike beyond go to blind tries.
SHALLOW = 6
_WIDE = np.uint64(0xFFFFFFFF)


# ---- the sort


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Numbers of equal strings, in the order of the strings, which all have one length.

    Inner nodes hold only where their strings part. A string goes down blindly to some leaf, is compared
    with it once, and is hung where the comparison says."""
    root: list = [strings[0], [0]]  # a leaf: [string, numbers]; an inner node: (place, {byte: node})
    for number in range(1, len(strings)):
        s = strings[number]
        node = root
        while type(node) is tuple:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        t = node[0]
        if s == t:
            node[1].append(number)
            continue
        apart = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
        at = len(s) - (apart.bit_length() + 7) // 8
        leaf, above, node = [s, [number]], None, root
        while type(node) is tuple and node[0] < at:
            above, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == at:
            node[1][s[at]] = leaf
            continue
        inner = (at, {s[at]: leaf, t[at]: node})
        if above is None:
            root = inner
        else:
            above[1][s[above[0]]] = inner
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            stack.extend(kid for _, kid in sorted(node[1].items(), reverse=True))
        else:
            out.append(node[1])
    return out


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a byte matrix, and for each row whether it is the first of its equals.

    Multikey quicksort parts the rows by one word of eight bytes at a time, down to the shallow depth; each
    group that is still alike there is put in order by a blind trie. Equal rows keep the order they come in."""
    n, width = rows.shape
    words = rows.view(">u8")
    order, group, first = np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    active = np.arange(n)
    for depth in range(min(shallow, width // 8)):
        if len(active) < 2:
            break
        mine, of, value = order[active], group[active], words[order[active], depth].astype(np.uint64)
        by = np.lexsort((value, of))
        order[active], of, value = mine[by], of[by], value[by]
        new = np.r_[True, (of[1:] != of[:-1]) | (value[1:] != value[:-1])]
        starts = np.flatnonzero(new)
        group[active] = active[starts][np.cumsum(new) - 1]
        sizes = np.diff(np.r_[starts, len(active)])
        active = active[np.repeat(sizes > 1, sizes)]
    if len(active):
        data, skip = rows.tobytes(), min(8 * shallow, width)
        cuts = np.flatnonzero(np.r_[True, np.diff(group[active]) != 0, True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = active[a]
            mine = order[at : at + b - a].tolist()
            if skip == width:
                classes = [list(range(len(mine)))]
            else:
                classes = blind_trie([data[i * width + skip : (i + 1) * width] for i in mine])
            done = at
            for numbers in classes:
                same = [mine[x] for x in numbers]
                order[done : done + len(same)] = same
                first[same[1:]] = False
                done += len(same)
    return order, first


# ---- anchors


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x)
    table = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    table[:n] = x
    table = table.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, hash, least, most) of the anchors of documents put end to end.

    The anchor of a LENGTH-byte string is the first of its GRAM-byte grams with the least hash, so equal
    strings have equal anchors at equal distances. least to most: the distances from the starts of the
    strings that have this anchor."""
    n = len(text)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < LENGTH:
        return none
    eight = np.empty(n - 7, np.uint64)
    for o in range(min(8, n - 7)):
        count = (n - o) // 8
        eight[o::8] = np.frombuffer(text, "<u8", count=count, offset=o)
    m = n - GRAM + 1
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, GRAM, 8):
            h = (h ^ eight[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    h = mix(h)
    least = _window_min((h & ~_WIDE) | np.arange(m, dtype=np.uint64), LENGTH - GRAM + 1) & _WIDE
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(least)]
    start = np.flatnonzero(np.arange(LENGTH, LENGTH + len(least)) <= ends)
    if not len(start):
        return none
    place = least[start].astype(np.int64)
    runs = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[runs[1:], len(place)] - 1
    place = place[runs]
    return place, h[place], place - start[last], place - start[runs]


#: Bytes of a context's row: anchor hash, distances, and the bytes around the anchor.
_HEAD = 10
_ROW = -(-(_HEAD + _LEFT + LENGTH) // 8) * 8


def contexts(text: bytes, place: np.ndarray, h: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A row for each anchor: its hash, the distances of its strings, and the bytes that these cover, zero beyond."""
    x = np.zeros(len(text) + _LEFT + LENGTH, np.uint8)
    x[_LEFT : _LEFT + len(text)] = np.frombuffer(text, np.uint8)
    rows = np.zeros((len(place), _ROW), np.uint8)
    rows[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8], rows[:, 9] = least, most
    body = rows[:, _HEAD : _HEAD + _LEFT + LENGTH]
    body[:] = np.lib.stride_tricks.sliding_window_view(x, _LEFT + LENGTH)[place]
    column = np.arange(_LEFT + LENGTH, dtype=np.int16)
    body *= (column >= (_LEFT - most)[:, None].astype(np.int16)) & (column < (_LEFT - least + LENGTH)[:, None].astype(np.int16))
    return rows


def _pieces(text: bytes, sizes: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(first document, bytes, sizes) of about _PIECE bytes each, documents whole."""
    first = at = 0
    while first < len(sizes):
        last, size = first, 0
        while last < len(sizes) and (size < _PIECE or last == first):
            size += int(sizes[last])
            last += 1
        yield first, text[at : at + size], sizes[first:last]
        first, at = last, at + size


# ---- over a corpus

_TEXT, _HASHES, _SPANS = 9, 1, 2
_CELLS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
CELLS = "kind int, block long, shard int, a binary, b binary"


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = mix(keys) % np.uint64(shards)
    for s in np.unique(shard).tolist():
        yield s, np.flatnonzero(shard == s)


def _chunks(shards: int):
    """Texts in chunks, in the order of doc_id, and each chunk's distinct anchor hashes by shard."""

    def cells(block: int, docs: list[tuple]) -> Iterator[tuple]:
        docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
        text, sizes = b"".join(t for _, t in docs), np.array([len(t) for _, t in docs], np.int64)
        meta = np.array([i or 0 for i, _ in docs], np.int64).tobytes() + sizes.tobytes() + np.array([i is None for i, _ in docs], np.uint8).tobytes()
        yield _TEXT, block, 0, squeeze(text, 6), squeeze(meta)
        found = [anchors(piece, own)[1] for _, piece, own in _pieces(text, sizes)]
        keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        for s, mine in _by_shard(keys, shards):
            yield _HASHES, block, s, pack_sorted(keys[mine]), np.packbits(n[mine] > 1).tobytes()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((doc_id, text.as_buffer().to_pybytes()))
                size += len(held[-1][1])
                if size >= CHUNK:
                    for cell in cells(block, held):
                        yield batch(_CELLS, [cell])
                    block, held, size = block + 1, [], 0
        if held:
            for cell in cells(block, held):
                yield batch(_CELLS, [cell])

    return read


def _find_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of a chunk's anchor hashes come twice or more in the corpus, as bits in the order of the hashes."""
    for shard, rows in groups(batches, "shard"):
        blocks, keys, twice = [], [], []
        for _, block, a, b in rows:
            k = unpack_sorted(a)
            blocks.append(block)
            keys.append(k)
            twice.append(np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(bool))
        every = np.sort(np.concatenate(keys))
        again = np.union1d(every[1:][every[1:] == every[:-1]], np.concatenate([k[t] for k, t in zip(keys, twice, strict=True)]))
        for block, k in zip(blocks, keys, strict=True):
            at = np.minimum(np.searchsorted(again, k), max(0, len(again) - 1))
            bits = again[at] == k if len(again) else np.zeros(len(k), bool)
            yield batch(_CELLS, [(_HASHES, block, shard, np.packbits(bits).tobytes(), b"")])


_ORDER = np.dtype([("none", "u1"), ("doc_id", "<i8"), ("block", "<i8"), ("doc", "<i4"), ("at", "<i8"), ("least", "u1"), ("most", "u1")])
_SPAN = np.dtype([("doc", "<i4"), ("start", "<i8"), ("end", "<i8")])


def _spans(where: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """What strings at distances least to most from their anchors cover."""
    out = np.empty(len(where), _SPAN)
    out["doc"], out["start"], out["end"] = where["doc"], where["at"] - most, where["at"] - least + LENGTH
    return out


def _send_contexts(shards: int):
    """From a chunk's bits, then its text: contexts of its repeated anchors, each distinct one once, by shard; the others' spans."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groups(batches, "block"):
            bits = {}
            for kind, _, shard, a, b in rows:
                if kind == _HASHES:
                    bits[shard] = np.frombuffer(a, np.uint8)
                    continue
                text, meta = expand(a), expand(b)
                many = len(meta) // 17
                ids, sizes = np.frombuffer(meta[: 8 * many], np.int64), np.frombuffer(meta[8 * many : 16 * many], np.int64)
                null = np.frombuffer(meta[16 * many :], np.uint8)
                found = [(first, piece, own, anchors(piece, own)) for first, piece, own in _pieces(text, sizes)]
                keys = np.unique(np.concatenate([f[3][1] for f in found]) if found else np.zeros(0, np.uint64))
                again = np.zeros(len(keys), bool)
                for s, mine in _by_shard(keys, shards):
                    again[mine] = np.unpackbits(bits[s], count=len(mine)).astype(bool)
                keys = keys[again]
                matrix, order = [np.zeros((0, _ROW), np.uint8)], [np.zeros(0, _ORDER)]
                for first, piece, own, (place, h, least, most) in found:
                    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                    use = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                    place, h, least, most = (x[use] for x in (place, h, least, most))
                    matrix.append(contexts(piece, place, h, least, most))
                    ends = np.cumsum(own)
                    doc = np.searchsorted(ends, place, "right")
                    o = np.empty(len(place), _ORDER)
                    o["doc"], o["at"], o["least"], o["most"], o["block"] = doc + first, place - (ends - own)[doc], least, most, block
                    o["doc_id"], o["none"] = ids[o["doc"]], null[o["doc"]]
                    order.append(o)
                rows_, where = np.concatenate(matrix), np.concatenate(order)
                _, new = deep_shallow(rows_)
                gone = where[~new]
                yield batch(_CELLS, [(_SPANS, block, block % shards, _spans(gone, gone["least"], gone["most"]).tobytes(), b"")])
                rows_, where = rows_[new], where[new]
                for s, mine in _by_shard(rows_[:, :8].copy().view(">u8").ravel().astype(np.uint64), shards):
                    yield batch(_CELLS, [(_HASHES, block, s, squeeze(rows_[mine].tobytes()), squeeze(where[mine].tobytes()))])

    return read


#: Contexts whose strings are sorted together; an anchor with more has them sorted one distance at a time.
_TOGETHER = 6_000


def _strings_again(rows: np.ndarray, row: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Which of the strings (row, distance), in the order of the corpus within a distance, come before in the list too."""
    table = np.zeros((len(row), 112), np.uint8)
    table[:, :8] = rows[row, :8]
    table[:, 8] = dist
    for d in np.unique(dist).tolist():
        of = slice(*np.searchsorted(dist, [d, d + 1]))
        table[of, 9 : 9 + LENGTH] = rows[row[of], _HEAD + _LEFT - d : _HEAD + _LEFT - d + LENGTH]
    return ~deep_shallow(table)[1]


def repeated_windows(rows: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings that start earlier too among distinct contexts of equal anchors, as (row, distance) in any order.

    rows are in the order of the corpus. Only anchors that have several contexts are looked at, each string of
    theirs as a row of anchor, distance and bytes; strings at different distances have no need to meet."""
    h = rows[:, :8].copy().view(">u8").ravel()
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    mine = np.flatnonzero(n[back] > 1)
    mine = mine[np.argsort(back[mine], kind="stable")]
    out_row, out_dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(back[mine]) != 0]) if len(mine) else np.zeros(0, np.int64), len(mine)]
    least, most = where["least"].astype(np.int64), where["most"].astype(np.int64)
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + _TOGETHER, "right")) - 1)
        part = mine[cuts[a] : cuts[b]]
        a = b
        if len(part) > _TOGETHER:
            for d in range(int(least[part].min()), int(most[part].max()) + 1):
                row = part[(least[part] <= d) & (d <= most[part])]
                again = row[_strings_again(rows, row, np.full(len(row), d))] if len(row) > 1 else row[:0]
                out_row.append(again)
                out_dist.append(np.full(len(again), d))
            continue
        many = most[part] - least[part] + 1
        row = np.repeat(part, many)
        dist = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(least[part], many)
        by = np.lexsort((row, dist))
        row, dist = row[by], dist[by]
        again = _strings_again(rows, row, dist)
        out_row.append(row[again])
        out_dist.append(dist[again])
    return np.concatenate(out_row), np.concatenate(out_dist)


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans that go, by chunk, from all contexts of a shard's anchors."""
    for shard, cells in groups(batches, "shard"):
        matrix, order = [], []
        for kind, block, _, a, b in cells:
            if kind == _SPANS:
                yield batch(_CELLS, [(_SPANS, block, shard, a, b"")])
                continue
            matrix.append(np.frombuffer(expand(a), np.uint8).reshape(-1, _ROW))
            order.append(np.frombuffer(expand(b), _ORDER))
        if not matrix:
            continue
        rows, where = np.concatenate(matrix), np.concatenate(order)
        by = np.lexsort((where["at"], where["doc"], where["block"], where["doc_id"], where["none"]))
        rows, where = rows[by], where[by]
        _, new = deep_shallow(rows)
        gone = where[~new]
        rows, where = rows[new], where[new]
        row, dist = repeated_windows(rows, where)
        parts = [(gone["block"], _spans(gone, gone["least"], gone["most"])), (where["block"][row], _spans(where[row], dist, dist))]
        blocks, spans = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        for block in np.unique(blocks).tolist():
            yield batch(_CELLS, [(_SPANS, block, shard, spans[blocks == block].tobytes(), b"")])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(with_text: bool):
    """From a chunk's spans, then its text: a row per document with what is kept, or its SHA-256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "block"):
            spans = [np.zeros(0, _SPAN)]
            for kind, _, _, a, b in rows:
                if kind == _SPANS:
                    spans.append(np.frombuffer(a, _SPAN))
                    continue
                text, meta = expand(a), expand(b)
                many = len(meta) // 17
                ids, sizes = np.frombuffer(meta[: 8 * many], np.int64), np.frombuffer(meta[8 * many : 16 * many], np.int64)
                null = np.frombuffer(meta[16 * many :], np.uint8)
                span = np.concatenate(spans)
                span = span[np.argsort(span["doc"], kind="stable")]
                for first, piece, own in _pieces(text, sizes):
                    mine = span[slice(*np.searchsorted(span["doc"], [first, first + len(own)]))]
                    ends_at = np.cumsum(own)
                    starts = ends_at - own
                    base = starts[mine["doc"] - first]
                    edge = np.bincount(base + mine["start"], minlength=len(piece) + 1) - np.bincount(base + mine["end"], minlength=len(piece) + 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    upto = np.r_[0, np.cumsum(gone)]
                    removed = upto[ends_at] - upto[starts]
                    opens = gone.copy()
                    opens[1:] &= ~gone[:-1]
                    real = starts[own > 0]
                    opens[real] = gone[real]
                    opened = np.r_[0, np.cumsum(opens)]
                    n_spans = opened[ends_at] - opened[starts]
                    left = np.frombuffer(piece, np.uint8)[~gone].tobytes()
                    kept_at = starts - upto[starts]
                    out = []
                    for i in range(len(own)):
                        a, b = int(kept_at[i]), int(kept_at[i] + own[i] - removed[i])
                        kept = left[a:b] if with_text else hashlib.sha256(left[a:b]).digest()
                        out.append((None if null[first + i] else int(ids[first + i]), int(own[i]), int(removed[i]), int(n_spans[i]), kept))
                    yield batch(schema, out)

    return read


def suffix_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text without its bytes that a LENGTH-byte string covers which starts earlier too.

    Needs doc_id and text; texts are UTF-8 bytes, null is empty. Earlier means a smaller doc_id (null last; rows
    of equal doc_id in the order they were read) or an earlier place in the same text. Strings never cross
    texts and are judged on the input. kept is the text that is left, or its SHA-256 without with_text.
    Repeated rows are documents of their own; other columns are not read. No documents give no rows. A very long text is cut into
    pieces that overlap by a string, and put together again by one task.

    Suffixes are dealt by the anchor of their first LENGTH bytes, so that equal ones meet. Anchors whose hash
    comes once are left out before any text moves. A chunk sorts its own contexts first and sends each distinct
    one once; a shard sorts what it gets, and then, where an anchor has several contexts, their strings."""
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("text"))
    total = raw.agg(F.sum(F.octet_length("text"))).first()[0]
    if total is None:
        return spark.createDataFrame([], RESULT)
    shards = max(4, int(total) // CHUNK)
    with arrow_rows(spark, 500):
        raw.mapInArrow(_chunks(shards), CELLS).write.partitionBy("kind").parquet(ws.path("cells"))
    with arrow_rows(spark, 4):
        cells = spark.read.schema(CELLS).parquet(ws.path("cells")).select("kind", "block", "shard", "a", "b")
        texts = cells.where(F.col("kind") == _TEXT)
        hashes = cells.where(F.col("kind") == _HASHES).select("shard", "block", "a", "b").repartition("shard").sortWithinPartitions("shard")
        bits = ws.stage(hashes.mapInArrow(_find_repeated, CELLS), "bits")
        ws.drop("cells/kind=1")
        chunks = texts.unionByName(bits).repartition("block").sortWithinPartitions("block", "kind")
        sent = chunks.mapInArrow(_send_contexts(shards), CELLS).repartition("shard").sortWithinPartitions("shard")
        spans = ws.stage(sent.mapInArrow(_sort_contexts, CELLS), "spans")
        result = texts.unionByName(spans).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_cut(with_text), RESULT)
        result = ws.stage(result, "result")
    ws.drop("cells", "bits", "spans")
    return result


def op6_suffix_dedup(spark, sf_dir):
    """All documents."""
    found = suffix_dedup(load(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


#: Each 100-byte string as hexadecimal digits, for small tables.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
w AS (SELECT r, unnest(range(n - {LENGTH - 1})) AS i, h FROM n WHERE n >= {LENGTH}),
k AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS s FROM w),
f AS (SELECT s, min(r * 4294967296 + i) AS first, count(*) AS c FROM k GROUP BY s HAVING count(*) > 1),
g AS (SELECT r, i FROM k JOIN f USING (s) WHERE r * 4294967296 + i <> first),
m AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM g),
j AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM m),
p AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM j GROUP BY r, span),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM p),
t AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN t USING (r)"""
