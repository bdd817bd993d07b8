"""Context-tree weighting over bytes: Krichevsky-Trofimov estimates of all depths, mixed along each context."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import add_up, batch, expand, groups, pack_array, pack_sorted, squeeze, unpack_array, unpack_sorted
from .jaccard import mix
from .shared import Workspace, arrow_rows, load, text_or_empty

#: Bytes of context. A gram is a context, nearest byte first, and the byte that follows: 8 * (DEPTH + 1) bits.
DEPTH = 5
FOLDS, HELD = 5, 1
#: Bytes of text whose distinct grams travel together.
CHUNK = 16 << 20
_PIECE = 4 << 20
_END = b"\n"


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def canonical(words: list[bytes]) -> bytes:
    """Words with a space between and an end: as much as the tokens say, and no more."""
    return b" ".join(words) + _END


def gram_keys(texts: bytes) -> np.ndarray:
    """The gram at each byte of texts that each end with the end byte; a text's context begins with ends."""
    x = np.frombuffer(_END * DEPTH + texts, np.uint8)
    n = len(texts)
    keys = x[DEPTH:].astype(np.uint64)
    since = np.arange(n)
    starts = np.r_[0, np.flatnonzero(x[DEPTH:-1] == _END[0]) + 1]
    since -= np.repeat(starts, np.diff(np.r_[starts, n]))
    for back in range(1, DEPTH + 1):
        byte = x[DEPTH - back : DEPTH - back + n]
        byte = np.where(since >= back, byte, _END[0])
        keys |= byte.astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back))
    return keys


# ---- the model, from distinct sorted grams and how often each comes in the training texts

_TABLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, 1 << 16) + 0.5))])


def _log_half(n: np.ndarray) -> np.ndarray:
    """log of (1/2)(3/2)...(n-1/2)."""
    big = n > 1 << 16
    out = _TABLE[np.where(big, 0, n)]
    if big.any():
        z = n[big] + 0.5
        out[big] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) - 0.5 * math.log(math.pi)
    return out


def _log_factorial(n: np.ndarray) -> np.ndarray:
    z = n + 1.0
    small = np.array([math.lgamma(i + 1.0) for i in range(256)])
    zz = np.maximum(z, 16.0)
    stirling = (zz - 0.5) * np.log(zz) - zz + 0.5 * math.log(2 * math.pi) + 1 / (12 * zz) - 1 / (360 * zz**3)
    return np.where(n < 256, small[np.minimum(n, 255)], stirling)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _log_half(n0) + _log_half(n1) - _log_factorial(n0 + n1)


def _own_weight(log_own: np.ndarray, log_children: np.ndarray) -> np.ndarray:
    """The share of a node's own estimate in its mixture with its children."""
    return 1.0 / (1.0 + np.exp(np.clip(log_children - log_own, -700, 700)))


class Level:
    """Nodes of one depth: a node is a context and the first k bits of the next byte."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.node, self.start, self.n0, self.n1 = grams, [], [], [], []
        for k in range(8):
            ids = grams >> np.uint64(8 - k)
            new = np.r_[True, ids[1:] != ids[:-1]]
            starts = np.flatnonzero(new)
            ones = np.add.reduceat(np.where((grams >> np.uint64(7 - k)) & np.uint64(1), counts, 0), starts)
            self.node.append(np.cumsum(new) - 1)
            self.start.append(starts)
            self.n1.append(ones)
            self.n0.append(np.add.reduceat(counts, starts) - ones)


class Tree:
    """Depths DEPTH to 2 of the tree for whole subtrees of nearest two bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.levels: dict[int, Level] = {DEPTH: Level(keys, counts)}
        self.up: dict[int, np.ndarray] = {}
        grams = keys
        for d in range(DEPTH - 1, 1, -1):
            # the context loses its farthest byte, which is next to the symbol
            shorter = (grams >> np.uint64(16) << np.uint64(8)) | (grams & np.uint64(255))
            grams, back = np.unique(shorter, return_inverse=True)
            counts = np.bincount(back, weights=counts, minlength=len(grams)).astype(np.int64)
            self.up[d + 1] = back
            self.levels[d] = Level(grams, counts)
        self.weight: dict[int, list[np.ndarray]] = {}
        log_w = [log_kt(a, b) for a, b in zip(self.levels[DEPTH].n0, self.levels[DEPTH].n1, strict=True)]
        for d in range(DEPTH - 1, 1, -1):
            here, below = self.levels[d], self.levels[d + 1]
            self.weight[d], mixed = [], []
            for k in range(8):
                parent = here.node[k][self.up[d + 1][below.start[k]]]
                children = np.bincount(parent, weights=log_w[k], minlength=len(here.start[k]))
                own = log_kt(here.n0[k], here.n1[k])
                self.weight[d].append(_own_weight(own, children))
                seen = here.n0[k] + here.n1[k] > 0
                mixed.append(np.where(seen, np.logaddexp(own, children) - math.log(2), 0.0))
            log_w = mixed
        self.log_w = log_w

    def tops(self) -> tuple[np.ndarray, ...]:
        """(nearest byte, bit node 1..255, n0, n1, sum of log weights) of the depth-2 nodes, summed."""
        level = self.levels[2]
        parts = []
        for k in range(8):
            g = level.grams[level.start[k]]
            near = (g >> np.uint64(16)).astype(np.int64)
            node = (1 << k) | ((g & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)
            parts.append((near * 256 + node, level.n0[k], level.n1[k], self.log_w[k]))
        at, n0, n1, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        sums = [np.bincount(at, weights=v, minlength=65536) for v in (n0, n1, s)]
        there = np.flatnonzero(np.bincount(at, minlength=65536))
        return there >> 8, there & 255, sums[0][there].astype(np.int64), sums[1][there].astype(np.int64), sums[2][there]

    def log10_probability(self, top: Top) -> np.ndarray:
        """Of each gram's last byte after its context, mixed over all depths."""
        out = np.zeros(len(self.keys))
        near = (self.keys >> np.uint64(8 * DEPTH)).astype(np.int64)
        symbol = (self.keys & np.uint64(255)).astype(np.int64)
        for k in range(8):
            one = (symbol >> (7 - k)) & 1
            at, p, seen = np.arange(len(self.keys)), None, None
            path = {DEPTH: at}
            for d in range(DEPTH - 1, 1, -1):
                path[d] = self.up[d + 1][path[d + 1]]
            for d in range(DEPTH, 1, -1):
                level, node = self.levels[d], self.levels[d].node[k][path[d]]
                n0, n1 = level.n0[k][node], level.n1[k][node]
                kt = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1.0)
                if p is None:
                    p = kt
                else:
                    w = self.weight[d][k][node]
                    p = np.where(seen, w * kt + (1 - w) * p, kt)
                seen = n0 + n1 > 0
            out += np.log10(top.finish(near, (1 << k) | (symbol >> (8 - k)), one, p, seen))
        return out


class Top:
    """Depths 1 and 0: 256 contexts of one byte and the empty one, of 255 bit nodes each."""

    def __init__(self, near, node, n0, n1, log_children):
        c0, c1, s = (np.zeros((256, 256)) for _ in range(3))
        c0[near, node], c1[near, node], s[near, node] = n0, n1, log_children
        c0, c1 = c0.astype(np.int64), c1.astype(np.int64)
        own = log_kt(c0, c1)
        w1 = _own_weight(own, s)
        mixed = np.where(c0 + c1 > 0, np.logaddexp(own, s) - math.log(2), 0.0)
        a0, a1 = c0.sum(0), c1.sum(0)
        self.n, self.w1, self.w0 = (c0, c1), w1, _own_weight(log_kt(a0, a1), mixed.sum(0))
        self.a = (a0, a1)

    def finish(self, near, node, one, p, seen):
        c0, c1 = self.n[0][near, node], self.n[1][near, node]
        kt = (np.where(one, c1, c0) + 0.5) / (c0 + c1 + 1.0)
        w = self.w1[near, node]
        p = np.where(seen, w * kt + (1 - w) * p, kt)
        a0, a1 = self.a[0][node], self.a[1][node]
        kt = (np.where(one, a1, a0) + 0.5) / (a0 + a1 + 1.0)
        w = self.w0[node]
        return np.where(c0 + c1 > 0, w * kt + (1 - w) * p, kt)


class Lookup:
    """Values of sorted distinct keys by hashing, a table for each round of collisions."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.tables = keys, values, []
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            table = np.zeros(1 << self.bits, np.int32)
            slot = self._slot(keys[left], len(self.tables))
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]

    def _slot(self, keys: np.ndarray, turn: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)) >> np.uint64(64 - self.bits)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.tables[0][self._slot(keys, 0)]
        for turn in range(1, len(self.tables)):
            wrong = np.flatnonzero(self.keys[at] != keys)
            if not len(wrong):
                break
            at[wrong] = self.tables[turn][self._slot(keys[wrong], turn)]
        return self.values[at]


# ---- over a corpus

_TEXT, _GRAMS, _WORDS = 9, 1, 2
CELLS = "kind int, block long, shard int, a binary, b binary"
_CELLS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about _PIECE bytes each."""
    first = 0
    while first < len(sizes):
        last, size = first, 0
        while last < len(sizes) and (size < _PIECE or last == first):
            size += int(sizes[last])
            last += 1
        yield first, last
        first = last


def _chunk_grams(texts: list[bytes], held: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A chunk's distinct grams, their counts in training texts, and the places of each shard's among them."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for first, last in _pieces(np.array([len(t) for t in texts], np.int64)):
        for test in (0, 1):
            if own := b"".join(t for t, h in zip(texts[first:last], held[first:last], strict=True) if h == test):
                keys, n = np.unique(gram_keys(own), return_counts=True)
                parts.append((keys, n * (1 - test)))
    keys, n = add_up(parts)
    return keys, n, _split(mix(keys) % np.uint64(shards), shards)


def _chunk_words(texts: list[bytes], held: np.ndarray, shards: int) -> tuple[list[bytes], Counter, list[np.ndarray]]:
    """A chunk's distinct words in order, their counts in training texts, and the places of each shard's among them."""
    words, trained = set(), Counter()
    for text, test in zip(texts, held, strict=True):
        words.update(text.split()) if test else trained.update(text.split())
    every = sorted(words | trained.keys())
    shard = np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in every), np.int64, len(every))
    return every, trained, _split(shard, shards)


def _split(shard: np.ndarray, shards: int) -> list[np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def _chunks(shards: int):
    """A mapInArrow function from (doc_id, text as bytes) to CELLS: texts in chunks, and each chunk's distinct grams and words by shard."""

    def cells(block: int, docs: list[tuple]) -> Iterator[tuple]:
        texts, ids = [canonical(tokens) for _, tokens in docs], [i for i, _ in docs]
        held = np.array([held_out(i) for i in ids], np.uint8)
        meta = [np.array([i or 0 for i in ids], np.int64), np.array([len(t) for t in texts], np.int64), np.array([i is None for i in ids], np.uint8), held]
        yield _TEXT, block, 0, squeeze(b"".join(texts), 6), squeeze(b"".join(x.tobytes() for x in meta))
        keys, n, places = _chunk_grams(texts, held, shards)
        for s, mine in enumerate(places):
            if len(mine):
                yield _GRAMS, block, s, pack_sorted(keys[mine]), pack_array(n[mine].astype(np.uint32))
        words, trained, places = _chunk_words(texts, held, shards)
        for s, mine in enumerate(places):
            if len(mine):
                own = [words[i] for i in mine.tolist()]
                yield _WORDS, block, s, squeeze(_END.join(own)), pack_array(np.fromiter(map(trained.__getitem__, own), np.uint32, len(own)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tokens = text.as_buffer().to_pybytes().lower().split()
                held.append((doc_id, tokens))
                size += len(text.as_buffer())
                if size >= CHUNK:
                    for cell in cells(block, held):
                        yield batch(_CELLS, [cell])
                    block, held, size = block + 1, [], 0
        if held:
            for cell in cells(block, held):
                yield batch(_CELLS, [cell])

    return read


_DISTINCT = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _combine_grams(parts: int):
    """All chunks' counts of a shard's grams added up, dealt again by the two nearest bytes of context."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groups(batches, "shard"):
            total: list[tuple] = []
            fresh: list[tuple] = []
            for _, a, b in rows:
                fresh.append((unpack_sorted(a), unpack_array(b, np.uint32).astype(np.int64)))
                if len(fresh) == 64:
                    total, fresh = [add_up(total + fresh)], []
            keys, counts = add_up(total + fresh)
            part = mix(keys >> np.uint64(8 * (DEPTH - 1))) % np.uint64(parts)
            for p in np.unique(part).tolist():
                mine = part == p
                yield batch(_DISTINCT, [(p, shard, pack_sorted(keys[mine]), pack_array(counts[mine]))])

    return read


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Tree, list[tuple[int, np.ndarray]]]]:
    for part, rows in groups(batches, "part"):
        cells = [(shard, unpack_sorted(k), unpack_array(c, np.int64)) for _, shard, k, c in rows]
        keys, counts = add_up([c[1:] for c in cells])
        yield part, Tree(keys, counts), [(shard, k) for shard, k, _ in cells]


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, tree, _ in _trees(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in tree.tops()], ["near", "node", "n0", "n1", "s"])


_SCORED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _score_grams(top: Top):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tree, cells in _trees(batches):
            scores = tree.log10_probability(top).astype(np.float32)
            for shard, keys in cells:
                yield batch(_SCORED, [(shard, -1, pack_sorted(keys), pack_array(scores[np.searchsorted(tree.keys, keys)]))])

    return read


def _return_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (shard, block), a shard's scores first: the scores of each chunk's grams."""
    for shard, rows in groups(batches, "shard"):
        scored, table = [], None
        for _, block, a, b in rows:
            if block < 0:
                scored.append((unpack_sorted(a), unpack_array(b, np.float32)))
                continue
            if table is None:
                keys, values = (np.concatenate([s[i] for s in scored]) for i in (0, 1))
                order = np.argsort(keys, kind="stable")
                table = keys[order], values[order]
            yield batch(_SCORED, [(shard, block, None, pack_array(table[1][np.searchsorted(table[0], unpack_sorted(a))]))])


_COUNTED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def _combine_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All chunks' counts of a shard's words added up, given back to each chunk; n and v of the shard once."""
    for shard, rows in groups(batches, "shard"):
        totals: Counter = Counter()
        chunks = []
        for _, block, a, b in rows:
            chunks.append((block, a))
            for w, c in zip(expand(a).split(_END), unpack_array(b, np.uint32).tolist(), strict=True):
                if c:
                    totals[w] += c
        n, v = sum(totals.values()), len(totals)
        for block, a in chunks:
            words = expand(a).split(_END)
            yield batch(_COUNTED, [(shard, block, None, pack_array(np.fromiter(map(totals.__getitem__, words), np.int64, len(words))), n, v)])
            n = v = 0


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_texts(shards: int, n: int, v: int, ends: int):
    """From what a chunk's grams and words count, then its text: a row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_base, end_known = float(base(np.array(float(ends)))), int(ends > 0)
        for _, rows in groups(batches, "block"):
            scores, counts = {}, {}
            for _, kind, shard, a, b in rows:
                if kind == _GRAMS:
                    scores[shard] = unpack_array(b, np.float32)
                    continue
                if kind == _WORDS:
                    counts[shard] = unpack_array(b, np.int64)
                    continue
                text, meta = expand(a), expand(b)
                many = len(meta) // 18
                ids, sizes = np.frombuffer(meta[: 8 * many], np.int64), np.frombuffer(meta[8 * many : 16 * many], np.int64)
                null, held = np.frombuffer(meta[16 * many : 17 * many], np.uint8), np.frombuffer(meta[17 * many :], np.uint8)
                ends_at = np.cumsum(sizes)
                texts = [text[end - size : end] for end, size in zip(ends_at.tolist(), sizes.tolist(), strict=True)]
                keys, _, places = _chunk_grams(texts, held, shards)
                values = np.zeros(len(keys), np.float32)
                for s, mine in enumerate(places):
                    values[mine] = scores.pop(s, ())
                table = Lookup(keys, values)
                words, _, places = _chunk_words(texts, held, shards)
                c = np.zeros(len(words), np.int64)
                for s, mine in enumerate(places):
                    c[mine] = counts.pop(s, ())
                known = dict(zip(words, c.tolist(), strict=True))
                for first, last in _pieces(sizes):
                    starts = np.cumsum(sizes[first:last]) - sizes[first:last]
                    sums = np.add.reduceat(table[gram_keys(b"".join(texts[first:last]))].astype(np.float64), starts)
                    out = []
                    for d in range(first, last):
                        own = texts[d].split()
                        c = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                        out.append((None if null[d] else int(ids[d]), bool(held[d]), len(own) + 1, int((c > 0).sum()) + end_known, n, float(base(c).sum()) + end_base, float(sums[d - first])))
                    yield batch(schema, out)

    return read


def context_tree_scores(docs: DataFrame) -> DataFrame:
    """One row per document: its log10 probability under the tree, and under counts of whole words. Needs doc_id and text.

    Texts are lower-cased (A-Z) and taken as words and an end; the tree learns from all texts outside the
    held-out fold and scores all. A null text is empty: one token, the end. A null doc_id is outside the fold;
    repeated rows count and are scored each. Other columns are not read. No documents give no rows.

    A chunk of texts sends each distinct gram and word once, with its count; shards add the counts up, so that
    a frequent gram costs a row per chunk at most. Subtrees of the nearest two bytes are mixed in one task
    each, from distinct grams; the two depths above have 256 * 255 nodes at most, which the driver holds.
    Paths end where the training texts have no longer context. A very long text is read whole by one task and may
    make several chunks. Shards follow the bytes of text; grams are dealt by their two nearest bytes, so the largest task grows
    with the most frequent pair."""
    spark = docs.sparkSession
    ws = Workspace(spark, "ctw")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("text"))
    total = raw.agg(F.sum(F.octet_length("text"))).first()[0]
    if total is None:
        return spark.createDataFrame([], RESULT)
    shards = max(4, int(total) // CHUNK)
    with arrow_rows(spark, 500):
        raw.mapInArrow(_chunks(shards), CELLS).write.partitionBy("kind").parquet(ws.path("cells"))
    cells = spark.read.schema(CELLS).parquet(ws.path("cells"))
    grams = cells.where(F.col("kind") == _GRAMS).select("shard", "block", "a", "b")
    words = cells.where(F.col("kind") == _WORDS).select("shard", "block", "a", "b")
    with arrow_rows(spark, 4):
        dealt = grams.select("shard", "a", "b").repartition("shard").sortWithinPartitions("shard")
        distinct = ws.stage(dealt.mapInArrow(_combine_grams(shards), "part int, shard int, keys binary, counts binary"), "distinct")
        by_part = distinct.repartition("part").sortWithinPartitions("part")
        tops = by_part.mapInArrow(_tops, "near long, node long, n0 long, n1 long, s double").groupBy("near", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "s")])
        found = tops.collect()  # 256 * 255 rows at most
        columns = [np.array([r[i] for r in found]) for i in range(5)]
        scored = ws.stage(by_part.mapInArrow(_score_grams(Top(*columns)), "shard int, block long, a binary, b binary"), "scored")
        back = scored.unionByName(grams).repartition("shard").sortWithinPartitions("shard", "block")
        known = ws.stage(back.mapInArrow(_return_grams, "shard int, block long, a binary, b binary"), "known")
        ws.drop("distinct", "scored", "cells/kind=1")
        counted = ws.stage(words.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(_combine_words, "shard int, block long, a binary, b binary, n long, v long"), "counted")
        ws.drop("cells/kind=2")
        key = F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.col("doc_id").cast("string"))
        ends = int(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.crc32(key.cast("binary")) % FOLDS != HELD).count())
        got = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        together = (
            cells.where(F.col("kind") == _TEXT).select("block", "kind", "shard", "a", "b")
            .unionByName(known.select("block", F.lit(_GRAMS).alias("kind"), "shard", "a", "b"))
            .unionByName(counted.select("block", F.lit(_WORDS).alias("kind"), "shard", "a", "b"))
        )
        dealt = together.repartition("block").sortWithinPartitions("block", "kind")
        result = ws.stage(dealt.mapInArrow(_score_texts(shards, int(got[0]) + ends, int(got[1]) + (ends > 0), ends), RESULT), "result")
    ws.drop("cells", "known", "counted")
    return result


def op1_context_tree(spark, sf_dir):
    """All documents scored."""
    return context_tree_scores(load(spark, sf_dir, "documents"))
