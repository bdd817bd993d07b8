"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, with bounds from sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import expand, pack_array, pack_sorted, squeeze, unpack_array, unpack_sorted
from .components import connected_components
from .exact_dedup import split, without
from .shared import Workspace, arrow_rows, fresh, load

#: Bytes of words that travel together, and bytes of words for each shard of the columns.
CHUNK, SHARD = 16 << 20, 32 << 20
#: Rows of a column that are multiplied with each other in one task; larger columns are cut into tiles of so many by so many.
TILE = 1000
_REMEMBERED, _AT_ONCE = 100_000, 20_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(self.words) > _REMEMBERED:
            self.words = {}
        known = self.words
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = max(1, min(self.n, len(words)))
        count = len(words) - size + 1 if words else 0
        got = np.full(count, size, np.uint64)
        for at in range(size):
            got = mix(got * _M1 + h[at : at + count])
        return np.unique(got)


def overlap_bound(percent: int, a, b):
    """The least overlap of two linked sets of a and b n-grams: overlap / (a + b - overlap) must come to percent."""
    return -(-percent * (a + b) // (100 + percent))


def long_prefix(percent: int, n):
    """Of the columns of a set of n, in one order for all sets, so many hold the first that it shares with any linked set."""
    return n - -(-percent * n // 100) + 1


def short_prefix(percent: int, n):
    """The same where the other set is no smaller."""
    return n - overlap_bound(percent, n, n) + 1


def parity(grams: np.ndarray, bits: int = 1024) -> bytes:
    """The parity of the n-grams in each of some hash buckets: sets differ in at least as many n-grams as these bits."""
    return np.packbits((np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _words(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [_words(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        columns = [pa.array([len(w) for w in words], pa.int64()), pa.array([_digest(w) for w in words], pa.binary()), pa.array(words, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], ["row", "doc_id", "bytes", "digest", "words"])


# ---- the columns' numbers of rows


def _keys(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a column and 32 of its bits. Columns alike in both are counted as one: that only weakens a bound."""
    return (((grams >> np.uint64(40)) % np.uint64(shards)) << np.uint64(32)) | (grams & _LOW)


def _chunks(n: int, shards: int):
    """From rows (row, words): chunks of about CHUNK bytes. cells and counts have for each shard the chunk's distinct
    columns and in how many of its rows each is: a column that all rows have is sent once for a chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        rows, texts, total = [], [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate([_keys(shingle(t), shards) for t in texts]), return_counts=True)
            edges = np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))
            parts = list(zip(edges[:-1], edges[1:], strict=True))
            cells = [pack_sorted(keys[a:b] & _LOW) for a, b in parts]
            sizes = [pack_array(counts[a:b].astype(np.uint32)) for a, b in parts]
            columns = [pa.array([rows[0]]), pa.array([rows], pa.list_(pa.int64())), pa.array([squeeze(b"\n".join(texts))], pa.binary()), pa.array([cells], pa.list_(pa.binary())), pa.array([sizes], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "rows", "words", "cells", "counts"])

        for batch in batches:
            for row, words in zip(batch.column("row").to_pylist(), batch.column("words").to_pylist(), strict=True):
                rows.append(row)
                texts.append(words)
                total += len(words)
                if total >= CHUNK:
                    yield flush()
                    rows, texts, total = [], [], 0
        if rows:
            yield flush()

    return read


def _rank(counts: np.ndarray) -> np.ndarray:
    """0 for a column of one row, then one more for each doubling."""
    return (np.frexp(counts.astype(np.float64))[1] - 1).astype(np.uint8)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From cells (chunk, shard, cell, counts) sorted by shard: for each the rank of each of its columns."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        keys = [unpack_sorted(cell) for _, _, cell, _ in held]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        ranks = _rank(np.bincount(place, np.concatenate([unpack_array(c, np.uint32) for *_, c in held]), len(every)))[place]
        ends = np.cumsum([len(k) for k in keys])
        packed = [squeeze(ranks[e - len(k) : e].tobytes()) for k, e in zip(keys, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held]), pa.array([x[1] for x in held], pa.int32()), pa.array(packed, pa.binary())], ["chunk", "shard", "ranks"])

    now, held = None, []
    for batch in batches:
        for chunk, shard, cell, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != now and held:
                yield flush(held)
                held = []
            now = shard
            held.append((chunk, shard, cell, counts))
    if held:
        yield flush(held)


SETS = "row long, n int, alone int, columns binary, parity binary, grams binary"


def _sets(n: int, shards: int, percent: int):
    """From chunks with the ranks of their columns by shard: SETS, a row for each set.

    Columns that no other set has add to no overlap: sets that share fewer than they need link with nothing and get no
    columns. For the others alone is the number of columns of their own, columns the first of the rest by
    (rank, hash), as far as the longest prefix goes, and grams all of the rest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for rows, blob, ranks in zip(*(batch.column(c).to_pylist() for c in ("rows", "words", "ranks")), strict=True):
                sets = [shingle(t) for t in expand(blob).split(b"\n")]
                keys = np.concatenate([_keys(g, shards) for g in sets])
                by_shard = sorted((x["shard"], x["ranks"]) for x in ranks)
                rank = np.frombuffer(b"".join(expand(r) for _, r in by_shard), np.uint8)
                every = np.unique(keys)
                if len(every) != len(rank):
                    raise ValueError("the columns of a chunk have changed")
                own = rank[np.searchsorted(every, keys)].astype(np.uint64)
                out, at = [], 0
                for row, grams in zip(rows, sets, strict=True):
                    r, size = own[at : at + len(grams)], len(grams)
                    at += size
                    rest, r = grams[r > 0], r[r > 0]
                    first = long_prefix(percent, size) - (size - len(rest))
                    if first <= 0:
                        out.append((row, size, size - len(rest), None, None, None))
                        continue
                    order = np.argsort((r << np.uint64(58)) | (rest >> np.uint64(6)), kind="stable")
                    out.append((row, size, size - len(rest), rest[order[:first]].tobytes(), parity(grams), rest.tobytes()))
                types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["row", "n", "alone", "columns", "parity", "grams"])

    return read


# ---- the product


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An entry (col, row, n, at) for each of the first columns of a set; at is its place in the order of all its columns."""
    for batch in batches:
        blobs = batch.column("columns").to_pylist()
        counts = np.array([len(b) // 8 for b in blobs], np.int64)
        alone = batch.column("alone").to_numpy()
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - alone, counts)
        spread = lambda c: np.repeat(batch.column(c).to_numpy(), counts)  # noqa: E731, B023
        columns = [np.frombuffer(b"".join(blobs), np.int64), spread("row"), spread("n").astype(np.int32), at.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["col", "row", "n", "at"])


def _may_link(percent: int, nx, ax, ny, ay):
    """Whether sets of nx <= ny n-grams that share a column, at places ax and ay of their orders, can link through it."""
    fits = (ax < short_prefix(percent, nx)) & (ay < long_prefix(percent, ny)) & (100 * nx >= percent * ny)
    return fits & (1 + np.minimum(ax, ay) + np.minimum(nx - ax, ny - ay) - 1 >= overlap_bound(percent, nx, ny))


def _stars(percent: int):
    """From entries sorted by (col, n, row): those of columns with several rows, and with each the smallest set of the
    column that it may link with, or null.

    A column may go on over many batches: only its first row of each size within reach is held."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64)]
        waits = False  # the only row held has not been given out, as its column may have no other
        for batch in batches:
            mine = [batch.column(c).to_numpy().astype(np.int64) for c in ("col", "row", "n", "at")]
            if not len(mine[0]):
                continue
            if len(held[0]) and held[0][0] != mine[0][0]:
                held, waits = [h[:0] for h in held], False
            old = len(held[0])
            col, row, n, at = (np.r_[h, m] for h, m in zip(held, mine, strict=True))
            group = np.cumsum(np.r_[0, col[1:] != col[:-1]])
            rows_of = np.bincount(group)
            if old and not waits:
                rows_of[0] += 1
            place = (group << 32) | n
            head = np.flatnonzero(at < short_prefix(percent, n))
            to = np.searchsorted(place[head], (group << 32) | -(-percent * n // 100))
            first = head[np.minimum(to, max(0, len(head) - 1))] if len(head) else np.zeros(len(row), np.int64)
            linked = (to < len(head)) & (first < np.arange(len(row)))
            linked &= _may_link(percent, n[first], at[first], n, at)
            give = rows_of[group] > 1
            give[:old] &= waits
            out = [col[give], row[give], n[give].astype(np.int32), at[give].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(row[first][give], mask=~linked[give])], ["col", "row", "n", "at", "first"])
            last = np.flatnonzero(group == group[-1])
            waits = rows_of[-1] == 1
            last = last[100 * n[last] >= percent * n[-1]]
            # the first row of each size, and the first of those whose place is in the short prefix
            size_first = np.r_[True, n[last][1:] != n[last][:-1]] if len(last) else np.zeros(0, bool)
            heads = last[at[last] < short_prefix(percent, n[last])]
            head_first = heads[np.r_[True, n[heads][1:] != n[heads][:-1]]] if len(heads) else heads
            keep = np.union1d(last[size_first], head_first)
            held = [x[keep] for x in (col, row, n, at)]

    return read


PAIRS = "row long, first long, n int, first_n int, at int, first_at int"
_PAIRS = [c.split()[0] for c in PAIRS.split(", ")]


def _linkable(percent: int, i, j, comp, n, at, bits) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries numbered i and j, the set of j no larger, those that components, sizes, places and parities allow to link."""
    use = comp[i] != comp[j]
    i, j = i[use], j[use]
    use = _may_link(percent, n[j], at[j], n[i], at[i])
    i, j = i[use], j[use]
    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
    use = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])
    return i[use], j[use]


def _spanning(i, j, label) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what all pairs (i, j) connect; label, the component of each entry, is brought up to date."""
    picked: list[tuple[int, int]] = []
    while len(i):
        picked.append((i[0], j[0]))
        label[label == label[i[0]]] = label[j[0]]
        use = label[i] != label[j]
        i, j = i[use], j[use]
    return tuple(np.array(picked, np.int64).reshape(-1, 2).T)


def _pair_batch(i, j, row, n, at) -> pa.RecordBatch:
    columns = [row[i], row[j], n[i].astype(np.int32), n[j].astype(np.int32), at[i].astype(np.int32), at[j].astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], _PAIRS)


def _columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    bits = np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.uint64).reshape(len(batch), -1)
    return [*(batch.column(c).to_numpy().astype(np.int64) for c in ("col", "row", "comp", "n", "at")), bits]


def _chain(percent: int):
    """From entries sorted by (col, n, row): pairs of each with the one before it, and with the first of its column."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first entry of the last column and its last
        for batch in batches:
            if not len(batch):
                continue
            mine = _columns_of(batch)
            old = 0
            if held is not None and held[0][0] == mine[0][0]:
                mine, old = [np.concatenate([h, m]) for h, m in zip(held, mine, strict=True)], len(held[0])
            col, *rest = mine
            new = np.r_[True, col[1:] != col[:-1]]
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            i = np.flatnonzero(~new)
            i = i[i >= old]
            row, comp, n, at, bits = rest
            i, j = _linkable(percent, np.r_[i, i], np.r_[i - 1, start[i]], comp, n, at, bits)
            yield _pair_batch(i, j, row, n, at)
            held = [x[[start[-1], len(col) - 1]] for x in mine]

    return read


def _product(percent: int, spanning: bool):
    """From entries (col, ta, tb, side, ...) sorted by tile (col, ta, tb) and (n, row): the pairs of a tile, a count of one for each.

    A tile has at most about TILE rows of either side; one with ta = tb has both in one. spanning: of the pairs only those
    that a tile needs to connect what they connect, fewer than its rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            _, row, comp, n, at, bits = (np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True))
            side = np.concatenate([h[1] for h in held])
            every = np.arange(len(side))
            step = max(1, _AT_ONCE // len(side))
            for k in range(0, len(side), step):
                i, j = np.repeat(every[k : k + step], len(side)), np.tile(every, len(every[k : k + step]))
                use = (j < i) if now[1] == now[2] else (j < i) & (side[i] != side[j])
                i, j = _linkable(percent, i[use], j[use], comp, n, at, bits)
                if spanning:
                    i, j = _spanning(i, j, comp)
                if len(i):
                    yield _pair_batch(i, j, row, n, at)

        for batch in batches:
            if not len(batch):
                continue
            mine = _columns_of(batch)
            ta, tb, side = (batch.column(c).to_numpy() for c in ("ta", "tb", "side"))
            cuts = np.flatnonzero(np.r_[True, (mine[0][1:] != mine[0][:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(ta)], strict=True):
                key = (mine[0][a], ta[a], tb[a])
                if key != now:
                    yield from flush()
                    now, held = key, []
                held.append(([x[a:b] for x in mine], side[a:b]))
        yield from flush()

    return read


def _left_over(shared: DataFrame, comps: DataFrame, tried: DataFrame, sets: DataFrame, ws: Workspace, percent: int, turn: str) -> DataFrame | None:
    """Pairs (row, first) that share columns, lie in different components and have not been tried; None where there are none.

    The turns chain and spanning give only as many pairs as there are entries, to connect most of what can be connected
    before all of the rest is given. That product counts in how many columns a pair meets; with what may follow the last of them in the orders
    of both sets that is an upper bound of their overlap, and pairs below the bound of their sizes are discarded."""
    labelled = ws.stage(
        shared.select("col", "row", "n", "at").join(comps.select(F.col("node").alias("row"), "root"), "row", "left").select("col", "row", "n", "at", F.coalesce("root", "row").alias("comp")), f"{turn}-labelled"
    )
    sizes = labelled.groupBy("col").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
    mixed = ws.stage(sizes.where("lo < hi").select("col", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), f"{turn}-mixed")
    if mixed.isEmpty():
        return None
    rest = labelled.join(mixed, "col").join(sets.where("columns is not null").select("row", "parity"), "row")
    if turn == "chain":
        dealt = rest.select("col", "row", "comp", "n", "at", "parity").repartition("col").sortWithinPartitions("col", "n", "row")
    else:
        mine = F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")
        tiled = rest.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.select("col", F.least("mine", "other").alias("ta"), F.greatest("mine", "other").alias("tb"), F.col("mine").alias("side"), "row", "comp", "n", "at", "parity")
        dealt = tiled.repartition("col", "ta", "tb").sortWithinPartitions("col", "ta", "tb", "n", "row")
    with arrow_rows(dealt.sparkSession, 5000):
        pairs = dealt.mapInArrow(_chain(percent) if turn == "chain" else _product(percent, turn == "spanning"), PAIRS)
        met = pairs.groupBy("row", "first").agg(F.count("*").alias("met"), F.max(F.struct("at", "n")).alias("a"), F.max(F.struct("first_at", "first_n")).alias("b"))
        most = F.col("met") + F.least(F.col("a.n") - F.col("a.at"), F.col("b.first_n") - F.col("b.first_at")) - 1
        enough = F.lit(True) if turn != "all" else (100 + percent) * most >= percent * (F.col("a.n") + F.col("b.first_n"))
        more = ws.stage(met.where(enough).select("row", "first").join(tried, ["row", "first"], "left_anti"), f"{turn}-cross")
    return None if more.isEmpty() else more


def _overlaps(percent: int):
    """From rows (first, salt, member, row, n, grams) sorted so: pairs that link, with their overlap, added up over all shared columns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot, pivot_n = None, np.zeros(0, np.uint64), 0
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for first, salt, member, row, n, blob in zip(*(batch.column(c).to_pylist() for c in ("first", "salt", "member", "row", "n", "grams")), strict=True):
                grams = np.frombuffer(blob, np.uint64)
                if not member:
                    at, pivot, pivot_n = (first, salt), grams, n
                    continue
                if at != (first, salt):
                    raise ValueError(f"row {first} of the product is missing")
                place = np.minimum(np.searchsorted(pivot, grams), len(pivot) - 1)
                overlap = int((pivot[place] == grams).sum())
                if 100 * overlap >= percent * (n + pivot_n - overlap):
                    out.append((row, first, overlap))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "first", "overlap"])

    return read


def _verify(pairs: DataFrame, sets: DataFrame, ws: Workspace, name: str, percent: int, share: int = 500) -> DataFrame:
    """The pairs (row, first) that link. A first with many rows is dealt to groups of about share rows."""
    salts = ws.stage(pairs.groupBy("first").agg((F.count("*") / share).cast("int").alias("salts")), f"{name}-salts")
    members = pairs.join(salts, "first").select("first", F.pmod(F.xxhash64("row"), F.col("salts") + 1).cast("int").alias("salt"), F.lit(1).alias("member"), "row")
    firsts = salts.select("first", F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt"), F.lit(0).alias("member"), F.col("first").alias("row"))
    need = ws.stage(members.unionByName(firsts), f"{name}-need")
    full = need.join(sets.where("columns is not null").select("row", "n", "grams"), "row").select("first", "salt", "member", "row", "n", "grams")
    dealt = full.repartition("first", "salt").sortWithinPartitions("first", "salt", "member")
    return ws.stage(dealt.mapInArrow(_overlaps(percent), "row long, first long, overlap long"), name, batch_rows=500)


def _first_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows (row, digest, words) that stand for their class.

    A filter of the classes of several rows lets the rows of all others through where they are; only
    what it holds is joined with the classes."""
    alone, other = split(rows, F.col("digest"), classes.where("size > 1"), "digest")
    # an inner join, as a semi join would be pushed below the filter and shuffle all rows; there is one row for each rep
    return alone.unionByName(other.join(classes.select(F.col("rep").alias("row")), "row").select(*rows.columns))


def _count_columns(reps: DataFrame, ws: Workspace, n: int, percent: int, total: int) -> DataFrame:
    """SETS of the rows (row, words), by way of how many rows each column has."""
    shards = max(1, -(-total // SHARD))
    chunks = ws.stage(reps.select("row", "words").mapInArrow(_chunks(n, shards), "chunk long, rows array<long>, words binary, cells array<binary>, counts array<binary>"), "chunks", batch_rows=500)
    cells = chunks.select("chunk", F.posexplode(F.arrays_zip("cells", "counts")).alias("shard", "cell")).select("chunk", "shard", F.col("cell.cells").alias("cell"), F.col("cell.counts").alias("counts"))
    ranks = ws.stage(cells.repartition("shard").sortWithinPartitions("shard").mapInArrow(_frequencies, "chunk long, shard int, ranks binary"), "ranks", batch_rows=16)
    back = ranks.groupBy("chunk").agg(F.collect_list(F.struct("shard", "ranks")).alias("ranks"))
    found = ws.stage(chunks.select("chunk", "rows", "words").join(back, "chunk").select("rows", "words", "ranks").mapInArrow(_sets(n, shards, percent), SETS), "sets", batch_rows=1)
    ws.drop("chunks", "ranks")
    return found


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, stays, digest) of every document; needs doc_id and text.

    Documents link when 100 times the overlap of their sets of n-word shingles is at least percent times the
    union. A text of fewer words is one shingle, a text without words (or null) has none and links with
    nothing. component_id is the smallest doc_id reachable by links. Null identifiers come last; repeated rows
    count as documents. A very long text is one row of the matrix, read whole and held by one task at a time.
    No documents give no rows; other columns are not read. Shingles are compared by 64-bit hashes.

    Rows with equal words are one class and one row of the incidence matrix. Its columns are counted, in shards:
    those of one row go, with the rows that share too little to link, and the others are ordered from rare to
    frequent. The product runs over the first columns of each row, as many as a linked row cannot miss, column
    by column: at first of each row with the smallest of a column, and what the best of these links leave in different
    components then pair by pair, in tiles. stays marks one row of each component, that of its smallest doc_id."""
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    raw = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = ws.stage(raw.mapInArrow(_normalise, "row long, doc_id long, bytes long, digest binary, words binary"), "rows", batch_rows=500, compression="zstd")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = ws.stage(rows.where("bytes > 0").groupBy("digest").agg(F.min("row").alias("rep"), F.min(order).alias("least"), F.count("*").alias("size"), F.max("bytes").alias("bytes")), "classes")
    total = classes.agg(F.sum("bytes")).first()[0] or 0
    sets = _count_columns(_first_rows(rows.where("bytes > 0").select("row", "digest", "words"), classes), ws, n, percent, total)
    with arrow_rows(spark, 2000):
        entries = sets.where("columns is not null").select("row", "n", "alone", "columns").mapInArrow(_entries, "col long, row long, n int, at int")
        dealt = entries.repartition("col").sortWithinPartitions("col", "n", "row")
        shared = ws.stage(dealt.mapInArrow(_stars(percent), "col long, row long, n int, at int, first long"), "shared", batch_rows=20_000)
    met = shared.where("first is not null").groupBy("row", "first").agg(F.count("*").alias("met"))
    tried = ws.stage(met.groupBy("row").agg(F.max(F.struct("met", (-F.col("first")).alias("first"))).alias("best")).select("row", (-F.col("best.first")).alias("first")), "tried")
    links = _verify(tried, sets, ws, "links", percent)
    comps = connected_components(links.select(F.col("row").alias("a"), F.col("first").alias("b")), ws, "first-round")

    for turn in ("chain", "spanning", "all"):
        more = _left_over(shared, comps, tried, sets, ws, percent, turn)
        if more is not None:
            links = links.unionByName(_verify(more, sets, ws, f"{turn}-links", percent))
            comps = connected_components(links.select(F.col("row").alias("a"), F.col("first").alias("b")), ws, f"{turn}-round")
            tried = tried.unionByName(more)

    named = classes.join(comps.select(F.col("node").alias("rep"), "root"), "rep", "left").join(sets.select(F.col("row").alias("rep"), "n"), "rep")
    roots = ws.stage(named.select("digest", "n", "least", F.coalesce("root", "rep").alias("root")), "roots")
    best = ws.stage(roots.groupBy("root").agg(F.min("least").alias("least")), "best")
    best = best.select("root", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("stay_row"))
    named = ws.stage(roots.join(best, "root").select("digest", "n", "component_id", "stay_row"), "named")
    result = rows.select("row", "doc_id", "bytes", "digest").join(named, "digest", "left")
    alone = F.col("bytes") == 0
    final = ws.stage(
        result.select(
            "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            (alone | (F.col("stay_row") == F.col("row"))).alias("stays"), "digest",
        ),
        "result",
    )
    ws.drop(*(t for t in ws.tables if t != "result"))
    return final


def near_dedup(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of docs of which one stays for each component, with all their columns.

    Rows that go are found by (doc_id, words): rows equal in both are told apart only by which comes first. Null and
    empty texts link with nothing and all stay; very long texts, ties, repeated rows, other columns and empty tables are
    as in jaccard_components, and columns pass through whatever their names."""
    found = jaccard_components(docs, n, percent)
    ws = Workspace(docs.sparkSession, "near")
    alike = found.groupBy("doc_id", "digest").agg(F.max("stays").alias("stays"), F.count("*").alias("rows"), F.sum(F.col("stays").cast("int")).alias("stay_rows"))
    names = {c: fresh(docs, c) for c in ("gone_id", "gone_set", "own_set")}
    gone = ws.stage(alike.where("not stays").select(F.col("doc_id").alias(names["gone_id"]), F.col("digest").alias(names["gone_set"])), "gone")
    twice = alike.where("stays and rows > stay_rows").limit(1)
    clash = found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1)
    if clash.isEmpty():
        return without(docs, gone, "doc_id", names["gone_id"], F.col("doc_id").eqNullSafe(F.col(names["gone_id"])))
    # identifiers repeat: a row is known by its set as well
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("carried")
    keyed = docs.select(row, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind = keyed.schema["carried"].dataType.simpleString()

    def add_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_digest(_words(t.as_buffer().to_pybytes())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(sets, pa.binary())], ["carried", "own_set"])

    known = keyed.mapInArrow(add_set, f"carried {kind}, own_set binary")
    left = known.join(gone, F.col("carried.doc_id").eqNullSafe(F.col(names["gone_id"])) & (F.col("own_set") == F.col(names["gone_set"])), "left_anti")
    if not twice.isEmpty():
        empty = F.lit(_digest(b""))
        left = left.withColumn("doc_id", F.col("carried.doc_id"))
        left = left.where(F.col("own_set") == empty).unionByName(left.where(F.col("own_set") != empty).dropDuplicates(["doc_id", "own_set"]))
    return left.select(*[F.col("carried")[c].alias(c) for c in docs.columns])


def op10_ngram_jaccard(spark, sf_dir):
    """Every document with the size of its set and its component."""
    return jaccard_components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: By rarest-first prefixes, for small tables: pairs are verified by list intersection and closed by recursion.
ORACLE = rf"""
WITH RECURSIVE
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, r, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS g FROM d),
u AS MATERIALIZED (SELECT r, len(g) AS n, unnest(g) AS sh FROM s),
f AS (SELECT sh, count(*) AS df FROM u GROUP BY sh),
p AS (SELECT r, n, sh, row_number() OVER (PARTITION BY r ORDER BY df, sh) AS k FROM u JOIN f USING (sh)),
x AS MATERIALIZED (SELECT r, n, sh FROM p WHERE k <= n - (9 * n + 9) // 10 + 1),
c AS MATERIALIZED (SELECT DISTINCT a.r AS a, b.r AS b FROM x a JOIN x b USING (sh) WHERE a.r < b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
o AS MATERIALIZED (SELECT c.a, c.b, len(p.g) + len(q.g) AS n, len(list_intersect(p.g, q.g)) AS k FROM c JOIN s p ON p.r = c.a JOIN s q ON q.r = c.b),
e AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * k >= 90 * (n - k) UNION ALL SELECT b, a FROM o WHERE 100 * k >= 90 * (n - k)),
t(r, root) AS (SELECT r, r FROM s UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.r)
SELECT s.doc_id, len(s.g) AS n_shingles, min(m.doc_id) AS component_id FROM t JOIN s USING (r) JOIN s m ON m.r = t.root GROUP BY s.r, s.doc_id, len(s.g)"""
