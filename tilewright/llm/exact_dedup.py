"""Exact deduplication through a log-structured merge index of SHA-256 digests, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Workspace, fresh, load, text_or_empty

#: A filter has FILTER_BITS for each key, in rows of 4 KiB, and MOST_BITS at most (16 MiB), as it is broadcast.
FILTER_BITS, MOST_BITS = 16, 1 << 27
_BLOCK = 1 << 15
#: Batches that the rows are flushed in, and runs of a level that compaction merges into one of the next.
RUNS, FANOUT = 4, 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys."""
    bits = _BLOCK
    while bits < min(keys * FILTER_BITS, MOST_BITS):
        bits *= 2
    return bits


def bitmap_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A one-hash Bloom filter as rows (filter_bucket, filter_bits), of bits / 32768 rows at most."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.select(F.shiftright(h, 15).alias("filter_bucket"), (h % _BLOCK).alias("at")).groupBy("filter_bucket").agg(F.bitmap_construct_agg(F.col("at")).alias("filter_bits"))


def may_contain(key: Column, bits: int, column: str = "filter_bits") -> tuple[Column, Column]:
    """The bucket of a key, and whether the filter's row of that bucket has its bit."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    at = (h % _BLOCK).cast("int")
    byte = F.conv(F.hex(F.substr(F.col(column), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.shiftright(h, 15), F.lit(1) == F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1))


def split(rows: DataFrame, key: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(absent, perhaps): rows whose key is surely not in the column of keys, and all others, with rows' columns.

    A filter of the keys is broadcast, of a size that follows their number up to MOST_BITS. Beyond a key for each of
    those bits it would let everything pass: then there is none, and all rows are in perhaps. Filters only spare
    joins and shuffles, what they let pass is joined exactly. keys should be a written table, as it is counted first."""
    n = keys.count()
    if n > MOST_BITS:
        return rows.limit(0), rows
    bits = filter_bits(n)
    names = {c: fresh(rows, c) for c in ("filter_bucket", "filter_bits", "filter_key")}
    table = bitmap_filter(keys, column, bits).select(*[F.col(c).alias(names[c]) for c in ("filter_bucket", "filter_bits")])
    bucket, inside = may_contain(F.col(names["filter_key"]), bits, names["filter_bits"])
    marked = rows.withColumn(names["filter_key"], key).join(F.broadcast(table), (bucket == F.col(names["filter_bucket"])) & inside, "left")
    out, hit = [F.col(c) for c in rows.columns], F.col(names["filter_bits"])
    return marked.where(hit.isNull()).select(*out), marked.where(hit.isNotNull()).select(*out)


def text_key(column: str) -> Column:
    """An identifier as text, null as empty: for filters, where keys may be alike."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class DigestIndex:
    """Log-structured merge index digest -> (first, size) in the shared folder.

    flush() makes a run of level 0 of a batch of rows: each task sorts its share of the digests, as a memtable, and
    writes one entry for each. Whenever a level has FANOUT runs they are merged into one of the next level, which
    keeps the smallest identifier of a digest: filters are probed first, and entries that the other runs surely do not have
    are copied without a shuffle. lookup() finds the entries of rows likewise, a run at a time. Runs are
    immutable, so a lost task is simply run again."""

    def __init__(self, ws: Workspace):
        self.ws, self.levels, self.n = ws, [], 0

    def _write(self, entries: DataFrame) -> DataFrame:
        self.n += 1
        return self.ws.stage(entries.sortWithinPartitions("digest"), f"run-{self.n}")

    def _add(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._add(merged, level + 1)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        alone, shared = [], []
        for i, run in enumerate(runs):
            rest = None
            for j, other in enumerate(runs):
                if i != j:
                    run, some = split(run, F.col("digest"), other, "digest")
                    rest = some if rest is None else rest.unionByName(some)
            alone.append(run)
            shared += [rest] if rest is not None else []
        if not shared:
            return runs[0]
        both = shared[0]
        for part in shared[1:]:
            both = both.unionByName(part)
        merged = both.groupBy("digest").agg(F.min("first").alias("first"), F.sum("size").alias("size"))
        for part in alone:
            merged = merged.unionByName(part)
        return self._write(merged)

    def flush(self, rows: DataFrame) -> DataFrame:
        """rows: (doc_id, digest, row), where row tells equal rows apart. Returns the run (digest, first, size):
        first is the struct (no_id, doc_id, row) of the row that stays; null identifiers come last."""
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
        run = self._write(rows.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("size")))
        self._add(run, 0)
        return run

    def compact(self) -> DataFrame:
        """All runs as one."""
        runs = [run for level in self.levels for run in level]
        whole = self._merge(runs)
        self.levels = [*([] for _ in self.levels[:-1]), [whole]]
        return whole

    def lookup(self, rows: DataFrame) -> DataFrame:
        """The entries (rows' columns, first, size) of the digests of rows; a row comes once for each run that has it."""
        found = None
        for run in (run for level in self.levels for run in level):
            _, perhaps = split(rows, F.col("digest"), run, "digest")
            hits = perhaps.join(run, "digest").select(*rows.columns, "first", "size")
            found = hits if found is None else found.unionByName(hits)
        return found


def _classes(docs: DataFrame, ws: Workspace, digest=sha256) -> DataFrame:
    """(doc_id, digest, row, keep_id, group_size, kept) of every row of docs.

    Rows are flushed in RUNS batches and the runs compacted; only rows whose digest may be one of several rows are joined
    with the index. Those get their bytes compared: the identifiers of such rows make a filter, so that only their
    texts (and few others) are normalised again, and the smallest and the largest text of a digest must be
    equal. Where they differ, rows are grouped by digest and text."""
    text = normalised(text_or_empty("text"))
    entries = ws.stage(docs.select("doc_id", digest(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "entries")
    index = DigestIndex(ws)
    for k in range(RUNS):
        index.flush(entries.where(F.col("row") % RUNS == k).select("doc_id", "digest", "row"))
    several = ws.stage(index.compact().where("size > 1"), "several")
    absent, perhaps = split(entries, F.col("digest"), several, "digest")
    alone = absent.select("doc_id", "digest", "row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    joined = perhaps.join(several, "digest", "left")
    mine = F.col("size").isNull()
    found = ws.stage(
        alone.unionByName(joined.select(
            "doc_id", "digest", "row", F.when(mine, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (mine | (F.col("first.row") == F.col("row"))).alias("kept"),
        )),
        "found",
    )
    ws.drop("entries", "several", *(f"run-{k}" for k in range(1, index.n + 1)))
    hits = ws.stage(found.where("group_size > 1").select(text_key("doc_id").alias("key")).distinct(), "hits")
    _, suspects = split(docs.select("doc_id", "text"), text_key("doc_id"), hits, "key")
    again = suspects.select("doc_id", digest(text).alias("digest"), text.alias("norm"))
    unequal = ws.stage(again.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest"), "unequal")
    if unequal.isEmpty():
        return found
    # digests that several texts share: these rows are grouped by the text itself
    texts = ws.stage(
        docs.select("doc_id", digest(text).alias("digest"), text.alias("norm")).join(unequal, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()),
        "shared-digests",
    )
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = ws.stage(texts.groupBy("digest", "norm").agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "shared-groups")
    told = texts.join(groups, ["digest", "norm"]).select("doc_id", "digest", "row", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("first.row") == F.col("row")).alias("kept"))
    return found.join(unequal, "digest", "left_anti").select(*told.columns).unionByName(told)


def without(rows: DataFrame, dropped: DataFrame, key: str, drop_key: str, gone: Column) -> DataFrame:
    """rows that no row of dropped matches under gone, which equates key and drop_key.

    A filter of the dropped keys lets all other rows through where they are, with their texts; only what it
    holds is joined. An outer join, as an anti join would be pushed below the filter and shuffle all rows. dropped
    should be a written table."""
    none = fresh(rows, "none")
    alone, held = split(rows, text_key(key), dropped.select(text_key(drop_key).alias("key")), "key")
    held = held.join(dropped.withColumn(none, F.lit(1)), gone, "left")
    return alone.unionByName(held.where(F.col(none).isNull()).select(*rows.columns))


def exact_dedup(docs: DataFrame, digest=sha256) -> DataFrame:
    """The rows of docs that stay, with all their columns; needs doc_id and text.

    Texts are equal when they are after each run of white space is made one space; null counts as empty. Of
    equal texts the row with the smallest doc_id stays (null identifiers last; of rows with equal doc_id and
    text one stays). Very long texts are hashed and compared whole, where they are. Other columns pass through whatever their names. No documents give no rows."""
    ws = Workspace(docs.sparkSession, "dedup")
    classes = _classes(docs, ws, digest)
    text = normalised(text_or_empty("text"))
    names = {c: fresh(docs, c) for c in ("drop_id", "drop_digest", "key_digest")}
    alike = classes.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    dropped = ws.stage(alike.where(~F.col("kept")).select(F.col("doc_id").alias(names["drop_id"]), F.col("digest").alias(names["drop_digest"])), "dropped")
    keyed = docs.withColumn(names["key_digest"], digest(text))
    gone = F.col("doc_id").eqNullSafe(F.col(names["drop_id"])) & (F.col(names["key_digest"]) == F.col(names["drop_digest"]))
    left = without(keyed, dropped, "doc_id", names["drop_id"], gone)
    if digest is not sha256 or not alike.where("kept and rows > 1").isEmpty():
        left = left.withColumn(names["drop_digest"], text).dropDuplicates(["doc_id", names["drop_digest"]]).drop(names["drop_digest"])
    return left.drop(names["key_digest"])


def op2_exact_dedup(spark, sf_dir):
    """Every document with the one that stays for its text."""
    ws = Workspace(spark, "op2")
    classes = _classes(load(spark, sf_dir, "documents"), ws)
    return classes.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""
