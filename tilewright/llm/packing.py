"""Best-fit packing of tokenised documents: large items are matched in pairs, small ones fill the gaps."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace, arrow_rows, load, text_or_empty

CAPACITY = 2048
END_ID = 0
_REMEMBERED = 300_000
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _byte_letters() -> dict[int, int]:
    """The character that a byte-level vocabulary writes for each byte: itself where it prints, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, with the ids of words remembered.

    White space never crosses a token of this vocabulary's pre-tokeniser, so a text's ids are those of its
    space-separated words in order. Letters and the marks after them are pre-tokens of their own, so a word
    of letters goes straight to the merges, without marks. All other words, and texts that may hold a special token's
    string, go to the whole tokeniser."""

    def __init__(self, vocab: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {b"": b""}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, core: bytes) -> bytes | None:
        """The ids of a word of letters only; None where it is not one."""
        if core.isalpha():
            text = core.decode()
        elif not core.isascii() and _one_word(core):
            text = core.decode("latin-1").translate(self.letters)
        else:
            return None
        return b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(text)])

    def forget(self) -> None:
        self.words, self.cores = {}, {b"": b""}

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self.words) > _REMEMBERED:
            self.words = {}
        if len(self.cores) > _REMEMBERED:
            self.cores = {b"": b""}
        for w in {w for words in texts for w in words if w not in self.words}:
            core = w.rstrip(_MARKS)
            ids = self.cores.get(core)
            if ids is None:
                ids = self._core(core)
                if ids is None:
                    self.words[w] = self._ids(w.decode())
                    continue
                self.cores[core] = ids
            tail = w[len(core) :]
            marks = self.tails.get(tail)
            if marks is None:
                marks = self._ids(tail.decode())
                if len(self.tails) < 10_000:
                    self.tails[tail] = marks
            self.words[w] = ids + marks

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        whole = [b"<|" in t for t in texts]
        split = [[] if w else t.lower().split() for t, w in zip(texts, whole, strict=True)]
        self.learn(split)
        for text, words, as_one in zip(texts, split, whole, strict=True):
            yield self._ids(text.decode()) if as_one else b"".join(map(self.words.__getitem__, words))


def _encoder(vocab: str) -> WordEncoder:
    """This process's encoder. It is kept on the tokenizers module, the one that all tasks of a worker share: functions
    that travel with the plan are made anew for each task, and loading a vocabulary each time takes its toll."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_word_encoders", {})
    return held.get(vocab) or held.setdefault(vocab, WordEncoder(vocab))


def _one_word(word: bytes) -> bool:
    text = word.decode()
    return text.isalpha() and text == unicodedata.normalize("NFC", text).lower()


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(vocab: str, capacity: int, end_id: int) -> Callable:
    """A mapInArrow function from (doc_id, text as bytes) to PIECES."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(vocab), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for i in range(0, len(texts), 100):
                for doc_id, raw in zip(ids[i : i + 100], encoder.encode(texts[i : i + 100]), strict=True):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()  # the process lives on with other tasks

    return cut


def plan_bins(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where the items of each length go, from the number of items of each length only.

    Items above a third of the capacity come first, two to a bin at most: the largest with the largest that
    still fits. Shorter ones, longest first, fill the smallest gap that holds them; where none does, new bins
    are opened. Bins alike are planned together, so the plan grows with the capacity, not with the items.
    Returns runs (length, first, n, base, each, offset): of the items of this length, numbered from 0, those
    from first on go to bins from base on, each of them to a bin, one after the other from offset."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    used = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def place(length: int, n: int, base: int, each: int, offset: int) -> None:
        runs.append((length, int(used[length]), n, base, each, offset))
        used[length] += n
        left[length] -= n

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            fits = np.flatnonzero(left[third + 1 : min(a, capacity - a) + 1])
            b = third + 1 + int(fits[-1]) if len(fits) else 0
            if b == a and left[a] == 1:
                b = third + 1 + int(fits[-2]) if len(fits) > 1 else 0
            n = int(left[a]) if not b else int(left[a]) // 2 if a == b else int(min(left[a], left[b]))
            place(a, n, bins, 1, 0)
            if b:
                place(b, n, bins, 1, a)
            gaps.setdefault(capacity - a - b, []).append((bins, n))
            bins += n
    has = np.zeros(capacity + 1, bool)
    has[list(gaps)] = True
    for s in range(third, 0, -1):
        while left[s]:
            fits = np.flatnonzero(has[s:])
            if not len(fits):
                n = -(-int(left[s]) // (capacity // s))
                gaps.setdefault(capacity, []).append((bins, n))
                has[capacity] = True
                bins += n
                continue
            gap = s + int(fits[0])
            base, n = gaps[gap].pop()
            each = gap // s
            full = min(n, int(left[s]) // each)
            rest = int(left[s]) - full * each if full < n else 0
            groups = []
            if full:
                place(s, full * each, base, each, capacity - gap)
                groups.append((gap - each * s, base, full))
            if rest:
                place(s, rest, base + full, rest, capacity - gap)
                groups.append((gap - rest * s, base + full, 1))
            groups.append((gap, base + full + bool(rest), n - full - bool(rest)))
            for g, first, many in groups:
                if many:
                    gaps.setdefault(g, []).append((first, many))
                    has[g] = True
            has[gap] = bool(gaps[gap])
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    return dict(zip(("length", "first", "n", "base", "each", "offset"), table.T, strict=True))


def _seat(plan: dict[str, np.ndarray]) -> Callable:
    """A mapInArrow function that adds sequence_id and offset to pieces numbered within their length."""
    keys = (plan["length"] << 44) + plan["first"]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            run = np.searchsorted(keys, (length << 44) + number, "right") - 1
            turn, each = number - plan["first"][run], plan["each"][run]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(plan["base"][run] + turn // each), pa.array(plan["offset"][run] + turn % each * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return seat


def pack(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID, bucket_rows: int = 20_000) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most capacity tokens.

    Needs doc_id and text; a null text is empty and so one token, the end. Only documents longer than the
    capacity are cut. Repeated rows are packed as often as they come; a null doc_id stays null; other
    columns are not read. No documents give no rows. A very long text is tokenised whole by one task. The driver sees one count per length; pieces of equal
    length are numbered in buckets of about bucket_rows, so that a frequent length is not one group."""
    spark = docs.sparkSession
    ws = Workspace(spark, "pack")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("text"))
    with arrow_rows(spark, 500):
        pieces = ws.stage(raw.mapInArrow(cut_pieces(vocab, capacity, end_id), PIECES), "pieces")
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = plan_bins(lengths, capacity)
    buckets = max(16, sum(lengths.values()) // bucket_rows)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("at", F.row_number().over(within) - 1).join(skips, ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("skip")).cast("long").alias("number"))
    return numbered.mapInArrow(_seat(plan), PIECES + ", sequence_id long, offset long")


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_pack_best_fit(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    return pack(load(spark, sf_dir, "documents"), default_vocab())
