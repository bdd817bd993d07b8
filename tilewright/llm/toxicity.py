"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, arrow_rows, load

FOLDS, HELD = 3, 1
#: Hash buckets of terms, and how many of them the machine keeps: those that tell the labels apart best.
BUCKETS, KEPT = 1 << 20, 4096
#: Bound of the labelled rows that the machine is fitted on; they are the first by a hash of their doc_id.
FIT_ROWS = 8_000
FACTORS, EPOCHS, SEED = 8, 60, 7
#: A word gives itself and its beginnings of these lengths (in bytes) as terms.
PREFIXES = (4, 5, 6, 7, 8)
_REMEMBERED = 300_000
_STRIP = b".,;:!?\"'()[]#*$%&|<>-"


class Terms:
    """Distinct hash buckets of a text's terms and how many words have them."""

    def __init__(self):
        self.words: dict[bytes, tuple[int, ...]] = {}

    def _of(self, word: bytes) -> tuple[int, ...]:
        core = word.strip(_STRIP)
        parts = {b"=" + core, *(b"^" + core[:n] for n in PREFIXES if len(core) >= n)} if core else ()
        return tuple(sorted({xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts}))

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.decode().lower().encode().split()
        if len(self.words) > _REMEMBERED:
            self.words = {}
        known = self.words
        for w in {w for w in words if w not in known}:
            known[w] = self._of(w)
        flat = [t for w in words for t in known[w]]
        return np.unique(np.array(flat, np.int64), return_counts=True)


def _value(counts: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(counts)).astype(np.float32)


class Machine:
    """score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)."""

    def __init__(self, place: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float):
        self.place, self.w, self.v, self.bias = place, w, v, bias

    def score(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Of n texts given as entries (row, column, value)."""
        out = np.full(n, self.bias, np.float64)
        out += np.bincount(rows, weights=self.w[cols] * values, minlength=n)
        for f in range(self.v.shape[1]):
            t = self.v[cols, f] * values
            out += 0.5 * (np.bincount(rows, weights=t, minlength=n) ** 2 - np.bincount(rows, weights=t * t, minlength=n))
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def fit(rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Machine:
    """The machine for texts given as entries (row, bucket, count) and a label per row.

    Terms are chosen by chi-squared of presence against the label; the fit is full-batch Adam on the logistic
    loss with a ridge, from seeded factors, so it is the same each time. One label only gives its prior."""
    n = len(labels)
    positive = float(labels.sum())
    prior = np.log((positive + 0.5) / (n - positive + 0.5)) if n else 0.0
    place = np.full(BUCKETS, -1, np.int32)
    if not 0 < positive < n:
        return Machine(place, np.zeros(1, np.float32), np.zeros((1, FACTORS), np.float32), float(prior))
    df = np.bincount(buckets, minlength=BUCKETS).astype(np.float64)
    hit = np.bincount(buckets, weights=labels[rows], minlength=BUCKETS)
    expected = df * positive / n
    chi = np.where(df >= 4, (hit - expected) ** 2 / np.maximum(expected * (1 - df / (n + 1.0)), 1e-9), 0.0)
    kept = np.sort(np.argsort(-chi, kind="stable")[:KEPT])
    kept = kept[chi[kept] > 6.0]
    place[kept] = np.arange(len(kept))
    use = place[buckets] >= 0
    r, c, x = rows[use], place[buckets[use]], _value(counts[use])
    rng = np.random.default_rng(SEED)
    size = max(1, len(kept))
    params = [np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32), np.array([prior], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    ridge = (2e-5, 2e-4, 0.0)
    for step in range(1, EPOCHS + 1):
        machine = Machine(place, params[0], params[1], float(params[2][0]))
        error = (machine.score(r, c, x, n) - labels) / n
        ex = error[r] * x
        grads = [np.bincount(c, weights=ex, minlength=size), np.empty_like(params[1]), np.array([error.sum()])]
        for f in range(FACTORS):
            t = params[1][c, f] * x
            total = np.bincount(r, weights=t, minlength=n)
            grads[1][:, f] = np.bincount(c, weights=ex * (total[r] - t), minlength=size)
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = g + ridge[i] * p
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            p -= (0.15 if i != 1 else 0.03) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(place, params[0], params[1], float(params[2][0]))


def _entries(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(t) for t, _ in found]
    rows = np.repeat(np.arange(len(found)), sizes)
    join = lambda i: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)
    return rows, join(0), join(1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for b in batches:
        found = [terms(t.as_buffer().to_pybytes()) for t in b.column("text")]
        ids = pa.array([t.astype("<u4").tobytes() for t, _ in found], pa.binary())
        counts = pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("toxic"), ids, counts], ["toxic", "terms", "counts"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fit on at most fit_rows labelled rows of the training folds; rows without a label or document are left out."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(key.cast("binary")) % FOLDS != HELD))
    chosen = usable.select(F.col("doc_id").cast("long").alias("fit_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    # at most fit_rows rows of two numbers are broadcast; repeated identifiers may give more rows, cut again below
    some = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("fit_id")).select("toxic", "text", F.xxhash64("doc_id", "text").alias("at"))
    some = some.orderBy("at").limit(fit_rows).drop("at") if _repeats(docs) else some.drop("at")
    with arrow_rows(docs.sparkSession, 500):
        got = some.mapInArrow(_describe, "toxic int, terms binary, counts binary").toArrow()
    found = [(np.frombuffer(t.as_py(), "<u4").astype(np.int64), np.frombuffer(c.as_py(), "<u4").astype(np.int64)) for t, c in zip(got["terms"], got["counts"], strict=True)]
    return fit(*_entries(found), got["toxic"].to_numpy().astype(np.float64))


def _repeats(docs: DataFrame) -> bool:
    return not docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()


def _apply(machine: Machine):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            ids = b.column(0).to_pylist()
            rows, buckets, counts = _entries([terms(t.as_buffer().to_pybytes()) for t in b.column(1)])
            cols = machine.place[buckets]
            use = cols >= 0
            score = machine.score(rows[use], cols[use], _value(counts[use]), len(ids))
            held = [zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD for i in ids]
            columns = [b.column(0), pa.array(held), pa.array(score), pa.array((score >= 0.7).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return read


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. Needs doc_id and text; labels: doc_id and toxic.

    The score depends on the whole text only. A null text is empty and gets the bias's score. Null labels are
    left out, a null doc_id is scored; without labels all scores are the same. Repeated rows are scored
    alike, other columns are not read. No documents give no rows. Very long texts are scored whole, one at a time in
    memory. The machine has a fixed size, at most KEPT terms, and goes to the executors with the plan."""
    machine = train(docs, labels, fit_rows)
    ws = Workspace(docs.sparkSession, "toxicity")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return ws.stage(texts.mapInArrow(_apply(machine), "doc_id long, held_out boolean, score double, predicted int"), "scores", batch_rows=500)


def op7_toxicity_fm(spark, sf_dir):
    """All documents scored."""
    return toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
