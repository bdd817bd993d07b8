"""Hard-negative mining over a pivot table: inner products as distances, bracketed by stored distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace, load
from .whitening import _lists, fixed_point, usable

#: Pivots, and the rows (those with the least hash) that they are chosen among.
PIVOTS, PIVOT_ROWS = 12, 2048
#: Rows and anchors that meet in one cell at most, on average; rows that are bracketed at a time.
ROW_BLOCK, ANCHOR_BLOCK, STRIP = 16_384, 1024, 1024
#: Cells over all rows at least, so that small tables use the cluster too.
LEAST_CELLS = 48
_LONG = 1 << 63


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as int64; one beyond 64 bits becomes the nearest that fits."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    bound = max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min())) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < _LONG:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -_LONG, _LONG - 1).astype(np.int64)


def _farthest(points: np.ndarray, k: int) -> np.ndarray:
    """k of the points, each the farthest from those before; the first is the farthest from their mean."""
    far = np.linalg.norm(points - points.mean(axis=0), axis=1)
    chosen = [int(far.argmax())]
    far = np.linalg.norm(points - points[chosen[0]], axis=1)
    while len(chosen) < min(k, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


class Pivots:
    """Pivots in the space that turns inner products into distances.

    A row x becomes (x, sqrt(top - |x|^2)), top being the largest |x|^2 of all rows, and an anchor q becomes (q, 0): their squared distance is
    |q|^2 + top - 2 <q, x>, so near means a high score. The triangle inequality over the distances to a pivot brackets the distance."""

    def __init__(self, sample: np.ndarray, top: float, k: int = PIVOTS):
        self.top = top
        self.points = _farthest(self.lifted(sample.astype(np.float64)), k)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))[:, None]])

    def _distances(self, lifted: np.ndarray) -> np.ndarray:
        return np.stack([np.linalg.norm(lifted - p, axis=1) for p in self.points], axis=1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots, as stored in the pivot table."""
        return self._distances(self.lifted(x.astype(np.float64)))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return self._distances(np.hstack([q, np.zeros((len(q), 1))]))

    def bracket(self, q_norm: np.ndarray, q_far: np.ndarray, x_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of anchors (down) and rows (across) are between the two, rounding included."""
        least, most = np.zeros((len(q_far), len(x_far))), np.full((len(q_far), len(x_far)), np.inf)
        for p in range(q_far.shape[1]):
            np.maximum(least, np.abs(q_far[:, p, None] - x_far[None, :, p]), out=least)
            np.minimum(most, q_far[:, p, None] + x_far[None, :, p], out=most)
        total = (q_norm + self.top)[:, None]
        slack = 1e-9 * total + 1e-6
        return (total - most * most) / 2 - slack, (total - least * least) / 2 + slack


TABLE = "row long, vec_id long, label int, x array<long>, far array<double>"
FOUND = "anchor long, place int, vec_id long, row long, score long"
_FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])


def pivot_table(vectors: DataFrame, ws: Workspace, k: int = PIVOTS, sample_rows: int = PIVOT_ROWS) -> tuple[DataFrame, Pivots | None, int]:
    """TABLE of vectors (row, vec_id, label, x): each row with its distances to the pivots; the pivots; the dimensions.

    Pivots are chosen among the sample_rows rows with the least hash; every row gets its distances."""
    shape = vectors.agg(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("dims"), F.max(F.aggregate("x", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double"))).alias("top")).first()
    if shape.top is None:
        return vectors.withColumn("far", F.array().cast("array<double>")), None, 0
    dims = max(1, shape.dims)
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("x").toArrow()
    pivots = Pivots(_lists(sample["x"], dims), shape.top, k)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = pivots.of_rows(_lists(batch.column(3), dims))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "far"])

    return ws.stage(vectors.select("row", "vec_id", "label", "x").mapInArrow(measure, TABLE), "pivot-table"), pivots, dims


def _best(anchor: np.ndarray, place: np.ndarray, vec: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each (anchor, place): higher scores, then smaller vec_id, then smaller row."""
    order = np.lexsort([row, vec, -score, place, anchor])
    a, p = anchor[order], place[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _search_cell(pivots: Pivots, dims: int, k: int, same_label: bool):
    """A cell's search: anchors with windows of scores (least and most, one for each place) against the rows of a block.

    Strips of rows are bracketed first. Rows whose bracket misses all windows, or whose upper end is below what an anchor's k-th find already
    scores in every place, are not looked at; what is left is multiplied out exactly."""

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        q, q_far = _lists(anchors["x"], dims), _lists(anchors["far"], len(pivots.points))
        q_label, q_row = anchors["label"].to_numpy(), anchors["row"].to_numpy()
        lists = [np.array(anchors[c].to_pylist(), dtype=object) for c in ("least", "most")]
        places = max(len(x) for x in lists[0])
        least = np.full((len(q), places), _LONG - 1, np.int64)
        most, floor = np.full((len(q), places), -_LONG, np.int64), np.full((len(q), places), -_LONG, np.int64)
        for i, (lo, hi) in enumerate(zip(*lists, strict=True)):
            least[i, : len(lo)], most[i, : len(hi)] = lo, hi
        x_all, far_all = _lists(rows["x"], dims), _lists(rows["far"], len(pivots.points))
        label_all, row_all = rows["label"].to_numpy(), rows["row"].to_numpy()
        vec_all = rows["vec_id"].fill_null(_LONG - 1).to_numpy()  # last of ties
        nameless = row_all[rows["vec_id"].is_null().to_numpy()]
        order = np.lexsort([row_all, far_all[:, 0], label_all])
        q_norm = (q.astype(np.float64) ** 2).sum(axis=1)
        held = [np.zeros(0, np.int64) for _ in range(5)]
        for at in range(0, len(order), STRIP):
            strip = order[at : at + STRIP]
            labels = label_all[strip]
            down = np.flatnonzero((q_label >= labels[0]) & (q_label <= labels[-1])) if same_label else np.arange(len(q))
            low, high = pivots.bracket(q_norm[down], q_far[down], far_all[strip])
            alive = (high >= np.maximum(least, floor)[down].min(axis=1)[:, None]) & (low <= most[down].max(axis=1)[:, None])
            same = q_label[down, None] == labels[None, :]
            alive &= (same & (q_row[down, None] != row_all[strip][None, :])) if same_label else ~same
            kept, across = alive.any(axis=1), np.flatnonzero(alive.any(axis=0))
            if not len(across):
                continue
            down, alive = down[kept], alive[kept][:, across]
            scores = exact_products(q[down], x_all[strip[across]])
            for p in range(places):
                i, j = np.nonzero(alive & (scores >= np.maximum(least, floor)[down, p, None]) & (scores <= most[down, p, None]))
                if not len(i):
                    continue
                chosen = strip[across[j]]
                new = [down[i], np.full(len(i), p), vec_all[chosen], row_all[chosen], scores[i, j]]
                mine = held[1] == p
                both = [np.concatenate([h[mine], n]) for h, n in zip(held, new, strict=True)]
                best = _best(*both, k)
                both = [c[best] for c in both]
                held = [np.concatenate([h[~mine], c]) for h, c in zip(held, both, strict=True)]
                ends = np.flatnonzero(np.append(both[0][1:] != both[0][:-1], True))
                full = ends[np.diff(ends, prepend=-1) >= k]  # the k-th find of those that have k
                floor[both[0][full], p] = both[4][full]
        vec = pa.array(held[2], mask=np.isin(held[3], nameless))
        return pa.Table.from_arrays([pa.array(q_row[held[0]]), pa.array(held[1], pa.int32()), vec, pa.array(held[3]), pa.array(held[4])], schema=_FOUND)

    return search


def pivot_search(anchors: DataFrame, table: DataFrame, n_anchors: int, n_rows: int, pivots: Pivots, dims: int, k: int, same_label: bool) -> DataFrame:
    """FOUND: for each anchor (row, label, x, far, least, most) and place the first k rows of table whose score is in the place's window.

    Anchors and rows meet in cells of a grid: rows are dealt to blocks by hash, whatever their label, anchors to blocks likewise, and a
    cell holds one block of each. An anchor's finds in all blocks meet as k rows each."""
    row_blocks, anchor_blocks = max(LEAST_CELLS, -(-n_rows // ROW_BLOCK)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    left = anchors.withColumn("down", block(anchor_blocks, 1)).withColumn("across", every(row_blocks))
    right = table.withColumn("across", block(row_blocks, 2)).withColumn("down", every(anchor_blocks))
    found = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(_search_cell(pivots, dims, k, same_label), FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), n_pivots: int = PIVOTS) -> DataFrame:
    """NEGATIVES of the anchors among rows (vec_id, label, x array of long): for each anchor and each of its first rows of the same label, the first rows
    of other labels that score from window[0] to window[1] hundredths of it.

    Rows are told apart by their place in the table, not by vec_id: repeated rows are positives of each other and anchors each; ties go to the
    smaller vec_id, a null one last. Short vectors end in zeros. An anchor without a positive, or a positive without a negative, gives no row; so do
    no rows."""
    ws = Workspace(rows.sparkSession, "negatives")
    numbered = ws.stage(rows.select("vec_id", "label", "x", is_anchor.alias("is_anchor")).withColumn("row", F.monotonically_increasing_id()), "rows")
    anchors = ws.stage(numbered.where("is_anchor").select("row"), "anchors")
    n_rows, n_anchors = numbered.count(), anchors.count()
    table, pivots, dims = pivot_table(numbered, ws, n_pivots)
    if pivots is None or not n_anchors:
        return rows.sparkSession.createDataFrame([], NEGATIVES)
    fit = (-(1 << 63), (1 << 63) - 1)

    queried = anchors.join(table, "row")
    lifted = _with_anchor_distances(queried, pivots, dims)
    whole = lifted.withColumn("least", F.array(F.lit(fit[0]))).withColumn("most", F.array(F.lit(fit[1])))
    first = ws.stage(pivot_search(ws.stage(whole, "queries"), table, n_anchors, n_rows, pivots, dims, positives, True), "positives")
    ends = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))  # positives rows at most
    low, high = window
    least = F.transform("found", lambda f: F.ceil(f["score"].cast("decimal(30,0)") * low / 100).cast("long"))
    most = F.transform("found", lambda f: F.floor(f["score"].cast("decimal(30,0)") * high / 100).cast("long"))
    again = ws.stage(lifted.join(ends, lifted["row"] == ends["anchor"]).drop("anchor").withColumn("least", least).withColumn("most", most).drop("found"), "windows")
    second = ws.stage(pivot_search(again, table, n_anchors, n_rows, pivots, dims, negatives, False), "found")
    mine = numbered.where("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = first.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = second.select("anchor", "place", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(pairs, ["anchor", "place"]).join(mine, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _with_anchor_distances(anchors: DataFrame, pivots: Pivots, dims: int) -> DataFrame:
    """Anchors with far as an anchor's distances: they are lifted to height 0, where rows are lifted to the sphere."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = pivots.of_anchors(_lists(batch.column(3), dims))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "far"])

    return anchors.select("row", "vec_id", "label", "x").mapInArrow(measure, TABLE)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings with vec_id divisible by 50; where it is divisible by 7, the label is moved on by one."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").where(F.col("label").isNotNull() & usable(F.col("embedding")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = rows.select("vec_id", moved.alias("label"), fixed_point(F.col("embedding")).alias("x"))
    return mine_negatives(rows, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


ORACLE = """
WITH usable AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::INT AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.x, r.x)::BIGINT AS score
  FROM usable a, usable r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT * FROM ranked WHERE rank <= 3"""
