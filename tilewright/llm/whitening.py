"""Whitening of embeddings by a QR factorisation of tall tables: partitions are factorised, triangles merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, fresh, load

#: Rows that a task factorises at a time, and triangles (or moments) that one merge takes.
BLOCK, FAN_IN = 4096, 16
SCALE = 256
#: Singular values below this share of the largest, times the dimensions, count as 0.
EPS = 2.0**-52


def usable(vector: Column) -> Column:
    """True for vectors that are there, with entries that are all there and finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def fixed_point(vector: Column, scale: int = SCALE) -> Column:
    """Entries as whole numbers floor(scale * c); a number beyond 64 bits becomes the nearest that fits."""
    floor = lambda c: F.floor(c.cast("double") * float(scale))
    top = 9.2e18
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double") * float(scale)) < top, floor(c)).when(c > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63))).cast("long"))


def _lists(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column; short rows are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == dims).all():
        return flat.reshape(len(ends), dims)
    out, at = np.zeros((len(ends), dims), flat.dtype if len(flat) else np.int64), 0
    for i, n in enumerate(ends):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n. n * x - sums is whole and exact, so nothing cancels; only the division rounds."""
    total = np.array(sums, dtype=object)
    if len(x) == 0:
        return np.zeros(x.shape)
    if max(int(x.max()), -int(x.min())) * n + max(map(abs, sums), default=0) < 1 << 62:
        return (x * n - total.astype(np.int64)).astype(np.float64) / n
    return ((x.astype(object) * n - total) / n).astype(np.float64)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)^2, exact; None where it does not fit 64 bits."""
    if len(x) == 0:
        return []
    largest = max(int(x.max()), -int(x.min())) * n + max(map(abs, sums), default=0)
    if largest <= isqrt((1 << 62) // max(1, x.shape[1])):
        d = x * n - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * n - np.array(sums, dtype=object)
    return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


TRIANGLE = "part long, row int, r array<double>"
_TRIANGLE = pa.schema([("part", pa.int64()), ("row", pa.int32()), ("r", pa.list_(pa.float64()))])


def _triangle_batch(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": [part] * len(r), "row": list(range(len(r))), "r": list(r)}, _TRIANGLE)


def partition_triangles(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """TRIANGLE: the R factor of each partition's centred rows (x), a block of rows at a time."""
    dims = len(sums)

    def factorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, dims))
        for batch in batches:
            x = _lists(batch.column(0), dims)
            for at in range(0, len(x), BLOCK):
                r = _triangle(np.vstack([r, _centred(x[at : at + BLOCK], n, sums)]))
        if len(r):
            yield _triangle_batch(TaskContext.get().partitionId(), r)

    return rows.select("x").mapInArrow(factorise, TRIANGLE)


def merge_triangles(triangles: DataFrame, parts: int, dims: int, ws: Workspace) -> np.ndarray:
    """The R factor of all rows: FAN_IN triangles are stacked and factorised anew until one is left. A group is FAN_IN * dims rows at most."""

    def merge(table: pa.Table) -> pa.Table:
        order = np.lexsort([table["row"].to_numpy(), table["part"].to_numpy()])
        r = _triangle(_lists(table["r"], dims)[order])
        return pa.Table.from_batches([_triangle_batch(int(table["part"][0].as_py()) // FAN_IN, r)])

    level = 0
    while parts > 1:
        merged = triangles.groupBy(F.floor(F.col("part") / FAN_IN).cast("long").alias("group")).applyInArrow(merge, TRIANGLE)
        parts, level = -(-parts // FAN_IN), level + 1
        triangles = ws.stage(merged, f"triangles-{level}")
    rows = triangles.orderBy("row").collect()  # dims * dims numbers
    return np.array([x.r for x in rows]).reshape(len(rows), dims)


MOMENTS = "part long, n long, mean array<double>, scatter array<double>"
_MOMENTS = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))])


def _join_moments(a, b):
    """Count, mean and centred scatter of two sets of rows together."""
    if a is None or b is None:
        return b if a is None else a
    (n, m, s), (k, o, t) = a, b
    d = o - m
    return n + k, m + d * (k / (n + k)), s + t + np.outer(d, d) * (n * k / (n + k))


def whitened_covariance(rows: DataFrame, n: int, sums: list[int], project: np.ndarray, ws: Workspace) -> np.ndarray:
    """Covariance, divisor n, of the projected fit list: rows are centred on their block's mean before multiplying, blocks are merged."""
    dims, k = project.shape

    def block_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            x = _lists(batch.column(0), dims)
            for at in range(0, len(x), BLOCK):
                w = _centred(x[at : at + BLOCK], n, sums) @ project
                c = w - w.mean(axis=0)
                held = _join_moments(held, (len(w), w.mean(axis=0), c.T @ c))
        if held:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [held[0]], "mean": [held[1]], "scatter": [held[2].ravel()]}, _MOMENTS)

    def merge(table: pa.Table) -> pa.Table:
        held = None
        for x in sorted(table.select(_MOMENTS.names).to_pylist(), key=lambda x: x["part"]):
            held = _join_moments(held, (x["n"], np.array(x["mean"]), np.array(x["scatter"]).reshape(k, k)))
        return pa.table({"part": [table["part"][0].as_py() // FAN_IN], "n": [held[0]], "mean": [held[1]], "scatter": [held[2].ravel()]}, _MOMENTS)

    moments = ws.stage(rows.select("x").mapInArrow(block_moments, MOMENTS), "moments-0")
    parts, level = (moments.agg(F.max("part")).first()[0] or 0) + 1, 0
    while parts > 1:
        merged = moments.groupBy(F.floor(F.col("part") / FAN_IN).cast("long").alias("group")).applyInArrow(merge, MOMENTS)
        parts, level = -(-parts // FAN_IN), level + 1
        moments = ws.stage(merged, f"moments-{level}")
    found = moments.first()
    return np.array(found.scatter).reshape(k, k) / found.n


class Whitening:
    """A fitted whitening: n, sums (exact), variances e (falling), vectors (a column for each component), trace, identity_error."""

    def __init__(self, n, sums, variances, vectors, trace, identity_error=None):
        self.n, self.sums, self.variances, self.vectors, self.trace, self.identity_error = n, sums, variances, vectors, trace, identity_error

    def projection(self) -> np.ndarray:
        """Vectors over the square roots of their variances, those of variance 0 left out."""
        return self.vectors[:, self.variances > 0] / np.sqrt(self.variances[self.variances > 0])


def fit_whitening(vectors: DataFrame, ws: Workspace, components: int | None = None) -> Whitening | None:
    """Fit on each distinct x (array of long) of vectors once; None if there is none.

    Sums per dimension are exact decimals. The covariance is never formed: the centred rows' R factor has the same right
    singular vectors as they have, its squared singular values over n are the variances. Components of variance 0 (to double
    precision) get variance 0. A model is dims * dims numbers, whatever the rows."""
    rows = ws.stage(vectors.select("x").distinct(), "distinct")
    shape = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("dims")).first()
    if not shape.n or not shape.dims:
        return None
    n, dims = shape.n, shape.dims
    got = rows.agg(*[F.sum(F.coalesce(F.try_element_at("x", F.lit(i + 1)), F.lit(0)).cast("decimal(19,0)")).alias(f"s{i}") for i in range(dims)]).first()
    sums = [int(s) for s in got]
    triangles = ws.stage(partition_triangles(rows, n, sums), "triangles-0")
    parts = triangles.agg(F.max("part")).first()[0] + 1
    r = merge_triangles(triangles, parts, dims, ws)
    _, s, v = np.linalg.svd(r)
    s = np.concatenate([s, np.zeros(dims - len(s))])
    s[s <= s[0] * EPS * max(n, dims)] = 0.0
    k = min(dims, components or dims)
    model = Whitening(n, sums, (s * s / n)[:k], v[:k].T.copy(), float((s * s).sum() / n))
    if (project := model.projection()).shape[1]:
        model.identity_error = float(np.abs(whitened_covariance(rows, n, sums, project, ws) - np.eye(project.shape[1])).max())
    return model


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """deviation (exact; null beyond 64 bits) and whitened (array, a number for each component; null where its variance is 0) for rows with x.

    Adds the columns in one pass, without a shuffle; other columns of vectors pass through."""
    n, sums, dims = model.n, model.sums, len(model.sums)
    scale = np.where(model.variances > 0, np.sqrt(np.where(model.variances > 0, model.variances, 1.0)), np.nan)
    project = model.vectors / scale
    names = {c: fresh(vectors, c) for c in ("deviation", "whitened")}
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    at = vectors.columns.index("x")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lists(batch.column(at), dims)
            w = _centred(x, n, sums) @ project
            cells = pa.array(w.ravel(), pa.float64(), from_pandas=True)
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_deviation(x, n, sums), pa.int64()), whitened], [*batch.schema.names, *names.values()])

    return vectors.mapInArrow(apply, f"{kinds}, {names['deviation']} long, {names['whitened']} array<double>")


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten_embeddings(rows: DataFrame, components: int = 4, scale: int = SCALE) -> DataFrame:
    """WHITENED: a row for each usable row of rows (vec_id, embedding) and component.

    Rows whose vector is null or holds null or non-finite entries are dropped. Repeated rows come as often as they are there, a
    repeated vector is fitted once, a null vec_id stays null, vectors shorter than the longest end in zeros. Fewer dimensions than
    components give fewer components. Where a component has variance 0 whitened is null; if all have, so are explained and
    identity_error. Other columns are ignored. No usable rows give none."""
    ws = Workspace(rows.sparkSession, "whiten")
    vectors = ws.stage(rows.select("vec_id", "embedding").where(usable(F.col("embedding"))).select("vec_id", fixed_point(F.col("embedding"), scale).alias("x")), "vectors")
    model = fit_whitening(vectors, ws, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], WHITENED)
    share = [float(e / model.trace) if model.trace > 0 else None for e in model.variances]
    cells = F.posexplode("whitened").alias("k", "value")
    explained = F.element_at(F.array(*[F.lit(s).cast("double") for s in share]), F.col("k") + 1)
    return whiten(vectors, model).select("vec_id", "deviation", cells).select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings."""
    return whiten_embeddings(load(spark, sf_dir, "embeddings"))
