"""Whitening and hard negatives against plain numpy and plain Python."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.llm import negatives, whitening
from tilewright.llm.shared import Workspace

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Embeddings with columns whose names clash with the operators' own."""
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("x", "row", "far", "n", "anchor", "whitened"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def fixed(v):
    """Whole numbers of a vector, None where it takes no part."""
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(256 * float(np.float32(c))) for c in v]


def check_whitening(got, rows, components):
    xs = [(i, fixed(v)) for i, v, _ in rows]
    xs = [(i, x) for i, x in xs if x is not None]
    dims = max((len(x) for _, x in xs), default=0)
    padded = [(i, tuple(x + [0] * (dims - len(x)))) for i, x in xs]
    fit = sorted({x for _, x in padded})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = (np.array(fit, dtype=np.float64) * n - sums) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, dims)
    assert len(got) == len(padded) * k
    by = defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-4 * e[r.component - 1] / e.sum()
        by[r.component].append(r)
    want_deviation = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in padded)
    for c in range(1, k + 1):
        assert Counter((r.vec_id, r.deviation) for r in by[c]) == want_deviation
        plain = [(np.array(x) * n - np.array(sums)) / n @ v[:, c - 1] / math.sqrt(e[c - 1]) for _, x in padded]
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in by[c])
        close = []
        for sign in (1, -1):
            other = sorted((i is None, i or 0, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), sign * w) for (i, x), w in zip(padded, plain, strict=True))
            close.append(all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-7 for a, b in zip(mine, other, strict=True)))
        assert any(close), c


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 6)) * [5, 3, 2, 1, 0.5, 0.2]
    rows = [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(base)]
    rows += [(i, v, 0) for i, v, _ in rows[:20]] + [(None, rows[3][1], None), (900, None, 1), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (902, [NAN] * 6, 1), (903, [0.0, INF] + [0.0] * 4, 1), (904, [1.0, -2.0], 1), (905, [], 1)]
    frame = table(spark, rows)
    check_whitening(whitening.whiten_embeddings(frame.repartition(7)).collect(), rows, 4)
    assert whitening.whiten_embeddings(frame.limit(0)).collect() == []
    assert whitening.whiten_embeddings(frame.where("vec_id >= 900 and vec_id < 904")).collect() == []


def test_whitening_of_the_given_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    check_whitening(whitening.op11_whitening(spark, SF).collect(), rows, 4)


def test_whitening_without_variance(spark):
    """One vector, or fewer directions than components: null where the variance is 0."""
    got = whitening.whiten_embeddings(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    got = whitening.whiten_embeddings(table(spark, [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and {round(r.explained, 9) for r in got if r.component == 1} == {1.0}
    assert sorted(x.vec_id for x in whitening.whiten_embeddings(table(spark, [(1, [1.0], 0), (2, [3.0], 0)])).collect()) == [1, 2]


def test_triangles_merge_in_levels(spark, monkeypatch):
    """Many partitions, small blocks: the same R as numpy's, up to signs of rows."""
    monkeypatch.setattr(whitening, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, (700, 5))
    frame = spark.createDataFrame([(list(map(int, r)),) for r in x], "x array<long>").repartition(40)
    ws = Workspace(spark, "t")
    rows = ws.stage(frame, "x")
    sums = [int(s) for s in x.sum(axis=0)]
    triangles = ws.stage(whitening.partition_triangles(rows.repartition(37), 700, sums), "r")
    r = whitening.merge_triangles(triangles, 37, 5, ws)
    c = (x * 700 - np.array(sums)) / 700
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-12)


def test_deviation_beyond_64_bits():
    x = np.array([[1 << 40], [5]])
    assert whitening._deviation(x, 10, [7]) == [None if (10 * (1 << 40) - 7) ** 2 >= 1 << 63 else 0, 43**2]
    assert np.allclose(whitening._centred(np.array([[1 << 61, 3]]), 10, [1, 2]), [[2.0**61 - 0.1, 2.8]])


def brute_negatives(rows, is_anchor, positives=5, negatives_=3, window=(50, 95)):
    """rows: (vec_id, label, x)."""
    out = Counter()
    dims = max((len(x) for _, _, x in rows), default=0)
    rows = [(i, label, x + [0] * (dims - len(x))) for i, label, x in rows]
    for k, (a, label, x) in enumerate(rows):
        if not is_anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), i if i is not None else 1 << 62, j) for j, (i, _, y) in enumerate(rows) if j != k]
        scored.sort()
        for s, i, _ in [t for t in scored if rows[t[2]][1] == label][:positives]:
            fit = [t for t in scored if rows[t[2]][1] != label and window[0] * -s <= 100 * -t[0] <= window[1] * -s][:negatives_]
            for rank, (t, j, _) in enumerate(fit, 1):
                out[(a, i if i != 1 << 62 else None, rank, j if j != 1 << 62 else None, -s, -t)] += 1
    return out


@pytest.mark.parametrize("blocks", [(16_384, 1024, 1024, 48), (40, 3, 8, 1)])
def test_hard_negatives(spark, monkeypatch, blocks):
    """Clusters, ties, repeated rows, negative scores, short vectors, a label of one row."""
    for name, value in zip(("ROW_BLOCK", "ANCHOR_BLOCK", "STRIP", "LEAST_CELLS"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(7)
    centres = rng.integers(-60, 60, (4, 5))
    rows = [(i, int(rng.integers(0, 3)), [int(c) for c in centres[i % 4] + rng.integers(-9, 9, 5)]) for i in range(150)]
    rows += [(i, label, x) for i, label, x in rows[:12]] + [(200 + i, i % 3, list(rows[0][2])) for i in range(9)] + [(300, 9, [1, 2, 3, 4, 5]), (301, 1, [5, -5]), (302, 2, []), (303, 1, [0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, x array<long>").repartition(3)
    got = negatives.mine_negatives(frame, F.col("vec_id") % 10 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert negatives.mine_negatives(frame.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine_negatives(frame, F.lit(False)).collect() == []


def test_query_drops_rows_that_take_no_part(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4)], int(rng.integers(0, 10)) % 4) for i in range(160)]
    rows += [(500, None, 1), (550, [1.0, None, 0.0, 0.0], 1), (600, [1.0, NAN, 0.0, 0.0], 1), (650, [INF, 0.0, 0.0, 0.0], 1), (700, [1.0, 1.0, 0.0, 0.0], None), (None, [3.0, 3.0, 0.0, 1.0], 1)]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = negatives.op12_hard_negatives(spark, str(tmp_path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    part = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, fixed(v)) for i, v, label in rows if label is not None and fixed(v) is not None]
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(part, lambda i: i is not None and i % 50 == 0)


def test_brackets_hold(spark):
    """Of rows on spheres of all sizes, with ties: each score is between its bounds, and near rows have narrow ones."""
    rng = np.random.default_rng(9)
    x = np.vstack([rng.integers(-300, 300, (200, 8)), np.zeros((2, 8), int), np.full((3, 8), 10**6)])
    p = negatives.Pivots(x[:100], float((x.astype(float) ** 2).sum(axis=1).max()))
    q = x[::5]
    low, high = p.bracket((q.astype(float) ** 2).sum(axis=1), p.of_anchors(q), p.of_rows(x))
    scores = q @ x.T
    assert (low <= scores).all() and (scores <= high).all()


def test_products_of_any_size():
    a, b = np.array([[3, -4], [1 << 30, 1]]), np.array([[5, 6], [-(1 << 30), 7]])
    want = [[sum(x * y for x, y in zip(r, s, strict=True)) for s in b.tolist()] for r in a.tolist()]
    assert negatives.exact_products(a, b).tolist() == want
    huge = np.array([[1 << 62, 1 << 62]])
    assert negatives.exact_products(huge, huge).tolist() == [[(1 << 63) - 1]] and negatives.exact_products(huge, -huge).tolist() == [[-(1 << 63)]]


def test_lists_of_unequal_lengths():
    assert whitening._lists(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 2).tolist() == [[1, 2], [0, 0], [3, 0]]
    assert whitening._lists(pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.int64())).slice(1), 2).tolist() == [[3, 4], [5, 6]]
