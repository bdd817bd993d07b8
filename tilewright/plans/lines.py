"""Queries of poly-lines: their points come from the vectors of the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilewright.functions.scalar import idiv, shr
from tilewright.operators import polylines
from tilewright.sources.rasters import duck, embedding_plane

QUERIES: dict = {}
ORACLES: dict = {}
_AXES = "xyz"


def _vector_lines(spark, sf, axes: int = 3):
    """A poly-line of six points for each vector: point k takes components axes * k and on."""
    plane = embedding_plane(spark, sf).where(F.col("x") < 6 * axes)
    pick = [F.max(F.when(F.col("x") % axes == k, shr("v", 2))).alias(_AXES[k]) if k < axes else F.lit(0).alias(_AXES[k]) for k in range(3)]
    return plane.groupBy(F.col("y").alias("line"), idiv("x", axes).alias("k")).agg(*pick)


def _vector_lines_sql(axes: int) -> str:
    pick = ", ".join(f"max(v >> 2) FILTER (x % {axes} = {k}) AS {_AXES[k]}" if k < axes else f"0 AS {_AXES[k]}" for k in range(3))
    return f",\npt AS (SELECT y AS line, x // {axes} AS k, {pick} FROM emb WHERE x < {6 * axes} GROUP BY ALL)"


def _band_lines(spark, sf):
    """A poly-line of eight points for each 64 rows: every eighth row gives one by its first components."""
    plane = embedding_plane(spark, sf).where((F.col("y") % 8 == 0) & (F.col("x") < 3))
    return plane.groupBy(idiv("y", 64).cast("int").alias("line"), idiv(F.col("y") % 64, 8).alias("k")).agg(*[F.max(F.when(F.col("x") == k, shr("v", 2))).alias(a) for k, a in enumerate(_AXES)])


_BAND_LINES = ",\npt AS (SELECT (y // 64)::INT AS line, y % 64 // 8 AS k, " + ", ".join(f"max(v >> 2) FILTER (x = {k}) AS {a}" for k, a in enumerate(_AXES)) + " FROM emb WHERE y % 8 = 0 AND x < 3 GROUP BY ALL)"
_SEGMENTS = f""",
s1 AS (SELECT line, k, {", ".join(f"{a}::DOUBLE AS {a}0, (lead({a}) OVER o)::DOUBLE AS {a}1" for a in _AXES)} FROM pt WINDOW o AS (PARTITION BY line ORDER BY k)),
s2 AS (SELECT *, round(sqrt({" + ".join(f"({a}1 - {a}0) * ({a}1 - {a}0)" for a in _AXES)}) * {polylines.UNIT})::BIGINT AS size FROM s1 WHERE x1 IS NOT NULL),
sg AS MATERIALIZED (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY line ORDER BY k) - 1 AS seg, (sum(size) OVER (PARTITION BY line ORDER BY k) - size)::BIGINT AS start, (sum(size) OVER (PARTITION BY line))::BIGINT AS total FROM s2 WHERE size > 0)"""


def _field_sql(axes: str, cells: str, where: str = "") -> str:
    """All cells against all segments of their line."""
    square = " + ".join(f"({a}1 - {a}0) * ({a}1 - {a}0)" for a in axes)
    foot = " + ".join(f"(c{a} - {a}0) * ({a}1 - {a}0)" for a in axes)
    off = " + ".join(f"(c{a} - ({a}0 + h * ({a}1 - {a}0))) * (c{a} - ({a}0 + h * ({a}1 - {a}0)))" for a in axes)
    index = ", ".join(f"greatest(0, least({n - 1}, ceil(pos * {n - 1} - 0.5)))::INT AS i{d}" for d, n in polylines.COUNTS.items())
    return f""",
ce AS ({cells}),
m1 AS (SELECT sg.*, {", ".join(f"c{a}" for a in axes)}, ({foot}) / ({square}) AS f FROM sg, ce {where}),
m2 AS (SELECT *, greatest(0.0, least(1.0, f)) AS h FROM m1),
m3 AS (SELECT line, {", ".join(f"c{a}" for a in axes)}, seg, sqrt({off}) AS d, (start + f * size) / total AS pos FROM m2),
m4 AS (SELECT line, {", ".join(f"c{a}" for a in axes)}, min(struct_pack(d := d, seg := seg, pos := pos)) AS s FROM m3 GROUP BY ALL),
fd AS (SELECT line, {", ".join(f"c{a}::INT AS {a}" for a in axes)}, trunc(((s.d + 1.0) * (s.d + 1.0) - 1.0) * 1024.0)::INT AS dist, {index.replace("pos", "s.pos")} FROM m4)"""


_SUMS = ", ".join(f"sum({k})::BIGINT AS {k}" for k in ("dist", "i6", "i5", "i4", "i3"))


def _resampled(spark, sf):
    """The points of each vector's line at four depths."""
    return polylines.resample(polylines.segments(_vector_lines(spark, sf)))


QUERIES["op_s26_resampled_lines"] = _resampled
ORACLES["op_s26_resampled_lines"] = duck("emb", _vector_lines_sql(3) + _SEGMENTS + f""",
dp AS (SELECT * FROM (VALUES {", ".join(f"({d}, {n - 1})" for d, n in polylines.COUNTS.items())}) v(depth, last)),
w AS (SELECT depth, last, i AS idx FROM dp, range(64) t(i) WHERE i <= last),
j AS (SELECT sg.*, depth, last, idx, (idx * total - last * start)::DOUBLE / (last * size)::DOUBLE + {polylines.GUARD} AS local FROM sg, w
  WHERE idx * total <= last * (start + size) AND (idx * total > last * start OR idx = 0 AND start = 0))
SELECT line, depth, idx::INT AS idx, {", ".join(f"trunc(({a}0 + ({a}1 - {a}0) * local) / 64 * 128)::INT AS f{a}" for a in _AXES)} FROM j""")  # fmt: skip


def _field_3d(spark, sf):
    """The field of 64 x 64 x 64 cells of each band's line, summed up by blocks of 8 x 8 x 8."""
    return polylines.field_blocks(polylines.segments(_band_lines(spark, sf)))


def _field_2d(spark, sf):
    """The field of 64 x 64 cells of each vector's line, summed up by blocks of 8 x 8."""
    return polylines.field_blocks(polylines.segments(_vector_lines(spark, sf, 2)), 2)


QUERIES["op_s27_distance_field_3d"] = _field_3d
ORACLES["op_s27_distance_field_3d"] = duck("emb", _BAND_LINES + _SEGMENTS + _field_sql("xyz", "SELECT (i % 64)::DOUBLE AS cx, (i // 64 % 64)::DOUBLE AS cy, (i // 4096)::DOUBLE AS cz FROM range(262144) t(i)")
    + f"\nSELECT line, (x // 8)::INT AS bx, (y // 8)::INT AS by, (z // 8)::INT AS bz, {_SUMS} FROM fd GROUP BY ALL")
QUERIES["op_s27_distance_field_2d"] = _field_2d
ORACLES["op_s27_distance_field_2d"] = duck("emb", _vector_lines_sql(2) + _SEGMENTS + _field_sql("xy", "SELECT (i % 64)::DOUBLE AS cx, (i // 64)::DOUBLE AS cy FROM range(4096) t(i)")
    + f"\nSELECT line, (x // 8)::INT AS bx, (y // 8)::INT AS by, {_SUMS} FROM fd GROUP BY ALL")


def _own_segments(spark, sf):
    """A field of the caller's own segments: each is its start alone, as far as the larger of the two steps to it."""

    def corner(place, seg):
        return np.maximum(*[np.abs(v - seg[f"{a}0"]) for a, v in place.items()]), 0.0

    return polylines.field_blocks(polylines.segments(_vector_lines(spark, sf, 2)), 2, corner)


QUERIES["op_f4_own_segments"] = _own_segments
ORACLES["op_f4_own_segments"] = duck("emb", _vector_lines_sql(2) + _SEGMENTS + f""",
ce AS (SELECT (i % 64)::DOUBLE AS cx, (i // 64)::DOUBLE AS cy FROM range(4096) t(i)),
m3 AS (SELECT line, cx, cy, seg, greatest(abs(cx - x0), abs(cy - y0)) AS d, start / total AS pos FROM sg, ce),
m4 AS (SELECT line, cx, cy, min(struct_pack(d := d, seg := seg, pos := pos)) AS s FROM m3 GROUP BY ALL),
fd AS (SELECT line, cx::INT AS x, cy::INT AS y, trunc(((s.d + 1.0) * (s.d + 1.0) - 1.0) * 1024.0)::INT AS dist, {", ".join(f"greatest(0, least({n - 1}, ceil(s.pos * {n - 1} - 0.5)))::INT AS i{d}" for d, n in polylines.COUNTS.items())} FROM m4)
SELECT line, (x // 8)::INT AS bx, (y // 8)::INT AS by, {_SUMS} FROM fd GROUP BY ALL""")  # fmt: skip
