"""Poly-lines in a cube of side 64: points at equal steps along them, and for every cell the distance to the line and the place on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.scalar import c, idiv

SIDE, FACTOR = 64, 128
#: Lengths count in millionths, so that sums of them are whole and do not depend on their order.
UNIT = 1_000_000
#: Points of a table by depth.
COUNTS = {6: 64, 5: 32, 4: 16, 3: 8}
#: Side of the blocks whose cells share their segments, and how far a block's cells are from its middle at most, by dimensions.
BLOCK = 8
REACH = {2: 4.9498, 3: 6.0622}
#: What is added to a place within a segment, so that ends are not cut below their whole number.
GUARD = 0.00001


def segments(points: DataFrame) -> DataFrame:
    """(line, seg, x0, y0, z0, x1, y1, z1, size, start, total) of points (line, k, x, y, z) in the order of k: lengths in UNITs, those before, the whole line's.

    Points that repeat the one before give no segment; a line of one place has none."""
    along = Window.partitionBy("line").orderBy("k")
    ahead = points.select("line", "k", *[c(a).cast("double").alias(f"{a}0") for a in "xyz"], *[F.lead(c(a).cast("double")).over(along).alias(f"{a}1") for a in "xyz"]).where("x1 is not null")
    square = sum(((F.col(f"{a}1") - F.col(f"{a}0")) * (F.col(f"{a}1") - F.col(f"{a}0")) for a in "xyz"), F.lit(0.0))
    sized = ahead.withColumn("size", F.round(F.sqrt(square) * UNIT).cast("long")).where("size > 0")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("line")
    return sized.select("line", (F.row_number().over(along) - 1).alias("seg"), *[f"{a}{e}" for e in (0, 1) for a in "xyz"], "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(whole).alias("total"))


def resample(lines: DataFrame, counts: dict[int, int] = COUNTS) -> DataFrame:
    """(line, depth, idx, fx, fy, fz) of segments: as many points as each depth has, at equal steps along the line from its first to its last, scaled to 0..128.

    A segment knows which of the points lie on it (the first segment has the first point, else the end belongs to the segment that it ends), so
    points are made and not looked up."""
    depths = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(n - 1).cast("long").alias("last")) for d, n in counts.items()])).alias("d")
    each = lines.select("*", depths).select("*", "d.*").drop("d")
    low = F.when(F.col("start") == 0, F.lit(0).cast("long")).otherwise(idiv(F.col("last") * F.col("start"), "total") + 1)
    high = idiv(F.col("last") * (F.col("start") + F.col("size")), "total")
    placed = each.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("idx", F.explode(F.sequence("low", "high")))
    local = (F.col("idx") * F.col("total") - F.col("last") * F.col("start")).cast("double") / (F.col("last") * F.col("size")).cast("double") + GUARD
    at = lambda a: ((F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * F.col("local")) / SIDE * FACTOR).cast("int").alias(f"f{a}")
    return placed.withColumn("local", local).select("line", "depth", F.col("idx").cast("int").alias("idx"), *map(at, "xyz"))


_PARTS = (*[f"{a}{e}" for e in (0, 1) for a in "xyz"], "size", "start", "total")
_FIGURES = ("dist", *[f"i{d}" for d in COUNTS])
#: Rows that a task hands on at a time.
_BATCH = 1 << 16


def _apart(place: dict, seg: dict) -> tuple:
    """Distance from places to a segment, and where along it the foot lies, not held to the segment."""
    d = {a: seg[f"{a}1"] - seg[f"{a}0"] for a in place}
    foot = sum((place[a] - seg[f"{a}0"]) * d[a] for a in place) / sum(d[a] * d[a] for a in place)
    held = np.clip(foot, 0.0, 1.0)
    off = {a: place[a] - (seg[f"{a}0"] + held * d[a]) for a in place}
    return np.sqrt(sum(off[a] * off[a] for a in place)), foot


def _slab(dims: int, slab: int) -> tuple[dict, dict]:
    """Coordinates by axis of a slab of blocks: a row for each block, a column for each cell; and the blocks' own."""
    axes, side = "xyz"[:dims], SIDE // BLOCK
    block, cell = slab * side**2 + np.arange(side**2), np.arange(BLOCK**dims)
    own = {a: block // side**k % side for k, a in enumerate(axes)}
    return {a: own[a][:, None] * float(BLOCK) + cell // BLOCK**k % BLOCK for k, a in enumerate(axes)}, own


def _nearest(place: dict, own: dict, segs: list[dict], apart) -> dict:
    """The figures of every cell of a slab, from the segments that can be nearest in its block."""
    dims, shape = len(place), next(iter(place.values())).shape
    middle = {a: v * float(BLOCK) + (BLOCK - 1) / 2 for a, v in own.items()}
    mids = np.stack([np.broadcast_to(apart(middle, seg)[0], shape[:1]) for seg in segs])
    near = mids <= mids.min(axis=0) + 2 * REACH[dims]
    best, at = np.full(shape, np.inf), np.zeros(shape)
    for seg, mine in zip(segs, near, strict=True):
        rows = np.flatnonzero(mine)
        if not len(rows):
            continue
        d, foot = apart({a: v[rows] for a, v in place.items()}, seg)
        before = best[rows]
        closer = d < before
        best[rows] = np.where(closer, d, before)
        at[rows] = np.where(closer, (seg["start"] + foot * seg["size"]) / seg["total"], at[rows])
    index = {f"i{d}": np.clip(np.ceil(at * (n - 1) - 0.5), 0, n - 1).astype(np.int32) for d, n in COUNTS.items()}
    return {"dist": (((best + 1.0) * (best + 1.0) - 1.0) * 1024.0).astype(np.int32), **index}


def _looked_at(lines: DataFrame, dims: int, apart, columns: str, made) -> DataFrame:
    """Rows of a line's slabs: made(place, own, figures) gives their columns. A slab of a line with its segments is one row, dealt over all tasks."""
    if dims == 2:
        lines = lines.where("x0 <> x1 or y0 <> y1")
    each = lines.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("seg", *_PARTS))).alias("segs"))
    slabs = F.explode(F.sequence(F.lit(0), F.lit((SIDE // BLOCK) ** (dims - 2) - 1))).alias("slab")
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = lines.schema["line"].dataType.simpleString()
    look = apart or _apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = {}

        def batch(ids, parts):
            counts = [len(next(iter(p.values()))) for p in parts]
            arrays = [ids.take(pa.array(np.repeat(np.arange(len(ids)), counts)))]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(np.concatenate([p[k] for p in parts])) for k in parts[0]], ["line", *parts[0]])

        for b in batches:
            ids, slab, segs = b.column("line"), b.column("slab").to_pylist(), b.column("segs")
            first, parts, held = 0, [], 0
            for i in range(len(slab)):
                if slab[i] not in grids:
                    grids[slab[i]] = _slab(dims, slab[i])
                place, own = grids[slab[i]]
                parts.append(made(place, own, _nearest(place, own, segs[i].as_py(), look)))
                held += len(next(iter(parts[-1].values())))
                if held >= _BATCH or i == len(slab) - 1:
                    yield batch(ids.slice(first, len(parts)), parts)
                    first, parts, held = i + 1, [], 0

    return each.select("line", slabs, "segs").repartition(tasks, "line", "slab").mapInArrow(run, f"line {kind}, {columns}")


def field(lines: DataFrame, dims: int = 3, apart=None) -> DataFrame:
    """(line, <cell coordinates>, dist, i6, i5, i4, i3) of every cell of the cube (or, with two dimensions, of the square): ((d + 1)^2 - 1) * 1024, cut, of the
    distance d to the line, and at each depth the point that is nearest along the line to the foot on the nearest segment (of equals the first).

    A block of cells is at most REACH from its middle, so only segments that come within twice that of the middle's nearest can be nearest to
    one of its cells; the others are not looked at there. Cells are made where they are measured and are not shuffled.

    apart: a caller's own segments: a function of places (arrays of coordinates by axis) and a segment (x0 to z1, size, start and total by name) that
    gives the places' distances to it and where on it they belong. A step of any length must change the distance by no more than its length."""
    axes = "xyz"[:dims]
    flat = lambda place, own, figures: {**{a: place[a].astype(np.int32).ravel() for a in axes}, **{k: figures[k].ravel() for k in _FIGURES}}
    return _looked_at(lines, dims, apart, ", ".join(f"{k} int" for k in (*axes, *_FIGURES)), flat)


def field_blocks(lines: DataFrame, dims: int = 3, apart=None) -> DataFrame:
    """(line, b<axis> ..., dist, i6, i5, i4, i3): the figures of field, summed up by blocks of BLOCK along each axis, in the task that measures the cells."""
    axes = "xyz"[:dims]
    summed = lambda place, own, figures: {**{f"b{a}": own[a].astype(np.int32) for a in axes}, **{k: figures[k].sum(axis=1, dtype=np.int64) for k in _FIGURES}}
    return _looked_at(lines, dims, apart, ", ".join([*[f"b{a} int" for a in axes], *[f"{k} long" for k in _FIGURES]]), summed)
