"""Planes of half and double size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.scalar import by, c, clamp, idiv

MODES = ("NEAREST_TL", "NEAREST_BR", "AVERAGE_BOX", "MAX_BOX", "MIN_BOX")


def neighbours(pixels: DataFrame, value: str) -> DataFrame:
    """(y, x, a, b, c_, d): each pixel, the one to the right, below, and below right; beyond the edge, the edge."""
    keys = by(pixels)
    right = F.coalesce(F.lead(c(value)).over(Window.partitionBy(*keys, "y").orderBy("x")), c(value))
    below = lambda k: F.coalesce(F.lead(k).over(Window.partitionBy(*keys, "x").orderBy("y")), F.col(k))
    return pixels.select(*keys, "y", "x", c(value).alias("a"), right.alias("b")).select(*keys, "y", "x", "a", "b", below("a").alias("c_"), below("b").alias("d"))


def down(pixels: DataFrame, value: str, mode: str, half_x: bool, half_y: bool) -> DataFrame:
    """(y, x, v). Where one axis is halved, the nearest-bottom-right, largest and least modes read the neighbour
    across the other axis, as defined; reads beyond the plane take its edge."""
    a, b, c_, d = (F.col(k) for k in ("a", "b", "c_", "d"))
    both, one_x = half_x and half_y, half_x
    v: Column = {
        "NEAREST_TL": a,
        "NEAREST_BR": d if both else c_ if one_x else b,
        "AVERAGE_BOX": idiv(a + b + c_ + d, 4) if both else idiv(a + b, 2) if one_x else idiv(a + c_, 2),
        "MAX_BOX": F.greatest(a, b, c_, d) if both else F.greatest(a, c_) if one_x else F.greatest(a, b),
        "MIN_BOX": F.least(a, b, c_, d) if both else F.least(a, c_) if one_x else F.least(a, b),
    }[mode] if half_x or half_y else a
    sx, sy = (2 if half_x else 1), (2 if half_y else 1)
    kept = neighbours(pixels, value).where((c("y") % sy == 0) & (c("x") % sx == 0))
    return kept.select(*by(pixels), idiv("y", sy).cast("int").alias("y"), idiv("x", sx).cast("int").alias("x"), v.cast("int").alias("v"))


def up(pixels: DataFrame, value: str, double_x: bool, double_y: bool, smooth: bool) -> DataFrame:
    """(y, x, v): each pixel once or twice in each direction, with means of its neighbours between where smooth."""
    got = neighbours(pixels, value)
    a, b, c_, d = (F.col(k) for k in ("a", "b", "c_", "d"))
    out = []
    for dy in (0, 1) if double_y else (0,):
        for dx in (0, 1) if double_x else (0,):
            v = a
            if smooth and (dx or dy):
                v = idiv(a + b + c_ + d, 4) if dx and dy else idiv(a + b, 2) if dx else idiv(a + c_, 2)
            out.append(F.struct((c("y") * (2 if double_y else 1) + dy).alias("y"), (c("x") * (2 if double_x else 1) + dx).alias("x"), v.cast("int").alias("v")))
    return got.select(*by(pixels), F.explode(F.array(*out)).alias("s")).select(*by(pixels), "s.*")


def shift_edge(pixels: DataFrame, value: str, dy: int, dx: int, width: int, height: int) -> DataFrame:
    """(y, x, v): the value at an offset, at the edge where that lies beyond."""
    keys = by(pixels)
    key = pixels.select(*keys, "y", "x", clamp(c("y") + dy, 0, height - 1).alias("ky"), clamp(c("x") + dx, 0, width - 1).alias("kx"))
    return key.join(pixels.select(*keys, F.col("y").alias("ky"), F.col("x").alias("kx"), c(value).alias("v")), [*keys, "ky", "kx"]).select(*keys, "y", "x", "v")


def fill_between(pixels: DataFrame, value: str, keep: Column, double_x: bool, double_y: bool) -> DataFrame:
    """(y, x, v): pixels at even places stay and those between become means of the even ones around, beyond the edge of
    the last pixel; blocks whose even pixel is not to be filled (keep) stay as they are.

    Each pixel goes to its block and to those that read it, one aggregation: no line or column is ordered as a whole."""
    keys = by(pixels)
    sx, sy = (2 if double_x else 1), (2 if double_y else 1)

    def seen_by(k: Column, step: int) -> Column:
        """The blocks that read a line or column, and how far from their start it lies: its own, and the one before where it starts a block."""
        own = F.struct(idiv(k, step).alias("t"), (k % step).cast("int").alias("o"))
        if step == 1:
            return F.array(own)
        return F.when(k % step == 0, F.array(own, F.struct((idiv(k, step) - 1).alias("t"), F.lit(step).alias("o")))).otherwise(F.array(own))

    sent = pixels.select(*keys, c(value).alias("v"), keep.alias("keep"), seen_by(c("y"), sy).alias("down"), seen_by(c("x"), sx).alias("across"))
    sent = sent.select(*keys, "v", "keep", F.explode("down").alias("j"), "across").select(*keys, "v", "keep", "j", F.explode("across").alias("i"))
    reach = [(j, i) for j in range(sy + (sy > 1)) for i in range(sx + (sx > 1))]
    spots = [(j, i) for j in range(sy) for i in range(sx)]
    at = lambda j, i: (F.col("j.o") == j) & (F.col("i.o") == i)
    read = [F.max(F.when(at(j, i), F.col("v"))).alias(f"v{j}{i}") for j, i in reach]
    there = [F.max(at(j, i)).alias(f"is{j}{i}") for j, i in spots]
    blocks = sent.groupBy(*keys, F.col("j.t").alias("ty"), F.col("i.t").alias("tx")).agg(*read, *there, F.max(F.when(at(0, 0), F.col("keep"))).alias("keep"))
    # a step on, or the last pixel of the line
    down = lambda i, n: F.coalesce(*[F.col(f"v{j}{i}") for j in range(n, -1, -1)])
    ahead = lambda n, m: F.coalesce(*[down(i, n) for i in range(m, -1, -1)])
    fill = {}
    if double_x:
        fill[0, 1] = idiv(F.col("v00") + ahead(0, 2), 2)
    if double_y:
        fill[1, 0] = idiv(F.col("v00") + ahead(2, 0), 2)
    if double_x and double_y:
        fill[1, 1] = idiv(F.col("v00") + ahead(0, 2) + ahead(2, 0) + ahead(2, 2), 4)
    kind = pixels.select(c(value)).schema[0].dataType
    y, x = (pixels.schema[k].dataType for k in "yx")

    def spot(j: int, i: int) -> Column:
        own = F.col(f"v{j}{i}")
        new = F.when(~F.col("keep"), F.coalesce(fill[j, i].cast("int").cast(kind), own)).otherwise(own) if (j, i) in fill else own
        return F.when(F.col(f"is{j}{i}"), F.struct((c("ty") * sy + j).cast(y).alias("y"), (c("tx") * sx + i).cast(x).alias("x"), new.alias("v")))

    whole = F.explode(F.filter(F.array(*[spot(j, i) for j, i in spots]), lambda p: p.isNotNull())).alias("p")
    return blocks.select(*keys, whole).select(*keys, "p.*")


#: Side of the blocks that are filled at a time, in even places.
EVEN_BLOCK = 256
_PACKED = "image_id int, bj int, bi int, high int, wide int, least int, most int, there binary, keep binary, old binary"
_EDGES = "image_id int, bj int, bi int, open boolean, low_down array<int>, high_down array<int>, low_right array<int>, high_right array<int>"


def _packed(rows, size: int):
    """The pixels of a block in arrays: those that are there, those that are kept, and their values. Even places that are missing count as kept and 0."""
    import numpy as np
    import pandas as pd

    bj, bi = int(rows.bj.iloc[0]), int(rows.bi.iloc[0])
    y, x = rows.y.to_numpy() - 2 * size * bj, rows.x.to_numpy() - 2 * size * bi
    high, wide = int(y.max()) // 2 + 1, int(x.max()) // 2 + 1
    there, keep, old = np.zeros((2 * high, 2 * wide), bool), np.ones((2 * high, 2 * wide), bool), np.zeros((2 * high, 2 * wide), np.int32)
    there[y, x], keep[y, x], old[y, x] = True, rows.keep.fillna(True).astype(bool), rows.v
    even = old[::2, ::2]
    return pd.DataFrame([(int(rows.image_id.iloc[0]), bj, bi, high, wide, int(even.min()), int(even.max()), there.tobytes(), keep.tobytes(), old.tobytes())], columns=[f.split()[0] for f in _PACKED.split(", ")])


def _filled(old, keep, top, left, corner, first_row: bool, first_column: bool):
    """What a block's even places become, with the line above and the one to the left: a diagonal at a time, as each reads those to the left, above and
    above left. top, left and corner have a row for each way in that is tried."""
    import numpy as np

    high, wide = old.shape
    done = np.zeros((len(corner), high + 1, wide + 1), np.int64)
    done[:, 0, 1:], done[:, 1:, 0], done[:, 0, 0] = top, left, corner
    for d in range(high + wide - 1):
        j = np.arange(max(0, d - wide + 1), min(high - 1, d) + 1)
        i = d - j
        on_top, on_left, own = first_row & (j == 0), first_column & (i == 0), old[j, i]
        near = np.where(on_left, own, done[:, j + 1, i])
        up = np.where(on_top, own, done[:, j, i + 1])
        far = np.where(on_top, near, np.where(on_left, up, done[:, j, i]))
        whole = far + up + near + own
        done[:, j + 1, i + 1] = np.where(keep[j, i], own, np.sign(whole) * (np.abs(whole) // 4))
    return done


def _block_of(r) -> tuple:
    import numpy as np

    shape = (2 * r.high, 2 * r.wide)
    return np.frombuffer(r.there, bool).reshape(shape), np.frombuffer(r.keep, bool).reshape(shape), np.frombuffer(r.old, np.int32).reshape(shape).astype(np.int64)


def _ways_in(r, low: int, most: int, known: bool) -> tuple:
    """The least and the most that the line above, the one to the left and the corner can be: what the blocks there have found, 0 where there is none."""
    import numpy as np

    if not known:
        ends = np.array([low, most])
        return np.repeat(ends[:, None], r.wide, 1), np.repeat(ends[:, None], r.high, 1), ends

    def two(name: str, n: int):
        found = [getattr(r, f"{k}_{name}") for k in ("low", "high")]
        return np.zeros((2, n), np.int64) if found[0] is None else np.array([v[:n] for v in found], np.int64)

    return two("top", r.wide), two("left", r.high), np.array([getattr(r, f"{k}_corner") for k in ("low", "high")], dtype=np.float64)


def fill_back(pixels: DataFrame, value: str, keep: Column, width: int, height: int, block: int | None = None) -> DataFrame:
    """(y, x, v): even places that are not kept become the mean of themselves and of the even places to the left, above and above left as these have
    become; right of them stands the mean of the one above and themselves as they were, below that of the two above, and across what they were. Reads
    beyond the plane take its edge; means are cut toward zero.

    What a place becomes hangs on all before it, cut by cut, and rises with each of them. So all blocks of even places of all images are first filled
    from the least and from the most that the lines above and to the left can hold: where both give the same last line, as they do soon after places
    that are kept, that line is known whatever came before. Blocks whose last lines stay open are filled again from what those before them have found,
    until none is open: at most as many rounds as a plane has blocks along two sides. Then every block is filled at once. The width and height are even."""
    import pandas as pd

    from .gradient import checkpointed

    size = block or EVEN_BLOCK
    keys = by(pixels)
    down, across = -(-(height // 2) // size), -(-(width // 2) // size)
    image = c("image_id").cast("int") if keys else F.lit(0)
    place = [idiv("y", 2 * size).cast("int").alias("bj"), idiv("x", 2 * size).cast("int").alias("bi")]
    rows = pixels.select(image.alias("image_id"), *place, "y", "x", c(value).cast("int").alias("v"), keep.alias("keep"))
    blocks = checkpointed(rows.groupBy("image_id", "bj", "bi").applyInPandas(lambda part: _packed(part, size), _PACKED))
    ends = blocks.agg(F.least(F.min("least"), F.lit(0)).alias("low"), F.greatest(F.max("most"), F.lit(0)).alias("most")).first()
    low, most = ends.low, ends.most

    def joined(some: DataFrame, edges: DataFrame) -> DataFrame:
        """Blocks with the last lines of those above, to the left and above left."""
        at = lambda dj, di: [F.col("image_id"), (F.col("bj") + dj).alias("bj"), (F.col("bi") + di).alias("bi")]
        top = edges.select(*at(1, 0), F.col("low_down").alias("low_top"), F.col("high_down").alias("high_top"))
        left = edges.select(*at(0, 1), F.col("low_right").alias("low_left"), F.col("high_right").alias("high_left"))
        corner = edges.select(*at(1, 1), *[F.element_at(f"{k}_down", -1).alias(f"{k}_corner") for k in ("low", "high")])
        out = some
        for part in (top, left, corner):
            out = out.join(part, ["image_id", "bj", "bi"], "left")
        return out.na.fill(0, ["low_corner", "high_corner"])

    def bounds(known: bool):
        def run(batches):
            for frame in batches:
                found = []
                for r in frame.itertuples(index=False):
                    _, kept, old = _block_of(r)
                    done = _filled(old[::2, ::2], kept[::2, ::2], *_ways_in(r, low, most, known), r.bj == 0, r.bi == 0)
                    # the last line and column, where a block comes after
                    lines = [done[k, -1, 1:] if r.bj < down - 1 else done[0, -1, 1:] for k in (0, 1)] + [done[k, 1:, -1] if r.bi < across - 1 else done[0, 1:, -1] for k in (0, 1)]
                    found.append((r.image_id, r.bj, r.bi, bool((lines[0] != lines[1]).any() or (lines[2] != lines[3]).any()), *lines))
                yield pd.DataFrame(found, columns=["image_id", "bj", "bi", "open", "low_down", "high_down", "low_right", "high_right"])

        return run

    edges = checkpointed(blocks.mapInPandas(bounds(False), _EDGES))
    while not edges.where("open").isEmpty():
        again = blocks.join(edges.where("open").select("image_id", "bj", "bi"), ["image_id", "bj", "bi"], "left_semi")
        edges = checkpointed(edges.where("not open").unionByName(joined(again, edges).mapInPandas(bounds(True), _EDGES)))

    def write(batches):
        import numpy as np

        cut = lambda v: np.sign(v) * (np.abs(v) // 2)
        for frame in batches:
            for r in frame.itertuples(index=False):
                there, kept, out = _block_of(r)
                old, hold = out[::2, ::2].copy(), kept[::2, ::2]
                done = _filled(old, hold, *_ways_in(r, low, most, True), r.bj == 0, r.bi == 0)[0]
                up, far = done[:-1, 1:].copy(), done[:-1, :-1].copy()
                if r.bj == 0:
                    up[0], far[0] = old[0], done[1, :-1]
                if r.bi == 0:
                    far[:, 0] = up[:, 0]
                for (j, i), new in {(0, 0): done[1:, 1:], (0, 1): cut(up + old), (1, 0): cut(far + up), (1, 1): old}.items():
                    out[j::2, i::2] = np.where(hold, out[j::2, i::2], new)
                y, x = np.nonzero(there)
                yield pd.DataFrame({"image_id": r.image_id, "y": y + 2 * size * r.bj, "x": x + 2 * size * r.bi, "v": out[y, x]})

    whole = joined(blocks, edges).mapInPandas(write, "image_id int, y int, x int, v int")
    kinds = {k: pixels.schema[k].dataType for k in [*keys, "y", "x"]}
    return whole.select(*[F.col(k).cast(t).alias(k) for k, t in kinds.items()], "v")
