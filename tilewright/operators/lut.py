"""Colours of tiles as entries of small point tables in a normalised cube: nearest entries, 48 modes, search, decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilewright.functions.scalar import AXIS_ORDERS, by, c, idiv, morton2, morton3, shl, shr, swap_axes

from . import stats

SIDE, FACTOR = 64, 128
SIZES = ((16, 8), (8, 16), (8, 8), (8, 4), (4, 8), (4, 4))
#: A depth is left when more than WRONG pixels are further than FAR from their colour.
FAR, WRONG = 5, 3
#: Tables in a bank, which goes along with functions; tiles and colours that a worker looks at together.
MOST_TABLES, _TILES, _COLORS = 64, 512, 1 << 16
#: The axis order that scoring has in effect in each of the 48 modes.
SCORED_ORDER = (
    "xyz xyz xyz xyz xyz xyz xyz xyz "
    "xzy xyz xzy xyz xzy xyz xzy xyz "
    "yxz xyz yxz xyz yxz xyz yxz xyz "
    "yzx zxy xyz yzx zxy xyz yzx zxy "
    "yzx xyz zxy yzx xyz zxy yzx xyz "
    "zyx xyz zyx xyz zyx xyz zyx xyz"
).split()


def factors(bank: DataFrame) -> DataFrame:
    """(lut_id, depth, idx, fx, fy, fz): every 1st, 2nd, 4th and 8th point for 6, 5, 4 and 3 bits, scaled to 0..128."""
    scaled = [idiv(c(k) * FACTOR, SIDE - 1).cast("int").alias(f"f{k}") for k in "xyz"]
    depths = F.explode(F.array(*[F.struct(F.lit(6 - s).alias("depth"), F.lit(1 << s).alias("step")) for s in range(4)]))
    return bank.select("lut_id", "idx", *scaled, depths.alias("d")).where(c("idx") % F.col("d.step") == 0).select("lut_id", F.col("d.depth").alias("depth"), idiv("idx", F.col("d.step")).cast("int").alias("idx"), "fx", "fy", "fz")


def tables_of(bank: DataFrame) -> dict[int, np.ndarray]:
    """The points of each table as rows (idx, x, y, z) in the order of idx. ValueError beyond MOST_TABLES tables of SIDE points."""
    rows = bank.select("lut_id", "idx", "x", "y", "z").limit(MOST_TABLES * SIDE + 1).collect()
    if len(rows) > MOST_TABLES * SIDE:
        raise ValueError(f"a bank has at most {MOST_TABLES} tables of {SIDE} points")
    tables: dict[int, list[tuple]] = {}
    for r in sorted(rows):
        tables.setdefault(r.lut_id, []).append((r.idx, r.x, r.y, r.z))
    return {lut_id: np.array(points, np.int64) for lut_id, points in tables.items()}


def _nearest(points: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For places (n, 3) the row of the nearest of every step-th point, of equals the first."""
    kept = np.flatnonzero(points[:, 0] % step == 0)
    return kept[sum((at[:, k, None] - points[None, kept, k + 1]) ** 2 for k in range(3)).argmin(axis=1)]


def _field(points: np.ndarray) -> np.ndarray:
    """The squared distance from each cell of the cube, its index being that of x, y and z in base SIDE, to the nearest of every 8th point."""
    kept = points[points[:, 0] % 8 == 0, 1:]
    if not len(kept):
        raise ValueError("a table has no point that stays with 3 bits")
    square = [(np.arange(SIDE)[None] - kept[:, k, None]) ** 2 for k in range(3)]
    return np.minimum.reduce([x[:, None, None] + y[None, :, None] + z[None, None, :] for x, y, z in zip(*square, strict=True)]).astype(np.int32).ravel()


def cells(bank: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lut_id, cx, cy, cz, dist, i6, i5, i4, i3): for cells wanted (cx, cy, cz), the squared distance to the nearest
    of every 8th point, and the nearest entry at each depth, of equals the first.

    The bank goes along with the function; each batch of cells is compared with all points of a table at once."""
    tables = tables_of(bank)
    kind = wanted.select("cx", "cy", "cz").schema
    numbers = ["dist", "i6", "i5", "i4", "i3"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("cx", "cy", "cz")], axis=1).astype(np.int64)
            for lut_id, points in tables.items():
                apart = sum((at[:, k, None] - points[None, :, k + 1]) ** 2 for k in range(3))
                dist, best = None, []
                for step in (1, 2, 4, 8):
                    kept = np.flatnonzero(points[:, 0] % step == 0)
                    if not len(kept):
                        dist = None
                        best.append(pa.nulls(len(at), pa.int32()))
                        continue
                    first = apart[:, kept].argmin(axis=1)  # of equals the least index
                    best.append(pa.array((points[kept, 0][first] // step).astype(np.int32)))
                    dist = apart[np.arange(len(at)), kept[first]].astype(np.int32)
                far = pa.nulls(len(at), pa.int32()) if dist is None else pa.array(dist)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lut_id, np.int32)), *(batch.column(k) for k in ("cx", "cy", "cz")), far, *best], ["lut_id", "cx", "cy", "cz", *numbers])

    schema = T.StructType([T.StructField("lut_id", T.IntegerType()), *kind.fields, *[T.StructField(n, T.IntegerType()) for n in numbers]])
    return wanted.select("cx", "cy", "cz").mapInArrow(near, schema)


def normalised(pixels: DataFrame, channels: list[str], free: Column, tw: int, th: int) -> DataFrame:
    """(ty, tx, y, x, <channels>, <channel>0/1 ..., ix, iy, iz) of the free pixels of tiles worth a table: wholly inside,
    and not flat in two axes or more. ix, iy, iz: place in the tile's own cube of side 64."""
    box = stats.color_box(pixels, channels, free, th, tw)
    wide = sum((F.col(f"{n}1") > F.col(f"{n}0")).cast("int") for n in channels)
    tiles = box.where(F.col("whole") & (F.col("cnt") > 0) & (wide >= 2)).drop("whole", "cnt")
    tiled = pixels.where(free).select(*by(pixels), "y", "x", *channels, *stats.tile(th, tw)).join(tiles, [*by(pixels), "ty", "tx"])

    def place(n: str) -> Column:
        """Through a reciprocal in 20 bits and single precision, cut."""
        span = F.col(f"{n}1") - F.col(f"{n}0")
        step = F.when(span > 0, idiv(F.lit(1 << 20), F.when(span > 0, span))).otherwise(0)
        part = (((c(n) - F.col(f"{n}0")) * step).cast("float") / float(1 << 20)).cast("float")
        return (part * F.lit(63.0).cast("float")).cast("int")

    return tiled.select("*", *[place(n).alias(f"i{k}") for n, k in zip(channels, "xyz", strict=True)])


def occupancy(places: DataFrame) -> DataFrame:
    """(ix, iy, iz, cnt) over all tiles."""
    return places.groupBy("ix", "iy", "iz").agg(F.count("*").alias("cnt"))


#: Of each mode the axis order that scoring has and the bits that flip a cell's index: 63 - v is v with all six bits turned.
_MODES_3D = [([*map("xyz".index, order)], sum(63 << 6 * (2 - k) for k in range(3) if m >> k & 1)) for m, order in enumerate(SCORED_ORDER)]
_MODES_2D = [([1, 0, 2] if m & 4 else [0, 1, 2], sum(63 << 6 * (2 - k) for k in range(2) if m >> k & 1)) for m in range(8)]


def _mode_sums(field: np.ndarray, place: np.ndarray, starts: np.ndarray, kinds: list) -> np.ndarray:
    """(modes, tiles): the sums of distances of each tile's places under each mode."""
    code = {}
    for order, _ in kinds:
        x, y, z = (place[:, a] for a in order)
        code.setdefault(tuple(order), (x * SIDE + y) * SIDE + z)
    return np.stack([np.add.reduceat(field[code[tuple(order)] ^ mask], starts, dtype=np.int64) for order, mask in kinds])


def _by_tile(places: DataFrame, columns: list[str]) -> tuple[list[str], DataFrame]:
    """A row for each tile, with a list of its pixels: at most as many as a tile has."""
    keys = [*by(places), "ty", "tx"]
    found = places.dropna(subset=columns).groupBy(*keys).agg(F.collect_list(F.struct(*[c(n).cast("int").alias(n) for n in columns])).alias("pixels"))
    return keys, found


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, first pixel of each, all their pixels as a matrix), _TILES rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, _TILES):
            rows = whole.slice(at, _TILES)
            lists = rows.column(rows.num_columns - 1)
            sizes = lists.value_lengths().to_numpy()
            columns = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten()]
            yield rows, np.cumsum(sizes) - sizes, np.stack(columns, axis=1)


def _result(tiles: DataFrame, keys: list[str], numbers: dict) -> T.StructType:
    return T.StructType([*tiles.select(*keys).schema.fields, *[T.StructField(n, kind) for n, kind in numbers.items()]])


def _scores(places: DataFrame, bank: DataFrame, kinds: list) -> DataFrame:
    tables = tables_of(bank)
    keys, tiles = _by_tile(places, ["ix", "iy", "iz"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = {lut_id: _field(points) for lut_id, points in tables.items()}
        for rows, starts, place in _tiles(batches):
            for lut_id, field in fields.items():
                sums = _mode_sums(field, place, starts, kinds)
                mode = sums.argmin(axis=0)
                numbers = [np.full(len(mode), lut_id, np.int32), mode.astype(np.int32), sums[mode, np.arange(len(mode))]]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], *map(pa.array, numbers)], [*keys, "lut_id", "mode", "score"])

    return tiles.mapInArrow(score, _result(tiles, keys, {"lut_id": T.IntegerType(), "mode": T.IntegerType(), "score": T.LongType()}))


def scores(places: DataFrame, bank: DataFrame) -> DataFrame:
    """(ty, tx, lut_id, mode, score): the best of 48 modes of each table for each tile, of equals the first.

    Tiles are the only thing shuffled. A worker measures the whole cube against each table once, and a mode is
    a way to index that field."""
    return _scores(places, bank, _MODES_3D)


def _axis_number(mode) -> Column:
    return shr(mode, 3)


def search(places: DataFrame, channels: list[str], bank: DataFrame) -> DataFrame:
    """(ty, tx, lut_id, mode, depth, err) of the tiles that some table serves: of each table its best mode and the least
    depth with at most WRONG pixels that are further than FAR off; over tables the least error, of equals the last."""
    tables = tables_of(bank)
    ends = [f"{n}{k}" for n in channels for k in (0, 1)]
    keys, tiles = _by_tile(places, ["ix", "iy", "iz", *channels, *ends])
    orders = np.array([[*map("xyz".index, order)] for order in AXIS_ORDERS])
    most = np.iinfo(np.int64).max

    def turn(mode: np.ndarray, v: np.ndarray, top) -> np.ndarray:
        flipped = np.where(mode[:, None] >> np.arange(3) & 1 != 0, top - v, v)
        return np.take_along_axis(flipped, orders[mode >> 3], axis=1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = {lut_id: _field(points) for lut_id, points in tables.items()}
        for rows, starts, pixels in _tiles(batches):
            n, tile = len(starts), np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pixels)]))
            color, low, high = pixels[:, 3:6], pixels[:, 6::2], pixels[:, 7::2]
            span = high - low
            part = ((color - low).astype(np.float32) / np.maximum(span, 1)).astype(np.float32) * np.float32(63)
            best = {"lut_id": np.zeros(n, np.int32), "mode": np.zeros(n, np.int32), "depth": np.zeros(n, np.int32), "err": np.full(n, most)}
            for lut_id in sorted(tables, reverse=True):
                points = tables[lut_id]
                mode = _mode_sums(fields[lut_id], pixels[:, :3], starts, _MODES_3D).argmin(axis=0)
                turned = turn(mode[tile], part, np.float32(63)).astype(np.int64)
                code, back = np.unique((turned[:, 0] * SIDE + turned[:, 1]) * SIDE + turned[:, 2], return_inverse=True)
                at = np.stack([code // SIDE**2, code // SIDE % SIDE, code % SIDE], axis=1)
                depth, err = np.zeros(n, np.int32), np.full(n, most)
                for d in (6, 5, 4, 3):  # the least that stands comes last
                    factor = points[_nearest(points, at, 1 << 6 - d), 1:] * FACTOR // (SIDE - 1)
                    off = np.abs(low + turn(mode[tile], factor[back], FACTOR) * span // FACTOR - color).max(axis=1)
                    stands = np.add.reduceat((off > FAR).astype(np.int64), starts) <= WRONG
                    depth[stands], err[stands] = d, np.add.reduceat(off, starts)[stands]
                better = err < best["err"]
                for name, value in (("lut_id", np.full(n, lut_id)), ("mode", mode), ("depth", depth), ("err", err)):
                    best[name][better] = value[better]
            served = pa.array(best["err"] < most)
            made = pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], *map(pa.array, best.values())], [*keys, *best])
            yield made.filter(served)

    number = T.IntegerType()
    return tiles.mapInArrow(find, _result(tiles, keys, {"lut_id": number, "mode": number, "depth": number, "err": T.LongType()}))


def _entries(pixels: DataFrame, bank: DataFrame) -> DataFrame:
    """The pixels (lut_id, depth, cx, cy, cz, ...) whose table there is, with the nearest entry at their depth, idx, and its fx, fy, fz."""
    tables = tables_of(bank)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _COLORS):
                rows = whole.slice(first, _COLORS)
                number = lambda n, rows=rows: rows.column(n).to_numpy(zero_copy_only=False)
                of, depth, at = number("lut_id"), number("depth"), np.stack([number(n) for n in ("cx", "cy", "cz")], axis=1).astype(np.int64)
                factor, entry = np.full((len(at), 3), -1, np.int32), np.full(len(at), -1, np.int32)
                for lut_id, points in tables.items():
                    for d in (6, 5, 4, 3):
                        mine = np.flatnonzero((of == lut_id) & (depth == d))
                        if len(mine):
                            found = _nearest(points, at[mine], 1 << 6 - d)
                            factor[mine], entry[mine] = points[found, 1:] * FACTOR // (SIDE - 1), points[found, 0] >> 6 - d
                made = pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(factor[:, k]) for k in range(3)], pa.array(entry)], [*rows.schema.names, "fx", "fy", "fz", "idx"])
                yield made.filter(pa.array(factor[:, 0] >= 0))

    return pixels.mapInArrow(find, T.StructType([*pixels.schema.fields, *[T.StructField(n, T.IntegerType()) for n in ("fx", "fy", "fz", "idx")]]))


def entries(places: DataFrame, choice: DataFrame, channels: list[str], bank: DataFrame) -> DataFrame:
    """(ty, tx, y, x, lut_id, mode, depth, idx, fx, fy, fz, <channel>0/1 ...): the entry that each pixel of the chosen tiles takes; axes are flipped and then
    swapped on the way to the table."""
    keys = [*by(places), "ty", "tx"]
    pixels = places.join(choice.select(*keys, "lut_id", "mode", "depth"), keys)
    rel = lambda n: (((c(n) - F.col(f"{n}0")).cast("float") / F.greatest(F.col(f"{n}1") - F.col(f"{n}0"), F.lit(1))).cast("float") * F.lit(63.0).cast("float"))
    turned = [F.when(c("mode").bitwiseAND(F.lit(1 << k)) != 0, F.lit(63.0).cast("float") - rel(n)).otherwise(rel(n)).cast("int") for k, n in enumerate(channels)]
    pixels = pixels.withColumn("t", swap_axes(_axis_number("mode"), *turned)).select("*", *[F.col("t")[k].alias(f"c{k}") for k in "xyz"]).drop("t")
    return _entries(pixels.select(*keys, "y", "x", *[f"{n}{k}" for n in channels for k in (0, 1)], "lut_id", "mode", "depth", "cx", "cy", "cz"), bank).drop("cx", "cy", "cz")


def entry_colors(entries: DataFrame, channels: list[str], keep: list[str]) -> DataFrame:
    """(keep, <channels>) of rows (mode, fx, fy, fz, <channel>0/1 ...): entries swapped and then flipped, scaled by 7 bits over the box."""
    moved = swap_axes(_axis_number("mode"), "fx", "fy", "fz")
    flip = lambda k, a: F.when(c("mode").bitwiseAND(F.lit(1 << k)) != 0, F.lit(FACTOR) - moved[a]).otherwise(moved[a])
    out = [(F.col(f"{n}0") + shr(flip(k, a) * (F.col(f"{n}1") - F.col(f"{n}0")), 7)).cast("int").alias(n) for k, (n, a) in enumerate(zip(channels, "xyz", strict=True))]
    return entries.select(*keep, *out)


def decode(places: DataFrame, choice: DataFrame, channels: list[str], bank: DataFrame) -> DataFrame:
    """(y, x, <channels>) as a decoder gives them: entries swapped and then flipped, scaled by 7 bits over the tile's box."""
    return entry_colors(entries(places, choice, channels, bank), channels, [*by(places), "y", "x"])


def palette_order(colors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, r, g, b, code): palettes, which the keys tell apart, in the order of their interleaved bits."""
    return colors.withColumn("code", morton3("r", "g", "b")).withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("code", "r", "g", "b")) - 1)


def palette_order_2d(colors: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """(keys, <channels>, code, idx): two-channel palettes, which the keys tell apart, in the order of their interleaved bits."""
    code = morton2(*channels)
    return colors.select(*keys, *channels, code.alias("code")).withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("code", *channels)) - 1)


def reduce_points(points: DataFrame, size: str, most: int, keys: list[str]) -> DataFrame:
    """(keys, idx, x, y, z): sequences of more than most points cut to most, by the mean of each bucket."""
    bucket = F.when(c(size) > most, idiv(c("idx") * most, size)).otherwise(c("idx")).cast("int")
    means = [idiv(F.sum(k), F.count("*")).cast("int").alias(k) for k in "xyz"]
    return points.groupBy(*keys, bucket.alias("idx")).agg(*means)


def pack_file_bytes(bank: DataFrame) -> DataFrame:
    """(depth, lut_id, data): the bytes of the X run, the Y run and the Z run, by depth from 3 up and table."""
    return pack_runs(factors(bank))


def pack_runs(scaled: DataFrame, axes: str = "xyz", keys: tuple[str, ...] = ()) -> DataFrame:
    """pack_file_bytes of factors, with the runs of these axes; keys tell files apart."""
    one = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", k))), lambda s: F.lpad(F.hex(s[k]), 2, "0")), "")
    return scaled.groupBy(*keys, "depth", "lut_id").agg(F.unhex(F.concat(*[one(f"f{a}") for a in axes])).alias("data"))


def cascade_entries(pixels: DataFrame, channels: list[str], bank: DataFrame, free: Column | None = None, sizes=SIZES) -> DataFrame:
    """(pass, tw, th, err, and the columns of entries) of the pixels that tables take, over all sizes, each trying the pixels that those before
    have left of the free ones. A pass is written with checkpoint() once; what is left is what no pass before holds."""
    from .gradient import checkpointed

    keys = [*by(pixels), "y", "x"]
    pixels, out = pixels.withColumn("free", F.lit(True) if free is None else free), None
    for k, (tw, th) in enumerate(sizes):
        left = pixels
        if out is not None:
            left = pixels.join(out.select(*keys, F.lit(True).alias("_held")), keys, "left").withColumn("free", F.col("free") & F.col("_held").isNull()).drop("_held")
        places = normalised(left, channels, F.col("free"), tw, th)
        tiles = search(places, channels, bank)
        taken = entries(places, tiles, channels, bank).join(tiles.select(*by(pixels), "ty", "tx", "err"), [*by(pixels), "ty", "tx"])
        named = checkpointed(taken.select(F.lit(k).alias("pass"), F.lit(tw).alias("tw"), F.lit(th).alias("th"), *taken.columns))
        out = named if out is None else out.unionByName(named)
    return out


def cascade(pixels: DataFrame, channels: list[str], bank: DataFrame, sizes=SIZES) -> DataFrame:
    """(pass, tw, th, ty, tx, lut_id, mode, depth, err) over all sizes, each trying the pixels that those before have left."""
    from .gradient import checkpointed, covered

    keys = [*by(pixels), "y", "x"]
    free, out = checkpointed(pixels.withColumn("free", F.lit(True))), None
    for k, (tw, th) in enumerate(sizes):
        places = normalised(free, channels, F.col("free"), tw, th)
        tiles = checkpointed(search(places, channels, bank))
        named = tiles.select(F.lit(k).alias("pass"), F.lit(tw).alias("tw"), F.lit(th).alias("th"), *tiles.columns)
        out = named if out is None else out.unionByName(named)
        taken = covered(tiles, tw, th).withColumn("taken", F.lit(True))
        free = checkpointed(free.join(taken, keys, "left").select(*pixels.columns, (F.col("free") & F.col("taken").isNull()).alias("free")))
    return out


#: Of two-channel tables no pixel may be further off.
FAR_2D = 6


def normalised_2d(pixels: DataFrame, channels: list[str], free: Column, tw: int, th: int) -> DataFrame:
    """As normalised, for two channels: tiles that are flat in neither, with places ix, iy."""
    third = pixels.withColumn("_zero", F.lit(0))
    return normalised(third, [*channels, "_zero"], free, tw, th).drop("_zero", "_zero0", "_zero1", "iz")


def _flat(bank: DataFrame) -> DataFrame:
    return bank.select("lut_id", "idx", "x", "y", F.lit(0).alias("z"))


def scores_2d(places: DataFrame, bank: DataFrame) -> DataFrame:
    """(ty, tx, lut_id, mode, score): the best of eight modes (flip x, flip y, after a swap), of equals the first."""
    return _scores(places.withColumn("iz", F.lit(0)), _flat(bank), _MODES_2D)


def _turned_2d(places: DataFrame, choice: DataFrame, channels: list[str], keep: list[str]) -> DataFrame:
    """The pixels of chosen tiles with the cell (cx, cy, cz) that they take, axes flipped and then swapped on the way to the table."""
    keys = [*by(places), "ty", "tx"]
    pixels = places.join(choice.select(*keys, *keep), keys)
    bit = lambda k: c("mode").bitwiseAND(F.lit(1 << k)) != 0
    one = F.lit(63.0).cast("float")
    rel = [((c(n) - F.col(f"{n}0")).cast("float") / (F.col(f"{n}1") - F.col(f"{n}0"))).cast("float") * one for n in channels]
    p, q = (F.when(bit(k), one - v).otherwise(v).cast("int") for k, v in enumerate(rel))
    return pixels.select("*", F.when(bit(2), q).otherwise(p).alias("cx"), F.when(bit(2), p).otherwise(q).alias("cy"), F.lit(0).alias("cz"))


def search_2d(places: DataFrame, channels: list[str], bank: DataFrame, far: int = FAR_2D, depths: tuple[int, ...] = (6, 5, 4, 3)) -> DataFrame:
    """(ty, tx, lut_id, mode, depth, err): as search, for two channels; a depth stands when no pixel is further than far off."""
    keys = [*by(places), "ty", "tx"]
    pixels = _turned_2d(places, scores_2d(places, bank), channels, ["lut_id", "mode"])
    bit = lambda k: c("mode").bitwiseAND(F.lit(1 << k)) != 0
    near = cells(_flat(bank), pixels.select("cx", "cy", "cz").distinct()).drop("dist", "cz")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"i{d}").alias("idx")) for d in depths])).alias("s")
    ends = [f"{n}{k}" for n in channels for k in (0, 1)]
    long = pixels.join(near, ["lut_id", "cx", "cy"]).select(*keys, "lut_id", "mode", *channels, *ends, each).select("*", "s.*").drop("s")
    entry = long.join(F.broadcast(factors(_flat(bank))), ["lut_id", "depth", "idx"])
    fx, fy = (F.when(bit(k), F.lit(FACTOR) - c(f)).otherwise(c(f)) for k, f in enumerate(("fx", "fy")))
    back = (F.when(bit(2), fy).otherwise(fx), F.when(bit(2), fx).otherwise(fy))
    error = F.greatest(*[F.abs(F.col(f"{n}0") + idiv(b * (F.col(f"{n}1") - F.col(f"{n}0")), FACTOR) - c(n)) for n, b in zip(channels, back, strict=True)])
    served = entry.withColumn("e", error).groupBy(*keys, "lut_id", "mode", "depth").agg(F.max("e").alias("worst"), F.sum("e").alias("err")).where(F.col("worst") <= far)
    least = served.groupBy(*keys, "lut_id", "mode").agg(F.min(F.struct("depth", "err")).alias("d"))
    best = F.min(F.struct(F.col("d.err").alias("err"), (-F.col("lut_id")).alias("l"), "mode", F.col("d.depth").alias("depth"))).alias("b")
    return least.groupBy(*keys).agg(best).select(*keys, (-F.col("b.l")).alias("lut_id"), F.col("b.mode").alias("mode"), F.col("b.depth").alias("depth"), F.col("b.err").alias("err"))


def decode_2d(places: DataFrame, choice: DataFrame, channels: list[str], bank: DataFrame) -> DataFrame:
    """(y, x, <channels>) as a decoder gives them: entries swapped and then flipped, scaled by 7 bits over the tile's box."""
    pixels = _turned_2d(places, choice, channels, ["lut_id", "mode", "depth"])
    ends = [f"{n}{k}" for n in channels for k in (0, 1)]
    entry = _entries(pixels.select(*by(places), "y", "x", *ends, "lut_id", "mode", "depth", "cx", "cy", "cz"), _flat(bank))
    bit = lambda k: c("mode").bitwiseAND(F.lit(1 << k)) != 0
    moved = (F.when(bit(2), c("fy")).otherwise(c("fx")), F.when(bit(2), c("fx")).otherwise(c("fy")))
    out = [(F.col(f"{n}0") + shr(F.when(bit(k), F.lit(FACTOR) - v).otherwise(v) * (F.col(f"{n}1") - F.col(f"{n}0")), 7)).cast("int").alias(n) for k, (n, v) in enumerate(zip(channels, moved, strict=True))]
    return entry.select(*by(places), "y", "x", *out)
