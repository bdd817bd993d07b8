"""Names of all raster and tile queries, with their DuckDB twins."""

from __future__ import annotations

from . import codec, lines, pixels, pngs, scalars, tiles

_PARTS = (scalars, pixels, tiles, codec, pngs, lines)


def flagship(spark, sf_dir):
    return tiles.QUERIES["op_e10_quantise"](spark, sf_dir)


def queries():
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql():
    return {k: v for part in _PARTS for k, v in part.ORACLES.items()}
