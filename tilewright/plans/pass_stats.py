"""Figures of passes: gathered in each pass's own job, appended to a folder, and summed up over runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tilewright.sources.files import write_files

FIGURES = "run string, technique string, tile int, tiles long, pixels long"


class PassStats:
    """The figures of one run: observe() counts a pass's tiles as its job writes them, so no table is scanned again; append() adds a file to a folder.

    The file appears whole or not at all, under the run's own name: a run that is appended again is written over, runs at the same time do not meet."""

    def __init__(self, run: str | None = None):
        self.run, self.seen = run or uuid.uuid4().hex[:12], []

    def observe(self, tiles: DataFrame, number: int, tw: int, th: int) -> DataFrame:
        seen = Observation()
        self.seen.append((str(number), tw * th, seen))
        return tiles.observe(seen, F.count(F.lit(1)).alias("tiles"))

    def figures(self) -> list[dict]:
        """A row for each pass that found tiles; passes that have not run yet are waited for."""
        found = [(name, size, seen.get["tiles"]) for name, size, seen in self.seen]
        return [{"run": self.run, "technique": name, "tile": size, "tiles": n, "pixels": n * size} for name, size, n in found if n]

    def append(self, spark: SparkSession, path: str) -> None:
        lines = "\n".join(json.dumps(x) for x in self.figures())
        write_files(spark.createDataFrame([(f"{self.run}.json", lines.encode())], "name string, data binary"), path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """FIGURES of all runs in a folder."""
    return spark.read.schema(FIGURES).json(path)


def totals(figures: DataFrame) -> DataFrame:
    """(technique, tile, tiles, pixels) over runs, with totals by rollup."""
    named = figures.select(F.col("technique"), F.col("tile").cast("string").alias("tile"), "tiles", "pixels").rollup("technique", "tile")
    return named.agg(F.sum("tiles").alias("tiles"), F.sum("pixels").alias("pixels")).na.fill("all", ["technique", "tile"])
