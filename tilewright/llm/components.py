"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def connected_components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node of its component.

    Each step hangs neighbours on the smallest of them (Kiveris et al., 2014) and is written to the shared
    folder. Minima are aggregated before they are joined back, so a node with many links is no large group;
    the join reads written tables, whose large partitions Spark splits. No links give no rows."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = ws.stage(pairs, f"{name}-0")
    step, before = 0, None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ws.stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-{step}-large-least")
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = ws.stage(larger.where("a <> b").distinct(), f"{name}-{step}-large")
        least = ws.stage(larger.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{step}-small-least")
        hung = larger.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = ws.stage(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{step}")
