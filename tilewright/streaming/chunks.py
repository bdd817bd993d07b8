"""Order of chunks: a check over files at rest, and container folders as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.sources.container import MAGIC, STATES, chunks_of


def order_errors(chunks: DataFrame) -> DataFrame:
    """(path, seq, tag, error) of chunks with an unknown tag, or whose state is before that of a chunk earlier in the file."""
    state = F.element_at(F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.lit(v))]), F.col("tag"))
    known = F.col("tag").isin(*STATES)
    reached = F.max("state").over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    staged = chunks.select("path", "seq", "tag", F.when(known, state).alias("state")).withColumn("reached", reached)
    error = F.when(F.col("state").isNull(), "unknown tag").when(F.col("state") < F.col("reached"), "wrong order")
    return staged.select("path", "seq", "tag", error.alias("error")).where("error is not null")


def stream_chunks(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """The chunks of containers as they come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.tile").load(path)
    return chunks_of(files, magic)
