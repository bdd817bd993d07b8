"""What the corpus operators share: the cluster's shared folder, staged tables, column names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and \t \n \x0B \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, seen by the driver and all executors.

    Only where it is unset (a local session, as in tests) is a temporary folder made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def stage(self, frame: DataFrame, table: str, batch_rows: int | None = None, **options: str) -> DataFrame:
        """Write the frame as Parquet and read it back. batch_rows: rows of an Arrow batch meanwhile.

        The write's shuffle files go when it is done: what it made is in the shared folder."""
        with arrow_rows(self.spark, batch_rows), setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            frame.write.options(**options).parquet(self.path(table))
        self.tables.append(table)
        return self.read(table, frame.schema)

    def read(self, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Remove staged tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str | None):
    """A session setting for a while; None leaves it as it is."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int | None):
    """Fewer rows in each Arrow batch while whole texts go through Python, so that a batch of long texts fits."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows and str(rows))


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any letter case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Words in the text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
