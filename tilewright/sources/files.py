"""A sink of whole files: a file for each row, renamed into place when all tasks are done."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's readers resolve it: one without a scheme is on the cluster's default file system, not on each machine's disk."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return re.sub(r"^file:/(?!/)", "file:///", whole)


class FileSink(DataSource):
    """df.write.format("tile_files").save(folder) of rows (name, data): a file for each, its folders included.

    Files are written under names of their own and renamed when all tasks are done; of an aborted job none is left."""

    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = self._store()
        store.create_dir(root)
        files = []
        for b in iterator:
            for name, data in zip(b.column("name").to_pylist(), b.column("data"), strict=True):
                folder, _, leaf = f"{root}/{name}".rpartition("/")
                store.create_dir(folder)
                held = f"{folder}/.{leaf}-{uuid.uuid4().hex}"
                with store.open_output_stream(held) as out:
                    out.write(data.as_buffer())
                files.append((held, f"{folder}/{leaf}"))
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, _ = self._store()
        for message in messages:
            for held, name in message.files:
                store.move(held, name)

    def abort(self, messages: list) -> None:
        store, _ = self._store()
        for message in messages:
            for held, _ in message.files if message else ():
                store.delete_file(held)


def write_files(files: DataFrame, path: str) -> None:
    """Write rows (name, data) as files of a folder; a file of the same name is replaced."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    files.select("name", "data").write.format("tile_files").mode("append").save(qualified(spark, path))
