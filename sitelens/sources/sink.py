"""Files of any kind, written by the executors: a Python data source for rows of names and bytes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sitelens.operators.storage import workers_find_package


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        for name, content in iterator:
            path = os.path.join(self.folder, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            fresh = f"{path}.{uuid.uuid4().hex}"
            with open(fresh, "wb") as f:
                f.write(content)
            os.replace(fresh, path)  # a task that runs twice leaves one whole file
        return WriterCommitMessage()


class FileSink(DataSource):
    """Writes rows (name, content) as files below a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "sitelens_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        folder = self.options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in folder:
            raise ValueError(f"{folder}: the executors write to a folder that they share, as paths")
        return _FileWriter(folder)


def write_files(files: DataFrame, path: str) -> None:
    """Writes files (name, content) below path; one that is there already is replaced."""
    workers_find_package(files.sparkSession)
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", "content").write.format("sitelens_files").mode("append").save(path)
