"""``spark.read.format("quarry_tar")``: entries of tar archives as a data source."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_Archive]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        with tarfile.open(partition.path, mode="r:*") as tar:
            for m in tar:
                yield partition.path, "/" + m.name.removeprefix("./").strip("/"), m.size, m.mode, int(m.mtime), m.linkname or None


class TarSource(DataSource):
    """Option ``paths``: archives, separated by commas, that every executor can open, such as a mounted share."""

    @classmethod
    def name(cls) -> str:
        return "quarry_tar"

    def schema(self) -> str:
        return "archive string, path string, size bigint, mode int, mtime bigint, link string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options.get("paths", "").split(",") if p])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarSource)
