"""A kept chunk store: tables of Parquet files that are inserted into, looked up, deleted from and listed.

A table is a folder of generations. An insert adds one with the rows that no earlier generation has;
a delete adds the keys that went. Readers take what is committed when they begin, so a job that is
lost leaves the table as it was. One writer a table at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.dedup import insert_or_ignore
from quarry.operators.prefix import running


class ChunkStore:
    """Rows of one schema, unique by some columns, each owned by a blob."""

    def __init__(self, spark: SparkSession, path: str, unique: list[str], owner: str) -> None:
        self.spark, self.path, self.unique, self.owner = spark, path.rstrip("/"), unique, owner

    def _generations(self, kind: str) -> list[tuple[int, str]]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        done = [n for n in names if n.endswith(f"-{kind}") and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted((int(n.split("-")[0]), f"{self.path}/{n}") for n in done)

    def _next(self, kind: str) -> str:
        last = max((n for k in ("rows", "gone") for n, _ in self._generations(k)), default=0)
        return f"{self.path}/{last + 1:08}-{kind}"

    def rows(self) -> DataFrame | None:
        """All rows there are; None before the first insert."""
        gone = self._generations("gone")
        kept = []
        for number, path in self._generations("rows"):
            part = self.spark.read.parquet(path)
            later = [self.spark.read.parquet(p) for n, p in gone if n > number]
            kept.append(part.join(reduce(DataFrame.unionByName, later).distinct(), self.owner, "left_anti").select(*part.columns) if later else part)
        return reduce(DataFrame.unionByName, kept) if kept else None

    def insert(self, rows: DataFrame, order: list[str]) -> None:
        """Add the first row by ``order`` of each key that isn't there."""
        fresh, old = insert_or_ignore(rows, self.unique, order), self.rows()
        if old is not None:
            fresh = fresh.join(old.select(*self.unique), self.unique, "left_anti")
        fresh.write.parquet(self._next("rows"))

    def delete(self, owners: DataFrame) -> None:
        """Remove the rows of the given owners."""
        owners.select(self.owner).distinct().write.parquet(self._next("gone"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``keys`` with the row of each that is there."""
        return keys.join(self.rows(), self.unique)

    def pages(self, order: list[str], size: int) -> DataFrame:
        """All rows with their page; ``order`` begins with a number. Going through the pages until one is empty reads all."""
        numbered = running(self.rows().withColumn("__all", F.lit(0)), ["__all"], F.floor(F.col(order[0]) / (1 << 16)), order, {}, index="page")
        return numbered.withColumn("page", F.floor(F.col("page") / size).cast("bigint")).drop("__all")
