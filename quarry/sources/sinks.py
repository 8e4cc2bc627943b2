"""Writers: content-addressed tables, blobs in dump order, statistics as JSON, archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.prefix import running, text_cell


def write_chunks(chunks: DataFrame, path: str, codec: str = "zstd") -> None:
    """Chunk rows as compressed Parquet, ordered inside each part."""
    chunks.sortWithinPartitions("image", "digest").write.option("compression", codec).parquet(path)


def write_in_dump_order(files: DataFrame, path: str, rank: str, parts: int) -> None:
    """Files ranged by their rank in the dump, prefetched ones first."""
    files.repartitionByRange(parts, rank).sortWithinPartitions(rank).write.parquet(path)


def content_name(rows: DataFrame, by: list[str], digest: str) -> DataFrame:
    """``name`` of each group's metadata: the hash of its sorted digests, so equal contents have equal names."""
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(digest)), ""), 256).alias("name"))


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects in one column."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("json"))


def contents_table(entries: DataFrame) -> DataFrame:
    """Table of contents of a blob (blob, name, size): offsets and a digest of the table."""
    return running(entries, ["blob"], text_cell(F.col("name")), ["name"], {"offset": F.col("size")})


def as_tar(files: DataFrame, group: str) -> DataFrame:
    """(group, archive): a tar archive of each group's files (path, content), a member at a time in path order.

    A group is an image; its archive is held by one task, as a file is.
    """
    kind = files.schema[group].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
            for path, content in frame.sort_values("path")[["path", "content"]].itertuples(index=False):
                info = tarfile.TarInfo(path.lstrip("/"))
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return pd.DataFrame({group: [key[0]], "archive": [out.getvalue()]})

    return files.groupBy(group).applyInPandas(run, f"{group} {kind}, archive binary")


def tar_round_trip(files: DataFrame, group: str) -> Iterator:
    """Files written to archives and read back."""
    from quarry.sources.formats import scan_tar

    return scan_tar(as_tar(files, group).select(F.col(group).cast("string").alias("path"), F.col("archive").alias("content")))
