"""Compaction: blobs that are used too little are rebuilt, small ones merged, unused ones dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.prefix import CELL, running


def greedy_merge(blobs: DataFrame, blob: str, size: str, most: int) -> DataFrame:
    """(blob, merged, offset): blobs in order of size, each added to the open one while the total stays within ``most``.

    What is open depends on all blobs before, so they pass through one task, which holds one open
    blob and a batch of rows. A blob table has a row a blob, few against chunks.
    """
    kind = blobs.schema[blob].dataType.simpleString()
    rows = blobs.filter(F.col(size) <= most).select(F.col(blob).alias("b"), F.col(size).cast("bigint").alias("s"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, filled = 0, 0
        for frame in frames:
            numbers, offsets = [], []
            for s in frame["s"]:
                if filled and filled + s > most:
                    number, filled = number + 1, 0
                numbers.append(number)
                offsets.append(filled)
                filled += s
            yield pd.DataFrame({"b": frame["b"], "merged": numbers, "offset": offsets})

    listed = rows.repartition(1).sortWithinPartitions("s", "b")
    return listed.mapInPandas(run, f"b {kind}, merged bigint, offset bigint").withColumnRenamed("b", blob)


#: What becomes of a blob.
KEEP, REBUILD, DROP = "keep", "rebuild", "drop"


def blob_states(chunks: DataFrame, used: DataFrame, blob: str, least_percent: int) -> DataFrame:
    """(blob, state, used_bytes, bytes): a blob none of whose chunks is in use is dropped, one used below ``least_percent`` rebuilt.

    ``chunks`` (blob, digest, comp_size) are all chunks that the blobs hold, ``used`` the digests in use.
    """
    one = chunks.groupBy(blob, "digest").agg(F.max("comp_size").alias("one"), F.sum("comp_size").alias("every"))
    known = one.join(used.select("digest").distinct().withColumn("__used", F.lit(True)), "digest", "left")
    sums = known.groupBy(blob).agg(F.coalesce(F.sum(F.when(F.col("__used"), F.col("one"))), F.lit(0)).alias("used_bytes"), F.sum("every").alias("bytes"))
    state = F.when(F.col("used_bytes") == 0, DROP).when(F.col("used_bytes") * 100 < F.col("bytes") * least_percent, REBUILD).otherwise(KEEP)
    return sums.select(blob, state.alias("state"), "used_bytes", "bytes")


def rebuilt(chunks: DataFrame, used: DataFrame, blob: str, least_percent: int, most: int) -> DataFrame:
    """(blob, digest, merged, new_offset): where each chunk in use of the blobs to rebuild goes, one copy a digest and blob.

    Blobs to rebuild are merged by ``greedy_merge`` in order of their used bytes; one of more than
    ``most`` is rebuilt alone (``merged`` is null). Offsets pack the chunks of a new blob by old blob and digest.
    """
    states = blob_states(chunks, used, blob, least_percent).filter(F.col("state") == REBUILD).select(blob, "used_bytes")
    merged = greedy_merge(states, blob, "used_bytes", most).withColumnRenamed("offset", "__base")
    live = chunks.join(used.select("digest").distinct(), "digest", "left_semi").groupBy(blob, "digest").agg(F.max("comp_size").alias("one"))
    mine = live.join(states.select(blob), blob)
    first = F.conv(F.substring("digest", 1, 4), 16, 10).cast("bigint")
    laid = running(mine, [blob], first, ["digest"], {"__offset": F.col("one")})
    placed = laid.join(merged, blob, "left")
    return placed.select(blob, "digest", "merged", (F.col("__offset") + F.coalesce("__base", F.lit(0))).alias("new_offset"))


def hot_blob(chunks: DataFrame, wanted: DataFrame, file: str = "ino") -> DataFrame:
    """(ino, idx, digest, new_offset): the blob to prefetch, the chunks of wanted files in their order, each digest where it is first.

    ``wanted`` has ino and rank, the file's number in prefetch order. Chunks keep their compressed form.
    """
    listed = chunks.join(wanted.select(file, "rank"), file)
    first = listed.groupBy("digest").agg(F.min(F.struct("rank", file, "idx")).alias("__first"))
    own = listed.join(first, "digest").filter(F.struct("rank", file, "idx") == F.col("__first")).withColumn("__all", F.lit(0))
    laid = running(own, ["__all"], F.floor(F.col("rank") / CELL), ["rank", file, "idx"], {"new_offset": F.col("comp_size")})
    return laid.select(file, "idx", "digest", "new_offset")
