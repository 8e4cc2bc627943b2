"""Ranges of bytes: chunk lookup, interval joins, request merging and layout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.prefix import CELL, CELL_BYTES, running, with_previous


def overlaps(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    """Whether two closed ranges meet; ranges that only touch do."""
    return F.greatest(a, b) <= F.least(a_end, b_end)


def range_to_chunks(requests: DataFrame, chunk_size: int) -> DataFrame:
    """Rows of ``requests`` (offset, length, n_chunks, has_hole) for each chunk index they need; files with holes need all."""
    first = F.floor(F.col("offset") / chunk_size)
    end = F.least(F.floor((F.col("offset") + F.col("length") - 1) / chunk_size) + 1, F.col("n_chunks"))
    low = F.when(F.col("has_hole"), F.lit(0).cast("bigint")).otherwise(first)
    high = F.when(F.col("has_hole"), F.col("n_chunks")).otherwise(end)
    return requests.withColumn("chunk", F.explode(F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))))


def range_join(left: DataFrame, right: DataFrame, key: str, width: int, l_off: str, l_end: str, r_off: str, r_end: str) -> DataFrame:
    """Pairs of equal key whose closed ranges meet.

    Both sides are dealt to buckets of ``width``, an equi-join Spark can shuffle; a pair is kept in
    the first bucket that both touch, so pairs aren't repeated.
    """
    bucket = lambda df, a, b: df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    joined = bucket(left, l_off, l_end).join(bucket(right, r_off, r_end), [key, "__bucket"])
    first = F.floor(F.greatest(l_off, r_off) / width)
    return joined.filter(overlaps(F.col(l_off), F.col(l_end), F.col(r_off), F.col(r_end)) & (F.col("__bucket") == first)).drop("__bucket")


def covering(chunks: DataFrame, points: DataFrame, key: str, width: int = CELL_BYTES, next_if_none: bool = False) -> DataFrame:
    """For each point (key, addr) the index of the chunk (key, idx, start, end) that holds it; with ``next_if_none`` the next chunk's otherwise.

    The lookup is an as-of join in two levels: chunks and points are sorted together inside cells of
    ``width`` bytes of a key, and each cell is handed the nearest chunks of the cells around it.
    """
    marks = chunks.select(key, F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("start", "idx", "end").alias("chunk"), F.lit(None).cast("bigint").alias("addr"))
    asked = points.select(key, F.col("addr").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["chunk"].dataType).alias("chunk"), "addr")
    both = marks.unionByName(asked).withColumn("cell", F.floor(F.col("at") / width))
    cells = both.groupBy(key, "cell").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    along = W.partitionBy(key).orderBy("cell")
    earlier = F.last("high", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    later = F.first("low", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing))
    around = cells.select(key, "cell", earlier.alias("earlier"), later.alias("later"))
    inside = W.partitionBy(key, "cell").orderBy("at", "kind")
    found = both.withColumn("here", F.last("chunk", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    if next_if_none:
        found = found.withColumn("next", F.first("chunk", ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing)))
    else:
        found = found.withColumn("next", F.lit(None).cast(marks.schema["chunk"].dataType))
        around = around.withColumn("later", F.lit(None).cast(marks.schema["chunk"].dataType))
    joined = found.filter("kind = 1").join(around, [key, "cell"])
    joined = joined.withColumns({"before": F.coalesce("here", "earlier"), "after": F.coalesce("next", "later")})
    return joined.select(key, "addr", F.when(F.col("addr") < F.col("before.end"), F.col("before.idx")).otherwise(F.col("after.idx")).alias("idx"))


def by_offset(column: str) -> Column:
    """Cell of a byte offset."""
    return F.floor(F.col(column) / CELL_BYTES)


def chunks_in_range(chunks: DataFrame, start: str, end: str, low: int, high: int, key: str) -> DataFrame:
    """Chunks that meet [low, high), with ``hole``: whether bytes are missing between a chunk and the one before."""
    some = chunks.filter((F.col(start) < high) & (F.col(end) > low))
    told = with_previous(some, [key], by_offset(start), [start], {"__end": F.col(end)})
    return told.withColumn("hole", F.coalesce(F.col("__end") != F.col(start), F.lit(False))).drop("__end")


def clip(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Part of a chunk inside a range, from the chunk's start."""
    return F.greatest(start, low) - start, F.least(end, high) - start


def holes(chunks: DataFrame, key: str, skip_last: bool = False) -> DataFrame:
    """Chunks (key, offset, size) that the next one doesn't follow; with ``skip_last`` a file's last pair isn't looked at."""
    pairs = with_previous(chunks.select(key, "offset", "size"), [key], by_offset("offset"), ["offset"], {"__offset": F.col("offset"), "__size": F.col("size")})
    bad = pairs.filter(F.col("__offset").isNotNull() & (F.col("offset") != F.col("__offset") + F.col("__size")))
    if skip_last:
        last = chunks.groupBy(key).agg(F.max("offset").alias("__last"))
        bad = bad.join(last, key).filter(F.col("offset") != F.col("__last"))
    return bad.select(key, F.col("__offset").alias("offset"), F.col("__size").alias("size"))


def continuous(chunks: DataFrame, key: str, start: str, end: str, max_gap: int) -> DataFrame:
    """``joins``: whether a chunk goes on from the one before it in its blob with a gap of ``max_gap`` at most."""
    told = with_previous(chunks, [key], by_offset(start), [start], {"__end": F.col(end)})
    joins = (F.col(start) >= F.col("__end")) & (F.col(start) - F.col("__end") <= max_gap)
    return told.withColumn("joins", F.coalesce(joins, F.lit(False))).drop("__end")


def islands(chunks: DataFrame, key: str, start: str, end: str, max_gap: int) -> DataFrame:
    """``island``: the number of the run of chunks that go on from each other."""
    first = F.when(F.col("joins"), 0).otherwise(1)
    numbered = running(continuous(chunks, key, start, end, max_gap), [key], by_offset(start), [start], {"island": first.cast("bigint")})
    return numbered.withColumn("island", F.col("island") + first)


def merged_requests(chunks: DataFrame, key: str, start: str, end: str, max_gap: int) -> DataFrame:
    """Requests (key, start, end, chunks) of chunks that go on from each other."""
    return islands(chunks, key, start, end, max_gap).groupBy(key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("chunks")).drop("island")


def capped_requests(chunks: DataFrame, key: str, start: str, end: str, max_gap: int, max_size: int) -> DataFrame:
    """As ``merged_requests``, but a request ends once it has ``max_size`` bytes.

    The cap resets a running sum, which no window expresses. It runs inside islands that a gap
    ends, folded over rows sorted in the partition, with one open request held at a time.
    """
    rows = islands(chunks, key, start, end, max_gap).select(F.col(key).alias("k"), "island", F.col(start).alias("a"), F.col(end).alias("b"))
    kind = chunks.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            out = []
            for k, island, a, b in frame.itertuples(index=False):
                if held and held[:2] == [k, island] and held[3] - held[2] < max_size:
                    held[3], held[4] = max(held[3], b), held[4] + 1
                else:
                    if held:
                        out.append((held[0], *held[2:]))
                    held = [k, island, a, b, 1]
            yield pd.DataFrame(out, columns=["k", "start", "end", "chunks"])
        if held:
            yield pd.DataFrame([(held[0], *held[2:])], columns=["k", "start", "end", "chunks"])

    dealt = rows.repartition("k", "island").sortWithinPartitions("k", "island", "a")
    return dealt.mapInPandas(run, f"k {kind}, start bigint, end bigint, chunks bigint").withColumnRenamed("k", key)


def id_runs(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Runs (keys, first, last) of consecutive ids."""
    numbered = running(rows.select(*keys, column), keys, F.floor(F.col(column) / CELL), [column], {}, index="__nth")
    island = (F.col(column) - F.col("__nth")).alias("island")
    return numbered.groupBy(*keys, island).agg(F.min(column).alias("first"), F.max(column).alias("last")).drop("island")


def strip_ready(chunks: DataFrame, key: str, order: str, ready: str, both_ends: bool = False) -> DataFrame:
    """Chunks without the ready ones at the tail, and at the head too with ``both_ends``."""
    ends = chunks.filter(~F.col(ready)).groupBy(key).agg(F.min(order).alias("__first"), F.max(order).alias("__last"))
    keep = F.col(order) <= F.col("__last")
    if both_ends:
        keep = keep & (F.col(order) >= F.col("__first"))
    return chunks.join(ends, key).filter(keep).drop("__last", "__first")


def extended(requests: DataFrame, chunks: DataFrame, key: str, limit: int, start: str, end: str) -> DataFrame:
    """``requests`` (key, start, end) grown by the chunks after them that end within ``limit`` bytes of their start.

    Chunks that end past a request, and ``limit`` after its start at most, lie in two or three cells of
    ``limit`` bytes: an equi-join by cell, not all chunks of a blob with all its requests.
    """
    more = chunks.select(key, F.col(end).alias("__chunk_end"), F.floor(F.col(end) / limit).alias("__cell"))
    reach = F.col("start") + limit
    cells = F.when(reach > F.col("end"), F.sequence(F.floor(F.col("end") / limit), F.floor(reach / limit)))
    near = requests.withColumn("__cell", F.explode(cells)).join(more, [key, "__cell"]).filter((F.col("__chunk_end") > F.col("end")) & (F.col("__chunk_end") <= reach))
    grown = near.groupBy(*requests.columns).agg(F.max("__chunk_end").alias("new_end"))
    return requests.join(grown, requests.columns, "left").withColumn("new_end", F.coalesce("new_end", "end"))


def amplified(files: DataFrame, key: str, order: str, window: int = 64) -> DataFrame:
    """``ahead``: bytes of the ``window`` files after each one, as the difference of two running sums."""
    summed = running(files, [key], F.floor(F.col(order) / CELL), [order], {"__sum": F.col("size")}, index="__nth")
    summed = summed.withColumn("__sum", F.col("__sum") + F.col("size"))
    later = summed.select(key, (F.col("__nth") - window).alias("__nth"), F.col("__sum").alias("__later"))
    whole = files.groupBy(key).agg(F.sum("size").alias("__whole"))
    joined = summed.join(later, [key, "__nth"], "left").join(whole, key)
    return joined.withColumn("ahead", F.coalesce("__later", "__whole") - F.col("__sum")).select(*files.columns, "ahead")


def align(size: Column, block: int = 4096) -> Column:
    return (F.ceil(size / block) * block).cast("bigint")


def layout(chunks: DataFrame, blob: str, order: list[str], block: int = 4096) -> DataFrame:
    """Index and offsets of each chunk of a blob: compressed ones packed, uncompressed ones aligned. ``order`` begins with a number."""
    sums = {"comp_offset": F.col("comp_size"), "uncomp_offset": align(F.col("size"), block)}
    return running(chunks, [blob], F.floor(F.col(order[0]) / CELL), order, sums, index="index")


def split_ranges(ranges: DataFrame, size: str, piece: int) -> DataFrame:
    """Requests (offset, length) of at most ``piece`` bytes that a range of ``size`` is cut into."""
    starts = F.when(F.col(size) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(size) - 1, F.lit(piece).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    out = ranges.withColumn("offset", F.explode(starts))
    return out.withColumn("length", F.least(F.lit(piece).cast("bigint"), F.col(size) - F.col("offset")))


def packed(files: DataFrame, blob: str, order: str, batch: int) -> DataFrame:
    """(blob, ino, batch_no, batch_offset): files of less than half a batch, next-fit packed in order; a batch ends where the next file doesn't fit."""
    kind = files.schema[blob].dataType.simpleString()
    rows = files.filter(F.col("size") < batch // 2).select(F.col(blob).alias("k"), F.col(order).cast("bigint").alias("o"), "size")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blob_now, number, used = None, 0, 0
        for frame in frames:
            out = []
            for k, o, size in frame.itertuples(index=False):
                if k != blob_now:
                    blob_now, number, used = k, 0, 0
                if used + size > batch:
                    number, used = number + 1, 0
                out.append((k, o, number, used))
                used += size
            yield pd.DataFrame(out, columns=["k", "o", "batch_no", "batch_offset"])

    dealt = rows.repartition("k").sortWithinPartitions("k", "o")
    return dealt.mapInPandas(run, f"k {kind}, o bigint, batch_no bigint, batch_offset bigint").withColumnsRenamed({"k": blob, "o": order})


#: What a region of a request is read from.
CACHE_FAST, CACHE_SLOW, BACKEND = "CacheFast", "CacheSlow", "Backend"


def regions(chunks: DataFrame, request: str, order: str, start: str, end: str, state: str, max_gap: int = 0) -> DataFrame:
    """(request, region, type, start, end, chunks): a request's chunks in order, cut into runs of one state that go on from each other.

    ``state`` says where each chunk is read from; a region ends where it changes or where bytes
    are missing between two chunks. A request has as many chunks as its length allows.
    """
    w = W.partitionBy(request).orderBy(order)
    goes_on = (F.lag(state).over(w) == F.col(state)) & (F.col(start) - F.lag(end).over(w)).between(0, max_gap)
    marked = chunks.withColumn("__new", F.when(goes_on, 0).otherwise(1))
    numbered = marked.withColumn("region", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(request, "region", F.col(state).alias("type")).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("chunks"))
