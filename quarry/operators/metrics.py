"""Operation metrics: counters, access patterns, latency and size bins, reports and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of bins. The last bin has no bound.
SIZE_BOUNDS = (1 << 10, 4 << 10, 16 << 10, 64 << 10, 128 << 10, 512 << 10, 1 << 20)
LATENCY_US_BOUNDS = (200, 1000, 20_000, 50_000, 500_000, 1_000_000, 2_000_000)
LATENCY_MS_BOUNDS = (1, 20, 50, 100, 500, 1000, 2000)


def binned(value: Column, bounds: tuple[int, ...], closed: bool) -> Column:
    """Bin of a value: how many bounds lie below it; a bound belongs to the bin below where ``closed``."""
    out = F.lit(0)
    for bound in bounds:
        out = out + (value > bound if closed else value >= bound).cast("int")
    return out.cast("bigint")


def size_bin(size: Column) -> Column:
    return binned(size, SIZE_BOUNDS, closed=False)


def latency_us_bin(latency: Column) -> Column:
    return binned(latency, LATENCY_US_BOUNDS, closed=True)


def latency_ms_bin(latency: Column) -> Column:
    return binned(latency, LATENCY_MS_BOUNDS, closed=True)


def operation_counters(ops: DataFrame) -> DataFrame:
    """Per operation: hits and errors; bytes of successful reads only."""
    return ops.groupBy("op").agg(
        F.count_if("ok").alias("hits"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.sum(F.when(F.col("ok") & (F.col("op") == "read"), F.col("bytes")).otherwise(0)).alias("bytes_read"),
    )


def open_handles(ops: DataFrame) -> DataFrame:
    """Opens less releases."""
    return ops.agg((F.count_if((F.col("op") == "open") & F.col("ok")) - F.count_if((F.col("op") == "release") & F.col("ok"))).alias("open_files"))


def read_size_histogram(ops: DataFrame) -> DataFrame:
    """Reads by size bin; failed reads count too."""
    return ops.filter("op = 'read'").groupBy(size_bin(F.col("bytes")).alias("bin")).agg(F.count("*").alias("reads"))


def latency_histogram(ops: DataFrame, unit: str) -> DataFrame:
    value = latency_us_bin(F.col("latency_us")) if unit == "us" else latency_ms_bin(F.floor(F.col("latency_us") / 1000))
    return ops.filter("op = 'read' and ok").groupBy(value.alias("bin")).agg(F.count("*").alias("reads"))


def inode_counters(ops: DataFrame) -> DataFrame:
    """Per inode: operations, errors, bytes, and its operations by size bin."""
    bins = [F.count_if(size_bin(F.col("bytes")) == i).alias(f"bin{i}") for i in range(len(SIZE_BOUNDS) + 1)]
    return ops.groupBy("ino").agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("errors"), F.sum("bytes").alias("bytes"), *bins)


def access_pattern(ops: DataFrame) -> DataFrame:
    """Per inode that was read: reads and the first read's time."""
    return ops.filter("op = 'read'").groupBy("ino").agg(F.count("*").alias("nr_read"), F.min("ts").alias("first_access")).filter("nr_read > 0")


def backend_matrix(ops: DataFrame) -> DataFrame:
    """Reads of a size bin and latency bin with their bytes, errors and latency."""
    return (
        ops.filter("op = 'read'")
        .groupBy(size_bin(F.col("bytes")).alias("size_bin"), latency_ms_bin(F.floor(F.col("latency_us") / 1000)).alias("latency_bin"))
        .agg(F.count("*").alias("reads"), F.count_if(~F.col("ok")).alias("errors"), F.sum("bytes").alias("bytes"), F.sum("latency_us").alias("latency_us"))
    )


def prefetch_metrics(requests: DataFrame) -> DataFrame:
    """Requests, bytes, when the last ended, and summed latency."""
    return requests.agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.max("ts").alias("end_time"), F.sum("latency_us").alias("latency_us"))


def whole_ratio(a: Column, b: Column) -> Column:
    """Whole quotient; 0 where the divisor is."""
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.floor(a / b).cast("bigint"))


def cache_report(ops: DataFrame) -> DataFrame:
    """Hits in percent, mean request size and bytes a second of all reads."""
    reads = ops.filter("op = 'read'").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("hits"), F.sum("bytes").alias("bytes"), (F.max("ts") - F.min("ts")).alias("seconds")
    )
    return reads.select(
        whole_ratio(F.col("hits") * 100, F.col("n")).alias("hit_percent"), whole_ratio(F.col("bytes"), F.col("n")).alias("mean_size"), whole_ratio(F.col("bytes"), F.col("seconds")).alias("bytes_per_second")
    )


def backend_report(ops: DataFrame, every: str = "1 day", seconds: int = 86_400) -> DataFrame:
    """Per interval: reads, KB a second, mean size and mean latency, each a whole number."""
    reads = ops.filter("op = 'read'").withColumn("slot", F.floor(F.col("ts") / seconds) * seconds)
    sums = reads.groupBy("slot").agg(F.count("*").alias("reads"), F.sum("bytes").alias("bytes"), F.sum("latency_us").alias("latency"))
    return sums.select(
        "slot", "reads", whole_ratio(F.col("bytes"), F.lit(1024 * seconds)).alias("kb_per_second"), whole_ratio(F.col("bytes"), F.col("reads")).alias("mean_size"), whole_ratio(F.col("latency"), F.col("reads")).alias("mean_latency_us")
    )


def metric_delta(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``delta``: the rise of a counter since the sample before, 0 where it fell or nothing came before."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return samples.withColumn("delta", F.coalesce(F.greatest(F.col(value) - before, F.lit(0)), F.lit(0)))


def vector_delta(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``delta``: the rise of each counter of an array; without a sample before, the array itself."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    rise = F.zip_with(value, before, lambda a, b: F.greatest(a - b, F.lit(0)))
    return samples.withColumn("delta", F.when(before.isNull(), F.col(value)).otherwise(rise))


def id_ranges(ids: DataFrame, column: str = "ino") -> DataFrame:
    """Ranges of ids in a row: first and last.

    A range starts where the id below is missing and ends where the id above is; both are found by
    a window inside blocks of ids and the blocks' edges, so no task sorts all ids.
    """
    block = 1 << 16
    own = ids.select(F.col(column).cast("bigint").alias("id")).distinct().withColumn("block", F.floor(F.col("id") / block))
    w = W.partitionBy("block").orderBy("id")
    islands = own.withColumn("island", F.col("id") - F.row_number().over(w)).groupBy("block", "island").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # Islands that touch over a block's edge are joined: few rows, one or two a block.
    order = W.orderBy("first")
    joined = islands.withColumn("new", F.when(F.lag("last").over(order) == F.col("first") - 1, 0).otherwise(1))
    run = joined.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
