"""Structured streams over tables of operations: tumbling metrics, first requests, readiness, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.streaming.state import Bucket, draw


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 1) -> DataFrame:
    """A table's files as a stream with an event time."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}.parquet*").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and value of each type and interval; later rows than ``late`` are dropped."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.unix_timestamp("window.start").alias("slot"), "event_type", "n", "value")


def first_by_key(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: requests in flight for one key share a result."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def limited(stream: DataFrame, key: str, amount: str, rate: int) -> DataFrame:
    """(key, requests, waited): a token bucket held as state for each key."""

    def step(group, frames: Iterator[pd.DataFrame], state):
        level, since, n, waited = state.get if state.exists else (None, None, 0, 0.0)
        bucket = None if level is None else Bucket(level, since)
        rows = pd.concat(list(frames)).sort_values(["t", "a"])
        for t, a in zip(rows["t"], rows["a"]):
            bucket, wait = draw(bucket, t, int(a), rate)
            waited += wait
        n += len(rows)
        state.update((bucket.level, float(bucket.since), n, waited))
        yield pd.DataFrame({"k": [group[0]], "requests": [n], "waited": [waited]})

    rows = stream.select(F.col(key).cast("bigint").alias("k"), F.unix_timestamp("ts").cast("double").alias("t"), F.col(amount).cast("bigint").alias("a"))
    return rows.groupBy("k").applyInPandasWithState(step, "k bigint, requests bigint, waited double", "level bigint, since double, n bigint, waited double", "update", "NoTimeout")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The rows that a stream gives for all files there are; small results, for checks against batch forms."""
    import uuid

    name = f"quarry_{uuid.uuid4().hex}"
    started = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.table(name)
