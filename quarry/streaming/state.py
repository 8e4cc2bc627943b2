"""State that follows an order: token buckets, rings, readiness, first requests. Batch forms of the streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.prefix import CELL, running


def ring(rows: DataFrame, order: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """The latest rows that fit ``most`` rows and ``most_bytes``; only that many rows reach the last step."""
    last = rows.orderBy(F.desc(order)).limit(most)
    total = F.sum(size).over(W.orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    return last.withColumn("__total", total).filter(F.col("__total") <= most_bytes).drop("__total")


class Bucket(NamedTuple):
    """Whole tokens that are left, and the time up to which tokens were added."""

    level: int
    since: float


def draw(bucket: Bucket | None, now: float, amount: int, rate: int) -> tuple[Bucket, float]:
    """The bucket after a request, and the seconds that the request waits.

    A bucket begins full, holds twice its rate at most and gains whole tokens with time. A request
    takes what it needs; where that is more than there is, the bucket is empty and the rest is waited for.
    """
    capacity = 2 * rate
    fresh = math.floor((now - bucket.since) * rate) if bucket else capacity
    if bucket is None or fresh > 0:
        bucket = Bucket(min(capacity, fresh + (bucket.level if bucket else 0)), now)
    lacking = max(0, amount - bucket.level)
    return bucket._replace(level=bucket.level + lacking - amount), lacking / rate


def token_buckets(requests: DataFrame, key: str, time: str, amount: str, order: str, rate: int) -> DataFrame:
    """(key, order, wait): each key's requests in order through a bucket of its own, one row held at a time."""
    kind = requests.schema[key].dataType.simpleString()
    rows = requests.select(F.col(key).alias("k"), F.col(order).cast("bigint").alias("o"), F.col(time).cast("double").alias("t"), F.col(amount).cast("bigint").alias("a"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bucket = None, None
        for frame in frames:
            waits = []
            for k, t, a in zip(frame["k"], frame["t"], frame["a"]):
                bucket, wait = draw(bucket if k == now else None, t, a, rate)
                waits.append(wait)
                now = k
            yield pd.DataFrame({"k": frame["k"], "o": frame["o"], "wait": waits})

    dealt = rows.repartition("k").sortWithinPartitions("k", "t", "o")
    return dealt.mapInPandas(run, f"k {kind}, o bigint, wait double").withColumnsRenamed({"k": key, "o": order})


def first_requests(rows: DataFrame, keys: list[str], time: str, order: str, window: int) -> DataFrame:
    """``leads``: whether a request is the first of its key in its interval; the others share its result."""
    w = W.partitionBy(*keys, F.floor(F.col(time) / window)).orderBy(time, order)
    return rows.withColumn("leads", F.row_number().over(w) == 1)


def newly_ready(rows: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """The request that makes each chunk ready; later ones find it ready."""
    return rows.groupBy(key).agg(F.min(F.struct(time, order)).alias("x"), (F.count("*") - 1).alias("found_ready")).select(key, F.col(f"x.{time}").alias("ready_at"), "found_ready")


def pending_indexes(requests: DataFrame, blob: str, start: str, count: str, order: list[str]) -> DataFrame:
    """(blob, index, order) of the chunks that each request finds not ready: those that no earlier one has marked. Keyed by chunk index."""
    wanted = requests.withColumn("index", F.explode(F.sequence(F.col(start), F.col(start) + F.col(count) - 1)))
    first = F.min(F.struct(*order)).alias("__first")
    return wanted.groupBy(blob, "index").agg(first).select(blob, "index", *[F.col(f"__first.{c}").alias(c) for c in order])


def ready_words(ready: DataFrame, blob: str, index: str, bits: int = 32) -> DataFrame:
    """(blob, word, bits): the bitmap of a blob's ready chunks, words of ``bits`` bits."""
    bit = F.expr(f"shiftleft(1L, cast(`{index}` % {bits} as int))")
    return ready.groupBy(blob, F.floor(F.col(index) / bits).alias("word")).agg(F.bit_or(bit).alias("bits"))


def ready_by_digest(chunks: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """``ready``: whether a chunk before, by ``order``, has brought the same digest. Keyed by digest."""
    first = chunks.groupBy(digest).agg(F.min(F.struct(*order)).alias("__first"))
    return chunks.join(first, digest).withColumn("ready", F.struct(*order) != F.col("__first")).drop("__first")


def dealt_to_workers(requests: DataFrame, order: list[str], workers: int) -> DataFrame:
    """``place`` in the queue, first in first out, and ``worker``: idle workers take requests in turn. ``order`` begins with a number."""
    queued = running(requests.withColumn("__all", F.lit(0)), ["__all"], F.floor(F.col(order[0]) / CELL), order, {}, index="place")
    return queued.drop("__all").withColumn("worker", F.pmod("place", F.lit(workers)).cast("bigint"))


def gated(requests: DataFrame, pauses: DataFrame, time: str, width: int) -> DataFrame:
    """``wait``: seconds until the pause (from, until) that a request comes in is over; 0 outside of pauses.

    Pauses are dealt to the buckets of ``width`` seconds that they touch, so requests meet those of
    their bucket only. A longer pause takes over from one that it overlaps.
    """
    spread = pauses.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(F.col("until") / width))))
    keyed = requests.withColumns({"__bucket": F.floor(F.col(time) / width), "__id": F.monotonically_increasing_id()})
    inside = (F.col(time) >= F.col("from")) & (F.col(time) < F.col("until"))
    ends = keyed.select("__id", "__bucket", time).join(spread, "__bucket").filter(inside).groupBy("__id").agg(F.max("until").alias("__until"))
    joined = keyed.join(ends, "__id", "left")
    return joined.withColumn("wait", F.coalesce(F.col("__until") - F.col(time), F.lit(0))).drop("__bucket", "__id", "__until")

