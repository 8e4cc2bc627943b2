"""Storage backends as Hadoop file systems, ranged reads and the retry policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: URI scheme of each kind of backend.
SCHEMES = {"localfs": "file", "localdisk": "file", "s3": "s3a", "oss": "oss", "registry": "https", "http-proxy": "http"}


def backend_uri(kind: str, root: str, blob_id: str = "") -> str:
    """URI of a blob of a backend; a kind that isn't known is an error."""
    if kind not in SCHEMES:
        raise ValueError(f"unsupported backend {kind!r}")
    return f"{SCHEMES[kind]}://{root.rstrip('/')}/{blob_id}".rstrip("/")


def read_blobs(spark: SparkSession, uri: str) -> DataFrame:
    """(path, length, content) of the files under a URI."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri).select("path", "length", "content")


def ranged(content: Column, offset: Column, length: Column) -> Column:
    """Bytes [offset, offset + length) of a blob; null where the blob is shorter."""
    enough = F.octet_length(content) >= offset + length
    return F.when(enough, F.substring(content, (offset + 1).cast("int"), length.cast("int")))


def retry_decision(status: Column, tried: Column, prefetch: Column) -> Column:
    """done, retry, retry without proxy, or fail."""
    left = tried < F.when(prefetch, 1).otherwise(3)
    again = F.when(status == 429, "retry without proxy").otherwise("retry")
    return F.when(status == 200, "done").when(status == 403, "fail").when(left, again).otherwise("fail")


def vectored(content: Column, ranges: Column) -> Column:
    """Bytes of each of several ranges (offset, length) of a blob, in one pass; null for a range that it is too short for."""
    return F.transform(ranges, lambda r: ranged(content, r["offset"], r["length"]))


def streamed(blobs: DataFrame, content: str, piece: int) -> DataFrame:
    """``blobs`` as a sequence of pieces (offset, part) of at most ``piece`` bytes, in place of the content."""
    size = F.octet_length(content)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(piece))).otherwise(F.array().cast("array<int>"))
    cut = blobs.withColumn("offset", F.explode(starts))
    part = F.substring(F.col(content), F.col("offset") + 1, F.lit(piece))
    return cut.withColumns({"part": part, "offset": F.col("offset").cast("bigint")}).drop(content)


def retry_delay(tried: Column, first_ms: int = 100, most_ms: int = 10_000) -> Column:
    """Milliseconds to wait before the next try: twice as long each time, up to a bound."""
    return F.least(F.lit(first_ms) * F.pow(F.lit(2.0), tried), F.lit(float(most_ms))).cast("bigint")
