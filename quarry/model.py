"""Relations of the engine, derived from the tables of a folder: files, chunks, dictionary rows, layer entries and operations.

Digests are SHA-256 in hex; sizes and offsets are long. A file is a document; its blob and image
are the document's source, its version and layer follow from its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SIZE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ino, path, parent, name, image, version, ver, layer, size, text."""
    key = F.col("doc_id").cast("string")
    parent = F.concat(F.lit("/"), "source", F.lit("/"), "lang")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ino"),
        F.concat(parent, F.lit("/"), key).alias("path"),
        parent.alias("parent"),
        key.alias("name"),
        F.col("source").alias("image"),
        F.concat(F.lit("v"), (F.col("doc_id") % 10).cast("string")).alias("version"),
        (F.col("doc_id") % 10).alias("ver"),
        (F.col("doc_id") % 3).alias("layer"),
        F.octet_length("text").cast("bigint").alias("size"),
        "text",
    )


FILES = """files AS (SELECT doc_id AS ino, '/'||source||'/'||lang||'/'||doc_id AS path, '/'||source||'/'||lang AS parent,
 CAST(doc_id AS VARCHAR) AS name, source AS image, 'v'||(doc_id%10) AS version, doc_id%10 AS ver, doc_id%3 AS layer,
 CAST(octet_length(encode(text)) AS BIGINT) AS size, text FROM documents)"""


def fixed_chunks(df: DataFrame, text: str = "text", chunk_size: int = CHUNK_SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Slices of ``chunk_size`` bytes of each text: ``keep``, idx, file_offset, size, digest. An empty text has none."""
    body = F.encode(F.col(text), "UTF-8")
    n = F.ceil(F.octet_length(text) / chunk_size).cast("int")
    some = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    sliced = df.select(*keep, body.alias("__body"), F.explode(some).alias("__idx"))
    part = F.expr(f"substring(__body, __idx * {chunk_size} + 1, {chunk_size})")
    return sliced.select(
        *keep,
        F.col("__idx").cast("bigint").alias("idx"),
        (F.col("__idx").cast("bigint") * chunk_size).alias("file_offset"),
        F.octet_length(part).cast("bigint").alias("size"),
        F.sha2(part, 256).alias("digest"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ino, image, version, ver, layer, idx, file_offset, size, digest, comp_size."""
    cut = fixed_chunks(files(spark, sf_dir), keep=("ino", "image", "version", "ver", "layer"))
    return cut.withColumn("comp_size", compressed_size(F.col("size")))


def compressed_size(size: Column) -> Column:
    """The stated compressed size of a chunk: three quarters of it."""
    return size - F.floor(size / 4)


CHUNKS = (
    FILES
    + """, sliced AS (SELECT ino, image, version, ver, layer, idx, idx*4096 AS file_offset,
 array_slice(encode(text), idx*4096+1, least((idx+1)*4096, size)) AS body FROM
 (SELECT *, unnest(range(0,(size+4095)//4096)) AS idx FROM files)),
chunks AS (SELECT ino, image, version, ver, layer, idx, file_offset, CAST(octet_length(body) AS BIGINT) AS size, sha256(body) AS digest,
 CAST(octet_length(body) - octet_length(body)//4 AS BIGINT) AS comp_size FROM sliced)"""
)


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File operations from events: ino, op, ok, bytes, latency_us, ts (seconds), seq."""
    op = (
        F.when(F.col("event_type").isin("view", "error"), "read").when(F.col("event_type") == "click", "lookup")
        .when(F.col("event_type") == "signup", "open").otherwise("release")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("bigint").alias("seq"),
        F.col("user_id").cast("bigint").alias("ino"),
        op.alias("op"),
        (F.col("event_type") != "error").alias("ok"),
        F.floor(F.col("value") * 1024).cast("bigint").alias("bytes"),
        F.floor(F.col("value") * 5000).cast("bigint").alias("latency_us"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
    )


OPERATIONS = """ops AS (SELECT CAST(event_id AS BIGINT) AS seq, CAST(user_id AS BIGINT) AS ino,
 CASE WHEN event_type IN ('view','error') THEN 'read' WHEN event_type='click' THEN 'lookup' WHEN event_type='signup' THEN 'open' ELSE 'release' END AS op,
 event_type <> 'error' AS ok, CAST(floor(value*1024) AS BIGINT) AS bytes, CAST(floor(value*5000) AS BIGINT) AS latency_us,
 CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of stacked layers: layer, path, is_dir, size, digest.

    Every document is a file of its layer; each directory is in the layers that have a file of it.
    A key divisible by 17 is a whiteout of the file one below, and layer 2 has an opaque marker in
    the French directory of the sources whose name ends in 3.
    """
    f = files(spark, sf_dir)
    name = F.when(F.col("ino") % 17 == 0, F.concat(F.lit(".wh."), (F.col("ino") - 1).cast("string"))).otherwise(F.col("name"))
    plain = f.select("layer", F.concat("parent", F.lit("/"), name).alias("path"), F.lit(False).alias("is_dir"), "size", F.sha2("text", 256).alias("digest"))
    # Every layer has some names of the layer below again, with other contents.
    again = f.filter("ino % 5 = 0 and layer < 2 and ino % 17 <> 0").select(
        (F.col("layer") + 1).alias("layer"), "path", F.lit(False).alias("is_dir"), (F.col("size") + 1).alias("size"), F.sha2(F.concat("text", F.lit("+")), 256).alias("digest")
    )
    none = F.lit(None).cast("string")
    dirs = f.select("layer", F.col("parent").alias("path")).distinct().select("layer", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size"), none.alias("digest"))
    opaque = f.filter("image like '%3' and parent like '%/fr'").select("parent").distinct().select(
        F.lit(2).cast("bigint").alias("layer"), F.concat("parent", F.lit("/.wh..wh..opq")).alias("path"), F.lit(False).alias("is_dir"), F.lit(0).cast("bigint").alias("size"), none.alias("digest")
    )
    return plain.unionByName(again).unionByName(dirs).unionByName(opaque)


ENTRIES = (
    FILES
    + """, entries AS (SELECT layer, parent||'/'||CASE WHEN ino%17=0 THEN '.wh.'||(ino-1) ELSE name END AS path, false AS is_dir, size, sha256(text) AS digest FROM files
 UNION ALL SELECT layer+1, path, false, size+1, sha256(text||'+') FROM files WHERE ino%5=0 AND layer<2 AND ino%17<>0
 UNION ALL SELECT DISTINCT layer, parent, true, CAST(0 AS BIGINT), NULL FROM files
 UNION ALL SELECT DISTINCT CAST(2 AS BIGINT), parent||'/.wh..wh..opq', false, CAST(0 AS BIGINT), NULL FROM files WHERE image LIKE '%3' AND parent LIKE '%/fr')"""
)
