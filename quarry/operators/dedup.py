"""Chunk deduplication: dictionaries, lookups, statistics and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dictionary(chunks: DataFrame, order: list[str], value: list[str]) -> DataFrame:
    """digest, uses and ``value`` of the first chunk of each digest by ``order``."""
    first = F.min_by(F.struct(*value), F.struct(*order))
    return chunks.groupBy("digest").agg(F.count("*").alias("uses"), first.alias("__first")).select("digest", "uses", *[F.col(f"__first.{v}").alias(v) for v in value])


def dedup_summary(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Raw and unique chunks and bytes of each group; a digest counts once a group, in one shuffle of digests."""
    per = chunks.groupBy(*by, "digest").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("size"))
    out = per.groupBy(*by) if by else per
    return out.agg(F.sum("n").alias("raw_chunks"), F.sum("bytes").alias("raw_bytes"), F.count("*").alias("unique_chunks"), F.sum("size").alias("unique_bytes"))


def size_matches(dict_size: Column, size: Column) -> Column:
    """A dictionary size of 0 matches every size."""
    return (dict_size == 0) | (dict_size == size)


def lookup(chunks: DataFrame, dictionary: DataFrame, value: str, default: str | None = None) -> DataFrame:
    """``chunks`` with ``value`` of the dictionary row of the same digest and a matching size, null where none is.

    ``dictionary`` has digest, dict_size and ``value``, one row a digest.
    """
    found = chunks.join(dictionary, "digest", "left")
    hit = F.when(size_matches(F.col("dict_size"), F.col("size")), F.col(value))
    return found.withColumn(value, hit if default is None else F.coalesce(hit, F.lit(default))).drop("dict_size")


def two_level_lookup(chunks: DataFrame, shared: DataFrame, parent: DataFrame) -> DataFrame:
    """``chunks`` with origin (DICT, PARENT or BUILD) and the blob that holds the chunk: the shared dictionary goes first."""
    a = shared.select("digest", F.col("dict_size").alias("__s1"), F.col("blob").alias("__b1"))
    b = parent.select("digest", F.col("dict_size").alias("__s2"), F.col("blob").alias("__b2"))
    joined = chunks.join(a, "digest", "left").join(b, "digest", "left")
    one, two = size_matches(F.col("__s1"), F.col("size")), size_matches(F.col("__s2"), F.col("size"))
    origin = F.when(one, "DICT").when(two, "PARENT").otherwise("BUILD")
    blob = F.when(one, F.col("__b1")).when(two, F.col("__b2")).otherwise(F.col("image"))
    return joined.withColumns({"origin": origin, "blob": blob}).drop("__s1", "__s2", "__b1", "__b2")


def own_and_referenced(target: DataFrame, base: DataFrame) -> DataFrame:
    """Unique chunks and bytes of ``target`` that ``base`` holds (referenced) and that it doesn't (own)."""
    known = base.select("digest").distinct().withColumn("__known", F.lit(True))
    unique = target.groupBy("digest").agg(F.max("size").alias("size")).join(known, "digest", "left")
    kind = F.when(F.col("__known"), "referenced").otherwise("own")
    return unique.groupBy(kind.alias("kind")).agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


def cas_lookup(chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """For each digest the chunk's offset in the blob of least id that holds it and is known."""
    known = chunks.join(blobs.select("blob_id", "file_path"), "blob_id")
    return known.groupBy("digest").agg(F.min_by(F.struct("blob_id", "file_path", "chunk_offset"), F.struct("blob_id", "chunk_offset")).alias("x")).select("digest", "x.*")


def threshold_table(chunks: DataFrame, levels: int = 20) -> DataFrame:
    """For t from 1 to ``levels``: a digest used t times or more goes to a base once, others stay in every image that uses them."""
    per = chunks.groupBy("digest").agg(F.count("*").alias("uses"), F.max("size").alias("size"))
    by_uses = per.groupBy("uses").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))  # a row a use count
    often = F.col("uses") >= F.col("threshold")
    return (
        by_uses.withColumn("threshold", F.explode(F.sequence(F.lit(1), F.lit(levels)).cast("array<bigint>")))
        .groupBy("threshold")
        .agg(
            F.sum(F.when(often, F.col("n")).otherwise(0)).alias("base_chunks"),
            F.sum(F.when(often, F.col("bytes")).otherwise(0)).alias("base_bytes"),
            F.sum(F.when(often, 0).otherwise(F.col("n") * F.col("uses"))).alias("image_chunks"),
            F.sum(F.when(often, 0).otherwise(F.col("bytes") * F.col("uses"))).alias("image_bytes"),
        )
    )


def log2_bucket(size: Column, most: int = 44) -> Column:
    """Binary digits of a size, at most ``most``; 0 for 0."""
    return F.when(size == 0, 0).otherwise(F.least(F.length(F.bin(size)), F.lit(most))).cast("bigint")


def size_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(log2_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def chunk_counts_by_size(files: DataFrame, low: int = 12, high: int = 20) -> DataFrame:
    """Chunks that all files would have at chunk sizes of 2**low to 2**high."""
    counts = [F.sum(F.ceil(F.col("size") / (1 << k))).cast("bigint").alias(str(k)) for k in range(low, high + 1)]
    wide = files.agg(*counts)
    stacked = ", ".join(f"{k}, `{k}`" for k in range(low, high + 1))
    return wide.selectExpr(f"stack({high - low + 1}, {stacked}) as (exponent, chunks)").select(F.col("exponent").cast("bigint").alias("exponent"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def image_statistics(files: DataFrame, chunks: DataFrame, block: int = 4096) -> DataFrame:
    """Per image: files, directories, bytes, padding to blocks, chunks. A repeat of a link counts as a file only.

    ``files`` has image, parent, link (the identity that hard links share), ino, size.
    """
    nth = F.row_number().over(W.partitionBy("image", "link").orderBy("ino"))
    first = files.withColumn("__first", nth == 1)
    padding = F.pmod(-F.col("size"), F.lit(block))
    once = lambda x: F.sum(F.when(F.col("__first"), x).otherwise(0))
    sizes = first.groupBy("image").agg(
        F.count("*").alias("files"), F.count_distinct("parent").alias("dirs"), once(F.col("size")).alias("bytes"), once(padding).alias("padding"), once(F.lit(1).cast("bigint")).alias("links")
    )
    per = chunks.groupBy("image").agg(F.count("*").alias("chunks"), F.count_distinct("digest").alias("unique_chunks"))
    return sizes.join(per, "image", "left").na.fill(0, ["chunks", "unique_chunks"])


def used_ratio(chunks: DataFrame, blob: str = "image") -> DataFrame:
    """Per blob: bytes of its distinct chunks as whole percents of all its bytes."""
    per = chunks.groupBy(blob, "digest").agg(F.max("comp_size").alias("one"), F.sum("comp_size").alias("every"))
    sums = per.groupBy(blob).agg(F.sum("one").alias("used"), F.sum("every").alias("blob_size"))
    return sums.withColumn("ratio", F.floor(F.col("used") * 100 / F.col("blob_size")).cast("bigint"))


def drop_small_blobs(chunks: DataFrame, least: int, blob: str = "image") -> DataFrame:
    """Chunks of the blobs whose chunks add up to ``least`` bytes or more."""
    large = chunks.groupBy(blob).agg(F.sum("size").alias("total")).filter(F.col("total") >= least).select(blob)
    return chunks.join(large, blob, "left_semi")


def distinct_set(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks and compressed bytes of the set of distinct keys."""
    return chunks.groupBy(*keys).agg(F.max("comp_size").alias("one")).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("one"), F.lit(0)).alias("bytes"))


def insert_or_ignore(rows: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` of each value of the unique columns."""
    rest = [c for c in rows.columns if c not in unique]
    return rows.groupBy(*unique).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*unique, "x.*")


def delete_cascade(chunks: DataFrame, blobs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows left in both relations, by kind, when the blobs of ``gone`` and their chunks go."""
    left = lambda df, kind: df.join(gone, "blob_id", "left_anti").agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "rows")
    return left(blobs, "blobs").unionByName(left(chunks, "chunks"))
