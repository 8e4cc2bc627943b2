"""Queries over chunks: digests, dictionaries, statistics, blobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import model
from quarry.model import CHUNKS, FILES
from quarry.operators import dedup
from quarry.plans.catalog import query


@query("chunk_fixed", f"WITH {CHUNKS} SELECT ino, idx, file_offset, size, digest FROM chunks")
def chunk_fixed(spark, sf_dir):
    return model.chunks(spark, sf_dir).select("ino", "idx", "file_offset", "size", "digest")


@query("dedup_summary", f"""WITH {CHUNKS}, per AS (SELECT digest, count(*) n, sum(size) b, max(size) s FROM chunks GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) raw_chunks, CAST(sum(b) AS BIGINT) raw_bytes, count(*) unique_chunks, CAST(sum(s) AS BIGINT) unique_bytes FROM per""")
def dedup_summary(spark, sf_dir):
    return dedup.dedup_summary(model.chunks(spark, sf_dir), [])


DEDUP_BY_SOURCE = f"""WITH {CHUNKS}, per AS (SELECT image, digest, count(*) n, sum(size) b, max(size) s FROM chunks GROUP BY 1, 2)
SELECT image, CAST(sum(n) AS BIGINT) raw_chunks, CAST(sum(b) AS BIGINT) raw_bytes, count(*) unique_chunks, CAST(sum(s) AS BIGINT) unique_bytes FROM per GROUP BY 1"""


@query("dedup_by_source", DEDUP_BY_SOURCE)
def dedup_by_source(spark, sf_dir):
    return dedup.dedup_summary(model.chunks(spark, sf_dir), ["image"])


@query("chunk_dictionary", f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ino, idx) rn, count(*) OVER (PARTITION BY digest) uses FROM chunks)
SELECT digest, uses, ino, idx, size FROM r WHERE rn = 1""")
def chunk_dictionary(spark, sf_dir):
    return dedup.dictionary(model.chunks(spark, sf_dir), ["ino", "idx"], ["ino", "idx", "size"])


@query("dedup_lookup", f"""WITH {CHUNKS}, d AS (SELECT digest, min(image) blob, min(CASE WHEN ino % 4 = 0 THEN 0 ELSE size END) dict_size FROM chunks WHERE layer = 0 GROUP BY 1)
SELECT c.ino, c.idx, CASE WHEN d.dict_size = 0 OR d.dict_size = c.size THEN d.blob END blob FROM chunks c LEFT JOIN d USING (digest) WHERE c.layer > 0""")
def dedup_lookup(spark, sf_dir):
    chunks = model.chunks(spark, sf_dir)
    known = chunks.filter("layer = 0").groupBy("digest").agg(F.min("image").alias("blob"), F.min(F.when(F.col("ino") % 4 == 0, 0).otherwise(F.col("size"))).alias("dict_size"))
    return dedup.lookup(chunks.filter("layer > 0"), known, "blob").select("ino", "idx", "blob")


@query("two_level_lookup", f"""WITH {CHUNKS}, a AS (SELECT digest, min(image) blob, 0 dict_size FROM chunks WHERE image = 'src0' GROUP BY 1),
b AS (SELECT digest, min(image) blob, max(size) dict_size FROM chunks WHERE layer = 0 GROUP BY 1)
SELECT c.ino, c.idx, CASE WHEN a.digest IS NOT NULL THEN 'DICT' WHEN b.dict_size = c.size THEN 'PARENT' ELSE 'BUILD' END origin,
CASE WHEN a.digest IS NOT NULL THEN a.blob WHEN b.dict_size = c.size THEN b.blob ELSE c.image END blob
FROM chunks c LEFT JOIN a USING (digest) LEFT JOIN b ON b.digest = c.digest WHERE c.layer = 1""")
def two_level_lookup(spark, sf_dir):
    chunks = model.chunks(spark, sf_dir)
    shared = chunks.filter("image = 'src0'").groupBy("digest").agg(F.min("image").alias("blob")).withColumn("dict_size", F.lit(0))
    parent = chunks.filter("layer = 0").groupBy("digest").agg(F.min("image").alias("blob"), F.max("size").alias("dict_size"))
    return dedup.two_level_lookup(chunks.filter("layer = 1"), shared, parent).select("ino", "idx", "origin", "blob")


@query("own_vs_ref_chunks", f"""WITH {CHUNKS}, u AS (SELECT digest, max(size) size FROM chunks WHERE ver >= 5 GROUP BY 1)
SELECT CASE WHEN EXISTS (SELECT 1 FROM chunks b WHERE b.ver < 5 AND b.digest = u.digest) THEN 'referenced' ELSE 'own' END kind, count(*) chunks, CAST(sum(size) AS BIGINT) bytes FROM u GROUP BY 1""")
def own_vs_ref_chunks(spark, sf_dir):
    chunks = model.chunks(spark, sf_dir)
    return dedup.own_and_referenced(chunks.filter("ver >= 5"), chunks.filter("ver < 5"))


def _blobs(spark, sf_dir):
    """Blobs of a store: one a supplier, with its file's path; every seventh has lost its file."""
    path = F.when(F.col("s_suppkey") % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("/cache/"), F.col("s_suppkey").cast("string")))
    return model.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("blob_id"), path.alias("file_path"))


def _store_chunks(spark, sf_dir):
    """Chunks of the store: a line item's part is its digest, its supplier the blob."""
    return model.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias("blob_id"), F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("digest"),
        (F.col("l_orderkey").cast("bigint") * 8 + F.col("l_linenumber")).alias("chunk_offset"), F.col("l_quantity").cast("bigint").alias("size"),
    )


BLOBS = "blobs AS (SELECT CAST(s_suppkey AS BIGINT) blob_id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE '/cache/'||s_suppkey END file_path FROM supplier)"
STORE = "store AS (SELECT CAST(l_suppkey AS BIGINT) blob_id, 'd'||l_partkey digest, CAST(l_orderkey AS BIGINT)*8+l_linenumber chunk_offset, CAST(l_quantity AS BIGINT) size FROM lineitem)"


@query("cas_lookup", f"""WITH {BLOBS}, {STORE}, r AS (SELECT s.digest, s.blob_id, b.file_path, s.chunk_offset, row_number() OVER (PARTITION BY digest ORDER BY s.blob_id, s.chunk_offset) rn
FROM store s JOIN blobs b USING (blob_id) WHERE b.file_path IS NOT NULL) SELECT digest, blob_id, file_path, chunk_offset FROM r WHERE rn = 1""")
def cas_lookup(spark, sf_dir):
    return dedup.cas_lookup(_store_chunks(spark, sf_dir), _blobs(spark, sf_dir).filter("file_path is not null"))


@query("cas_insert_or_ignore", f"WITH {STORE} SELECT digest, blob_id, min(chunk_offset) chunk_offset FROM store GROUP BY 1, 2")
def cas_insert_or_ignore(spark, sf_dir):
    rows = _store_chunks(spark, sf_dir).select("digest", "blob_id", "chunk_offset")
    return dedup.insert_or_ignore(rows, ["digest", "blob_id"], ["chunk_offset"])


@query("cas_delete_blobs", f"""WITH {BLOBS}, {STORE} SELECT 'blobs' kind, count(*) "rows" FROM blobs WHERE blob_id % 7 <> 0
UNION ALL SELECT 'chunks', count(*) FROM store WHERE blob_id % 7 <> 0""")
def cas_delete_blobs(spark, sf_dir):
    blobs = _blobs(spark, sf_dir)
    return dedup.delete_cascade(_store_chunks(spark, sf_dir), blobs, blobs.filter("file_path is null").select("blob_id"))


@query("cas_count_rows", f"WITH {BLOBS}, {STORE} SELECT 'Blobs' AS name, count(*) n FROM blobs UNION ALL SELECT 'Chunks', count(*) FROM store")
def cas_count_rows(spark, sf_dir):
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one(_blobs(spark, sf_dir), "Blobs").unionByName(one(_store_chunks(spark, sf_dir), "Chunks"))


@query("cas_keys", f"""WITH {CHUNKS} SELECT ino, idx, CASE WHEN ino % 11 = 0 THEN NULL ELSE 'sha256:'||digest END "key" FROM chunks""")
def cas_keys(spark, sf_dir):
    """Keys of chunks in the store; a chunk without a digest has none."""
    digest = F.when(F.col("ino") % 11 != 0, F.col("digest"))
    return model.chunks(spark, sf_dir).select("ino", "idx", F.when(digest.isNotNull(), F.concat_ws(":", F.lit("sha256"), digest)).alias("key"))


@query("cas_dedup_read", f"""WITH {CHUNKS}, held AS (SELECT digest, min(ino) from_ino FROM chunks WHERE ver = 0 GROUP BY 1)
SELECT c.ino, c.idx, h.from_ino, CASE WHEN h.from_ino IS NULL THEN 'Backend' ELSE 'CacheFast' END region FROM chunks c LEFT JOIN held h USING (digest) WHERE c.ver = 1""")
def cas_dedup_read(spark, sf_dir):
    """Where chunks of one version are read from: another file's copy or the backend."""
    chunks = model.chunks(spark, sf_dir)
    held = chunks.filter("ver = 0").groupBy("digest").agg(F.min("ino").alias("from_ino"))
    found = chunks.filter("ver = 1").join(held, "digest", "left")
    return found.select("ino", "idx", "from_ino", F.when(F.col("from_ino").isNull(), "Backend").otherwise("CacheFast").alias("region"))


@query("unused_blobs", f"WITH {BLOBS}, {STORE} SELECT blob_id FROM blobs WHERE blob_id NOT IN (SELECT blob_id FROM store WHERE size > 45 AND chunk_offset % 500 < 8)")
def unused_blobs(spark, sf_dir):
    return _blobs(spark, sf_dir).join(_store_chunks(spark, sf_dir).filter("size > 45 and chunk_offset % 500 < 8"), "blob_id", "left_anti").select("blob_id")


@query("stale_blobs", f"WITH {BLOBS} SELECT blob_id FROM blobs b WHERE NOT EXISTS (SELECT 1 FROM (SELECT '/cache/'||p_partkey listed FROM part WHERE p_partkey % 2 = 0) l WHERE l.listed = b.file_path)")
def stale_blobs(spark, sf_dir):
    """Blobs whose file isn't in the listing."""
    listed = model.table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("/cache/"), F.col("p_partkey").cast("string")).alias("file_path"))
    return _blobs(spark, sf_dir).join(listed, "file_path", "left_anti").select("blob_id")


@query("new_blobs", "SELECT DISTINCT CAST(l_suppkey AS BIGINT) blob_id FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7 AND l_quantity < 2)")
def new_blobs(spark, sf_dir):
    """Blobs of a manifest that the store doesn't list yet."""
    items = model.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("blob_id"), "l_returnflag", "l_linenumber", "l_quantity")
    return items.filter("l_returnflag = 'R'").select("blob_id").distinct().join(items.filter("l_linenumber = 7 and l_quantity < 2").select("blob_id"), "blob_id", "left_anti")


@query("blob_containment", "SELECT DISTINCT s_nationkey AS layer, count(*) FILTER (WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity < 3)) AS missing FROM supplier GROUP BY 1")
def blob_containment(spark, sf_dir):
    """Per image: blobs of its table that no manifest layer names; 0 passes."""
    layers = model.table(spark, sf_dir, "lineitem").filter("l_quantity < 3").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("known", F.lit(True))
    blobs = model.table(spark, sf_dir, "supplier").join(layers, "s_suppkey", "left")
    return blobs.groupBy(F.col("s_nationkey").alias("layer")).agg(F.count_if(F.col("known").isNull()).alias("missing"))


@query("extend_blob_list", f"""WITH {BLOBS} SELECT blob_id, 'table' origin FROM blobs WHERE blob_id % 2 = 0
UNION ALL SELECT blob_id, 'dictionary' FROM blobs WHERE blob_id % 3 = 0 AND blob_id % 2 <> 0""")
def extend_blob_list(spark, sf_dir):
    """A blob table with the dictionary's blobs that it lacks behind it."""
    blobs = _blobs(spark, sf_dir).select("blob_id")
    own, extra = blobs.filter("blob_id % 2 = 0"), blobs.filter("blob_id % 3 = 0")
    return own.withColumn("origin", F.lit("table")).unionByName(extra.join(own, "blob_id", "left_anti").withColumn("origin", F.lit("dictionary")))


THRESHOLD = f"""WITH {CHUNKS}, per AS (SELECT digest, count(*) uses, max(size) size FROM chunks GROUP BY 1), t AS (SELECT unnest(range(1, 21)) threshold)
SELECT CAST(threshold AS BIGINT) threshold, CAST(count(*) FILTER (uses >= threshold) AS BIGINT) base_chunks, CAST(coalesce(sum(size) FILTER (uses >= threshold), 0) AS BIGINT) base_bytes,
CAST(coalesce(sum(uses) FILTER (uses < threshold), 0) AS BIGINT) image_chunks, CAST(coalesce(sum(size*uses) FILTER (uses < threshold), 0) AS BIGINT) image_bytes FROM per, t GROUP BY 1"""


@query("dedup_threshold_table", THRESHOLD)
def dedup_threshold_table(spark, sf_dir):
    return dedup.threshold_table(model.chunks(spark, sf_dir))


@query("file_size_hist", f"WITH {FILES} SELECT CAST(CASE WHEN size = 0 THEN 0 ELSE least(length(bin(size)), 44) END AS BIGINT) bucket, count(*) files, CAST(sum(size) AS BIGINT) bytes FROM files GROUP BY 1")
def file_size_hist(spark, sf_dir):
    return dedup.size_histogram(model.files(spark, sf_dir))


@query("chunk_size_hist", f"WITH {FILES} SELECT CAST(k AS BIGINT) exponent, CAST(sum((size + (1 << k) - 1) // (1 << k)) AS BIGINT) chunks FROM files, (SELECT unnest(range(12, 21)) k) GROUP BY 1")
def chunk_size_hist(spark, sf_dir):
    return dedup.chunk_counts_by_size(model.files(spark, sf_dir))


IMAGE_STAT = f"""WITH {CHUNKS}, f AS (SELECT *, row_number() OVER (PARTITION BY image, sha256(text) ORDER BY ino) rn FROM files),
a AS (SELECT image, count(*) files, count(DISTINCT parent) dirs, CAST(sum(size) FILTER (rn=1) AS BIGINT) bytes, CAST(sum((4096 - size % 4096) % 4096) FILTER (rn=1) AS BIGINT) padding, count(*) FILTER (rn=1) links FROM f GROUP BY 1),
c AS (SELECT image, count(*) chunks, count(DISTINCT digest) unique_chunks FROM chunks GROUP BY 1)
SELECT image, files, dirs, bytes, padding, links, coalesce(chunks, 0) chunks, coalesce(unique_chunks, 0) unique_chunks FROM a LEFT JOIN c USING (image)"""


@query("image_stat", IMAGE_STAT)
def image_stat(spark, sf_dir):
    """Files of equal content in an image stand for hard links."""
    files = model.files(spark, sf_dir).withColumn("link", F.sha2("text", 256)).drop("text")
    return dedup.image_statistics(files, model.chunks(spark, sf_dir))


@query("used_blob_ratio", f"""WITH {CHUNKS}, per AS (SELECT image, digest, max(comp_size) one, sum(comp_size) every FROM chunks GROUP BY 1, 2)
SELECT image, CAST(sum(one) AS BIGINT) used, CAST(sum(every) AS BIGINT) blob_size, CAST(sum(one) * 100 // sum(every) AS BIGINT) ratio FROM per GROUP BY 1""")
def used_blob_ratio(spark, sf_dir):
    return dedup.used_ratio(model.chunks(spark, sf_dir))


@query("distinct_set_total", f"WITH {CHUNKS}, d AS (SELECT image, digest, max(comp_size) one FROM chunks GROUP BY 1, 2) SELECT count(*) chunks, CAST(coalesce(sum(one), 0) AS BIGINT) bytes FROM d")
def distinct_set_total(spark, sf_dir):
    return dedup.distinct_set(model.chunks(spark, sf_dir), ["image", "digest"])


@query("chunk_set_union", f"WITH {CHUNKS} SELECT image, digest, max(comp_size) comp_size FROM chunks WHERE ver IN (1, 2) GROUP BY 1, 2")
def chunk_set_union(spark, sf_dir):
    """Union of two chunk sets, key by key, the first's value where both have one."""
    chunks = model.chunks(spark, sf_dir)
    one = lambda v: chunks.filter(F.col("ver") == v).groupBy("image", "digest").agg(F.max("comp_size").alias("comp_size"))
    both = one(1).withColumn("o", F.lit(0)).unionByName(one(2).withColumn("o", F.lit(1)))
    return both.groupBy("image", "digest").agg(F.min_by("comp_size", "o").alias("comp_size"))


@query("size_by_blob", f"WITH {CHUNKS} SELECT image, CAST(sum(size) AS BIGINT) bytes FROM chunks GROUP BY 1")
def size_by_blob(spark, sf_dir):
    return model.chunks(spark, sf_dir).groupBy("image").agg(F.sum("size").alias("bytes"))


@query("filter_small_blobs", f"WITH {CHUNKS}, t AS (SELECT image FROM chunks GROUP BY 1 HAVING sum(size) >= 120000) SELECT ino, idx, image FROM chunks WHERE image IN (SELECT image FROM t)")
def filter_small_blobs(spark, sf_dir):
    return dedup.drop_small_blobs(model.chunks(spark, sf_dir), 120_000).select("ino", "idx", "image")


@query("chunks_by_image", f"WITH {CHUNKS} SELECT image, version, count(*) chunks, md5(string_agg(digest, ',' ORDER BY ino, idx)) list_md5 FROM chunks GROUP BY 1, 2")
def chunks_by_image(spark, sf_dir):
    """Chunk lists of an image's versions in order, as a checksum."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ino", "idx", "digest"))), lambda x: x["digest"]), ",")
    return model.chunks(spark, sf_dir).groupBy("image", "version").agg(F.count("*").alias("chunks"), F.md5(ordered).alias("list_md5"))


@query("filter_by_blob", f"WITH {CHUNKS} SELECT ino, idx, digest FROM chunks WHERE image = 'src3'")
def filter_by_blob(spark, sf_dir):
    return model.chunks(spark, sf_dir).filter("image = 'src3'").select("ino", "idx", "digest")


@query("blob_by_id", f"WITH {BLOBS} SELECT blob_id, file_path FROM blobs WHERE blob_id = 10")
def blob_by_id(spark, sf_dir):
    return _blobs(spark, sf_dir).filter("blob_id = 10")


@query("used_blobs_first_use", f"WITH {CHUNKS}, f AS (SELECT image, min(ino * 100000 + idx) first FROM chunks GROUP BY 1) SELECT image, row_number() OVER (ORDER BY first) - 1 blob_index FROM f")
def used_blobs_first_use(spark, sf_dir):
    """Blobs renumbered in the order of their first use; blobs are few against chunks."""
    from pyspark.sql import Window as W

    first = model.chunks(spark, sf_dir).groupBy("image").agg(F.min(F.col("ino") * 100000 + F.col("idx")).alias("first"))
    return first.select("image", (F.row_number().over(W.orderBy("first")).cast("bigint") - 1).alias("blob_index"))


@query("validate_digests", f"WITH {CHUNKS} SELECT image, count(*) checked, count(*) FILTER (ino % 13 = 0 AND idx = 0) bad FROM chunks GROUP BY 1")
def validate_digests(spark, sf_dir):
    """Chunks whose recorded digest their bytes don't have; every thirteenth file's first record is damaged."""
    recorded = F.when((F.col("ino") % 13 == 0) & (F.col("idx") == 0), F.lit("damaged")).otherwise(F.col("digest"))
    return model.chunks(spark, sf_dir).withColumn("recorded", recorded).groupBy("image").agg(F.count("*").alias("checked"), F.count_if(F.col("recorded") != F.col("digest")).alias("bad"))
