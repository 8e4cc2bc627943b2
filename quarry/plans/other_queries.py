"""Queries of dictionaries from image histories, scalar functions, sources, sorting, and state."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import model
from quarry.functions import scalar
from quarry.model import CHUNKS, FILES, OPERATIONS
from quarry.operators import dictionary, trees
from quarry.operators.prefix import CELL, CELL_BYTES, running
from quarry.plans.catalog import query
from quarry.plans.range_queries import LAYOUT, _layout
from quarry.sources import formats, sinks
from quarry.streaming import state, streams


@query("image_distance", f"""WITH {CHUNKS}, i AS (SELECT DISTINCT image FROM chunks), p AS (SELECT a.image a, b.image b FROM i a JOIN i b ON a.image < b.image),
x AS (SELECT p.a, p.b, c.digest, c.size, row_number() OVER (PARTITION BY p.a, p.b, c.digest ORDER BY c.size DESC, c.image, c.ino, c.idx) rn FROM p JOIN chunks c ON c.image IN (p.a, p.b))
SELECT a, b, round(1.0 - coalesce(sum(size) FILTER (rn > 1), 0)::DOUBLE / sum(size)::DOUBLE, 9) distance FROM x GROUP BY 1, 2""")
def image_distance(spark, sf_dir):
    out = dictionary.distances(model.chunks(spark, sf_dir))
    return out.select("a", "b", F.round("distance", 9).alias("distance"))


@query("image_clusters")
def image_clusters(spark, sf_dir):
    """Density clusters of images whose chunks are line items' parts; five points suffice for a core here."""
    items = model.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("i"), (F.col("l_suppkey") % 40).cast("string")).alias("image"), (F.col("l_partkey") % 60).cast("string").alias("digest"), F.lit(1).cast("bigint").alias("size")
    )
    return dictionary.cluster_images(items, least=5)


@query("cluster_vote", f"""WITH {CHUNKS}, k AS (SELECT DISTINCT image, CAST(substring(image, 4) AS BIGINT) % 3 AS cluster FROM chunks), n AS (SELECT cluster, count(*) n FROM k GROUP BY 1),
h AS (SELECT cluster, left(digest, 1) digest, count(DISTINCT c.image) images FROM chunks c JOIN k ON k.image = c.image GROUP BY 1, 2)
SELECT h.cluster, digest, images FROM h JOIN n USING (cluster) WHERE images >= n * 0.9""")
def cluster_vote(spark, sf_dir):
    """Chunk classes (by the digest's first digit) that nine tenths of a cluster's images have."""
    chunks = model.chunks(spark, sf_dir).withColumn("digest", F.substring("digest", 1, 1))
    clusters = chunks.select("image").distinct().withColumn("cluster", F.substring("image", 4, 9).cast("bigint") % 3)
    return dictionary.cluster_votes(chunks, clusters)


@query("noise_points", f"WITH {CHUNKS} SELECT DISTINCT image FROM chunks WHERE image NOT IN ('src1', 'src2', 'src3')")
def noise_points(spark, sf_dir):
    clusters = spark.createDataFrame([("src1", 1), ("src2", 1), ("src3", 2)], "image string, cluster bigint")
    return dictionary.noise(model.chunks(spark, sf_dir), clusters)


@query("train_test_split", f"""WITH {CHUNKS}, v AS (SELECT DISTINCT image, version, ver FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY ver) nth, count(*) OVER (PARTITION BY image) n FROM v)
SELECT image, version, CASE WHEN nth <= floor(n*0.7) THEN 'train' ELSE 'test' END part FROM r""")
def train_test_split(spark, sf_dir):
    return dictionary.split_versions(model.chunks(spark, sf_dir)).select("image", "version", "part").distinct()


@query("natural_version_sort", """WITH v AS (SELECT DISTINCT 'v'||(o_orderkey%12)||'.'||(o_custkey%15)||CASE WHEN o_orderkey%2=0 THEN '-rc'||(o_custkey%3) ELSE '' END version FROM orders)
SELECT version, row_number() OVER (ORDER BY list_transform(regexp_extract_all(version, '(\\d+)', 1), lambda x: CAST(x AS BIGINT)), version) rank FROM v""")
def natural_version_sort(spark, sf_dir):
    orders = model.table(spark, sf_dir, "orders")
    rc = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-rc"), (F.col("o_custkey") % 3).cast("string"))).otherwise("")
    version = F.concat(F.lit("v"), (F.col("o_orderkey") % 12).cast("string"), F.lit("."), (F.col("o_custkey") % 15).cast("string"), rc)
    versions = orders.select(version.alias("version")).distinct()
    return versions.withColumn("rank", F.row_number().over(W.orderBy(dictionary.natural_key(F.col("version")), "version")).cast("bigint"))


_SMOOTH = CHUNKS + """, pv AS (SELECT image, ver, lag(ver) OVER (PARTITION BY image ORDER BY ver) prev FROM (SELECT DISTINCT image, ver FROM chunks)),
m AS (SELECT c.image, c.ver, c.ino, c.idx, pv.prev, EXISTS (SELECT 1 FROM chunks o WHERE o.image=c.image AND o.ver=pv.prev AND o.digest[1:1]=c.digest[1:1])::INT dup, row_number() OVER (PARTITION BY c.image ORDER BY c.ver, c.ino, c.idx) rn FROM chunks c JOIN pv ON pv.image=c.image AND pv.ver=c.ver)"""


@query("exp_smoothing", f"""WITH {_SMOOTH} SELECT image, ino, idx, CASE WHEN prev IS NULL THEN 0.0 ELSE round(sum(dup*power(2.0, rn)) OVER (PARTITION BY image ORDER BY rn ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) / power(2.0, rn+1), 9) END::DOUBLE score FROM m""")
def exp_smoothing(spark, sf_dir):
    """Scores of chunk classes (the digest's first digit), as whole digests seldom recur between versions here."""
    rows = model.chunks(spark, sf_dir).withColumns({"pos": F.struct("ino", "idx"), "digest": F.substring("digest", 1, 1)})
    return dictionary.smoothed(rows, cell=F.floor(F.col("ino") / CELL)).select("image", "ino", "idx", F.round("score", 9).alias("score"))


@query("dict_search_versions")
def dict_search_versions(spark, sf_dir):
    chunks = model.chunks(spark, sf_dir).withColumn("digest", F.substring("digest", 1, 2))
    return dictionary.search_versions(chunks)


@query("dict_search_images")
def dict_search_images(spark, sf_dir):
    """Dictionaries of clusters of images over line items: the supplier's group is the image, the order its version."""
    items = model.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("i"), (F.col("l_suppkey") % 30).cast("string")).alias("image"), F.concat(F.lit("v"), (F.col("l_orderkey") % 10).cast("string")).alias("version"),
        (F.col("l_partkey") % 40).cast("string").alias("digest"), F.lit(1).cast("bigint").alias("size"),
    )
    return dictionary.search_images(items.distinct(), least=5)


@query("chunk_compress", f"WITH {CHUNKS}, c AS (SELECT unnest(['none', 'gzip', 'zstd', 'lz4']) codec) SELECT codec, ino, idx, size, digest FROM chunks CROSS JOIN c")
def chunk_compress(spark, sf_dir):
    """Digests of all chunks after each codec has packed and unpacked them; bytes stay as they are where packing doesn't help."""
    chunks = model.chunks(spark, sf_dir).select("ino", "idx", "size")
    bodies = model.files(spark, sf_dir).select("ino", F.encode("text", "UTF-8").alias("body"))
    part = F.expr("substring(body, cast(idx * 4096 + 1 as int), 4096)")
    pieces = chunks.join(bodies, "ino").select("ino", "idx", "size", part.alias("part"), F.explode(F.array(*[F.lit(c) for c in scalar.CODECS])).alias("codec"))
    packed = pieces.select("codec", "ino", "idx", "size", scalar.packed("part", "codec").alias("packed"))
    return packed.select("codec", "ino", "idx", "size", F.sha2(scalar.unpacked("packed", "codec", "size"), 256).alias("digest"))


@query("build_output_json", f"""WITH {CHUNKS} SELECT '{{"blobs":'||to_json(list_sort(list(DISTINCT image)))||',"chunks":'||count(*)||'}}' json FROM chunks""")
def build_output_json(spark, sf_dir):
    """What a build reports: its blobs and chunks."""
    out = model.chunks(spark, sf_dir).agg(F.array_sort(F.collect_set("image")).alias("blobs"), F.count("*").alias("chunks"))
    return sinks.as_json(out)


@query("dict_completion", f"""WITH {CHUNKS}, d AS (SELECT DISTINCT image, digest, size FROM chunks WHERE digest < '02')
SELECT image, digest, size FROM d UNION SELECT image, digest, size FROM chunks WHERE image IN (SELECT image FROM d)""")
def dict_completion(spark, sf_dir):
    chunks = model.chunks(spark, sf_dir)
    return dictionary.completed(chunks.filter("digest < '02'").select("image", "digest", "size").distinct(), chunks)


_SMALL = f"""{CHUNKS}, b AS (SELECT image, CAST(sum(comp_size) AS BIGINT) s FROM chunks GROUP BY 1 HAVING sum(comp_size) <= 400000),
n AS (SELECT image, s, row_number() OVER (ORDER BY s, image) rn FROM b),
r(image, rn, k, "offset", total) AS (SELECT image, rn, CAST(0 AS BIGINT), CAST(0 AS BIGINT), s FROM n WHERE rn = 1 UNION ALL SELECT n.image, n.rn, r.k + CASE WHEN r.total + n.s > 400000 THEN 1 ELSE 0 END,
 CASE WHEN r.total + n.s > 400000 THEN 0 ELSE r.total END, n.s + CASE WHEN r.total + n.s > 400000 THEN 0 ELSE r.total END FROM r JOIN n ON n.rn = r.rn + 1)"""


@query("compact_greedy_merge", f"""WITH RECURSIVE {_SMALL} SELECT image, k merged, "offset" FROM r""")
def compact_greedy_merge(spark, sf_dir):
    """Small blobs merged in order of size while a merged blob stays within a bound."""
    from quarry.operators.compaction import greedy_merge

    blobs = model.chunks(spark, sf_dir).groupBy("image").agg(F.sum("comp_size").alias("size"))
    return greedy_merge(blobs, "image", "size", 400_000)


@query("sort_dict_chunks", f"""WITH {LAYOUT} SELECT image, comp_offset, digest, row_number() OVER (PARTITION BY image ORDER BY comp_offset, uncomp_offset, digest) - 1 place FROM laid""")
def sort_dict_chunks(spark, sf_dir):
    laid, order = _layout(spark, sf_dir), ["comp_offset", "uncomp_offset", "digest"]
    return running(laid, ["image"], F.floor(F.col("comp_offset") / CELL_BYTES), order, {}, index="place").select("image", "comp_offset", "digest", "place")


@query("blobs_by_size", f"WITH {CHUNKS} SELECT image, CAST(sum(comp_size) AS BIGINT) bytes FROM chunks GROUP BY 1 ORDER BY bytes, image LIMIT 5")
def blobs_by_size(spark, sf_dir):
    """The five smallest blobs."""
    return model.chunks(spark, sf_dir).groupBy("image").agg(F.sum("comp_size").alias("bytes")).orderBy("bytes", "image").limit(5)


@query("paged_list", f"WITH {CHUNKS} SELECT ino, idx, digest FROM chunks ORDER BY ino, idx LIMIT 100 OFFSET 300")
def paged_list(spark, sf_dir):
    return model.chunks(spark, sf_dir).select("ino", "idx", "digest").orderBy("ino", "idx").offset(300).limit(100)


@query("paged_by_blob", f"WITH {CHUNKS} SELECT ino, idx, digest FROM chunks WHERE image='src0' ORDER BY ino, idx LIMIT 10 OFFSET 5")
def paged_by_blob(spark, sf_dir):
    return model.chunks(spark, sf_dir).filter("image = 'src0'").select("ino", "idx", "digest").orderBy("ino", "idx").offset(5).limit(10)


@query("sha256_text", f"WITH {FILES} SELECT ino, sha256(text) digest, octet_length(unhex(sha256(text))) AS \"bytes\" FROM files")
def sha256_text(spark, sf_dir):
    digest = F.sha2("text", 256)
    return model.files(spark, sf_dir).select("ino", digest.alias("digest"), F.octet_length(F.unhex(digest)).cast("bigint").alias("bytes"))


@query("crc32c_text")
def crc32c_text(spark, sf_dir):
    return model.files(spark, sf_dir).select("ino", scalar.crc32c(F.encode("text", "UTF-8")).alias("crc"))


@query("codec_round_trip", f"WITH {FILES} SELECT ino, size, sha256(text) digest, true smaller FROM files")
def codec_round_trip(spark, sf_dir):
    """Digests of whole files after compression, and whether it gave no more bytes than there were."""
    body = F.encode("text", "UTF-8")
    packed = model.files(spark, sf_dir).select("ino", "size", body.alias("body")).withColumn("packed", scalar.gzip_or_raw("body"))
    return packed.select("ino", "size", F.sha2(scalar.gunzip_or_raw("packed"), 256).alias("digest"), (F.octet_length("packed") <= F.col("size")).alias("smaller"))


@query("encrypt_round_trip", f"WITH {FILES} SELECT ino, sha256(text) digest, size + 28 AS cipher_size, true hidden FROM files")
def encrypt_round_trip(spark, sf_dir):
    body, key = F.encode("text", "UTF-8"), F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    held = model.files(spark, sf_dir).select("ino", body.alias("body")).withColumn("cipher", scalar.encrypted(F.col("body"), key))
    hidden = ~F.contains("cipher", "body") | (F.octet_length("body") == 0)
    return held.select("ino", F.sha2(scalar.decrypted(F.col("cipher"), key), 256).alias("digest"), F.octet_length("cipher").cast("bigint").alias("cipher_size"), hidden.alias("hidden"))


@query("round_up_4k", f"WITH {FILES} SELECT ino, (size+4095)//4096*4096 aligned FROM files")
def round_up_4k(spark, sf_dir):
    return model.files(spark, sf_dir).select("ino", scalar.round_up(F.col("size")).alias("aligned"))


@query("merkle_level_sizes", """WITH RECURSIVE l(pages, level, n) AS (SELECT DISTINCT CAST(p_size AS BIGINT) * 1000, 1, (CAST(p_size AS BIGINT) * 1000 + 127) // 128 FROM part
UNION ALL SELECT pages, level + 1, (n + 127) // 128 FROM l WHERE n > 1) SELECT pages, CAST(level AS BIGINT) AS level, n FROM l""")
def merkle_level_sizes(spark, sf_dir):
    """Pages of each level of the hash trees over as many thousands of pages as parts have sizes; a tree of 2**63 pages has nine levels."""
    pages = model.table(spark, sf_dir, "part").select((F.col("p_size").cast("bigint") * 1000).alias("pages")).distinct()
    levels = trees.merkle_levels_of(F.col("pages"))
    return pages.select("pages", F.posexplode(levels).alias("place", "n")).select("pages", (F.col("place") + 1).cast("bigint").alias("level"), "n")


@query("split_paths", f"WITH {FILES} SELECT ino, '/,'||array_to_string(string_split(path[2:], '/'), ',') parts, CASE WHEN starts_with(path, '/src1/') THEN path[6:] ELSE path END moved FROM files")
def split_paths(spark, sf_dir):
    return model.files(spark, sf_dir).select("ino", F.array_join(scalar.components(F.col("path")), ",").alias("parts"), scalar.reparented(F.col("path"), "/src1").alias("moved"))


@query("file_types", "SELECT CAST(s_suppkey AS BIGINT) id, CASE s_suppkey%4 WHEN 0 THEN 'dir' WHEN 1 THEN 'file' WHEN 2 THEN 'symlink' ELSE 'special' END kind FROM supplier")
def file_types(spark, sf_dir):
    k = F.col("s_suppkey")
    mode = F.when(k % 4 == 0, 0o040755).when(k % 4 == 1, 0o100644).when(k % 4 == 2, 0o120777).otherwise(0o020600)
    return model.table(spark, sf_dir, "supplier").select(k.cast("bigint").alias("id"), scalar.file_type(mode).alias("kind"))


@query("flag_bits", "SELECT CAST(p_partkey AS BIGINT) flags, (p_partkey & 4) <> 0 bit2, bit_count(CAST(p_partkey AS BIGINT))::INT set_bits FROM part")
def flag_bits(spark, sf_dir):
    flags = F.col("p_partkey").cast("bigint")
    return model.table(spark, sf_dir, "part").select(flags.alias("flags"), scalar.has_flag(flags, 2).alias("bit2"), F.bit_count(flags).alias("set_bits"))


@query("blob_id_from_path", f"WITH {FILES} SELECT ino, CASE WHEN ino%3<>0 THEN sha256(text) END blob_id FROM files")
def blob_id_from_path(spark, sf_dir):
    digest = F.sha2("text", 256)
    path = F.concat(F.lit("/cache/"), F.when(F.col("ino") % 3 == 0, F.substring(digest, 1, 20)).otherwise(digest), F.lit(".blob.meta"))
    return model.files(spark, sf_dir).select("ino", scalar.blob_id(path).alias("blob_id"))


@query("image_tag_split", f"WITH {FILES} SELECT DISTINCT image, version AS tag FROM files")
def image_tag_split(spark, sf_dir):
    image, tag = scalar.image_and_tag(F.concat(F.lit("registry:"), "image", F.lit(":"), "version"))
    return model.files(spark, sf_dir).select(image.alias("image"), tag.alias("tag")).distinct()


@query("url_query_part", "SELECT page_id, CASE WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) <> '' THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END page FROM pages")
def url_query_part(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select("page_id", scalar.query_part(F.col("url"), "page").alias("page"))


@query("parse_config", "SELECT CAST(s_suppkey AS BIGINT) id, CAST(s_suppkey*2 AS BIGINT) threads, s_suppkey%2=0 prefetch FROM supplier")
def parse_config(spark, sf_dir):
    k = F.col("s_suppkey").cast("bigint")
    text = F.to_json(F.struct(F.struct((k * 2).alias("threads"), (k % 2 == 0).alias("enable")).alias("prefetch")))
    config = F.from_json(text, "prefetch struct<threads:bigint,enable:boolean>")
    return model.table(spark, sf_dir, "supplier").select(k.alias("id"), config["prefetch"]["threads"].alias("threads"), config["prefetch"]["enable"].alias("prefetch"))


@query("xattr_parse", "SELECT CAST(s_suppkey AS BIGINT) id, 'v'||s_suppkey \"user\", 'y' opaque FROM supplier")
def xattr_parse(spark, sf_dir):
    """Extended attributes as a map of name to bytes."""
    k = F.col("s_suppkey").cast("string")
    pairs = F.concat(F.lit("user.a="), F.lit("v"), k, F.lit(";trusted.overlay.opaque=y"))
    held = F.transform_values(F.str_to_map(pairs, F.lit(";"), F.lit("=")), lambda _, v: v.cast("binary"))
    return model.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), held["user.a"].cast("string").alias("user"), held["trusted.overlay.opaque"].cast("string").alias("opaque"))


@query("sniff_compression", f"WITH {FILES} SELECT ino, CASE WHEN ino%2=0 THEN 'gzip' ELSE 'none' END kind FROM files")
def sniff_compression(spark, sf_dir):
    body = F.encode("text", "UTF-8")
    head = F.when(F.col("ino") % 2 == 0, F.concat(F.unhex(F.lit("1F8B")), body)).otherwise(body)
    return model.files(spark, sf_dir).select("ino", formats.sniff_compression(head).alias("kind"))


@query("toc_entries", f"WITH {FILES} SELECT image, name, size FROM files")
def toc_entries(spark, sf_dir):
    """Tables of contents, one an image, written as JSON and read back."""
    entry = F.struct("name", F.lit("reg").alias("type"), "size")
    tables = model.files(spark, sf_dir).groupBy("image").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(entry).alias("entries"))).alias("toc"))
    return formats.toc_entries(tables, "toc").select("image", "entry.name", "entry.size")


@query("attributes_file", "SELECT '/a/'||s_suppkey AS path, 'ext'||s_suppkey kind, CAST(s_suppkey AS BIGINT) first_crc, 2::INT crcs FROM supplier")
def attributes_file(spark, sf_dir):
    k = F.col("s_suppkey")
    line = F.concat(F.lit("a/"), k.cast("string"), F.lit(" type=ext"), k.cast("string"), F.lit(" crcs=0x"), F.lower(F.hex(k.cast("bigint"))), F.lit(",0xff"))
    rows = formats.parse_attributes(model.table(spark, sf_dir, "supplier").select(line.alias("value")))
    return rows.select("path", F.col("attributes")["type"].alias("kind"), F.col("crcs")[0].alias("first_crc"), F.size("crcs").alias("crcs"))


@query("prefetch_json", f"WITH {FILES} SELECT path, CASE WHEN ino%4<>0 THEN ino END \"offset\", CASE WHEN ino%4<>0 THEN size END size FROM files WHERE ino%3<>0")
def prefetch_json(spark, sf_dir):
    """Prefetch lists, one an image; every third path is relative and left out."""
    path = F.when(F.col("ino") % 3 == 0, F.substring("path", 2, 1 << 20)).otherwise(F.col("path"))
    ranges = F.when(F.col("ino") % 4 != 0, F.array(F.array("ino", "size")))
    listed = model.files(spark, sf_dir).groupBy("image").agg(F.to_json(F.struct(F.lit("v1").alias("version"), F.collect_list(F.struct(path.alias("path"), ranges.alias("ranges"))).alias("files"))).alias("json"))
    return formats.prefetch_ranges(listed, "json")


@query("tar_round_trip", f"WITH {FILES} SELECT image AS archive, path, size, sha256(text) digest FROM files")
def tar_round_trip(spark, sf_dir):
    files = model.files(spark, sf_dir).select("image", "path", F.encode("text", "UTF-8").alias("content"))
    return sinks.tar_round_trip(files, "image").select("archive", "path", "size", F.sha2("content", 256).alias("digest"))


@query("bootstrap_names", f"WITH {CHUNKS} SELECT image, sha256(string_agg(digest, '' ORDER BY digest)) AS name FROM (SELECT DISTINCT image, digest FROM chunks) GROUP BY 1")
def bootstrap_names(spark, sf_dir):
    return sinks.content_name(model.chunks(spark, sf_dir), ["image"], "digest")


@query("blob_contents_table", f"""WITH {FILES} SELECT image AS blob, name, size, CAST(coalesce(sum(size) OVER (PARTITION BY image ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) "offset" FROM files""")
def blob_contents_table(spark, sf_dir):
    return sinks.contents_table(model.files(spark, sf_dir).select(F.col("image").alias("blob"), "name", "size"))


@query("stats_json", f"""WITH {CHUNKS} SELECT '{{"bytes":'||CAST(sum(size) AS BIGINT)||',"chunks":'||count(*)||',"image":"'||image||'"}}' json FROM chunks GROUP BY image""")
def stats_json(spark, sf_dir):
    stats = model.chunks(spark, sf_dir).groupBy("image").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))
    return sinks.as_json(stats)


@query("chunk_sink_round_trip", f"WITH {CHUNKS} SELECT image, count(*) chunks, CAST(sum(size) AS BIGINT) bytes FROM chunks GROUP BY 1")
def chunk_sink_round_trip(spark, sf_dir):
    """Chunk tables written to the shared folder and read back."""
    from quarry.session import scratch

    path = scratch(spark, "chunks")
    sinks.write_chunks(model.chunks(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("image").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


@query("token_bucket", f"""WITH RECURSIVE {OPERATIONS}, n AS (SELECT ino, seq, ts, bytes, row_number() OVER (PARTITION BY ino ORDER BY ts, seq) rn FROM ops WHERE op='read'),
r(ino, seq, rn, seen, held, wait) AS (SELECT ino, seq, rn, ts, greatest(20 - bytes, 0), greatest(bytes - 20, 0) / 10.0::DOUBLE FROM n WHERE rn = 1 UNION ALL
 SELECT n.ino, n.seq, n.rn, n.ts, greatest(least(20, r.held + (n.ts - r.seen) * 10) - n.bytes, 0), greatest(n.bytes - least(20, r.held + (n.ts - r.seen) * 10), 0) / 10.0::DOUBLE FROM r JOIN n ON n.ino = r.ino AND n.rn = r.rn + 1)
SELECT ino, seq, CAST(wait AS DOUBLE) wait FROM r""")
def token_bucket(spark, sf_dir):
    reads = model.operations(spark, sf_dir).filter("op = 'read'")
    return state.token_buckets(reads, "ino", "ts", "bytes", "seq", 10)


@query("single_flight", f"""WITH {OPERATIONS} SELECT ino, seq, row_number() OVER (PARTITION BY ino, ts//3600 ORDER BY ts, seq) = 1 leads FROM ops""")
def single_flight(spark, sf_dir):
    return state.first_requests(model.operations(spark, sf_dir), ["ino"], "ts", "seq", 3600).select("ino", "seq", "leads")


@query("chunk_readiness", f"""WITH {OPERATIONS} SELECT ino, min(ts) ready_at, count(*) - 1 found_ready FROM ops GROUP BY 1""")
def chunk_readiness(spark, sf_dir):
    return state.newly_ready(model.operations(spark, sf_dir), "ino", "ts", "seq")


@query("prefetch_queue_flush", f"""WITH {OPERATIONS} SELECT seq, ino FROM ops WHERE op='open' AND NOT (ino%10=3 AND seq < 5000)""")
def prefetch_queue_flush(spark, sf_dir):
    """Queued prefetch requests left when those of one blob are flushed."""
    return model.operations(spark, sf_dir).filter("op = 'open' and not (ino % 10 = 3 and seq < 5000)").select("seq", "ino")


@query("streaming_tumbling", "SELECT CAST(floor(epoch(ts)/86400)*86400 AS BIGINT) slot, event_type, count(*) n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def streaming_tumbling(spark, sf_dir):
    """Tumbling metrics by a stream over the events' files."""
    return streams.drain(streams.tumbling(streams.event_stream(spark, sf_dir))).select("slot", "event_type", "n", F.round("value", 4).alias("value"))


@query("streaming_first", "SELECT CAST(user_id AS BIGINT) user_id, count(DISTINCT event_type) kinds FROM events GROUP BY 1")
def streaming_first(spark, sf_dir):
    """Distinct kinds of events of each user: a stream keeps the first row of a kind."""
    rows = streams.drain(streams.first_by_key(streams.event_stream(spark, sf_dir), ["user_id", "event_type"], "60 days"), "append")
    return rows.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(F.count("*").alias("kinds"))


@query("streaming_rate_limit", """WITH RECURSIVE n AS (SELECT CAST(user_id AS BIGINT) k, floor(epoch(ts)) t, CAST(trunc(value * 10) AS BIGINT) a, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), trunc(value * 10)) rn FROM events),
r(k, rn, t, held, waited) AS (SELECT k, rn, t, greatest(2 - a, 0), CAST(greatest(a - 2, 0) AS DOUBLE) FROM n WHERE rn = 1 UNION ALL
 SELECT n.k, n.rn, n.t, greatest(least(2, r.held + n.t - r.t) - n.a, 0), r.waited + greatest(n.a - least(2, r.held + n.t - r.t), 0) FROM r JOIN n ON n.k = r.k AND n.rn = r.rn + 1)
SELECT k, max(rn) requests, max(waited) waited FROM r GROUP BY 1""")
def streaming_rate_limit(spark, sf_dir):
    """A token bucket held as a stream's state."""
    stream = streams.event_stream(spark, sf_dir).withColumn("amount", (F.col("value") * 10).cast("bigint"))
    rows = streams.drain(streams.limited(stream, "user_id", "amount", 1), "update")
    return rows.groupBy("k").agg(F.max("requests").alias("requests"), F.round(F.max("waited"), 6).alias("waited"))


@query("convert_image", f"""WITH {CHUNKS}, d AS (SELECT digest, min((ino, idx)) first FROM chunks GROUP BY 1), m AS (SELECT c.*, (c.ino, c.idx) = d.first own FROM chunks c JOIN d USING (digest))
SELECT image, count(*) chunks, count(*) FILTER (own) written, CAST(coalesce(sum(comp_size) FILTER (own), 0) AS BIGINT) blob_size, CAST(sum(size) AS BIGINT) image_size FROM m GROUP BY 1""")
def convert_image(spark, sf_dir):
    """Conversion of all images in order: the chunks and bytes each one's blob gets once earlier chunks are found again."""
    chunks = model.chunks(spark, sf_dir).withColumn("at", F.struct("ino", "idx"))
    first = chunks.groupBy("digest").agg(F.min("at").alias("first"))
    own = F.col("at") == F.col("first")
    return chunks.join(first, "digest").groupBy("image").agg(
        F.count("*").alias("chunks"), F.count_if(own).alias("written"), F.coalesce(F.sum(F.when(own, F.col("comp_size"))), F.lit(0)).alias("blob_size"), F.sum("size").alias("image_size")
    )


@query("ino_from_path", f"WITH {FILES} SELECT ino, path FROM files")
def ino_from_path(spark, sf_dir):
    """Inodes of stated paths, joined on the whole path."""
    wanted = model.files(spark, sf_dir).select("path").distinct()
    return model.files(spark, sf_dir).join(wanted, "path", "left_semi").select("ino", "path")


def flagship(spark, sf_dir):
    """Chunks, digests and deduplicated bytes of each source."""
    from quarry.plans.dedup_queries import dedup_by_source

    return dedup_by_source(spark, sf_dir)


