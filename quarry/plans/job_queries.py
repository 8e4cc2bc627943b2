"""Queries of whole jobs: a kept store, compaction, prefetch blobs, checks, commits, copies, packing, and state keyed by index or digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import model
from quarry.model import CHUNKS, ENTRIES, FILES, OPERATIONS
from quarry.operators import compaction, overlay, ranges, trees
from quarry.operators.prefix import CELL_BYTES, running, text_cell
from quarry.plans.catalog import query
from quarry.plans.range_queries import LAYOUT, _layout
from quarry.plans.tree_queries import _PATTERNS, NODES, _nodes, _patterns
from quarry.session import scratch
from quarry.sources import backends, sinks
from quarry.sources.store import ChunkStore
from quarry.streaming import state

_STORED = CHUNKS + """, s AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY layer > 0, ino, idx) rn FROM chunks)"""


def _store(spark, sf_dir):
    """Chunks of the lowest layer, then of the others, are inserted; the blobs whose name ends in 3 are deleted."""
    chunks = model.chunks(spark, sf_dir).select("digest", "image", "ino", "idx", "layer", "size")
    store = ChunkStore(spark, scratch(spark, "store"), ["digest"], "image")
    store.insert(chunks.filter("layer = 0"), ["ino", "idx"])
    store.insert(chunks.filter("layer > 0"), ["ino", "idx"])
    store.delete(chunks.filter("image like '%3'"))
    return store


@query("store_rows", f"WITH {_STORED} SELECT digest, image, ino, idx FROM s WHERE rn = 1 AND image NOT LIKE '%3'")
def store_rows(spark, sf_dir):
    """Rows of a kept chunk store after inserts that ignore what is there, and a delete by blob."""
    return _store(spark, sf_dir).rows().select("digest", "image", "ino", "idx")


@query("store_lookup", f"WITH {_STORED} SELECT c.ino, c.idx, s.image AS held_by, s.ino AS held_ino FROM chunks c JOIN s ON s.digest = c.digest AND s.rn = 1 AND s.image NOT LIKE '%3'")
def store_lookup(spark, sf_dir):
    """Every chunk of every file, looked up in the kept store."""
    wanted = model.chunks(spark, sf_dir).select("digest", F.col("ino").alias("asked"), F.col("idx").alias("place"))
    return _store(spark, sf_dir).lookup(wanted).select(F.col("asked").alias("ino"), F.col("place").alias("idx"), F.col("image").alias("held_by"), F.col("ino").alias("held_ino"))


@query("store_pages", f"WITH {_STORED} SELECT digest, (row_number() OVER (ORDER BY ino, idx) - 1) // 100 AS page FROM s WHERE rn = 1 AND image NOT LIKE '%3'")
def store_pages(spark, sf_dir):
    """The kept store listed page by page to its end."""
    return _store(spark, sf_dir).pages(["ino", "idx"], 100).select("digest", "page")


_IN_USE = "u AS (SELECT DISTINCT digest FROM chunks WHERE ver < 6 AND image <> 'src1')"
_STATES = f"""{_IN_USE}, o AS (SELECT image, c.digest, max(comp_size) one, sum(comp_size) every, max(CASE WHEN u.digest IS NULL THEN 0 ELSE 1 END) used FROM chunks c LEFT JOIN u ON u.digest = c.digest GROUP BY 1, 2),
b AS (SELECT image, CAST(coalesce(sum(one) FILTER (used = 1), 0) AS BIGINT) used_bytes, CAST(sum(every) AS BIGINT) AS bytes FROM o GROUP BY 1),
st AS (SELECT image, CASE WHEN used_bytes = 0 THEN 'drop' WHEN used_bytes * 100 < bytes * 60 THEN 'rebuild' ELSE 'keep' END state, used_bytes, bytes FROM b)"""


def _compaction(spark, sf_dir):
    """All chunks, and those in use: what newer versions or an image that is gone had isn't."""
    chunks = model.chunks(spark, sf_dir)
    return chunks, chunks.filter("ver < 6 and image <> 'src1'").select("digest").distinct()


@query("compact_states", f"WITH {CHUNKS}, {_STATES} SELECT image, state, used_bytes, bytes FROM st")
def compact_states(spark, sf_dir):
    """What compaction does to each blob, by how much of it is in use."""
    return compaction.blob_states(*_compaction(spark, sf_dir), "image", 60)


@query("compact_rebuild", f"""WITH RECURSIVE {CHUNKS}, {_STATES}, n AS (SELECT image, used_bytes s, row_number() OVER (ORDER BY used_bytes, image) rn FROM st WHERE state = 'rebuild' AND used_bytes <= 40000),
r(image, rn, k, base, total) AS (SELECT image, rn, CAST(0 AS BIGINT), CAST(0 AS BIGINT), s FROM n WHERE rn = 1 UNION ALL SELECT n.image, n.rn, r.k + CASE WHEN r.total + n.s > 40000 THEN 1 ELSE 0 END,
 CASE WHEN r.total + n.s > 40000 THEN 0 ELSE r.total END, n.s + CASE WHEN r.total + n.s > 40000 THEN 0 ELSE r.total END FROM r JOIN n ON n.rn = r.rn + 1),
l AS (SELECT o.image, o.digest, CAST(coalesce(sum(one) OVER (PARTITION BY o.image ORDER BY o.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) pos FROM o JOIN st ON st.image = o.image AND state = 'rebuild' WHERE used = 1)
SELECT l.image, digest, k merged, pos + coalesce(base, 0) new_offset FROM l LEFT JOIN r ON r.image = l.image""")
def compact_rebuild(spark, sf_dir):
    """Where the chunks in use of rebuilt and merged blobs go."""
    return compaction.rebuilt(*_compaction(spark, sf_dir), "image", 60, 40_000)


@query("sort_compact_chunks", f"""WITH {LAYOUT} SELECT image, comp_offset, digest, row_number() OVER (ORDER BY image, comp_offset, uncomp_offset, digest) - 1 place FROM laid""")
def sort_compact_chunks(spark, sf_dir):
    """Chunks of all blobs by blob and offset, as compaction dumps them: places count inside a blob, from the blob's first."""
    laid = _layout(spark, sf_dir)
    order = ["comp_offset", "uncomp_offset", "digest"]
    inside = running(laid, ["image"], F.floor(F.col("comp_offset") / CELL_BYTES), order, {}, index="nth")
    blobs = laid.groupBy("image").agg(F.count("*").alias("n")).withColumn("__all", F.lit(0))
    first = running(blobs, ["__all"], text_cell(F.col("image")), ["image"], {"first": F.col("n")}).select("image", "first")
    return inside.join(first, "image").select("image", "comp_offset", "digest", (F.col("first") + F.col("nth")).alias("place"))


@query("optimize_image", f"""WITH {CHUNKS}, {_PATTERNS}, w AS (SELECT f.ino, min(p.place) place FROM files f JOIN pats p ON f.path = p.pattern OR starts_with(f.path, p.pattern||'/') GROUP BY 1),
k AS (SELECT ino, row_number() OVER (ORDER BY place, ino) - 1 AS rank FROM w), l AS (SELECT c.*, rank, row_number() OVER (PARTITION BY digest ORDER BY rank, idx) rn FROM chunks c JOIN k ON k.ino = c.ino)
SELECT ino, idx, digest, CAST(coalesce(sum(comp_size) OVER (ORDER BY rank, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) new_offset FROM l WHERE rn = 1""")
def optimize_image(spark, sf_dir):
    """The blob to prefetch: chunks of the files that the patterns name, in the patterns' order."""
    up = F.concat(overlay.ancestors(F.col("path")), F.array("path"))
    spread = model.files(spark, sf_dir).select("ino", F.explode(up).alias("pattern"))
    place = spread.join(_patterns(spark), "pattern").groupBy("ino").agg(F.min("place").alias("place")).withColumn("__all", F.lit(0))
    cell = F.col("place") * F.lit(1 << 40) + F.floor(F.col("ino") / 65536)
    wanted = running(place, ["__all"], cell, ["place", "ino"], {}, index="rank").select("ino", "rank")
    return compaction.hot_blob(model.chunks(spark, sf_dir), wanted)


@query("check_rules", f"""WITH {CHUNKS}, d AS (SELECT * FROM chunks WHERE NOT (ino % 101 = 3 AND idx = 0)), per AS (SELECT ino, sum(size) held, count(*) n, max(idx) + 1 last FROM d GROUP BY 1)
SELECT 'size' AS rule, f.ino FROM files f LEFT JOIN per USING (ino) WHERE coalesce(held, 0) <> f.size UNION ALL SELECT 'holes', ino FROM per WHERE n <> last
UNION ALL SELECT 'chunk', ino FROM d WHERE size > 4096 OR size <= 0 OR length(digest) <> 64 UNION ALL SELECT 'blob', ino FROM d WHERE image NOT IN (SELECT image FROM files WHERE ino % 2 = 0)""")
def check_rules(spark, sf_dir):
    """Files that break a rule in an image from which some first chunks are missing: sizes, contiguous chunks, sound chunks, known blobs."""
    files, chunks = model.files(spark, sf_dir), model.chunks(spark, sf_dir).filter("not (ino % 101 = 3 and idx = 0)")
    return overlay.broken_rules(files, chunks, files.filter("ino % 2 = 0").select("image"), 4096)


@query("commit_layer", f"""WITH {ENTRIES}, a AS (SELECT * FROM entries WHERE layer = 0), b AS (SELECT * FROM entries WHERE layer = 1),
c AS (SELECT coalesce(a.path, b.path) path, b.path IS NULL gone FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size IS DISTINCT FROM b.size OR a.digest IS DISTINCT FROM b.digest)
SELECT path, false is_marker FROM c WHERE NOT gone UNION ALL SELECT regexp_replace(path, '/[^/]*$', '')||'/.wh.'||regexp_extract(path, '[^/]*$'), true FROM c WHERE gone AND NOT EXISTS (SELECT 1 FROM c x WHERE x.gone AND starts_with(c.path, x.path||'/'))""")
def commit_layer(spark, sf_dir):
    """The layer that turns the lowest one into the next: its paths, and markers of what is deleted."""
    e = model.entries(spark, sf_dir)
    return overlay.committed(overlay.layer_diff(e.filter("layer = 0"), e.filter("layer = 1"), ["size", "digest"]))


@query("copy_parts", f"""WITH {CHUNKS}, b AS (SELECT image, CAST(sum(comp_size) AS BIGINT) total FROM chunks GROUP BY 1), p AS (SELECT image, total, unnest(range(0, total, 65536)) "offset" FROM b)
SELECT image, "offset", least(65536, total - "offset") length FROM p""")
def copy_parts(spark, sf_dir):
    """The parts that each blob is pushed in when an image is copied."""
    blobs = model.chunks(spark, sf_dir).groupBy("image").agg(F.sum("comp_size").alias("total"))
    return ranges.split_ranges(blobs, "total", 65536).select("image", "offset", "length")


@query("pack_artifact", f"""WITH {CHUNKS}, d AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ino, idx) = 1 own FROM chunks)
SELECT image, count(DISTINCT ino) files, count(*) FILTER (own) chunks, CAST(coalesce(sum(comp_size) FILTER (own), 0) AS BIGINT) blob_size, sha256(coalesce(string_agg(digest, '' ORDER BY ino, idx) FILTER (own), '')) AS name FROM d GROUP BY 1""")
def pack_artifact(spark, sf_dir):
    """Directories packed into artifacts: new chunks against all before, the blob's size, and its name by its chunks in order."""
    chunks = state.ready_by_digest(model.chunks(spark, sf_dir), "digest", ["ino", "idx"])
    own = ~F.col("ready")
    return chunks.groupBy("image").agg(
        F.count_distinct("ino").alias("files"), F.count_if(own).alias("chunks"), F.coalesce(F.sum(F.when(own, F.col("comp_size"))), F.lit(0)).alias("blob_size"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("ino", "idx", "digest")))), lambda x: x["digest"]), ""), 256).alias("name"),
    )


@query("merge_root", f"""WITH {ENTRIES}, r AS (SELECT DISTINCT layer, '/' path, true is_dir, CAST(layer AS BIGINT) AS size FROM entries) SELECT path, max(layer) AS layer, max(size) AS size FROM r GROUP BY 1""")
def merge_root(spark, sf_dir):
    """The root's attributes in a stack of layers are the uppermost's."""
    e = model.entries(spark, sf_dir)
    roots = e.select("layer").distinct().select("layer", F.lit("/").alias("path"), F.lit(True).alias("is_dir"), F.col("layer").cast("bigint").alias("size"), F.lit(None).cast("string").alias("digest"))
    return overlay.merge_layers(e.unionByName(roots)).filter("path = '/'").select("path", "layer", "size")


@query("tree_post_order", f"""WITH {NODES}, k AS (SELECT *, list_concat(string_split(regexp_replace(path,'^/',''),'/'), CASE WHEN is_dir THEN [chr(1114111)] ELSE [] END) w FROM nodes WHERE path <> '/')
SELECT path, row_number() OVER (PARTITION BY string_split(path,'/')[2] ORDER BY w) - 1 AS "order" FROM k""")
def tree_post_order(spark, sf_dir):
    """A walk that visits a directory after all below it."""
    return trees.depth_last(_nodes(spark, sf_dir).filter("path <> '/'")).select("path", "order")


_ASKED = OPERATIONS + ", asked AS (SELECT ino % 20 AS blob, seq, ts, bytes % 500 AS start, 1 + latency_us % 9 AS count FROM ops WHERE op = 'read')"


def _asked(spark, sf_dir):
    reads = model.operations(spark, sf_dir).filter("op = 'read'")
    return reads.select((F.col("ino") % 20).alias("blob"), "seq", "ts", (F.col("bytes") % 500).alias("start"), (1 + F.col("latency_us") % 9).alias("count"))


@query("readiness_by_index", f"""WITH {_ASKED}, w AS (SELECT blob, ts, seq, unnest(range(start, start + count)) AS "index" FROM asked)
SELECT blob, "index", ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY blob, "index" ORDER BY ts, seq) rn FROM w) WHERE rn = 1""")
def readiness_by_index(spark, sf_dir):
    """The request that finds each chunk, by its index in a blob, not ready and fetches it."""
    return state.pending_indexes(_asked(spark, sf_dir), "blob", "start", "count", ["ts", "seq"])


@query("readiness_bitmap", f"""WITH {_ASKED}, w AS (SELECT DISTINCT blob, unnest(range(start, start + count)) AS i FROM asked) SELECT blob, i // 32 AS word, CAST(sum(1::BIGINT << (i % 32)) AS BIGINT) AS bits FROM w GROUP BY 1, 2""")
def readiness_bitmap(spark, sf_dir):
    """Bitmaps of the blobs' ready chunks once all requests are served."""
    return state.ready_words(state.pending_indexes(_asked(spark, sf_dir), "blob", "start", "count", ["ts", "seq"]), "blob", "index")


@query("readiness_by_digest", f"WITH {CHUNKS} SELECT ino, idx, row_number() OVER (PARTITION BY digest ORDER BY ino, idx) > 1 ready FROM chunks")
def readiness_by_digest(spark, sf_dir):
    """Whether each chunk's digest has been fetched before, in reading order."""
    return state.ready_by_digest(model.chunks(spark, sf_dir), "digest", ["ino", "idx"]).select("ino", "idx", "ready")


@query("prefetch_workers", f"""WITH {OPERATIONS}, q AS (SELECT seq, row_number() OVER (ORDER BY ts, seq) - 1 place FROM ops WHERE op = 'open' AND ino % 10 <> 3) SELECT seq, place, place % 4 AS worker FROM q""")
def prefetch_workers(spark, sf_dir):
    """Queued prefetch requests in order, dealt to four workers, once those of one blob are flushed."""
    queue = model.operations(spark, sf_dir).filter("op = 'open' and ino % 10 <> 3").select("seq", "ts")
    return state.dealt_to_workers(queue, ["ts", "seq"], 4).select("seq", "place", "worker")


@query("pause_gate", f"""WITH {OPERATIONS}, p AS (SELECT ts "from", ts + 600 + bytes % 3000 until FROM ops WHERE NOT ok)
SELECT seq, coalesce((SELECT max(until) FROM p WHERE "from" <= ts AND ts < until) - ts, 0) wait FROM ops WHERE op = 'read'""")
def pause_gate(spark, sf_dir):
    """How long each read waits while the backend is paused after errors."""
    ops = model.operations(spark, sf_dir)
    pauses = ops.filter("not ok").select(F.col("ts").alias("from"), (F.col("ts") + 600 + F.col("bytes") % 3000).alias("until"))
    return state.gated(ops.filter("op = 'read'").select("seq", "ts"), pauses, "ts", 3600).select("seq", "wait")


@query("read_and_clear", f"""WITH {OPERATIONS}, s AS (SELECT DISTINCT ts // 86400 AS slot, ino FROM ops WHERE op = 'read'), g AS (SELECT *, ino - row_number() OVER (PARTITION BY slot ORDER BY ino) k FROM s)
SELECT slot, min(ino) AS first, max(ino) AS "last" FROM g GROUP BY slot, k""")
def read_and_clear(spark, sf_dir):
    """Ranges of the inodes read since the export before, a day each."""
    reads = model.operations(spark, sf_dir).filter("op = 'read'").select(F.floor(F.col("ts") / 86400).alias("slot"), "ino").distinct()
    return ranges.id_runs(reads, ["slot"], "ino")


@query("vectored_read", f"""WITH {FILES}, b AS (SELECT ino, size, encode(text) c FROM files), r AS (SELECT ino, size, c, unnest(range(0, 3)) i FROM b), o AS (SELECT *, (ino * (37 + i)) % 900 o, 1 + (ino + i) % 64 l FROM r)
SELECT ino, i, CASE WHEN size >= o + l THEN hex(array_slice(c, o + 1, o + l)) END body FROM o""")
def vectored_read(spark, sf_dir):
    """Three ranges of each file in one read."""
    asked = F.array(*[F.struct(((F.col("ino") * (37 + i)) % 900).alias("offset"), (1 + (F.col("ino") + i) % 64).alias("length")) for i in range(3)])
    parts = backends.vectored(F.encode("text", "UTF-8"), asked)
    return model.files(spark, sf_dir).select("ino", F.posexplode(parts).alias("i", "part")).select("ino", F.col("i").cast("bigint").alias("i"), F.hex("part").alias("body"))


@query("stream_read", f"""WITH {FILES}, b AS (SELECT ino, size, encode(text) c FROM files), p AS (SELECT ino, c, size, unnest(range(0, size, 1000)) "offset" FROM b)
SELECT ino, "offset", sha256(array_slice(c, "offset" + 1, least("offset" + 1000, size))) digest FROM p""")
def stream_read(spark, sf_dir):
    """Every file read as a sequence of pieces."""
    blobs = model.files(spark, sf_dir).select("ino", F.encode("text", "UTF-8").alias("content"))
    return backends.streamed(blobs, "content", 1000).select("ino", "offset", F.sha2("part", 256).alias("digest"))


@query("retry_delays", "SELECT CAST(p_partkey AS BIGINT) id, p_size % 12 AS tried, CAST(least(100 * power(2, p_size % 12), 10000) AS BIGINT) delay_ms FROM part")
def retry_delays(spark, sf_dir):
    part = model.table(spark, sf_dir, "part")
    tried = F.col("p_size") % 12
    return part.select(F.col("p_partkey").cast("bigint").alias("id"), tried.alias("tried"), backends.retry_delay(tried).alias("delay_ms"))


@query("dump_sink_round_trip", f"""WITH {FILES}, {_PATTERNS}, m AS (SELECT f.ino, f.size, min(p.place) place FROM files f LEFT JOIN pats p ON f.path = p.pattern OR starts_with(f.path, p.pattern||'/') GROUP BY 1, 2)
SELECT ino, size, coalesce(place, 1000) AS rank, true in_order FROM m""")
def dump_sink_round_trip(spark, sf_dir):
    """All files written in dump order and read back, with whether a part's rows follow their rank."""
    up = F.concat(overlay.ancestors(F.col("path")), F.array("path"))
    spread = model.files(spark, sf_dir).select("ino", "size", F.explode(up).alias("pattern"))
    place = spread.join(F.broadcast(_patterns(spark)), "pattern", "left").groupBy("ino", "size").agg(F.min("place").alias("place"))
    path = scratch(spark, "dump")
    sinks.write_in_dump_order(place.select("ino", "size", F.coalesce("place", F.lit(1000)).alias("rank")), path, "rank", 4)
    back = spark.read.parquet(path).select("ino", "size", "rank", F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row"))
    told = ranges.with_previous(back, ["part"], F.floor(F.col("row") / 65536), ["row"], {"before": F.col("rank")})
    return told.select("ino", "size", "rank", F.coalesce(F.col("before") <= F.col("rank"), F.lit(True)).alias("in_order"))
