"""Queries over byte ranges: layout, lookups, merging of requests, reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import model
from quarry.model import CHUNKS, FILES
from quarry.operators import ranges
from quarry.operators.prefix import CELL, running, text_cell, with_previous
from quarry.plans.catalog import query
from quarry.sources.backends import ranged

LAYOUT = CHUNKS + """, laid AS (SELECT *, row_number() OVER w - 1 AS "index", CAST(coalesce(sum(comp_size) OVER b, 0) AS BIGINT) comp_offset, CAST(coalesce(sum((size+4095)//4096*4096) OVER b, 0) AS BIGINT) uncomp_offset
FROM chunks WINDOW w AS (PARTITION BY image ORDER BY ino, idx), b AS (PARTITION BY image ORDER BY ino, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _layout(spark, sf_dir):
    return ranges.layout(model.chunks(spark, sf_dir), "image", ["ino", "idx"])


@query("blob_layout_offsets", f'WITH {LAYOUT} SELECT image, ino, idx, "index", comp_offset, uncomp_offset FROM laid')
def blob_layout_offsets(spark, sf_dir):
    return _layout(spark, sf_dir).select("image", "ino", "idx", "index", "comp_offset", "uncomp_offset")


@query("file_offsets", f"""WITH {CHUNKS}, u AS (SELECT image, digest, max(size) size FROM chunks GROUP BY 1, 2)
SELECT image, digest, CAST(coalesce(sum(size) OVER (PARTITION BY image ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) file_offset FROM u""")
def file_offsets(spark, sf_dir):
    """Layout of a dictionary file: each digest once, in order."""
    unique = model.chunks(spark, sf_dir).groupBy("image", "digest").agg(F.max("size").alias("size"))
    return running(unique, ["image"], text_cell(F.col("digest")), ["digest"], {"file_offset": F.col("size")}).select("image", "digest", "file_offset")


REQUESTS = f"""{FILES}, req AS (SELECT ino, (ino*37)%9000 AS "offset", 1 + (ino*53)%7000 AS length, (size+4095)//4096 AS n_chunks, ino%10=0 AS has_hole FROM files WHERE size > 0)"""


def _requests(spark, sf_dir):
    return model.files(spark, sf_dir).filter("size > 0").select(
        "ino", ((F.col("ino") * 37) % 9000).alias("offset"), (1 + (F.col("ino") * 53) % 7000).alias("length"), F.ceil(F.col("size") / 4096).cast("bigint").alias("n_chunks"), (F.col("ino") % 10 == 0).alias("has_hole")
    )


@query("range_to_chunks", f"""WITH {REQUESTS}, b AS (SELECT ino, CASE WHEN has_hole THEN 0 ELSE "offset"//4096 END lo, CASE WHEN has_hole THEN n_chunks ELSE least(("offset"+length-1)//4096+1, n_chunks) END hi FROM req)
SELECT ino, unnest(range(lo, hi)) AS chunk FROM b WHERE hi > lo""")
def range_to_chunks(spark, sf_dir):
    return ranges.range_to_chunks(_requests(spark, sf_dir), 4096).select("ino", "chunk")


@query("chunk_range_overlap", f"""WITH {CHUNKS}, req AS (SELECT ino AS rino, (ino*37)%9000 AS lo, (ino*37)%9000 + (ino*53)%7000 AS hi FROM files)
SELECT ino, idx FROM chunks JOIN req ON rino = ino WHERE greatest(file_offset, lo) <= least(file_offset+size, hi)""")
def chunk_range_overlap(spark, sf_dir):
    """Chunks that a file's requested range meets or touches."""
    chunks = model.chunks(spark, sf_dir).withColumn("c_end", F.col("file_offset") + F.col("size"))
    wanted = model.files(spark, sf_dir).select("ino", ((F.col("ino") * 37) % 9000).alias("lo"), ((F.col("ino") * 37) % 9000 + (F.col("ino") * 53) % 7000).alias("hi"))
    return ranges.range_join(chunks, wanted, "ino", 16384, "file_offset", "c_end", "lo", "hi").select("ino", "idx")


POINTS = LAYOUT + """, pts AS (SELECT image, (ino*7919) % 90000 AS addr FROM files)"""


def _points(spark, sf_dir):
    return model.files(spark, sf_dir).select("image", ((F.col("ino") * 7919) % 90000).alias("addr"))


def _extents(spark, sf_dir):
    """Uncompressed extents of chunks; alignment leaves holes."""
    laid = _layout(spark, sf_dir)
    return laid.select("image", F.col("index").alias("idx"), F.col("uncomp_offset").alias("start"), (F.col("uncomp_offset") + F.col("size")).alias("end"))


@query("point_in_interval", f"""WITH {POINTS} SELECT p.image, p.addr, (SELECT max("index") FROM laid l WHERE l.image=p.image AND l.uncomp_offset <= p.addr AND p.addr < l.uncomp_offset+l.size) idx FROM pts p""")
def point_in_interval(spark, sf_dir):
    return ranges.covering(_extents(spark, sf_dir), _points(spark, sf_dir), "image")


@query("point_or_next_chunk", f"""WITH {POINTS} SELECT p.image, p.addr, (SELECT min("index") FROM laid l WHERE l.image=p.image AND p.addr < l.uncomp_offset+l.size) idx FROM pts p""")
def point_or_next_chunk(spark, sf_dir):
    return ranges.covering(_extents(spark, sf_dir), _points(spark, sf_dir), "image", next_if_none=True)


@query("chunks_covering_uncompressed", f"""WITH {LAYOUT}, s AS (SELECT image, "index", uncomp_offset a, uncomp_offset+size b FROM laid WHERE uncomp_offset < 60000 AND uncomp_offset+size > 10000)
SELECT image, "index", coalesce(lag(b) OVER (PARTITION BY image ORDER BY a) <> a, false) hole FROM s""")
def chunks_covering_uncompressed(spark, sf_dir):
    ext = _layout(spark, sf_dir).withColumn("u_end", F.col("uncomp_offset") + F.col("size"))
    return ranges.chunks_in_range(ext, "uncomp_offset", "u_end", 10_000, 60_000, "image").select("image", "index", "hole")


@query("chunks_covering_compressed", f"""WITH {LAYOUT} SELECT image, "index", false hole FROM laid WHERE comp_offset < 60000 AND comp_offset+comp_size > 10000""")
def chunks_covering_compressed(spark, sf_dir):
    ext = _layout(spark, sf_dir).withColumn("c_end", F.col("comp_offset") + F.col("comp_size"))
    return ranges.chunks_in_range(ext, "comp_offset", "c_end", 10_000, 60_000, "image").select("image", "index", "hole")


# Chunks as they lie uncompressed: alignment leaves gaps between them.
IO = LAYOUT + ", io AS (SELECT image, layer, \"index\", uncomp_offset a, uncomp_offset+size b FROM laid)"


def _io(spark, sf_dir):
    laid = _layout(spark, sf_dir)
    return laid.select("image", "layer", "index", F.col("uncomp_offset").alias("a"), (F.col("uncomp_offset") + F.col("size")).alias("b"))


@query("continuous_io", f"""WITH {IO} SELECT image, "index", coalesce(a - lag(b) OVER (PARTITION BY image ORDER BY a) <= 1024, false) joins FROM io""")
def continuous_io(spark, sf_dir):
    return ranges.continuous(_io(spark, sf_dir), "image", "a", "b", 1024).select("image", "index", "joins")


@query("io_merge_islands", f"""WITH {IO}, j AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY image ORDER BY a) <= 1024 THEN 0 ELSE 1 END n FROM io),
i AS (SELECT *, sum(n) OVER (PARTITION BY image ORDER BY a) k FROM j) SELECT image, min(a) "start", max(b) "end", count(*) chunks FROM i GROUP BY image, k""")
def io_merge_islands(spark, sf_dir):
    return ranges.merged_requests(_io(spark, sf_dir), "image", "a", "b", 1024)


@query("io_merge_capped", f"""WITH RECURSIVE {IO}, n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY a) rn FROM io),
r(image, rn, s, e, k) AS (SELECT image, rn, a, b, 1 FROM n WHERE rn = 1 UNION ALL SELECT n.image, n.rn, CASE WHEN n.a - r.e <= 1024 AND r.e - r.s < 16384 THEN r.s ELSE n.a END,
 n.b, CASE WHEN n.a - r.e <= 1024 AND r.e - r.s < 16384 THEN r.k ELSE r.k + 1 END FROM r JOIN n ON n.image = r.image AND n.rn = r.rn + 1)
SELECT image, min(s) "start", max(e) "end", count(*) chunks FROM r GROUP BY image, k""")
def io_merge_capped(spark, sf_dir):
    return ranges.capped_requests(_io(spark, sf_dir), "image", "a", "b", 1024, 16_384)


@query("consecutive_runs", f"""WITH {IO}, g AS (SELECT image, layer, "index" - row_number() OVER (PARTITION BY image, layer ORDER BY "index") k, "index" x FROM io) SELECT image, layer, min(x) first, max(x) "last" FROM g GROUP BY image, layer, k""")
def consecutive_runs(spark, sf_dir):
    """Runs of consecutive chunk indexes of each layer in its blob."""
    return ranges.id_runs(_io(spark, sf_dir), ["image", "layer"], "index")


_STRIP = LAYOUT + ", r AS (SELECT image, \"index\", digest < '8' ready FROM laid), e AS (SELECT image, min(\"index\") lo, max(\"index\") hi FROM r WHERE NOT ready GROUP BY 1)"


@query("strip_ready_tail", f"""WITH {_STRIP} SELECT r.image, r."index" FROM r JOIN e USING (image) WHERE r."index" <= hi""")
def strip_ready_tail(spark, sf_dir):
    chunks = _layout(spark, sf_dir).select("image", "index", (F.col("digest") < "8").alias("ready"))
    return ranges.strip_ready(chunks, "image", "index", "ready").select("image", "index")


@query("strip_ready_both", f"""WITH {_STRIP} SELECT r.image, r."index" FROM r JOIN e USING (image) WHERE r."index" BETWEEN lo AND hi""")
def strip_ready_both(spark, sf_dir):
    chunks = _layout(spark, sf_dir).select("image", "index", (F.col("digest") < "8").alias("ready"))
    return ranges.strip_ready(chunks, "image", "index", "ready", both_ends=True).select("image", "index")


@query("extend_request", f"""WITH {IO}, q AS (SELECT image, min(a) AS "start", min(b) AS "end" FROM io GROUP BY 1)
SELECT q.image, q."start", q."end", greatest(q."end", (SELECT max(b) FROM io WHERE io.image=q.image AND b <= greatest(q."end", q."start"+20000))) new_end FROM q""")
def extend_request(spark, sf_dir):
    chunks = _io(spark, sf_dir).drop("layer")
    asked = chunks.groupBy("image").agg(F.min("a").alias("start"), F.min("b").alias("end"))
    return ranges.extended(asked, chunks, "image", 20_000, "a", "b").select("image", "start", "end", "new_end")


@query("read_amplification", f"WITH {FILES} SELECT ino, CAST(coalesce(sum(size) OVER (PARTITION BY image ORDER BY ino ROWS BETWEEN 1 FOLLOWING AND 64 FOLLOWING), 0) AS BIGINT) ahead FROM files")
def read_amplification(spark, sf_dir):
    return ranges.amplified(model.files(spark, sf_dir), "image", "ino").select("ino", "ahead")


_HOLES = FILES + ", h AS (SELECT image, ino AS \"offset\", 1 + ino%2 AS size FROM files), n AS (SELECT *, lead(\"offset\") OVER w nx, lead(\"offset\",2) OVER w af FROM h WINDOW w AS (PARTITION BY image ORDER BY \"offset\"))"


def _pieces(spark, sf_dir):
    return model.files(spark, sf_dir).select("image", F.col("ino").alias("offset"), (1 + F.col("ino") % 2).alias("size"))


@query("hole_check", f"""WITH {_HOLES} SELECT image, "offset", size FROM n WHERE nx <> "offset"+size AND af IS NOT NULL""")
def hole_check(spark, sf_dir):
    """Chunks that the next doesn't follow; as in the format's own check, a file's last pair isn't looked at."""
    return ranges.holes(_pieces(spark, sf_dir), "image", skip_last=True)


@query("hole_check_all", f"""WITH {_HOLES} SELECT image, "offset", size FROM n WHERE nx <> "offset"+size""")
def hole_check_all(spark, sf_dir):
    return ranges.holes(_pieces(spark, sf_dir), "image")


@query("batch_pack", f"""WITH RECURSIVE {FILES}, n AS (SELECT image, ino, size, row_number() OVER (PARTITION BY image ORDER BY ino) rn FROM files WHERE size < 4096),
r(image, ino, rn, batch_no, batch_offset, used) AS (SELECT image, ino, rn, CAST(0 AS BIGINT), CAST(0 AS BIGINT), size FROM n WHERE rn = 1 UNION ALL
 SELECT n.image, n.ino, n.rn, r.batch_no + CASE WHEN r.used + n.size > 8192 THEN 1 ELSE 0 END, CASE WHEN r.used + n.size > 8192 THEN 0 ELSE r.used END, n.size + CASE WHEN r.used + n.size > 8192 THEN 0 ELSE r.used END
 FROM r JOIN n ON n.image = r.image AND n.rn = r.rn + 1) SELECT image, ino, batch_no, batch_offset FROM r""")
def batch_pack(spark, sf_dir):
    return ranges.packed(model.files(spark, sf_dir), "image", "ino", 8192)


@query("prefetch_split", f"WITH {FILES}, s AS (SELECT ino, size, unnest(range(0, size, 4096)) AS \"offset\" FROM files WHERE size > 0) SELECT ino, \"offset\", least(4096, size-\"offset\") length FROM s")
def prefetch_split(spark, sf_dir):
    return ranges.split_ranges(model.files(spark, sf_dir), "size", 4096).select("ino", "offset", "length")


@query("ranged_read", f"""WITH {FILES}, b AS (SELECT ino, size, encode(text) c, (ino*37)%900 o, 1+ino%64 l FROM files) SELECT ino, CASE WHEN size >= o+l THEN hex(array_slice(c, o+1, o+l)) END body FROM b""")
def ranged_read(spark, sf_dir):
    content = F.encode("text", "UTF-8")
    return model.files(spark, sf_dir).select("ino", F.hex(ranged(content, (F.col("ino") * 37) % 900, 1 + F.col("ino") % 64)).alias("body"))


@query("file_read", f"""WITH {CHUNKS}, q AS (SELECT ino AS q, (ino*37)%9000 lo, least((ino*37)%9000 + 1 + (ino*53)%7000, size) hi FROM files)
SELECT ino, idx, greatest(file_offset, lo) - file_offset chunk_start, least(file_offset+size, hi) - file_offset chunk_end FROM chunks JOIN q ON q=ino WHERE file_offset < hi AND file_offset+size > lo""")
def file_read(spark, sf_dir):
    """The part of each chunk that a read of a file takes."""
    f = model.files(spark, sf_dir)
    low = (F.col("ino") * 37) % 9000
    asked = f.select("ino", low.alias("lo"), F.least(low + 1 + (F.col("ino") * 53) % 7000, F.col("size")).alias("hi"))
    joined = model.chunks(spark, sf_dir).join(asked, "ino").filter("file_offset < hi and file_offset + size > lo")
    a, b = ranges.clip(F.col("file_offset"), F.col("file_offset") + F.col("size"), F.col("lo"), F.col("hi"))
    return joined.select("ino", "idx", a.alias("chunk_start"), b.alias("chunk_end"))


@query("io_by_blob", f"WITH {CHUNKS} SELECT image, layer, count(*) chunks, CAST(sum(comp_size) AS BIGINT) bytes FROM chunks GROUP BY 1, 2")
def io_by_blob(spark, sf_dir):
    return model.chunks(spark, sf_dir).groupBy("image", "layer").agg(F.count("*").alias("chunks"), F.sum("comp_size").alias("bytes"))


@query("bio_vectors", f"""WITH {CHUNKS}, b AS (SELECT ver, ino, idx, image, CASE WHEN image = lag(image) OVER (PARTITION BY ver ORDER BY ino, idx) THEN 0 ELSE 1 END n FROM chunks),
k AS (SELECT *, sum(n) OVER (PARTITION BY ver ORDER BY ino, idx) vec FROM b) SELECT ver, CAST(vec AS BIGINT) vec, image, count(*) chunks FROM k GROUP BY 1, 2, 3""")
def bio_vectors(spark, sf_dir):
    """Runs of chunks of one blob in reading order."""
    chunks, cell, order = model.chunks(spark, sf_dir).select("ver", "ino", "idx", "image"), F.floor(F.col("ino") / CELL), ["ino", "idx"]
    marked = with_previous(chunks, ["ver"], cell, order, {"before": F.col("image")})
    first = F.when(F.col("before") == F.col("image"), 0).otherwise(1).cast("bigint")
    vec = (F.col("vec") + first).alias("vec")
    return running(marked, ["ver"], cell, order, {"vec": first}).select("ver", "image", vec).groupBy("ver", "vec", "image").agg(F.count("*").alias("chunks"))


_STATES = "CASE WHEN digest < '4' THEN 'CacheFast' WHEN digest < '8' THEN 'CacheSlow' ELSE 'Backend' END"


@query("dispatch_regions", f"""WITH {CHUNKS}, s AS (SELECT ino, idx, file_offset a, file_offset+size b, {_STATES} state FROM chunks),
n AS (SELECT *, CASE WHEN lag(state) OVER w = state AND lag(b) OVER w = a THEN 0 ELSE 1 END n FROM s WINDOW w AS (PARTITION BY ino ORDER BY idx)),
r AS (SELECT *, sum(n) OVER (PARTITION BY ino ORDER BY idx) region FROM n)
SELECT ino, CAST(region AS BIGINT) region, state AS type, min(a) "start", max(b) "end", count(*) chunks FROM r GROUP BY 1, 2, 3""")
def dispatch_regions(spark, sf_dir):
    """Regions of a request for a whole file: chunks ready, ready after a check, and not ready; a digest's first digit stands for the state."""
    state = F.when(F.col("digest") < "4", ranges.CACHE_FAST).when(F.col("digest") < "8", ranges.CACHE_SLOW).otherwise(ranges.BACKEND)
    chunks = model.chunks(spark, sf_dir).select("ino", "idx", F.col("file_offset").alias("a"), (F.col("file_offset") + F.col("size")).alias("b"), state.alias("state"))
    return ranges.regions(chunks, "ino", "idx", "a", "b", "state")


@query("block_export", f"""WITH {CHUNKS}, e AS (SELECT image, 0 kind, CAST(0 AS BIGINT) ino, CAST(0 AS BIGINT) idx, CAST(64*count(*) AS BIGINT) len FROM chunks GROUP BY 1 UNION ALL SELECT image, 1, ino, idx, comp_size FROM chunks)
SELECT image, kind, ino, idx, CAST(coalesce(sum((len+4095)//4096) OVER (PARTITION BY image ORDER BY kind, ino, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) block FROM e""")
def block_export(spark, sf_dir):
    """First block of each extent when metadata and data are flattened to a disk."""
    chunks, none = model.chunks(spark, sf_dir), F.lit(0).cast("bigint")
    meta = chunks.groupBy("image").agg((64 * F.count("*")).alias("len")).select("image", F.lit(0).alias("kind"), none.alias("ino"), none.alias("idx"), "len")
    data = chunks.select("image", F.lit(1).alias("kind"), "ino", "idx", F.col("comp_size").alias("len"))
    cell = F.col("kind") + F.floor(F.col("ino") / CELL)
    placed = running(meta.unionByName(data), ["image"], cell, ["kind", "ino", "idx"], {"block": F.ceil(F.col("len") / 4096).cast("bigint")})
    return placed.select("image", "kind", "ino", "idx", "block")


@query("extent_lookup", """WITH x AS (SELECT CAST(p_partkey AS BIGINT) k, p_partkey*10 lo, p_partkey*10 + p_partkey%8 hi, CASE p_partkey%3 WHEN 0 THEN 'meta' ELSE 'data' END kind FROM part),
b AS (SELECT CAST(o_orderkey AS BIGINT) block FROM orders)
SELECT block, coalesce(kind, 'hole') kind FROM b LEFT JOIN x ON block BETWEEN lo AND hi""")
def extent_lookup(spark, sf_dir):
    """What each block is: metadata, data or a hole."""
    part = model.table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("bigint")
    extents = part.select(F.lit(0).alias("disk"), k.alias("idx"), (k * 10).alias("start"), (k * 10 + k % 8 + 1).alias("end"))
    kinds = part.select(k.alias("idx"), F.when(k % 3 == 0, "meta").otherwise("data").alias("kind"))
    blocks = model.table(spark, sf_dir, "orders").select(F.lit(0).alias("disk"), F.col("o_orderkey").cast("bigint").alias("addr"))
    found = ranges.covering(extents, blocks, "disk", 1 << 16).join(kinds, "idx", "left")
    return found.select(F.col("addr").alias("block"), F.coalesce("kind", F.lit("hole")).alias("kind"))
