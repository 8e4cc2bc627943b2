"""Queries over layers and trees: merging, differences, walks, lookups, digests, inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import model
from quarry.model import CHUNKS, ENTRIES, FILES
from quarry.operators import overlay, trees
from quarry.operators.prefix import CELL, running
from quarry.plans.catalog import query

_NAMED = ENTRIES + """, named AS (SELECT *, regexp_extract(path, '[^/]*$') nm, regexp_replace(path, '/[^/]*$', '') up FROM entries),
kinds AS (SELECT *, CASE WHEN layer = 0 THEN NULL WHEN nm = '.wh..wh..opq' THEN 'OciOpaque' WHEN starts_with(nm, '.wh.') THEN 'OciRemoval' END kind FROM named),
hides AS (SELECT up||'/'||substring(nm, 5) p, layer l, true ex FROM kinds WHERE kind = 'OciRemoval' UNION ALL SELECT up, layer, false FROM kinds WHERE kind = 'OciOpaque'
 UNION ALL SELECT path, layer, false FROM kinds WHERE kind IS NULL AND NOT is_dir),
live AS (SELECT * FROM named e WHERE NOT starts_with(nm, '.wh.') AND NOT EXISTS (SELECT 1 FROM hides h WHERE h.l > e.layer AND ((h.ex AND h.p = e.path) OR starts_with(e.path, h.p||'/')))),
merged AS (SELECT path, layer, is_dir, size, digest FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY layer DESC) rn FROM live) WHERE rn = 1)"""


@query("whiteout_types", f"WITH {_NAMED} SELECT layer, path, kind, CASE WHEN starts_with(nm, '.wh.') AND nm <> '.wh..wh..opq' THEN substring(nm, 5) END origin FROM kinds")
def whiteout_types(spark, sf_dir):
    name = overlay.base_name(F.col("path"))
    return model.entries(spark, sf_dir).select("layer", "path", overlay.whiteout_type(name, F.col("layer")).alias("kind"), overlay.origin_name(name).alias("origin"))


@query("overlay_merge", f"WITH {_NAMED} SELECT path, layer, is_dir, size, digest FROM merged")
def overlay_merge(spark, sf_dir):
    return overlay.merge_layers(model.entries(spark, sf_dir)).select("path", "layer", "is_dir", "size", "digest")


@query("overlay_states", f"""WITH {ENTRIES}, f AS (SELECT *, min(layer) OVER (PARTITION BY path) f FROM entries)
SELECT layer, path, CASE WHEN layer=0 THEN 'Lower' WHEN f < layer THEN 'UpperModification' ELSE 'UpperAddition' END state FROM f""")
def overlay_states(spark, sf_dir):
    return overlay.overlay_states(model.entries(spark, sf_dir)).select("layer", "path", "state")


@query("should_dump", f"""WITH {ENTRIES}, f AS (SELECT *, min(layer) OVER (PARTITION BY path) f FROM entries) SELECT layer, count(*) nodes FROM f WHERE layer > 0 GROUP BY 1""")
def should_dump(spark, sf_dir):
    states = overlay.overlay_states(model.entries(spark, sf_dir))
    return states.filter(overlay.should_dump(F.col("state"))).groupBy("layer").agg(F.count("*").alias("nodes"))


@query("overlay_diff", f"""WITH {ENTRIES}, a AS (SELECT * FROM entries WHERE layer = 0), b AS (SELECT * FROM entries WHERE layer = 1)
SELECT coalesce(a.path, b.path) path, CASE WHEN a.path IS NULL THEN 'Add' WHEN b.path IS NULL THEN 'Delete' ELSE 'Modify' END change FROM a FULL JOIN b ON a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.size IS DISTINCT FROM b.size OR a.digest IS DISTINCT FROM b.digest""")
def overlay_diff(spark, sf_dir):
    e = model.entries(spark, sf_dir)
    return overlay.layer_diff(e.filter("layer = 0"), e.filter("layer = 1"), ["size", "digest"])


@query("fs_compare", f"""WITH {FILES}, a AS (SELECT path, size, ino%8 mode, CASE WHEN ino%6=0 THEN NULL ELSE 'l'||ino END symlink FROM files WHERE ino%10<>0),
b AS (SELECT path, size + (CASE WHEN ino%50=1 THEN 1 ELSE 0 END) size, CASE WHEN ino%40=3 THEN 9 ELSE ino%8 END mode, CASE WHEN ino%6=0 OR ino%70=5 THEN NULL ELSE 'l'||ino END symlink FROM files WHERE ino%15<>0)
SELECT coalesce(a.path, b.path) path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.size<>b.size THEN 'size' WHEN a.mode<>b.mode THEN 'mode' ELSE 'symlink' END verdict
FROM a FULL JOIN b ON a.path=b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size<>b.size OR a.mode<>b.mode OR a.symlink IS DISTINCT FROM b.symlink""")
def fs_compare(spark, sf_dir):
    """A file system against its converted copy: missing, extra and differing paths."""
    f, none = model.files(spark, sf_dir), F.lit(None).cast("string")
    link = F.concat(F.lit("l"), F.col("ino").cast("string"))
    a = f.filter("ino % 10 <> 0").select("path", "size", (F.col("ino") % 8).alias("mode"), F.when(F.col("ino") % 6 == 0, none).otherwise(link).alias("symlink"))
    b = f.filter("ino % 15 <> 0").select(
        "path", (F.col("size") + F.when(F.col("ino") % 50 == 1, 1).otherwise(0)).alias("size"), F.when(F.col("ino") % 40 == 3, 9).otherwise(F.col("ino") % 8).alias("mode"),
        F.when((F.col("ino") % 6 == 0) | (F.col("ino") % 70 == 5), none).otherwise(link).alias("symlink"),
    )
    return overlay.compare_trees(a, b, ["size", "mode", "symlink"])


@query("same_entries", f"""WITH {ENTRIES} SELECT a.path, a.size = b.size AND a.digest IS NOT DISTINCT FROM b.digest same FROM entries a JOIN entries b ON a.path=b.path AND a.layer=0 AND b.layer=1""")
def same_entries(spark, sf_dir):
    e = model.entries(spark, sf_dir)
    b = e.filter("layer = 1").select("path", F.col("size").alias("s2"), F.col("digest").alias("d2"))
    return e.filter("layer = 0").join(b, "path").select("path", ((F.col("size") == F.col("s2")) & F.col("digest").eqNullSafe(F.col("d2"))).alias("same"))


@query("record_merge", """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) k, max(CASE WHEN o_orderkey%3=0 THEN o_orderkey END) blob, max(CASE WHEN o_orderkey%4=0 THEN o_orderkey END) boot FROM orders WHERE o_orderkey%2=0 GROUP BY 1),
n AS (SELECT CAST(o_custkey AS VARCHAR) k, max(CASE WHEN o_orderkey%5=0 THEN o_orderkey END) blob, max(CASE WHEN o_orderkey%7=0 THEN o_orderkey END) boot FROM orders WHERE o_orderkey%2=1 GROUP BY 1)
SELECT coalesce(o.k, n.k) AS chain, CAST(coalesce(n.blob, o.blob) AS BIGINT) blob, CAST(coalesce(n.boot, o.boot) AS BIGINT) boot FROM o FULL JOIN n ON o.k=n.k""")
def record_merge(spark, sf_dir):
    """Build-cache records of a chain id: new fields over old ones."""
    orders = model.table(spark, sf_dir, "orders")
    one = lambda df, a, b: df.groupBy(F.col("o_custkey").cast("string").alias("chain")).agg(
        F.max(F.when(F.col("o_orderkey") % a == 0, F.col("o_orderkey"))).cast("bigint").alias("blob"), F.max(F.when(F.col("o_orderkey") % b == 0, F.col("o_orderkey"))).cast("bigint").alias("boot")
    )
    return overlay.merge_records(one(orders.filter("o_orderkey % 2 = 0"), 3, 4), one(orders.filter("o_orderkey % 2 = 1"), 5, 7), "chain")


@query("cache_import", "SELECT CAST(o_custkey AS BIGINT) AS chain, CAST(max(o_orderkey) AS BIGINT) newest, CAST(arg_max(o_totalprice, o_orderkey) AS DOUBLE) price FROM orders GROUP BY 1")
def cache_import(spark, sf_dir):
    """The latest record of each chain id."""
    orders = model.table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").cast("bigint").alias("chain")).agg(F.max("o_orderkey").cast("bigint").alias("newest"), F.max_by("o_totalprice", "o_orderkey").cast("double").alias("price"))


@query("cache_check", "SELECT CAST(c_custkey AS BIGINT) AS chain FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def cache_check(spark, sf_dir):
    """Chain ids whose record's blob exists."""
    held = model.table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return model.table(spark, sf_dir, "customer").join(held, "c_custkey", "left_semi").select(F.col("c_custkey").cast("bigint").alias("chain"))


@query("cache_lru", """WITH n AS (SELECT CAST(p_partkey AS BIGINT) k, 0 age FROM part WHERE p_partkey%50=0), o AS (SELECT CAST(p_partkey AS BIGINT) k, 1 age FROM part WHERE p_partkey%20=0 AND p_partkey NOT IN (SELECT k FROM n))
SELECT row_number() OVER (ORDER BY age, k) - 1 place, k FROM (SELECT * FROM n UNION ALL SELECT * FROM o) ORDER BY age, k LIMIT 60""")
def cache_lru(spark, sf_dir):
    part = model.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k")).withColumn("t", F.col("k"))
    return overlay.keep_recent(part.filter("k % 20 = 0"), part.filter("k % 50 = 0"), "k", "t", 60)


NODES = FILES + """, parts AS (SELECT path, string_split(path, '/') p FROM files), dirs AS (SELECT DISTINCT array_to_string(p[1:i], '/') path FROM (SELECT p, unnest(range(2, len(p))) i FROM parts)),
nodes AS (SELECT path, CASE WHEN regexp_replace(path, '/[^/]*$', '')='' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END parent, false is_dir, size FROM files
 UNION ALL SELECT path, CASE WHEN regexp_replace(path, '/[^/]*$', '')='' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END, true, CAST(0 AS BIGINT) FROM dirs UNION ALL SELECT '/', NULL, true, CAST(0 AS BIGINT))"""


def _nodes(spark, sf_dir):
    return trees.with_directories(model.files(spark, sf_dir).select("path", "size"))


@query("tree_nodes", f"WITH {NODES} SELECT path, parent, is_dir, size, CAST(CASE WHEN path='/' THEN 0 ELSE len(string_split(path,'/'))-1 END AS BIGINT) AS depth FROM nodes")
def tree_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).withColumn("depth", trees.depth(F.col("path")))


@query("tree_dfs", f"""WITH {NODES} SELECT path, row_number() OVER (PARTITION BY string_split(path,'/')[2] ORDER BY string_split(regexp_replace(path,'^/',''),'/')) - 1 AS "order" FROM nodes WHERE path <> '/'""")
def tree_dfs(spark, sf_dir):
    return trees.depth_first(_nodes(spark, sf_dir).filter("path <> '/'")).select("path", "order")


@query("tree_bfs", f"""WITH {NODES} SELECT path, depth, row_number() OVER (PARTITION BY parent ORDER BY path) - 1 AS "index" FROM (SELECT *, CAST(len(string_split(path,'/'))-1 AS BIGINT) AS depth FROM nodes WHERE path <> '/')""")
def tree_bfs(spark, sf_dir):
    """A breadth-first walk: level, and place among the parent's children."""
    return trees.child_index(_nodes(spark, sf_dir)).select("path", trees.depth(F.col("path")).alias("depth"), "index")


@query("tree_paths", """WITH n AS (SELECT CAST(-1 AS BIGINT) k, NULL::BIGINT p, '' nm UNION ALL SELECT CAST(r_regionkey AS BIGINT), -1, r_name FROM region UNION ALL SELECT 100+n_nationkey, n_regionkey, n_name FROM nation
UNION ALL SELECT 1000+s_suppkey, 100+s_nationkey, 's'||s_suppkey FROM supplier) SELECT CAST(d.k AS BIGINT) ino, CASE WHEN d.k=-1 THEN '/' WHEN b.k IS NULL OR b.k=-1 THEN '/'||d.nm WHEN c.k=-1 THEN '/'||b.nm||'/'||d.nm ELSE '/'||c.nm||'/'||b.nm||'/'||d.nm END path
FROM n d LEFT JOIN n b ON b.k=d.p LEFT JOIN n c ON c.k=b.p""")
def tree_paths(spark, sf_dir):
    """Paths of inodes from parent pointers: regions, their nations, their suppliers."""
    t = lambda name: model.table(spark, sf_dir, name)
    root = spark.range(1).select(F.lit(-1).cast("bigint").alias("ino"), F.lit(None).cast("bigint").alias("parent_ino"), F.lit("").alias("name"))
    big = lambda c: F.col(c).cast("bigint")
    rows = (
        root.unionByName(t("region").select(big("r_regionkey").alias("ino"), F.lit(-1).cast("bigint").alias("parent_ino"), F.col("r_name").alias("name")))
        .unionByName(t("nation").select((100 + big("n_nationkey")).alias("ino"), big("n_regionkey").alias("parent_ino"), F.col("n_name").alias("name")))
        .unionByName(t("supplier").select((1000 + big("s_suppkey")).alias("ino"), (100 + big("s_nationkey")).alias("parent_ino"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name")))
    )
    return trees.paths_by_parent(rows)


@query("node_by_path", f"WITH {FILES} SELECT ino, path FROM files WHERE path IN (SELECT min(path) FROM files GROUP BY image) OR path = '/nowhere'")
def node_by_path(spark, sf_dir):
    """Nodes of stated paths: the first of each image, and one that there isn't."""
    files = model.files(spark, sf_dir)
    wanted = files.groupBy("image").agg(F.min("path").alias("path")).select("path").unionByName(spark.createDataFrame([("/nowhere",)], "path string"))
    return files.join(wanted, "path", "left_semi").select("ino", "path")


@query("child_by_name", f"WITH {FILES} SELECT ino FROM files WHERE parent = '/src1/en' AND name = '21'")
def child_by_name(spark, sf_dir):
    return model.files(spark, sf_dir).filter("parent = '/src1/en' and name = '21'").select("ino")


@query("child_by_index", f"""WITH {NODES}, c AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY path) - 1 i FROM nodes WHERE parent IS NOT NULL) SELECT parent, path FROM c WHERE i = 2""")
def child_by_index(spark, sf_dir):
    return trees.child_index(_nodes(spark, sf_dir)).filter("index = 2").select("parent", "path")


@query("inspect_ls", f"""WITH {NODES} SELECT path, row_number() OVER (ORDER BY path) - 1 AS "index", CASE WHEN is_dir THEN 'd' ELSE '-' END sign FROM nodes WHERE parent = '/src1/en'""")
def inspect_ls(spark, sf_dir):
    return trees.children(_nodes(spark, sf_dir), "/src1/en").select("path", "index", F.when(F.col("is_dir"), "d").otherwise("-").alias("sign"))


@query("readdir_offset", f"""WITH {NODES} SELECT path FROM nodes WHERE parent = '/src2/en' ORDER BY path LIMIT 5 OFFSET 2""")
def readdir_offset(spark, sf_dir):
    """A page of a directory's children in name order."""
    return _nodes(spark, sf_dir).filter("parent = '/src2/en'").select("path").orderBy("path").offset(2).limit(5)


@query("descendants", f"WITH {NODES} SELECT path, size FROM nodes WHERE NOT is_dir AND starts_with(path, '/src4/')")
def descendants(spark, sf_dir):
    return trees.descendants(_nodes(spark, sf_dir), "/src4").select("path", "size")


@query("nlink", f"WITH {NODES} SELECT d.path, (SELECT count(*) FROM nodes c WHERE c.parent=d.path) children, (SELECT count(*)+2 FROM nodes c WHERE c.parent=d.path AND c.is_dir) nlink FROM nodes d WHERE d.is_dir")
def nlink(spark, sf_dir):
    return trees.link_counts(_nodes(spark, sf_dir))


@query("dir_digest", f"""WITH {FILES}, l2 AS (SELECT parent path, sha256(string_agg(sha256(text), '' ORDER BY path)) digest FROM files GROUP BY 1),
l1 AS (SELECT regexp_replace(path,'/[^/]*$','') path, sha256(string_agg(digest, '' ORDER BY path)) digest FROM l2 GROUP BY 1), l0 AS (SELECT '/' path, sha256(string_agg(digest, '' ORDER BY path)) digest FROM l1)
SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0""")
def dir_digest(spark, sf_dir):
    files = model.files(spark, sf_dir).select("path", F.sha2("text", 256).alias("digest"), "size")
    nodes = trees.with_directories(files.select("path", "size")).join(files.select("path", "digest"), "path", "left")
    return trees.directory_digests(nodes, 2)


@query("merkle_root", f"""WITH {CHUNKS}, p AS (SELECT image, digest, row_number() OVER (PARTITION BY image ORDER BY ino, idx) - 1 page FROM chunks),
a AS (SELECT image, page//8 page, sha256(string_agg(digest, '' ORDER BY page)) digest FROM p GROUP BY 1, 2), b AS (SELECT image, page//8 page, sha256(string_agg(digest, '' ORDER BY page)) digest FROM a GROUP BY 1, 2),
c AS (SELECT image, page//8 page, sha256(string_agg(digest, '' ORDER BY page)) digest FROM b GROUP BY 1, 2) SELECT image, digest AS root FROM c""")
def merkle_root(spark, sf_dir):
    pages = running(model.chunks(spark, sf_dir), ["image"], F.floor(F.col("ino") / CELL), ["ino", "idx"], {}, index="page")
    return trees.merkle_roots(pages, "image", fanout=8, most_pages=512)


@query("hardlink_paths", f"WITH {FILES} SELECT sha256(text) link, count(*) n, string_agg(path, ',' ORDER BY path) paths FROM files GROUP BY 1 HAVING count(*) > 1")
def hardlink_paths(spark, sf_dir):
    """All paths of each inode that has several; equal contents stand for links."""
    paths = F.array_join(F.array_sort(F.collect_list("path")), ",")
    return model.files(spark, sf_dir).groupBy(F.sha2("text", 256).alias("link")).agg(F.count("*").alias("n"), paths.alias("paths")).filter("n > 1")


@query("inode_numbering", f"""WITH {FILES}, k AS (SELECT image, sha256(text) link, min(ino) first FROM files GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY first) number FROM k)
SELECT f.ino, r.number FROM files f JOIN r ON r.image=f.image AND r.link=sha256(f.text)""")
def inode_numbering(spark, sf_dir):
    files = model.files(spark, sf_dir).select("image", "ino", F.sha2("text", 256).alias("link"))
    return trees.numbered_inodes(files, ["image", "link"], ["ino"]).select("ino", "number")


@query("inspect_stats", f"WITH {NODES} SELECT count(*) inodes, count(*) FILTER (is_dir) dirs, CAST(sum(size) AS BIGINT) bytes FROM nodes")
def inspect_stats(spark, sf_dir):
    return _nodes(spark, sf_dir).agg(F.count("*").alias("inodes"), F.count_if("is_dir").alias("dirs"), F.sum("size").alias("bytes"))


@query("inspect_stat_file", f"WITH {CHUNKS} SELECT f.path, f.size AS file_size, c.idx, c.size, c.digest FROM files f JOIN chunks c USING (ino) WHERE f.path = '/src1/en/21' OR f.ino = 4")
def inspect_stat_file(spark, sf_dir):
    files = model.files(spark, sf_dir).filter("path = '/src1/en/21' or ino = 4").select("ino", "path", F.col("size").alias("file_size"))
    return files.join(model.chunks(spark, sf_dir), "ino").select("path", "file_size", "idx", "size", "digest")


@query("inspect_blobs", f"WITH {CHUNKS} SELECT image, count(*) chunks, CAST(sum(comp_size) AS BIGINT) comp_size, CAST(sum(size) AS BIGINT) size FROM chunks GROUP BY 1")
def inspect_blobs(spark, sf_dir):
    return model.chunks(spark, sf_dir).groupBy("image").agg(F.count("*").alias("chunks"), F.sum("comp_size").alias("comp_size"), F.sum("size").alias("size"))


@query("inspect_chunk", f"WITH {CHUNKS} SELECT f.path, c.idx FROM chunks c JOIN files f USING (ino) WHERE c.file_offset = 8192 AND c.ver = 2")
def inspect_chunk(spark, sf_dir):
    """Files with a chunk at an offset."""
    hits = model.chunks(spark, sf_dir).filter("file_offset = 8192 and ver = 2").select("ino", "idx")
    return hits.join(model.files(spark, sf_dir).select("ino", "path"), "ino").select("path", "idx")


@query("inspect_icheck", f"WITH {FILES} SELECT path FROM files WHERE ino = 77")
def inspect_icheck(spark, sf_dir):
    return model.files(spark, sf_dir).filter("ino = 77").select("path")


PATTERNS = [(0, "/src1"), (1, "/src2/en"), (2, "/src1/en"), (3, "relative/x"), (4, "/src3/de/7"), (5, "/src2"), (6, "/src2/en")]
_PATTERNS = "pats(place, pattern) AS (VALUES " + ", ".join(f"({a}, '{b}')" for a, b in PATTERNS) + ")"


def _patterns(spark):
    return spark.createDataFrame(PATTERNS, "place bigint, pattern string")


@query("prefetch_patterns", f"""WITH {_PATTERNS}, a AS (SELECT CAST(place AS BIGINT) place, pattern FROM pats WHERE starts_with(pattern, '/'))
SELECT place, pattern FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.place < a.place AND (b.pattern = a.pattern OR starts_with(a.pattern, b.pattern||'/')))""")
def prefetch_patterns(spark, sf_dir):
    return trees.uncovered_patterns(_patterns(spark))


@query("longest_prefix", f"""WITH {FILES}, {_PATTERNS}, m AS (SELECT f.path, p.pattern, row_number() OVER (PARTITION BY f.path ORDER BY length(p.pattern) DESC) rn FROM files f JOIN (SELECT DISTINCT pattern FROM pats) p ON f.path = p.pattern OR starts_with(f.path, p.pattern||'/'))
SELECT path, pattern FROM m WHERE rn = 1""")
def longest_prefix(spark, sf_dir):
    return trees.longest_prefix(model.files(spark, sf_dir).select("path"), _patterns(spark))


@query("prefetch_order", f"""WITH {FILES}, {_PATTERNS}, m AS (SELECT f.ino, min(p.place) place FROM files f LEFT JOIN pats p ON f.path = p.pattern OR starts_with(f.path, p.pattern||'/') GROUP BY 1)
SELECT ino, row_number() OVER (PARTITION BY place IS NULL ORDER BY place, ino) - 1 AS rank, place IS NOT NULL prefetch FROM m""")
def prefetch_order(spark, sf_dir):
    """Files in dump order: those of prefetch patterns by pattern, then the others."""
    up = F.concat(overlay.ancestors(F.col("path")), F.array("path"))
    spread = model.files(spark, sf_dir).select("ino", F.explode(up).alias("pattern"))
    place = spread.join(F.broadcast(_patterns(spark)), "pattern", "left").groupBy("ino").agg(F.min("place").alias("place"))
    cell = F.coalesce("place", F.lit(0)) * F.lit(1 << 40) + F.floor(F.col("ino") / CELL)
    ranked = running(place.withColumn("prefetch", F.col("place").isNotNull()), ["prefetch"], cell, ["place", "ino"], {}, index="rank")
    return ranked.select("ino", "rank", "prefetch")


@query("prefetch_files", f"""WITH {FILES}, {_PATTERNS} SELECT DISTINCT sha256(text) link, min(ino) OVER (PARTITION BY sha256(text)) ino FROM files f WHERE EXISTS (SELECT 1 FROM pats p WHERE f.path = p.pattern OR starts_with(f.path, p.pattern||'/'))""")
def prefetch_files(spark, sf_dir):
    """Files to prefetch: directories expand, hard links count once."""
    hit = trees.longest_prefix(model.files(spark, sf_dir).select("path"), _patterns(spark)).select("path")
    files = model.files(spark, sf_dir).select("path", "ino", F.sha2("text", 256).alias("link"))
    return files.join(hit, "path", "left_semi").groupBy("link").agg(F.min("ino").alias("ino"))


@query("inspect_prefetch", f"WITH {FILES}, {_PATTERNS} SELECT ino, path FROM files f WHERE EXISTS (SELECT 1 FROM pats p WHERE f.path = p.pattern) OR path IN (SELECT max(path) FROM files GROUP BY image)")
def inspect_prefetch(spark, sf_dir):
    """Files that a prefetch table names: the patterns and the last file of each image."""
    files = model.files(spark, sf_dir)
    wanted = _patterns(spark).select(F.col("pattern").alias("path")).unionByName(files.groupBy("image").agg(F.max("path").alias("path")).select("path"))
    return files.join(wanted, "path", "left_semi").select("ino", "path")


@query("external_paths", f"WITH {FILES} SELECT path, starts_with(path, '/src1/') OR path = '/src3/de/7' external FROM files")
def external_paths(spark, sf_dir):
    """Files whose data are external: attribute patterns match a path or a prefix."""
    from quarry.sources.formats import is_external

    return model.files(spark, sf_dir).select("path", is_external(F.col("path"), ["/src1/", "/src3/de/7"]).alias("external"))


@query("version_check", f"WITH {FILES} SELECT image, count(DISTINCT layer) formats, count(DISTINCT layer) = 1 consistent FROM files GROUP BY 1")
def version_check(spark, sf_dir):
    """Whether an image's inputs share one format version."""
    return model.files(spark, sf_dir).groupBy("image").agg(F.count_distinct("layer").alias("formats")).withColumn("consistent", F.col("formats") == 1)


@query("config_compatibility", """WITH m AS (SELECT CAST(s_suppkey AS BIGINT) id, 12 + s_suppkey%9 chunk_bits, s_suppkey%2 = 0 explicit_uid, 5 + s_suppkey%2 version FROM supplier)
SELECT id, CASE WHEN version <> 6 THEN 'version' WHEN chunk_bits <> 20 THEN 'chunk_size' WHEN NOT explicit_uid THEN 'uid' END problem FROM m""")
def config_compatibility(spark, sf_dir):
    k = F.col("s_suppkey").cast("bigint")
    problem = F.when(5 + k % 2 != 6, "version").when(12 + k % 9 != 20, "chunk_size").when(k % 2 != 0, "uid")
    return model.table(spark, sf_dir, "supplier").select(k.alias("id"), problem.alias("problem"))


@query("check_image", f"""WITH {CHUNKS} SELECT image, count(DISTINCT ino) files, count(*) chunks, count(*) FILTER (size > 4096 OR size <= 0) bad_sizes, count(*) FILTER (length(digest) <> 64) bad_digests FROM chunks GROUP BY 1""")
def check_image(spark, sf_dir):
    return model.chunks(spark, sf_dir).groupBy("image").agg(
        F.count_distinct("ino").alias("files"), F.count("*").alias("chunks"), F.count_if((F.col("size") > 4096) | (F.col("size") <= 0)).alias("bad_sizes"), F.count_if(F.length("digest") != 64).alias("bad_digests")
    )


@query("manifest_rule", """WITH l AS (SELECT CAST(l_orderkey AS BIGINT) image, l_returnflag = 'N' boot, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC) rn FROM lineitem)
SELECT image, count(*) layers, count(*) FILTER (rn = 1 AND boot) = 1 AND count(*) FILTER (boot) = 1 valid FROM l GROUP BY 1""")
def manifest_rule(spark, sf_dir):
    """A manifest is valid where its last layer, and only it, is the metadata layer."""
    layers = model.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("bigint").alias("image"))
    boot = F.col("l_returnflag") == "N"
    last = F.max_by(boot, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    out = layers.agg(F.count("*").alias("layers"), F.count_if(boot).alias("boots"), last.alias("last_is_boot"))
    return out.select("image", "layers", (F.col("last_is_boot") & (F.col("boots") == 1)).alias("valid"))
