import hashlib
import random

from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.model import fixed_chunks
from quarry.operators import compaction, dedup, dictionary, metrics, overlay, prefix, ranges, trees
from quarry.sources.store import ChunkStore
from quarry.streaming import state, streams


def test_chunks_of_empty_and_multibyte_texts(spark):
    rows = fixed_chunks(spark.createDataFrame([(1, ""), (2, "é" * 5), (3, "abcd"), (4, None)], "k bigint, text string"), chunk_size=4, keep=("k",)).collect()
    assert sorted((r["k"], r["idx"], r["size"]) for r in rows) == [(2, 0, 4), (2, 1, 4), (2, 2, 2), (3, 0, 4)]


def test_bins_at_their_bounds(spark):
    values = [0, 200, 201, 1000, 1001, 2_000_000, 2_000_001]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v bigint").select(metrics.latency_us_bin(F.col("v"))).collect()]
    assert got == [0, 0, 1, 1, 2, 6, 7]
    sizes = [0, 1023, 1024, 4095, 4096, 16383, 16384, 65536, 131072, 524288, 1 << 20, 1 << 40]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in sizes], "v bigint").select(metrics.size_bin(F.col("v"))).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 7]


def test_id_ranges_cross_blocks(spark):
    ids = [1, 2, 3, 7, 65534, 65535, 65536, 65537, 131072]
    got = sorted(tuple(r) for r in metrics.id_ranges(spark.createDataFrame([(i,) for i in ids], "ino bigint")).collect())
    assert got == [(1, 3), (7, 7), (65534, 65537), (131072, 131072)]


def test_capped_requests_equal_a_loop(spark):
    rng = random.Random(1)
    rows, at = [], 0
    for _ in range(300):
        at += rng.choice([0, 0, 0, 3, 50])
        rows.append(("k%d" % (at % 2 * 0), at, at + rng.randrange(1, 30)))
        at = rows[-1][2]
    got = ranges.capped_requests(spark.createDataFrame(rows, "k string, a bigint, b bigint"), "k", "a", "b", 10, 60).collect()
    expected, held = [], None
    for _, a, b in rows:
        if held and a - held[1] <= 10 and held[1] - held[0] < 60:
            held = [held[0], b, held[2] + 1]
        else:
            expected += [tuple(held)] if held else []
            held = [a, b, 1]
    expected.append(tuple(held))
    assert sorted((r["start"], r["end"], r["chunks"]) for r in got) == expected


def test_layers_merge_by_the_rules(spark):
    rows = [
        (0, "/d", True), (0, "/d/a", False), (0, "/d/b", False), (0, "/e", True), (0, "/e/x", False), (0, "/f", True), (0, "/f/y", False), (0, "/.wh.zero", False),
        (1, "/d/.wh.a", False), (1, "/e", True), (1, "/e/.wh..wh..opq", False), (1, "/e/new", False), (1, "/f", False), (2, "/d/a", False),
    ]
    merged = overlay.merge_layers(spark.createDataFrame(rows, "layer bigint, path string, is_dir boolean")).collect()
    assert sorted((r["path"], r["layer"]) for r in merged) == [("/d", 0), ("/d/a", 2), ("/d/b", 0), ("/e", 1), ("/e/new", 1), ("/f", 1)]


def test_distances_and_clusters(spark):
    rows = [("a", "1", 5), ("a", "2", 5), ("b", "1", 5), ("b", "2", 5), ("c", "9", 10)]
    got = {(r["a"], r["b"]): r["distance"] for r in dictionary.distances(spark.createDataFrame(rows, "image string, digest string, size bigint")).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 1.0, ("b", "c"): 1.0}
    assert len(dictionary.radii()) == 8 and len(dictionary.radii(0.5, 0.05, 0.8)) == 6
    clusters = dictionary.Clusters(list("abcdefghijkl"), 10)
    near = [(x, y, 0.4) for i, x in enumerate("abcdefghijk") for y in "abcdefghijk"[i + 1 :]]
    assert set(clusters.grow(dictionary.neighbours(near, 0.5)).values()) == {1} and "l" not in clusters.label


def test_smoothing_equals_the_recurrence(spark):
    rng = random.Random(2)
    rows = [("i", v, p, rng.choice("abcd")) for v in range(6) for p in range(40)]
    df = spark.createDataFrame(rows, "image string, ver bigint, pos bigint, digest string")
    got = {(r["ver"], r["pos"]): r["score"] for r in dictionary.smoothed(df).collect()}
    for width in (7, 60):  # blocks narrower and wider than the rows that weigh anything
        cells = dictionary.smoothed(df, cell=F.floor(F.col("pos") / 9), width=width).collect()
        assert len(cells) == len(rows) and {(r["ver"], r["pos"]): r["score"] for r in cells} == got
    last = 0.0
    for _, v, p, d in rows:
        seen = v > 0 and any(x[1] == v - 1 and x[3] == d for x in rows)
        last = 0.0 if v == 0 else 0.5 * seen + 0.5 * last
        assert abs(got[v, p] - last) < 1e-12


def test_packing_and_merging(spark):
    files = spark.createDataFrame([("a", i, s) for i, s in enumerate([30, 40, 40, 10, 60, 49, 49, 2])], "blob string, ino bigint, size bigint")
    got = sorted((r["ino"], r["batch_no"], r["batch_offset"]) for r in ranges.packed(files, "blob", "ino", 100).collect())
    assert got == [(0, 0, 0), (1, 0, 30), (2, 1, 0), (3, 1, 40), (5, 1, 50), (6, 2, 0), (7, 2, 49)]
    blobs = spark.createDataFrame([("x", 20), ("y", 30), ("z", 60), ("w", 1000)], "b string, size bigint")
    merged = {r["b"]: (r["merged"], r["offset"]) for r in compaction.greedy_merge(blobs, "b", "size", 100).collect()}
    assert merged["x"][1] == 0 and merged["y"] == (merged["x"][0], 20) and merged["z"][0] != merged["x"][0] and "w" not in merged


def test_checksums_codecs_and_paths(spark):
    assert scalar.crc32c_of(b"123456789") == 0xE3069283
    df = spark.createDataFrame([(b"123456789",), (None,), (b"a" * 1000,)], "b binary")
    assert [r[0] for r in df.select(scalar.crc32c("b")).collect()][:2] == [0xE3069283, None]
    packed = df.select("b", scalar.gzip_or_raw("b").alias("p")).select("b", "p", scalar.gunzip_or_raw("p").alias("q")).collect()
    assert all(r["b"] == r["q"] for r in packed) and len(packed[2]["p"]) < 100 and packed[0]["p"] == packed[0]["b"]
    one = spark.range(1).select(scalar.components(F.lit("/a/b")).alias("c"), scalar.reparented(F.lit("/r"), "/r").alias("r"), scalar.reparented(F.lit("/rx/y"), "/r").alias("s")).first()
    assert (one["c"], one["r"], one["s"]) == (["/", "a", "b"], "/", "/rx/y")


def test_merkle_levels_and_walk_order(spark):
    assert trees.merkle_levels(1) == [1] and trees.merkle_levels(128) == [1] and trees.merkle_levels(129) == [2, 1]
    nodes = spark.createDataFrame([("/a/b.c",), ("/a/b/c",), ("/a",), ("/a/b",)], "path string")
    assert [r["path"] for r in trees.depth_first(nodes).orderBy("order").collect()] == ["/a", "/a/b", "/a/b/c", "/a/b.c"]


def test_buckets_wait_when_empty():
    bucket, waits = None, []
    for now, amount in [(0, 20), (0, 5), (1, 10), (1.05, 1), (9, 25), (9, 0)]:
        bucket, wait = state.draw(bucket, now, amount, 10)
        waits.append(wait)
    assert waits == [0.0, 0.5, 0.0, 0.1, 0.5, 0.0] and bucket == state.Bucket(0, 9)


def test_streams_equal_batches(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = streams.drain(streams.tumbling(streams.event_stream(spark, sf_dir))).agg(F.sum("n")).first()[0]
    assert got == events.count()


def test_statistics_count_links_once(spark):
    files = spark.createDataFrame([("i", "/d", "l1", 1, 10), ("i", "/d", "l1", 2, 10), ("i", "/e", "l2", 3, 4096)], "image string, parent string, link string, ino bigint, size bigint")
    chunks = spark.createDataFrame([("i", "x")], "image string, digest string")
    row = dedup.image_statistics(files, chunks).first()
    assert (row["files"], row["links"], row["bytes"], row["padding"], row["chunks"]) == (3, 2, 4106, 4086, 1)


def test_point_lookups_equal_a_loop_in_cells_of_any_width(spark):
    rng = random.Random(6)
    rows, at = [], 0
    for i in range(120):
        at += rng.choice([0, 0, 5, 300])
        rows.append(("k", i, at, at + rng.randrange(1, 40)))
        at = rows[-1][3]
    points = [rng.randrange(at + 50) for _ in range(300)]
    chunks, asked = spark.createDataFrame(rows, "k string, idx bigint, start bigint, end bigint"), spark.createDataFrame([("k", p) for p in points], "k string, addr bigint")
    for width in (1, 17, 1000, 1 << 28):
        for following in (False, True):
            got = sorted(((r["addr"], r["idx"]) for r in ranges.covering(chunks, asked, "k", width, next_if_none=following).collect()), key=str)
            one = lambda p: next((i for _, i, a, b in rows if a <= p < b), next((i for _, i, a, b in rows if p < b), None) if following else None)
            assert got == sorted(((p, one(p)) for p in points), key=str), (width, following)


def test_neighbours_and_running_sums_cross_cells(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), n) for n in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g string, n bigint")
    for width in (1, 10, 10_000):
        told = prefix.with_previous(df, ["g"], F.floor(F.col("n") / width), ["n"], {"before": F.col("n")}).collect()
        summed = prefix.running(df, ["g"], F.floor(F.col("n") / width), ["n"], {"sum": F.col("n")}, index="nth").collect()
        for g in "ab":
            own = sorted(n for x, n in rows if x == g)
            assert sorted(((r["n"], r["before"]) for r in told if r["g"] == g)) == list(zip(own, [None, *own]))
            assert sorted((r["n"], r["sum"], r["nth"]) for r in summed if r["g"] == g) == [(n, sum(own[:i]), i) for i, n in enumerate(own)]
    texts = ["", "a", "ab", "b", "zz", "é", "\U0010ffff", None]
    cells = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(prefix.text_cell(F.col("t"))).collect()]
    assert cells[:-1] == sorted(cells[:-1]) and cells[-1] == -1


def test_paths_of_a_deep_tree_and_of_nodes_without_a_root(spark):
    rows = [(0, None, "")] + [(i, i - 1, f"n{i}") for i in range(1, 300)] + [(1000, 999, "lost"), (2000, 0, "x")]
    got = dict(tuple(r) for r in trees.paths_by_parent(spark.createDataFrame(rows, "ino bigint, parent_ino bigint, name string")).collect())
    assert got[0] == "/" and got[3] == "/n1/n2/n3" and got[299].count("/") == 299 and got[2000] == "/x" and 1000 not in got


def test_levels_of_hash_trees_by_column(spark):
    pages = [1, 2, 127, 128, 129, 16_384, 16_385, 10**9, 1 << 62]
    got = spark.createDataFrame([(p,) for p in pages], "p bigint").select("p", trees.merkle_levels_of(F.col("p")).alias("l")).collect()
    assert all(r["l"] == trees.merkle_levels(r["p"]) for r in got)


def test_codecs_give_back_the_bytes(spark):
    bodies = [b"", b"x", b"abc" * 1000, bytes(range(256)), None]
    rows = [(b, c, len(b or b"")) for b in bodies for c in scalar.CODECS]
    packed = spark.createDataFrame(rows, "b binary, c string, n bigint").withColumn("p", scalar.packed("b", "c"))
    for r in packed.withColumn("u", scalar.unpacked("p", "c", "n")).collect():
        assert r["u"] == r["b"] and len(r["p"] or b"") <= r["n"] and (r["c"] == "none" or r["n"] != 3000 or len(r["p"]) < 100)


def test_a_kept_store_ignores_repeats_deletes_and_lists_pages(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "t"), ["digest"], "blob")
    assert store.rows() is None
    rows = lambda *x: spark.createDataFrame(x, "digest string, blob string, n bigint")
    store.insert(rows(("a", "x", 2), ("a", "y", 1), ("b", "x", 3)), ["n"])
    store.insert(rows(("a", "z", 0), ("c", "x", 4)), ["n"])
    store.delete(rows(("-", "x", 0)))
    assert sorted(tuple(r) for r in store.rows().collect()) == [("a", "y", 1)]
    store.insert(rows(("c", "x", 5), ("d", "w", 6)), ["n"])
    assert sorted(tuple(r) for r in store.rows().collect()) == [("a", "y", 1), ("c", "x", 5), ("d", "w", 6)]
    assert sorted((r["digest"], r["page"]) for r in store.pages(["n"], 2).collect()) == [("a", 0), ("c", 0), ("d", 1)]
    assert [r["blob"] for r in store.lookup(rows(("d", "", 0)).select("digest")).collect()] == ["w"]


def test_clusters_of_images_follow_density(spark):
    """Two groups of images that share all chunks, and one apart, at any radius."""
    rows = [(f"a{i}", "1", 5) for i in range(6)] + [(f"b{i}", "2", 5) for i in range(7)] + [("c", "9", 5)]
    got = dictionary.cluster_images(spark.createDataFrame(rows, "image string, digest string, size bigint"), least=5).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], set()).add(r["image"])
    assert sorted(map(sorted, groups.values())) == [[f"a{i}" for i in range(6)], [f"b{i}" for i in range(7)]]


def test_version_search_equals_a_loop(spark):
    """Scores in row order, thresholds by repeated addition, later thresholds winning ties."""
    rng = random.Random(4)
    rows = [(image, f"v{v}", v, v * 100 + n, 0, rng.choice("abcdefgh") + str(rng.randrange(3)), rng.randrange(1, 9)) for image in ("p", "q") for v in range(1, 11) for n in range(rng.randrange(3, 9))]
    sizes = {d: n for *_, d, n in rows}
    rows = [(*r[:-1], sizes[r[-2]]) for r in rows]
    got = dictionary.search_versions(spark.createDataFrame(rows, "image string, version string, ver bigint, ino bigint, idx bigint, digest string, size bigint")).collect()
    for image in ("p", "q"):
        mine = sorted(r[2:] for r in rows if r[0] == image)
        score, best, held = 0.0, {}, {}
        for v, _, _, d, _ in mine:
            held.setdefault(v, set()).add(d)
        for v, _, _, d, _ in mine:
            if v <= 7:
                score = 0.5 * (d in held.get(v - 1, ())) + 0.5 * score
                best[d] = max(best.get(d, 0.0), score if v > 1 else 0.0)
        test = {d for v, _, _, d, _ in mine if v > 7}
        costs = []
        for t in dictionary.radii(0.5, 0.05, 0.8):
            kept = {d for d, x in best.items() if x > t}
            costs.append((sum(sizes[d] for d in kept) + sum(sizes[d] for d in test - kept), -t))
        cost, t = min(costs)
        assert next((r["threshold"], r["bytes"]) for r in got if r["image"] == image) == (-t, cost)


def plain_distances(rows):
    """Distances of all pairs by counting each pair's chunks: bytes of a digest's chunks but its first repeat."""
    out, images = {}, sorted({r[0] for r in rows})
    for i, a in enumerate(images):
        for b in images[i + 1 :]:
            seen, repeated, whole = set(), 0, 0
            for digest, size in [(d, n) for image, d, n in rows if image in (a, b)]:
                whole += size
                repeated += size if digest in seen else 0
                seen.add(digest)
            out[a, b] = 1.0 - repeated / whole
    return out


def test_near_pairs_equal_all_pairs_cut_at_the_radius(spark):
    """Images that share chunks, images that repeat their own and share none, and both."""
    rng = random.Random(8)
    sizes = {f"d{i}": rng.randrange(1, 20) for i in range(60)}
    rows = []
    for i in range(24):
        own = [f"d{(i * 2 + j) % 60}" for j in range(rng.randrange(1, 7))]
        rows += [(f"i{i:02}", d, sizes[d]) for d in own for _ in range(rng.choice([1, 1, 2, 5]))]
    df, every = spark.createDataFrame(rows, "image string, digest string, size bigint"), plain_distances(rows)
    for radius in (0.05, 0.3, 0.5, 0.7, 0.9):
        got = {(a, b): d for a, b, d in dictionary.near_pairs(df, radius, dictionary._total_rows(df))}
        assert got == {pair: d for pair, d in every.items() if d <= radius}
    assert {(r["a"], r["b"]): r["distance"] for r in dictionary.distances(df).collect()} == every


def test_image_search_equals_a_loop(spark):
    """Rounds of clusters, votes and uncovered bytes, with plain distances; later radii win ties."""
    rng = random.Random(9)
    sizes, chunks = {}, set()
    for i in range(14):
        for v in range(1, 5):
            common = [f"{'ab'[i % 2]}{n}" for n in range(8) if rng.random() < 0.95]
            for d in [*common, *(f"x{rng.randrange(30)}" for _ in range(2))]:
                chunks.add((f"i{i:02}", f"v{v}", d, sizes.setdefault(d, rng.randrange(1, 9))))
    rows = sorted(chunks)
    got = dictionary.search_images(spark.createDataFrame(rows, "image string, version string, digest string, size bigint"), least=5).collect()
    train, test = [(i, d, n) for i, v, d, n in rows if v < "v3"], [(d, n) for _, v, d, n in rows if v >= "v3"]
    expected = []
    for number in range(1, 8):
        images = sorted({r[0] for r in train})
        near = [(a, b, d) for (a, b), d in plain_distances(train).items()]
        clusters, best, least_left, before = dictionary.Clusters(images, 5), set(), None, None
        for radius in dictionary.radii():
            labels = dict(clusters.grow(dictionary.neighbours(near, radius)))
            if labels == before:
                continue
            before, votes = labels, set()
            for c in set(labels.values()):
                members = {i for i, x in labels.items() if x == c}
                for d in {d for i, d, _ in train if i in members}:
                    if len({i for i, x, _ in train if x == d and i in members}) >= len(members) * 0.9:
                        votes.add((c, d))
            left = sum(n for d, n in test if d not in {x for _, x in votes})
            if least_left is None or left <= least_left:
                least_left, best = left, votes
        if not images or len(clusters.label) < 0.2 * len(images):
            break
        expected += [(number, c, d) for c, d in best]
        gone = {d for _, d in best}
        train, test = [r for r in train if r[1] not in gone], [r for r in test if r[0] not in gone]
    assert expected and sorted(tuple(r) for r in got) == sorted(expected)


def test_digests_of_large_directories_equal_those_of_small_ones(spark):
    rng = random.Random(10)
    names = ["/", "/a", "/a/b", "/a/c", "/d"]
    up = {"/": None, "/a": "/", "/a/b": "/a", "/a/c": "/a", "/d": "/"}
    rows = [(p, up[p], True, None) for p in names] + [(f"{p}/f{i}".replace("//", "/"), p, False, f"{rng.randrange(1 << 60):x}") for p in names for i in range(rng.choice([1, 3, 40]))]
    df = spark.createDataFrame(rows, "path string, parent string, is_dir boolean, digest string")
    held = {p: d for p, _, is_dir, d in rows if not is_dir}
    for name in sorted(names, key=lambda p: -p.count("/") - (p != "/")):
        below = sorted((p, held[p]) for p, parent, _, _ in rows if parent == name)
        held[name] = hashlib.sha256("".join(d for _, d in below).encode()).hexdigest()
    for most in (0, 3, 1000):
        got = {r["path"]: r["digest"] for r in trees.directory_digests(df, 2, most).collect()}
        assert got == {p: held[p] for p in names}
