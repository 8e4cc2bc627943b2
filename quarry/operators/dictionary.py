"""Chunk dictionaries from image histories: distances, clusters, smoothing and search."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.prefix import CELL, running


def natural_key(version: Column) -> Column:
    """The digit runs of a version, as numbers: sorts v1.10 after v1.9."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def image_bytes(chunks: DataFrame) -> DataFrame:
    """(image, digest, uses, bytes): how often and with how many bytes each image has a digest."""
    return chunks.groupBy("image", "digest").agg(F.count("*").alias("uses"), F.sum("size").alias("bytes"), F.max("size").alias("size"))


def _pair_parts(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals of images named a, the same named b, bytes of one copy of each digest that both of a pair have)."""
    per = image_bytes(chunks)
    totals = per.groupBy("image").agg(F.sum("bytes").alias("total"), F.sum(F.col("bytes") - F.col("size")).alias("repeat"))
    a, b = per.select("digest", F.col("image").alias("a"), "size"), per.select("digest", F.col("image").alias("b"))
    both = a.join(b, "digest").filter("a < b").groupBy("a", "b").agg(F.sum("size").alias("shared"))
    one = lambda n: totals.select(F.col("image").alias(n), F.col("total").alias(f"t{n}"), F.col("repeat").alias(f"r{n}"))
    return one("a"), one("b"), both


def _distance() -> Column:
    """1 less the share of bytes that repeat in a pair's chunks: those of either image alone and one copy of each digest both have."""
    repeated = F.col("ra") + F.col("rb") + F.coalesce("shared", F.lit(0))
    return (F.lit(1.0) - repeated / (F.col("ta") + F.col("tb"))).alias("distance")


def distances(chunks: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of images, which is the result asked for; ``near_pairs`` makes none but near ones.

    Only digests that two images share are paired; images with none follow from their totals.
    """
    a, b, both = _pair_parts(chunks)
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", _distance())


def shared_distances(chunks: DataFrame) -> DataFrame:
    """(a, b, distance) of the pairs of images that share a digest."""
    a, b, both = _pair_parts(chunks)
    return both.join(a, "a").join(b, "b").select("a", "b", _distance())


def neighbours(near: list[tuple[str, str, float]], radius: float) -> dict[str, list[str]]:
    """Images within the radius of each, itself included."""
    out: dict[str, set[str]] = {}
    for a, b, d in near:
        out.setdefault(a, {a}), out.setdefault(b, {b})
        if d <= radius:
            out[a].add(b), out[b].add(a)
    return {a: sorted(x) for a, x in sorted(out.items())}


class Clusters:
    """Density clusters of images over growing radii. What a radius visits or labels stays so; each radius numbers its clusters from 1."""

    def __init__(self, images: list[str], least: int = 10) -> None:
        self.images, self.least = sorted(images), least
        self.visited: set[str] = set()
        self.label: dict[str, int] = {}

    def _around(self, near: dict[str, list[str]], image: str) -> list[str]:
        return [x for x in near.get(image, [image]) if x not in self.visited]

    def grow(self, near: dict[str, list[str]]) -> dict[str, int]:
        """Cluster the images that have no label yet, in order of name; an image counts itself until it is visited."""
        numbers = itertools.count(1)
        for seed in self.images:
            if seed in self.label or len(self._around(near, seed)) < self.least:
                continue
            number = self.label[seed] = next(numbers)
            open_ends = [seed]
            while open_ends:
                image = open_ends.pop()
                if image not in self.visited:
                    self.visited.add(image)
                    around = self._around(near, image)
                    if len(around) >= self.least:
                        open_ends += around
                        for other in around:
                            self.label.setdefault(other, number)
        return self.label


def radii(low: float = 0.5, step: float = 0.05, high: float = 0.9) -> list[float]:
    """Steps by repeated addition, as floats."""
    out = []
    while low <= high:
        out.append(low)
        low += step
    return out


#: Most images, and pairs of near ones (about 150 bytes each), that the driver clusters.
MOST_IMAGES, MOST_PAIRS = 20_000, 5_000_000


def _total_rows(chunks: DataFrame) -> list[tuple[str, int, int]]:
    """(image, bytes, repeated bytes) of each image, in order of name; more than the driver holds are an error."""
    per = image_bytes(chunks).groupBy("image").agg(F.sum("bytes").alias("total"), F.sum(F.col("bytes") - F.col("size")).alias("repeat"))
    rows = [(r["image"], r["total"], r["repeat"]) for r in per.limit(MOST_IMAGES + 1).collect()]
    if len(rows) > MOST_IMAGES:
        raise ValueError(f"more than {MOST_IMAGES} images: cluster groups of them apart")
    return sorted(rows)


def _apart(rows: list[tuple[str, int, int]], radius: float) -> Iterator[tuple[str, str, float]]:
    """(a, b, distance) of the pairs of images that are near by what repeats inside each, whatever they share.

    A pair is near where the two images' repeated bytes, less what the radius asks of their totals, sum
    to no less than nothing: each image meets an end of the list that is sorted by this surplus, so
    only near pairs are visited, up to rounding, which the distance itself settles.
    """
    ranked = sorted((repeat - (1.0 - radius) * total, image, total, repeat) for image, total, repeat in rows)
    surpluses = [x[0] for x in ranked]
    for i, (surplus, image, total, repeat) in enumerate(ranked):
        for _, other, t, r in ranked[max(i + 1, bisect.bisect_left(surpluses, -surplus - 1e-9 * total - 1.0)) :]:
            distance = 1.0 - (repeat + r) / (total + t)
            if distance <= radius:
                yield min(image, other), max(image, other), distance


def near_pairs(chunks: DataFrame, radius: float, totals: list[tuple[str, int, int]]) -> list[tuple[str, str, float]]:
    """Pairs of images within a radius; more than the driver holds are an error.

    Pairs that share a digest are found by joining digests; shared bytes only bring a pair nearer, so
    all others that are near follow from the images' totals.
    """
    rows = shared_distances(chunks).filter(F.col("distance") <= radius).limit(MOST_PAIRS + 1).collect()
    near = {(r["a"], r["b"]): r["distance"] for r in rows}
    for a, b, distance in _apart(totals, radius):
        if len(near) > MOST_PAIRS:
            break
        near.setdefault((a, b), distance)
    if len(near) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of near images: cluster groups of them apart")
    return [(a, b, d) for (a, b), d in near.items()]


def cluster_images(chunks: DataFrame, least: int = 10, radius_list: list[float] | None = None) -> DataFrame:
    """(image, cluster): density clusters; images of none are left out. The driver holds a row a pair of near images."""
    spark = chunks.sparkSession
    totals = _total_rows(chunks)
    steps = radii() if radius_list is None else radius_list
    near = near_pairs(chunks, max(steps), totals)
    clusters = Clusters([image for image, _, _ in totals], least)
    for radius in steps:
        clusters.grow(neighbours(near, radius))
    return spark.createDataFrame(sorted(clusters.label.items()), "image string, cluster bigint")


def cluster_votes(chunks: DataFrame, clusters: DataFrame, share: float = 0.9) -> DataFrame:
    """(cluster, digest): digests that a share of a cluster's images or more have."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    held = chunks.select("image", "digest").distinct().join(clusters, "image").groupBy("cluster", "digest").agg(F.count("*").alias("images"))
    return held.join(size, "cluster").filter(F.col("images") >= F.col("n") * share).select("cluster", "digest", "images")


def noise(chunks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Images of no cluster."""
    return chunks.select("image").distinct().join(clusters.select("image"), "image", "left_anti")


def split_versions(chunks: DataFrame, share: float = 0.7) -> DataFrame:
    """``part``: train for the first floor(share * n) versions of an image in natural order, test for the others."""
    versions = chunks.select("image", "version").distinct()
    w = W.partitionBy("image")
    ranked = versions.withColumns({"nth": F.row_number().over(w.orderBy(natural_key(F.col("version")), "version")), "n": F.count("*").over(w)})
    part = F.when(F.col("nth") <= F.floor(F.col("n") * share), "train").otherwise("test")
    return chunks.join(ranked.select("image", "version", part.alias("part")), ["image", "version"])


def smoothed(rows: DataFrame, alpha: float = 0.5, cell: Column | None = None, width: int = CELL) -> DataFrame:
    """``score`` of each row (image, ver, pos, digest): exponential smoothing, in row order, of whether its digest is in the version before.

    Rows of an image's first version have score 0. A weight shrinks by 1 - alpha with each row, so from
    some row back on all together are below the precision of a double and the sum over a window is the recurrence.
    An image's rows are numbered in cells (by version, and ``cell``, which doesn't fall in ``pos``), and
    ``width`` rows meet in a window with as many before them as weigh anything.
    """
    span = 0 if alpha == 1 else math.ceil(-52 * math.log(2) / math.log(1 - alpha))
    vers = rows.select("image", "ver").distinct()
    before = vers.withColumn("prev", F.lag("ver").over(W.partitionBy("image").orderBy("ver")))
    held = rows.select("image", F.col("ver").alias("prev"), "digest").distinct().withColumn("__held", F.lit(1.0))
    marked = rows.join(before, ["image", "ver"]).join(held, ["image", "prev", "digest"], "left")
    seen = marked.withColumn("__dup", F.when(F.col("prev").isNull(), 0.0).otherwise(F.coalesce("__held", F.lit(0.0)))).drop("__held")
    numbered = running(seen, ["image"], F.struct("ver", F.lit(0) if cell is None else cell), ["ver", "pos"], {}, index="__nth")
    own = F.floor(F.col("__nth") / width)
    # The last rows of a block are also sent to the blocks whose windows begin before them.
    reached = numbered.withColumn("__block", F.explode(F.sequence(own, F.floor((F.col("__nth") + span) / width))))
    w = W.partitionBy("image", "__block").orderBy("__nth").rowsBetween(-span, 0)
    recent = F.reverse(F.collect_list("__dup").over(w))
    score = F.aggregate(F.transform(recent, lambda x, i: x * alpha * F.pow(F.lit(1 - alpha), i)), F.lit(0.0), lambda a, x: a + x)
    scored = reached.withColumn("score", F.when(F.col("prev").isNull(), 0.0).otherwise(score)).filter(F.col("__block") == own)
    return scored.drop("prev", "__dup", "__nth", "__block")


def completed(dictionary: DataFrame, chunks: DataFrame) -> DataFrame:
    """The dictionary with every chunk of each blob that it touches, each once."""
    touched = chunks.join(dictionary.select("image").distinct(), "image", "left_semi").select("image", "digest", "size")
    return dictionary.select("image", "digest", "size").unionByName(touched).distinct()


def search_versions(chunks: DataFrame, low: float = 0.5, step: float = 0.05, high: float = 0.8) -> DataFrame:
    """(image, threshold, bytes): the smoothing threshold whose dictionary leaves fewest bytes for the test versions; later ones win ties."""
    split = split_versions(chunks)
    scored = smoothed(split.filter("part = 'train'").withColumn("pos", F.struct("ino", "idx")), cell=F.floor(F.col("ino") / CELL))
    grid = F.array(*[F.lit(t) for t in radii(low, step, high)])
    best = scored.groupBy("image", "digest").agg(F.max("score").alias("score"), F.max("size").alias("size"))
    test = split.filter("part = 'test'").groupBy("image", "digest").agg(F.max("size").alias("need"))
    joined = best.join(test, ["image", "digest"], "full_outer").withColumn("threshold", F.explode(grid))
    inside = F.col("score") > F.col("threshold")
    cost = F.sum(F.when(inside, F.col("size")).otherwise(F.coalesce("need", F.lit(0))))
    costs = joined.groupBy("image", "threshold").agg(cost.alias("bytes"))
    return costs.groupBy("image").agg(F.min_by(F.struct("threshold", "bytes"), F.struct("bytes", -F.col("threshold"))).alias("x")).select("image", "x.*")


def search_images(chunks: DataFrame, least: int = 10, rounds: int = 7, enough: float = 0.2) -> DataFrame:
    """(round, cluster, digest): dictionaries of clusters of images, one set a round.

    A round clusters the training versions at growing radii and keeps the votes that leave fewest
    bytes of the test versions uncovered, later radii winning ties; their digests leave both sets.
    Rounds end when fewer than a share of the images are in clusters.
    """
    from quarry.session import cut

    split = cut(split_versions(chunks).select("image", "digest", "size", "part"))
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    steps, kept = radii(), []
    for number in range(1, rounds + 1):
        totals = _total_rows(train)
        if not totals:
            break
        images = [image for image, _, _ in totals]
        near = near_pairs(train, max(steps), totals)
        clusters, best, least_left, before = Clusters(images, least), None, None, None
        for radius in steps:
            labels = dict(clusters.grow(neighbours(near, radius)))
            if labels != before:
                before = labels
                rows = train.sparkSession.createDataFrame(sorted(labels.items()), "image string, cluster bigint")
                votes = cluster_votes(train, rows).select("cluster", "digest")
                left = test.join(votes.select("digest").distinct(), "digest", "left_anti").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
                if least_left is None or left <= least_left:
                    least_left, best = left, votes
        best = cut(best)
        if len(clusters.label) < enough * len(images):
            break
        kept.append(best.select(F.lit(number).cast("bigint").alias("round"), "cluster", "digest"))
        gone = best.select("digest").distinct()
        train, test = cut(train.join(gone, "digest", "left_anti")), cut(test.join(gone, "digest", "left_anti"))
    out = chunks.sparkSession.createDataFrame([], "round bigint, cluster bigint, digest string")
    for rows in kept:
        out = out.unionByName(rows)
    return out
