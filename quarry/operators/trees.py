"""Trees by parent pointers and paths: walks, lookups, counts and digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.overlay import ancestors, parent_of
from quarry.operators.prefix import CELL, running, text_cell
from quarry.session import cut


def with_directories(files: DataFrame) -> DataFrame:
    """(path, parent, is_dir, size): files and every directory above them; the root is ``/``."""
    up = F.explode(ancestors(F.col("path")))
    dirs = files.select(up.alias("path")).distinct()
    root = dirs.sparkSession.range(1).select(F.lit("/").alias("path"))
    kids = lambda df: F.when(F.col("path") == "/", F.lit(None).cast("string")).when(parent_of(F.col("path")) == "", "/").otherwise(parent_of(F.col("path")))
    all_dirs = dirs.unionByName(root).select("path", kids(dirs).alias("parent"), F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size"))
    return files.select("path", kids(files).alias("parent"), F.lit(False).alias("is_dir"), "size").unionByName(all_dirs)


def walk_key(path: Column) -> Column:
    """Sorts paths as a depth-first walk does that visits a directory before its children, in name order."""
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def depth(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1).cast("bigint")


def depth_first(nodes: DataFrame) -> DataFrame:
    """``order``: the place of each node in a depth-first walk, within its top directory, so walks run apart.

    Places are counted in cells of the name below the top directory, so a large one isn't one task's.
    """
    parts = F.split("path", "/")
    walked = nodes.withColumns({"top": F.element_at(parts, 2), "__key": walk_key(F.col("path"))})
    return running(walked, ["top"], text_cell(F.get(parts, F.lit(2))), ["__key"], {}, index="order").drop("__key")


def depth_last(nodes: DataFrame) -> DataFrame:
    """``order``: the place of each node (path, is_dir) in a walk that visits a directory after all below it, within its top directory."""
    after = F.when(F.col("is_dir"), F.array(F.lit("\U0010ffff"))).otherwise(F.array().cast("array<string>"))
    walked = nodes.withColumns({"top": F.element_at(F.split("path", "/"), 2), "__key": F.concat(walk_key(F.col("path")), after)})
    return running(walked, ["top"], text_cell(F.get("__key", F.lit(1))), ["__key"], {}, index="order").drop("__key")


def children(nodes: DataFrame, parent: str) -> DataFrame:
    """Children of a directory with their index in name order."""
    return child_index(nodes.filter(F.col("parent") == parent))


def child_index(nodes: DataFrame) -> DataFrame:
    """``index``: place of each node among its parent's children, in name order, counted in cells of their names."""
    name = F.element_at(F.split("path", "/"), -1)
    return running(nodes.filter("parent is not null"), ["parent"], text_cell(name), ["path"], {}, index="index")


def descendants(nodes: DataFrame, directory: str) -> DataFrame:
    """Files under a directory."""
    return nodes.filter(~F.col("is_dir") & F.col("path").startswith(directory.rstrip("/") + "/"))


def link_counts(nodes: DataFrame) -> DataFrame:
    """Per directory: children and links (2 and one for each child directory)."""
    per = nodes.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"), (F.count_if("is_dir") + 2).alias("nlink"))
    return nodes.filter("is_dir").select("path").join(per, "path", "left").select("path", F.coalesce("children", F.lit(0).cast("bigint")).alias("children"), F.coalesce("nlink", F.lit(2).cast("bigint")).alias("nlink"))


def paths_by_parent(nodes: DataFrame, key: str = "ino", parent: str = "parent_ino", name: str = "name") -> DataFrame:
    """(key, path) of each node from parent pointers, for trees of any size; the root's parent is null, and what hangs from no root is left out.

    Pointers double, so a tree of depth d takes log d joins, each checkpointed.
    """
    root = F.col(parent).isNull()
    state = cut(nodes.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.when(root, "").otherwise(F.concat(F.lit("/"), F.col(name))).alias("path")))
    while True:
        waiting = state.filter("up is not null")
        if waiting.isEmpty():
            break
        above = state.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        moved = waiting.join(above, "up").select("k", F.col("up2").alias("up"), F.concat("path2", "path").alias("path"))
        state = cut(state.filter("up is null").unionByName(moved))
    return state.select(F.col("k").alias(key), F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"))


def _joined_digest(order: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), ""), 256)


#: Children of a directory that are gathered in one row to be hashed, at most; those of a larger one are hashed as they come, in order.
MOST_CHILDREN = 1 << 17


def _streamed_digest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, digest): as ``_joined_digest`` by a key that is never null, holding one batch of rows at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, hashlib.sha256()
        for frame in frames:
            done = []
            for name, digest in zip(frame[key], frame["digest"]):
                if name != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = name, hashlib.sha256()
                state.update(digest.encode())
            yield pd.DataFrame(done, columns=[key, "digest"])
        if now is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=[key, "digest"])

    ordered = rows.select(key, order, F.coalesce("digest", F.lit("")).alias("digest")).repartition(key).sortWithinPartitions(key, order)
    return ordered.select(key, "digest").mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, digest string")


def directory_digests(nodes: DataFrame, levels: int, most_children: int = MOST_CHILDREN) -> DataFrame:
    """(path, digest) of directories: the hash of their children's digests in name order, level by level from the deepest.

    ``nodes`` has path, parent, is_dir, digest (of files). A level needs the files and directories
    right below its own, and is checkpointed. A directory's children are gathered where they are
    ``most_children`` or fewer; the hash of a larger one is a fold that one task makes, a batch at a time.
    """
    large = cut(nodes.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n")).filter(F.col("n") > most_children).select("path"))
    any_large = not large.isEmpty()
    files = nodes.filter("not is_dir").select("path", "parent", "digest")
    dirs = cut(nodes.filter("is_dir").select("path", "parent", depth(F.col("path")).alias("depth")))
    out, below = [], None
    for level in range(levels, -1, -1):
        mine = dirs.filter(F.col("depth") == level).select("path", F.col("parent").alias("__up"))
        held = files if below is None else files.unionByName(below)
        made = mine.join(held.select(F.col("path").alias("__child"), F.col("parent").alias("path"), "digest"), "path")
        few = made.join(large, "path", "left_anti") if any_large else made
        digests = few.groupBy("path", "__up").agg(_joined_digest("__child").alias("digest"))
        if any_large:
            digests = digests.unionByName(_streamed_digest(made.join(large, "path", "left_semi"), "path", "__child").join(mine, "path").select("path", "__up", "digest"))
        below = cut(digests.select("path", F.col("__up").alias("parent"), "digest"))
        out.append(below.select("path", "digest"))
    return reduce(DataFrame.unionByName, out)


def merkle_levels(data_pages: int, fanout: int = 128) -> list[int]:
    """Pages of each level of a hash tree over ``data_pages`` pages, lowest first."""
    out, n = [], data_pages
    while n > 1:
        n = -(-n // fanout)
        out.append(n)
    return out or [1]


def merkle_levels_of(pages: Column, fanout: int = 128, most_levels: int = 9) -> Column:
    """As ``merkle_levels``, of a column of longs: nine levels of 128 hold any."""
    sizes, n = [], pages
    for _ in range(most_levels):
        n = F.call_function("div", n - 1, F.lit(fanout).cast("bigint")) + 1
        sizes.append(n)
    needed = F.array_position(F.array(*sizes), F.lit(1).cast("bigint"))
    return F.slice(F.array(*sizes), F.lit(1), needed.cast("int"))


def merkle_roots(pages: DataFrame, key: str, fanout: int = 128, most_pages: int | None = None) -> DataFrame:
    """(key, root): the root of a hash tree over the page digests (key, page, digest) of each blob."""
    if most_pages is None:
        most_pages = pages.agg(F.max("page") + 1).first()[0] or 0
    now = pages.select(key, "page", "digest")
    for _ in merkle_levels(most_pages, fanout):
        now = now.groupBy(key, F.floor(F.col("page") / fanout).alias("up")).agg(_joined_digest("page").alias("digest")).select(key, F.col("up").alias("page"), "digest")
    return now.select(key, F.col("digest").alias("root"))


def numbered_inodes(nodes: DataFrame, link: list[str], order: list[str]) -> DataFrame:
    """``number``: inode numbers in order, hard links (equal ``link``) sharing their first's. ``order`` begins with a number."""
    first = nodes.groupBy(*link).agg(F.min(F.struct(*order)).alias("__first"))
    ranked = running(first, [link[0]], F.floor(F.col(f"__first.{order[0]}") / CELL), ["__first"], {}, index="number")
    ranked = ranked.withColumn("number", F.col("number") + 1)
    return nodes.join(ranked.drop("__first"), link)


def longest_prefix(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, pattern): the longest pattern that is the path or an ancestor; paths with none are left out."""
    spread = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"), F.array(F.lit("/")))).alias("pattern"))
    return spread.join(patterns.select("pattern").distinct(), "pattern").groupBy("path").agg(F.max_by("pattern", F.length("pattern")).alias("pattern"))


def uncovered_patterns(patterns: DataFrame) -> DataFrame:
    """Absolute patterns (place, pattern) that no earlier one covers."""
    absolute = patterns.filter(F.col("pattern").startswith("/"))
    up = absolute.select("place", "pattern", F.explode(F.concat(ancestors(F.col("pattern")), F.array("pattern"))).alias("above"))
    first = absolute.groupBy(F.col("pattern").alias("above")).agg(F.min("place").alias("first"))
    covered = up.join(first, "above").filter("first < place").select("place").distinct()
    return absolute.join(covered, "place", "left_anti")
