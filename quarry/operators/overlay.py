"""Stacked layers as sets: whiteouts, merging, differences and comparison of trees.

A layer's entries are rows (layer, path, is_dir, ...). A whiteout ``.wh.name`` hides ``name`` of the
layers below, an opaque marker hides everything below its directory, and a file in the place of a
directory hides what was in it. Merging is two anti joins over explicit hiding rows and one
aggregation, for any number of layers at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, OPAQUE = ".wh.", ".wh..wh..opq"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def whiteout_type(name: Column, layer: Column, is_char_device: Column | None = None, opaque_xattr: Column | None = None) -> Column:
    """OciOpaque, OciRemoval, OverlayFsRemoval, OverlayFsOpaque or null. The lowest layer has no whiteouts."""
    device = F.lit(False) if is_char_device is None else is_char_device
    opaque = F.lit(False) if opaque_xattr is None else F.coalesce(opaque_xattr == "y", F.lit(False))
    kind = F.when(name == OPAQUE, "OciOpaque").when(name.startswith(PREFIX), "OciRemoval").when(device, "OverlayFsRemoval").when(opaque, "OverlayFsOpaque")
    return F.when(layer > 0, kind)


def origin_name(name: Column) -> Column:
    """The name that a removal hides."""
    return F.when(name.startswith(PREFIX) & (name != OPAQUE), F.substring(name, len(PREFIX) + 1, 1 << 20))


def ancestors(path: Column) -> Column:
    """Proper ancestors of a path, without the root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def hiding_rows(entries: DataFrame) -> DataFrame:
    """(path, layer, exact): what a layer hides below it; ``exact`` hides the path itself too, and every row what is under it."""
    name, up = base_name(F.col("path")), parent_of(F.col("path"))
    named = entries.select("path", "layer", "is_dir", whiteout_type(name, F.col("layer")).alias("kind"))
    hidden = (
        F.when(F.col("kind") == "OciRemoval", F.concat(up, F.lit("/"), origin_name(name)))
        .when(F.col("kind") == "OciOpaque", up)
        .when(F.col("kind").isNull() & ~F.col("is_dir"), F.col("path"))
    )
    rows = named.select(hidden.alias("path"), "layer", F.coalesce(F.col("kind") == "OciRemoval", F.lit(False)).alias("exact"))
    return rows.filter("path is not null")


def merge_layers(entries: DataFrame) -> DataFrame:
    """The entries that the stack of all layers shows, each of its highest layer. Markers never show."""
    hides = hiding_rows(entries).groupBy("path").agg(F.max(F.when(F.col("exact"), F.col("layer"))).alias("exact_layer"), F.max("layer").alias("under_layer"))
    marker = base_name(F.col("path")).startswith(PREFIX)
    top = entries.filter(~marker).groupBy("path").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "path"]), "layer").alias("x")).select("path", "x.*")
    own = top.join(hides.select("path", "exact_layer"), "path", "left").filter("exact_layer is null or exact_layer <= layer").drop("exact_layer")
    # One row for each entry and ancestor; the deepest layer that hides an ancestor decides.
    spread = own.select("path", "layer", F.explode(ancestors(F.col("path"))).alias("above"))
    under = hides.select(F.col("path").alias("above"), "under_layer")
    dead = spread.join(under, "above").filter("under_layer > layer").select("path").distinct()
    return own.join(dead, "path", "left_anti")


def layer_diff(lower: DataFrame, upper: DataFrame, by: list[str]) -> DataFrame:
    """(path, change): entries that are added, modified (any of ``by`` differs, null-safely) or deleted."""
    a = lower.select("path", F.lit(True).alias("__a"), F.struct(*by).alias("__x"))
    b = upper.select("path", F.lit(True).alias("__b"), F.struct(*by).alias("__y"))
    joined = a.join(b, "path", "full_outer")
    change = F.when(F.col("__a").isNull(), "Add").when(F.col("__b").isNull(), "Delete").when(~F.col("__x").eqNullSafe(F.col("__y")), "Modify")
    return joined.select("path", change.alias("change")).filter("change is not null")


def overlay_states(entries: DataFrame) -> DataFrame:
    """``state`` of each entry: Lower in the lowest layer, then UpperAddition, or UpperModification where a lower layer has the path."""
    first = entries.groupBy("path").agg(F.min("layer").alias("__first"))
    state = F.when(F.col("layer") == 0, "Lower").when(F.col("__first") < F.col("layer"), "UpperModification").otherwise("UpperAddition")
    return entries.join(first, "path").withColumn("state", state).drop("__first")


def should_dump(state: Column) -> Column:
    return state.isin("UpperAddition", "UpperModification")


def compare_trees(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """(path, verdict): missing, extra or the first attribute that differs; equal paths are left out."""
    a = source.select("path", F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in by])
    b = target.select("path", F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in by])
    verdict = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra")
    for c in by:
        verdict = verdict.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), c)
    return a.join(b, "path", "full_outer").select("path", verdict.alias("verdict")).filter("verdict is not null")


def merge_records(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Field by field the new record's value, or the old one's where that is null."""
    fields = [c for c in old.columns if c != key]
    a = old.select(key, *[F.col(c).alias(f"__old_{c}") for c in fields])
    return a.join(new, key, "full_outer").select(key, *[F.coalesce(F.col(c), F.col(f"__old_{c}")).alias(c) for c in fields])


def keep_recent(old: DataFrame, new: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """New records first, then old ones that aren't repeated, ``most`` in all; ``place`` from 0."""
    a = new.select(key, F.lit(0).alias("__age"), F.col(order).alias("__order"))
    b = old.join(new.select(key), key, "left_anti").select(key, F.lit(1).alias("__age"), F.col(order).alias("__order"))
    kept = a.unionByName(b).orderBy("__age", "__order", key).limit(most)
    rows = kept.groupBy(F.lit(1)).agg(F.array_sort(F.collect_list(F.struct("__age", "__order", key))).alias("x"))  # at most ``most``
    return rows.select(F.posexplode("x").alias("place", "r")).select(F.col("place").cast("bigint").alias("place"), f"r.{key}")


def committed(changes: DataFrame) -> DataFrame:
    """(path, is_marker) of the layer that makes ``changes`` (path, change): added and modified paths, and a marker for each deleted one.

    A path below a deleted directory needs no marker of its own.
    """
    gone = changes.filter("change = 'Delete'").select("path")
    above = gone.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    covered = above.join(gone.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    top = gone.join(covered, "path", "left_anti")
    marker = F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/" + PREFIX), base_name(F.col("path")))
    stay = changes.filter("change <> 'Delete'").select("path", F.lit(False).alias("is_marker"))
    return stay.unionByName(top.select(marker.alias("path"), F.lit(True).alias("is_marker")))


def broken_rules(files: DataFrame, chunks: DataFrame, blobs: DataFrame, chunk_size: int) -> DataFrame:
    """(rule, ino): files whose chunks don't add up to their size or leave holes, and a row for each unsound chunk or unknown blob.

    ``files`` has ino and size, ``chunks`` ino, idx, image, size and digest, ``blobs`` the known images.
    """
    per = chunks.groupBy("ino").agg(F.sum("size").alias("held"), F.count("*").alias("n"), (F.max("idx") + 1).alias("last"))
    sizes = files.select("ino", "size").join(per, "ino", "left")
    unsound = (F.col("size") > chunk_size) | (F.col("size") <= 0) | (F.length("digest") != 64)
    broken = {
        "size": sizes.filter(F.coalesce("held", F.lit(0)) != F.col("size")),
        "holes": per.filter("n <> last"),
        "chunk": chunks.filter(unsound),
        "blob": chunks.join(blobs.select("image").distinct(), "image", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(rule).alias("rule"), "ino") for rule, rows in broken.items()])
