"""Readers of directory trees, tar archives, tables of contents, attribute and prefetch files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names in an archive that describe it and are no entries of the tree.
SPECIAL_NAMES = ("stargz.index.json", ".prefetch.landmark", ".no.prefetch.landmark")
TOC_SCHEMA = "version int, entries array<struct<name:string,type:string,size:bigint,linkName:string,mode:int,uid:int,gid:int,offset:bigint,digest:string,chunkOffset:bigint,chunkSize:bigint,chunkDigest:string>>"
PREFETCH_SCHEMA = "version string, files array<struct<path:string,ranges:array<array<bigint>>>>"


def sniff_compression(head: Column) -> Column:
    """gzip by its magic bytes, or none."""
    return F.when(F.hex(F.substring(head, 1, 2)) == "1F8B", "gzip").otherwise("none")


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, parent, name, size, mtime, digest) of the files under a directory, paths from the root; whiteouts of a lowest layer are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.regexp_extract("path", f"^[a-z0-9+]*:?/*{_quoted(base.lstrip('/'))}(/.*)$", 1)
    out = files.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.sha2("content", 256).alias("digest"))
    out = out.withColumns({"parent": F.regexp_replace("path", "/[^/]*$", ""), "name": F.element_at(F.split("path", "/"), -1)})
    return out.filter(~F.col("name").startswith(".wh."))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in text)


def scan_tar(archives: DataFrame) -> DataFrame:
    """Entries of tar or tar.gz archives (path, content): archive, path, type, mode, uid, gid, size, mtime, link, xattrs, content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {tarfile.REGTYPE: "reg", tarfile.AREGTYPE: "reg", tarfile.DIRTYPE: "dir", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink", tarfile.CHRTYPE: "char", tarfile.BLKTYPE: "block", tarfile.FIFOTYPE: "fifo"}
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"]):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        name = "/" + m.name.removeprefix("./").strip("/")
                        if name[1:] in SPECIAL_NAMES:
                            continue
                        attributes = {k.removeprefix("SCHILY.xattr."): v for k, v in m.pax_headers.items() if k.startswith("SCHILY.xattr.")}
                        body = tar.extractfile(m).read() if m.isreg() else None
                        row = [archive, name, kinds.get(m.type, "other"), m.mode, m.uid, m.gid, m.size, int(m.mtime), m.linkname or None, attributes, body]
                        yield pd.DataFrame([row], columns=["archive", "path", "type", "mode", "uid", "gid", "size", "mtime", "link", "xattrs", "content"])

    fields = "archive string, path string, type string, mode int, uid int, gid int, size bigint, mtime bigint, link string, xattrs map<string,string>, content binary"
    return archives.select("path", "content").mapInPandas(run, fields)


def toc_entries(documents: DataFrame, column: str) -> DataFrame:
    """Entries of tables of contents in JSON; another version than 1 and an empty table are errors."""
    parsed = documents.withColumn("__toc", F.from_json(column, TOC_SCHEMA))
    bad = F.when(F.coalesce(F.col("__toc.version"), F.lit(-1)) != 1, F.raise_error(F.lit("unsupported table of contents"))).when(
        F.coalesce(F.size("__toc.entries"), F.lit(0)) < 1, F.raise_error(F.lit("empty table of contents"))
    )
    checked = parsed.withColumn("__entries", F.coalesce(bad.cast(parsed.select("__toc.entries").schema[0].dataType), F.col("__toc.entries")))
    return checked.withColumn("entry", F.explode("__entries")).drop("__toc", "__entries")


def parse_attributes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, attributes, crcs) of ``path key=value ...`` lines; comments and empty lines are left out, checksums in hex become numbers."""
    line = F.trim(F.col(column))
    rows = lines.filter((line != "") & ~line.startswith("#"))
    words = F.split(line, r"\s+")
    pairs = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.contains(w, F.lit("=")))
    attributes = F.map_from_entries(F.transform(pairs, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_replace(w, "^[^=]*=", "").alias("v"))))
    crcs = F.transform(F.split(F.try_element_at(attributes, F.lit("crcs")), ","), lambda x: F.conv(F.regexp_replace(x, "^0[xX]", ""), 16, 10).cast("bigint"))
    path = F.when(words[0].startswith("/"), words[0]).otherwise(F.concat(F.lit("/"), words[0]))
    return rows.select(path.alias("path"), attributes.alias("attributes"), crcs.alias("crcs"))


def is_external(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern equals a path, or begins it where the pattern ends in a slash."""
    out = F.lit(False)
    for p in patterns:
        out = out | (path.startswith(p) if p.endswith("/") else path == p)
    return out


def prefetch_ranges(documents: DataFrame, column: str) -> DataFrame:
    """(path, offset, size) of prefetch lists in JSON; another version than v1 is an error, relative paths are left out, files without ranges have nulls."""
    parsed = documents.select(F.from_json(column, PREFETCH_SCHEMA).alias("p"))
    version = F.when(F.coalesce(F.col("p.version"), F.lit("")) != "v1", F.raise_error(F.lit("unsupported prefetch list")))
    files = parsed.withColumn("f", F.explode(F.coalesce(version.cast(parsed.select("p.files").schema[0].dataType), F.col("p.files"))))
    ranges = files.select(F.col("f.path").alias("path"), F.explode_outer("f.ranges").alias("r")).filter(F.col("path").startswith("/"))
    return ranges.select("path", F.col("r")[0].alias("offset"), F.col("r")[1].alias("size"))
