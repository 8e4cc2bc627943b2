import gzip
import io
import os
import tarfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.sources import backends, datasource, formats, sinks


def make_tar(path, compressed=False):
    with tarfile.open(path, "w:gz" if compressed else "w", format=tarfile.PAX_FORMAT) as tar:
        for name, body in (("./a/x", b"one"), ("a/y", b""), ("stargz.index.json", b"{}")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            info.pax_headers = {"SCHILY.xattr.user.k": "v"}
            tar.addfile(info, io.BytesIO(body))
        for name, kind, link in (("a", tarfile.DIRTYPE, ""), ("l", tarfile.SYMTYPE, "a/x"), ("h", tarfile.LNKTYPE, "a/x")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, link
            tar.addfile(info)


def test_tar_and_tar_gz_entries(spark, tmp_path):
    make_tar(tmp_path / "one.tar")
    make_tar(tmp_path / "two.tar.gz", compressed=True)
    rows = formats.scan_tar(backends.read_blobs(spark, str(tmp_path))).collect()
    assert len(rows) == 10
    one = {r["path"]: r for r in rows if r["archive"].endswith("one.tar")}
    assert set(one) == {"/a/x", "/a/y", "/a", "/l", "/h"}
    assert bytes(one["/a/x"]["content"]) == b"one" and one["/a/x"]["xattrs"] == {"user.k": "v"}
    assert [one[p]["type"] for p in ("/a", "/l", "/h")] == ["dir", "symlink", "hardlink"] and one["/l"]["link"] == "a/x"
    datasource.register(spark)
    listed = spark.read.format("quarry_tar").option("paths", str(tmp_path / "one.tar")).load()
    assert listed.count() == 6 and listed.filter("path = '/a/x'").first()["size"] == 3


def test_directory_scan_leaves_whiteouts_out(spark, tmp_path):
    os.makedirs(tmp_path / "root/d e")
    for name, body in (("root/f", "1"), ("root/d e/g.txt", "22"), ("root/.wh.gone", "")):
        (tmp_path / name).write_text(body)
    rows = {r["path"]: r for r in formats.scan_directory(spark, str(tmp_path / "root")).collect()}
    assert set(rows) == {"/f"} | {p for p in rows if p.endswith("g.txt")} and len(rows) == 2
    assert rows["/f"]["size"] == 1 and rows["/f"]["name"] == "f"


def test_compression_is_sniffed(spark):
    df = spark.createDataFrame([(gzip.compress(b"x"),), (b"plain",), (b"",)], "b binary")
    assert [r[0] for r in df.select(formats.sniff_compression(F.col("b"))).collect()] == ["gzip", "none", "none"]


def test_tables_of_contents_are_checked(spark):
    make = lambda *x: spark.createDataFrame([(v,) for v in x], "t string")
    good = formats.toc_entries(make('{"version":1,"entries":[{"name":"a","type":"reg","size":3},{"name":"b"}]}'), "t").select("entry.name", "entry.size").collect()
    assert [tuple(r) for r in good] == [("a", 3), ("b", None)]
    for bad in ('{"version":2,"entries":[{"name":"a"}]}', '{"version":1,"entries":[]}', "{}"):
        with pytest.raises(PySparkException):
            formats.toc_entries(make(bad), "t").collect()


def test_attribute_and_prefetch_files(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("  a/b  type=external crcs=0x1f,FF",), ("/c x=1=2",)], "value string")
    rows = {r["path"]: r for r in formats.parse_attributes(lines).collect()}
    assert rows["/a/b"]["crcs"] == [31, 255] and rows["/a/b"]["attributes"]["type"] == "external"
    assert rows["/c"]["attributes"] == {"x": "1=2"} and rows["/c"]["crcs"] is None
    text = '{"version":"v1","files":[{"path":"/a","ranges":[[0,5],[9,1]]},{"path":"rel","ranges":[[1,1]]},{"path":"/b"}]}'
    got = formats.prefetch_ranges(spark.createDataFrame([(text,)], "j string"), "j").collect()
    assert [tuple(r) for r in got] == [("/a", 0, 5), ("/a", 9, 1), ("/b", None, None)]
    with pytest.raises(PySparkException):
        formats.prefetch_ranges(spark.createDataFrame([('{"version":"v2","files":[]}',)], "j string"), "j").collect()


def test_backends_and_ranged_reads(spark):
    assert backends.backend_uri("s3", "bucket/p", "id") == "s3a://bucket/p/id"
    with pytest.raises(ValueError):
        backends.backend_uri("tape", "x")
    df = spark.createDataFrame([(b"abcdef",)], "b binary")
    row = df.select(backends.ranged(F.col("b"), F.lit(2), F.lit(3)).alias("x"), backends.ranged(F.col("b"), F.lit(4), F.lit(3)).alias("y")).first()
    assert bytes(row["x"]) == b"cde" and row["y"] is None


def test_sinks_keep_rows_and_order(spark, tmp_path):
    files = spark.range(100).select(F.col("id").alias("rank"), (F.col("id") * 3).alias("size"))
    sinks.write_in_dump_order(files, str(tmp_path / "out"), "rank", 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and sorted(r["rank"] for r in back.collect()) == list(range(100))
    names = sinks.content_name(spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", "3")], "g string, d string"), ["g"], "d")
    by = {r["g"]: r["name"] for r in names.collect()}
    assert by["a"] == by["b"] != by["c"]
