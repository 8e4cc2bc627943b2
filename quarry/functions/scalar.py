"""Scalar functions: digests, checksums, codecs, paths, flags."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType

#: Fixed value: the reflected Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def _step() -> np.ndarray:
    """The checksum's state after one byte, for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table


_CRC = _step()


def _shifted(levels: int = 40) -> np.ndarray:
    """Row j, column i: what bit i of a state becomes after 2**j bytes of zero."""
    rows = np.empty((levels, 32), dtype=np.uint32)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    rows[0] = (bits >> np.uint32(8)) ^ _CRC[bits & np.uint32(0xFF)]
    for j in range(1, levels):
        rows[j] = _advance(rows[j - 1], rows[j - 1])
    return rows


def _advance(row: np.ndarray, states: np.ndarray) -> np.ndarray:
    """States moved on by the zeros of a row of ``_shifted``."""
    out = np.zeros_like(states)
    for i in range(32):
        out ^= np.where((states >> np.uint32(i)) & np.uint32(1), row[i], np.uint32(0))
    return out


_ZEROS = _shifted()


def crc32c_of(data: bytes) -> int:
    """CRC-32C of bytes: the state is linear, so halves are joined pairwise, all pairs of a length at once."""
    size = len(data)
    states = _CRC[np.frombuffer(data, dtype=np.uint8)]
    begin = np.uint32(0xFFFFFFFF)
    for j in range(size.bit_length()):
        if (size >> j) & 1:
            begin = _advance(_ZEROS[j], np.array([begin], dtype=np.uint32))[0]
    level = 0
    while len(states) > 1:
        if len(states) % 2:
            states = np.concatenate([np.zeros(1, dtype=np.uint32), states])  # zeros in front leave a state as it is
        states = _advance(_ZEROS[level], states[::2]) ^ states[1::2]
        level += 1
    state = (states[0] if size else np.uint32(0)) ^ begin
    return int(state ^ np.uint32(0xFFFFFFFF))


@pandas_udf(LongType())
def crc32c(column: pd.Series) -> pd.Series:
    """CRC-32C of bytes; Spark's own checksum has another polynomial."""
    return column.map(lambda x: None if x is None else crc32c_of(bytes(x))).astype("Int64")


#: Codecs of chunks, by name; lz4 is the block format without a frame.
CODECS = ("none", "gzip", "zstd", "lz4")


def _pack(data: bytes, codec: str) -> bytes:
    if codec == "none":
        return data
    if codec == "gzip":
        small = zlib.compress(data, 6, wbits=31)
    else:
        small = pa.Codec({"zstd": "zstd", "lz4": "lz4_raw"}[codec]).compress(data, asbytes=True)
    return small if len(small) < len(data) else data


def _unpack(data: bytes, codec: str, size: int) -> bytes:
    if codec == "none" or len(data) == size:
        return data
    if codec == "gzip":
        return zlib.decompress(data, wbits=31)
    return pa.Codec({"zstd": "zstd", "lz4": "lz4_raw"}[codec]).decompress(data, decompressed_size=size, asbytes=True)


@pandas_udf(BinaryType())
def packed(data: pd.Series, codec: pd.Series) -> pd.Series:
    """Bytes compressed by a named codec, or as they are where that isn't smaller."""
    return pd.Series([None if x is None else _pack(bytes(x), c) for x, c in zip(data, codec)])


@pandas_udf(BinaryType())
def unpacked(data: pd.Series, codec: pd.Series, size: pd.Series) -> pd.Series:
    """The inverse, by the bytes' number before: as many bytes weren't compressed."""
    return pd.Series([None if x is None else _unpack(bytes(x), c, int(n)) for x, c, n in zip(data, codec, size)])


@pandas_udf(BinaryType())
def gzip_or_raw(column: pd.Series) -> pd.Series:
    """Bytes compressed, or as they are where that isn't smaller."""

    def one(data):
        if data is None:
            return None
        small = zlib.compress(bytes(data), 6, wbits=31)
        return small if len(small) < len(data) else bytes(data)

    return column.map(one)


@pandas_udf(BinaryType())
def gunzip_or_raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The inverse: compressed bytes begin with the gzip magic."""
    for column in batches:
        yield column.map(lambda x: None if x is None else zlib.decompress(bytes(x), wbits=31) if bytes(x[:2]) == b"\x1f\x8b" else bytes(x))


def encrypted(data: Column, key: Column) -> Column:
    """AES in GCM mode, with a key of 32 bytes."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def decrypted(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"))


def round_up(size: Column, block: int = 4096) -> Column:
    return (F.ceil(size / block) * block).cast("bigint")


def components(path: Column) -> Column:
    """Parts of a path, the root first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


def reparented(path: Column, root: str) -> Column:
    """The path from a root on; another path as it is."""
    inside = (path == root) | path.startswith(root.rstrip("/") + "/")
    rest = F.substring(path, len(root.rstrip("/")) + 1, 1 << 20)
    return F.when(inside, F.when(rest == "", "/").otherwise(rest)).otherwise(path)


def file_type(mode: Column) -> Column:
    """Name of a file's type by the type bits of its mode."""
    kind = mode.bitwiseAND(0o170000)
    return F.when(kind == 0o040000, "dir").when(kind == 0o100000, "file").when(kind == 0o120000, "symlink").otherwise("special")


def blob_id(path: Column) -> Column:
    """The 64 characters of a metadata file's name before its extension; null for others."""
    found = F.regexp_extract(path, r"([^/.]+)(?:\.[^/]*)?$", 1)
    return F.when(F.length(found) == 64, found)


def image_and_tag(directory: Column) -> tuple[Column, Column]:
    """The last two parts of a directory's name."""
    parts = F.split(directory, ":")
    return F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))


def query_part(url: Column, key: str) -> Column:
    """Value of a key of a URL's query."""
    found = F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)
    return F.when(found != "", found)


def has_flag(flags: Column, bit: int) -> Column:
    return F.getbit(flags, F.lit(bit)) == 1
