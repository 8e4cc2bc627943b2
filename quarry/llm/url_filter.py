"""URL filter by a Bloom filter cascade: exact membership of listed hosts over the corpus's own keys, without joins.

The key universe is every host of the corpus and its parent domains. Level 1 encodes the listed
keys; level 2 the keys that aren't listed but pass level 1; level 3 the listed keys that pass
level 2; and so on until nothing passes wrongly. The first level that a key of the universe fails
then tells exactly whether it is listed. Levels are bit arrays of a checked size: keys are dealt to
as many cascades, by hash, as keep each below ``MAX_BITS``, and a task that has more than one tests
``HELD_KEYS`` of its keys against one cascade after the other and lets go of each. URLs are judged
where they lie; only distinct keys are shuffled.

A rule table decides first: the longest rule that fits by host and path prefix wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed; a URL of any length is read whole; rules that fit equally long are judged by the later of the
table; repeated rows are judged alike; an empty list blocks nothing; other columns aren't read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import cut
from quarry.llm.textvec import mix

#: (host, path, verdict) of the production rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hosts of the production list; each stands for its subdomains too.
BLOCKED = tuple(f"{name}.example.{top}" for name in ("casino-win", "cheap-pills", "spam-farm") for top in ("com", "net", "org"))
#: Bits of a level, at most (32 MB).
MAX_BITS = 1 << 28
#: Keys that a task holds (20 MB) while it goes through several cascades.
HELD_KEYS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text of the longest rule that fits, like ``net/``, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_keys(host: Column, most_labels: int) -> Column:
    """The host and its parents of up to ``most_labels`` labels: none longer is listed."""
    labels = F.size(F.split(host, r"\.", -1))
    some = F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(max(1, most_labels)))), lambda n: _tail(host, n))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(some)


def _tail(host: Column, n: Column) -> Column:
    parts = F.split(host, r"\.", -1)
    return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")


def hashes(key: Column) -> list[Column]:
    """128 bits of a key."""
    return [F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))]


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, k: int) -> np.ndarray:
    """(k, keys) places of the keys in a level."""
    with np.errstate(over="ignore"):
        a = mix(h1.view(np.uint64) + np.uint64(level))
        b = mix(h2.view(np.uint64) ^ np.uint64(level)) | np.uint64(1)
        return np.stack([(a + np.uint64(j) * b) % np.uint64(bits) for j in range(k)])


class Level:
    """A Bloom filter of one level."""

    def __init__(self, level: int, bits: int, k: int) -> None:
        self.level, self.bits, self.k = level, bits, k
        self.array = np.zeros((bits + 63) // 64, dtype=np.uint64)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = positions(h1, h2, self.level, self.bits, self.k)
        return ((self.array[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def listed(cascade: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed, by the first level that it fails: it isn't where that level encodes listed keys."""
    out = np.zeros(len(h1), dtype=bool)
    left = np.arange(len(h1))
    for n, level in enumerate(cascade):
        passed = level.holds(h1[left], h2[left])
        out[left[~passed]] = n % 2 == 1
        left = left[passed]
    out[left] = len(cascade) % 2 == 1
    return out


def sized(level: int, keys: int, others: int) -> tuple[int, int]:
    """(bits, hash functions) of a level: level 1 lets pass about as many others as it has keys, each later level half."""
    if not keys:
        return 64, 1
    p = min(0.5, keys * math.sqrt(0.5) / max(others, 1)) if level == 1 else 0.5
    return max(64, math.ceil(-keys * math.log(p) / math.log(2) ** 2)), max(1, round(-math.log2(p)))


def _fill(level: Level, keys: DataFrame) -> Level:
    """Set the bits of the keys: distinct words of 64 bits are made on the executors."""
    n, bits, k = level.level, level.bits, level.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(positions(batch.column(0).to_numpy(), batch.column(1).to_numpy(), n, bits, k))
            word, one = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, dtype=np.int64)
            merged = np.bitwise_or.reduceat(one, heads) if len(word) else one
            yield pa.RecordBatch.from_arrays([pa.array(word[heads]), pa.array(merged.view(np.int64))], names=["word", "bits"])

    words = keys.select("h1", "h2").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for r in words.toLocalIterator():  # at most MAX_BITS / 64 rows
        level.array[r["word"]] = np.array([r["bits"]], dtype=np.int64).view(np.uint64)[0]
    return level


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.holds(batch.column(0).to_numpy(), batch.column(1).to_numpy())))

    return keys.mapInArrow(run, "h1 bigint, h2 bigint")


def build(universe: DataFrame, max_bits: int = MAX_BITS) -> list[list[Level]]:
    """Cascades over ``universe`` (h1, h2, listed), one for each part of the keys by hash."""
    universe = cut(universe)
    n = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    whole, _ = sized(1, n.get(True, 0), n.get(False, 0))
    count = max(1, math.ceil(whole * 1.2 / max_bits))
    out = []
    for part in range(count):
        mine = universe if count == 1 else universe.filter(F.pmod("h1", F.lit(count)) == part)
        sides = [mine.filter("listed").select("h1", "h2"), mine.filter("not listed").select("h1", "h2")]
        sizes = [side.count() for side in sides]
        cascade: list[Level] = []
        while sizes[0]:
            level = _fill(Level(len(cascade) + 1, *sized(len(cascade) + 1, *sizes)), sides[0])
            cascade.append(level)
            wrong = cut(_passing(sides[1], level))
            sides, sizes = [wrong, sides[0]], [wrong.count(), sizes[0]]
        out.append(cascade)
    return out


def judge_hosts(rows: DataFrame, cascades: list[list[Level]], columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` and ``is_listed``: whether any of the keys hashed in k1, k2 (arrays) is listed."""
    context = rows.sparkSession.sparkContext
    held = [context.broadcast(c) for c in cascades]

    def judged(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches).combine_chunks()
        k1, k2 = (both.column(len(columns) + i).combine_chunks() for i in (0, 1))
        h1, h2 = k1.flatten().to_numpy(zero_copy_only=False).astype(np.int64), k2.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(both.num_rows), k1.value_lengths().to_numpy(zero_copy_only=False))
        found = np.zeros(both.num_rows, dtype=bool)
        for part, cascade in enumerate(held):
            mine = np.flatnonzero(h1 % len(held) == part) if len(held) > 1 else np.arange(len(h1))
            found[owner[mine[listed(cascade.value, h1[mine], h2[mine])]]] = True
            if len(held) > 1:
                vars(cascade).pop("_value", None)  # read again from the worker's disk for the next keys
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(found[at : at + batch.num_rows])], names=[*columns, "is_listed"])
            at += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, keys = [], 0
        for batch in batches:
            waiting.append(batch)
            keys += len(batch.column(len(columns)).flatten())
            if len(held) == 1 or keys >= HELD_KEYS:
                yield from judged(waiting)
                waiting, keys = [], 0
        if waiting:
            yield from judged(waiting)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns, "k1", "k2").mapInArrow(run, f"{fields}, is_listed boolean")


def url_filter(pages: DataFrame, blocked: DataFrame | None = None, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row; ``blocked`` has the listed hosts in its first column."""
    spark = pages.sparkSession
    if blocked is None:
        blocked = spark.createDataFrame([(h,) for h in BLOCKED], "host string")
    hosts = blocked.select(F.translate(F.col(blocked.columns[0]), UPPER, LOWER).alias("key")).filter("key <> ''").distinct()
    most_labels = hosts.agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0] or 1
    host, path = host_and_path(url)
    parsed = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    distinct = parsed.select("host").distinct().select(F.explode(host_keys(F.col("host"), most_labels)).alias("key")).distinct()
    marked = distinct.join(hosts.withColumn("listed", F.lit(True)), "key", "left")
    h1, h2 = hashes(F.col("key"))
    cascades = build(marked.select(h1.alias("h1"), h2.alias("h2"), F.coalesce("listed", F.lit(False)).alias("listed")), MAX_BITS)
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    keyed = parsed.withColumns({"rule": rule, "by_rule": verdict, "keys": host_keys(F.col("host"), most_labels)})
    keyed = keyed.withColumns({"k1": F.transform("keys", lambda k: hashes(k)[0]), "k2": F.transform("keys", lambda k: hashes(k)[1])})
    judged = judge_hosts(keyed, cascades, [key, "host", "path", "rule", "by_rule"])
    by_list = F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(key, "host", "path", "rule", F.coalesce("by_rule", by_list).alias("verdict"))
