"""Language identification by rank-order profiles of frequent n-grams (Cavnar and Trenkle, 1994).

A profile ranks a language's most frequent byte n-grams of one to three bytes. A text's own most
frequent n-grams are ranked alike, and each language's distance is the sum of how far each n-gram
is out of place, an absent one counting as the length of the profile. Profiles are learnt from a
bounded sample of the labelled rows that aren't held out: the ``per_language`` rows of each
language whose key and text hash lowest. Rows are counted by slices of the hash's range, coarse ones
first, and only those of the first slices that hold as many are counted finer and then ranked, so a
language of most rows sends no more to a task than a few thousand slices and as many rows as it learns from.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text where
nothing could be learnt; texts of any length are profiled whole; a row with a null key isn't learnt
from and not held out; n-grams as frequent as each other rank by their bytes, and languages as near
as each other go by name; rows equal in key and text are learnt from once and predicted alike, rows
of one key with different texts each; other columns aren't read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import cut
from quarry.llm.textvec import chunks

#: N-grams in a profile.
PROFILE = 400
#: Labelled rows that each language's profile is learnt from, at most.
PER_LANGUAGE = 2000
#: Binary digits of a coarse and of a fine slice of the hash's range.
SLICE_BITS = (10, 20)
#: Most rows of small tables (slices, sampled hashes) that are broadcast.
BROADCAST_ROWS = 500_000


def _fold() -> np.ndarray:
    """Letters in lower case, bytes of other scripts as they are, everything else one gap."""
    table = np.full(256, 32, dtype=np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_FOLD = _fold()


def ngrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of one text, codes ascending; an n-gram has no gap but at its ends."""
    b = np.concatenate([np.array([32], dtype=np.uint32), _FOLD[data], np.array([32], dtype=np.uint32)])
    gap = b == 32
    one = b[~gap]
    two = ((b[:-1] << np.uint32(8)) | b[1:])[~(gap[:-1] & gap[1:])] | np.uint32(1 << 30)
    three = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:])[~gap[1:-1]] | np.uint32(1 << 31)
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def held_out(key: str = "doc_id") -> Column:
    """Whether the checksum of the key as text leaves the remainder 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language."""
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l"), held_out(key).alias("out"))
    labelled = labelled.filter("k is not null and t is not null and l is not null and not out").select("t", "l", F.xxhash64("k", "t").alias("h"))
    small = lambda rows: F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
    some = cut(labelled.select("l", "h").distinct())
    before = F.sum("n").over(W.partitionBy("l").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    for bits in SLICE_BITS:
        sliced = some.withColumn("slice", F.shiftright("h", 64 - bits).cast("int"))
        counts = sliced.groupBy("l", "slice").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
        needed = counts.filter(F.col("before") < per_language).select("l", "slice")
        some = cut(sliced.join(small(needed), ["l", "slice"]).select("l", "h"))
    nth = F.row_number().over(W.partitionBy("l").orderBy("h"))
    sample = cut(some.withColumn("nth", nth).filter(F.col("nth") <= per_language).select("l", "h"))
    rows = labelled.join(small(sample), ["l", "h"], "left_semi").groupBy("l", "h").agg(F.first("t").alias("t")).select("l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, data, offsets in chunks(batch.column(1)):
                for i in range(len(offsets) - 1):
                    codes, counts = ngrams(data[offsets[i] : offsets[i + 1]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[row + i]] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))],
                        names=["l", "code", "n"],
                    )

    counted = rows.mapInArrow(run, "l string, code bigint, n bigint").groupBy("l", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("l").orderBy(F.desc("n"), "code"))
    profiles: dict[str, list] = {}
    for r in counted.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("l", "rank").collect():  # size rows a language
        profiles.setdefault(r["l"], []).append(r["code"])
    return {name: np.array(codes, dtype=np.uint32) for name, codes in profiles.items()}


class Profiles:
    """All profiles as one table of ranks."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.names])) if profiles else np.zeros(0, dtype=np.uint32)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int32)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, data: np.ndarray) -> tuple[str, float]:
        """The nearest language and 1 less its distance as a share of the largest."""
        own = top(*ngrams(data), self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.names[best], float(1 - apart[best] / (len(own) * self.size))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row; only the text decides."""
    held = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))
    kind = docs.schema[key].dataType.simpleString()
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for row, data, offsets in chunks(batch.column(2)):
                for i in range(len(offsets) - 1):
                    if offsets[i + 1] > offsets[i]:
                        names[row + i], scores[row + i] = held.value.predict(data[offsets[i] : offsets[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    rows = docs.select(key, held_out(key).alias("held_out"), F.when(lettered, F.col(text)).alias("t"))
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
