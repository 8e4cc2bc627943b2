"""Line dedup by winnowing: repeated runs of lines of ``RUN_WORDS`` words or more are deleted but for their first place.

A document is its sequence of lines that have a word. A gram is the shortest run of lines from a
line on with ``GRAM_WORDS`` words; a window is the shortest run from a line on with ``RUN_WORDS``
words. The gram of least hash inside each window is a fingerprint of the document, so any two runs
of RUN_WORDS words that are equal line by line have a fingerprint in common at the same place in
both. Where a fingerprint recurs, the windows around it, the shortest runs of RUN_WORDS words that
begin or end at a line, are compared with all others by digests of 128 bits; a run that is at an
earlier place by (document, line) is deleted. Any equal runs of RUN_WORDS words are made of such
windows, so a later run goes whole, whichever documents hold parts of it before.
The first place of a window is never the one deleted, but where a text repeats one line over and
over, windows overlap their own first place, and of such a run the first line stays.

Fingerprints and windows are reduced to their first places before they are shuffled, so a line that
half of all documents hold costs one row a document and window; only digests, not texts, are brought
together. Texts move only where the rows with repeated runs hold more than ``BROADCAST_LINES`` lines.

Defined cases: null and empty texts have no lines and stay as they are; a text or line of any length
is taken whole; a row with a null key stays as it is, since nothing orders it; rows that repeat a
key have their own places by the hash of their texts, and rows equal in key and text are one
document, changed alike; lines are compared by their words; extra columns are passed through but for
those named like results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import cut
from quarry.llm.textvec import line_hashes

#: Words of a run that is deleted, at least (the guarantee), and of a gram (the noise threshold).
RUN_WORDS, GRAM_WORDS = 50, 25
#: Lines to delete, and rows that have any, that are broadcast to clean the texts where they lie, at most (about 60 MB).
BROADCAST_LINES = 2_000_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def fingerprints(hashes: np.ndarray, counts: np.ndarray, run: int, gram: int) -> list[tuple[int, int]]:
    """(hash, line) of the gram of least hash in each window, by the winnowing of a document's lines."""
    n = len(hashes)
    total = np.r_[0, np.cumsum(counts)]
    if n == 0 or total[-1] < run:
        return []
    ends = np.searchsorted(total, total[:-1] + gram)  # line after the gram from each line on; n + 1: none
    stops = np.searchsorted(total, total[:-1] + run)
    h = hashes.tolist()
    values: dict[int, int] = {}

    def value(i: int) -> int:
        if i not in values:
            x = int(ends[i]) - i
            for y in h[i : int(ends[i])]:
                x = ((x ^ y) * _MULTIPLIER) & _MASK
                x ^= x >> 29
            values[i] = x
        return values[i]

    chosen: dict[int, int] = {}
    for s in range(n):
        stop = int(stops[s])
        if stop > n:
            break
        best, i = None, s
        while i < stop and ends[i] <= stop:
            if best is None or value(i) <= value(best):
                best = i
            i += 1
        chosen[best] = value(best)
    return [(v, i) for i, v in chosen.items()]


def _scan(docs: DataFrame, key: str, text: str, run_words: int, gram_words: int) -> DataFrame:
    """A row for each document: key, d (hash of the text), hashes and words of its lines, fingerprints and their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, p, f, at = [], [], [], [], []
            for _, hashes, counts, places in line_hashes(batch.column(2)):
                prints = fingerprints(hashes, counts, run_words, gram_words)
                h.append(hashes.view(np.int64))
                w.append(counts.astype(np.int32))
                p.append(places.astype(np.int32))
                f.append(np.array([v for v, _ in prints], dtype=np.uint64).view(np.int64))
                at.append(np.array([i for _, i in prints], dtype=np.int32))
            columns = [pa.array(h, pa.list_(pa.int64())), pa.array(w, pa.list_(pa.int32())), pa.array(p, pa.list_(pa.int32())), pa.array(f, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "d", "hashes", "counts", "places", "prints", "at"])

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("d"), text)
    kind = docs.schema[key].dataType.simpleString()
    fields = f"id {kind}, d bigint, hashes array<bigint>, counts array<int>, places array<int>, prints array<bigint>, at array<int>"
    return rows.mapInArrow(run, fields)


def windows(counts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after) of the shortest runs of ``run`` words that begin at a line or end at one: they cover any run of as many words."""
    n = len(counts)
    total = np.r_[0, np.cumsum(counts)]
    stops = np.searchsorted(total, total[:-1] + run)
    starts = np.flatnonzero(stops <= n)
    more = np.maximum(np.minimum(np.r_[stops[1:], n + 1], n + 1)[starts] - stops[starts], 1)
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    return np.repeat(starts, more), np.repeat(stops[starts], more) + step


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(id, d, lines): places, among all lines of the text, of the lines to delete, for each document that has any."""
    # Rows equal in key and text may be there twice: their places are the same, so none is later than the other.
    scanned = cut(_scan(docs, key, text, run_words, gram_words))
    prints = scanned.select("id", "d", F.explode(F.arrays_zip("prints", "at")).alias("x")).select("id", "d", F.col("x.prints").alias("print"), F.col("x.at").alias("at"))
    often = prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    shared = prints.join(often, "print").groupBy("id", "d").agg(F.collect_set("at").alias("shared"))  # at most a place a line
    met = shared.join(scanned.select("id", "d", "hashes", "counts", "places"), ["id", "d"]).select("id", "d", "hashes", "counts", "places", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                hashes, counts, places, at = (batch.column(c)[r].values.to_numpy() for c in (2, 3, 4, 5))
                low, high = windows(counts, run_words)
                at = np.sort(at)
                holds = np.searchsorted(at, low) < np.searchsorted(at, high)
                low, high = low[holds], high[holds]
                m = len(low)
                digests = [blake2b(hashes[i:j].tobytes(), digest_size=16).digest() for i, j in zip(low, high)]
                columns = [pa.repeat(batch.column(0)[r], m), pa.repeat(batch.column(1)[r], m), pa.array(digests, pa.binary()), pa.array(low, pa.int32())]
                lines = pa.array([places[i:j] for i, j in zip(low, high)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, lines], names=["id", "d", "w", "at", "lines"])

    kind = docs.schema[key].dataType.simpleString()
    held = cut(met.mapInArrow(run, f"id {kind}, d bigint, w binary, at int, lines array<int>"))
    first = held.groupBy("w").agg(F.min(F.struct("id", "d", "at")).alias("one"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = held.join(first, "w").filter("struct(id, d, at) <> one")
    return later.groupBy("id", "d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """``docs`` without repeated runs: the text is cleaned, ``n_lines`` and ``removed_lines`` (their places) are added."""
    docs = docs.drop("n_lines", "removed_lines")
    runs = cut(repeated_runs(docs, key, text, run_words, gram_words)).withColumnsRenamed({"id": "__id", "d": "__d", "lines": "removed_lines"})
    held = runs.agg(F.coalesce(F.sum(F.size("removed_lines") + 1), F.lit(0))).first()[0]
    runs = F.broadcast(runs) if held <= BROADCAST_LINES else runs
    keyed = docs.withColumn("__hash", F.xxhash64(text))
    joined = keyed.join(runs, (keyed[key] == runs["__id"]) & (keyed["__hash"] == runs["__d"]), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains("removed_lines", i))
    cleaned = F.when(F.col("removed_lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    empty = F.array().cast("array<int>")
    out = joined.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(n_lines), "__text": cleaned})
    return out.withColumns({text: F.col("__text"), "removed_lines": F.coalesce("removed_lines", empty)}).select(*docs.columns, "n_lines", "removed_lines")
