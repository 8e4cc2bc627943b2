"""Consistent-hash sharding with virtual nodes and bounded loads.

The ring has a number of cells that follows from the number of virtual nodes. A row's key hashes to
a cell; each shard owns virtual nodes at cells, and the cells up to a virtual node form its arc.
Shards hold at most a stated number of rows: rows of an arc whose shard is full go on clockwise to
the next virtual node with room. The walk needs only the number of rows of each cell, a table whose
size the ring states and not the data, so the driver makes it; rows then look up their cell's
segments. The one shuffle is the numbering of rows inside a cell: cells are numbered in as many parts
as their rows need to stay near ``ROWS_PER_PART`` a part, so a cell of a third of all rows spreads
over many tasks. Without slack all shards fill up, and counts are at most one apart. A shard more
takes its rows from all others, and only rows whose way clockwise changes move besides: ``moved``
tells the share from the cells' counts.

Defined cases: a null key is placed by its fallback columns; a null text has no bytes and the
checksum of no bytes; a text of any length is one row; equal keys share a cell, are dealt to its parts
by the fallback columns and numbered in any order where these tie; an empty table gives an empty
result; input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Binary digits of a cell's number, at least: 16,384 cells.
CELL_BITS = 14
#: Rows of a cell's part, about.
ROWS_PER_PART = 4096


def cell_bits(shards: int, vnodes: int) -> int:
    """Binary digits of a cell's number: four cells a virtual node or more. The ring's tables have a row a cell."""
    if shards < 1 or vnodes < 1:
        raise ValueError("a ring needs a shard and a virtual node")
    return max(CELL_BITS, (4 * shards * vnodes - 1).bit_length())


@lru_cache(maxsize=8)
def ring(shards: int, vnodes: int, bits: int | None = None) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; a taken cell sends a node to the next free one, lower shards first."""
    bits = bits or cell_bits(shards, vnodes)
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - bits)
            while cell in taken:
                cell = (cell + 1) % (1 << bits)
            taken[cell] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard; without slack they add up to the rows."""
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, vnodes: int, slack: float, bits: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, from, to, shard, first slot): where the rows of each cell go, by their number in the cell."""
    nodes = ring(shards, vnodes, bits)
    room = capacities(sum(counts.values()), shards, slack)
    filled = [0] * shards
    out = []

    def offer(cell: int, low: int, high: int, shard: int) -> int:
        take = min(high - low, room[shard] - filled[shard])
        if take > 0:
            out.append((cell, low, low + take, shard, filled[shard]))
            filled[shard] += take
            low += take
        return low

    over, owner = [], 0
    for cell in sorted(counts):
        while owner < len(nodes) and nodes[owner][0] < cell:
            owner += 1
        at = owner % len(nodes)
        low = offer(cell, 0, counts[cell], nodes[at][1])
        if low < counts[cell]:
            over.append((cell, low, counts[cell], at))
    # The next node whose shard has room, as links that skip full ones.
    skip = list(range(len(nodes)))

    def with_room(at: int) -> int:
        way = []
        while room[nodes[at][1]] == filled[nodes[at][1]]:
            way.append(at)
            at = skip[at] if skip[at] != at else (at + 1) % len(nodes)
        for x in way:
            skip[x] = at
        return at

    for cell, low, high, at in over:
        while low < high:
            at = with_room(at)
            low = offer(cell, low, high, nodes[at][1])
    return out


def moved(counts: dict[int, int], shards: int, vnodes: int, slack: float = 0.0, bits: int | None = None) -> float:
    """Share of the rows that are in another of the first ``shards`` shards, or in the new one, once there is one shard more."""
    bits = bits or cell_bits(shards + 1, vnodes)
    both = [sorted(walk(counts, n, vnodes, slack, bits)) for n in (shards, shards + 1)]
    stay = i = j = 0
    while i < len(both[0]) and j < len(both[1]):
        (c, a, b, s, _), (d, e, f, t, _) = both[0][i], both[1][j]
        if c == d and s == t:
            stay += max(0, min(b, f) - max(a, e))
        i, j = (i + 1, j) if (c, b) <= (d, f) else (i, j + 1)
    return 1 - stay / max(1, sum(counts.values()))


def place(df: DataFrame, key: str, fallback: list[str], shards: int = 16, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, gapless from 0 in each shard. ``fallback`` columns place rows whose key is null."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    bits = cell_bits(shards, vnodes)
    spot = F.when(F.col(key).isNull(), F.xxhash64(F.lit(1), *fallback)).otherwise(F.xxhash64(key))
    cell = F.shiftrightunsigned(F.col("__ring"), 64 - bits).cast("int")
    ringed = df.withColumn("__ring", spot).withColumn("__cell", cell)
    counts = {r["__cell"]: r["n"] for r in ringed.groupBy("__cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    segments = {c: [x[1:] for x in of] for c, of in groupby(sorted(walk(counts, shards, vnodes, slack)), key=lambda x: x[0])}
    table = [(c, -(-n // ROWS_PER_PART), segments[c]) for c, n in counts.items()]
    # At most a row a cell, and a segment a cell and one more for each shard that fills up.
    cells = spark.createDataFrame(table, "__cell int, __parts bigint, __segments array<struct<low:bigint,high:bigint,shard:int,base:bigint>>")
    part = F.pmod(F.xxhash64(F.lit(2), key, *fallback), F.col("__parts"))
    dealt = lambda rows: rows.join(F.broadcast(cells.select("__cell", "__parts")), "__cell").withColumn("__part", part)
    sized = dealt(ringed.select("__cell", key, *[c for c in fallback if c != key])).groupBy("__cell", "__part").agg(F.count("*").alias("__n"))
    up_to = F.sum("__n").over(W.partitionBy("__cell").orderBy("__part").rowsBetween(W.unboundedPreceding, 0))
    offsets = sized.withColumn("__end", up_to).withColumn("__first", F.col("__end") - F.col("__n")).join(F.broadcast(cells), "__cell")
    mine = F.filter("__segments", lambda x: (x["low"] < F.col("__end")) & (x["high"] > F.col("__first")))
    offsets = offsets.select("__cell", "__part", "__first", mine.alias("__mine"))
    number = F.row_number().over(W.partitionBy("__cell", "__part").orderBy("__ring", key, *fallback)).cast("bigint") - 1
    numbered = dealt(ringed).withColumn("__row", number).join(offsets, ["__cell", "__part"]).withColumn("__number", F.col("__first") + F.col("__row"))
    segment = F.filter("__mine", lambda x: (x["low"] <= F.col("__number")) & (F.col("__number") < x["high"]))
    return (
        numbered.withColumn("__segment", F.get(segment, F.lit(0)))
        .withColumn("shard", F.col("__segment.shard"))
        .withColumn("slot", F.col("__segment.base") + F.col("__number") - F.col("__segment.low"))
        .select(*df.columns, "shard", "slot")
    )


def text_size(text: str) -> Column:
    """UTF-8 bytes and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def shard_digest(docs: DataFrame, shards: int = 16, vnodes: int = 64) -> DataFrame:
    """Shard and slot of every row, with its size and checksum, under the law ``rows``."""
    rows = docs.select(
        "doc_id",
        text_size("text").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = place(rows, "doc_id", ["text_crc32", "size"], shards, vnodes)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_documents(docs: DataFrame, shards: int = 16, vnodes: int = 64) -> DataFrame:
    """``docs`` with shard and slot; the rows themselves move, as they would to be written by shard."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return place(docs.withColumn("__crc", crc), "doc_id", ["__crc"], shards, vnodes).drop("__crc")
