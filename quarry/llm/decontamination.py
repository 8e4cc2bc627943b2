"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so resemblance of whole sets says nothing; containment of
the item does. Items are partitioned by their number of shingles, and each partition has an index and
a bound of its own. In a partition of at most ``u`` shingles, an item's sketch is its
``floor((1 - t) u) + 1`` smallest shingle hashes (bottom-m MinHash): an item of ``s`` shingles of which
a share ``t`` or more lies in a document misses ``floor((1 - t) s)`` at most, so the document holds the
others of its minima, at least one. A document's own sketch for a partition is those of its hashes up
to the partition's largest minimum, so it has what it needs however long the document is. Documents
that hold enough minima of an item are candidates for it and are verified in place by the exact share
of the item's shingles that the whole document holds.

Documents are read whole and never shuffled. Items are hashed on the executors and broadcast in
blocks of a checked number of shingles; a larger benchmark takes more passes.

Words are runs of letters, digits and other scripts' bytes in lower case. Defined cases: a null or
empty text or item matches nothing; an item of fewer words than a shingle matches only documents
that are the same word sequence; texts of any length count whole; repeated rows, and items with equal
texts, match each alike; where the keys of documents and items have the same name, the item's is
prefixed ``item_``; other columns aren't read; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.textvec import chunks, releasing, shingles, whole, words

#: Shingles of the items of a block, at most (8 MB of hashes).
BLOCK_SHINGLES = 1_000_000


def bottom(upper: int, num: int, den: int) -> int:
    """Minima that a sketch needs in a partition of items of at most ``upper`` shingles."""
    return upper - -(-upper * num // den) + 1


def _grams(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles in order) of every text."""
    for row, data, offsets in chunks(column):
        hashes, first = words(data, offsets, "plain")
        grams = shingles(hashes, k)
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            yield row + i, grams[a : b - k + 1] if b - a >= k else whole(hashes[a:b]) if b > a else np.zeros(0, dtype=np.uint64)


class Partition:
    """Items of at most ``upper`` shingles: their minima, and how many of them a document must hold."""

    def __init__(self, upper: int, members: list[tuple[int, np.ndarray]], num: int, den: int) -> None:
        most = bottom(upper, num, den)
        sketches = [s[:most] for _, s in members]  # sets are sorted: the first are the smallest
        minima, owners = np.concatenate(sketches), np.repeat(np.arange(len(members)), [len(x) for x in sketches])
        order = np.argsort(minima, kind="stable")
        self.items = np.array([i for i, _ in members], dtype=np.int64)
        self.minima, self.owners, self.bound = minima[order], owners[order], minima.max()
        # A document that holds num/den of a set misses the others at most, of its minima too.
        self.need = np.array([len(x) - (len(s) - -(-len(s) * num // den)) for x, (_, s) in zip(sketches, members)], dtype=np.int64)

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """Items with as many minima as they need among sorted hashes of a document."""
        sketch = hits[: np.searchsorted(hits, self.bound, "right")]
        low, high = np.searchsorted(self.minima, sketch, "left"), np.searchsorted(self.minima, sketch, "right")
        held = [self.owners[a:b] for a, b in zip(low, high) if b > a]
        if not held:
            return self.items[:0]
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return self.items[found[n >= self.need[found]]]


class Items:
    """A block of items: an index a partition, and all shingles for verification."""

    def __init__(self, items: list[tuple[object, np.ndarray]], num: int, den: int) -> None:
        self.ids = [x for x, _ in items]
        self.sets = [s for _, s in items]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, s in enumerate(self.sets):
            by_size.setdefault(1 << (len(s) - 1).bit_length(), []).append((i, s))
        self.partitions = [Partition(upper, members, num, den) for upper, members in sorted(by_size.items())]
        minima = np.concatenate([p.minima for p in self.partitions])
        self.bits = max(16, int(len(minima)).bit_length() + 5)
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[minima & np.uint64((1 << self.bits) - 1)] = True

    def candidates(self, grams: np.ndarray) -> np.ndarray:
        """Items that a document of these shingles may hold, partition by partition."""
        hits = np.unique(grams[self.filter[grams & np.uint64((1 << self.bits) - 1)]])
        if not len(hits):
            return hits.astype(np.int64)
        return np.concatenate([p.candidates(hits) for p in self.partitions])


def _blocks(benchmark: DataFrame, item: str, text: str, k: int, num: int, den: int, block_shingles: int) -> Iterator[Items]:
    """Items in blocks; the driver holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(grams).view(np.int64) for _, grams in _grams(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["item", "grams"])

    hashed = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {benchmark.schema[item].dataType.simpleString()}, grams array<bigint>")
    held, size = [], 0
    for r in hashed.filter("size(grams) > 0").toLocalIterator():
        held.append((r[0], np.array(r[1], dtype=np.int64).view(np.uint64)))
        size += len(r[1])
        if size >= block_shingles:
            yield Items(held, num, den)
            held, size = [], 0
    if held:
        yield Items(held, num, den)


def _matches(column: pa.Array, items: Items, k: int, num: int, den: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of every text that holds num/den or more of an item."""
    for row, grams in _grams(column, k):
        some = items.candidates(grams) if len(grams) else ()
        if len(some):
            own = np.unique(grams)
            for i in some:
                s = items.sets[i]
                n = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                if n * den >= len(s) * num:
                    yield row, i, n


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = 5,
    num: int = 4,
    den: int = 5,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(key, item, item_shingles, shared_shingles, containment) of every document that holds num/den or more of an item."""
    context = docs.sparkSession.sparkContext
    key_type, item_type = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    named = f"item_{item}" if item == key else item
    schema = f"`{key}` {key_type}, `{named}` {item_type}, item_shingles bigint, shared_shingles bigint, containment double"
    id_type = to_arrow_type(benchmark.schema[item].dataType)
    out = None
    for block in _blocks(benchmark, item, item_text, k, num, den, block_shingles):
        held = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                if found := list(_matches(batch.column(1), items, k, num, den)):
                    sizes = [len(items.sets[i]) for _, i, _ in found]
                    columns = [
                        batch.column(0).take(pa.array([row for row, _, _ in found], pa.int64())),
                        pa.array([items.ids[i] for _, i, _ in found], id_type),
                        pa.array(sizes, pa.int64()),
                        pa.array([n for _, _, n in found], pa.int64()),
                        pa.array([n / size for (_, _, n), size in zip(found, sizes)], pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, named, "item_shingles", "shared_shingles", "containment"])

        part = docs.select(key, text).mapInArrow(releasing(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 5, num: int = 4, den: int = 5, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """The rows of ``docs`` that hold no item, filtered where they lie."""
    context, place = docs.sparkSession.sparkContext, docs.columns.index(text)
    for block in _blocks(benchmark, item, item_text, k, num, den, block_shingles):
        held = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for row, _, _ in _matches(batch.column(place), held.value, k, num, den):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(releasing(run), docs.schema)
    return docs
