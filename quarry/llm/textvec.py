"""Words, word shingles and lines of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task else keeps the pages of its largest arrays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other allocators return pages by themselves
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives its memory back at the end of a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _lower()
#: Separators of the white-space words `[^\x20\x09-\x0D]+`.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of plain words: every ASCII character but digits and letters.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _PLAIN[_a:_b] = False


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(int(_ODD), -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _ODD, dtype=np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, dtype=np.uint64)], dtype=np.uint64)
        return self.up, self.down


_POWERS = Powers()


def _letters(skip: np.ndarray, lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if lower:
        values = values[_LOWER]
    values[skip] = 0
    return values


_TABLES = {(name, lower): _letters(skip, lower) for name, skip in (("space", _SPACE), ("plain", _PLAIN)) for lower in (False, True)}
_SKIPS = {"space": _SPACE, "plain": _PLAIN}


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of pieces of a string column; null and empty texts have no bytes."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, kind: str = "space", lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the number of words at last)."""
    return words_at(data, offsets, kind, lower)[:2]


def words_at(data: np.ndarray, offsets: np.ndarray, kind: str = "space", lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, with the byte where each word starts."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.int64)
    gap = _SKIPS[kind][data]
    begins = np.empty(len(data), dtype=bool)
    begins[0] = True
    begins[1:] = gap[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = True
    begins &= ~gap
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first, starts
    up, down = _POWERS.upto(len(data))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_TABLES[kind, lower][data] * up[: len(data)], starts)
        return mix(sums * down[starts]), first, starts


#: Odd multipliers of a shingle's words, by place.
_PLACES = mix(np.arange(11, 43, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[:n] * _PLACES[0]
        for i in range(1, k):
            total = total + hashes[i : i + n] * _PLACES[i]
        return mix(total)


def whole(hashes: np.ndarray) -> np.ndarray:
    """A text of fewer words than a shingle, as one shingle."""
    with np.errstate(over="ignore"):
        return mix(np.array([(hashes * _PLACES[: len(hashes)]).sum(dtype=np.uint64) ^ np.uint64(len(hashes))], dtype=np.uint64))


def shingle_sets(column: pa.Array, k: int, kind: str = "space") -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text; a text of fewer than k words has its whole sequence as one shingle, a text without words none."""
    for row, data, offsets in chunks(column):
        hashes, first = words(data, offsets, kind)
        grams = shingles(hashes, k)
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield row + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield row + i, whole(hashes[a:b])
            else:
                yield row + i, np.zeros(0, dtype=np.uint64)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of tokens, as two signed longs."""
    with np.errstate(over="ignore"):
        one = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        two = mix(tokens + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
        pair = mix(np.array([one, two + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def line_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, words, place among all lines) of the lines with a word, for every text; lines are their words in order."""
    none = np.zeros(0, dtype=np.int64)
    for row, data, offsets in chunks(column):
        hashes, first, starts = words_at(data, offsets, "space", lower=False)
        if not len(hashes):
            for i in range(len(offsets) - 1):
                yield row + i, none.view(np.uint64), none, none
            continue
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        one = line + text
        heads = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
        up, down = _POWERS.upto(len(hashes))
        with np.errstate(over="ignore"):
            value = mix(np.add.reduceat(hashes * up[: len(hashes)], heads) * down[heads])
        counts = np.diff(np.r_[heads, len(hashes)])
        place = line[heads] - np.searchsorted(breaks, offsets[text[heads]])
        cuts = np.searchsorted(heads, first)
        for i in range(len(offsets) - 1):
            a, b = cuts[i], cuts[i + 1]
            yield row + i, value[a:b], counts[a:b], place[a:b]
