import re

import numpy as np
import pyarrow as pa

from quarry.llm import textvec

TEXTS = ["", None, "a", "One two  three\tfour\nfive", "  lead and trail \r\n", "Ünïcode wörter ÄÖ", "x" * 5000, "a b c d e f a b c d e f", "no\vgap\fhere", "\n\n", "last"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_row(texts, size=None):
    old = textvec.CHUNK_BYTES
    textvec.CHUNK_BYTES = size or old
    try:
        return {row: s for row, s in textvec.shingle_sets(pa.array(texts, pa.string()), 3)}
    finally:
        textvec.CHUNK_BYTES = old


def test_equal_words_have_equal_hashes_and_others_differ():
    seen = {}
    for _, data, offsets in textvec.chunks(pa.array(TEXTS, pa.string())):
        hashes, first = textvec.words(data, offsets)
        flat = [w for t in TEXTS for w in WORD.findall(lowered(t))]
        assert len(hashes) == len(flat) and first[-1] == len(flat)
        for w, h in zip(flat, hashes.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets_have_the_size_of_the_brute_force_sets_at_any_chunk_size():
    for size in (None, 1, 7, 64):
        got = by_row(TEXTS, size)
        for row, text in enumerate(TEXTS):
            w = WORD.findall(lowered(text))
            expected = {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
            assert len(got[row]) == len(expected)
        assert all((got[row] == by_row(TEXTS)[row]).all() for row in got)


def test_lines_are_found_with_their_places():
    texts = ["a b\n\nc d e\n  \nf", "", "x\ny", None, "\n\nz z"]
    got = {row: (counts.tolist(), places.tolist()) for row, _, counts, places in textvec.line_hashes(pa.array(texts, pa.string()))}
    assert got == {0: ([2, 3, 1], [0, 2, 4]), 1: ([], []), 2: ([1, 1], [0, 1]), 3: ([], []), 4: ([2], [2])}


def test_equal_lines_hash_alike_across_texts():
    rows = {row: h.tolist() for row, h, _, _ in textvec.line_hashes(pa.array(["same line\nother", "zero\n same  line"], pa.string()))}
    assert rows[0][0] == rows[1][1] and rows[0][1] != rows[1][0]


def test_fingerprints_tell_sets_apart():
    a, b = np.array([1, 2, 3], dtype=np.uint64), np.array([1, 2, 4], dtype=np.uint64)
    assert textvec.fingerprint(a) == textvec.fingerprint(a.copy()) != textvec.fingerprint(b)


def test_tasks_give_memory_back_and_keep_their_rows():
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    assert [b.column(0).to_pylist() for b in textvec.releasing(iter)(iter(batches))] == [[0], [1], [2]]
    unread = textvec.releasing(iter)(iter(batches))
    next(unread)
    unread.close()
