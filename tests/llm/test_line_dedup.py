import random

import numpy as np
import pytest
import xxhash

from quarry.llm import line_dedup as L
from quarry.llm.line_dedup import fingerprints, line_dedup


def corpus(seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passages = [[line(60)], [line(20), line(20), line(20)], [line(8) for _ in range(9)], [line(30), "", line(30)]]
    common = line(5)
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            lines += rng.choice([[line(rng.randrange(1, 30))], [common], rng.choice(passages), [line(12)]])
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(["again and again"] * 60)), (None, docs[0][1]), (104, docs[1][1]), (104, docs[1][1]), (104, docs[2][1])]
    rng.shuffle(docs)
    return docs


def spark_hash(text):
    """Spark's hash of a text."""
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute(docs, run=L.RUN_WORDS):
    """Places of the lines to delete of each (key, text): those of every run of lines of 50 words that has an equal one before."""
    split, first = {}, {}
    for i, t in docs:
        if i is not None and t is not None:
            split[i, t] = [(n, tuple(x.split())) for n, x in enumerate(t.split("\n")) if x.split()]
    spans = []
    for (i, t), lines in split.items():
        for a in range(len(lines)):
            words = 0
            for b in range(a + 1, len(lines) + 1):
                words += len(lines[b - 1][1])
                if words >= run:
                    held, place = tuple(w for _, w in lines[a:b]), (i, spark_hash(t), a)
                    spans.append((held, place, (i, t), {n for n, _ in lines[a:b]}))
                    first[held] = min(first.get(held, place), place)
                    if words >= 3 * run:
                        break
    gone = {key: set() for key in split}
    for held, place, key, lines in spans:
        if place != first[held]:
            gone[key] |= lines
    return gone


@pytest.mark.parametrize("seed, broadcast", [(7, True), (8, False), (9, True)])
def test_deleted_lines_equal_brute_force(spark, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr(L, "BROADCAST_LINES", 0)
    docs = corpus(seed)
    d = spark.createDataFrame([(t, i, 5) for i, t in docs], "text string, doc_id bigint, n_lines int").repartition(3)
    got = line_dedup(d).collect()
    gone = brute(docs)
    expected = []
    for i, t in docs:
        lines = (t or "").split("\n")
        out = gone.get((i, t), set())
        expected.append((i, t if not out else "\n".join(x for n, x in enumerate(lines) if n not in out), sorted(out), 0 if t is None else len(lines)))
    assert sum(map(bool, gone.values())) > 20
    assert sorted(((r["doc_id"], r["text"], r["removed_lines"], r["n_lines"]) for r in got), key=repr) == sorted(expected, key=repr)


def test_very_long_lines_and_string_keys(spark):
    line = " ".join(f"w{i}" for i in range(200_000))
    many = "\n".join(f"short line {i}" for i in range(20_000))
    rows = [("b", line + "\nend"), ("a", "start\n" + line), ("c", many), ("d", many + "\nmore")]
    got = {r["name"]: r for r in line_dedup(spark.createDataFrame(rows, "name string, body string"), "name", "body").collect()}
    assert got["a"]["removed_lines"] == got["c"]["removed_lines"] == [] and got["b"]["body"] == "end" and got["d"]["body"] == "more"


def test_equal_runs_share_a_fingerprint():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randrange(1, 12)
        run_h, run_c = [rng.getrandbits(64) for _ in range(n)], [rng.randrange(1, 40) for _ in range(n)]
        if sum(run_c) < L.RUN_WORDS:
            continue
        found = []
        for _ in range(2):
            before, after = rng.randrange(5), rng.randrange(5)
            h = [rng.getrandbits(64) for _ in range(before)] + run_h + [rng.getrandbits(64) for _ in range(after)]
            c = [rng.randrange(1, 40) for _ in range(before)] + run_c + [rng.randrange(1, 40) for _ in range(after)]
            found.append({(v, i - before) for v, i in fingerprints(np.array(h, dtype=np.uint64), np.array(c), L.RUN_WORDS, L.GRAM_WORDS)})
        assert found[0] & found[1]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    out = line_dedup(d)
    assert out.columns == ["doc_id", "text", "n_lines", "removed_lines"] and out.collect() == []


def test_passages_go_though_an_earlier_document_holds_a_part(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    rows = []
    for i in range(0, 90, 3):
        one, two = line(), line()
        rows += [(i, f"{one}\n{line()}"), (i + 1, f"{one}\n{two}"), (i + 2, f"{one}\n{two}")]
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: [0, 1] if i % 3 == 2 else [] for i, _ in rows}


def test_windows_cover_every_run():
    rng = random.Random(6)
    for _ in range(300):
        counts = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 14))]
        found = list(zip(*(x.tolist() for x in L.windows(np.array(counts), 50))))
        assert all(sum(counts[i:j]) >= 50 for i, j in found)
        for a in range(len(counts)):
            for b in range(a + 1, len(counts) + 1):
                if sum(counts[a:b]) >= 50:
                    assert {x for i, j in found if a <= i and j <= b for x in range(i, j)} == set(range(a, b))
