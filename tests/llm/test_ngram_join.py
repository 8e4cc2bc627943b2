import itertools
import random
import re

import numpy as np
import pytest

from quarry.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = "doc_id bigint, text string, n bigint, label string"


def corpus(seed=3):
    """Copies, near copies, a passage in unrelated texts, short, empty and null texts, frequent words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, long = text(120), text(60), text(900)
    texts = [base] * 20 + [passage + " " + text(rng.randrange(20, 200)) for _ in range(25)] + [text(rng.randrange(1, 60)) for _ in range(40)]
    for source in (base, long):
        for _ in range(25):
            w = source.split()
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w[: len(w) - rng.randrange(4)]))
    texts += [None, "", "   ", "one", "one two", "ONE two", "one two", "a b c", "x" * 100_000]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], FIELDS).repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.ngram_join(docs, **options).collect()}


@pytest.mark.parametrize("k, num, den, extra", [(3, 90, 100, 1.0), (5, 4, 5, 0.5), (1, 1, 2, 0.5), (2, 1, 10, 0.0)])
def test_components_equal_brute_force(spark, k, num, den, extra):
    rows = corpus()
    assert run(spark, rows, k=k, num=num, den=den, extra=extra) == brute(rows, k, num, den)


def test_frequent_tokens_and_cut_groups_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(J, "LOCAL_MIN", 2)
    monkeypatch.setattr(J, "GLOBAL_MIN", 3)
    rows = corpus(5)
    expected = brute(rows, 3, 4, 5)
    assert run(spark, rows, k=3, num=4, den=5) == expected
    assert run(spark, rows, k=3, num=4, den=5, group_tokens=300) == expected


def test_null_keys_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1, "x"), (2, "a b c d e f", 1, None), (2, "a b c d e f", 1, None), (None, "only here", None, "x")], FIELDS)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.ngram_join(docs).collect()), key=str)
    assert got == sorted([(None, 2, 2), (2, 2, 2), (2, 2, 2), (None, 1, None)], key=str)
    assert J.ngram_join(docs.limit(0)).collect() == []


def test_one_document_of_each_component_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows] + [(10, rows[0][1], 0, "x"), (None, "nameless", 0, "x")], FIELDS)
    kept = J.keep_one(docs, k=5, num=4, den=5)
    assert kept.columns == docs.columns
    expected = {i for i, (_, c) in brute(rows, 5, 4, 5).items() if i == c}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(expected) and ids.count(None) == 1


def test_small_sets_link_with_larger_ones(spark):
    """Sets of 9 and 10 shingles at 9/10: the smaller prefix holds fewer tokens than the larger."""
    rows = []
    for i in range(12):
        words = [f"p{i}w{j}" for j in range(11)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words, "end"] if i % 2 else ["start", *words]))]
    expected = brute(rows, 3, 90, 100)
    assert all(expected[10 * i + 1] == (10, 10 * i) for i in range(12))
    assert run(spark, rows, k=3, num=90, den=100, extra=1.0) == expected


@pytest.mark.parametrize("num, den, extra", [(90, 100, 1.0), (4, 5, 0.5), (1, 2, 0.5), (1, 10, 0.0), (2, 3, 2.0)])
def test_prefixes_of_links_share_what_both_need(num, den, extra):
    rng = random.Random(8)
    none = np.zeros(0, dtype=np.uint64)
    links = 0
    for _ in range(4000):
        n = rng.randrange(1, 60)
        both = [rng.getrandbits(64) for _ in range(n)]
        more = [[rng.getrandbits(64) for _ in range(rng.randrange(0, max(2, n * (den - num) // num + 2)))] for _ in range(2)]
        a, b = (sorted({*both, *x}) for x in more)
        if a == b or n * den < (len(a) + len(b) - n) * num:
            continue
        links += 1
        often = np.array(sorted(rng.sample(both, rng.randrange(0, n + 1))), dtype=np.uint64) if rng.random() < 0.5 else none
        classes = np.ones(len(often), dtype=np.int64)
        found = [J.index_rows(np.array(x, dtype=np.uint64), often, classes, num, den, extra) for x in (a, b)]
        rare = [set(keys[kinds < J.PAIR].tolist()) for keys, kinds, _ in found]
        assert len(rare[0] & rare[1]) >= max(need for _, _, need in found)
    assert links > 100


def test_every_pair_of_sizes_and_overlaps_shares_what_both_need():
    """All sizes to 48, all overlaps that link: the shared tokens may stand anywhere, at the end at worst."""
    none = np.zeros(0, dtype=np.uint64)
    for num, den, extra in [(90, 100, 1.0), (90, 100, 2.0), (4, 5, 0.5), (4, 5, 1.0), (1, 2, 0.5)]:
        for n in range(1, 49):
            for m in range(n, min(48, n * den // num) + 1):
                for o in range(1, n + 1):
                    if o * den < (n + m - o) * num or n == m == o:
                        continue
                    shared = np.arange(10_000, 10_000 + o, dtype=np.uint64)
                    a = np.concatenate([np.arange(n - o, dtype=np.uint64), shared])
                    b = np.concatenate([np.arange(100, 100 + m - o, dtype=np.uint64), shared])
                    found = [J.index_rows(x, none, none.astype(np.int64), num, den, extra) for x in (a, b)]
                    keys = [set(k[kinds < J.PAIR].tolist()) for k, kinds, _ in found]
                    single = [set(k[kinds == J.SINGLE].tolist()) for k, kinds, _ in found]
                    assert len(keys[0] & keys[1]) >= max(need for _, _, need in found) and single[0] & single[1], (num, den, extra, n, m, o)


def test_string_keys_and_clashing_names(spark):
    rows = corpus()
    docs = spark.createDataFrame([(f"k{i:04}", t, 0, "x") for i, t in rows], "id string, d1 string, n int, label string").repartition(3)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in J.ngram_join(docs, key="id", text="d1", k=3, num=4, den=5).collect()}
    assert got == {f"k{i:04}": (n, f"k{c:04}") for i, (n, c) in brute(rows, 3, 4, 5).items()}
    kept = J.keep_one(docs, key="id", text="d1", k=3, num=4, den=5)
    assert kept.columns == docs.columns and sorted(r["id"] for r in kept.collect()) == sorted(f"k{i:04}" for i, (_, c) in brute(rows, 3, 4, 5).items() if i == c)


def test_rows_of_one_key_with_different_texts_are_judged_by_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a + " end", 1), (2, a, 1), (2, b, 2), (2, b, 2), (2, b, 1), (2, b.upper(), 0), (3, b + " more", 1), (4, None, 1), (4, None, 1), (4, "", 1), (5, "alone here", 1), (6, a, 1), (6, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    got = sorted((tuple(r) for r in J.keep_one(docs).collect()), key=repr)
    assert got == sorted([(1, a + " end", 1), (2, b.upper(), 0), (4, None, 1), (4, None, 1), (4, "", 1), (5, "alone here", 1), (6, "", 1)], key=repr)
    docs = spark.createDataFrame([(9, a, 1), (9, a, 1), (8, b, 1)], "doc_id bigint, text string, n bigint")
    assert sorted(r["doc_id"] for r in J.keep_one(docs).collect()) == [8, 9]


def test_sets_that_clash_in_half_their_digest_still_link(spark, monkeypatch):
    """All digests agree in their first half: groups are as coarse as can be, the links the same."""
    whole = J.fingerprint
    monkeypatch.setattr(J, "fingerprint", lambda tokens: (7, whole(tokens)[1]))
    rows = corpus(11)
    assert run_in_process(spark, rows) == brute(rows, 3, 4, 5)


def run_in_process(spark, rows):
    """The join where Python workers see the patched digest: functions are shipped by value."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(J)
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert {r["d1"] for r in J._summaries(docs, "doc_id", "text", 3).filter("kind = 0 and n > 0").collect()} == {7}
        return run(spark, rows, k=3, num=4, den=5)
    finally:
        cloudpickle.unregister_pickle_by_value(J)
