import random
import re

import numpy as np
import pytest

from quarry.llm.decontamination import Items, bottom, clean_documents, contained_items

PLAIN = re.compile("[0-9a-zA-Z\x80-\U0010ffff]+")


def grams(text, k=5):
    w = PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 3) for _ in range(n))
    items = [(100 + i, text(rng.randrange(5, 90))) for i in range(30)] + [(500, None), (501, ""), (502, "one two"), (503, "Same, Item! is here twice ok"), (504, "same item is here twice ok"), (None, text(30))]
    docs = []
    for i in range(60):
        item = items[rng.randrange(30)][1].split()
        for _ in range(rng.randrange(0, 3)):
            item[rng.randrange(len(item))] = "changed"
        docs.append((i, text(rng.randrange(0, 3000)) + " " + " ".join(item).upper() + ". " + text(rng.randrange(0, 50))))
    docs += [(900, None), (901, ""), (902, "One, two"), (903, "one two three"), (904, text(40_000)), (904, "SAME item is here twice ok"), (None, "same item is here twice ok"), (905, items[-1][1])]
    return docs, items


@pytest.mark.parametrize("block_shingles", [1_000_000, 60])
def test_pairs_equal_exact_containment(spark, block_shingles):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string").drop("item_id")
    got = contained_items(d.repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), block_shingles=block_shingles).collect()
    expected = []
    for i, t in docs:
        own = grams(t)
        for j, u in items:
            item = grams(u)
            if item and 5 * len(item & own) >= 4 * len(item):
                expected.append((i, j, len(item), len(item & own)))
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=str) == sorted(expected, key=str)
    assert len(expected) > 30


def test_clean_documents_stay_whole(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(t, i) for i, t in docs], "text string, doc_id bigint")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    kept = clean_documents(d, b, block_shingles=200)
    bad = [t for _, t in docs if any(g and 5 * len(g & grams(t)) >= 4 * len(g) for g in (grams(u) for _, u in items))]
    assert sorted((r["text"] or "-") for r in kept.collect()) == sorted((t or "-") for _, t in docs if t not in bad)
    assert kept.columns == d.columns


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert contained_items(d, b).collect() == [] and clean_documents(d, b).count() == 1
    assert contained_items(d.limit(0), spark.createDataFrame([(1, "a b c d e f")], b.schema)).collect() == []


def test_sketches_cannot_miss():
    for upper in range(1, 200):
        for n in range(upper // 2 + 1, upper + 1):
            assert n - -(-n * 4 // 5) < bottom(upper, 4, 5)


def test_equal_key_names_equal_items_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 7), (1, "a b c d e f g", 7), (2, None, None)], "id bigint, text string, shared_shingles int")
    items = spark.createDataFrame([("x", "A b, c d e f"), ("y", "a b c d e f")], "id string, text string")
    got = contained_items(docs, items, key="id", item="id")
    assert got.columns[:2] == ["id", "item_id"] and sorted((r[0], r[1]) for r in got.collect()) == [(1, "x"), (1, "x"), (1, "y"), (1, "y")]
    assert [r["id"] for r in clean_documents(docs, items, item="id").collect()] == [2]


def test_documents_hold_the_minima_that_candidates_need():
    rng = random.Random(7)
    for _ in range(300):
        sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randrange(1, 70))], dtype=np.uint64)) for _ in range(5)]
        items = Items(list(enumerate(sets)), 4, 5)
        s = sets[0]
        gone = rng.sample(range(len(s)), len(s) - -(-len(s) * 4 // 5))
        held = np.concatenate([np.delete(s, gone), np.array([rng.getrandbits(64) for _ in range(400)], dtype=np.uint64)])
        assert 0 in items.candidates(held)
