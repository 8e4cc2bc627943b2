import random

import pytest

from quarry.llm.shared import connected_components


def brute(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)], [(7, i) for i in range(-20, 60)], [(2 * i, 2 * i + 1) for i in range(30)],
    [(random.Random(1).randrange(i + 1), i) for i in range(1, 80)], [(a, b) for a in range(12) for b in range(12)],
], ids=["path", "star", "pairs", "tree", "clique"])
def test_labels_equal_union_find(spark, edges):
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    got = {r["node"]: r["label"] for r in connected_components(frame).collect()}
    expected = brute(edges)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in expected.items() if k not in loops}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
