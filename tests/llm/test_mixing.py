import math
from collections import defaultdict

import pytest
import xxhash

from quarry.llm import mixing as M

FIELDS = "doc_id bigint, source string, text string, block string"


def corpus(spark):
    rows = [(i, "big", "w " * (1 + i % 40), "x") for i in range(3000)] + [(10_000 + i, "small", "a b c d e", "x") for i in range(200)]
    rows += [(20_000 + i, None, "one two three", "x") for i in range(100)] + [(30_000, "big", None, "x"), (30_001, "none", "", "x"), (None, "small", "null key", "x")]
    return spark.createDataFrame(rows, FIELDS).repartition(6)


def totals(docs):
    out = defaultdict(int)
    for r in docs.collect():
        out[r["source"]] += len((r["text"] or "").split())
    return {k: v for k, v in out.items() if v}


def test_entropy_and_limit_are_met(spark):
    docs = corpus(spark)
    have = totals(docs)
    whole = sum(have.values())
    got = M.mix(docs, entropy_share=0.9, max_repetition=None).select("source", "weight").distinct().collect()
    weights = {r["source"]: r["weight"] for r in got}
    assert sum(weights.values()) == pytest.approx(1)
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert entropy == pytest.approx(0.9 * math.log(len(have)), abs=1e-6)
    limited = {r["source"]: r["weight"] for r in M.mix(docs, entropy_share=None, max_repetition=1.5).select("source", "weight").distinct().collect()}
    assert max(w * whole / have[s] for s, w in limited.items()) == pytest.approx(1.5, abs=1e-6)


def test_streams_follow_the_quotas_and_blocks_have_the_mix(spark):
    docs = corpus(spark)
    have = totals(docs)
    whole = sum(have.values())
    rows = M.permute(M.mix(docs, entropy_share=0.9, max_repetition=None, block_tokens=8000)).collect()
    drawn, copies, blocks = defaultdict(int), defaultdict(set), defaultdict(lambda: defaultdict(int))
    for r in rows:
        assert (r["doc_id"], r["copy"]) not in copies[r["source"]]
        copies[r["source"]].add((r["doc_id"], r["copy"]))
        drawn[r["source"]] += r["n_tokens"]
        blocks[r["block"]][r["source"]] += r["n_tokens"]
        assert r["n_tokens"] == len(r["text"].split())
    weight = {r["source"]: r["weight"] for r in rows}
    for s, tokens in drawn.items():
        assert 0 <= tokens - math.floor(weight[s] * whole) <= 40  # the last document may run over
        n = [c for _, c in copies[s]]
        for copy in range(max(n)):  # every epoch but the last is whole
            assert n.count(copy) == sum(1 for r in docs.collect() if r["source"] == s and (r["text"] or "").split())
    for b, sums in blocks.items():
        for s, tokens in sums.items():
            assert abs(tokens - weight[s] * whole / len(blocks)) <= 80
        places = sorted(r["place"] for r in rows if r["block"] == b)
        assert places == list(range(len(places)))
    assert set(have) == set(drawn)


def test_same_input_gives_the_same_mixture(spark):
    docs = corpus(spark)
    key = lambda df: sorted(((r["doc_id"] or -1, r["copy"], r["block"]) for r in df.collect()))
    assert key(M.mix(docs)) == key(M.mix(docs.repartition(2)))


def test_single_sources_budgets_and_empty_tables(spark):
    docs = corpus(spark).filter("source = 'big'")
    assert M.mix(docs).count() == 3000
    tokens = sum(r["n_tokens"] for r in M.mix(docs, budget=1000).collect())
    assert 1000 <= tokens <= 1040
    assert M.mix(docs.limit(0)).collect() == []
    assert M.mix_documents(corpus(spark)).columns == FIELDS.replace(" bigint", "").replace(" string", "").split(", ")


def test_plan_has_no_python(spark):
    plan = M.mix(corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_limits_that_no_weights_keep_are_errors_and_contradictions_are_told(spark):
    rows = [(3 * i + j, f"s{j}", "a b c d", "x") for i in range(20) for j in range(3)]
    docs = spark.createDataFrame(rows, FIELDS)
    with pytest.raises(ValueError, match="more than 2.0 times"):
        M.mix(docs, budget=6 * 240, max_repetition=2.0)
    assert max(r["copy"] for r in M.mix(docs, budget=2 * 240, max_repetition=2.0).collect()) == 1
    with pytest.warns(UserWarning, match="below the target"):
        mixed = M.mix(corpus(spark), entropy_share=0.99, max_repetition=1.5)
    have = totals(corpus(spark))
    weights = {r["source"]: r["weight"] for r in mixed.select("source", "weight").distinct().collect()}
    assert max(w * sum(have.values()) / have[s] for s, w in weights.items()) <= 1.5 + 1e-9


def spark_hash(*values, seed=42):
    """The hash of longs (Python ints), ints (as bytes of four) and texts, as Spark chains it; nulls are passed over."""
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def four(n):
    return n.to_bytes(4, "little", signed=True)


def solved(totals, budget, entropy_share, max_repetition):
    """The exponent, by halving."""
    shares = [x / sum(totals) for x in totals]

    def figures(a):
        p = [x**a / sum(y**a for y in shares) for x in shares]
        return -sum(x * math.log(x) for x in p) / math.log(len(p)), max(x * budget / t for x, t in zip(p, totals))

    found = []
    for fits in (lambda a: figures(a)[0] >= entropy_share, lambda a: figures(a)[1] > (max_repetition or math.inf)):
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if fits(middle) else (low, middle)
        found.append(low)
    return max(found)


def brute(rows, budget, alpha, block_tokens, seed=11, rows_per_cell=M.ROWS_PER_CELL):
    """The mixture of rows (key, source, text, hash of the row), one document after the other: (key, source, copy, block, place)."""
    live = [(k, s, len((t or "").split()), h) for k, s, t, h in rows if (t or "").split()]
    total, counts = defaultdict(int), defaultdict(int)
    for _, s, n, _ in live:
        total[s] += n
        counts[s] += 1
    whole = sum(total.values())
    z = sum((total[s] / whole) ** alpha for s in total)
    blocks = max(1, math.ceil(budget / block_tokens))
    out = []
    for s in total:
        quota, at, copy = math.floor((total[s] / whole) ** alpha / z * budget), 0, 0
        cells = math.ceil(counts[s] / rows_per_cell)
        while at < quota:
            epoch = [(spark_hash(four(seed), four(copy), k, h), k, h, n) for k, x, n, h in live if x == s]
            for h, k, _, n in sorted(epoch, key=lambda e: (e[0] % cells, e[0], e[1] is not None, e[1] or 0, e[2])):
                if at < quota:
                    out.append((at * blocks // quota, spark_hash(four(seed), at * blocks // quota, four(copy), k), k, copy, s))
                at += n
            copy += 1
    placed, seen = [], defaultdict(int)
    for block, _, k, copy, s in sorted(out, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3])):
        placed.append((k, s, copy, block, seen[block]))
        seen[block] += 1
    return placed


@pytest.mark.parametrize("rows_per_cell", [M.ROWS_PER_CELL, 100])
def test_mixture_equals_one_made_document_by_document(spark, monkeypatch, rows_per_cell):
    monkeypatch.setattr(M, "ROWS_PER_CELL", rows_per_cell)
    docs = corpus(spark)
    rows = [(k, s, t, spark_hash(k, s, t, b)) for k, s, t, b in docs.collect()]
    low = solved(list(totals(docs).values()), sum(totals(docs).values()), 0.9, None)
    mixed = M.mix(docs.withColumnRenamed("block", "own"), entropy_share=0.9, max_repetition=None, block_tokens=8000)
    got = sorted(((r["doc_id"], r["source"], r["copy"], r["block"], r["place"]) for r in M.permute(mixed).collect()), key=repr)
    budget = sum(totals(docs).values())
    assert got == sorted(brute(rows, budget, low, 8000, rows_per_cell=rows_per_cell), key=repr)


def test_rows_of_one_key_long_texts_and_ties(spark):
    rows = [(1, "a", f"text {i}", "x") for i in range(50)] + [(1, "a", "same words", "x")] * 30 + [(2, "b", "w " * 200_000, "x"), (3, "b", "end", None)]
    docs = spark.createDataFrame(rows, FIELDS)
    got = M.mix(docs, entropy_share=None, max_repetition=None).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((k, t) for k, _, t, _ in rows)


def test_documents_come_block_by_block_with_their_own_columns(spark):
    docs = corpus(spark)
    plain = M.permute(M.mix(docs.drop("block"), block_tokens=8000, max_repetition=2.0, entropy_share=0.9)).collect()
    mixed = M.mix_documents(docs.drop("block"), block_tokens=8000, entropy_share=0.9)
    runs = defaultdict(list)
    for r in sorted(plain, key=lambda r: (r["block"], r["place"])):
        runs[r["block"]].append((r["doc_id"], r["text"]))
    for part in mixed.rdd.glom().collect():
        ids = [(r["doc_id"], r["text"]) for r in part]
        while ids:
            block = next(b for b, run in runs.items() if ids[: len(run)] == run)
            ids = ids[len(runs.pop(block)) :]
    assert not runs
    assert {r["block"] for r in M.mix_documents(docs).collect()} == {"x"}
