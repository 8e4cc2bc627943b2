import collections
import os
import unicodedata

import pytest
from test_decontamination import grams
from test_mixing import brute as mixture
from test_mixing import solved, spark_hash
from test_ngram_join import brute as components
from test_quality_rules import WORD, figures

import corpus_pipeline
from quarry.llm import sharding
from quarry.llm.decontamination import contained_items
from quarry.llm.ngram_join import ngram_join
from quarry.llm.quality_rules import RULES, STOP_WORDS, quality_rules


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage gives, stage by stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs.toPandas())
    return out


def test_stages_are_those_of_the_job_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_every_stage_keeps_the_columns_of_documents(stages):
    for frame in stages[1:-1]:
        assert list(frame.columns) == list(stages[0].columns)
    assert list(stages[-1].columns) == [*stages[0].columns, "shard", "slot"]


def test_each_stage_does_its_part_on_its_own_input(spark, sf_dir, stages):
    make = lambda frame: spark.createDataFrame(frame)
    good = {r["doc_id"] for r in quality_rules(make(stages[0])).filter("kept").collect()}
    assert set(stages[1]["doc_id"]) == good < set(stages[0]["doc_id"])
    firsts = {r["doc_id"] for r in ngram_join(make(stages[1]), k=5, num=4, den=5).filter("doc_id = component_id").collect()}
    assert sorted(stages[2]["doc_id"]) == sorted(firsts)
    hits = {r["doc_id"] for r in contained_items(make(stages[2]), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert set(stages[3]["doc_id"]) == set(stages[2]["doc_id"]) - hits
    assert set(stages[4]["doc_id"]) <= set(stages[3]["doc_id"]) and len(stages[4]) > 0.5 * len(stages[3])
    assert sorted(stages[5]["doc_id"]) == sorted(stages[4]["doc_id"])
    sizes = stages[5].groupby("shard").size().reindex(range(16), fill_value=0)
    assert sizes.max() - sizes.min() <= 1


def kept_by_rules(text):
    """The rules' verdict, figure by figure."""
    n, chars, symbols, dup_lines, repeats = figures(text)
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    letters, upper = (sum(unicodedata.category(c) in kinds for c in text or "") for kinds in (("Lu", "Ll", "Lt", "Lm", "Lo"), ("Lu",)))
    ratios = {
        "n_words": n, "mean_word_length": chars / max(n, 1), "symbol_word_ratio": symbols / max(n, 1), "stop_word_ratio": sum(w in STOP_WORDS for w in words) / max(n, 1),
        "upper_letter_ratio": upper / max(letters, 1), "letter_ratio": letters / max(chars, 1), "dup_line_ratio": dup_lines / max(len(lines), 1), "repeat_word_ratio": repeats / max(n, 1),
    }
    bad = [r for r in RULES if n >= r.from_words and (r.low is not None and ratios[r.figure] < r.low or r.high is not None and ratios[r.figure] > r.high)]
    return not (n < 10 or 100 * repeats > 20 * n or bad)


def brute(docs, items):
    """(doc_id, text, shard, slot) of the pipeline by plain loops over all documents; ``docs`` has rows (doc_id, text, lang, source, n_chars)."""
    docs = [d for d in docs if kept_by_rules(d[1])]
    component = components([(d[0], d[1]) for d in docs], 5, 4, 5)
    docs = [d for d in docs if component[d[0]][1] == d[0]]
    items = [g for g in map(grams, items) if g]
    docs = [d for d in docs if not any(5 * len(g & own) >= 4 * len(g) for own in (grams(d[1]),) for g in items)]
    totals = collections.Counter()
    for d in docs:
        totals[d[3]] += len(WORD.findall(d[1]))
    budget = sum(totals.values())
    alpha = solved(list(totals.values()), budget, 0.97, 2.0)
    drawn = mixture([(d[0], d[3], d[1], spark_hash(*d)) for d in docs], budget, alpha, 1 << 18)
    text = {d[0]: d[1] for d in docs}
    nodes, room = sharding.ring(16, 64), sharding.capacities(len(drawn), 16, 0.0)
    filled, out, over = [0] * 16, [], []

    def put(key, shard):
        out.append((key, text[key], shard, filled[shard]))
        filled[shard] += 1

    spots = sorted((spark_hash(k) % (1 << 64) >> 64 - sharding.CELL_BITS, spark_hash(k), k) for k, *_ in drawn)
    for cell, _, key in spots:
        at = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        put(key, nodes[at][1]) if filled[nodes[at][1]] < room[nodes[at][1]] else over.append((key, at))
    for key, at in over:
        put(key, next(s for s in (nodes[(at + i) % len(nodes)][1] for i in range(len(nodes))) if filled[s] < room[s]))
    return out


def test_run_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    expected = brute(docs, items)
    assert len(expected) > 100
    assert sorted((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got) == sorted(expected)


def test_empty_documents_go_through(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
