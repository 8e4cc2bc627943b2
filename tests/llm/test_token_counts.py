import random

import pyarrow as pa

from quarry.llm import token_counts as T


def test_pieces_encode_as_the_whole():
    encoder = T._encoder(open(T.VOCABULARY, "rb").read())
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice(["a", "the ", " ", "\n", "  ", "é", "'s", "12", "!!", "\t ", "word "]) for _ in range(500))
        whole = encoder.encode_ordinary(text)
        assert [x for p in T.pieces(text, 40) for x in encoder.encode_ordinary(p)] == whole
        assert "".join(T.pieces(text, 40)) == text
        assert encoder.decode(whole) == text


def test_histogram_answers_every_limit(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(-1, None), (-2, ""), (None, "x"), (5, "x" * 20_000), (5, "many words " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    lengths = [r["n_tokens"] for r in T.token_lengths(docs).collect()]
    assert len(lengths) == len(rows)
    got = {r["n_tokens"]: r for r in T.length_histogram(docs).collect()}
    assert {n: r["docs"] for n, r in got.items()} == {n: lengths.count(n) for n in set(lengths)}
    for n, r in got.items():
        assert r["tokens"] == n * r["docs"]
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert abs(r["share_upto"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    limits = [1, 2, 7, 33, 59, 1000, 10**6]
    for r in T.truncated_totals(T.length_histogram(docs), limits).collect():
        assert r["docs_over"] == sum(x > r["context"] for x in lengths) and r["tokens_kept"] == sum(min(x, r["context"]) for x in lengths)
    for r in T.quantiles(T.length_histogram(docs), [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == min(x for x in lengths if sum(y <= x for y in lengths) / len(lengths) >= r["share"])


def test_lengths_of_null_and_empty_columns_and_tables(spark):
    encoder = T._encoder(open(T.VOCABULARY, "rb").read())
    assert T._lengths(pa.array([None, "", " "], pa.string()), encoder).tolist()[:2] == [0, 0]
    assert T.length_histogram(spark.createDataFrame([], "text string")).collect() == []


def test_long_runs_of_blanks_encode_as_the_whole(monkeypatch):
    encoder = T._encoder(open(T.VOCABULARY, "rb").read())
    monkeypatch.setattr(T, "_LONG_GAP", T.re.compile(rf"[{T.BLANKS}]{{5,}}"))
    rng = random.Random(3)
    for _ in range(60):
        gap = lambda: "".join(rng.choice(" \n\t\r\x0b\x85\xa0 　") for _ in range(rng.choice([1, 2, 4, 5, 6, 40])))
        text = "".join(rng.choice([gap(), "word", "12", "漢字", "'s", "!?", "\x1c"]) for _ in range(60))
        assert T.n_tokens(text, encoder) == len(encoder.encode_ordinary(text))
        assert "".join(p for p, _ in T.parts(text)) == text


def test_texts_of_ten_megabytes_without_a_word_boundary():
    encoder = T._encoder(open(T.VOCABULARY, "rb").read())
    for one in (" ", "\n", "　"):
        n = 10_000_000 // len(one.encode())
        each = len(encoder.encode_ordinary(one * 1000)) / 1000
        assert abs(T.n_tokens(one * n, encoder) - each * n) <= each
        assert T.n_tokens("a" + one * n + "b", encoder) == 1 + T.n_tokens(one * (n - 1), encoder) + len(encoder.encode_ordinary(one + "b"))
    for one in ("a", "漢"):
        text = one * (10_000_000 // len(one.encode()))
        assert T.n_tokens(text, encoder) == len(encoder.encode_ordinary(text))
