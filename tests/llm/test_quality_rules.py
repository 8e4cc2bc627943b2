import collections
import random
import re

import pytest

from quarry.llm.quality_rules import RULES, Rule, keep_good, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "and", "é", "größe", "x#y", "&&", "<b>", "Zwölf", "a|b"])
    some = ["", None, " \t\n", "one", "\n\na\n\na\n a\n", "a b c d e a b c d e", "a b c d e f a b c d e", "same " * 30, "a\vb\fc\rd", "w " * 50_000, "𝒳 emoji 😀 word"]
    for n in (3, 9, 10, 40, 200):
        some += [" ".join(word() + rng.choice(["", "\n", " ", "\t\t"]) for _ in range(n)) for _ in range(8)]
    return some


def test_figures_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        r, e = got[i], figures(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e, (i, text)
        assert r["base_failed"] == (e[0] < 10 or 100 * e[4] > 20 * e[0])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("text, reason", [
    ("THE CAT SAT ON THE MAT AND THEN IT RAN OFF TO FIND A NEW HAT FOR THE DOG TODAY", "upper_letter_ratio"),
    ("the ##% and $$$ of ||| to <<< in &&& on *** at the end of all this", "symbol_word_ratio"),
    ("12 34 56 78 90 11 22 33 44 55 66 77 88", "letter_ratio"),
])
def test_rules_name_what_fails(spark, text, reason):
    row = quality_rules(spark.createDataFrame([(text,)], "text string")).first()
    assert reason in row["failed"] and not row["kept"]


def test_clean_texts_are_kept_and_rules_are_a_table(spark):
    clean = "The quick brown fox runs over the lazy dog and then it rests in the shade of a tree."
    docs = spark.createDataFrame([(clean,)], "text string")
    assert quality_rules(docs).first()["kept"]
    assert not quality_rules(docs, (*RULES, Rule("n_words", 100, None))).first()["kept"]


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "The fox runs over the dog and rests in the shade of it", "mine", True)], "doc_id bigint, text string, kept string, n_words boolean")
    assert keep_good(docs).collect() == docs.collect()
    assert quality_rules(docs).first()["n_words"] == 13
    assert quality_rules(docs.limit(0)).collect() == [] and keep_good(docs.limit(0)).columns == docs.columns


def test_repeated_rows_are_judged_alike(spark):
    docs = spark.createDataFrame([(1, "The fox runs over the dog and rests in the shade of it")] * 3 + [(1, None), (None, "same " * 30)] * 2, "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in quality_rules(docs).collect())
    assert got == [(0, 30, False)] * 2 + [(1, 0, False)] * 2 + [(1, 13, True)] * 3 and keep_good(docs).count() == 3
