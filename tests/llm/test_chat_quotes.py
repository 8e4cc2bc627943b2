import random
import re

from quarry.llm.chat_quotes import format_chats, link_quotes, normalised, parse, runs

FIELDS = "conv_id bigint, turn bigint, role string, text string, depth string"


def test_levels_and_introductions():
    text = "Hello\nAnna wrote:\n> first\n> second\n>> deeper\n> > also deep\n> back\nmine again"
    assert parse(text) == [(0, "Hello"), (1, "first\nsecond"), (2, "deeper\nalso deep"), (1, "back"), (0, "mine again")]
    assert parse(None) == parse("") == [(0, "")]
    assert normalised("  A  b\n C ") == "a b c"


def test_conversations_are_reply_ordered_without_quotes(spark):
    rows = [
        (1, 0, "u", "What is it?"), (1, 1, "a", "It is a thing.\n\nA second part."), (1, 2, "u", "> It is a thing.\nwhich?"), (1, 3, "a", "> what IS  it?\nanother answer"),
        (1, 4, "u", ">> It is a thing.\n> which?\nthat one"), (1, 5, "u", "> never said\nhm"), (1, 6, "u", "> a future line\nno"), (1, 7, "u", "a future line"), (1, 8, "u", "> A second part.\nyes"),
        (2, 0, "u", "> It is a thing.\nother conversation"), (2, 1, "a", None), (2, 1, "a", "twice"), (None, 0, "u", "no conversation"), (3, None, "u", "> x\nno turn"),
    ]
    got = format_chats(spark.createDataFrame([(*r, "x") for r in rows], FIELDS)).collect()
    assert len(got) == len(rows)
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert {t: r["parent_turn"] for t, r in one.items()} == {0: None, 1: None, 2: 1, 3: 0, 4: 2, 5: None, 6: None, 7: None, 8: 1}
    assert one[4]["depth"] == 2 and one[4]["root_turn"] == 1
    assert [t for t, _ in sorted(one.items(), key=lambda x: (x[1]["root_turn"], x[0]))] == [0, 3, 1, 2, 4, 8, 5, 6, 7]
    assert one[2]["text"] == "which?" and one[4]["n_quotes"] == 2 and one[4]["n_linked"] == 2 and one[5]["n_linked"] == 0
    two = [r for r in got if r["conv_id"] == 2]
    assert {r["text"] for r in two} == {"other conversation", None, "twice"} and all(r["parent_turn"] is None for r in two)


def test_long_chains_and_hot_conversations(spark):
    rows = [(1, i, "u", (f"> note {i - 1}\n" if i else "") + f"note {i}", "x") for i in range(70)]
    rows += [(9, i, "u", "same words", "x") for i in range(500)] + [(9, 500, "u", "> same words\nreply", "x")]
    got = link_quotes(spark.createDataFrame(rows, FIELDS)).collect()
    assert {r["turn"]: (r["root_turn"], r["depth"]) for r in got if r["conv_id"] == 1} == {i: (0, i) for i in range(70)}
    assert next(r for r in got if r["turn"] == 500)["parent_turn"] == 0
    assert link_quotes(spark.createDataFrame(rows, FIELDS).limit(0)).collect() == []


def test_quotes_of_some_lines_link_to_the_earliest_message_that_holds_them(spark):
    whole = "First part\nin two lines.\n\nSecond  part.\n\nThird part,\nwith three\nlines."
    texts = [
        "hello", whole, whole, "> First part\n> in two lines.\n>\n> Second part.\nyes", "> Third part,\n> with three\nno", "> Second part.\n>\n> Third part,\n> with three\n> lines.\nwhy",
        "> in two lines.\n> Third part,\nnot in a row", "> hello\nA block\nof lines\n> First part\nAnother one\nof two", "> Another one\n> of two\nok", "> A block\n> of lines\nok", "> part\n> in two\nnot whole lines",
    ]
    got = link_quotes(spark.createDataFrame([(1, i, "u", t, "x") for i, t in enumerate(texts)], FIELDS)).collect()
    assert {r["turn"]: r["parent_turn"] for r in got} == {0: None, 1: None, 2: None, 3: 1, 4: 1, 5: 1, 6: None, 7: 0, 8: 7, 9: 7, 10: None}


def test_runs_are_of_whole_lines():
    assert runs("a b\n\nC\nd e", {1, 3, 9}) == {"c", "a b c", "c d e"} and runs("", {1}) == set()


def conversation(rng):
    """Messages with paragraphs, and replies that quote lines in a row, whole messages with their quotes, or re-wrapped paragraphs."""
    line = lambda: " ".join(rng.choice(["red", "Blue", "green", "sun", "Moon", "tree", "lake"]) for _ in range(rng.randrange(1, 7)))
    texts = []
    for _ in range(rng.randrange(2, 14)):
        out = []
        for _ in range(rng.randrange(1, 4)):
            if texts and rng.random() < 0.6:
                old = rng.choice(texts).split("\n")
                how = rng.random()
                if how < 0.4:
                    a = rng.randrange(len(old))
                    out += ["> " + x for x in old[a : a + rng.randrange(1, 5)]]
                elif how < 0.6:
                    out += [rng.choice([">", "> ", " >"]) + x for x in old]
                else:
                    own = " ".join(x for x in old if not x.lstrip().startswith(">")).split()
                    while own:
                        n = rng.randrange(1, 6)
                        out.append("> " + "  ".join(own[:n]).upper())
                        own = own[n:]
                if rng.random() < 0.3:
                    out.insert(0, "x" * rng.choice([3, 400]) + " wrote:")
            out += [line() for _ in range(rng.randrange(0, 4))] + [""] * rng.randrange(0, 2)
        texts.append("\n".join(out))
    return texts


def brute(texts):
    """(parent, root, depth, linked) of each message, quote by quote against every run of earlier messages' own lines."""
    split = []
    for text in texts:
        lines = []
        for x in text.split("\n"):
            marks = re.match(r"\s{0,3}(>\s?)+", x)
            lines.append((marks[0].count(">"), x[marks.end() :]) if marks else (0, x))
        kept = [(n, x) for i, (n, x) in enumerate(lines) if not (x.strip().lower().endswith("wrote:") and i + 1 < len(lines) and lines[i + 1][0] > n)]
        split.append(kept)
    own = [[" ".join(x.lower().split()) for n, x in lines if n == 0 and x.split()] for lines in split]
    out = []
    for i, lines in enumerate(split):
        quotes, before = [], 0
        for n, x in lines:
            if n and n == before:
                quotes[-1][1].extend(x.lower().split())
            elif n:
                quotes.append((n, x.lower().split()))
            before = n
        found = []
        for level, words in quotes:
            holders = [j for j in range(i) for a in range(len(own[j])) for b in range(a + 1, len(own[j]) + 1) if words and " ".join(own[j][a:b]) == " ".join(words)]
            if holders:
                found.append((level, min(holders)))
        parent = min(found, key=lambda q: q[0])[1] if found else None
        root, depth = (i, 0) if parent is None else (out[parent][1], out[parent][2] + 1)
        out.append((parent, root, depth, len(found)))
    return out


def test_links_equal_brute_force_on_generated_conversations(spark):
    rng = random.Random(12)
    all_texts = {f"c-{c}": conversation(rng) for c in range(150)}
    rows = [(c, str(t), "u", x, "e") for c, texts in all_texts.items() for t, x in enumerate(texts)] + [("c-0", "none", "u", "> odd turn\nown", "e")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string, extra string").repartition(3)
    got = format_chats(docs).collect()
    expected = {(c, str(t)): x for c, texts in all_texts.items() for t, x in enumerate(brute(texts))}
    assert sum(x[0] is not None for x in expected.values()) > 100 and max(x[2] for x in expected.values()) > 2
    assert {(r["conv_id"], r["turn"]): (r["parent_turn"], r["root_turn"], r["depth"], r["n_linked"]) for r in got if r["turn"] != "none"} == expected
    odd = next(r for r in got if r["turn"] == "none")
    assert (odd["text"], odd["parent_turn"], odd["root_turn"], odd["depth"], odd["extra"]) == ("own", None, None, 0, "e")


def test_very_long_texts_ties_and_repeated_rows(spark):
    long = "\n".join(f"line {i}" for i in range(30_000))
    rows = [(1, 0, "u", long, "x"), (1, 1, "u", "> line 29998\n> line 29999\nend", "x"), (1, 1, "u", "> line 29998\n> line 29999\nend", "x")]
    rows += [(2, 0, "u", "same", "x"), (2, 0, "u", "same", "x"), (2, 0, "u", "other", "x"), (2, 3, "u", "> same\na", "x"), (2, 3, "u", "> other\nb", "x"), (2, 4, "u", "> b\nc", "x")]
    got = format_chats(spark.createDataFrame(rows, FIELDS)).collect()
    assert sorted((r["conv_id"], r["turn"], r["parent_turn"], r["depth"]) for r in got if r["turn"]) == [(1, 1, 0, 1)] * 2 + [(2, 3, 0, 1)] * 2 + [(2, 4, 3, 2)]
    assert next(r for r in got if r["conv_id"] == 1 and r["turn"] == 0)["text"] == long
