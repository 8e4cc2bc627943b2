import random
import zlib
from collections import Counter

import numpy as np
import xxhash

from quarry.llm import language_id as L

SAMPLES = {"en": "the cat and the dog were in the house with that other thing", "de": "der hund und die katze sind nicht in dem haus mit einer maus", "fr": "le chat et le chien sont dans la maison avec une souris très"}


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lang = rng.choice(list(SAMPLES))
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 80))), lang))
    return rows + [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "the dog and the cat", None), (None, "der hund und die maus", "fr"), (1003, "", "de"), (1004, "the dog " * 50_000, "en")]


def test_held_out_texts_are_told_apart(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in L.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        if i is not None:
            assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if i is not None and i < 1000 and got[i]["held_out"]]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1003)] == [("und", 0.0)] * 3
    assert got[1002]["lang_pred"] == "en" and got[None]["lang_pred"] == "de" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_ranks_and_distance_equal_a_plain_version():
    profiles = {k: L.top(*L.ngrams(np.frombuffer(v.encode(), dtype=np.uint8)), 30) for k, v in SAMPLES.items()}
    table = L.Profiles(profiles, 30)
    for text in SAMPLES.values():
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        own = L.top(*L.ngrams(data), 30).tolist()
        far = {}
        for name, codes in profiles.items():
            place = {c: i for i, c in enumerate(codes.tolist())}
            far[name] = sum(abs(place[c] - i) if c in place else 30 for i, c in enumerate(own))
        best = min(sorted(far), key=far.get)
        assert table.predict(data) == (best, 1 - far[best] / (len(own) * 30))


def test_nothing_learnt_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert L.language_id(docs).first()["lang_pred"] == "und"
    assert L.language_id(docs.limit(0)).collect() == []


def plain_ngrams(text):
    """Counts of the byte n-grams of a text, coded by their bytes and length."""
    fold = lambda b: b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
    b = [32, *map(fold, text.encode()), 32]
    out = Counter(x for x in b if x != 32)
    out.update((1 << 30) | (x << 8) | y for x, y in zip(b, b[1:]) if (x, y) != (32, 32))
    out.update((1 << 31) | (x << 16) | (y << 8) | z for x, y, z in zip(b, b[1:], b[2:]) if y != 32)
    return out


def ranked(counts, size=L.PROFILE):
    return [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def brute(rows, per_language):
    """(language, score) of every row, learnt and compared n-gram by n-gram."""
    def h(i, t):
        x = xxhash.xxh64(t.encode(), seed=xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=42).intdigest()).intdigest()
        return x - (1 << 64) if x >> 63 else x

    labelled = {}
    for i, t, lang in rows:
        if None not in (i, t, lang) and zlib.crc32(str(i).encode()) % 4 != 2:
            labelled.setdefault(lang, {})[h(i, t)] = t
    profiles = {}
    for lang, texts in labelled.items():
        counts = sum((plain_ngrams(texts[x]) for x in sorted(texts)[:per_language]), Counter())
        profiles[lang] = {c: n for n, c in enumerate(ranked(counts))}
    out = []
    for _, t, _ in rows:
        own = ranked(plain_ngrams(t or ""))
        if not any(c.isalpha() for c in t or "") or not profiles:
            out.append(("und", 0.0))
        else:
            far = {lang: sum(abs(p[c] - n) if c in p else L.PROFILE for n, c in enumerate(own)) for lang, p in profiles.items()}
            best = min(sorted(far), key=far.get)
            out.append((best, 1 - far[best] / (len(own) * L.PROFILE)))
    return out


def test_predictions_equal_brute_force(spark):
    """With ties, repeated rows, rows of one key, long texts, and columns that clash with inner names."""
    rows = corpus() + corpus()[:40] + [(7, "the other dog", "en"), (7, "der andere hund", "de"), (2000, "zzz", "qa"), (2001, "zzz", "qb"), (2002, "zzz", None)]
    for per_language in (3, 25, 2000):
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, held_out string, score int").repartition(5)
        got = L.identify(docs, L.learn(docs, per_language=per_language))
        expected = [(i, *p) for (i, _, _), p in zip(rows, brute(rows, per_language))]
        assert sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()), key=repr) == sorted(expected, key=repr)
