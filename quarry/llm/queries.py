"""Queries of this package's operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.chat_quotes import format_chats
from quarry.llm.decontamination import contained_items
from quarry.llm.language_id import language_id
from quarry.llm.line_dedup import line_dedup
from quarry.llm.mixing import mix, permute, word_tokens
from quarry.llm.ngram_join import ngram_join
from quarry.llm.quality_rules import RULES as RULES_TABLE
from quarry.llm.quality_rules import STOP_WORDS, quality_rules
from quarry.llm.shared import cut
from quarry.llm.sharding import shard_digest
from quarry.llm.token_counts import length_histogram
from quarry.llm.url_filter import BLOCKED, RULES, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"), shards=16)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every drawn document in the mixture's blocks; the budget is the corpus's own number of words."""
    words = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_tokens().alias("words")))
    return permute(mix(words, tokens=F.col("words"), entropy_share=0.97, max_repetition=4.0).drop("words"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds 0.8 or more of the 5-word shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles recur more than longer ones: prefixes are doubled to tell documents apart."""
    return ngram_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100, extra=1.0)


def op6_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later repeats of runs of lines of 50 words or more."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text", "failed")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_ngram_join": op5_ngram_join,
    "op6_chat_quotes": op6_chat_quotes,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles_sql(name: str, rows: str, words: str, k: int) -> str:
    """CTE of the distinct shingles (id, g) of ``rows`` (id, text)."""
    return f"""{name}_w AS (SELECT id, {words} w FROM ({rows})),
{name} AS (SELECT DISTINCT id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+{k - 1}], ' ') END g
 FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) i FROM {name}_w WHERE len(w) > 0))"""


def _decontamination_sql(k: int = 5) -> str:
    words = "regexp_extract_all(" + _LOWER.format("text") + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"
    docs = _shingles_sql("d", "SELECT doc_id id, text FROM documents WHERE text IS NOT NULL", words, k)
    items = _shingles_sql("b", "SELECT item_id id, text FROM benchmark WHERE text IS NOT NULL", words, k)
    return f"""WITH {docs}, {items}, n AS (SELECT id, count(*) n FROM b GROUP BY 1),
s AS (SELECT d.id doc_id, b.id item_id, count(*) shared_shingles FROM d JOIN b USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n item_shingles, shared_shingles, shared_shingles / n containment FROM s JOIN n ON n.id = s.item_id WHERE shared_shingles * 5 >= n * 4"""


def _ngram_join_sql(k: int = 3, num: int = 90, den: int = 100) -> str:
    sets = _shingles_sql("s", "SELECT doc_id id, text FROM documents WHERE text IS NOT NULL", _WORDS.format(_LOWER.format("text")), k)
    return f"""WITH RECURSIVE {sets}, n AS (SELECT id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.id a, b.id b, count(*) o FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE {den} * o >= {num} * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) component_id
FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN (SELECT a, min(b) low FROM r GROUP BY 1) m ON m.a = d.doc_id"""


def _url_filter_sql() -> str:
    order = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order)
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED)
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
h AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path FROM r)
SELECT page_id, host, path, {rule} AS rule, {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END verdict FROM h"""


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ratios = {
        "n_words": "n_words", "mean_word_length": "word_chars / one", "symbol_word_ratio": "n_symbols / one", "stop_word_ratio": "stops / one",
        "upper_letter_ratio": "upper / greatest(letters, 1)", "letter_ratio": "letters / greatest(word_chars, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_word_ratio": "n_repeat_words / one",
    }
    tests = []
    for r in RULES_TABLE:
        bounds = [f"{ratios[r.figure]} < {r.low}"] * (r.low is not None) + [f"{ratios[r.figure]} > {r.high}"] * (r.high is not None)
        tests.append(f"(n_words >= {r.from_words} AND ({' OR '.join(bounds)}))")
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') x FROM documents),
w AS (SELECT doc_id, x, {_WORDS.format("x")} w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) c FROM g) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + 5)) p FROM again) GROUP BY 1),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines, coalesce(cover.n, 0) n_repeat_words, len(l) n_lines, len(list_filter(w, lambda z: z IN ({stops}))) stops,
 length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) upper, length(array_to_string(w, '')) - length(regexp_replace(x, '[\p{{L}} 	-
]', '', 'g')) letters, greatest(len(w), 1) one
 FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR {" OR ".join(tests)}) kept FROM f"""


SQL: dict[str, str] = {
    "op4_decontamination": _decontamination_sql(),
    "op5_ngram_join": _ngram_join_sql(),
    "op7_url_filter": _url_filter_sql(),
    "op10_quality_rules": _quality_sql(),
}
