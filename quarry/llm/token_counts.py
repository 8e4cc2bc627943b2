"""Exact histogram of encoded lengths, whose suffix sums answer totals, quantiles and truncated totals for every context limit.

Texts are encoded whole by a published byte-level vocabulary; only (length, documents) pairs leave
a task. A row of the result is a length that occurs, with the documents and tokens of that length,
of all lengths from it on, and the total that stays when every document is cut to that length. A
limit between two lengths is answered by the next row: see ``truncated_totals``.

Defined cases: null and empty texts have no tokens and count as documents of length 0; texts of any
length are encoded whole, long ones in pieces that encode alike, runs of blanks of any length too;
other columns aren't read, whatever their names; repeated rows and equal lengths count each; an empty
table gives an empty histogram. The sums over groups of lengths run in one task: it has as many rows
as the longest text has tokens, by ``GROUP``, however many documents there are.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import cut

#: Vocabulary in rank-file form.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern that splits a text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are encoded in pieces, cut where the pattern always cuts.
PIECE_CHARS = 200_000
#: Blanks in a row from this many on are encoded apart, as the pattern's look-ahead would go back over each of them.
GAP_CHARS = 4096
#: Lengths of a group of the two-level suffix sums.
GROUP = 64
#: The characters that the pattern takes as blanks (the Unicode property White_Space).
BLANKS = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_SAFE_CUT = re.compile(rf"[{BLANKS}](?=[^{BLANKS}])")
_LONG_GAP = re.compile(rf"[{BLANKS}]{{{GAP_CHARS},}}")


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of a text that encode apart as they do together: the last blank before another character always begins a new match."""
    at = 0
    while len(text) - at > most:
        found = _SAFE_CUT.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one long run of blanks) of a text: the pattern takes such a run whole, but for its last blank where more follows."""
    at = 0
    for gap in _LONG_GAP.finditer(text):
        end = gap.end() - (gap.end() < len(text))
        if gap.start() > at:
            yield from ((p, False) for p in pieces(text[at : gap.start()]))
        yield text[gap.start() : end], True
        at = end
    if at < len(text):
        yield from ((p, False) for p in pieces(text[at:]))


def n_tokens(text: str | None, encoder) -> int:
    """Tokens of a whole text of any length."""
    return sum(len(encoder._encode_single_piece(p) if gap else encoder.encode_ordinary(p)) for p, gap in parts(text or ""))


def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lengths(column: pa.Array, encoder) -> np.ndarray:
    return np.fromiter((n_tokens(x.as_py(), encoder) for x in column), dtype=np.int64, count=len(column))


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as file:  # a published vocabulary has under 2 MB
        return docs.sparkSession.sparkContext.broadcast(file.read())


def token_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row."""
    held = _vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_lengths(batch.column(1), encoder))], names=[key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def length_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length."""
    held = _vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(held.value)
            lengths, n = np.unique(_lengths(batch.column(0), encoder), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(n.astype(np.int64))], names=["n_tokens", "docs"])

    return docs.select(text).mapInArrow(run, "n_tokens bigint, docs bigint").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram: n_tokens, docs, tokens, docs_from, tokens_from, truncated_total, share_upto.

    Sums run inside groups of lengths and over the totals of groups, so no task holds all lengths.
    """
    rows = counts.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / GROUP).alias("g"))
    groups = rows.groupBy("g").agg(F.sum("docs").alias("gd"), F.sum("tokens").alias("gt"))
    every = W.partitionBy(F.lit(0))
    later = every.orderBy(F.desc("g")).rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select(
        "g",
        F.coalesce(F.sum("gd").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("gt").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("gd").over(every).alias("all_docs"),
        F.sum("gt").over(every).alias("all_tokens"),
    )
    inside = W.partitionBy("g").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumns({"id": F.sum("docs").over(inside), "it": F.sum("tokens").over(inside)}).join(groups, "g")
    docs_from, tokens_from = F.col("later_docs") + F.col("id"), F.col("later_tokens") + F.col("it")
    return summed.select(
        "n_tokens",
        "docs",
        "tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_total"),
        ((F.col("all_docs") - docs_from + F.col("docs")) / F.col("all_docs")).alias("share_upto"),
    )


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The histogram of all texts, each encoded once."""
    return suffix_sums(cut(length_counts(docs, text, vocabulary)))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, tokens_kept): documents longer than each limit, and tokens left when documents are cut to it."""
    total = F.sum("tokens")
    over = F.col("n_tokens") > F.col("context")
    first = F.min_by(F.struct("docs_from", "tokens_from"), F.when(over, F.col("n_tokens")))
    docs_over = F.coalesce(first["docs_from"], F.lit(0))
    return (
        histogram.withColumn("context", F.explode(F.array(*[F.lit(x).cast("bigint") for x in limits])))
        .groupBy("context")
        .agg(total.alias("total"), docs_over.alias("docs_over"), F.coalesce(first["tokens_from"], F.lit(0)).alias("tokens_over"))
        .select("context", "docs_over", (F.col("total") - F.col("tokens_over") + F.col("context") * F.col("docs_over")).alias("tokens_kept"))
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least that share of documents doesn't exceed."""
    return (
        histogram.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
        .filter("share_upto >= share")
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
