"""Quality rules: a threshold table compiled into one Spark projection, evaluated without user functions.

Every figure of a text is an expression over its array of words or lines, so the whole operator is
one projection over the scan: no shuffle, no Python, no state beyond the row. The 5-word windows
are compared by 64-bit hashes; a text none of whose windows recurs leaves that rule after one
hash-set pass, and only the others sort their windows.

Defined cases: a null or empty text has no words, fails the base and is not kept; null in other
columns is passed through; repeated rows are judged alike; an empty table gives an empty result;
input columns named like figures are replaced by the figures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words.
GAPS = r"[\x20\x09-\x0D]+"
#: The same characters, for trimming.
GAP_CHARS = "\t\n\x0b\x0c\r "
#: Runs of the characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]+"
#: Frequent function words of the languages served; fixed values, in natural order.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "avec", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "ou", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "al", "como", "con", "del", "el", "los", "no", "para", "por", "se", "su", "las", "es", "lo",
)


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: a text of at least ``from_words`` words fails outside [low, high]."""

    figure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The production table. A rule on ratios applies to texts long enough for the ratio to mean something.
RULES = (
    Rule("n_words", 10, None),
    Rule("mean_word_length", 1.5, 25.0),
    Rule("symbol_word_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.01, None, 50),
    Rule("upper_letter_ratio", None, 0.7, 20),
    Rule("letter_ratio", 0.5, None),
    Rule("dup_line_ratio", None, 0.5, 20),
    Rule("repeat_word_ratio", None, 0.2),
)


def _windows(words: Column, width: int) -> Column:
    """Hash of the words from each place on, for every full window."""

    def zipped(h: Column) -> Column:
        n = F.greatest(F.size(h) - (width - 1), F.lit(0))
        return F.transform(F.arrays_zip(*[F.slice(h, j + 1, n) for j in range(width)]), lambda s: F.xxhash64(s))

    return _with(F.transform(words, lambda w: F.xxhash64(w)), zipped)


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words which the array holds twice or more."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            near = lambda i, step: F.get(s, i + step)["h"].eqNullSafe(F.get(s, i)["h"])
            marked = F.transform(s, lambda x, i: F.when(near(i, 1) | ((i > 0) & near(i, -1)), x["i"]))
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        def total(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(width)), F.lit(width))),
                F.lit(0).cast("bigint"), lambda a, x: a + x,
            )

        return _with(_with(pairs, places), total)

    return _with(
        _windows(words, width),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)),
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its figures, ``base_failed``, ``failed`` (the figures that fail) and ``kept``.

    Figures, all long: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(GAP_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAPS, -1))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    made = [*figures, "base_failed", "failed", "kept"]
    base = docs.drop(*[c for c in made if c in docs.columns])
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(GAP_CHARS))) > 0)
    words_name, lines_name = "__quality_words", "__quality_lines"
    counted = (
        base.withColumns({words_name: words, lines_name: lines})
        .withColumns(
            {
                "n_words": F.size(words_name).cast("bigint"),
                "word_chars": F.length(F.regexp_replace(body, GAPS, "")).cast("bigint"),
                "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("bigint"),
                "n_dup_lines": (F.size(lines_name) - F.size(F.array_distinct(lines_name))).cast("bigint"),
                "n_repeat_words": repeated_window_words(F.col(words_name)),
                "__quality_stops": F.size(F.filter(words_name, lambda w: w.isin(*STOP_WORDS))),
                "__quality_marks": F.length(F.regexp_replace(body, r"[^\p{L}\s]+", "")) - F.length(body),
                "__quality_upper": F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", "")),
            }
        )
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.col("word_chars") + F.col("__quality_marks")
    ratios = {
        "n_words": F.col("n_words"),
        "mean_word_length": F.col("word_chars") / n,
        "symbol_word_ratio": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("__quality_stops") / n,
        "upper_letter_ratio": F.col("__quality_upper") / F.greatest(letters, F.lit(1)),
        "letter_ratio": letters / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size(lines_name), F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / n,
    }

    def fails(rule: Rule) -> Column:
        value = ratios[rule.figure]
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        return out & (F.col("n_words") >= rule.from_words)

    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(fails(r), F.lit(r.figure)) for r in rules]), lambda x: x.isNotNull())
    out = counted.withColumns({"base_failed": base_failed, "failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop(
        words_name, lines_name, "__quality_stops", "__quality_marks", "__quality_upper"
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept")
    clash = {c: f"__own_{c}" for c in docs.columns if c in made}
    # A filter that could move below the projection would take a copy of every figure along; one on a row number can't.
    judged = quality_rules(docs.withColumnsRenamed(clash), rules).withColumn("__row", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("__row") >= 0)).select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
