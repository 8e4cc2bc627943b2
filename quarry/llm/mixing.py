"""Mixing sources to target weights by a temperature, drawn as block permutations of a token budget.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected to meet a
target entropy (a fraction of the largest), a limit on how often a source repeats within the
budget, or both. Sixteen-way bisection evaluates fifteen exponents in one aggregation over the
per-source totals. The limit always holds: a budget that no exponent can keep within it is an error,
and where entropy and limit contradict each other, alpha is the least that keeps the limit and a
warning tells the entropy that is left. Each source is then a stream of epochs, each a permutation of
its documents by hash; the stream is cut where the source's share of the budget ends, and dealt evenly
over the blocks, so that every block has the target mix. Positions in a stream are prefix sums made in
two levels, cells of the hash and rows inside a cell; a source has as many cells as its rows need to
stay near ``ROWS_PER_CELL`` a cell, so that a hot source spreads over many tasks.

Only DataFrame functions run here. Defined cases: rows without tokens (null, empty or blank texts)
are never drawn; a text of any length is drawn whole, so a stream ends with the document that its
quota's last token lies in; a null source is a source of its own; rows that repeat a key, or are
equal in all columns, count each, and ties of their hash are broken by all other columns; an empty
table gives an empty result; input columns named like results are replaced.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import cut

#: Rows of a cell of a source's epoch, about: prefix sums run inside a cell.
ROWS_PER_CELL = 4096
#: Most sources whose weights are broadcast (about 40 bytes each); more are joined by shuffles.
BROADCAST_SOURCES = 100_000
GAPS = r"[\x20\x09-\x0D]+"


def word_tokens(text: str = "text") -> Column:
    """Words of a text, as its tokens."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit("\t\n\x0b\x0c\r "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAPS, -1))).cast("bigint")


def solve_alpha(totals: DataFrame, budget: int, entropy_share: float | None, max_repetition: float | None, rounds: int = 8) -> float:
    """The largest exponent whose weights reach the entropy, or the smallest that keeps the limit, whichever is larger.

    ``totals`` has ``share`` and ``total`` of each source. Entropy falls and the largest
    repetition falls as alpha grows to 1, where every source repeats alike, so each condition is
    met on one side of its root, and a limit that 1 doesn't keep can't be kept.
    """
    sums = totals.agg(F.count("*"), F.sum("total")).first()
    n, whole = sums[0], sums[1] or 0
    if max_repetition is not None and budget > max_repetition * whole and n:
        raise ValueError(f"a budget of {budget} tokens draws {whole} tokens more than {max_repetition} times whatever the weights")
    if n < 2:
        return 1.0

    def figures(grid: list[float]) -> dict[float, tuple[float, float]]:
        """(entropy, largest repetition) at each exponent."""
        power = F.pow("share", F.col("alpha"))
        rows = (
            totals.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in grid])))
            .groupBy("alpha")
            .agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("e"), F.max(power / F.col("total")).alias("m"))
            .select(
                "alpha",
                (F.log("z") - F.col("alpha") * F.col("e") / F.col("z")).alias("entropy"),
                (F.col("m") / F.col("z") * budget).alias("repetition"),
            )
            .collect()
        )
        return {r["alpha"]: (r["entropy"], r["repetition"]) for r in rows}

    def bisect(kind: str) -> float:
        low, high = 0.0, 1.0
        for _ in range(rounds):
            grid = [low + (high - low) * i / 16 for i in range(16)] + [high]
            by = figures(grid)
            if kind == "entropy":
                good = [a for a in grid if by[a][0] >= entropy_share * math.log(n)]
                low = max(good, default=0.0)
                high = min((a for a in grid if a > low), default=low)
            else:
                good = [a for a in grid if by[a][1] <= max_repetition]
                high = min(good, default=1.0)  # at 1 all sources repeat alike, within the limit as checked above
                low = max((a for a in grid if a < high), default=high)
            if low == high:
                break
        return low if kind == "entropy" else high

    reached = None if entropy_share is None else bisect("entropy")
    kept = None if max_repetition is None else bisect("repetition")
    if reached is not None and kept is not None and kept > reached:
        left = figures([kept])[kept][0] / math.log(n)
        warnings.warn(f"at most {max_repetition} repeats leave an entropy of {left:.4f} of the largest, below the target of {entropy_share}", stacklevel=2)
    return max((x for x in (reached, kept) if x is not None), default=1.0)


def mix(
    docs: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    tokens: Column | None = None,
    budget: int | None = None,
    entropy_share: float | None = 0.97,
    max_repetition: float | None = 4.0,
    block_tokens: int = 1 << 18,
    seed: int = 11,
) -> DataFrame:
    """The drawn rows of ``docs`` with n_tokens, copy (epoch, from 0), weight and block.

    ``budget`` is in tokens, by default those of the whole table. A document is drawn where its
    first token lies inside its source's share of the budget. Rows move once, to their cells.
    """
    docs = docs.drop("n_tokens", "copy", "weight", "block")
    group = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    counted = docs.withColumns({"n_tokens": tokens if tokens is not None else word_tokens(), "__group": group, "__row": row_hash(docs)}).filter("n_tokens > 0")
    totals = cut(counted.groupBy("__group").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("__rows")))
    whole = totals.agg(F.sum("total")).first()[0] or 0
    budget = whole if budget is None else budget
    shares = totals.withColumn("share", F.col("total") / F.lit(max(whole, 1)))
    alpha = solve_alpha(shares, budget, entropy_share, max_repetition)
    z = shares.agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0] or 1.0
    weights = shares.select(
        "__group",
        "total",
        (F.pow("share", F.lit(alpha)) / z).alias("weight"),
        F.floor(F.pow("share", F.lit(alpha)) / z * budget).cast("bigint").alias("__quota"),
        F.ceil(F.col("__rows") / ROWS_PER_CELL).alias("__cells"),
    )
    if shares.count() <= BROADCAST_SOURCES:
        weights = F.broadcast(weights)
    blocks = max(1, math.ceil(budget / block_tokens))

    def placed(rows: DataFrame) -> DataFrame:
        """``rows`` for each epoch that they may be drawn in, with their hash and cell."""
        epochs = F.sequence(F.lit(0), (F.ceil(F.col("__quota") / F.col("total")) - 1).cast("int"))
        drawn = rows.join(weights, "__group").filter("__quota > 0").withColumn("copy", F.explode(epochs))
        return drawn.withColumn("__hash", F.xxhash64(F.lit(seed), "copy", key, "__row")).withColumn("__cell", F.pmod("__hash", F.col("__cells")))

    # The sums by cell need no texts: they are a second, narrow pass over the scan.
    cells = placed(counted.select("__group", key, "__row", "n_tokens")).groupBy("__group", "copy", "__cell").agg(F.sum("n_tokens").alias("__sum"))
    before = W.partitionBy("__group").orderBy("copy", "__cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select("__group", "copy", "__cell", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__group", "copy", "__cell").orderBy("__hash", key, "__row").rowsBetween(W.unboundedPreceding, -1)
    return (
        placed(counted).withColumn("__inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, ["__group", "copy", "__cell"])
        .withColumn("__start", F.col("__before") + F.col("__inside"))
        .filter("__start < __quota")
        .withColumn("block", F.floor(F.col("__start").cast("decimal(38,0)") * blocks / F.col("__quota")).cast("bigint"))
        .select(*docs.columns, "n_tokens", "copy", "weight", "block")
    )


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row: tells apart rows that share a key."""
    return F.xxhash64(*[F.col(c) for c in docs.columns])


def permutation(key: str, seed: int) -> list[Column]:
    """What sorts the rows of a block."""
    return [F.xxhash64(F.lit(seed), "block", "copy", key), F.col(key), F.col("copy")]


def permute(mixed: DataFrame, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """``mixed`` with each row's place in the permutation of its block; a block holds a bounded number of tokens."""
    order = W.partitionBy("block").orderBy(*permutation(key, seed))
    return mixed.withColumn("place", F.row_number().over(order).cast("bigint") - 1)


def mix_documents(docs: DataFrame, max_repetition: float = 2.0, key: str = "doc_id", seed: int = 11, **options) -> DataFrame:
    """The drawn rows with the columns of ``docs`` only, block by block; a source that is drawn twice has its rows twice.

    A partition holds whole blocks, each in the order of its permutation, and so does a file that is
    written of it.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c in ("n_tokens", "copy", "weight", "block")}
    mixed = mix(docs.withColumnsRenamed(own), max_repetition=max_repetition, key=key, seed=seed, **options)
    dealt = mixed.repartition("block").sortWithinPartitions("block", *permutation(key, seed))
    return dealt.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
