"""Numbers, running sums and neighbours inside groups of any size, in two levels: cells of the order, and the cells' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], cell: Column, order: list[str], sums: dict[str, Column], index: str | None = None) -> DataFrame:
    """``df`` with the sum of each value over the rows before a row in its group, and the row's number from 0.

    ``cell`` is a number that doesn't fall as rows go on in ``order``: sums run inside a group's
    cell, and over the cells' totals, so a group of a third of all rows spreads over its cells.
    """
    one = F.lit(1).cast("bigint")
    values = {**sums, **({index: one} if index else {})}
    held = df.withColumn("__cell", cell).withColumns({f"__v_{n}": v for n, v in values.items()})
    totals = held.groupBy(*group, "__cell").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = W.partitionBy(*group).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "__cell", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values])
    inside = W.partitionBy(*group, "__cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = held.withColumns({f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in values})
    joined = local.join(offsets, [*group, "__cell"])
    return joined.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in values])


#: Numbers of a cell, where a group is ordered by a number that grows by about one a row.
CELL = 1 << 16
#: Bytes of a cell, where a group is ordered by byte offsets of chunks.
CELL_BYTES = 1 << 28


def text_cell(text: Column, width: int = 4) -> Column:
    """A number that doesn't fall as texts go on: their first ``width`` bytes, 7 at most; -1 for null."""
    head = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, width)), 2 * width, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("bigint"), F.lit(-1).cast("bigint"))


def with_previous(df: DataFrame, group: list[str], cell: Column, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with each value of the row before a row in its group, null for the first.

    As in ``running``, ``cell`` doesn't fall in ``order``. A row looks back inside its cell; the first
    of a cell takes the last of the nearest cell before, found among one row a cell.
    """
    held = df.withColumn("__cell", cell).withColumn("__value", F.struct(*[v.alias(n) for n, v in values.items()]))
    lasts = held.groupBy(*group, "__cell").agg(F.max_by("__value", F.struct(*order)).alias("__last"))
    carried = lasts.select(*group, "__cell", F.lag("__last").over(W.partitionBy(*group).orderBy("__cell")).alias("__carried"))
    inside = F.lag("__value").over(W.partitionBy(*group, "__cell").orderBy(*order))
    joined = held.withColumn("__inside", inside).join(carried, [*group, "__cell"])
    before = F.coalesce("__inside", "__carried")
    return joined.withColumn("__before", before).select(*df.columns, *[F.col(f"__before.{n}").alias(n) for n in values])
