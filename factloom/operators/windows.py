"""Context windows, newest-first selections and running numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.shared import kept


def with_context(facts: DataFrame, n: int = 2, by: tuple[str, ...] = ("project_id", "session_id"), order: str = "ord", content: str = "content") -> DataFrame:
    """Adds `context_window`: the contents of up to n neighbours on each side in one save call, without the fact itself."""
    if n == 0:
        return facts.withColumn("context_window", F.expr("cast(array() as array<string>)"))
    own = Window.partitionBy(*by).orderBy(order)
    return facts.withColumn("context_window", F.concat(F.collect_list(content).over(own.rowsBetween(-n, -1)), F.collect_list(content).over(own.rowsBetween(1, n))))


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order, numbered from 1 in `recency`."""
    return rows.withColumn("recency", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("recency") <= n).withColumn("recency", F.col("recency").cast("long"))


def top(rows: DataFrame, by: list[str], score: str, ties: list[str], n: int | None = None, rank: str = "rank") -> DataFrame:
    """Ranks from 1 by score, highest first; scores that agree to nine digits are ties."""
    out = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), *ties)))
    out = out if n is None else out.where(F.col(rank) <= n)
    return out.withColumn(rank, F.col(rank).cast("long"))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Adds a number from 1 over all rows in the given order, which should leave no ties.

    No task sees all rows: ranges of the order are sorted apart, and a row's number is its place within its range plus the sizes of
    the ranges before it (one number a range on the driver).
    """
    at = F.monotonically_increasing_id()
    held = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33).cast("int")
    sizes = dict(held.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1))])
    offset = F.lit(before.tolist())[part]
    return held.withColumn(name, offset + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at")
