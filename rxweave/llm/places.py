"""Consecutive numbers for the rows of a table in a given order, without a window over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, sized


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], place: str, total: str) -> DataFrame:
    """rows with place (0, 1, 2... within each value of by, in that order) and total, the rows that share the value; both long.

    Rows are dealt out by ranges of (by, order), so a value with many rows is spread over many tasks.  A row's place is its number
    within its task, moved by what earlier tasks hold of the value; the window that sums those runs over one row for each task and value.
    Where rows tie in all of order their places may come either way round; end order with something unique to fix them.
    """
    at, task, n, shift = fresh([*rows.columns, place, total], "at", "task", "n", "shift")
    held = cut(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn(at, F.monotonically_increasing_id()))
    held = held.withColumn(task, F.shiftright(at, 33))
    parts = held.groupBy(*by, task).agg(F.min(at).alias(shift), F.count("*").alias(n))
    all_of = Window.partitionBy(*by)
    before = F.sum(n).over(all_of.orderBy(task).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    parts = parts.select(*by, task, (before - F.col(shift)).alias(shift), F.sum(n).over(all_of).alias(total))
    h, p = held.alias("h"), sized(cut(parts)).alias("p")
    same = F.col(f"h.{task}") == F.col(f"p.{task}")
    for c in by:
        same &= F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}"))
    return h.join(p, same).select("h.*", (F.col(f"h.{at}") + F.col(f"p.{shift}")).alias(place), f"p.{total}").drop(at, task)
