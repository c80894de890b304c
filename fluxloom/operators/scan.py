"""Scans of a series that is more than one task: chunks of rows, a short table of what each chunk ends with, then each chunk alone.

A window function over a series puts it in one task. Here the rows of a chunk are a task's, and what a row
needs of earlier or later chunks (the last value seen, a running maximum) comes from one row for each
chunk, over which an ordinary window runs. ``chunk`` must ascend with the order of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import col, keyed_join

DAY = 86_400


def of(keys: Sequence[str]):
    """The series of a window; the whole (short) table without keys."""
    return Window.partitionBy(*[col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))


def day_of(seconds: Column) -> Column:
    return F.floor(seconds / DAY).cast("long")


def neighbours(df: DataFrame, value: Column, order: Sequence[str], chunk: Column, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """``df`` with the last non-null ``value`` at or before a row, and the first at or after it, in the order of ``order``.

    Rows that tie in ``order`` come in any order. Two exchanges by (keys, chunk) of which one is of short rows.
    """
    place = F.struct(*[F.col(c) for c in order])
    held = df.withColumns({"__value": value, "__chunk": chunk})
    known = F.when(F.col("__value").isNotNull(), place)
    ends = held.groupBy(*keys, "__chunk").agg(F.min_by("__value", known).alias("__head"), F.max_by("__value", known).alias("__tail"))
    earlier, later = of(keys).orderBy("__chunk"), of(keys).orderBy(F.col("__chunk").desc())
    carried = ends.select(
        *[col(k) for k in keys], "__chunk",
        F.last("__tail", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("__in"),
        F.last("__head", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, -1)).alias("__out"),
    )
    one = Window.partitionBy(*[col(k) for k in keys], "__chunk")
    there, back = one.orderBy(*order), one.orderBy(*[F.col(c).desc() for c in order])
    grown = Window.unboundedPreceding, Window.currentRow
    both = keyed_join(held, carried, [*keys, "__chunk"])
    found = both.withColumn(before, F.coalesce(F.last("__value", ignorenulls=True).over(there.rowsBetween(*grown)), "__in"))
    # the next value is the last one seen from the end: a frame that grows is one pass
    found = found.withColumn(after, F.coalesce(F.last("__value", ignorenulls=True).over(back.rowsBetween(*grown)), "__out"))
    return found.drop("__value", "__chunk", "__in", "__out")


def running_max(df: DataFrame, value: Column, order: Sequence[str], chunk: Column, keys: Sequence[str], into: str) -> DataFrame:
    """``df`` with the greatest ``value`` at or before a row in the order of ``order``."""
    held = df.withColumns({"__value": value, "__chunk": chunk})
    tops = held.groupBy(*keys, "__chunk").agg(F.max("__value").alias("__top"))
    earlier = of(keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*[col(k) for k in keys], "__chunk", F.max("__top").over(earlier).alias("__in"))
    grown = Window.partitionBy(*[col(k) for k in keys], "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = keyed_join(held, carried, [*keys, "__chunk"])
    return both.withColumn(into, F.greatest(F.max("__value").over(grown), F.col("__in"))).drop("__value", "__chunk", "__in")
