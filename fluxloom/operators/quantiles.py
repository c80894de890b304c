"""Exact quantiles in bounded memory, by selection over a few passes.

``percentile`` keeps a count of every distinct value of a group in one task. Here a pass counts the values in
BUCKETS buckets of the interval that holds a wanted rank, keeps the bucket with the rank, and the next pass
cuts that one, until a bucket holds one value. Tasks hold at most BUCKETS counts for each open interval, and
only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir, stored
from .clean import col, keyed_join

#: Buckets of an interval in one pass, and passes after which something is wrong.
BUCKETS, PASSES = 1024, 200


def bucket(x: Column, lo: Column, hi: Column, number: int) -> Column:
    """A bucket that ascends with x. Passes take turns: equal widths, then widths that double away from ``lo``.

    So a value far from all others costs one pass, and values of all magnitudes no more than a few.
    """
    # halves, so that nothing overflows; of two numbers so near zero that their halves are equal, the upper one counts as the end
    share = F.coalesce(F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2), F.when(x > lo, 1.0).otherwise(0.0))
    even = F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS))
    log = F.when(share > 0, F.greatest(F.lit(1), F.lit(BUCKETS) + F.floor(F.log2(share) * (1 if number % 4 == 1 else 32)))).otherwise(0)
    return F.when(lo == hi, 0).otherwise(even if number % 2 == 0 else log).cast("int")


def selected_quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, variable, quantiles): what ``percentile(column, shares, weight)`` gives, for each column of each series.

    Linear between the two values next to a rank. Nulls, NaN and infinities are left out, and rows whose weight is null
    or not positive; a column without values has no row here. The narrow rows are written once to the shared folder.
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    keys, names = list(keys), [*keys, "variable"]
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    listed = F.array(*[F.struct(F.lit(c).alias("variable"), col(c).cast("double").alias("x")) for c in cols])
    narrow = df.select(*[col(k) for k in keys], w.alias("w"), F.explode(listed).alias("__e")).select(*keys, "w", "__e.variable", "__e.x")
    rows = stored(narrow.where((F.col("w") > 0) & (F.abs("x") < float("inf"))), folder, "values")  # false for null and NaN, which is above all numbers

    # wanted: (keys, variable, rank), rank counted from 0 within the interval [lo, hi]
    whole = rows.groupBy(*names).agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    ranks = F.array_distinct(F.array(*[c.cast("long") for a in at for c in (F.floor(a), F.ceil(a))]))
    wanted = stored(whole.select(*names, "lo", "hi", F.explode(ranks).alias("rank")).withColumn("left", F.col("rank")), folder, "wanted-0")
    done = []
    for number in range(PASSES):
        done.append(wanted.where("lo = hi").select(*names, "rank", F.col("lo").alias("value")))
        still = wanted.where("lo < hi")
        if not still.head(1):
            break
        # the open intervals of a column lie apart, so a value is in one at most
        cells = still.groupBy(*names).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("cells"))
        inside = keyed_join(rows, cells, names).withColumn("cell", F.get(F.filter("cells", lambda c: F.col("x").between(c["lo"], c["hi"])), F.lit(0))).where("cell is not null")
        by = [*names, F.col("cell.lo").alias("from"), bucket(F.col("x"), F.col("cell.lo"), F.col("cell.hi"), number).alias("bucket")]
        counts = inside.groupBy(*by).agg(F.sum("w").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        before = Window.partitionBy(*[col(k) for k in names], "from").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        met = keyed_join(still.withColumnRenamed("lo", "from").drop("hi"), counts, [*names, "from"])
        met = met.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        wanted = stored(met.select(*names, F.col("a").alias("lo"), F.col("b").alias("hi"), "rank", (F.col("left") - F.col("before")).alias("left")), folder, f"wanted-{number + 1}")
    else:
        raise RuntimeError(f"quantiles did not settle in {PASSES} passes")
    values = done[0]
    for d in done[1:]:
        values = values.union(d)
    found = values.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__of"))
    joined = keyed_join(whole, found, names)

    def quantile(a: Column) -> Column:
        low, high = F.floor(a).cast("long"), F.ceil(a).cast("long")
        x, y = F.col("__of")[low], F.col("__of")[high]
        return F.when((low == high) | (x == y), x).otherwise((high - a) * x + (a - low) * y)

    return joined.select(*names, F.array(*[quantile(a) for a in at]).alias("quantiles"))
