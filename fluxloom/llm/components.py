"""Connected components of a graph held as a table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component: its smallest reachable node.

    Each round ties the neighbours of a node to the smallest of them, first those above the node
    and then those below it, until nothing changes; the table of links never grows. All rounds are
    joins and partial aggregates; links and labels stay in tables of the shared folder. Loops and
    repeated links are harmless; an empty table gives an empty one.
    """
    now = common.stored(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), folder, "links-0")
    seen = None
    for k in range(1, rounds + 1):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("u"), "m").where("u != m")
        now = common.stored(small.union(least.select("hi", "m")).distinct().toDF("hi", "lo"), folder, f"links-{k}")
        common.discard(folder, f"links-{k - 1}")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return found.union(found.select("component", "component").distinct())
