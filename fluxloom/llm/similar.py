"""Links between texts whose sets of word shingles have a Jaccard similarity of a threshold or more.

SimHash at a few bits finds copies with few edits; at a similarity of 0.8 fingerprints differ in
some ten bits of 64, more than any segment index can select. These links close that gap: banded
minwise hashes choose the pairs that are compared, and the shingle sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Bands of minwise hashes and hashes in a band: a pair at 0.8 meets in no band with probability 0.0002.
BANDS, ROWS = 16, 4
#: Texts and shingles of a group that are compared in memory at once; larger groups are compared by pairs of blocks of half as many.
GROUP, SHINGLES = 512, 4_000_000
#: Bands paired with each band for the first links of a larger group, by their distance.
PAIRED = (1, 2, 4)
#: Shingles whose minwise hashes are made at a time.
BLOCK = 1 << 12

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The band keys of a set of 64-bit shingle hashes; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[lo : lo + BLOCK, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    mixed = (least >> np.uint64(20)).reshape(BANDS, ROWS) * _MIX
    return np.bitwise_xor.reduce(mixed ^ mixed >> np.uint64(31), axis=1).view(np.int64)


def forest(ids: np.ndarray, sets: list[np.ndarray], similarity: float, trees: np.ndarray | None = None, split: int = 0) -> list[tuple[int, int]]:
    """Links that connect the sets as all pairs at ``similarity`` or more do.

    Sets of one number in ``trees`` are connected already. With ``split``, the sets before it are compared with those from it only.
    """
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    tree = np.arange(len(sets)) if trees is None else np.unique(trees, return_inverse=True)[1]
    mark, out = np.zeros(number.max() + 1, np.int32), []
    for k in range(split or len(sets) - 1):
        lo = max(k + 1, split)
        if (tree[lo:] == tree[k]).all():
            continue
        mine = number[starts[k] : starts[k] + sizes[k]]
        mark[mine] = 1
        first = starts[lo]
        shared = np.add.reduceat(mark[number[first:]], starts[lo:] - first)
        mark[mine] = 0
        for other in np.flatnonzero(shared >= similarity * (sizes[k] + sizes[lo:] - shared)) + lo:
            if tree[other] != tree[k]:
                tree[tree == tree[other]] = tree[k]
                out.append((int(ids[k]), int(ids[other])))
    return out


def groups_forest(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (low, id, shingles) sorted by low; a group is held at a time."""
    now, ids, sets, found = None, [], [], []

    def made() -> pa.RecordBatch:
        pairs = np.array(found, np.int64).reshape(-1, 2)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        low, members, shingles = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for k in range(batch.num_rows):
            if low[k] != now:
                found += forest(np.array(ids), sets, similarity)
                now, ids, sets = low[k], [], []
            ids.append(members[k])
            sets.append(shingles[k].values.to_numpy())
        yield made()
    found += forest(np.array(ids), sets, similarity)
    yield made()


def blocks_forest(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (pair, block, id, label, shingles) sorted by pair and block; the one or two blocks of a pair are held at a time."""
    now, rows = None, []

    def made() -> pa.RecordBatch:
        found = []
        if rows:
            block, ids, labels, sets = zip(*rows)
            found = forest(np.array(ids), list(sets), similarity, np.array(labels), next((k for k, b in enumerate(block) if b != block[0]), 0))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        pair, block, ids, labels = (batch.column(c).to_numpy() for c in range(4))
        for k in range(batch.num_rows):
            if pair[k] != now:
                yield made()
                now, rows = pair[k], []
            rows.append((block[k], ids[k], labels[k], batch.column(4)[k].values.to_numpy()))
    yield made()


def blocks(groups: DataFrame, labels: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, label, block) of the members of ``groups`` (low, id, n), and (i, j): pairs of blocks that hold members of one group with different labels.

    ``labels`` (node, component) tells which members are connected already. A label with many members of
    a group fills blocks of its own, so blocks of one label are not compared with one another.
    """
    members = groups.groupBy("id").agg(F.min("low").alias("home"), F.first("n").alias("n"))
    members = members.join(labels, F.col("id") == F.col("node"), "left").select("home", "id", "n", F.coalesce("component", "id").alias("label"))
    members = common.stored(members, folder, "labelled")
    parts = lambda size, weight: F.ceil(F.greatest(F.col(size) / (GROUP / 2), F.col(weight) / (SHINGLES / 2)))
    mine = members.groupBy("home", "label").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).withColumn("own", parts("size", "weight"))
    pool = mine.where("own = 1").groupBy("home").agg(F.sum("size").alias("all"), F.sum("weight").alias("heavy")).select("home", parts("all", "heavy").alias("pool"))
    dealt = members.join(mine.select("home", "label", "own"), ["home", "label"]).join(pool, "home", "left")
    alone = F.xxhash64("home", "label", F.pmod(F.xxhash64("id"), "own"))
    block = F.when(F.col("own") > 1, alone).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("label"), "pool")))
    dealt = common.stored(dealt.select("id", "label", block.alias("block")), folder, "blocks")
    spans = groups.select("low", "id").join(dealt, "id").groupBy("low", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    other = spans.select("low", F.col("block").alias("j"), F.col("least").alias("least_j"), F.col("most").alias("most_j"))
    both = spans.hint("merge").join(other, "low").where("block <= j and not (least = most_j and most = least_j)")
    return dealt, common.stored(both.select(F.col("block").alias("i"), "j").distinct(), folder, "block-pairs")


def shared_bucket(rows: DataFrame, *ends: Column) -> DataFrame:
    """``rows`` (key, id, n) of each bucket of two or more ids, with its least id ``low`` and the other ``ends`` asked for."""
    least = rows.groupBy("key").agg(F.min("id").alias("low"), *ends)
    return rows.hint("merge").join(least, "key").where(F.col("low") != F.col("id"))


def links(sketches: DataFrame, fetch: Callable[[DataFrame], DataFrame], folder: str, similarity: float = 0.8) -> DataFrame:
    """(a, b): links between the ids of ``sketches`` (id, n, bands); rows that share an id are copies and agree.

    ``fetch`` gets a table of ids and returns their sets of n shingles (id, shingles), one row each.
    All texts that meet the same least id in any band form its group, and each group is compared
    whole. One of up to ``GROUP`` texts and ``SHINGLES`` shingles is compared in memory, and gives a
    spanning forest of all its links. Members of larger groups first meet again in buckets of two
    bands at once; each is compared with both ends of each bucket and with its group's least id,
    which is linear in the rows and connects most copies. Then all pairs of members that this left
    unconnected are compared, a pair of blocks of the group at a time. No row is dropped on either
    way, and every link has been checked on whole sets. Texts without shingles have no bands and no
    link; an empty table gives none.
    """
    rows = sketches.select(F.explode("bands").alias("key"), "id", "n")
    least = common.stored(rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("key", "low"), folder, "shared-bands")
    near = rows.where(common.key_filter(least.select("key"))(F.col("key")))  # few bands are shared, and only their rows are shuffled
    groups = common.stored(near.join(least, "key").select("low", "id", "n").distinct(), folder, "groups")
    large = groups.groupBy("low").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).select("low", ((F.col("size") > GROUP) | (F.col("weight") > SHINGLES)).alias("large"))
    groups = common.stored(groups.join(large, "low"), folder, "sized")
    crowd = groups.where("large").select("id").distinct()
    crowded = bool(crowd.head(1))
    sets = common.stored(fetch(groups.select("id").distinct()), folder, "sets")
    small = groups.where("not large").join(sets.hint("merge"), "id").select("low", "id", "shingles")
    ordered = small.repartition("low").sortWithinPartitions("low", "id")
    near = common.map_batches(ordered, lambda batches: groups_forest(batches, similarity), "a long, b long")
    if not crowded:
        return near

    pairs = [F.xxhash64(F.lit(k), F.lit(step), F.col("bands")[k], F.col("bands")[(k + step) % BANDS]) for k in range(BANDS) for step in PAIRED]
    crowd = common.stored(crowd, folder, "crowd")
    banded = sketches.where(common.key_filter(crowd)(F.col("id"))).dropDuplicates(["id"])
    met = shared_bucket(banded.hint("merge").join(crowd, "id").select(F.explode(F.array(*pairs)).alias("key"), "id", "n"), F.max("id").alias("high"))
    ends = met.select(F.explode(F.array("low", "high")).alias("a"), F.col("id").alias("b")).union(groups.where("large").select("low", "id"))
    ends = ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = ends.join(sets.hint("merge").toDF("a", "of_a"), "a").join(sets.hint("merge").toDF("b", "of_b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    far = common.stored(both.where(shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b"), folder, "far")

    dealt, met = blocks(groups.where("large"), components(far, f"{folder}/far-components"), folder)
    pair = F.xxhash64("i", "j").alias("pair")
    met = met.select(pair, F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rest = met.hint("merge").join(dealt, "block").hint("merge").join(sets, "id").select("pair", "block", "id", "label", "shingles")
    ordered = rest.repartition("pair").sortWithinPartitions("pair", "block", "id")
    rest = common.map_batches(ordered, lambda batches: blocks_forest(batches, similarity), "a long, b long")
    return near.union(far).union(rest)
