"""Operator 13: a Merkle manifest of a dataset, with a proof for each row.

A row's fields hash to a leaf. The leaves of a source, in order, are hashed in runs of ARITY up to the
source's subroot, and the subroots up to the root. A proof is found by pointer jumping: each node holds
the siblings on its way to an ancestor and the ancestor's name; a join of the table with itself puts the
ancestor's own way behind it, so the distance doubles until every way ends in the root.

Digests are hex text throughout, as they are hashed. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clean import keyed_join
from . import common

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIBLINGS = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """A field in the preimage of a leaf: its length in bytes, a colon and its text; a dash for null."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(docs: DataFrame, **instead: Column) -> Column:
    return F.sha2(F.concat(*[field(instead.get(c, docs[c])) for c in FIELDS]), 256)


def placed(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with place: from 0 within its source, by doc_id and then leaf.

    Ranges of (source, doc_id, leaf) are sorted apart and written; a row's number in its range and
    the short table of how many rows of each source each range holds give its place. So a source
    with a third of all rows is as many tasks as its share.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "doc_id", "leaf"]
    ranged = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = common.stored(ranged.withColumn("__range", F.shiftright("__at", 33)), folder, "ranged")
    first = ranged.groupBy("source", "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = first.select("source", "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return keyed_join(ranged, offsets, ["source", "__range"]).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("place"))


def runs_of(nodes: DataFrame) -> DataFrame:
    """(tree, level, place, hash, children) of the level above: children lists the hashes of a run."""
    at = F.floor(F.col("place") / ARITY).cast("long")
    made = nodes.groupBy("tree", (F.col("level") + 1).alias("level"), at.alias("at")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("c"))
    made = made.withColumnRenamed("at", "place")
    children = F.transform("c", lambda x: x["hash"])
    return made.select("tree", "level", "place", F.sha2(F.array_join(children, ""), 256).alias("hash"), children.alias("children"))


def grown(leaves: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(the nodes above ``leaves``, the top node of each tree). ``leaves``: (tree, level, place, hash), a tree's places from 0.

    One level a round, stored; a round reads only the level below, so all rounds but the first are short.
    A tree of one leaf has no node above it, and the leaf is its top.
    """
    now, levels, tops = leaves, [], []
    while True:
        made = runs_of(now)
        ends = made.groupBy("tree").agg(F.max("place").alias("last"))
        made = common.stored(keyed_join(made, ends, ["tree"]), folder, f"{name}-{len(levels) + 1}")
        lone = (F.col("last") == 0) & (F.size("children") == 1)
        tops.append(made.where(lone).select("tree", (F.col("level") - 1).alias("level"), "place", F.col("children")[0].alias("hash")))
        levels.append(made.where(~lone).drop("last"))
        tops.append(made.where(~lone & (F.col("last") == 0)).select(*leaves.columns))
        now = made.where("last > 0").select(*leaves.columns)
        if not now.head(1):
            break
    nodes, done = levels[0], tops[0]
    for level in levels[1:]:
        nodes = nodes.union(level)
    for t in tops[1:]:
        done = done.union(t)
    return nodes, common.stored(done, folder, f"{name}-tops")


def step(children: Column, place: Column) -> Column:
    """One step of a way: the hashes left and right of a node among its run."""
    k = (place % ARITY).cast("int")
    return F.array(F.struct(F.array_join(F.slice(children, F.lit(1), k), "").alias("left"), F.array_join(F.slice(children, k + 2, F.lit(ARITY)), "").alias("right")))


def ways(nodes: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, hash, children, way) of every inner node: the siblings on its way to the top of ``nodes`` (node, parent, place, hash, children).

    Pointer jumping: after k rounds a node has 2^k steps of its way, or all of them.
    """
    above = nodes.select(F.col("node").alias("p"), F.col("children").alias("c"))
    one = nodes.join(above, nodes["parent"] == above["p"], "left")
    way = F.when(F.col("p").isNull(), F.array().cast(SIBLINGS)).otherwise(step(F.col("c"), F.col("place")))
    now = common.stored(one.select("node", "hash", "children", F.when(F.col("p").isNotNull(), F.col("parent")).alias("to"), way.alias("way")), folder, f"{name}-0")
    rounds = 0
    while now.where("to is not null").head(1):
        far = now.select(F.col("node").alias("far"), F.col("to").alias("further"), F.col("way").alias("rest"))
        both = now.join(far, now["to"] == far["far"], "left")
        rounds += 1
        now = common.stored(both.select("node", "hash", "children", F.col("further").alias("to"), F.concat("way", F.coalesce("rest", F.array().cast(SIBLINGS))).alias("way")), folder, f"{name}-{rounds}")
    return now


def fold(start: Column, way: Column) -> Column:
    """The root that a leaf's hash and the siblings of its way give."""
    return F.aggregate(way, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    Leaves of a source ascend by doc_id (null first), rows that share one by their leaves; sources ascend
    by their bytes, null first. ``tampered`` says which rows are checked with the letters A-Z of their
    text in lower case (default: those where 5 divides the crc32 of the decimal doc_id; a null never):
    their folded_root comes from that text, with the siblings of the untouched rows. Repeated rows are
    leaves of their own; null, empty and very long texts are hashed as they are; a table of one row has
    its leaf as root and an empty proof; other columns are ignored; an empty table gives an empty one.

    Texts are read once and hashed where they are read; only digests are shuffled.
    """
    folder = common.shared_dir(docs.sparkSession)
    if tampered is None:
        tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    changed = leaf_of(docs, text=F.translate(docs["text"], UPPER, LOWER))
    hashed = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), leaf_of(docs).alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), changed).alias("shown"))
    rows = common.stored(placed(hashed, folder), folder, "leaves")

    # a node's name: its source, its level and its place; inner nodes of sources, then the tree over the subroots
    nodes, tops = grown(rows.select(F.col("source").alias("tree"), F.lit(0).alias("level"), "place", F.col("leaf").alias("hash")), folder, "source")
    number = Window.orderBy(F.col("tree").asc_nulls_first())  # one short row for each source
    roots = common.stored(tops.withColumn("at", (F.row_number().over(number) - 1).cast("long")), folder, "subroots")
    upper, top = grown(roots.select(F.lit(None).cast("string").alias("tree"), F.lit(0).alias("level"), F.col("at").alias("place"), "hash"), folder, "root")
    name = lambda kind, tree, level, place: F.struct(F.lit(kind).alias("kind"), tree.alias("tree"), level.cast("int").alias("level"), place.cast("long").alias("place"))
    none, at = F.lit(None).cast("string"), F.floor(F.col("place") / ARITY)
    # a subroot is node (0, at) of the upper tree, so the parent of a source's top node is there
    of = roots.select(F.col("tree").alias("t"), F.col("level").alias("l"), "at", F.col("hash").alias("subroot"))
    joined = nodes.join(of.drop("subroot"), F.col("tree").eqNullSafe(F.col("t")))
    is_top = F.col("level") == F.col("l")
    over = name(1, none, F.lit(1), F.floor(F.col("at") / ARITY))
    parent = F.when(is_top, over).otherwise(name(0, F.col("tree"), F.col("level") + 1, at))
    inner = joined.select(name(0, F.col("tree"), F.col("level"), F.col("place")).alias("node"), parent.alias("parent"), F.when(is_top, F.col("at")).otherwise(F.col("place")).alias("place"), "hash", "children")
    upper = upper.select(name(1, none, F.col("level"), F.col("place")).alias("node"), name(1, none, F.col("level") + 1, at).alias("parent"), "place", "hash", "children")
    above = ways(common.stored(inner.union(upper), folder, "nodes"), folder, "way").select(F.col("node").alias("n"), "children", F.col("way").alias("rest"))

    alone = F.col("l") == 0  # a source of one row: its leaf is the subroot
    to = F.when(alone, over).otherwise(name(0, F.col("source"), F.lit(1), at))
    leaves = rows.join(of, F.col("source").eqNullSafe(F.col("t"))).select("doc_id", "leaf", "shown", "subroot", to.alias("to"), F.when(alone, F.col("at")).otherwise(F.col("place")).alias("place"))
    # the last jump: a leaf's own step, then its run's way
    met = leaves.join(above, leaves["to"] == above["n"], "left")
    way = F.when(F.col("n").isNull(), F.array().cast(SIBLINGS)).otherwise(F.concat(step(F.col("children"), F.col("place")), F.col("rest")))
    found = met.select("doc_id", "leaf", "shown", "subroot", way.alias("way"))
    root = top.select(F.col("hash").alias("root"))  # one row
    siblings = F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("shown", "leaf"), F.col("way"))
    out = found.join(root).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
