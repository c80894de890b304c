"""Operator 3: SimHash near-duplicates, with candidates by the pigeonring principle.

A 64-bit fingerprint is cut into M segments on a ring. If two fingerprints differ in at most D
bits, some segment starts a chain in which each run of its first l segments differs in at most
floor(l * D / M) bits: the budgets grow in proportion to the length. With D < M the chain's first
segment is equal in both, and the budgets leave at least one more equal segment within each of the
next few. So every chain start is an index key (start, positions of the equal segments, their bits),
and pairs that meet in a bucket go through the chain test before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, similar
from .components import components

BITS = 64
SEGMENTS = 7
#: Fingerprints of a bucket that are compared with one another in memory; larger ones take the ball route.
BUCKET = 1024
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a whole text, in order: ASCII lower case, words parted by ASCII white space."""
    flat = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not flat:
        return np.empty(0, "<u8")
    space = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(space + 1).tolist()], [*space.tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts, ends[words - 1 :] or ends[-1:])), "<u8")


def majority(h: np.ndarray) -> int:
    """SimHash: the bits set in over half the hashes; zero for none."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), BLOCK):
        counts += np.unpackbits(h[lo : lo + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of a whole text."""
    return majority(hashes(text, words))


def fingerprints(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in common.column(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return common.map_batches(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), run, "doc_id long, fp long")


def shingle_set(h: np.ndarray) -> tuple[int, np.ndarray]:
    """A digest of a set of shingle hashes, and the set as sorted 32-bit numbers."""
    distinct = np.unique(h)
    return xxhash.xxh64_intdigest(distinct.tobytes(), 42) - (1 << 63), np.unique(distinct.astype(np.uint32)).view(np.int32)


def row_key(docs: DataFrame) -> Column:
    """What a row is known by from one pass over the texts to the next."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(key, doc_id, fp, digest, n, bands): fingerprint, and the digest, size and band keys of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in common.column(batch, "text"):
                h = hashes(t, words)
                digest, shingles = shingle_set(h)
                rows.append((np.array(majority(h), np.uint64).view(np.int64), digest, len(shingles), similar.bands(np.unique(h))))
            fp, digest, n, keys = zip(*rows) if rows else ((),) * 4
            arrays = [pa.array(fp, pa.int64()), pa.array(digest, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["key", "doc_id", "fp", "digest", "n", "bands"])

    rows = docs.select(row_key(docs).alias("key"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return common.map_batches(rows, run, "key long, doc_id long, fp long, digest long, n int, bands array<long>")


def sets_of(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(digest, shingles) of the rows whose key is in ``keys``, and of a few others, from their whole texts."""
    held = common.key_filter(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sets = zip(*[shingle_set(hashes(t, words)) for t in common.column(batch, "text")]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(sets, pa.list_(pa.int32()))], names=["digest", "shingles"])

    rows = docs.where(docs["doc_id"].isNotNull() & held(row_key(docs))).select(docs["text"].alias("text"))
    return common.map_batches(rows, run, "digest long, shingles array<int>")


def segment_bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """First bit and width of each segment; widths differ by one at most."""
    cuts = [k * BITS // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_keys(segments: int, differ: int) -> list[tuple[int, ...]]:
    """Sets of segments that a chain within its budgets leaves equal, the chain's start first.

    The longest chain used is the shortest that leaves three equal segments (or all that it can).
    """
    budget = [length * differ // segments for length in range(segments + 1)]
    length = next((x for x in range(3, segments + 1) if x - budget[x] >= 3), segments)
    equal = length - budget[length]
    out = set()
    for start in range(segments):
        for rest in combinations(range(1, length), equal - 1):
            kept = {0, *rest}
            if all(x - len(kept & set(range(x))) <= budget[x] for x in range(1, length + 1)):
                out.add(tuple(sorted((start + k) % segments for k in kept)))
    return sorted(out)


def chain_passes(diff: np.ndarray, segments: int, differ: int) -> np.ndarray:
    """Of XORed fingerprints, those with a chain of all lengths within its budgets."""
    per = np.stack([np.bitwise_count(diff >> np.uint64(a) & np.uint64((1 << w) - 1)) for a, w in segment_bounds(segments)]).astype(np.int16)
    ok = np.zeros(diff.shape, bool)
    for start in range(segments):
        run, fine = np.zeros(diff.shape, np.int16), np.ones(diff.shape, bool)
        for length in range(1, segments + 1):
            run = run + per[(start + length - 1) % segments]
            fine &= run <= length * differ // segments
        ok |= fine
    return ok


def forest(ids: np.ndarray, fps: np.ndarray, segments: int, differ: int) -> list[tuple[int, int]]:
    """Links that connect a bucket's fingerprints as all its links do: one for each merged pair of trees."""
    parent = list(range(len(ids)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for k in range(len(ids) - 1):
        diff = fps[k + 1 :] ^ fps[k]
        near = np.flatnonzero(chain_passes(diff, segments, differ))
        for other in near[np.bitwise_count(diff[near]) <= differ]:
            a, b = root(k), root(int(other) + k + 1)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[k]), int(ids[other + k + 1])))
    return out


def links(nodes: DataFrame, folder: str, differ: int = 4, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect ``nodes`` (id, fp; fp distinct) as all pairs within ``differ`` bits do.

    Buckets of up to ``bucket`` fingerprints are compared in memory, as the sorted rows of a
    partition stream by, and give a spanning forest. Members of larger ones go on to the ball
    route: two fingerprints differ in at most 2r bits exactly if some third one is within r bits
    of both, so each is listed under all points of its ball and ties to the smallest there. That
    is linear in the rows, whatever a bucket's size. No bucket is ever held whole or dropped.
    An empty table gives no link.
    """
    if differ % 2 or differ >= segments:
        raise ValueError("differ must be even and below the number of segments")
    bounds = segment_bounds(segments)
    keys = []
    for k, chosen in enumerate(chain_keys(segments, differ)):
        mask = sum(((1 << bounds[s][1]) - 1) << bounds[s][0] for s in chosen)
        keys.append(F.struct(F.lit(k).alias("chain"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("bits")))
    spread = nodes.select("id", "fp", F.explode(F.array(*keys)).alias("key")).select("key.chain", "key.bits", "id", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot = np.empty((0, 4), np.int64), None  # rows of the bucket that may go on, and its key if it is known to be large
        for batch in batches:
            rows = np.concatenate([rest, np.column_stack([c.to_numpy() for c in batch.columns])])
            if not len(rows):
                continue
            cut = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            last = int(cut[-1]) if len(cut) else 0
            found, open_key = [], tuple(rows[last, :2])
            if last:
                found.append(closed(rows[:last], np.concatenate([[0], cut]), hot))
                hot = None if hot != open_key else hot
            rest = rows[last:]
            if hot == open_key or len(rest) > bucket:
                hot = open_key
                found.append(np.column_stack([rest[:, 2:], np.ones(len(rest), np.int64)]))
                rest = rest[:0]
            yield frame(found)
        yield frame([closed(rest, np.array([0, len(rest)]), hot)] if len(rest) else [])

    def closed(rows: np.ndarray, cuts: np.ndarray, hot) -> np.ndarray:
        """(a, b, 0) for the links of whole buckets, which start at ``cuts``, and (id, fp, 1) for the members of large ones."""
        fps, sizes, out = rows[:, 3].view(np.uint64), np.diff(cuts), []
        two = cuts[:-1][sizes == 2]
        diff = fps[two] ^ fps[two + 1]
        two = two[chain_passes(diff, segments, differ)]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= differ]
        out.append(np.column_stack([rows[two, 2], rows[two + 1, 2], np.zeros(len(two), np.int64)]))
        for k in np.flatnonzero((sizes > 2) | (np.arange(len(sizes)) == 0)):
            part = rows[cuts[k] : cuts[k + 1]]
            if len(part) > bucket or tuple(part[0, :2]) == hot:
                out.append(np.column_stack([part[:, 2:], np.ones(len(part), np.int64)]))
            elif len(part) > 2:
                out.append(np.array([(a, b, 0) for a, b in forest(part[:, 2], part[:, 3].view(np.uint64), segments, differ)], np.int64).reshape(-1, 3))
        return np.concatenate(out)

    def frame(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate([np.empty((0, 3), np.int64), *parts])
        return pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(3)], names=["a", "b", "hot"])

    sorted_rows = spread.repartition("chain", "bits").sortWithinPartitions("chain", "bits", "id").select(F.col("chain").cast("long").alias("chain"), "bits", "id", "fp")
    met = common.stored(sorted_rows.mapInArrow(run, "a long, b long, hot long"), folder, "met")
    crowd = met.where("hot = 1").select(F.col("a").alias("id"), F.col("b").alias("fp")).distinct()
    flips = [sum(1 << k for k in chosen) for r in range(differ // 2 + 1) for chosen in combinations(range(BITS), r)]
    flips = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in flips]) if crowd.head(1) else F.array(F.lit(0).cast("long"))
    ball = crowd.select("id", F.explode(flips).alias("flip"), "fp").select("id", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = ball.groupBy("point").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high")
    stars = ball.hint("merge").join(least, "point").where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    return met.where("hot = 0").select("a", "b").union(stars)


def labels(prints: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """(fp, component, component_id) of every fingerprint of ``prints`` (doc_id, fp); ``edges`` (a, b) link fingerprints.

    component is the least fingerprint reachable and component_id the smallest doc_id that has one of them.
    """
    found = common.stored(components(edges, folder).withColumnRenamed("node", "fp"), folder, "found")
    each = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), folder, "each")
    linked = each.join(found, "fp")
    least = common.stored(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), folder, "least")
    alone = each.join(found, "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("doc_id").alias("component_id"))
    return common.stored(linked.join(least, "component").select("fp", "component", "component_id").union(alone), folder, "labels")


def near_duplicates(docs: DataFrame, words: int = 4, differ: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: SimHash classes linked at ``differ`` bits or fewer.

    component_id is the smallest doc_id reachable by links. Null and empty texts have fingerprint
    zero and link like any other; fewer than ``words`` words count as one shingle; repeated rows
    stay repeated; rows that share a doc_id are told apart by their fingerprints; a row with a null
    doc_id is kept and links, but is no component's id unless all are null; other columns are
    ignored; an empty table gives an empty one.

    Equal fingerprints are one node of the search, so groups of copies, whatever their size, enter
    it as one row and no pair of copies is made.
    """
    folder = common.shared_dir(docs.sparkSession)
    prints = common.stored(fingerprints(docs, words, doc_id, text), folder, "prints")
    nodes = prints.select("fp").distinct().select(F.col("fp").alias("id"), "fp")
    label = labels(prints, links(nodes, folder, differ), folder)
    return prints.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_or_near(docs: DataFrame, words: int = 5, differ: int = 4, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): classes linked by SimHash, and by a Jaccard similarity of the shingles of at least ``similarity``.

    Edge cases are those of ``near_duplicates``, but rows without a doc_id are in no class. Texts with the same set of shingles enter the
    search for similar sets as one row, those with the same fingerprint the search by bits.
    """
    folder = common.shared_dir(docs.sparkSession)
    made, label = classes(docs, words, differ, similarity, folder)
    known = made.where("doc_id is not null").select("doc_id", "fp").join(label, "fp").select("doc_id", "component_id")
    return known.union(made.where("doc_id is null").select("doc_id", F.lit(None).cast("long")))


def classes(docs: DataFrame, words: int, differ: int, similarity: float, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows (key, doc_id, fp, ...) of ``docs``, and the ``labels`` of the fingerprints of those with a doc_id.

    Texts are read twice and never shuffled: once for sketches, and once for the sets of shingles of those that share a band.
    """
    made = common.stored(sketches(docs, words), folder, "sketches")
    known = made.where("doc_id is not null")
    by_bits = links(known.select("fp").distinct().select(F.col("fp").alias("id"), "fp"), folder, differ)
    # texts with one set of shingles, but other numbers of each
    mixed = common.stored(known.groupBy("digest").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high"), folder, "mixed")
    same = known.where(common.key_filter(mixed.select("digest"))(F.col("digest"))).select("digest", "fp").distinct().join(mixed, "digest").where("fp != low").select("low", "fp")

    def fetch(ids: DataFrame) -> DataFrame:
        # stored before the join: Spark would join first, and gather all copies of a text in one task
        firsts = common.stored(known.where(common.key_filter(ids)(F.col("digest"))).groupBy("digest").agg(F.min("key").alias("key")), folder, "nearly-firsts")
        firsts = common.stored(firsts.join(ids, firsts["digest"] == ids["id"], "left_semi"), folder, "firsts")
        sets = sets_of(docs, firsts.select("key"), words).join(firsts, "digest", "left_semi")
        return sets.select(F.col("digest").alias("id"), "shingles").dropDuplicates(["id"])

    rows = known.select(F.col("digest").alias("id"), "n", "bands")
    alike = common.stored(similar.links(rows, fetch, folder, similarity), folder, "alike")
    ends = alike.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    fps = common.stored(known.where(common.key_filter(ends)(F.col("digest"))).groupBy("digest").agg(F.min("fp").alias("fp")), folder, "nearly-ends")
    fps = common.stored(fps.join(ends, "digest", "left_semi"), folder, "ends")
    alike = alike.join(fps.toDF("a", "of_a"), "a").join(fps.toDF("b", "of_b"), "b").select("of_a", "of_b")
    edges = common.stored(by_bits.union(alike).union(same), folder, "edges")
    return made, labels(known, edges, folder)


def drop_near_duplicates(docs: DataFrame, words: int = 5, differ: int = 4, similarity: float = 0.8) -> DataFrame:
    """One row of each class of near-duplicates: that with the smallest doc_id, with its columns.

    Classes are of texts, so unlike texts under one doc_id are judged apart; of a class's rows that
    share its smallest doc_id one stays, and repeated rows come out once. Rows without a doc_id are
    kept. Null and empty texts are alike and one of them stays. Any other columns are returned as
    they are; an empty table gives an empty one.

    Only rows that may go (and a few more, see ``common.key_filter``) meet the list of those that do.
    """
    folder = common.shared_dir(docs.sparkSession)
    made, label = classes(docs, words, differ, similarity, folder)
    placed = made.where("doc_id is not null").select("key", "doc_id", "fp").join(label, "fp").select("key", "doc_id", "component", "component_id")
    placed = common.stored(placed, folder, "placed")
    heads = common.stored(placed.where("doc_id = component_id").groupBy("component").agg(F.min("key").alias("head")), folder, "heads")
    drop = placed.join(heads, "component").where("key != head").select("key", "doc_id", F.lit(False).alias("stays"))
    again = placed.groupBy("key", "doc_id").agg(F.count("*").alias("n")).where("n > 1").join(heads, F.col("key") == F.col("head"), "left_semi").select("key", "doc_id", F.lit(True).alias("stays"))
    acts = common.stored(drop.distinct().union(again), folder, "acts")
    held = common.key_filter(acts.select("key"))(row_key(docs)) & docs["doc_id"].isNotNull()
    some = docs.where(held)
    key, stays = common.fresh("key"), common.fresh("stays")
    acts = acts.select(F.col("key").alias(key), F.col("doc_id").alias(f"{key}_id"), F.col("stays").alias(stays))
    judged = some.withColumn(key, row_key(docs)).join(acts.withColumnRenamed(key, f"{key}_act"), (F.col(key) == F.col(f"{key}_act")) & (some["doc_id"] == F.col(f"{key}_id")), "left")
    kept = judged.where(F.col(stays).isNull()).select(*[some[c] for c in docs.columns])
    if acts.where(F.col(stays)).head(1):
        kept = kept.union(judged.where(F.col(stays)).dropDuplicates([key, f"{key}_id"]).select(*[some[c] for c in docs.columns]))
    return docs.where(~held).union(kept)
