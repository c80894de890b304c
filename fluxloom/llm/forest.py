"""Operator 12: approximate nearest neighbours by a forest of random-projection trees.

Each tree cuts the unit vectors by random directions at the medians of a bounded sample. A query walks
all trees through one priority queue. A node's priority is the chance that a neighbour lies below it.
Along a random direction w, a neighbour of q at cosine c lies about c (w q), give or take sqrt((1 - c^2) / d):
that gives the chance of either side of a cut, and chances multiply down the tree. The walk ends when
the chance of missing a neighbour in all trees is below a bound. So a query near others visits few
leaves, and one far from all visits many.

Rows are dealt by leaf, once for each tree, and queries to the cells of leaves that they visit; there
every candidate of a visited leaf is compared exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Production parameters: trees, the chance of missing a neighbour that ends a walk, rows of a leaf.
TREES, MISS, LEAF_ROWS = 3, 0.02, 128
#: Rows and bytes of the sample that the trees are fitted on, and its rows for a leaf at least.
SAMPLE_ROWS, SAMPLE_BYTES, LEAF_SAMPLE = 16_384, 16 << 20, 8
#: Bytes of vectors of a cell (a subtree that is one shuffle key), and of the queries that it holds at a time.
CELL_BYTES, QUERY_BYTES = 1 << 20, 16 << 20
#: Distinct vectors that a task remembers, to send on no more copies of one than a result can show.
REMEMBERED = 1 << 16
#: Rows of a cell that are compared at a time.
HELD_ROWS = 2048
#: Candidates beyond the wanted ones that are compared again in a fixed order of summation.
SLACK = 8


@dataclass
class Trees:
    """Trees of equal depth. Node k of a tree has children 2k + 1 and 2k + 2; leaves are numbered from the left."""

    depth: int
    cell_depth: int
    planes: np.ndarray  # tree, node, dimension
    cuts: np.ndarray  # tree, node
    sample: np.ndarray

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(unit), len(self.planes)), np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", unit, planes[node]) > cuts[node]
                node = 2 * node + 1 + right
            out[:, t] = node - (2**self.depth - 1)
        return out

    def walk(self, unit: np.ndarray, cosine: float, miss: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until the chance of missing a neighbour in all trees is at most ``miss``."""
        margin = (cosine * (self.planes @ unit) - self.cuts) / np.sqrt(max(1 - cosine * cosine, 1e-12)) * np.sqrt(len(unit))
        # logarithms of the chances of the right and the left side; the logistic curve stands for the normal one, with longer tails
        right, left = -np.logaddexp(0, -1.702 * margin), -np.logaddexp(0, 1.702 * margin)
        first_leaf, found, missed = 2**self.depth - 1, [], np.ones(len(self.planes))
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        while queue and missed.prod() > miss:
            p, t, node = heapq.heappop(queue)
            if node >= first_leaf:
                found.append((t, node - first_leaf))
                missed[t] = max(0.0, missed[t] - np.exp(-p))
                continue
            heapq.heappush(queue, (p - left[t, node], t, 2 * node + 1))
            heapq.heappush(queue, (p - right[t, node], t, 2 * node + 2))
        return found


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a power of two goes first, so that no square overflows or vanishes."""
    scaled = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])
    return scaled / np.sqrt(np.square(scaled).sum(axis=1))[:, None]


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in the order of the components."""
    scaled = [np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1]) for x in (query, rows)]
    a, b = scaled
    return (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))


def usable(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int, int]:
    """(id, vec) of the rows that take part, how many there are, and their dimension (the commonest, of equals the least)."""
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    vec = rows.select(rows[vec_id].cast("long").alias("id"), rows[vector].cast(kind).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    held = vec.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = held.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    if not sizes:
        return held, 0, 0
    return held.where(F.size("vec") == sizes[0]["d"]), sizes[0]["count"], sizes[0]["d"]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def fit(held: DataFrame, n: int, width: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 42) -> Trees:
    """Trees over a sample of at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes, chosen by a hash of the id.

    A tree is deep enough for leaves of ``leaf_rows`` rows of the whole table, as far as the sample carries it.
    """
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)) + 1
    batches = held.where(share).limit(2 * most).toArrow().combine_chunks().to_batches()
    unit = unit_rows(matrix(batches[0].column(1), width)) if batches else np.empty((0, width))
    unit = np.unique(unit, axis=0)  # copies would unbalance the cuts
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / leaf_rows))), int(np.log2(max(len(unit), 1) / LEAF_SAMPLE)) if len(unit) >= LEAF_SAMPLE else 0))
    cell_depth = max(0, min(depth, int(np.ceil(np.log2(max(n * width * 4 / CELL_BYTES, 1))))))
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(trees, 2**depth - 1, width))
    planes /= np.sqrt(np.square(planes).sum(axis=2, keepdims=True))
    cuts = np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        below = [np.arange(len(unit))]
        for node in range(2**depth - 1):
            rows = below[node]
            at = unit[rows] @ planes[t, node]
            cuts[t, node] = np.median(at) if len(rows) else 0.0
            below += [rows[at <= cuts[t, node]], rows[at > cuts[t, node]]]
    return Trees(depth, cell_depth, planes, cuts, unit)


def dealt_rows(held: DataFrame, forest, width: int, copies: int) -> DataFrame:
    """(cell, leaf, same, id, vec): every row once for each tree.

    ``same`` is a hash of the vector. Of equal vectors a task sends on only those that ``copies`` smaller ids don't precede.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            raw = matrix(batch.column(1), width)
            ids = batch.column(0).to_numpy()
            keys = [xxhash.xxh128_digest(row.tobytes()) for row in raw]
            keep = []
            for k in np.argsort(ids, kind="stable"):
                least = seen.setdefault(keys[k], [])  # the smallest ids sent, largest first
                if (len(least) < copies or -least[0] > ids[k]) and -int(ids[k]) not in least:
                    (heapq.heappush if len(least) < copies else heapq.heappushpop)(least, -int(ids[k]))
                    keep.append(k)
            if len(seen) > REMEMBERED:
                seen.clear()
            keep = np.sort(np.array(keep, np.int64))
            leaves = trees.leaves(unit_rows(raw[keep]))
            same = np.array([int.from_bytes(keys[k][:8], "little", signed=True) for k in keep], np.int64)
            vec = batch.column(1).take(pa.array(keep))
            for t in range(leaves.shape[1]):
                cell = (leaves[:, t] >> (trees.depth - trees.cell_depth)) + (t << trees.cell_depth)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(leaves[:, t].astype(np.int32)), pa.array(same), pa.array(ids[keep]), vec], names=["cell", "leaf", "same", "id", "vec"])

    return common.map_batches(held, run, f"cell int, leaf int, same long, id long, vec {held.schema['vec'].dataType.simpleString()}")


def walks(queries: DataFrame, forest, width: int, k: int, miss: float) -> DataFrame:
    """(id, vec, cell, leaves): each query once for each cell in which it visits leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for batch in batches:
            ids, unit = batch.column(0).to_numpy(), unit_rows(matrix(batch.column(1), width))
            near = unit @ trees.sample.T
            near[near > 1 - 1e-9] = -2.0  # the query itself and its copies: a radius without them is no smaller
            # the k-th of the sample is no nearer than the k-th of all rows, so the walk is no shorter; with fewer than k others all leaves are visited
            best = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] >= k else np.full(len(ids), -2.0)
            rows, cells, lists = [], [], []
            for r, (u, cos) in enumerate(zip(unit, best, strict=True)):
                by: dict[int, list[int]] = {}
                for t, leaf in trees.walk(u, max(float(cos), 0.0), 0.0 if cos < -1.5 else miss):
                    by.setdefault((leaf >> (trees.depth - trees.cell_depth)) + (t << trees.cell_depth), []).append(leaf)
                rows += [r] * len(by)
                cells += by
                lists += by.values()
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["id", "vec", "cell", "leaves"])

    return common.map_batches(queries, run, f"id long, vec {queries.schema['vec'].dataType.simpleString()}, cell int, leaves array<int>")


class Cell:
    """The queries of one cell, and the best candidates of each so far."""

    def __init__(self, width: int, copies: int):
        self.width, self.copies, self.most = width, copies, copies + SLACK
        self.asked: list[tuple[np.ndarray, np.ndarray, list]] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held, self.ready = 0, False
        self.last, self.last_id, self.run = None, None, 0  # the last row seen, and how many rows have its vector

    def add_queries(self, batch: pa.RecordBatch) -> None:
        self.asked.append((batch.column("id").to_numpy(), matrix(batch.column("vec"), self.width), batch.column("leaves").to_pylist()))

    def start(self) -> None:
        self.ids, self.raw = (np.concatenate([a[k] for a in self.asked]) for k in (0, 1))
        self.unit, self.visits = unit_rows(self.raw), {}
        for q, leaves in enumerate(x for a in self.asked for x in a[2]):
            for leaf in leaves:
                self.visits.setdefault(leaf, []).append(q)
        self.score = np.full((len(self.ids), self.most), -np.inf)
        self.best = np.full((len(self.ids), self.most), np.iinfo(np.int64).max)
        self.ready = True

    def add_rows(self, batch: pa.RecordBatch) -> None:
        if not self.asked:
            return
        if not self.ready:
            self.start()
        raw, ids, leaf = matrix(batch.column("vec"), self.width), batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
        # equal vectors lie together, smallest id first: only the first few can be among the best
        fresh = np.ones(len(raw), bool)
        fresh[1:] = (raw[1:] != raw[:-1]).any(axis=1)
        fresh[0] = self.last is None or bool((raw[0] != self.last).any())
        again = ~fresh & (ids == np.concatenate([[self.last_id if self.last_id is not None else 0], ids[:-1]]))
        count, at = np.cumsum(~again), np.maximum.accumulate(np.where(fresh, np.arange(len(raw)), -1))
        nth = np.where(at >= 0, count - count[at], self.run + count - 1)
        self.last, self.last_id, self.run = raw[-1], ids[-1], int(nth[-1]) + 1
        keep = (nth < self.copies) & ~again & np.isin(leaf, list(self.visits))
        self.held.append((raw[keep], ids[keep], leaf[keep]))
        self.n_held += int(keep.sum())
        if self.n_held >= HELD_ROWS:
            self.compare()

    def compare(self) -> None:
        """The rows held so far against the queries that visit their leaves."""
        if not self.n_held:
            return
        raw, ids, leaf = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        self.held, self.n_held = [], 0
        unit, (leaves, at) = unit_rows(raw), np.unique(leaf, return_inverse=True)
        who = np.unique(np.concatenate([self.visits[int(x)] for x in leaves]))
        visited = np.zeros((len(who), len(leaves)), bool)
        for column, x in enumerate(leaves):
            visited[np.searchsorted(who, self.visits[int(x)]), column] = True
        n = min(self.most, len(ids))
        for lo in range(0, len(who), 256):
            q, seen = who[lo : lo + 256], visited[lo : lo + 256][:, at]
            near = np.where(seen, self.unit[q] @ unit.T, -np.inf)
            top = np.argpartition(-near, n - 1, axis=1)[:, :n]
            # the best are scored anew, summed in one order everywhere, so that ties are ties
            exact = np.where(np.take_along_axis(seen, top, 1), cosines(self.raw[q][:, None, :], raw[top]), -np.inf)
            score, best = np.concatenate([self.score[q], exact], axis=1), np.concatenate([self.best[q], ids[top]], axis=1)
            order = np.lexsort((best, -score), axis=1)[:, : self.most]
            self.score[q], self.best[q] = np.take_along_axis(score, order, 1), np.take_along_axis(best, order, 1)

    def results(self) -> pa.RecordBatch:
        self.compare()
        if self.ready:
            good = np.isfinite(self.score[:, : self.copies])
            columns = np.repeat(self.ids, self.copies).reshape(-1, self.copies)[good], self.best[:, : self.copies][good], self.score[:, : self.copies][good]
        else:
            columns = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "id", "score"])


def found(rows: DataFrame, queries: DataFrame, width: int, copies: int) -> DataFrame:
    """(query, id, score): the best ``copies`` candidates of each query and cell.

    A cell's queries are dealt to blocks of at most QUERY_BYTES, and its rows go to each of the blocks. Rows stream by, leaf by leaf.
    """
    per = max(1, QUERY_BYTES // (8 * width))
    counts = queries.groupBy("cell").agg(F.ceil(F.count("*") / per).cast("int").alias("blocks"))  # at most a row for each cell of the forest
    asked = queries.join(F.broadcast(counts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(-1).alias("leaf"), F.lit(0).cast("long").alias("same"), "id", "vec", "leaves")
    offered = rows.join(F.broadcast(counts), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    offered = offered.select("cell", "block", "leaf", "same", "id", "vec", F.lit(None).cast("array<int>").alias("leaves"))
    dealt = asked.union(offered).repartition("cell", "block").sortWithinPartitions("cell", "block", "leaf", "same", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, Cell(width, copies)
        for batch in batches:
            both = np.stack([batch.column(c).to_numpy() for c in (0, 1)])
            cuts = [0, *(np.flatnonzero((both[:, 1:] != both[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if tuple(both[:, a]) != key:
                    yield cell.results()
                    key, cell = tuple(both[:, a]), Cell(width, copies)
                part = batch.slice(a, b - a)
                n = int((part.column("leaf").to_numpy() < 0).sum())
                if n:
                    cell.add_queries(part.slice(0, n))
                if n < part.num_rows:
                    cell.add_rows(part.slice(n))
        yield cell.results()

    return common.map_batches(dealt, run, "query long, id long, score double")


def neighbours(rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", miss: float = MISS, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id ``is_query`` takes, by cosine.

    Ties go to the smaller id. Rows without an id take no part, nor do vectors that are null, zero, or hold a null
    or non-finite component, nor those of another length than the table's commonest. Rows that share an id are all
    candidates; the id is listed once, with its best score, and as a query it has one list, of what its vectors find. A
    query never finds its own id. With fewer than ``k`` candidates all are listed; other columns are ignored; an
    empty table, or one without queries, gives no row.

    Equal vectors are searched once, and of equal candidates a task sends on the k + 1 smallest ids, all that a list can show.
    """
    spark = rows.sparkSession
    folder = common.shared_dir(spark)
    held, n, width = usable(rows, vec_id, vector)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = spark.sparkContext.broadcast(fit(held, n, width, trees, leaf_rows))  # bounded by SAMPLE_BYTES
    queries = held.where(is_query(F.col("id")))
    distinct = common.stored(queries.select("vec").distinct().select(F.monotonically_increasing_id().alias("id"), "vec"), folder, "distinct")
    owners = common.stored(queries.join(distinct.withColumnRenamed("id", "query"), "vec").select("query", F.col("id").alias("query_id")), folder, "owners")
    visits = common.stored(walks(distinct, forest, width, k, miss), folder, "visits")
    parts = found(dealt_rows(held, forest, width, k + 1), visits, width, k + 1).distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = parts.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    each = owners.join(near, "query").where("id != query_id").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
