"""Regression trees on binned features: rows alike are one cell, large nodes are split by Spark, the rest grows in tasks.

A tree on bins can't tell rows of equal bins apart, so it is grown on their sums. No model passes through the driver or to
all tasks: a cell's prediction is made where its node is grown, and meets the rows in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, stored
from .quantiles import selected_quantiles
from .ustar import poisson_sample

#: Bins of a feature, as many as Spark's own trees have.
BINS = 32
#: Cells of a node that one task grows to the end; a larger node is split by a job.
NODE_CELLS = 50_000
#: Gains that differ by less are the same but for rounding; a share of a node's sum of squares.
SAME, NO_GAIN = 1e-9, 1e-18
#: Cells of a task of Spark's boosted trees. These look for a feature's values in a sample of the square of their bins: all cells, for a million.
FIT_CELLS, SEEN_BINS = 20_000, 1024
#: Nodes of a level whose sums a task holds at a time.
NODES = 1024
#: Node numbers are those of Spark's own trees: root 1, children 2n and 2n + 1.
DEEPEST = 30


def quantile_cuts(known: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """BINS - 1 cuts at most of each column, at quantiles. Values that fill a bin alone get one, and the other values share the rest."""
    shares = lambda n: [k / (n + 1) for k in range(1, n + 1)]
    ask = lambda df, names, at: {r["variable"]: r["quantiles"] for r in selected_quantiles(df, names, at).collect()} if names else {}
    found = ask(known, list(cols), shares(BINS - 1))
    heavy = {c: [v for v, n in zip(*np.unique(q, return_counts=True), strict=True) if n > 1] for c, q in found.items()}
    edges = {c: {float(e) for v in vs for e in (np.nextafter(v, -np.inf), v)} for c, vs in heavy.items() if vs}
    left = {c: shares(BINS - 1 - len(e)) for c, e in edges.items()}
    at = sorted({p for ps in left.values() for p in ps})
    others = known.select([F.when(~F.col(c).isin([float(v) for v in heavy[c]]), F.col(c)).alias(c) for c in edges])
    rest = {c: dict(zip(at, q, strict=True)) for c, q in ask(others, list(edges), at).items()}
    return {c: sorted(edges[c] | {rest[c][p] for p in left[c] if c in rest} if c in edges else set(q)) for c, q in found.items()}


def bin_cuts(known: DataFrame, cols: Sequence[str]) -> list[list[float]]:
    """For each column ascending numbers, BINS - 1 at most: midpoints of its values if they are few, else quantiles."""
    about = known.agg(*[F.approx_count_distinct(c) for c in cols]).first()
    few = [c for c, n in zip(cols, about, strict=True) if n <= 2 * BINS]
    # sets of about 2 * BINS values
    values = dict(zip(few, known.agg(*[F.sort_array(F.collect_set(c)) for c in few]).first(), strict=True)) if few else {}
    values = {c: v for c, v in values.items() if len(v) <= BINS}
    found = quantile_cuts(known, [c for c in cols if c not in values])
    return [[a / 2 + b / 2 for a, b in zip(values[c], values[c][1:])] if c in values else found.get(c, []) for c in cols]


def binned(cols: Sequence[str], cuts: Sequence[Sequence[float]]) -> Column:
    """The bins of a row's features: the number of cuts below each."""
    below = lambda c, at: F.size(F.filter(F.array(*map(F.lit, at)), lambda cut: cut < F.col(c))) if at else F.lit(0)
    return F.array(*[below(c, at) for c, at in zip(cols, cuts, strict=True)])


def subset_size(features: str, d: int, trees: int) -> int:
    """Features that a node chooses among, by the names that Spark's forests have for it, a share or a number."""
    named = {"all": d, "sqrt": np.ceil(np.sqrt(d)), "log2": np.ceil(np.log2(d)) if d > 1 else 1, "onethird": np.ceil(d / 3)}
    named["auto"] = named["all"] if trees == 1 else named["onethird"]
    if features in named:
        return max(1, int(named[features]))
    try:
        number = int(features) if features.isdigit() else int(np.ceil(float(features) * d))
    except ValueError:
        raise ValueError(f"unknown choice of features: {features!r}") from None
    if number < 1 or (not features.isdigit() and float(features) > 1):
        raise ValueError(f"unknown choice of features: {features!r}")
    return min(d, number)


def best_splits(w: np.ndarray, s: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, last bin of the left side, gain) of most gain for each node: from weights and weighted sums, nodes by features by bins."""
    total, whole = w[:, 0].sum(axis=1), s[:, 0].sum(axis=1)
    cw, cs = np.cumsum(w, axis=2)[:, :, :-1], np.cumsum(s, axis=2)[:, :, :-1]
    rw, rs = total[:, None, None] - cw, whole[:, None, None] - cs
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((cw > 0) & (rw > 0) & allowed[:, :, None], cw * rw / total[:, None, None] * (cs / cw - rs / rw) ** 2, 0.0)
        least = np.where(total > 0, NO_GAIN * whole * whole / total, 0.0)
    gain = gain.reshape(len(w), -1)
    top = gain.max(axis=1)
    at = np.argmax(gain >= top[:, None] * (1 - SAME), axis=1)
    return np.where(top > least, at // cw.shape[2], -1), at % cw.shape[2], gain[np.arange(len(w)), at]


def chosen(d: int, size: int, tree: int, node: int) -> np.ndarray:
    """Which features a node may be split by; the same wherever the node is split."""
    allowed = np.ones(d, bool)
    if size < d:
        allowed[np.random.default_rng([tree, node]).permutation(d)[size:]] = False
    return allowed


def grow(bins: np.ndarray, w: np.ndarray, s: np.ndarray, tree: int, node: int, max_depth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of the cells below a node, and the gain by each feature. Cells of weight 0 only get a prediction."""
    n, d = bins.shape
    flat, place, gains, rows = bins + np.arange(d) * BINS, np.full(n, node), np.zeros(d), np.arange(n)
    for _ in range(max_depth + 1 - node.bit_length()):  # a level, of which NODES nodes at a time
        rows = rows[np.argsort(place[rows], kind="stable")]
        nodes, starts = np.unique(place[rows], return_index=True)
        split = []
        for k in range(0, len(nodes), NODES):
            part = rows[starts[k] : starts[k + NODES] if k + NODES < len(nodes) else len(rows)]
            ids, at = np.unique(place[part], return_inverse=True)
            to = (at[:, None] * (d * BINS) + flat[part]).ravel()
            hist = [np.bincount(to, np.repeat(v[part], d), len(ids) * d * BINS).reshape(len(ids), d, BINS) for v in (w, s)]
            j, cut, gain = best_splits(*hist, np.stack([chosen(d, size, tree, int(i)) for i in ids]) if size < d else np.ones((len(ids), d), bool))
            np.add.at(gains, j[j >= 0], gain[j >= 0])
            part, at = part[j[at] >= 0], at[j[at] >= 0]
            place[part] = 2 * place[part] + (bins[part, j[at]] > cut[at])
            split.append(part)
        rows = np.concatenate(split) if split else rows[:0]
    _, at = np.unique(place, return_inverse=True)
    return (np.bincount(at, s) / np.bincount(at, w))[at], gains


def cell_sums(rows: DataFrame, trees: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """(__bins, tree, w, s): weight and weighted sum of __y over the known rows of each cell, for each tree; 0 for a cell without any.

    A tree's weights are a bootstrap by Poisson weights, where there is more than one tree. A tree that draws no row at all takes all.
    """
    known = rows.where("__known")
    plain = known.select("__bins", F.lit(1).cast("long").alias("w"), F.col("__y"))
    all_trees = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    none = rows.select("__bins").distinct().select("__bins", all_trees, F.lit(0).cast("long").alias("w"), F.lit(0.0).alias("s"))
    if trees == 1:
        drawn, empty = plain.select("__bins", F.lit(0).alias("tree"), "w", F.col("__y").alias("s")), []
    else:
        drawn = poisson_sample(known, trees, seed, keys).select("__bins", F.col("rep").alias("tree"), F.col("weight").alias("w"), (F.col("weight") * F.col("__y")).alias("s"))
        empty = sorted({*range(trees)} - {r["tree"] for r in drawn.select("tree").distinct().collect()}) if known.count() < 1000 else []
    if empty:
        drawn = drawn.union(plain.select("__bins", F.explode(F.array(*map(F.lit, empty))).alias("tree"), "w", F.col("__y").alias("s")))
    return none.union(drawn).groupBy("__bins", "tree").agg(F.sum("w").cast("double").alias("w"), F.sum("s").alias("s"))


def split_large(cells: DataFrame, d: int, max_depth: int, size: int, node_cells: int) -> tuple[DataFrame, list[tuple[int, int]], int, list[tuple[int, int, float]]]:
    """Cells with their ``node``, split until none that can be split holds more than ``node_cells``.

    With it come the large nodes that can't be split, how many nodes there are, and (tree, feature, gain) of the splits. A round is a
    job on sums by node, feature and bin. The driver gets a row for each node, of which there are few: its cells, its split.
    """
    now, gains, spark, ended = cells.withColumn("node", F.lit(1).cast("long")), [], cells.sparkSession, set()

    def split(key: tuple, hist: pd.DataFrame) -> pd.DataFrame:
        tree, node = map(int, key)
        w, s = np.zeros((2, 1, d, BINS))
        w[0, hist["j"], hist["bin"]], s[0, hist["j"], hist["bin"]] = hist["w"], hist["s"]
        j, k, gain = best_splits(w, s, chosen(d, size, tree, node)[None])
        return pd.DataFrame({"tree": tree, "node": node, "j": j, "k": k, "gain": gain})

    while True:
        counts = {(r["tree"], r["node"]): r["count"] for r in now.groupBy("tree", "node").count().collect()}
        large = [k for k, n in counts.items() if n > node_cells]
        ended |= {k for k in large if k[1].bit_length() > max_depth}
        large = [k for k in large if k not in ended]
        if not large:
            return now, sorted(ended), len(counts), gains
        wanted = F.broadcast(spark.createDataFrame(large, "tree int, node long"))
        each = now.join(wanted, ["tree", "node"]).select("tree", "node", "w", "s", F.posexplode("__bins").alias("j", "bin"))
        hist = each.groupBy("tree", "node", "j", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
        found = hist.groupBy("tree", "node").applyInPandas(split, "tree int, node long, j int, k int, gain double").collect()
        ended |= {(r["tree"], r["node"]) for r in found if r["j"] < 0}
        made = [(r["tree"], r["node"], r["j"], r["k"]) for r in found if r["j"] >= 0]
        gains += [(r["tree"], r["j"], r["gain"]) for r in found if r["j"] >= 0]
        if made:
            splits = F.broadcast(spark.createDataFrame(made, "tree int, node long, j int, k int"))
            down = F.when(F.col("j").isNull(), F.col("node")).otherwise(2 * F.col("node") + (F.get("__bins", F.col("j")) > F.col("k")).cast("long"))
            now = now.join(splits, ["tree", "node"], "left").withColumn("node", down).drop("j", "k")


def forest(rows: DataFrame, cols: Sequence[str], keys: Sequence[str], trees: int, max_depth: int, features: str, node_cells: int = NODE_CELLS) -> tuple[DataFrame, np.ndarray]:
    """(__bins, __p): the mean of all trees' predictions for each cell of ``rows`` (__bins, __known, __y, keys, datetime), and importance by feature.

    Importance is each feature's share of a tree's gain, averaged over the trees that split at all.
    """
    if not 0 <= max_depth <= DEEPEST or trees < 1:
        raise ValueError(f"a forest has a tree at least, of depth 0 to {DEEPEST}")
    d, folder = len(cols), shared_dir(rows.sparkSession)
    size = subset_size(features, d, trees)
    cells = stored(cell_sums(rows, trees, keys), folder, "cells")
    nodes, ended, count, top = split_large(cells, d, max_depth, size, node_cells)
    schema = "__bins array<int>, tree int, __p double, j int, gain double"

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree, node = map(int, key)
        bins = np.stack(part["__bins"].to_list()).astype(np.int64)
        order = np.lexsort(bins.T[::-1])  # one order, so that sums round alike
        value, gains = grow(bins[order], part["w"].to_numpy()[order], part["s"].to_numpy()[order], tree, node, max_depth, size)
        return pd.DataFrame({
            "__bins": [*bins[order], *[None] * d], "tree": tree, "__p": np.concatenate([value, np.full(d, np.nan)]),
            "j": np.concatenate([np.full(len(value), -1), np.arange(d)]), "gain": np.concatenate([np.zeros(len(value)), gains]),
        })

    grown = nodes
    if ended:  # a large node that can't be split needs its sums only
        marks = F.broadcast(nodes.sparkSession.createDataFrame(ended, "tree int, node long"))
        grown, whole = nodes.join(marks, ["tree", "node"], "left_anti"), nodes.join(marks, ["tree", "node"])
        means = whole.groupBy("tree", "node").agg((F.sum("s") / F.sum("w")).alias("__p"))
        leaves = whole.join(F.broadcast(means), ["tree", "node"]).select("__bins", "tree", "__p", F.lit(-1).alias("j"), F.lit(0.0).alias("gain"))
    done = grown.repartition(2 * count, "tree", "node").groupBy("tree", "node").applyInPandas(finish, schema)  # few rows, much work: not to be put together
    done = stored(done.union(leaves) if ended else done, folder, "grown")
    gains = np.zeros((trees, d))
    for r in done.where("j >= 0").groupBy("tree", "j").agg(F.sum("gain").alias("gain")).collect():  # trees by features
        gains[r["tree"], r["j"]] += r["gain"]
    for tree, j, gain in top:
        gains[tree, j] += gain
    total = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).sum(axis=0)
    return done.where("j < 0").groupBy("__bins").agg(F.avg("__p").alias("__p")), shares / (shares.sum() or 1.0)


def boosted(rows: DataFrame, cols: Sequence[str], keys: Sequence[str], estimator: GBTRegressor) -> tuple[DataFrame, np.ndarray]:
    """(__bins, __p) for each cell of ``rows``, as for ``forest``, by Spark's boosted trees on the cells' means and weights, and importance.

    By squared errors that is the fit on the rows in these bins, if all rows count in each round and a leaf may hold one row.
    """
    folder = shared_dir(rows.sparkSession)
    made = cell_sums(rows, 1, keys).select("__bins", array_to_vector(F.transform("__bins", lambda b: b.cast("double"))).alias("__x"), (F.col("s") / F.nullif("w", F.lit(0.0))).alias("__y"), "w")
    cells = stored(made, folder, "cells")
    # a hundred rounds of several jobs: tasks by the cells' number, in an order that no run changes
    parts = max(1, -(-cells.count() // FIT_CELLS))
    known = cells.where("w > 0").repartition(parts, "__bins").sortWithinPartitions("__bins").select("__x", "__y", "w").cache()
    try:
        model = estimator.setFeaturesCol("__x").setLabelCol("__y").setWeightCol("w").setPredictionCol("__p").setMaxBins(SEEN_BINS).fit(known)
    finally:
        known.unpersist()
    return model.transform(cells).select("__bins", "__p"), model.featureImportances.toArray()
