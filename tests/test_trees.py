"""Trees on cells: against Spark's own trees on rows, and whatever the partitioning."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from fluxloom.operators import gapfill, trees

N = 900


@pytest.fixture(scope="module")
def few_values(spark):
    """Features of at most 32 values, so that bins lose nothing."""
    rng = np.random.default_rng(21)
    a, b, c = rng.integers(0, 30, N), rng.integers(0, 12, N), rng.integers(0, 3, N)
    y = np.sin(a / 4) * 5 + (b > 6) * c + rng.normal(0, 0.5, N)
    rows = [(1, k, float(a[k]), float(b[k]), float(c[k]), float(y[k]) if k % 7 else None) for k in range(N)]
    df = spark.createDataFrame(rows, "site int, k int, a double, b double, c double, y double")
    return df.withColumn("datetime", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 30 * k, 0)")).drop("k")


def said(done, short):
    return {r["datetime"]: r[f"y_{short}pred_all"] for r in done.table.collect()}


def same(x, y, by=1e-9):
    return x.keys() == y.keys() and len(x) == N and all(abs(x[k] - y[k]) < by for k in x)


@pytest.mark.parametrize("depth", [3, 30])
def test_a_tree_on_cells_is_sparks_tree(spark, few_values, depth):
    args = (few_values, "y", "use_custom_X_col", ["a", "b", "c"])
    one = gapfill.fill_random_forest(*args, True, ["site"], trees=1, max_depth=depth)
    spark_tree = gapfill._trees(few_values, "y", "RF", DecisionTreeRegressor(maxDepth=depth), args[2], args[3], True, ["site"], 0.0)
    mine, theirs = said(one, "RF"), said(spark_tree, "RF")
    # a row whose values no training row shares may meet a cut elsewhere between two training values
    assert np.mean([abs(mine[k] - theirs[k]) < 1e-9 for k in mine]) > 0.97 and len(mine) == N
    shares = lambda d: np.array([r["importance"] for r in d.importance.collect()])
    assert np.allclose(shares(one), shares(spark_tree), atol=0.01) and abs(shares(one).sum() - 1) < 1e-9


def test_boosting_on_cells_is_sparks_boosting_on_rows(spark, few_values):
    args = (few_values, "y", "use_custom_X_col", ["a", "b", "c"])
    cells = gapfill.fill_gbt(*args, True, ["site"], rounds=8)
    rows = gapfill._trees(few_values, "y", "XGB", GBTRegressor(maxDepth=3, stepSize=0.1, maxIter=8, seed=0), args[2], args[3], True, ["site"], 0.0)
    assert same(said(cells, "XGB"), said(rows, "XGB"), 1e-6)


def test_fits_do_not_depend_on_partitions(spark, few_values):
    noisy = few_values.withColumn("d", F.pmod(F.xxhash64("datetime"), F.lit(100_003)).cast("double"))
    for short, params in (("RF", {"trees": 4}), ("XGB", {"rounds": 4})):
        one, other = (said(gapfill.FILL[short](noisy.repartition(n), "y", "use_custom_X_col", ["a", "b", "c", "d"], True, ["site"], **params), short) for n in (1, 7))
        assert same(one, other)


@pytest.mark.parametrize("features,depth", [("all", 30), ("sqrt", 30), ("all", 4)])
def test_large_nodes_split_by_jobs_grow_the_same_forest(spark, few_values, features, depth):
    cols = ["a", "b", "c"]
    rows = few_values.withColumns({"__y": F.col("y"), "__known": F.col("y").isNotNull()})
    rows = rows.withColumn("__bins", trees.binned(cols, trees.bin_cuts(rows.where("__known"), cols)))
    found = []
    for node_cells in (trees.NODE_CELLS, 40):
        cells, shares = trees.forest(rows, cols, ["site"], 3, depth, features, node_cells)
        found.append(({tuple(r["__bins"]): r["__p"] for r in cells.collect()}, shares))
    (whole, a), (cut, b) = found
    assert whole.keys() == cut.keys() and len(whole) > 300 and all(abs(whole[k] - cut[k]) < 1e-9 for k in whole)
    assert np.allclose(a, b)


def test_a_large_node_that_no_feature_splits_is_a_leaf(spark):
    rows = spark.range(200).select(F.lit(1).alias("site"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 30 * cast(id as int), 0)").alias("datetime"), F.lit(2.5).alias("__y"), F.lit(True).alias("__known"), F.array((F.col("id") % 20).cast("int"), F.lit(0)).alias("__bins"))
    cells, shares = trees.forest(rows, ["a", "b"], ["site"], 2, 30, "all", 5)
    assert {r["__p"] for r in cells.collect()} == {2.5} and cells.count() == 20 and shares.sum() == 0


@pytest.mark.parametrize("features,size", [("all", 9), ("auto", 3), ("onethird", 3), ("sqrt", 3), ("log2", 4), ("0.5", 5), ("1.0", 9), ("4", 4), ("40", 9)])
def test_choices_of_features(features, size):
    assert trees.subset_size(features, 9, 10) == size


def test_unknown_choices_are_refused(spark, few_values):
    for wrong in ("some", "0", "1.5", "-1"):
        with pytest.raises(ValueError):
            trees.subset_size(wrong, 9, 10)
    with pytest.raises(ValueError):
        gapfill.fill_random_forest(few_values, "y", "use_custom_X_col", ["a"], keys=["site"], max_depth=31)


def test_a_feature_of_many_equal_values_keeps_its_cuts(spark):
    df = spark.createDataFrame([(float(v),) for v in [*[0] * 3000, *range(1, 1001)]], "a double")
    (cuts,) = trees.bin_cuts(df, ["a"])
    assert len(cuts) == trees.BINS - 1 and cuts[0] < 1 and max(np.diff(cuts)) < 100
