"""Gap filling by boosted trees, random forest, AdaBoost and a neural regressor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import shared_dir, stored
from . import trees as trees_
from .clean import CANONICAL_ERA5, col

# Columns of the exchanged datasets, and the names by which methods are called.
NOT_FEATURES = ("datetime", "LE", "NEE", "H", "SHF", "u*")
NOT_NEGATIVE = ("SWC", "SWIN", "PPFD", "RH", "VPD", "Rn", "Rg", "pr")
METHODS = {"XGboost": "XGB", "XGB": "XGB", "XGb": "XGB", "RandomForest": "RF", "RF": "RF", "Adaboost": "Ada", "Ada": "Ada", "NeuralNetwork": "ANN", "ANN": "ANN"}
#: A network's fit ends when its loss has not fallen by TOLERANCE for PATIENCE rounds.
TOLERANCE, PATIENCE = 1e-4, 2
#: Training rows that a network's task holds.
SHARD_ROWS = 10_000
#: Rounds of AdaBoost between two stored tables of weights.
STORE_ROUNDS = 10


@dataclass
class Filled:
    """The table with its new columns, metrics (part, rmse, mae, r2), and importance of features where there is any."""

    table: DataFrame
    metrics: DataFrame
    importance: DataFrame | None = None


def split_known_missing(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.where(col(target).isNotNull()), df.where(col(target).isNull())


def feature_columns(df: DataFrame, target: str, mode: str = "all", x_col: Sequence[str] | None = None, keys: Sequence[str] = ()) -> list[str]:
    if mode == "use_era5_only":
        return [c for c in ["DOY", *CANONICAL_ERA5[:7]] if c in df.columns]
    if mode == "use_custom_X_col":
        if not x_col:
            raise ValueError("use_custom_X_col needs X_col")
        return list(x_col)
    if target in NOT_FEATURES:
        raise ValueError(f"{target} needs a list of feature columns")
    numbers = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")}
    return [c for c in df.columns if c in numbers and c not in (*NOT_FEATURES, *keys, target) and not c.startswith("__")]


def train_test(df: DataFrame, keys: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """__test: three rows in ten, by a hash of seed, keys and datetime, whatever the partitioning."""
    label = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys], F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    return df.withColumn("__test", F.conv(F.substr(F.md5(label), F.lit(1), F.lit(8)), 16, 10).cast("long") % 10 < 3)


def impute_constant(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.fillna(value, subset=list(cols))


def fit_metrics(scored: DataFrame, target: str, prediction: str, part: str = "__test", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, part, rmse, mae, r2, n) of training and test rows in one aggregate."""
    e, y = col(target) - col(prediction), col(target)
    return scored.groupBy(*[col(k) for k in keys], F.when(F.col(part), "test").otherwise("train").alias("part")).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.count(y) * F.var_pop(y))).alias("r2"), F.count(y).alias("n")
    )


def clamp_nonnegative(prediction, target: str, short: str):
    """Boosted-tree predictions of quantities that can't be negative, at zero or above."""
    return F.greatest(prediction, F.lit(0.0)) if short == "XGB" and target in NOT_NEGATIVE else prediction


def gap_filled(df: DataFrame, target: str, short: str, prediction: str, pred_all: bool = False) -> DataFrame:
    """<target>_<M>pred on missing rows, <target>_<M>GapFilled, and <target>_<M>pred_all on request."""
    p = clamp_nonnegative(col(prediction), target, short)
    out = df.withColumn(f"{target}_{short}pred", F.when(col(target).isNull(), p))
    out = out.withColumn(f"{target}_{short}GapFilled", F.coalesce(col(f"{target}_{short}pred"), col(target)))
    return out.withColumn(f"{target}_{short}pred_all", p) if pred_all else out


def _features(df: DataFrame, target: str, mode: str, x_col, keys, fill: float) -> tuple[DataFrame, list[str]]:
    """The rows with __test and features __f0.. as doubles, and the features' names."""
    names = feature_columns(df, target, mode, x_col, keys)
    safe = {c: f"__f{i}" for i, c in enumerate(names)}
    if not names:
        raise ValueError(f"no feature columns for {target} in mode {mode!r}")
    return impute_constant(train_test(df, keys).withColumns({s: col(c).cast("double") for c, s in safe.items()}), list(safe.values()), fill), names


def _prepared(df: DataFrame, target: str, mode: str, x_col, keys, fill: float) -> tuple[DataFrame, list[str]]:
    made, names = _features(df, target, mode, x_col, keys, fill)
    safe = [f"__f{i}" for i in range(len(names))]
    return VectorAssembler(inputCols=safe, outputCol="__x").transform(made).drop(*safe), names


def _importance(df: DataFrame, shares, names: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(names, shares, strict=True)], "feature string, importance double")


def _trees(df: DataFrame, target: str, short: str, estimator, mode, x_col, pred_all, keys, fill) -> Filled:
    rows, names = _prepared(df, target, mode, x_col, keys, fill)
    rows = rows.withColumn("__y", col(target).cast("double"))
    known = rows.where("__y is not null and not __test").select("__x", "__y").cache()
    try:
        model = estimator.setFeaturesCol("__x").setLabelCol("__y").setPredictionCol("__p").fit(known) if known.head(1) else None
    finally:
        known.unpersist()
    scored = model.transform(rows) if model else rows.withColumn("__p", F.lit(None).cast("double"))
    table = gap_filled(scored, target, short, "__p", pred_all).drop("__x", "__y", "__test", "__p")
    shares = model.featureImportances.toArray() if model else [0.0] * len(names)
    return Filled(table, fit_metrics(scored.where("__y is not null"), "__y", "__p"), _importance(df, shares, names))


def _by_cells(df: DataFrame, target: str, short: str, fit, mode, x_col, pred_all, keys, fill) -> Filled:
    """Trees on cells: ``fit`` gets rows of (__bins, __known, __y, keys, datetime) and the features, and returns (__bins, __p) and importance."""
    made, names = _features(df, target, mode, x_col, keys, fill)
    safe = [f"__f{i}" for i in range(len(names))]
    made = made.withColumn("__y", col(target).cast("double"))
    known = F.col("__y").isNotNull() & ~F.col("__test")
    narrow = stored(made.select(*[col(k) for k in keys], "datetime", "__y", known.alias("__known"), *safe), shared_dir(df.sparkSession), "rows")
    if narrow.where("__known").head(1):
        bins = trees_.binned(safe, trees_.bin_cuts(narrow.where("__known"), safe))
        said, shares = fit(narrow.withColumn("__bins", bins), safe)
        scored = made.withColumn("__bins", bins).join(said, "__bins", "left").drop("__bins")
    else:
        scored, shares = made.withColumn("__p", F.lit(None).cast("double")), [0.0] * len(names)
    table = gap_filled(scored, target, short, "__p", pred_all).drop(*safe, "__y", "__test", "__p")
    return Filled(table, fit_metrics(scored.where("__y is not null"), "__y", "__p"), _importance(df, shares, names))


def gram(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, total): sums of products of all pairs of ``names`` and a column of ones (named '1'), a <= b in this order, for each series.

    One aggregate, of which only sums are shuffled. Without keys there is one series.
    """
    listed = {"1": F.lit(1.0), **{c: col(c).cast("double") for c in names}}
    pairs = [(a, b) for i, a in enumerate(listed) for b in list(listed)[i:]]
    one = df.groupBy(*[col(k) for k in keys]).agg(*[F.sum(listed[a] * listed[b]).alias(f"__{k}") for k, (a, b) in enumerate(pairs)])
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(f"__{k}", F.lit(0.0)).alias("total")) for k, (a, b) in enumerate(pairs)]
    return one.select(*[col(k) for k in keys], F.explode(F.array(*each)).alias("__e")).select(*[col(k) for k in keys], "__e.*")


def boosted_linear(sums: np.ndarray, rounds: int, rate: float, alpha: float, lambda_: float) -> np.ndarray:
    """Intercept and weights of a linear model boosted by rounds of coordinate descent with soft thresholds.

    ``sums``: the Gram matrix of (1, features, target), or a stack of them (any leading axes), all of which advance together. A
    round moves the intercept by its Newton step and then each weight in turn, all by ``rate``. Penalties are a row's, so alpha
    and lambda weigh alike on tables of any length. For alpha 0 the rounds tend to the ridge solution. No rows: weights of zero.
    """
    g, c = sums[..., :-1, :-1], sums[..., :-1, -1]
    n, w = g[..., 0, 0], np.zeros(c.shape)
    part = lambda top, bottom: np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)
    slope = lambda j: (g[..., j, :] * w).sum(axis=-1) - c[..., j]
    for _ in range(rounds):
        w[..., 0] -= rate * part(slope(0), n)
        for j in range(1, w.shape[-1]):
            curve = g[..., j, j] + n * lambda_
            free = w[..., j] - part(slope(j) + n * lambda_ * w[..., j], curve)  # the least without alpha
            moved = np.sign(free) * np.maximum(np.abs(free) - part(n * alpha, curve), 0.0) - w[..., j]
            w[..., j] += np.where(curve > 0, rate * moved, 0.0)
    return w


def fill_linear(df: DataFrame, target: str, mode: str = "all", X_col=None, pred_all: bool = False, keys: Sequence[str] = (), fill: float = 0.0, rounds: int = 100, rate: float = 0.1, reg_alpha: float = 0.0, reg_lambda: float = 1.0) -> Filled:
    """``boosted_linear`` of all series' known training rows: one aggregate of products, whatever their number.

    Importance is each weight's share of all weights' sizes. Without known rows predictions are null.
    """
    names = feature_columns(df, target, mode, X_col, keys)
    if not names:
        raise ValueError(f"no feature columns for {target} in mode {mode!r}")
    safe = {c: f"__f{i}" for i, c in enumerate(names)}
    made = train_test(df, keys).withColumns({s: col(c).cast("double") for c, s in safe.items()}).withColumn("__y", col(target).cast("double"))
    rows = impute_constant(made, list(safe.values()), fill)
    used = [*safe.values(), "__y"]
    place = {c: k for k, c in enumerate(["1", *used])}
    sums = np.zeros((len(place), len(place)))
    for r in gram(rows.where("__y is not null and not __test"), used).collect():  # a row for each pair of features
        sums[place[r["a"]], place[r["b"]]] = sums[place[r["b"]], place[r["a"]]] = r["total"]
    w = boosted_linear(sums, rounds, rate, reg_alpha, reg_lambda)
    prediction = sum((F.lit(float(v)) * col(s) for v, s in zip(w[1:], safe.values(), strict=True)), F.lit(float(w[0])))
    scored = rows.withColumn("__p", prediction if sums[0, 0] else F.lit(None).cast("double"))
    table = gap_filled(scored, target, "XGB", "__p", pred_all).drop(*used, "__test", "__p")
    size = np.abs(w[1:]).sum()
    importance = df.sparkSession.createDataFrame([(c, float(abs(v) / size) if size else 0.0) for c, v in zip(names, w[1:], strict=True)], "feature string, importance double")
    return Filled(table, fit_metrics(scored.where("__y is not null"), "__y", "__p"), importance)


def series_weights(rows: DataFrame, used: Sequence[str], keys: Sequence[str], rounds: int, rate: float, alpha: float, lambda_: float) -> DataFrame:
    """(__k0.. for the keys, __w): ``boosted_linear`` weights of each series from the sums of its rows, many series at a time in a task."""
    named = [f"__k{i}" for i in range(len(keys))]
    place = {c: k for k, c in enumerate(["1", *used])}
    sums = gram(rows.select(*[col(k).alias(n) for k, n in zip(keys, named, strict=True)], *used), used, named)
    flat = sums.groupBy(*named).agg(F.collect_list(F.struct("a", "b", "total")).alias("__s"))  # as many as there are pairs of columns

    def solve(batches):
        for part in batches:
            stack = np.zeros((len(part), len(place), len(place)))
            for i, cells in enumerate(part["__s"]):
                for cell in cells:
                    stack[i, place[cell["a"]], place[cell["b"]]] = stack[i, place[cell["b"]], place[cell["a"]]] = cell["total"]
            yield part[named].assign(__w=list(boosted_linear(stack, rounds, rate, alpha, lambda_)))

    return flat.mapInPandas(solve, StructType([*[flat.schema[n] for n in named], StructField("__w", ArrayType(DoubleType()))]))


def fill_linear_per_key(df: DataFrame, target: str, mode: str = "all", X_col=None, pred_all: bool = False, keys: Sequence[str] = (), fill: float = 0.0, rounds: int = 100, rate: float = 0.1, reg_alpha: float = 0.0, reg_lambda: float = 1.0) -> Filled:
    """``fill_linear`` with a model for each series, equal to one fitted on the series' rows alone.

    One job for any number of series: only sums are shuffled, and each series' weights meet its rows in a join; null keys are a series of
    their own. Metrics and importance carry the keys. A series without known training rows has null predictions, and no importance.
    """
    names = feature_columns(df, target, mode, X_col, keys)
    if not names or not keys:
        raise ValueError(f"models for each series need keys and feature columns for {target} in mode {mode!r}")
    safe = {c: f"__f{i}" for i, c in enumerate(names)}
    made = train_test(df, keys).withColumns({s: col(c).cast("double") for c, s in safe.items()}).withColumn("__y", col(target).cast("double"))
    rows = impute_constant(made, list(safe.values()), fill)
    used, named = [*safe.values(), "__y"], [f"__k{i}" for i in range(len(keys))]
    weights = series_weights(rows.where("__y is not null and not __test"), used, keys, rounds, rate, reg_alpha, reg_lambda)
    weights = stored(weights, shared_dir(df.sparkSession), "weights")  # a row for each series, read for predictions and importance
    met = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named, strict=True)])
    prediction = reduce(lambda a, i: a + F.col("__w")[i + 1] * F.col(f"__f{i}"), range(len(names)), F.col("__w")[0])
    scored = rows.join(weights, met, "left").withColumn("__p", prediction).drop(*named, "__w")
    table = gap_filled(scored, target, "XGB", "__p", pred_all).drop(*used, "__test", "__p")
    sizes = [F.abs(F.col("__w")[i + 1]) for i in range(len(names))]
    whole = reduce(lambda a, b: a + b, sizes)
    shares = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(whole > 0, v / whole).otherwise(0.0).alias("importance")) for c, v in zip(names, sizes, strict=True)])
    importance = weights.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], F.explode(shares).alias("__e")).select(*[col(k) for k in keys], "__e.*")
    return Filled(table, fit_metrics(scored.where("__y is not null"), "__y", "__p", keys=keys), importance)


def fill_gbt(df: DataFrame, target: str, mode: str = "all", X_col=None, pred_all: bool = False, keys: Sequence[str] = (), fill: float = 0.0, max_depth: int = 3, step_size: float = 0.1, rounds: int = 100, subsample: float = 1.0, min_instances: int = 1, booster: str = "gbtree", reg_alpha: float = 0.0, reg_lambda: float = 1.0, per_key: bool = False) -> Filled:
    """Boosted trees, or with ``booster='gblinear'`` the boosted linear model, to which alone the two penalties and ``per_key`` apply."""
    if per_key and booster != "gblinear":
        raise ValueError("models for each series are linear: booster='gblinear'")
    if booster == "gblinear":
        return (fill_linear_per_key if per_key else fill_linear)(df, target, mode, X_col, pred_all, keys, fill, rounds, step_size, reg_alpha, reg_lambda)
    if booster != "gbtree":
        raise ValueError(f"booster must be gbtree or gblinear, not {booster!r}")
    e = GBTRegressor(maxDepth=max_depth, stepSize=step_size, maxIter=rounds, subsamplingRate=subsample, minInstancesPerNode=min_instances, seed=0)
    if subsample == 1.0 and min_instances == 1:  # else single rows count
        return _by_cells(df, target, "XGB", lambda rows, cols: trees_.boosted(rows, cols, keys, e), mode, X_col, pred_all, keys, fill)
    return _trees(df, target, "XGB", e, mode, X_col, pred_all, keys, fill)


def fill_random_forest(df: DataFrame, target: str, mode: str = "all", X_col=None, pred_all: bool = False, keys: Sequence[str] = (), fill: float = 0.0, trees: int = 10, max_depth: int = 30, features: str = "all") -> Filled:
    """Trees on binned features, each on rows by Poisson weights; see ``trees.forest``."""
    fit = lambda rows, cols: trees_.forest(rows, cols, keys, trees, max_depth, features)
    return _by_cells(df, target, "RF", fit, mode, X_col, pred_all, keys, fill)


def fill_adaboost(df: DataFrame, target: str, mode: str = "all", X_col=None, pred_all: bool = False, keys: Sequence[str] = (), fill: float = 0.0, estimators: int = 100, rate: float = 1.0, max_depth: int = 3) -> Filled:
    """AdaBoost.R2 with linear loss: weighted trees, weights by each tree's errors, and the weighted median of all trees.

    The rows' weights are stored every STORE_ROUNDS rounds, so a plan spans few rounds and a lost executor repeats few.
    """
    rows, _ = _prepared(df, target, mode, X_col, keys, fill)
    rows = rows.withColumn("__y", col(target).cast("double"))
    folder = shared_dir(df.sparkSession)
    boosted = stored(rows.where("__y is not null and not __test").select("__x", "__y", F.lit(1.0).alias("__w")), folder, "round-0").cache()
    models, weights, total = [], [], float(boosted.count())
    for k in range(estimators if total else 0):
        model = DecisionTreeRegressor(featuresCol="__x", labelCol="__y", weightCol="__w", predictionCol="__p", maxDepth=max_depth, seed=k).fit(boosted)
        err = model.transform(boosted).withColumn("__e", F.abs(F.col("__y") - F.col("__p")))
        top, loss, mass = err.agg(F.max("__e"), F.sum(F.col("__w") * F.col("__e")), F.sum("__w")).first()
        if top <= 0:
            models, weights = [*models, model], [*weights, 1.0]
            break
        mean = loss / top / mass
        if mean >= 0.5:
            if not models:
                models, weights = [model], [1.0]
            break
        beta = mean / (1 - mean)
        models, weights = [*models, model], [*weights, rate * float(np.log(1 / beta))]
        after = err.select("__x", "__y", (F.col("__w") * (total / mass) * F.pow(F.lit(beta), (1 - F.col("__e") / top) * rate)).alias("__w"))
        after = stored(after, folder, f"round-{k + 1}").cache() if (k + 1) % STORE_ROUNDS == 0 else after.cache()
        after.count()  # before the weights that it is made from are let go
        boosted.unpersist()
        boosted = after
    boosted.unpersist()
    scored = rows.withColumn("__p", F.lit(None).cast("double"))
    if models:
        each = rows
        for k, model in enumerate(models):
            each = model.setPredictionCol(f"__p{k}").transform(each)
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"__p{k}").alias("p"), F.lit(w).alias("w")) for k, w in enumerate(weights)]))
        step = lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(a["p"].isNull() & (a["s"] + x["w"] >= sum(weights) / 2), x["p"]).otherwise(a["p"]).alias("p"))
        walk = F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("p")), step)
        scored = each.withColumn("__p", walk["p"]).drop(*[f"__p{k}" for k in range(len(models))])
    table = gap_filled(scored, target, "Ada", "__p", pred_all).drop("__x", "__y", "__test", "__p")
    return Filled(table, fit_metrics(scored.where("__y is not null"), "__y", "__p"))


class Network:
    """One hidden layer of rectified units as a flat vector of weights, and its steps."""

    def __init__(self, inputs: int, hidden: int, ridge: float):
        self.shapes, self.ridge = [(inputs, hidden), (hidden,), (hidden,), (1,)], ridge
        self.cuts = np.cumsum([int(np.prod(s)) for s in self.shapes])

    def first(self) -> np.ndarray:
        rng, (d, hidden) = np.random.default_rng(0), self.shapes[0]
        return np.concatenate([rng.normal(0, np.sqrt(2 / d), d * hidden), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), hidden), np.zeros(1)])

    def layers(self, p: np.ndarray) -> list[np.ndarray]:
        return [a.reshape(s) for a, s in zip(np.split(p, self.cuts[:-1]), self.shapes, strict=True)]

    def predict(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers(p)
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def gradient(self, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Mean gradient of half the squared error of a batch, and the sum of squared errors."""
        w1, b1, w2, b2 = self.layers(p)
        h = np.maximum(x @ w1 + b1, 0)
        e = h @ w2 + b2 - y
        back = np.outer(e, w2) * (h > 0)
        return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), h.T @ e, [e.sum()]]) / len(y) + self.ridge * p / len(y), float(e @ e)

    def epochs(self, state: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, steps: float, rate: float, batch: int, seed: list[int]) -> tuple[np.ndarray, float]:
        """``n`` passes over the rows in shuffled batches, by Adam, from ``state`` (weights, both moments) after ``steps`` steps; the last pass's loss."""
        (p, m, v), rng, loss = state.copy(), np.random.default_rng(seed), 0.0
        for _ in range(n):
            order, loss = rng.permutation(len(y)), 0.0
            for at in range(0, len(y), batch):
                rows, steps = order[at : at + batch], steps + 1
                g, squared = self.gradient(p, x[rows], y[rows])
                loss += squared
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
                p = p - rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        return np.stack([p, m, v]), loss


def fill_ann(df: DataFrame, target: str, mode: str = "all", X_col=None, pred_all: bool = False, keys: Sequence[str] = (), fill: float = 0.0, hidden: int = 100, epochs: int = 200, rate: float = 1e-3, ridge: float = 1e-4, batch: int = 200, rounds: int = 10, shard_rows: int = SHARD_ROWS) -> Filled:
    """One hidden layer of rectified units on standardised features, fitted on all training rows in shuffled batches (Adam).

    Rows are dealt by a hash of their values to shards of about ``shard_rows``. A round is a Spark job: each shard goes on from the common
    weights for its share of the epochs, alone, and the shards' weights are averaged by rows. So there are few jobs, a task
    holds one shard, and only weights pass through the driver. Up to ``shard_rows`` rows that is the fit of a
    single machine; how the table is partitioned changes no more than the rounding of sums. Rounds end when the loss no longer falls. Without a known
    row predictions are null.
    """
    rows, names = _prepared(df, target, mode, X_col, keys, fill)
    rows = rows.withColumn("__y", col(target).cast("double")).withColumn("__v", vector_to_array("__x")).drop("__x")
    d = len(names)
    each = [F.col("__v")[i] for i in range(d)] + [F.col("__y")]
    known = rows.where("__y is not null and not __test").select("__v", "__y")
    stats = known.agg(F.count("*"), *[f(c) for c in each for f in (F.avg, F.stddev_pop)]).first()
    n, mean, scale = stats[0], np.array(stats[1::2], float), np.array([s or 1.0 for s in stats[2::2]], float)
    net, shards = Network(d, hidden, ridge), max(1, round(n / shard_rows))
    p = net.first()
    state, best, since, done, steps = np.stack([p, np.zeros_like(p), np.zeros_like(p)]), np.inf, 0, 0, 0.0
    train = known.withColumn("__h", F.xxhash64("__v", "__y")).withColumn("__s", F.pmod("__h", F.lit(shards)).cast("int"))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__h", kind="stable")
        x, y = (np.stack(part["__v"].to_list()) - mean[:-1]) / scale[:-1], (part["__y"].to_numpy() - mean[-1]) / scale[-1]
        return pd.DataFrame({"__s": part["__s"].iloc[:1], "__v": [x.ravel()], "__y": [y]})

    if n:  # a row for each shard, so that rounds neither group rows nor turn them into arrays
        train = stored(train.groupBy("__s").applyInPandas(packed, "__s int, __v array<double>, __y array<double>"), shared_dir(df.sparkSession), "shards")
        train = train.repartition(shards, "__s")

    def one_round(k: int, now: int, state: np.ndarray, steps: float):
        def go_on(batches):
            total = 0.0
            for part in batches:
                for s, v, y in zip(part["__s"], part["__v"], part["__y"], strict=True):
                    after, loss = net.epochs(state, v.reshape(-1, d), y, now, steps, rate, batch, [k, int(s)])
                    total = total + np.concatenate([after.ravel() * len(y), [loss, -(-len(y) // batch) * now * len(y)]])
            if np.ndim(total):
                yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

        return go_on

    for k in range(1, rounds + 1 if n else 1):
        now = epochs * k // rounds - done
        sums = np.zeros(state.size + 2)
        for r in train.mapInPandas(one_round(k, now, state, steps), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # one row for each weight
            sums[r["at"]] = r["v"] / n
        state, loss, done, steps = sums[:-2].reshape(state.shape), sums[-2], done + now, steps + sums[-1]
        since = 0 if loss < best - TOLERANCE else since + 1
        best = min(best, loss)
        if since >= PATIENCE:
            break
    scored = rows.withColumn("__p", F.lit(None).cast("double"))
    if n:
        weights = state[0]

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(net.predict(weights, (np.stack(x.to_list()) - mean[:-1]) / scale[:-1]) * scale[-1] + mean[-1])

        scored = rows.withColumn("__p", predict("__v"))
    table = gap_filled(scored, target, "ANN", "__p", pred_all).drop("__v", "__y", "__test", "__p")
    return Filled(table, fit_metrics(scored.where("__y is not null"), "__y", "__p"))


FILL = {"XGB": fill_gbt, "RF": fill_random_forest, "Ada": fill_adaboost, "ANN": fill_ann}


def fill_columns(df: DataFrame, method: str = "XGB", num_to_fill_na: float = 0.0, mode: str = "use_era5_only", vars_to_fill: Sequence[str] | None = None, X_col: Sequence[str] | None = None, keys: Sequence[str] = (), **params) -> Filled:
    """Fill several columns, that with the fewest gaps first; a filled column serves as a feature of the later ones.

    ``mode`` chooses the features as in ``feature_columns``: of ``vars_to_fill`` and ``X_col`` where both are given, else
    of the whole table without fluxes. Without ``vars_to_fill`` all columns with gaps but fluxes are filled. Nulls of the
    other features are a constant in each step. Columns come out as <v>_<M>GapFilled; metrics have a row for each column
    and part. A table without gaps comes back as it is.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    short = METHODS[method]
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float") and f.name not in keys]
    wanted = list(vars_to_fill) if vars_to_fill else [c for c in numbers if c not in NOT_FEATURES]
    gaps = df.agg(*[F.count(F.when(col(c).isNull(), 1)).alias(f"g{i}") for i, c in enumerate(wanted)]).first()
    order = sorted((n, i, c) for i, (n, c) in enumerate(zip(gaps, wanted, strict=True)) if n)
    pool = df
    if vars_to_fill and X_col:
        chosen = {*wanted, *X_col, *keys, "datetime"}
        pool = df.select([col(c) for c in df.columns if c in chosen])
    now, metrics, folder = df.withColumns({f"__o{i}": col(c) for _, i, c in order}), [], shared_dir(df.sparkSession)
    for _, i, c in order:
        features = [f for f in feature_columns(pool, c, mode, X_col, keys) if f != c]
        done = FILL[short](now, c, "use_custom_X_col", features, keys=keys, fill=num_to_fill_na, **params)
        metrics.append(done.metrics.select(F.lit(c).alias("variable"), "*"))
        now = done.table.withColumn(c, col(f"{c}_{short}GapFilled")).drop(f"{c}_{short}pred")
        now = stored(now, folder, f"column-{i}")  # the next model is trained on it many times over
    for _, i, c in order:
        now = now.withColumn(c, F.col(f"__o{i}")).drop(f"__o{i}")
    none = df.sparkSession.createDataFrame([], "variable string, part string, rmse double, mae double, r2 double, n long")
    return Filled(now, reduce(DataFrame.union, metrics, none))
