"""Edge tables and properties: null keys, empty and one-row tables, all-null columns, equal datetimes, order and partitioning."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxloom.operators import clean, gapfill, partition, quality, report, ustar, windows

T0 = dt.datetime(2024, 1, 1)
SOME = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUES = st.lists(st.one_of(st.none(), st.floats(-50, 50)), min_size=1, max_size=40)


def table(spark, sites, **cols):
    """A row for each site, half an hour apart; null sites are a series of their own."""
    rows = [(s, T0 + dt.timedelta(minutes=30 * k), *(None if x[k] is None else float(x[k]) for x in cols.values())) for k, s in enumerate(sites)]
    return spark.createDataFrame(rows, "site long, datetime timestamp_ntz, " + ", ".join(f"`{c}` double" for c in cols))


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("datetime").collect()]


def test_rows_with_a_null_key_stay(spark):
    n = 60
    df = table(spark, [None if k % 3 == 0 else 1 for k in range(n)], x=[k % 7 for k in range(n)], Rg=[0.0] * n, **{"u*": [k * 0.01 for k in range(n)], "NEE": [1.0] * n, "Tair": [float(k % 11) for k in range(n)]})
    keys = ["site"]
    assert quality.smart_range_qc(df, ["x"], keys).where("x_SmartY_qc is not null").count() == n
    assert quality.despike(df, "x", "Rg", 8, keys=keys).count() == n
    assert ustar.quantile_bin(df, "u*", 4, keys).where("bin is not null").count() == n
    assert {r["site"] for r in ustar.mpt_threshold(df, nee_bins=2, temp_groups=2, keys=keys).where("threshold is not null").collect()} == {None, 1}
    assert {r["site"] for r in ustar.bootstrap_ustar(df, None, 3, nee_bins=2, temp_groups=2, keys=keys).collect()} == {None, 1}
    assert report.daily_carbon(df, ["NEE"], 0, keys).where("site is null").count() > 0
    assert partition.nt_partition(df, e0=200.0, keys=keys).count() == partition.dt_partition(df, keys=keys).count() == n


@pytest.mark.parametrize("rows", [0, 1])
def test_empty_and_short_tables(spark, rows):
    df = table(spark, [1] * rows, x=[2.0] * rows, a=[1.0] * rows, Rg=[0.0] * rows, Tair=[3.0] * rows, NEE=[None] * rows)
    keys = ["site"]
    assert quality.smart_range_qc(df, ["x", "NEE"], keys).count() == rows
    assert quality.despike(df, "x", "Rg", 8).count() == rows and quality.qc_summary(df, "x", "a").count() == 1
    assert partition.nt_partition(df, keys=keys).where("RECO is null").count() == rows
    assert partition.dt_partition(df, keys=keys).count() == rows and report.diurnal_cycle(df, ["x"]).count() == rows
    assert windows.positions(df).where("__pos = 0").count() == rows


@pytest.mark.parametrize("method", ["XGB", "RF", "Ada", "ANN"])
def test_fills_without_known_rows_are_null(spark, method):
    params = {"XGB": {"rounds": 2}, "RF": {"trees": 2}, "Ada": {"estimators": 2}, "ANN": {"hidden": 3, "epochs": 2}}[method]
    for n in (0, 5):
        df = table(spark, [1] * n, y=[None] * n, a=[1.0] * n)
        done = gapfill.FILL[method](df, "y", "use_custom_X_col", ["a"], **params)
        assert [r[f"y_{method}GapFilled"] for r in done.table.collect()] == [None] * n and done.metrics.count() == 0


def test_network_learns_a_curve(spark):
    x = np.linspace(-3, 3, 400)
    df = table(spark, [1] * 400, y=[float(v * v) if k % 5 else None for k, v in enumerate(x)], a=x.tolist())
    done = gapfill.fill_ann(df, "y", "use_custom_X_col", ["a"], hidden=24, epochs=150, rate=0.02)  # the rate that was the default before batches
    assert done.metrics.where("part = 'test'").first()["r2"] > 0.95


def test_fill_columns_uses_its_mode(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, 200)
    df = table(spark, [1] * 200, VPD=[float(3 * v) if k % 9 else None for k, v in enumerate(a)], VPD_era5=a.tolist(), pr=rng.normal(0, 1, 200).tolist(), NEE=a.tolist())
    used = []
    fill = gapfill.FILL["RF"]
    gapfill.FILL["RF"] = lambda *args, **kw: used.append(args[3]) or fill(*args, **kw)
    try:
        era5 = gapfill.fill_columns(df, "RF", trees=4)
        gapfill.fill_columns(df, "RF", mode="all", keys=["site"], trees=1)
        gapfill.fill_columns(df, "RF", mode="use_custom_X_col", vars_to_fill=["VPD"], X_col=["pr", "VPD"], trees=1)
    finally:
        gapfill.FILL["RF"] = fill
    assert used == [["VPD_era5"], ["VPD_era5", "pr"], ["pr"]]
    assert {(r["variable"], r["part"]) for r in era5.metrics.collect()} == {("VPD", "train"), ("VPD", "test")}
    assert era5.metrics.where("part = 'test' and r2 > 0.8").count() == 1
    with pytest.raises(ValueError):
        gapfill.fill_columns(df, "RF", mode="use_custom_X_col")
    with pytest.raises(ValueError):
        gapfill.fill_columns(df.drop("VPD_era5"), "RF")
    assert gapfill.fill_columns(df.drop("VPD"), "RF").table.count() == 200


def test_users_columns_survive(spark):
    n = 48 * 16
    t = [10 + 8 * np.sin(k / 48 * 2 * np.pi) for k in range(n)]
    df = table(spark, [1] * n, Tair=t, Rg=[max(0.0, 500 * np.sin(k / 48 * 2 * np.pi)) for k in range(n)], NEE=[2.0 + 0.1 * v for v in t], alpha=[7.0] * n, E0=[8.0] * n)
    out = partition.dt_partition(df, keys=["site"])
    assert out.where("alpha = 7 and E0 = 8 and RECO is not null").count() == n
    kept = clean.build_dataset(df.withColumnsRenamed({"alpha": "Tair_era5", "E0": "odd"}))
    assert kept.columns == ["datetime", "Tair", "Rg", "NEE", "Tair_era5"]


def test_long_series_interpolate_in_linear_time(spark):
    n = 120_000
    df = spark.range(n).select(F.timestamp_seconds(F.col("id") * 1800).cast("timestamp_ntz").alias("datetime"), F.when(F.col("id") % 1000 == 500, F.col("id") * 2.0).alias("v"), F.lit(1).alias("site"))
    out = windows.interpolate_by_position(windows.positions(df, ["site"]), "v", ["site"]).orderBy("datetime").toPandas()["v"]
    at = np.arange(500, n, 1000)
    assert np.allclose(out, np.interp(np.arange(n), at, at * 2.0))
    anchors = df.where("v is not null").select("site", F.col("datetime").alias("centre"), F.col("v").alias("w"))
    timed = windows.interpolate_by_time(df.select("site", "datetime"), anchors, ["w"], ["site"]).orderBy("datetime").toPandas()["w"]
    assert np.allclose(timed, np.arange(n) * 2.0)


@SOME
@given(VALUES, st.integers(1, 4))
def test_quality_control_keeps_values(spark, x, parts):
    df = table(spark, [1] * len(x), x=x, Rg=[0.0] * len(x)).repartition(parts)
    for out, name in ((quality.smart_range_qc(df, ["x"]), "x_SmartY_qc"), (quality.range_qc(df, ["x"], [-9], [9]), "x_MaxMinValue_qc"), (quality.despike(df, "x", "Rg", 6), "x_despiked")):
        assert all(after is None or after == before for before, after in values(out, "x", name)) and len(values(out, "x")) == len(x)
        s = quality.qc_summary(out, "x", name).first()
        assert abs(s["kept_pct"] + s["removed_pct"] + s["missing_pct"] - 100) < 1e-9


@SOME
@given(st.floats(-9, 9), st.integers(1, 30))
def test_constant_series_have_no_spikes(spark, v, n):
    assert values(quality.despike(table(spark, [1] * n, x=[v] * n, Rg=[50.0] * n), "x", "Rg", 6), "x_despiked") == [(v,)] * n


@SOME
@given(VALUES)
def test_daily_sums_are_sums_of_halves(spark, x):
    df = table(spark, [1] * len(x), NEE=x)
    got = report.daily_carbon(df, ["NEE"], 0).first()["NEE"]
    assert abs(got - sum(v for v in x if v is not None) * 1800 * 12e-6) < 1e-9


def test_equal_datetimes_and_skipped_windows(spark):
    n = 48 * 20
    tair = [10 + 8 * np.sin(k / 48 * 2 * np.pi) for k in range(n)]
    nee = [3 * float(np.exp(200 * partition.term(np.array([a]))[0])) for a in tair]
    nee[40] = None  # a night row: the windows that hold it are skipped by default
    df = table(spark, [1] * n, NEE=nee, Tair=tair, Rg=[max(0.0, 500 * np.sin(k / 48 * 2 * np.pi)) for k in range(n)])
    skipped = {r["window"] for r in partition.estimate_rref(df.withColumn("e0", F.lit(200.0)), keys=["site"]).collect()}
    kept = {r["window"] for r in partition.estimate_rref(df.withColumn("e0", F.lit(200.0)), keys=["site"], nulls="drop_rows").collect()}
    assert 0 in kept and kept - skipped == {0}
    twice = df.union(df)
    assert sorted(r["__pos"] for r in windows.positions(twice).collect()) == list(range(2 * n))
    assert partition.nt_partition(twice, e0=200.0, keys=["site"]).count() == 2 * n


def test_bootstrap_percentiles_are_ordered(spark):
    rng = np.random.default_rng(6)
    n = 400
    u = rng.uniform(0.02, 0.6, n)
    df = table(spark, [1] * n, Rg=[0.0] * n, **{"u*": u.tolist(), "NEE": np.minimum(1, u / 0.2).tolist(), "Tair": rng.normal(10, 4, n).tolist()})
    for r in ustar.bootstrap_ustar(df, [("2024-01-01 00:00:00", "2024-01-05 00:00:00"), ("2024-01-03 00:00:00", "2024-01-09 00:00:00")], 8, nee_bins=5, temp_groups=2, keys=["site"]).collect():
        assert r["u5"] <= r["u50"] <= r["u95"]


def test_boosted_linear_tends_to_ridge_and_thresholds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) + [0, 1, 2, 0]
    y = x @ [2.0, -1.0, 0.0, 0.5] + 3 + rng.normal(0, 0.1, 400)
    z = np.column_stack([np.ones(400), x, y])
    penalty = np.diag([0, *[0.05 * 400] * 4])
    ridge = np.linalg.solve(z[:, :5].T @ z[:, :5] + penalty, z[:, :5].T @ y)
    assert np.allclose(gapfill.boosted_linear(z.T @ z, 3000, 0.5, 0.0, 0.05), ridge, atol=1e-9)
    sparse = gapfill.boosted_linear(z.T @ z, 3000, 0.5, 0.8, 0.0)
    assert abs(sparse[3]) < 1e-300 and abs(sparse[4]) < 1e-300 and 0 < sparse[1] < 2  # halved each round, so never quite zero
    residual = y - z[:, :5] @ sparse
    assert np.allclose([x[:, 0] @ residual / 400, x[:, 1] @ residual / 400], [0.8, -0.8], atol=1e-6)  # on the edge of the threshold
    assert (gapfill.boosted_linear(np.zeros((6, 6)), 5, 0.1, 0.0, 1.0) == 0).all()


def test_linear_booster_fills(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, 300)
    df = table(spark, [1] * 300, y=[float(2 * v + 1) if k % 5 else None for k, v in enumerate(a)], a=a, b=[None if k % 9 == 0 else 1.0 for k in range(300)])
    done = gapfill.fill_gbt(df, "y", "use_custom_X_col", ["a", "b"], keys=["site"], booster="gblinear", rounds=3000, step_size=0.5, reg_lambda=0.0)
    rows = done.table.collect()
    assert all(r["y_XGBGapFilled"] == r["y"] for r in rows if r["y"] is not None)
    assert all(abs(r["y_XGBpred"] - (2 * r["a"] + 1)) < 1e-3 for r in rows if r["y"] is None)
    assert {r["feature"]: round(r["importance"], 2) for r in done.importance.collect()} == {"a": 1.0, "b": 0.0}
    empty = gapfill.fill_gbt(df.withColumn("y", F.lit(None).cast("double")), "y", "use_custom_X_col", ["a"], booster="gblinear")
    assert empty.table.where("y_XGBGapFilled is not null").count() == 0 and empty.metrics.count() == 0
    with pytest.raises(ValueError):
        gapfill.fill_gbt(df, "y", "use_custom_X_col", ["a"], booster="dart")


def test_linear_models_of_each_series(spark):
    rng = np.random.default_rng(4)
    site = [None if k % 4 == 3 else k % 4 for k in range(800)]
    a, b = rng.normal(0, 1, 800), rng.normal(3, 1, 800)
    y = [None if s == 2 or k % 7 == 0 else float((5 if s is None else s + 1) * a[k] - b[k] + rng.normal(0, 0.1)) for k, s in enumerate(site)]
    df = table(spark, site, y=y, a=a, b=b)
    params = {"rounds": 300, "step_size": 0.5, "reg_alpha": 0.01, "reg_lambda": 0.01, "booster": "gblinear", "pred_all": True}
    done = gapfill.fill_gbt(df, "y", "use_custom_X_col", ["a", "b"], keys=["site"], per_key=True, **params)
    got = done.table.collect()
    assert len(got) == 800 and set(done.table.columns) == {*df.columns, "y_XGBpred", "y_XGBGapFilled", "y_XGBpred_all"}
    importance = {(r["site"], r["feature"]): r["importance"] for r in done.importance.collect()}
    assert {s for s, _ in importance} == {0, 1, None}  # site 2 knows nothing
    for s in (0, 1, None):
        alone = gapfill.fill_gbt(df.where(F.col("site").eqNullSafe(F.lit(s))), "y", "use_custom_X_col", ["a", "b"], keys=["site"], **params)
        want = {r["datetime"]: r["y_XGBpred_all"] for r in alone.table.collect()}
        assert all(abs(r["y_XGBpred_all"] - want[r["datetime"]]) < 1e-9 for r in got if r["site"] == s)
        assert all(abs(importance[s, r["feature"]] - r["importance"]) < 1e-9 for r in alone.importance.collect())
        parts = {r["part"]: r for r in alone.metrics.collect()}
        mine = {r["part"]: r for r in done.metrics.where(F.col("site").eqNullSafe(F.lit(s))).collect()}
        assert all(abs(mine[k]["r2"] - parts[k]["r2"]) < 1e-9 and mine[k]["n"] == parts[k]["n"] for k in ("train", "test"))
    assert all(r["y_XGBpred_all"] is None for r in got if r["site"] == 2)
    for wrong in ({"keys": []}, {"keys": ["site"], "booster": "gbtree"}):
        with pytest.raises(ValueError):
            gapfill.fill_gbt(df, "y", "use_custom_X_col", ["a"], per_key=True, **{"booster": "gblinear", **wrong})
    assert gapfill.fill_gbt(df.limit(0), "y", "use_custom_X_col", ["a"], keys=["site"], booster="gblinear", per_key=True).table.count() == 0


def test_adaboost_by_brute_force(spark):
    rng = np.random.default_rng(6)
    n, estimators = 240, 8
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 9, n)]).astype(float)
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] + rng.normal(0, 0.2, n)
    df = table(spark, [1] * n, y=[None if k % 11 == 0 else float(v) for k, v in enumerate(y)], a=x[:, 0], b=x[:, 1])
    place = {r["datetime"]: (r["y"], np.array([r["a"], r["b"]]), r["__test"]) for r in gapfill.train_test(df, ["site"]).collect()}
    train = [v for v in place.values() if v[0] is not None and not v[2]]
    tx, ty, w = np.stack([v[1] for v in train]), np.array([v[0] for v in train]), np.ones(len(train))

    def stump(w):
        best = None
        for j in range(2):
            levels = np.unique(tx[:, j])
            for cut in (levels[:-1] + levels[1:]) / 2:
                left = tx[:, j] <= cut
                means = [np.average(ty[s], weights=w[s]) for s in (left, ~left)]
                error = (w * (ty - np.where(left, *means)) ** 2).sum()
                if best is None or error < best[0]:
                    best = error, j, cut, means
        return best[1:]

    stumps, votes, say = [], [], lambda s, z: np.where(z[..., s[0]] <= s[1], *s[2])
    for _ in range(estimators):
        s = stump(w)
        e = np.abs(ty - say(s, tx))
        mean = (w * e).sum() / w.sum() / e.max()
        if mean >= 0.5:
            break
        beta = mean / (1 - mean)
        stumps, votes = [*stumps, s], [*votes, np.log(1 / beta)]
        w = w * beta ** (1 - e / e.max())
    assert len(stumps) >= 4  # the rounds that change weights
    done = gapfill.fill_adaboost(df, "y", "use_custom_X_col", ["a", "b"], pred_all=True, keys=["site"], estimators=estimators, max_depth=1)
    for r in done.table.collect():
        said = sorted((float(say(s, place[r["datetime"]][1])), v) for s, v in zip(stumps, votes, strict=True))
        total = np.cumsum([v for _, v in said])
        assert abs(r["y_Adapred_all"] - said[int(np.argmax(total >= sum(votes) / 2 - 1e-12))][0]) < 1e-9


def test_network_shards_equal_a_single_fit(spark):
    rng = np.random.default_rng(11)
    n = 3000
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    y = np.sin(2 * a) + 0.5 * b**2 + rng.normal(0, 0.05, n)
    df = table(spark, [1] * n, y=y, a=a, b=b)
    fits = {}
    for shard_rows, parts in ((10_000, 3), (10_000, 7), (500, 3)):
        done = gapfill.fill_ann(df.repartition(parts), "y", "use_custom_X_col", ["a", "b"], keys=["site"], hidden=30, epochs=200, rate=0.01, shard_rows=shard_rows)
        fits[shard_rows, parts] = {r["part"]: r["r2"] for r in done.metrics.collect()}
    assert fits[10_000, 3]["test"] > 0.95
    assert all(abs(fits[10_000, 3][k] - fits[10_000, 7][k]) < 1e-6 for k in ("train", "test"))  # partitioning changes no more than the rounding of sums
    assert abs(fits[500, 3]["test"] - fits[10_000, 3]["test"]) < 0.01


def test_network_rounds_read_a_row_for_each_shard(spark, monkeypatch):
    kept, stored = [], gapfill.stored
    monkeypatch.setattr(gapfill, "stored", lambda *args: kept.append(stored(*args)) or kept[-1])
    df = table(spark, [1] * 400, y=[float(k % 7) for k in range(400)], a=[float(k) for k in range(400)])
    gapfill.fill_ann(df, "y", "use_custom_X_col", ["a"], keys=["site"], hidden=3, epochs=2, rounds=1, shard_rows=100)
    shards = kept[0].collect()
    assert len(shards) <= 4 and sum(len(r["__y"]) for r in shards) == df.count() - gapfill.train_test(df, ["site"]).where("__test").count()


def test_network_gradient_by_differences():
    rng = np.random.default_rng(3)
    net = gapfill.Network(3, 4, 0.1)
    p, x, y = net.first() + 0.01, rng.normal(size=(7, 3)), rng.normal(size=7)
    g, squared = net.gradient(p, x, y)
    loss = lambda q: ((net.predict(q, x) - y) ** 2).sum() / 14 + 0.1 * (q**2).sum() / 14
    assert abs(squared - ((net.predict(p, x) - y) ** 2).sum()) < 1e-12
    for k in range(len(p)):
        e = np.zeros_like(p)
        e[k] = 1e-6
        assert abs((loss(p + e) - loss(p - e)) / 2e-6 - g[k]) < 1e-6


def test_a_value_just_k_deviations_away_is_no_spike():
    x = np.array([5.4, 5.4, 5.4, 7.7, 10.0, 10.0, 10.0, 14.6, 0.8])  # 7.7 - 0.8 is 3 times 2.3, in binary a little more
    flag, _ = quality.spikes(x, np.zeros(9, bool), np.arange(9), 9, 3.0, 6)
    assert not flag.any()
    assert quality.spikes(np.where(x == 0.8, 0.79, x), np.zeros(9, bool), np.arange(9), 9, 3.0, 6)[0].sum() == 1
