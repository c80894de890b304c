"""Series in chunks, ranges by a sweep, bounded quantiles and Poisson weights: against brute force, keyed results and plans."""

import bisect
import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxloom.operators import quality, quantiles, ustar, windows

T0 = dt.datetime(2024, 1, 1)
SOME = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def half_hours(spark, n, **cols):
    rows = [(T0 + dt.timedelta(minutes=30 * k), *(None if x[k] is None else float(x[k]) for x in cols.values())) for k in range(n)]
    return spark.createDataFrame(rows, "datetime timestamp_ntz, " + ", ".join(f"`{c}` double" for c in cols)).repartition(5)


@given(st.lists(st.one_of(st.none(), st.none(), st.floats(-9, 9)), min_size=1, max_size=150), st.integers(1, 40))
@SOME
def test_chunks_equal_whole_series(spark, x, chunk):
    df = half_hours(spark, len(x), x=x).withColumn("site", F.when(F.minute("datetime") == 0, 1))
    keyed = windows.positions(df, ["site"])
    cut = windows.positions(df, ["site"], whole_series=False)
    assert sorted(map(str, keyed.collect())) == sorted(map(str, cut.select(*keyed.columns).collect()))
    a = windows.interpolate_by_position(keyed, "x", ["site"]).select("datetime", "x")
    b = windows.interpolate_by_position(keyed, "x", ["site"], whole_series=False, chunk_rows=chunk).select("datetime", "x")
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


@pytest.mark.parametrize("n_anchors", [0, 1, 2, 5])
def test_time_interpolation_without_keys(spark, n_anchors):
    df = half_hours(spark, 400, v=[float(k) for k in range(400)]).union(half_hours(spark, 1, v=[0.0]).withColumn("datetime", F.lit(None).cast("timestamp_ntz")))
    at = [100, 103, 180, 290, 291][:n_anchors]
    anchors = spark.createDataFrame([(T0 + dt.timedelta(minutes=30 * k), float(k * k), None if k == 180 else 1.0) for k in at], "centre timestamp_ntz, a double, b double")
    got = {r["datetime"]: r["a"] for r in windows.interpolate_by_time(df, anchors, ["a", "b"], required=["a"]).collect()}
    assert len(got) == 401
    for k in range(400):
        have = got[T0 + dt.timedelta(minutes=30 * k)]
        if not at:
            assert have is None
        elif len(at) == 1:
            assert have == at[0] ** 2
        else:
            i = min(max(bisect.bisect_right(at, k) - 1, 0), len(at) - 2)
            p, q = at[i], at[i + 1]
            assert abs(have - (p * p + (q * q - p * p) * (k - p) / (q - p))) < 1e-9


def test_keyless_windows_put_no_series_in_one_task(spark, tmp_path):
    half_hours(spark, 3000, x=[float(k % 7) if k % 5 == 0 else None for k in range(3000)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    anchors = df.where("x = 3").select(F.col("datetime").alias("centre"), F.col("x").alias("a"))
    made = [windows.row_windows(df, 720, 240), windows.time_windows(df), windows.interpolate_by_position(windows.positions(df), "x"), windows.interpolate_by_time(df, anchors, ["a"])]
    for out in made:
        text = plan(out)
        # what is in one partition is a summary: an aggregate stands right below that exchange
        for at in re.finditer("Exchange SinglePartition", text):
            below = text[at.end() :].split("\n")[1:4]
            assert any("HashAggregate" in line or "SortAggregate" in line for line in below), "\n".join(below)
        assert out.count() > 0


def test_very_many_ranges(spark):
    rnd = random.Random(1)
    df = half_hours(spark, 48 * 60, x=[1.0] * (48 * 60)).union(half_hours(spark, 1, x=[2.0]).withColumn("datetime", F.lit(None).cast("timestamp_ntz")))
    made = []
    for _ in range(100_000):
        a = rnd.uniform(0, 60 * 86400)
        made.append((int(a), int(a) + rnd.choice([0, 1, 5, 20])))
    made += [(86400 * 7, 86400 * 19), (86400 * 9, 86400 * 10), (90, 80), (1800, 1800)]
    ranges = spark.createDataFrame([(T0 + dt.timedelta(seconds=a), T0 + dt.timedelta(seconds=b)) for a, b in made] + [(None, T0), (T0, None)], "start timestamp_ntz, end timestamp_ntz")
    out = quality.datetime_qc(df, "x", ranges)
    text = plan(out)
    assert "NestedLoop" not in text and "Cartesian" not in text and "exists(" not in text
    rows = out.collect()
    assert len(rows) == 48 * 60 + 1
    for r in rows:
        if r["datetime"] is None:
            assert r["x_Datetime_qc"] == 2.0
    inside = np.zeros(48 * 60, bool)
    for a, b in made:
        inside[math.ceil(a / 1800) : b // 1800 + 1] = True
    assert {int((r["datetime"] - T0).total_seconds()) // 1800 for r in rows if r["datetime"] and r["x_Datetime_qc"] is None} == set(np.flatnonzero(inside).tolist())
    few, many = [(f"2024-01-{d:02d} 00:00:00", f"2024-01-{d:02d} 05:00:00") for d in range(1, 6)], []
    many = few * 5  # over the number of literals, so by the sweep
    a, b = (quality.datetime_qc(df, "x", x).where("x_Datetime_qc is null").count() for x in (few, many))
    assert a == b == 55


def test_ranges_belong_to_their_series(spark):
    df = half_hours(spark, 96, x=[1.0] * 96).withColumn("site", F.explode(F.array(F.lit(1), F.lit(2), F.lit(None).cast("int"))))
    ranges = spark.createDataFrame([(1, T0, T0 + dt.timedelta(hours=2)), (None, T0 + dt.timedelta(hours=20), T0 + dt.timedelta(hours=30))], "site int, start timestamp_ntz, end timestamp_ntz")
    out = quality.datetime_qc(df, "x", ranges, ["site"]).where("x_Datetime_qc is null")
    assert {r["site"]: r["count"] for r in out.groupBy("site").count().collect()} == {1: 5, None: 21}


@given(st.lists(st.tuples(st.integers(0, 1), st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1e300, -1e300, 5e-324, 2.5]), st.floats(allow_nan=False, allow_infinity=False)), st.integers(0, 3)), min_size=1, max_size=60))
@SOME
def test_selected_quantiles_equal_percentile(spark, rows):
    df = spark.createDataFrame([(k, x, w, 1.0) for k, x, w in rows], "k int, x double, w int, variable double").repartition(3)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    listed = F.array(*[F.lit(p) for p in shares])
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("x", listed, F.col("w")).alias("q")).collect() if r["q"] is not None}
    got = {r["k"]: r["quantiles"] for r in quantiles.selected_quantiles(df, ["x"], shares, ["k"], "w").collect()}
    assert got == want


def test_selected_quantiles_of_hard_columns(spark):
    n = 20_000
    rng = np.random.default_rng(5)
    cols = {"normal": rng.normal(size=n), "steps": rng.integers(0, 3, n).astype(float), "far": np.where(np.arange(n) == 7, 1e280, rng.random(n)), "powers": np.exp2(rng.integers(-900, 900, n)), "one": np.full(n, 4.5)}
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in cols.values()])), ", ".join(f"{c} double" for c in cols)).repartition(4)
    shares = [0.05, 0.25, 0.5, 0.75, 0.999]
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in shares])).alias(c) for c in cols]).first()
    got = {r["variable"]: r["quantiles"] for r in quantiles.selected_quantiles(df, list(cols), shares).collect()}
    assert got == want.asDict()
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r["quantiles"] for r in quantiles.selected_quantiles(odd, ["x"], [0.5]).collect()] == [[2.0]]
    assert quantiles.selected_quantiles(odd.limit(0), ["x"], [0.5]).count() == 0


def test_bounded_ranges_equal_plain_ones(spark):
    rng = np.random.default_rng(6)
    df = half_hours(spark, 500, x=np.round(rng.normal(size=500), 1), y=[None] * 500).withColumn("site", F.minute("datetime"))
    for keys in ([], ["site"]):
        a, b = (quality.smart_range_qc(df, ["x", "y"], keys, 0.5, bounded=m).select("datetime", "x_SmartY_qc", "y_SmartY_qc") for m in (False, True))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
        a, b = (quality.range_reference_stats(df, ["x"], keys, bounded=m) for m in (False, True))
        assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_poisson_weights_are_poisson_and_independent(spark):
    n, reps = 4000, 40
    df = half_hours(spark, n, x=[1.0] * n)
    out = ustar.poisson_sample(df, reps, 7).select("datetime", "rep", "weight").toPandas()
    w = np.zeros((n, reps))
    w[((out["datetime"] - T0).dt.total_seconds() // 1800).astype(int), out["rep"]] = out["weight"]
    for k in range(4):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.004
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    c = np.corrcoef(w.T) - np.eye(reps)
    assert np.abs(c).max() < 5 / math.sqrt(n)  # replicates
    along = np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]
    assert abs(along) < 4 / math.sqrt(n * reps)  # neighbouring rows
    again = ustar.poisson_sample(df.where("minute(datetime) = 0").repartition(2), reps, 7).select("datetime", "rep", "weight").toPandas()
    same = out.merge(again, on=["datetime", "rep"])
    assert len(same) == len(again) and (same["weight_x"] == same["weight_y"]).all()
    assert ustar.poisson_sample(df.limit(0), 3).count() == 0


def test_poisson_sample_needs_no_shuffle(spark):
    text = plan(ustar.poisson_sample(spark.range(9).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("datetime")), 5))
    assert "Exchange" not in text and "Join" not in text


def test_both_bootstraps_agree_and_list_their_thresholds(spark):
    rng = np.random.default_rng(9)
    n = 4800
    u = rng.uniform(0.02, 0.6, n)
    nee = 3 * np.minimum(1, u / 0.25) + rng.normal(0, 0.15, n)
    df = half_hours(spark, n, NEE=nee, Tair=rng.uniform(0, 25, n), Rg=[0.0] * n).join(half_hours(spark, n, u=u), "datetime").withColumnRenamed("u", "u*")
    a, b = (ustar.bootstrap_ustar(df, None, 20, nee_bins=10, draws=d).where("season = 'all'").first() for d in ("multinomial", "poisson"))
    assert abs(a["u50"] - b["u50"]) < 0.05 and 0.12 < b["u50"] < 0.35 and b["u5"] <= b["u50"] <= b["u95"]
    seasons = [("2024-01-01 00:00:00", "2024-02-10 00:00:00"), ("2024-02-01 00:00:00", "2024-12-31 00:00:00")]
    each = ustar.bootstrap_thresholds(df, seasons, 5, nee_bins=10, draws="poisson").toPandas().pivot(index="rep", columns="season", values="threshold")
    assert each.shape == (5, 3) and (each["overall"] == each.drop(columns="overall").max(axis=1)).all()
    with pytest.raises(ValueError):
        ustar.bootstrap_thresholds(df, draws="other")


def test_gate_sums_equal_correlation(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(t), float(0.01 * (t * s + rng.normal())), float(rng.integers(1, 4))) for g, s in ((1, 0.0), (2, 1.0), (3, -1.0)) for t in rng.normal(15, 3, 200)] + [(4, 3.0, 0.01 * k, 1.0) for k in range(50)] + [(5, None, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "g int, Tair double, ustar double, w double").withColumn("w", F.col("w").cast("long"))
    for weight in (None, "w"):
        want = {r["g"] for r in ustar.correlation_gate(df, "Tair", "ustar", ["g"], weight=weight).where("accepted").collect()}
        assert {r["g"] for r in ustar.gated_edges(df, "Tair", "ustar", ["g"], 4, weight).collect()} == want == {1, 4, 5}


@pytest.mark.parametrize("draws", ["multinomial", "poisson"])
def test_replicates_stay_in_the_task_that_makes_them(spark, draws):
    """Only a copy of the narrow rows for each block of replicates is shuffled, before there are replicates; thresholds are those of each replicate alone."""
    rng = np.random.default_rng(4)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * i), float(rng.uniform(0, 25)), round(float(rng.uniform(0.02, 0.9)), 6), float(rng.normal(1, 1)), 0.0) for k in (1, None) for i in range(240)]
    df = spark.createDataFrame(rows, "site long, datetime timestamp_ntz, Tair double, `u*` double, NEE double, Rg double")
    each = ustar.bootstrap_thresholds(df, None, 12, temp_groups=2, nee_bins=4, keys=["site"], draws=draws)
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "rep#" not in plan.split("Exchange ")[1]
    sample = (ustar.poisson_sample if draws == "poisson" else ustar.bootstrap_sample)(df, 12, keys=["site"])
    alone = ustar.mpt_threshold(sample, temp_groups=2, nee_bins=4, keys=["site", "rep"], weight="weight")
    want = {(r["site"], r["rep"]): r["threshold"] for r in alone.collect()}
    got = {(r["site"], r["rep"]): r["threshold"] for r in each.where("season = 'overall'").collect()}
    assert len(want) == 24 and got == pytest.approx(want)


def test_edges_that_differ_in_their_last_bits_are_repeated(spark):
    """0.3 between two values of 0.1 + 0.2: such a group has no bins, as in SQL."""
    rows = [(x, 1.0) for x in (0.1, 0.2, 0.3, 0.1 + 0.2, 0.5)]
    df = spark.createDataFrame(rows, "u double, NEE double").selectExpr("1 AS site", "*")
    assert ustar.ustar_bin_stats(df, "u", "NEE", ["site"], 4).count() == 0
