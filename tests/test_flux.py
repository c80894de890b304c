"""Flux operators against plain pandas and NumPy versions, planted truth, and edge tables."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import clean, gapfill, partition, quality, report, ustar, windows
from fluxloom.sources import files

SF = "/root/testdata/sf0.01"
T0 = dt.datetime(2024, 1, 1)


def series(spark, n, **cols):
    number = lambda v: None if v is None or v != v else float(v)
    rows = [(T0 + dt.timedelta(minutes=30 * k), *(number(x[k]) for x in cols.values())) for k in range(n)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, " + ", ".join(f"`{c}` double" for c in cols))
    return df


def test_logger_files_round_trip(spark, tmp_path):
    flux, biomet = tmp_path / "flux.csv", tmp_path / "bio.csv"
    flux.write_text("file,,data\nfilename,date,time,DOY,co2_flux,co2_strg,qc_co2_flux,H,qc_H,LE,qc_LE,ET,air_temperature,RH,VPD,air_pressure,wind_speed,wind_dir,u*\n,[y],[t],,,,,,,,,,,,,,,,\n"
                    "a,2024-01-01,00:30,1,2.0,0.5,0,5,2,6,1,0,280.15,70,3,1000,2,90,0.2\na,2024-01-01,01:00,1,-9999,0.5,0,5,0,-9999,0,0,-9999,70,3,1000,2,90,0.3\n")
    biomet.write_text("date,time,TA_1_1_1,TS_1_1_1,RH_1_1_1,SWIN_1_1_1,LWIN_1_1_1,SWOUT_1_1_1,LWOUT_1_1_1,SWC_1_1_1,PPFD_1_1_1,P_RAIN_1_1_1,SHF_1_1_1\n,,K,K,%,,,,,,,,\n"
                      "2024-01-01,00:30,-9999,275.15,-9999,100,300,20,340,0.3,5,0,-9999\n2024-01-01,01:00,281.15,275.15,60,100,-9999,20,340,0.3,5,0,1\n")
    a, b = files.read_flux_output(spark, str(flux)), files.read_biomet(spark, str(biomet))
    rows = clean.load_flux(a, b).orderBy("datetime").collect()
    assert [round(r["Tair"], 6) for r in rows] == [7.0, 8.0]
    assert [r["RH_1_1_1"] for r in rows] == [70.0, 60.0]
    assert [r["NEE"] for r in rows] == [2.5, None] and [r["Rn"] for r in rows] == [40.0, None]
    assert [r["H"] for r in rows] == [None, 5.0] and [r["LE"] for r in rows] == [6.0, None] and [r["SHF_1_1_1"] for r in rows] == [None, 1.0]
    out = str(tmp_path / "out")
    files.write_dataset(clean.load_flux(a, b), out, "csv")
    assert files.read_dataset(spark, out).orderBy("datetime").collect()[0]["NEE"] == 2.5


def despiked(x, rg, window, k, period, replace):
    out = list(x)
    for i in range(len(x)):
        is_day = rg[i] is not None and rg[i] >= 10
        if x[i] is None or (rg[i] is not None and period != "both" and (period == "day") != is_day):
            continue
        near = [x[j] for j in range(max(0, i - window // 2), min(len(x), i + window // 2 + 1)) if x[j] is not None and (rg[j] is not None and rg[j] >= 10) == is_day]
        if len(near) <= window // 8:
            continue
        m = float(np.median(near))
        if abs(x[i] - m) > k * float(np.median(np.abs(np.array(near) - m))):
            out[i] = m if replace else None
    return out


@pytest.mark.parametrize("period,replace,chunk", [("both", False, 20_000), ("night", False, 37), ("day", True, 50)])
def test_despike_equals_row_loop(spark, period, replace, chunk):
    rng = np.random.default_rng(3)
    x = [float(np.sin(k / 9) + rng.normal(0, 0.1) + (9 if k % 41 == 0 else 0)) if k % 7 else None for k in range(300)]
    rg = [float(max(0, 50 * np.sin(k / 8))) if k % 53 else None for k in range(300)]
    df = series(spark, 300, x=x, Rg=rg)
    got = [r["x_despiked"] for r in quality.despike(df, "x", "Rg", 24, 3, period, replace, chunk_rows=chunk).orderBy("datetime").collect()]
    want = despiked(x, rg, 24, 3, period, replace)
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None])
    with pytest.raises(ValueError):
        quality.despike(df, "x", period="noon")


def test_dependency_compat_and_duplicates(spark):
    df = series(spark, 3, x=[1.0, 2.0, 3.0], a=[1.0, 5.0, None], b=[1.0, 1.0, 1.0])
    plain = quality.dependency_qc(df, "x", ["a", "b"], [0, 0], [2, 2]).orderBy("datetime")
    assert [r["x_Dependency_qc"] for r in plain.collect()] == [1.0, None, None]
    compat = quality.dependency_qc(df, "x", ["a", "b"], [0, 0], [2, 2], compat=True)
    assert compat.where("x_Dependency_qc is not null").count() == 3
    with pytest.raises(ValueError):
        quality.datetime_qc(df, "x", [("bad", "worse")])


def test_bins_equal_qcut(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.3, 0.1, 200)
    df = series(spark, 200, x=x, nee=rng.normal(0, 1, 200)).withColumn("site", F.lit(1))
    cut = pd.qcut(x, 20)
    got = ustar.quantile_bin(df, "x", 20, ["site"]).orderBy("datetime").select("bin").toPandas()["bin"]
    assert (got.to_numpy() == cut.codes).all()
    mids = ustar.ustar_bin_stats(df, "x", "nee", ["site"], 20).orderBy("bin").toPandas()["mid"]
    assert np.allclose(mids, [c.mid for c in cut.categories], atol=1e-12)


def test_ties_on_edges_have_no_bins(spark):
    df = series(spark, 40, x=[1.0] * 40).withColumn("site", F.lit(1))
    assert ustar.quantile_bin(df, "x", 6, ["site"]).where("bin is not null").count() == 0


def test_moving_point_tries_the_strict_tolerance_first(spark):
    stats = spark.createDataFrame([(1, 0, 0.95, 0.1), (1, 1, 0.2, 0.2), (1, 2, 1.0, 0.3), (1, 3, 1.0, 0.4), (2, 0, 0.1, 0.1), (2, 1, 1.0, 0.2)], "g int, bin int, mean_nee double, mid double")
    got = {r["g"]: r["threshold"] for r in ustar.moving_point(stats, ["g"]).collect()}
    assert got == {1: 0.1, 2: 0.1}


def test_bootstrap_weights_and_order(spark):
    df = series(spark, 120, x=[float(k) for k in range(120)])
    w = ustar.bootstrap_sample(df, 4, 7)
    assert [r[0] for r in w.groupBy("rep").agg(F.sum("weight")).select("sum(weight)").collect()] == [120] * 4
    again = ustar.bootstrap_sample(df.repartition(5), 4, 7)
    assert w.select("datetime", "rep", "weight").exceptAll(again.select("datetime", "rep", "weight")).count() == 0


@pytest.mark.parametrize("n", [0, 10, 11, 14, 30])
def test_row_windows_by_brute_force(spark, n):
    df = series(spark, n, x=[1.0] * n)
    got = sorted((r["window"], r["pos"]) for r in windows.row_windows(df, 10, 3).collect())
    want = sorted((k, p) for k, s in enumerate(range(0, max(0, n - 10), 3)) for p in range(s, s + 10))
    assert got == want


def test_interpolation_by_position(spark):
    x = [None, 2.0, None, None, 8.0, None]
    df = windows.positions(series(spark, 6, x=x))
    got = [r["x"] for r in windows.interpolate_by_position(df, "x").orderBy("datetime").collect()]
    assert got == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_fits_recover_planted_values():
    t = np.linspace(2, 25, 60)
    e0, rel = partition.fit_e0(t, np.exp(200 * partition.term(t)))
    assert abs(e0 - 200) < 1e-3 and rel < 1e-3
    (r,), (e,) = partition.fit_respiration(t, 3 * np.exp(220 * partition.term(t)))
    assert abs(r - 3) < 1e-9 and abs(e - 220) < 1e-7
    rg, reco = np.linspace(10, 900, 80), np.full(80, 3.0)
    nee = reco - (0.05 * rg * 25 / (0.05 * rg + 25) - 0.05)
    assert np.allclose(partition.fit_light(rg, nee, reco)[:, 0], [0.05, 25, 0.05], atol=1e-8)


def test_partition_identities(spark):
    n = 48 * 20
    tair = [10 + 8 * np.sin(k / 48 * 2 * np.pi) for k in range(n)]
    rg = [max(0.0, 500 * np.sin(k / 48 * 2 * np.pi)) for k in range(n)]
    nee = [3 * np.exp(200 * partition.term(np.array([a]))[0]) - (0.05 * g * 25 / (0.05 * g + 25) if g >= 10 else 0) for a, g in zip(tair, rg)]
    df = series(spark, n, NEE=nee, Tair=tair, Rg=rg)
    nt = partition.nt_partition(df, e0=200.0).toPandas()
    assert np.allclose(nt["RECO"] - nt["GPP"], nt["NEE"])
    day = partition.dt_partition(df).where("Rg >= 10").toPandas()
    want = 0.05 * day["Rg"] * 25 / (0.05 * day["Rg"] + 25)
    assert np.abs(day["GPP"] - want).max() < 1e-2 and np.abs(day["GPP_model"] - want).max() < 0.1


def test_daily_carbon_shows_every_day(spark):
    df = series(spark, 48, GPP=[1.0] * 48, NEE=[None] * 48, RECO=[2.0] * 48).union(series(spark, 48, GPP=[1.0] * 48, NEE=[1.0] * 48, RECO=[2.0] * 48).withColumn("datetime", F.col("datetime") + F.expr("interval 2 days")))
    rows = report.daily_carbon(df).orderBy("date").collect()
    assert [r["date"].day for r in rows] == [1, 2, 3]
    assert rows[0]["NEE"] is None and rows[1]["GPP"] is None and abs(rows[2]["GPP"] - 48 * 1800 * 12e-6) < 1e-9


def test_a_folder_of_a_dataset_is_written_by_one_task(spark, tmp_path):
    rows = spark.range(0, 2000, 1, 8).select(F.when(F.col("id") % 20 > 0, F.col("id") % 20).alias("site id"), F.col("id").cast("double").alias("NEE"))
    for fmt in ("parquet", "csv"):
        out = tmp_path / fmt
        files.write_dataset(rows, str(out), fmt, ("site id",))
        assert len([p for p in out.rglob("part-*") if not p.name.endswith(".crc")]) == 20
        back = files.read_dataset(spark, str(out), fmt)
        assert sorted((r["site id"] and int(r["site id"]), r["NEE"]) for r in back.where("`site id` is not null").collect()) == sorted((r["site id"], r["NEE"]) for r in rows.where("`site id` is not null").collect())
        assert back.count() == 2000


@pytest.mark.parametrize("method,params", [("XGB", {"rounds": 5}), ("RF", {"trees": 3, "max_depth": 5}), ("Ada", {"estimators": 3}), ("ANN", {"hidden": 8, "epochs": 5})])
def test_gap_fill_keeps_known_values(spark, method, params):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, 300)
    df = series(spark, 300, y=[float(2 * v) if k % 5 else None for k, v in enumerate(a)], a=a)
    done = gapfill.FILL[method](df, "y", "use_custom_X_col", ["a"], **params)
    rows = done.table.collect()
    assert len(rows) == 300 and all(r[f"y_{method}GapFilled"] is not None for r in rows)
    assert all(r[f"y_{method}GapFilled"] == r["y"] for r in rows if r["y"] is not None)
    assert {r["part"] for r in done.metrics.collect()} == {"train", "test"}


def test_columns_are_filled_by_number_of_gaps(spark):
    rng = np.random.default_rng(4)
    cols = {c: [float(v) if k % m else None for k, v in enumerate(rng.normal(0, 1, 200))] for c, m in (("a", 40), ("b", 10), ("c", 4))}
    df = series(spark, 200, **cols, d=rng.normal(0, 1, 200))
    done = gapfill.fill_columns(df, "RandomForest", mode="all", trees=2, max_depth=3)
    out = done.table
    assert [r["variable"] for r in done.metrics.where("part = 'test'").collect()] == ["a", "b", "c"]
    assert out.where("a_RFGapFilled is null or b_RFGapFilled is null or c_RFGapFilled is null").count() == 0
    assert out.where("a is null").count() == 5
    with pytest.raises(ValueError):
        gapfill.fill_columns(df, "magic")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry_and_oracles_are_registered():
    import __spark_entry__

    made = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(made) and len(made) > 45
