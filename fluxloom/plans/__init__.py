"""Registered queries of the flux operators over the half-hourly table, and their DuckDB twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import clean, gapfill, partition, quality, quantiles, report, ustar, windows
from ..session import shared_dir
from ..sources import files
from .fixtures import DUCK, biomet_text, era5_like, flux_text, halfhourly, write_logger

SITE = ["site_id"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` continues after the CTE of the half-hourly table ``h``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().startswith(("SELECT /**/", "WITH")) else DUCK + sql
        return f

    return add


def r(name: str, c=None):
    """A result column rounded as the oracle rounds it."""
    c = F.col(f"`{name}`") if c is None else c
    return F.round(c + 1e-9, 6).alias(name)


def rs(name: str, sql: str | None = None) -> str:
    return f'round({sql or name} + 1e-9, 6) AS "{name}"'


FLUX_SQL = """
, fx AS (SELECT *, CASE WHEN NEE IS NULL OR n % 5 = 0 THEN NULL WHEN n % 3 = 2 THEN NULL ELSE (NEE - 0.1) + 0.1 END AS nee2,
         CASE WHEN n % 3 = 2 THEN NULL ELSE 0.3*Rn END AS h2, CASE WHEN n % 3 = 2 THEN NULL ELSE 0.4*Rn END AS le2 FROM h)
"""


def d(name: str):
    """A result column read from text."""
    return r(name, F.col(f"`{name}`").cast("double"))


@query(f"""SELECT site_id, strftime(datetime, '%Y-%m-%d') AS date, strftime(datetime, '%H:%M') AS time, {rs('co2_flux', 'coalesce(NEE - 0.1, -9999)')}, {rs('co2_strg', 'CASE WHEN n % 5 = 0 THEN -9999 ELSE 0.1 END')}, {rs('H', '0.3*Rn')}, {rs('air_temperature', 'Tair + 273.15')}, {rs('u*', 'ustar')} FROM h""")
def read_flux_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table written as logger files of three head lines, one folder for each site, and read back."""
    folder = write_logger(flux_text(halfhourly(spark, sf_dir)), f"{shared_dir(spark)}/flux", True)
    out = files.read_flux_output(spark, folder)
    return out.select(F.col("site_id").cast("long").alias("site_id"), "date", "time", *[d(c) for c in ("co2_flux", "co2_strg", "H", "air_temperature", "u*")])


@query(f"""SELECT site_id, strftime(datetime, '%Y-%m-%d') AS date, strftime(datetime, '%H:%M') AS time, {rs('TA_1_1_1', 'CASE WHEN n % 4 = 0 THEN -9999 ELSE Tair + 273.15 END')}, {rs('SWOUT_1_1_1', '0.2*Rg')}, {rs('SHF_1_1_1', '-9999')} FROM h""")
def read_biomet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_logger(biomet_text(halfhourly(spark, sf_dir)), f"{shared_dir(spark)}/biomet", False)
    out = files.read_biomet(spark, folder)
    return out.select(F.col("site_id").cast("long").alias("site_id"), "date", "time", *[d(c) for c in ("TA_1_1_1", "SWOUT_1_1_1", "SHF_1_1_1")])


DATASET_SQL = f"""SELECT site_id, datetime, {rs('Tair')}, {rs('VPD')}, {rs('Rg')}, {rs('NEE')} FROM h"""


@query(DATASET_SQL)
def read_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical dataset as CSV with a head line, and back."""
    folder = f"{shared_dir(spark)}/dataset"
    files.write_dataset(clean.build_dataset(halfhourly(spark, sf_dir), keys=SITE), folder, "csv")
    return files.read_dataset(spark, folder).select(F.col("site_id").cast("long").alias("site_id"), "datetime", *[r(c) for c in ("Tair", "VPD", "Rg", "NEE")])


@query(DATASET_SQL)
def write_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical dataset as Parquet in a folder for each site, and back."""
    folder = f"{shared_dir(spark)}/dataset"
    files.write_dataset(clean.build_dataset(halfhourly(spark, sf_dir), keys=SITE), folder, partition_by=("site_id",))
    return files.read_dataset(spark, folder, "parquet").select(F.col("site_id").cast("long").alias("site_id"), "datetime", *[r(c) for c in ("Tair", "VPD", "Rg", "NEE")])


@query(FLUX_SQL + f"""SELECT site_id, datetime, CAST(dayofyear(datetime) AS DOUBLE) AS "DOY", {rs('Tair', '(Tair + 273.15) - 273.15')}, {rs('Tsoil', '(Tair + 272.15) - 273.15')},
 {rs('RH_1_1_1', 'CASE WHEN n % 4 = 1 THEN 90 - 2*VPD ELSE 80 END')}, {rs('Rn', 'Rg + 300 - 0.2*Rg - 340')}, {rs('H', 'h2')}, {rs('LE', 'le2')}, {rs('NEE', 'nee2')}, CAST(NULL AS DOUBLE) AS "SHF_1_1_1", {rs('u*', 'ustar')} FROM fx""")
def load_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = halfhourly(spark, sf_dir)
    out = clean.load_flux(flux_text(h), biomet_text(h), SITE)
    return out.select("site_id", "datetime", "DOY", *[r(c) for c in ("Tair", "Tsoil", "RH_1_1_1", "Rn", "H", "LE", "NEE", "SHF_1_1_1", "u*")])


@query(FLUX_SQL + f"""SELECT site_id, datetime, CAST(dayofyear(datetime) AS DOUBLE) AS "DOY", {rs('Tair', '(Tair + 273.15) - 273.15')}, 101325.0::DOUBLE AS air_pressure, {rs('RH', '90 - 2*VPD')}, {rs('VPD')}, {rs('H', 'h2')}, {rs('LE', 'le2')}, {rs('NEE', 'nee2')}, {rs('u*', 'ustar')} FROM fx""")
def load_flux_nobiomet(spark, sf_dir):
    out = clean.load_flux_nobiomet(flux_text(halfhourly(spark, sf_dir)), SITE)
    return out.select("site_id", "datetime", "DOY", r("Tair"), "air_pressure", *[r(c) for c in ("RH", "VPD", "H", "LE", "NEE", "u*")])


@query(f"""SELECT site_id, datetime, {rs('Tair')}, {rs('VPD')}, {rs('Rn')}, {rs('Rg')}, {rs('WS', '2.5')}, {rs('NEE')}, {rs('u*', 'ustar')} FROM h""")
def canonical_dataset(spark, sf_dir):
    raw = halfhourly(spark, sf_dir).withColumnRenamed("ustar", "u*").withColumn("wind_speed", F.lit(2.5))
    out = clean.build_dataset(raw, keys=SITE)
    return out.select("site_id", "datetime", *[r(c) for c in ("Tair", "VPD", "Rn", "Rg", "WS", "NEE", "u*")])


ERA5_SQL = """
, e AS (SELECT site_id, datetime, Rn AS Fn, Rg AS Fsd, 90 - 2*VPD AS RH, 15 + (Tair-15)*0.9 AS Ta FROM h WHERE (hour(datetime)*2 + minute(datetime)//30 + day(datetime)*48) % 50 <> 0)
"""


@query(ERA5_SQL + f"""SELECT h.site_id, h.datetime, {rs('Tair')}, {rs('VPD')}, {rs('NEE')}, {rs('Tair_era5', 'Ta')}, {rs('Tsoil_era5', 'Ta - 1')}, {rs('SWIN_era5', 'Fsd')}, {rs('RH_era5', 'RH')}, {rs('VPD_era5', 'VPD')}, {rs('Rn_era5', 'Fn')} FROM h JOIN e USING (site_id, datetime)""")
def build_dataset_era5(spark, sf_dir):
    h = halfhourly(spark, sf_dir)
    out = clean.build_dataset(h, era5_like(h), keys=SITE)
    return out.select("site_id", "datetime", *[r(c) for c in ("Tair", "VPD", "NEE", "Tair_era5", "Tsoil_era5", "SWIN_era5", "RH_era5", "VPD_era5", "Rn_era5")])


@query(f"""
, q AS (SELECT site_id, quantile_cont(NEE, 0.25) a, quantile_cont(NEE, 0.5) b, quantile_cont(NEE, 0.75) c, quantile_cont(VPD, 0.25) d, quantile_cont(VPD, 0.5) e, quantile_cont(VPD, 0.75) f FROM h GROUP BY 1)
SELECT site_id, datetime, {rs('NEE_SmartY_qc', 'CASE WHEN NEE BETWEEN b - 2*(c-a) AND b + 2*(c-a) THEN NEE END')}, {rs('VPD_SmartY_qc', 'CASE WHEN VPD BETWEEN e - 2*(f-d) AND e + 2*(f-d) THEN VPD END')} FROM h JOIN q USING (site_id)""")
def smart_range_qc(spark, sf_dir):
    out = quality.smart_range_qc(halfhourly(spark, sf_dir), ["NEE", "VPD"], SITE, k=2)
    return out.select("site_id", "datetime", r("NEE_SmartY_qc"), r("VPD_SmartY_qc"))


@query(f"""
, q AS (SELECT quantile_cont(NEE, 0.25) a, quantile_cont(NEE, 0.5) b, quantile_cont(NEE, 0.75) c FROM h)
SELECT site_id, datetime, {rs('NEE_SmartY_qc', 'CASE WHEN NEE BETWEEN b - 2*(c-a) AND b + 2*(c-a) THEN NEE END')} FROM h, q""")
def smart_range_qc_keyless(spark, sf_dir):
    """All sites as one group, with exact quartiles in bounded memory."""
    return quality.smart_range_qc(halfhourly(spark, sf_dir), ["NEE"], k=2, bounded=True).select("site_id", "datetime", r("NEE_SmartY_qc"))


WEIGHTED = [0, 0.05, 1 / 3, 0.5, 0.9, 1]


@query(f"""
, lg AS (SELECT l_suppkey % 3 AS site_id, 'price' AS variable, l_extendedprice::DOUBLE AS x, l_quantity::BIGINT AS w FROM lineitem UNION ALL SELECT l_suppkey % 3, 'discount', l_discount::DOUBLE, l_quantity::BIGINT FROM lineitem)
, q AS (SELECT site_id, variable, quantile_cont(x, {WEIGHTED}) AS q FROM (SELECT *, unnest(range(w)) FROM lg) GROUP BY 1, 2)
SELECT site_id, variable, {', '.join(rs(f'q{k}', f'q[{k + 1}]') for k in range(len(WEIGHTED)))} FROM q""")
def weighted_quantiles(spark, sf_dir):
    """Quantiles with weights, in bounded memory: prices (hardly a tie) and discounts (hardly anything else)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 3).alias("site_id"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), "l_quantity")
    out = quantiles.selected_quantiles(lines, ["price", "discount"], WEIGHTED, SITE, "l_quantity")
    return out.select("site_id", "variable", *[r(f"q{k}", F.col("quantiles")[k]) for k in range(len(WEIGHTED))])


@query(f"""SELECT site_id, datetime, {rs('NEE_MaxMinValue_qc', 'CASE WHEN NEE BETWEEN -15 AND 10 THEN NEE END')}, {rs('Tair_MaxMinValue_qc', 'CASE WHEN Tair BETWEEN 10 AND 20 THEN Tair END')} FROM h""")
def range_qc(spark, sf_dir):
    out = quality.range_qc(halfhourly(spark, sf_dir), ["NEE", "Tair"], [-15, 10], [10, 20])
    return out.select("site_id", "datetime", r("NEE_MaxMinValue_qc"), r("Tair_MaxMinValue_qc"))


@query(" UNION ALL ".join(f"""{'' if i else ''}SELECT site_id, '{c}' AS variable, {rs('median', f'quantile_cont({c}, 0.5)')}, {rs('q25', f'quantile_cont({c}, 0.25)')}, {rs('q75', f'quantile_cont({c}, 0.75)')}, {rs('min', f'min({c})')}, {rs('max', f'max({c})')} FROM h GROUP BY site_id""" for i, c in enumerate(("NEE", "Tair", "VPD"))))
def range_reference_stats(spark, sf_dir):
    out = quality.range_reference_stats(halfhourly(spark, sf_dir), ["NEE", "Tair", "VPD"], SITE)
    return out.select("site_id", "variable", *[r(c) for c in ("median", "q25", "q75", "min", "max")])


@query(f"""SELECT site_id, datetime, {rs('NEE_Dependency_qc', 'CASE WHEN Tair BETWEEN 8 AND 18 AND VPD BETWEEN 3 AND 9 THEN NEE END')} FROM h""")
def dependency_qc(spark, sf_dir):
    out = quality.dependency_qc(halfhourly(spark, sf_dir), "NEE", ["Tair", "VPD"], [8, 3], [18, 9], keys=SITE, unique_times=False)
    return out.select("site_id", "datetime", r("NEE_Dependency_qc"))


@query(f"""SELECT site_id, datetime, {rs('NEE_Datetime_qc', "CASE WHEN dayofmonth(datetime) BETWEEN 5 AND 8 OR hour(datetime) = 99 THEN NULL ELSE NEE END")} FROM h""")
def datetime_qc(spark, sf_dir):
    h = halfhourly(spark, sf_dir)
    span = h.agg(F.date_trunc("month", F.min("datetime")).cast("date").alias("a"), F.date_trunc("month", F.max("datetime")).cast("date").alias("b")).first()
    months, m = [], span["a"]
    while m <= span["b"]:  # a few calendar months
        months.append(m)
        m = m.replace(year=m.year + (m.month == 12), month=m.month % 12 + 1)
    out = quality.datetime_qc(h, "NEE", [*((f"{x:%Y-%m}-05 00:00:00", f"{x:%Y-%m}-08 23:59:59") for x in months), ("no date", "at all")])
    return out.select("site_id", "datetime", r("NEE_Datetime_qc"))


@query(f"""
, e AS (SELECT CAST(floor(user_id/40) AS BIGINT) AS site_id, ts AS "start", ts + to_seconds(event_id % 1800) AS "end" FROM events WHERE event_id % 3 > 0)
SELECT h.site_id, datetime, {rs('NEE_Datetime_qc', 'CASE WHEN bool_or(e."start" IS NOT NULL) THEN NULL ELSE any_value(NEE) END')} FROM h LEFT JOIN e ON e.site_id = h.site_id AND datetime BETWEEN e."start" AND e."end" GROUP BY 1, 2""")
def datetime_qc_ranges(spark, sf_dir):
    """Many irregular ranges of each site, two of three events' own half hours or parts of them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 > 0")
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 1800).cast("decimal(18,6)"))
    start = F.col("ts").cast("timestamp_ntz")
    ranges = events.select(F.floor(F.col("user_id") / 40).cast("long").alias("site_id"), start.alias("start"), (start + length).alias("end"))
    return quality.datetime_qc(halfhourly(spark, sf_dir), "NEE", ranges, SITE).select("site_id", "datetime", r("NEE_Datetime_qc"))


DESPIKE_SQL = """
, p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY datetime) - 1 AS pos, coalesce(Rg >= 10, false) AS isday FROM h)
, w AS (SELECT a.site_id, a.pos, median(b.NEE) AS med, count(*) AS cnt, list(b.NEE) AS vals FROM p a JOIN p b ON a.site_id = b.site_id AND a.isday = b.isday AND b.pos BETWEEN a.pos - {half} AND a.pos + {half} AND b.NEE IS NOT NULL GROUP BY 1, 2)
, m AS (SELECT site_id, pos, med, cnt, (SELECT median(abs(x - med)) FROM (SELECT unnest(vals) AS x)) AS mad FROM w)
"""


@query(DESPIKE_SQL.format(half=24) + f"""SELECT site_id, datetime, {rs('NEE_despiked', "CASE WHEN NOT isday AND cnt > 6 AND round(abs(NEE - med) - 3*mad, 9) > 0 THEN NULL ELSE NEE END")} FROM p LEFT JOIN m USING (site_id, pos)""")
def despike_night(spark, sf_dir):
    out = quality.despike(halfhourly(spark, sf_dir), "NEE", "Rg", 48, period="night", keys=SITE)
    return out.select("site_id", "datetime", r("NEE_despiked"))


@query(DESPIKE_SQL.format(half=120) + f"""SELECT site_id, datetime, {rs('NEE_despiked', "CASE WHEN cnt > 30 AND round(abs(NEE - med) - 3*mad, 9) > 0 THEN med ELSE NEE END")} FROM p LEFT JOIN m USING (site_id, pos)""")
def despike_median(spark, sf_dir):
    out = quality.despike(halfhourly(spark, sf_dir), "NEE", "Rg", 240, replace_with_median=True, keys=SITE)
    return out.select("site_id", "datetime", r("NEE_despiked"))


@query("""
, m AS (SELECT CAST(min(datetime) AS DATE) AS a, CAST(max(datetime) AS DATE) AS b FROM h)
SELECT site_id, datetime, n FROM h, m WHERE datetime BETWEEN a + 1 AND b - 1""")
def between_times(spark, sf_dir):
    h = halfhourly(spark, sf_dir)
    span = h.agg(F.date_add(F.min("datetime").cast("date"), 1).alias("a"), F.date_sub(F.max("datetime").cast("date"), 1).alias("b")).first()
    return quality.between_times(h, f"{span['a']} 00:00:00", f"{span['b']} 00:00:00").select("site_id", "datetime", "n")


@query(f"""SELECT site_id, {rs('kept_pct', "100.0 * count(*) FILTER (NEE BETWEEN -15 AND 10) / count(*)")}, {rs('removed_pct', "100.0 * count(*) FILTER (NEE IS NOT NULL AND NOT NEE BETWEEN -15 AND 10) / count(*)")}, {rs('missing_pct', "100.0 * count(*) FILTER (NEE IS NULL) / count(*)")}, {rs('min_kept', 'min(NEE) FILTER (NEE BETWEEN -15 AND 10)')}, {rs('max_kept', 'max(NEE) FILTER (NEE BETWEEN -15 AND 10)')} FROM h GROUP BY site_id""")
def qc_summary(spark, sf_dir):
    out = quality.qc_summary(quality.range_qc(halfhourly(spark, sf_dir), ["NEE"], [-15], [10]), "NEE", "NEE_MaxMinValue_qc", SITE)
    return out.select("site_id", *[r(c) for c in ("kept_pct", "removed_pct", "missing_pct", "min_kept", "max_kept")])


TBIN_SQL = """
, n1 AS (SELECT * FROM h WHERE Rg < 10)
, te AS (SELECT site_id, list_transform(quantile_cont(Tair, [1/6, 2/6, 3/6, 4/6, 5/6]), lambda e: round(e, 9)) AS te FROM n1 GROUP BY 1)
, tb AS (SELECT n1.*, CASE WHEN Tair IS NOT NULL THEN len(list_filter(te, lambda e: Tair > e)) END AS temp_group FROM n1 JOIN te USING (site_id))
"""


def bins_sql(rows: str, keys: str) -> str:
    """CTEs of the moving-point test over the night rows of ``rows`` (keys, NEE, ustar, temp_group): edges, bins, statistics and thresholds."""
    by = f"{keys}, temp_group"
    return f"""
, gate AS (SELECT {by}, corr(Tair, ustar) AS r FROM {rows} GROUP BY ALL)
, ue0 AS (SELECT {by}, list_transform(quantile_cont(ustar, list_transform(range(21), lambda i: i / 20)), lambda e: round(e, 12)) AS ue FROM {rows} GROUP BY ALL)
, ue1 AS (SELECT *, list_transform(range(3, 20), lambda p: list_transform(ue, lambda e: CASE WHEN abs(e) >= 1 OR e = 0 THEN round_even(e * power(10, p), 0) / power(10, p) ELSE round_even(e * power(10, p - floor(log10(abs(e))) - 1), 0) / power(10, p - floor(log10(abs(e))) - 1) END)) AS shown FROM ue0 WHERE len(list_distinct(ue)) = 21)
, ue2 AS (SELECT {by}, ue, coalesce(list_min(list_filter(range(3, 20), lambda p: len(list_distinct(shown[p - 2])) = 21)), 3) AS p, shown FROM ue1)
, ue AS (SELECT {by}, ue, list_transform(shown[p - 2], lambda e, i: CASE WHEN i = 1 THEN e - power(10, -p) ELSE e END) AS labels FROM ue2)
, grid AS (SELECT {by}, labels, unnest(range(20)) AS bin FROM ue)
, ub AS (SELECT t.*, len(list_filter(ue[2:20], lambda e: ustar > round(e, 9))) AS bin FROM {rows} t JOIN ue USING ({by}) WHERE ustar IS NOT NULL)
, us0 AS (SELECT {by}, bin, avg(NEE) AS mean_nee, count(ustar) AS n FROM ub GROUP BY ALL)
, us AS (SELECT {by}, bin, mean_nee, coalesce(n, 0) AS n, (labels[bin+1] + labels[bin+2])/2 AS mid FROM grid LEFT JOIN us0 USING ({by}, bin))
, lt AS (SELECT *, avg(mean_nee) OVER (PARTITION BY {by} ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lat FROM us)
, mp AS (SELECT {by}, coalesce(arg_min(mid, bin) FILTER (mean_nee > 0.99*lat), arg_min(mid, bin) FILTER (mean_nee > 0.9*lat), 0.1) AS threshold FROM lt GROUP BY ALL)
, found AS (SELECT {keys}, quantile_cont(threshold, 0.5) AS threshold FROM mp JOIN gate USING ({by}) WHERE coalesce(abs(r) < 0.4, true) GROUP BY ALL)
"""


MPT_SQL = UBIN_SQL = TBIN_SQL + bins_sql("tb", "site_id")


@query(TBIN_SQL + "SELECT site_id, datetime, CAST(temp_group AS BIGINT) AS temp_group FROM tb")
def quantile_bins(spark, sf_dir):
    night = quality.night(halfhourly(spark, sf_dir))
    return ustar.quantile_bin(night, "Tair", 6, SITE, "temp_group").select("site_id", "datetime", F.col("temp_group").cast("long").alias("temp_group"))


def _groups(spark, sf_dir):
    night = quality.night(halfhourly(spark, sf_dir))
    return ustar.quantile_bin(night, "Tair", 6, SITE, "temp_group").where("temp_group is not null")


@query(UBIN_SQL + f"SELECT site_id, CAST(temp_group AS BIGINT) AS temp_group, {rs('r')}, coalesce(abs(r) < 0.4, true) AS accepted FROM gate")
def correlation_gate(spark, sf_dir):
    out = ustar.correlation_gate(_groups(spark, sf_dir), "Tair", "ustar", ["site_id", "temp_group"])
    return out.select("site_id", F.col("temp_group").cast("long").alias("temp_group"), r("r"), "accepted")


@query(UBIN_SQL + f"SELECT site_id, CAST(temp_group AS BIGINT) AS temp_group, CAST(bin AS BIGINT) AS bin, {rs('mean_nee')}, n, {rs('mid')} FROM us")
def ustar_bin_stats(spark, sf_dir):
    out = ustar.ustar_bin_stats(_groups(spark, sf_dir), "ustar", "NEE", ["site_id", "temp_group"])
    return out.select("site_id", F.col("temp_group").cast("long").alias("temp_group"), F.col("bin").cast("long").alias("bin"), r("mean_nee"), "n", r("mid"))


@query(MPT_SQL + f"SELECT site_id, CAST(temp_group AS BIGINT) AS temp_group, {rs('threshold')} FROM mp")
def moving_point(spark, sf_dir):
    keys = ["site_id", "temp_group"]
    out = ustar.moving_point(ustar.ustar_bin_stats(_groups(spark, sf_dir), "ustar", "NEE", keys), keys)
    return out.select("site_id", F.col("temp_group").cast("long").alias("temp_group"), r("threshold"))


@query(MPT_SQL + f"SELECT site_id, {rs('threshold')} FROM (SELECT DISTINCT site_id FROM n1) LEFT JOIN found USING (site_id)")
def mpt_threshold(spark, sf_dir):
    return ustar.mpt_threshold(halfhourly(spark, sf_dir), "ustar", keys=SITE).select("site_id", r("threshold"))


@query("""
, p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY site_id) AS cnt FROM h)
, d AS (SELECT site_id, rep, ('0x' || substr(md5('42|' || site_id || '|' || rep || '|' || pos), 1, 8))::BIGINT % cnt AS pos FROM p, range(3) t(rep))
SELECT p.site_id, p.datetime, d.rep, count(*) AS weight FROM d JOIN p ON d.site_id = p.site_id AND d.pos = p.pos GROUP BY ALL""")
def bootstrap_weights(spark, sf_dir):
    out = ustar.bootstrap_sample(halfhourly(spark, sf_dir), 3, 42, SITE)
    return out.select("site_id", "datetime", F.col("rep").cast("long").alias("rep"), "weight")


DRAWN_SQL = """
, p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY site_id) AS cnt FROM h)
, d AS (SELECT site_id, rep, ('0x' || substr(md5('42|' || site_id || '|' || rep || '|' || pos), 1, 8))::BIGINT % cnt AS pos FROM p, range(100) t(rep))
, n1 AS (SELECT d.rep, p.* FROM d JOIN p USING (site_id, pos) WHERE Rg < 10)
, te AS (SELECT site_id, rep, list_transform(quantile_cont(Tair, [1/6, 2/6, 3/6, 4/6, 5/6]), lambda e: round(e, 9)) AS te FROM n1 GROUP BY ALL)
, tb AS (SELECT n1.*, CASE WHEN Tair IS NOT NULL THEN len(list_filter(te, lambda e: Tair > e)) END AS temp_group FROM n1 JOIN te USING (site_id, rep))
"""


@query(DRAWN_SQL + bins_sql("tb", "site_id, rep") + f"""SELECT site_id, season, {rs('u5', 'quantile_cont(threshold, 0.05)')}, {rs('u50', 'quantile_cont(threshold, 0.5)')}, {rs('u95', 'quantile_cont(threshold, 0.95)')} FROM (SELECT DISTINCT site_id, rep FROM n1) LEFT JOIN found USING (site_id, rep), (VALUES ('all'), ('overall')) v(season) GROUP BY ALL""")
def bootstrap_ustar(spark, sf_dir):
    out = ustar.bootstrap_ustar(halfhourly(spark, sf_dir), None, 100, "ustar", keys=SITE)
    return out.select("site_id", "season", r("u5"), r("u50"), r("u95"))


def poisson_sql(x: str = "") -> str:
    """The operator's hash and its inverted Poisson distribution over rows (site_id, datetime, rep)."""
    p, cuts = ustar.PRIME, " + ".join(f"(x >= {c})::BIGINT" for c in ustar.POISSON_CUTS)
    made = f"""
, nm AS (SELECT *, ('0x' || substr(md5('42|' || site_id || '|' || datetime), 1, 7))::BIGINT AS a, ('0x' || substr(md5('42|' || site_id || '|' || datetime), 8, 7))::BIGINT AS b FROM h{x})
, x0 AS (SELECT nm.*, rep, (a + rep * {ustar.REP_STRIDE}) % {p} AS x FROM nm, range(100) t(rep))"""
    for k, (stride, shift) in enumerate(zip(ustar.STRIDES, ustar.SHIFTS)):
        made += f"""
, x{k + 1} AS (SELECT * REPLACE (xor(x, x >> {shift}) % {p} AS x) FROM (SELECT * REPLACE ((x * {stride} + b) % {p} AS x) FROM x{k}))"""
    return made + f"""
, pw AS (SELECT * EXCLUDE (x), {cuts} AS weight FROM x{len(ustar.STRIDES)})
"""


@query(poisson_sql() + "SELECT site_id, datetime, rep, weight FROM pw WHERE weight > 0 AND rep < 10")
def poisson_weights(spark, sf_dir):
    out = ustar.poisson_sample(halfhourly(spark, sf_dir), 10, 42, SITE)
    return out.select("site_id", "datetime", F.col("rep").cast("long").alias("rep"), "weight")


#: Two seasons that overlap, and one without rows.
SEASONS = [("2024-01-01 00:00:00", "2024-01-18 23:59:59"), ("2024-01-12 00:00:00", "2024-12-31 23:59:59"), ("1999-01-01 00:00:00", "1999-12-31 23:59:59")]
SEASON_SQL = ", ".join(f"('{a} to {b}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in SEASONS)
TEMP_GROUPS_SQL = """
, te AS (SELECT site_id, rep, season, list_transform(quantile_cont(Tair, [1/6, 2/6, 3/6, 4/6, 5/6]), lambda e: round(e, 9)) AS te FROM n1 GROUP BY ALL)
, tb AS (SELECT n1.*, CASE WHEN Tair IS NOT NULL THEN len(list_filter(te, lambda e: Tair > e)) END AS temp_group FROM n1 JOIN te USING (site_id, rep, season))
"""
THRESHOLDS_SQL = bins_sql("tb", "site_id, rep, season") + """
, each AS (SELECT site_id, rep, season, threshold FROM (SELECT DISTINCT site_id, rep, season FROM n1) LEFT JOIN found USING (site_id, rep, season))
, reps AS (FROM each UNION ALL SELECT site_id, rep, 'overall', max(threshold) FROM each GROUP BY ALL)
"""
POISSON_SQL = poisson_sql(" WHERE Rg < 10") + ", n1 AS (SELECT *, 'all' AS season, unnest(range(weight)) AS copy FROM pw WHERE weight > 0)" + TEMP_GROUPS_SQL + THRESHOLDS_SQL
SEASONS_SQL = f"""
, p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY site_id) AS cnt FROM h)
, d AS (SELECT site_id, rep, ('0x' || substr(md5('42|' || site_id || '|' || rep || '|' || pos), 1, 8))::BIGINT % cnt AS pos FROM p, range(100) t(rep))
, n1 AS (SELECT d.rep, p.*, season FROM d JOIN p USING (site_id, pos), (VALUES {SEASON_SQL}) v(season, a, b) WHERE Rg < 10 AND datetime BETWEEN a AND b)
""" + TEMP_GROUPS_SQL + THRESHOLDS_SQL
PERCENTILES_SQL = f"""SELECT site_id, season, {rs('u5', 'quantile_cont(threshold, 0.05)')}, {rs('u50', 'quantile_cont(threshold, 0.5)')}, {rs('u95', 'quantile_cont(threshold, 0.95)')} FROM reps GROUP BY ALL"""


def _percentiles(out):
    return out.select("site_id", "season", r("u5"), r("u50"), r("u95"))


@query(POISSON_SQL + PERCENTILES_SQL)
def bootstrap_poisson(spark, sf_dir):
    return _percentiles(ustar.bootstrap_ustar(halfhourly(spark, sf_dir), None, 100, "ustar", keys=SITE, draws="poisson"))


@query(SEASONS_SQL + PERCENTILES_SQL)
def bootstrap_seasons(spark, sf_dir):
    return _percentiles(ustar.bootstrap_ustar(halfhourly(spark, sf_dir), SEASONS, 100, "ustar", keys=SITE))


@query(POISSON_SQL + f"SELECT site_id, rep, season, {rs('threshold')} FROM reps")
def bootstrap_thresholds(spark, sf_dir):
    """The threshold of each replicate."""
    out = ustar.bootstrap_thresholds(halfhourly(spark, sf_dir), None, 100, "ustar", keys=SITE, draws="poisson")
    return out.select("site_id", F.col("rep").cast("long").alias("rep"), "season", r("threshold"))


@query(f"""SELECT site_id, datetime, {rs('reco', '2.5 * exp(200 * (1/56.02 - 1/(Tair + 46.02)))')} FROM h""")
def lloyd_taylor(spark, sf_dir):
    return halfhourly(spark, sf_dir).select("site_id", "datetime", r("reco", physics.lloyd_taylor(F.col("Tair"), F.lit(2.5), F.lit(200.0))))


WINDOW_SQL = """
, p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY site_id) AS cnt FROM h)
, w AS (SELECT p.*, k AS "window", k * {s} AS "start" FROM p JOIN range(100000) t(k) ON pos >= k * {s} AND pos < k * {s} + {w} AND k * {s} < cnt - {w})
"""


@query(WINDOW_SQL.format(s=240, w=720) + """SELECT site_id, "window", count(*) AS n_rows, min(pos) AS first_pos, max(pos) AS last_pos FROM w GROUP BY 1, 2""")
def row_windows(spark, sf_dir):
    out = windows.row_windows(halfhourly(spark, sf_dir), 720, 240, SITE)
    return out.groupBy("site_id", "window").agg(F.count("*").alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def narrowed(table: str, fit: str, first: str, steps: list[float]) -> str:
    """CTEs z1, z2, ... that close in on the root of a fit's slope in e: each level takes the last of its points with a positive slope."""
    made, last = "", first
    for k, step in enumerate(steps, 1):
        made += f""", z{k} AS (SELECT site_id, "window", coalesce(max(e) FILTER (slope > 0), min(e)) AS e FROM (SELECT w.site_id, w."window", e, {fit} AS slope FROM (SELECT site_id, "window", e0 + i * {step!r} AS e FROM {last} q(site_id, "window", e0), range(0, 21) t(i)) c JOIN {table} w USING (site_id, "window") GROUP BY 1, 2, 3) GROUP BY 1, 2)
"""
        last = f"z{k}"
    return made


E0_STEPS = [1.0, 0.05, 0.0025, 1.25e-4, 6.25e-6, 3.125e-7, 1.5e-8, 1e-9]
E0_SQL = WINDOW_SQL.format(s=240, w=720) + """
, nr AS (SELECT site_id, "window", NEE, 1/56.02 - 1/(Tair + 46.02) AS g FROM w WHERE Rg < 10 AND NEE IS NOT NULL AND Tair IS NOT NULL)
, ok AS (SELECT site_id, "window" FROM w WHERE Rg < 10 AND NEE IS NOT NULL AND Tair IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 6 AND max(Tair) - min(Tair) >= 5)
, nw AS (SELECT nr.* FROM nr JOIN ok USING (site_id, "window"))
, z0 AS (SELECT site_id, "window", greatest(30.0, arg_min(e, loss) - 10) AS e FROM (SELECT site_id, "window", e, sum((NEE - exp(e * g)) * (NEE - exp(e * g))) AS loss FROM nw, (SELECT 30.0 + 5 * i AS e FROM range(85) t(i)) GROUP BY 1, 2, 3) GROUP BY 1, 2)
""" + narrowed("nw", "sum(g * exp(e * g) * (NEE - exp(e * g)))", "z0", E0_STEPS) + f"""
, fe AS (SELECT site_id, "window", least(e, 450.0) AS e0, sqrt(sum((NEE - exp(e * g)) * (NEE - exp(e * g))) / (count(*) - 1) / sum(g * g * exp(2 * e * g))) / least(e, 450.0) AS rel_err FROM nw JOIN z{len(E0_STEPS)} USING (site_id, "window") GROUP BY 1, 2, e)
, fits AS (SELECT * FROM fe WHERE rel_err < 0.5)
, best AS (SELECT site_id, avg(e0) AS e0 FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY rel_err, "window") AS k FROM fits) WHERE k <= 3 GROUP BY 1)
"""


@query(E0_SQL + """SELECT site_id, "window", round(e0 + 1e-9, 4) AS e0, round(rel_err + 1e-9, 4) AS rel_err FROM fits""")
def e0_windows(spark, sf_dir):
    out = partition.fit_e0_windows(halfhourly(spark, sf_dir), keys=SITE, nulls="drop_rows")
    return out.select("site_id", "window", F.round(F.col("e0") + 1e-9, 4).alias("e0"), F.round(F.col("rel_err") + 1e-9, 4).alias("rel_err"))


@query(E0_SQL + "SELECT site_id, round(e0 + 1e-9, 4) AS e0 FROM best")
def global_e0(spark, sf_dir):
    out = partition.global_e0(partition.fit_e0_windows(halfhourly(spark, sf_dir), keys=SITE, nulls="drop_rows"), SITE)
    return out.select("site_id", F.round(F.col("e0") + 1e-9, 4).alias("e0"))


RREF_SQL = WINDOW_SQL.format(s=192, w=336) + """
, rr AS (SELECT site_id, "window", "start" + 168 AS pos, least(greatest(sum(kk * NEE) / sum(kk * kk), 0), 1000) AS rref, count(*) AS n FROM (SELECT *, exp(200 * (1/56.02 - 1/(Tair + 46.02))) AS kk FROM w WHERE Rg < 10 AND NEE IS NOT NULL AND Tair IS NOT NULL) GROUP BY 1, 2, 3)
, an AS (SELECT site_id, pos, rref FROM rr WHERE n >= 3)
"""


@query(RREF_SQL + f"""SELECT site_id, "window", pos, {rs('rref')} FROM rr WHERE n >= 3""")
def rref_windows(spark, sf_dir):
    h = halfhourly(spark, sf_dir).withColumn("e0", F.lit(200.0))
    return partition.estimate_rref(h, keys=SITE, nulls="drop_rows").select("site_id", "window", "pos", r("rref"))


INTERP_SQL = """
, j AS (SELECT p.site_id, p.datetime, p.pos, p.NEE, p.Tair, p.Rg, rref FROM p LEFT JOIN an USING (site_id, pos))
, k2 AS (SELECT *, last_value(CASE WHEN rref IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last_value(rref IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN rref IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1, first_value(rref IGNORE NULLS) OVER a AS v1 FROM j
  WINDOW b AS (PARTITION BY site_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY site_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
, ip AS (SELECT *, CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 WHEN p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END AS rf FROM k2)
"""


@query("""
, p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY datetime) - 1 AS pos FROM h)
, an AS (SELECT site_id, pos, NEE AS rref FROM p WHERE NEE IS NOT NULL)
""" + INTERP_SQL + f"SELECT site_id, datetime, {rs('NEE', 'rf')} FROM ip")
def interp_position(spark, sf_dir):
    return windows.interpolate_by_position(windows.positions(halfhourly(spark, sf_dir), SITE), "NEE", SITE).select("site_id", "datetime", r("NEE"))


LINE_SQL = """
, line AS (SELECT * REPLACE (datetime + to_days(CAST(64 * site_id AS INTEGER)) AS datetime) FROM h)
"""


def one_line(h):
    """All sites as one series without keys, 64 days apart."""
    return h.withColumn("datetime", F.col("datetime") + F.make_dt_interval((64 * F.col("site_id")).cast("int")))


@query(LINE_SQL + """
, p AS (SELECT *, row_number() OVER (ORDER BY datetime) - 1 AS pos, count(*) OVER () AS cnt FROM line)
SELECT k AS "window", count(*) AS n_rows, min(pos) AS first_pos, max(pos) AS last_pos FROM p JOIN range(100000) t(k) ON pos >= k * 240 AND pos < k * 240 + 720 AND k * 240 < cnt - 720 GROUP BY 1""")
def row_windows_keyless(spark, sf_dir):
    out = windows.row_windows(one_line(halfhourly(spark, sf_dir)), 720, 240)
    return out.groupBy("window").agg(F.count("*").alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(LINE_SQL + """
, p AS (SELECT 0 AS site_id, * EXCLUDE (site_id), row_number() OVER (ORDER BY datetime) - 1 AS pos FROM line)
, an AS (SELECT site_id, pos, NEE AS rref FROM p WHERE NEE IS NOT NULL)
""" + INTERP_SQL + f"SELECT datetime, {rs('NEE', 'rf')} FROM ip")
def interp_position_keyless(spark, sf_dir):
    placed = windows.positions(one_line(halfhourly(spark, sf_dir)))
    return windows.interpolate_by_position(placed, "NEE", chunk_rows=1000).select("datetime", r("NEE"))


@query(RREF_SQL + INTERP_SQL + f"""SELECT site_id, datetime, {rs('RECO', 'CASE WHEN rf IS NULL THEN NULL ELSE rf * exp(200 * (1/56.02 - 1/(Tair + 46.02))) END')}, {rs('GPP', 'CASE WHEN rf IS NULL THEN NULL ELSE rf * exp(200 * (1/56.02 - 1/(Tair + 46.02))) - NEE END')} FROM ip""")
def nt_partition_fixed_e0(spark, sf_dir):
    out = partition.nt_partition(halfhourly(spark, sf_dir), keys=SITE, nulls="drop_rows", e0=200.0)
    return out.select("site_id", "datetime", r("RECO"), r("GPP"))


NT_SQL = E0_SQL + """
, w2 AS (SELECT p.*, k AS "window", k * 192 AS "start" FROM p JOIN range(100000) t(k) ON pos >= k * 192 AND pos < k * 192 + 336 AND k * 192 < cnt - 336)
, rr AS (SELECT site_id, "window", "start" + 168 AS pos, least(greatest(sum(kk * NEE) / sum(kk * kk), 0), 1000) AS rref, count(*) AS n FROM (SELECT w2.*, exp(e0 * (1/56.02 - 1/(Tair + 46.02))) AS kk FROM w2 JOIN best USING (site_id) WHERE Rg < 10 AND NEE IS NOT NULL AND Tair IS NOT NULL) GROUP BY 1, 2, 3)
, an AS (SELECT site_id, pos, rref FROM rr WHERE n >= 3)
""" + INTERP_SQL + """
, model AS (SELECT ip.*, rf * exp(e0 * (1/56.02 - 1/(Tair + 46.02))) AS reco FROM ip LEFT JOIN best USING (site_id))
"""


@query(NT_SQL + f"""SELECT site_id, datetime, round(CASE WHEN rf IS NULL THEN NULL WHEN Rg < 10 THEN NEE ELSE reco END + 1e-9, 4) AS RECO, round(CASE WHEN rf IS NULL THEN NULL WHEN Rg < 10 THEN 0 ELSE reco - NEE END + 1e-9, 4) AS GPP FROM model""")
def nt_partition(spark, sf_dir):
    out = partition.nt_partition(halfhourly(spark, sf_dir), keys=SITE, nulls="drop_rows", night_estimate=False)
    return out.select("site_id", "datetime", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("RECO", "GPP")])


@query(f"""SELECT site_id, datetime, {rs('nee', '0.05 * 25 * Rg / (0.05 * Rg + 25) + 2')} FROM h""")
def light_response(spark, sf_dir):
    c = physics.light_response(F.col("Rg"), F.lit(0.05), F.lit(25.0), F.lit(2.0))
    return halfhourly(spark, sf_dir).select("site_id", "datetime", r("nee", c))


@query(f"""SELECT site_id, datetime, {rs('beta', 'CASE WHEN VPD > 6 THEN 25 * exp(-0.05 * (VPD - 6)) ELSE 25 END')} FROM h""")
def vpd_beta(spark, sf_dir):
    return halfhourly(spark, sf_dir).select("site_id", "datetime", r("beta", physics.vpd_limited_beta(F.col("VPD"), F.lit(25.0), F.lit(0.05), 6.0)))


@query("""
, b AS (SELECT site_id, min(datetime) AS t0, max(datetime) AS t1 FROM h GROUP BY 1)
, c2 AS (SELECT site_id, k AS "window", t0 + to_days(CAST(2*k AS INTEGER)) AS centre FROM b JOIN range(100000) t(k) ON k <= date_diff('second', t0, t1) / 172800)
SELECT c2.site_id, "window", centre, count(*) AS n_rows, min(datetime) AS first_row, max(datetime) AS last_row FROM c2 JOIN h ON h.site_id = c2.site_id AND datetime BETWEEN centre - INTERVAL 7 DAYS AND centre + INTERVAL 7 DAYS GROUP BY 1, 2, 3""")
def time_windows(spark, sf_dir):
    out = windows.time_windows(halfhourly(spark, sf_dir), 15, 2, SITE)
    return out.groupBy("site_id", "window", "centre").agg(F.count("*").alias("n_rows"), F.min("datetime").alias("first_row"), F.max("datetime").alias("last_row"))


def light_level(last: str, k: int, step: float, at: str = '"window", u0') -> str:
    """CTE v<k>: of 21 points of u above each window's, the last from which the loss still falls, with its exact box fit."""
    most, cap = f"least({partition.MOST_GPP!r}, hh * {partition.MOST_ALPHA!r})", f"{partition.MOST_BETA!r}::DOUBLE"
    side = lambda g, b: f"(SELECT {{'c': gg*gg*ss - 2*gg*ys - 2*gg*bb*s + 2*bb*y + bb*bb*n, 'g': gg, 'b': bb}} FROM (SELECT {g} AS gg, {b} AS bb))"
    clip = lambda x, hi: f"greatest(0, least({x}, {hi}))"
    sides = [side(clip("ys/ss", most), "0::DOUBLE"), side(clip(f"(ys + {cap}*s)/ss", most), cap), side("0::DOUBLE", clip("-y/n", cap)), side(most, clip(f"({most}*s - y)/n", cap))]
    return f"""
, s{k} AS (SELECT site_id, "window", u, exp(u) AS hh, count(*) AS n, sum(y) AS y, sum(s) AS s, sum(s*s) AS ss, sum(y*s) AS ys, sum(s*t) AS st, sum(y*t) AS yt, sum(t) AS t
  FROM (SELECT *, Rg/(Rg + exp(u)) AS s, Rg/(Rg + exp(u))/(Rg + exp(u)) AS t FROM (SELECT site_id, "window", u0 + i * {step!r} AS u FROM {last}, range(0, 21) q(i)) JOIN ld USING (site_id, "window")) GROUP BY 1, 2, 3)
, f{k} AS (SELECT *, CASE WHEN gi BETWEEN 0 AND {most} AND bi BETWEEN 0 AND {cap} THEN {{'c': 0::DOUBLE, 'g': gi, 'b': bi}} ELSE list_min([{", ".join(sides)}]) END AS o
  FROM (SELECT *, (n*ys - s*y)/(n*ss - s*s) AS gi, (s*ys - ss*y)/(n*ss - s*s) AS bi FROM s{k}))
, v{k} AS (SELECT site_id, "window", coalesce(max(u) FILTER (-o.g * (yt - o.g*st + o.b*t) + CASE WHEN o.g >= hh * {partition.MOST_ALPHA!r} THEN ys - o.g*ss + o.b*s ELSE 0 END > 0), min(u)) AS u0 FROM f{k} GROUP BY 1, 2)
"""


DAY_E0_STEPS = [5.0, 0.25, 0.0125, 6.25e-4, 3.125e-5, 1.5625e-6, 7.8125e-8, 3.90625e-9]
DAY_SQL = """
, b AS (SELECT site_id, min(datetime) AS t0, max(datetime) AS t1 FROM h GROUP BY 1)
, c2 AS (SELECT site_id, k AS "window", t0 + to_days(CAST(2*k AS INTEGER)) AS centre FROM b JOIN range(100000) t(k) ON k <= date_diff('second', t0, t1) / 172800)
, wr AS (SELECT c2.site_id, "window", centre, NEE, Tair, Rg, 1/56.02 - 1/(Tair + 46.02) AS g FROM c2 JOIN h ON h.site_id = c2.site_id AND datetime BETWEEN centre - INTERVAL 7 DAYS AND centre + INTERVAL 7 DAYS)
, okw AS (SELECT site_id, "window", any_value(centre) AS centre FROM wr GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (Rg < 10 AND NEE IS NOT NULL AND Tair IS NOT NULL) > 5)
, nd AS (SELECT wr.* FROM wr JOIN okw USING (site_id, "window") WHERE Rg < 10 AND NEE IS NOT NULL AND wr.Tair IS NOT NULL)
, z0 AS (SELECT site_id, "window", greatest(-2000.0, arg_min(e, loss) - 50) AS e FROM (SELECT site_id, "window", e, sum(NEE*NEE) - power(sum(exp(e*g)*NEE), 2) / sum(exp(2*e*g)) AS loss FROM nd, (SELECT -2000.0 + 50*i AS e FROM range(101) t(i)) GROUP BY 1, 2, 3) GROUP BY 1, 2)
""" + narrowed("nd", "sum(exp(e*g)*NEE) * (sum(g*exp(e*g)*NEE) - sum(exp(e*g)*NEE) / sum(exp(2*e*g)) * sum(g*exp(2*e*g)))", "z0", DAY_E0_STEPS) + f"""
, nf AS (SELECT site_id, "window", e AS E0, sum(exp(e*g)*NEE) / sum(exp(2*e*g)) AS R_ref FROM nd JOIN z{len(DAY_E0_STEPS)} USING (site_id, "window") GROUP BY 1, 2, 3)
"""
# the grid's step is a tenth of log 10; each of the levels after it has twenty steps of the one before
LIGHT_STEPS = [math.log(10) / 100 / 20**k for k in range(7)]
LIGHT_SQL = DAY_SQL + """
, ld0 AS (SELECT site_id, "window", Rg, R_ref*exp(E0*g) - NEE AS y FROM wr JOIN nf USING (site_id, "window") WHERE Rg >= 10 AND NEE IS NOT NULL AND Tair IS NOT NULL)
, ld AS (SELECT * FROM ld0 QUALIFY count(*) OVER (PARTITION BY site_id, "window") > 3)
, g0 AS (SELECT DISTINCT site_id, "window", ln(10) * (-1 + 2.1*j) AS u0 FROM ld, range(4) t(j))
""" + light_level("g0", 0, math.log(10) / 10).split("\n, v0")[0] + """
, v0 AS (SELECT site_id, "window", greatest(-ln(10), arg_min(u, o.g*o.g*ss - 2*o.g*ys - 2*o.g*o.b*s + 2*o.b*y + o.b*o.b*n) - ln(10)/10) AS u0 FROM f0 WHERE u < 6.05 * ln(10) GROUP BY 1, 2)
""" + "".join(light_level(f"v{k}", k + 1, step) for k, step in enumerate(LIGHT_STEPS)) + f"""
, lf AS (SELECT site_id, "window", o.g / hh AS alpha, o.g AS GPP_max, o.b AS beta FROM f{len(LIGHT_STEPS)} JOIN v{len(LIGHT_STEPS)} USING (site_id, "window") WHERE u = u0)
, fit AS (SELECT site_id, "window", centre, R_ref, E0, alpha, GPP_max, beta FROM nf JOIN okw USING (site_id, "window") LEFT JOIN lf USING (site_id, "window"))
"""


def places(c: str, digits: int):
    return F.round(F.col(c) + 1e-9, digits).alias(c)


@query(DAY_SQL + 'SELECT site_id, "window", centre, round(R_ref + 1e-9, 4) AS "R_ref", round(E0 + 1e-9, 3) AS "E0" FROM nf JOIN okw USING (site_id, "window")')
def dt_night_fit(spark, sf_dir):
    out = partition.fit_day_windows(halfhourly(spark, sf_dir), keys=SITE, nulls="drop_rows")
    return out.select("site_id", "window", "centre", places("R_ref", 4), places("E0", 3))


@query(LIGHT_SQL + 'SELECT site_id, "window", centre, round(alpha + 1e-9, 4) AS alpha, round(GPP_max + 1e-9, 3) AS "GPP_max", round(beta + 1e-9, 4) AS beta FROM fit')
def dt_light_fit(spark, sf_dir):
    out = partition.fit_day_windows(halfhourly(spark, sf_dir), keys=SITE, nulls="drop_rows")
    return out.select("site_id", "window", "centre", places("alpha", 4), places("GPP_max", 3), places("beta", 4))


TIME_SQL = f"""
, b AS (SELECT site_id, datetime AS t, Tair AS v, lead(datetime) OVER w AS t2, lead(Tair) OVER w AS v2, lag(datetime) OVER w AS t_, lag(Tair) OVER w AS v_ FROM h WHERE hour(datetime) = 6 AND minute(datetime) = 0 WINDOW w AS (PARTITION BY site_id ORDER BY datetime))
, s AS (SELECT site_id, t, CASE WHEN t2 IS NULL THEN coalesce(t_, t) ELSE t END AS ta, CASE WHEN t2 IS NULL THEN coalesce(v_, v) ELSE v END AS va, coalesce(t2, t) AS tb, coalesce(v2, v) AS vb, row_number() OVER (PARTITION BY site_id ORDER BY t) AS k FROM b)
, l AS (SELECT h.site_id, h.datetime, coalesce(max(k) FILTER (s.t <= h.datetime), 1) AS k FROM h JOIN s ON h.site_id = s.site_id GROUP BY 1, 2)
SELECT l.site_id, l.datetime, {rs('anchor', "va + (vb - va) * CASE WHEN ta = tb THEN 0 ELSE CAST(date_diff('second', ta, l.datetime) AS DOUBLE) / date_diff('second', ta, tb) END")} FROM l JOIN s USING (site_id, k)"""


def _at_six(h):
    return h.where((F.hour("datetime") == 6) & (F.minute("datetime") == 0))


@query(TIME_SQL)
def interp_time(spark, sf_dir):
    h = halfhourly(spark, sf_dir).select("site_id", "datetime", "Tair")
    anchors = _at_six(h).select("site_id", F.col("datetime").alias("centre"), F.col("Tair").alias("anchor"))
    out = windows.interpolate_by_time(h, anchors, ["anchor"], SITE)
    return out.where("anchor is not null").select("site_id", "datetime", r("anchor"))


@query(LINE_SQL + TIME_SQL.replace("FROM h ", "FROM (SELECT 0 AS site_id, * EXCLUDE (site_id) FROM line) h ").replace("SELECT l.site_id, l.datetime", "SELECT l.datetime"))
def interp_time_keyless(spark, sf_dir):
    h = one_line(halfhourly(spark, sf_dir)).select("datetime", "Tair")
    anchors = _at_six(h).select(F.col("datetime").alias("centre"), F.col("Tair").alias("anchor"))
    return windows.interpolate_by_time(h, anchors, ["anchor"]).where("anchor is not null").select("datetime", r("anchor"))


@query(LINE_SQL + """
, b AS (SELECT min(datetime) AS t0, max(datetime) AS t1 FROM line)
, c2 AS (SELECT k AS "window", t0 + to_days(CAST(2*k AS INTEGER)) AS centre FROM b JOIN range(100000) t(k) ON k <= date_diff('second', t0, t1) / 172800)
SELECT "window", centre, count(*) AS n_rows, min(line.datetime) AS first_row, max(line.datetime) AS last_row FROM c2 JOIN line ON line.datetime BETWEEN centre - INTERVAL 7 DAYS AND centre + INTERVAL 7 DAYS GROUP BY 1, 2""")
def time_windows_keyless(spark, sf_dir):
    out = windows.time_windows(one_line(halfhourly(spark, sf_dir)), 15, 2)
    return out.groupBy("window", "centre").agg(F.count("*").alias("n_rows"), F.min("datetime").alias("first_row"), F.max("datetime").alias("last_row"))


FITTED = ("R_ref", "E0", "alpha", "GPP_max", "beta")


@query(LIGHT_SQL + f"""
, an AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY centre) AS k, count(*) OVER (PARTITION BY site_id) AS m FROM fit WHERE alpha IS NOT NULL)
, l AS (SELECT h.site_id, h.datetime, any_value(h.NEE) AS NEE, any_value(h.Tair) AS Tair, any_value(h.Rg) AS Rg, greatest(1, least(coalesce(max(k) FILTER (centre <= datetime), 1), max(m) - 1)) AS k FROM h LEFT JOIN an USING (site_id) GROUP BY 1, 2)
, li AS (SELECT l.*, coalesce(date_diff('second', x.centre, datetime)::DOUBLE / date_diff('second', x.centre, z.centre), 0) AS share, {", ".join(f"x.{c} AS {c}0, coalesce(z.{c}, x.{c}) AS {c}1" for c in FITTED)}
  FROM l LEFT JOIN an x ON x.site_id = l.site_id AND x.k = l.k LEFT JOIN an z ON z.site_id = l.site_id AND z.k = l.k + 1)
, lv AS (SELECT site_id, datetime, NEE, Tair, Rg, {", ".join(f"{c}0 + ({c}1 - {c}0) * share AS {c}" for c in FITTED)} FROM li)
, lm AS (SELECT *, R_ref * exp(E0 * (1/56.02 - 1/(Tair + 46.02))) AS reco, alpha * Rg * GPP_max / (alpha * Rg + GPP_max) - beta AS model FROM lv)
SELECT site_id, datetime, round(CASE WHEN Rg >= 10 THEN reco ELSE NEE END + 1e-9, 4) AS "RECO", round(CASE WHEN Rg >= 10 THEN reco - NEE END + 1e-9, 4) AS "GPP", round(CASE WHEN Rg >= 10 THEN model END + 1e-9, 4) AS "GPP_model" FROM lm""")
def dt_partition(spark, sf_dir):
    out = partition.dt_partition(halfhourly(spark, sf_dir), keys=SITE, nulls="drop_rows")
    return out.select("site_id", "datetime", *[places(c, 4) for c in ("RECO", "GPP", "GPP_model")])


@query("""SELECT site_id, count(NEE) AS known, count(*) - count(NEE) AS missing FROM h GROUP BY 1""")
def gap_split(spark, sf_dir):
    known, missing = gapfill.split_known_missing(halfhourly(spark, sf_dir), "NEE")
    a = known.groupBy("site_id").agg(F.count("*").alias("known"))
    b = missing.groupBy("site_id").agg(F.count("*").alias("missing"))
    return a.join(b, "site_id", "full").select("site_id", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("missing", F.lit(0)).alias("missing"))


FEATURES = ["Rg", "Tair", "VPD", "ustar"]


def _filled(spark, sf_dir, short, **params):
    h = halfhourly(spark, sf_dir)
    out = gapfill.FILL[short](h, "NEE", "use_custom_X_col", FEATURES, keys=SITE, **params).table
    return out.select("site_id", "datetime", "NEE", *[F.round(f"NEE_{short}{c}", 3).alias(f"NEE_{short}{c}") for c in ("pred", "GapFilled")])


@query()
def fill_gbt(spark, sf_dir):
    return _filled(spark, sf_dir, "XGB")


GRAM = ["1", *FEATURES, "NEE"]
TRAIN_SQL = """, tr AS (SELECT * FROM h WHERE NEE IS NOT NULL AND ('0x' || substr(md5('0|' || site_id || '|' || strftime(datetime, '%Y-%m-%d %H:%M:%S')), 1, 8))::BIGINT % 10 >= 3)
"""


@query(TRAIN_SQL + " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b})::DOUBLE, 4) AS total FROM tr""" for i, a in enumerate(GRAM) for b in GRAM[i:]))
def gram_sums(spark, sf_dir):
    """What a linear booster knows of its training rows."""
    rows = gapfill.train_test(halfhourly(spark, sf_dir), SITE).where("NEE is not null and not __test")
    return gapfill.gram(rows, [*FEATURES, "NEE"]).select("a", "b", F.round("total", 4).alias("total"))


def _rounds_sql(rounds: int, rate: float, alpha: float, lambda_: float, by: str = "0") -> str:
    """The rounds of the linear booster as a recursive table of weights, one step for each coordinate, for each ``by``."""
    k = len(FEATURES)
    c = lambda a, b: f"sum({a} * {b})::DOUBLE"
    rows = [f"[{', '.join(c(a, b) for b in GRAM[:-1])}]" for a in GRAM[:-1]]
    dot = f"list_sum(list_transform(range({k + 1}), lambda i: g[j + 1][i + 1] * w[i + 1]))"
    curve, ridge = f"(g[j + 1][j + 1] + n * {lambda_!r})", f"n * {lambda_!r} * w[j + 1]"
    free = f"(w[j + 1] - ({dot} - c[j + 1] + {ridge}) / {curve})"
    to = f"CASE WHEN j = 0 THEN w[1] - {rate!r} * ({dot} - c[1]) / n ELSE w[j + 1] + {rate!r} * (sign({free}) * greatest(abs({free}) - n * {alpha!r} / {curve}, 0) - w[j + 1]) END"
    return TRAIN_SQL + f""", gm AS (SELECT {by} AS id, count(*)::DOUBLE AS n, [{', '.join(rows)}] AS g, [{', '.join(c(a, 'NEE') for a in GRAM[:-1])}] AS c FROM tr GROUP BY 1)
, ws AS (WITH RECURSIVE ws AS (SELECT id, 0 AS step, {[0.0] * (k + 1)}::DOUBLE[] AS w FROM gm UNION ALL SELECT id, step + 1, list_transform(w, lambda x, i: CASE WHEN i = j + 1 THEN v ELSE x END) FROM (SELECT id, step, j, w, {to} AS v FROM (SELECT *, step % {k + 1} AS j FROM ws WHERE step < {rounds * (k + 1)}) JOIN gm USING (id))) FROM ws WHERE step = {rounds * (k + 1)})
"""


LINEAR = {"rounds": 100, "step_size": 0.5, "reg_alpha": 0.01, "reg_lambda": 0.001}


@query(_rounds_sql(100, 0.5, 0.01, 0.001) + f"""SELECT site_id, datetime, NEE, round(CASE WHEN NEE IS NULL THEN p END, 3) AS "NEE_XGBpred", round(coalesce(NEE, p), 3) AS "NEE_XGBGapFilled" FROM (SELECT h.*, w[1] + {' + '.join(f'w[{i + 2}] * {c}' for i, c in enumerate(FEATURES))} AS p FROM h, ws)""")
def fill_gblinear(spark, sf_dir):
    return _filled(spark, sf_dir, "XGB", booster="gblinear", **LINEAR)


@query(_rounds_sql(100, 0.5, 0.01, 0.001, "site_id") + f"""SELECT site_id, datetime, NEE, round(CASE WHEN NEE IS NULL THEN p END, 3) AS "NEE_XGBpred", round(coalesce(NEE, p), 3) AS "NEE_XGBGapFilled" FROM (SELECT h.*, w[1] + {' + '.join(f'w[{i + 2}] * {c}' for i, c in enumerate(FEATURES))} AS p FROM h LEFT JOIN ws ON id = site_id)""")
def fill_gblinear_per_site(spark, sf_dir):
    return _filled(spark, sf_dir, "XGB", booster="gblinear", per_key=True, **LINEAR)


@query()
def fill_rf(spark, sf_dir):
    return _filled(spark, sf_dir, "RF")


@query()
def fill_ada(spark, sf_dir):
    return _filled(spark, sf_dir, "Ada")


@query()
def fill_ann(spark, sf_dir):
    return _filled(spark, sf_dir, "ANN")


@query(f"""SELECT CASE WHEN n % 4 = 0 THEN 'test' ELSE 'train' END AS part, {rs('rmse', 'sqrt(avg((VPD - 0.5*Tair)*(VPD - 0.5*Tair)))')}, {rs('mae', 'avg(abs(VPD - 0.5*Tair))')}, {rs('r2', '1 - sum((VPD - 0.5*Tair)*(VPD - 0.5*Tair)) / (count(VPD) * var_pop(VPD))')}, count(VPD) AS n FROM h GROUP BY 1""")
def fit_metrics(spark, sf_dir):
    h = halfhourly(spark, sf_dir).withColumn("p", 0.5 * F.col("Tair")).withColumn("test", F.col("n") % 4 == 0)
    return gapfill.fit_metrics(h, "VPD", "p", "test").select("part", r("rmse"), r("mae"), r("r2"), "n")


@query(f"""SELECT site_id, datetime, {rs('Rn_XGBpred', 'CASE WHEN n = 1 THEN greatest(Rn, 0) END')}, {rs('Rn_XGBGapFilled', 'CASE WHEN n = 1 THEN greatest(Rn, 0) ELSE Rn END')} FROM h""")
def clamp_nonnegative(spark, sf_dir):
    h = halfhourly(spark, sf_dir).withColumn("p", F.col("Rn")).withColumn("Rn", F.when(F.col("n") != 1, F.col("Rn")))
    return gapfill.gap_filled(h, "Rn", "XGB", "p").select("site_id", "datetime", r("Rn_XGBpred"), r("Rn_XGBGapFilled"))


@query(f"""SELECT site_id, datetime, {rs('Rn_XGBpred', 'CASE WHEN n = 1 THEN greatest(Rn, 0) END')}, {rs('Rn_XGBGapFilled', 'CASE WHEN n = 1 THEN greatest(Rn, 0) ELSE Rn END')}, {rs('Rn_XGBpred_all', 'greatest(Rn, 0)')} FROM h""")
def predict_all(spark, sf_dir):
    h = halfhourly(spark, sf_dir).withColumn("p", F.col("Rn")).withColumn("Rn", F.when(F.col("n") != 1, F.col("Rn")))
    return gapfill.gap_filled(h, "Rn", "XGB", "p", True).select("site_id", "datetime", r("Rn_XGBpred"), r("Rn_XGBGapFilled"), r("Rn_XGBpred_all"))


@query("""SELECT site_id, datetime, ('0x' || substr(md5('0|' || site_id || '|' || strftime(datetime, '%Y-%m-%d %H:%M:%S')), 1, 8))::BIGINT % 10 < 3 AS test FROM h""")
def train_test(spark, sf_dir):
    return gapfill.train_test(halfhourly(spark, sf_dir), SITE).select("site_id", "datetime", F.col("__test").alias("test"))


@query(f"""SELECT site_id, datetime, {rs('NEE', 'coalesce(NEE, -1.5)')} FROM h""")
def impute_constant(spark, sf_dir):
    return gapfill.impute_constant(halfhourly(spark, sf_dir), ["NEE"], -1.5).select("site_id", "datetime", r("NEE"))


@query("""SELECT site_id, 'NEE' AS target, unnest(['Rg', 'Tair', 'VPD', 'ustar']) AS feature FROM h GROUP BY 1
UNION ALL SELECT site_id, 'VPD', unnest(['Rg', 'Rn', 'Tair', 'n', 'ustar']) FROM h GROUP BY 1
UNION ALL SELECT site_id, 'era5', unnest(['Tair_era5', 'Tsoil_era5', 'SWC_era5', 'SWIN_era5', 'RH_era5', 'VPD_era5', 'Rn_era5']) FROM h GROUP BY 1""")
def feature_columns(spark, sf_dir):
    """Features that each mode chooses, for each site of the table."""
    h = halfhourly(spark, sf_dir)
    both = clean.build_dataset(h, era5_like(h), keys=SITE)
    chosen = {
        "NEE": gapfill.feature_columns(h, "NEE", "use_custom_X_col", FEATURES, SITE), "VPD": gapfill.feature_columns(h, "VPD", "all", None, SITE),
        "era5": gapfill.feature_columns(both, "VPD", "use_era5_only", None, SITE),
    }
    listed = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("feature")) for t, cs in chosen.items() for c in cs])
    return h.select("site_id").distinct().select("site_id", F.inline(listed))


@query()
def fill_columns(spark, sf_dir):
    h = halfhourly(spark, sf_dir)
    gaps = h.withColumn("VPD", F.when(F.dayofyear("datetime") % 5 != 0, F.col("VPD"))).withColumn("Tair", F.when(F.hour("datetime") != 3, F.col("Tair")))
    out = gapfill.fill_columns(gaps, "RandomForest", 0.0, "use_custom_X_col", ["VPD", "Tair"], ["Rg", "Rn", "ustar"], SITE)
    return out.table.select("site_id", "datetime", F.round("VPD_RFGapFilled", 3).alias("VPD_RFGapFilled"), F.round("Tair_RFGapFilled", 3).alias("Tair_RFGapFilled"))


@query()
def feature_importance(spark, sf_dir):
    done = gapfill.fill_random_forest(halfhourly(spark, sf_dir), "NEE", "use_custom_X_col", FEATURES, keys=SITE)
    return done.importance.select("feature", F.round("importance", 3).alias("importance"))


@query(f"""SELECT site_id, CAST(datetime AS DATE) AS date, strftime(datetime, '%H:%M') AS time, {rs('NEE', 'avg(NEE)')}, {rs('Tair', 'avg(Tair)')} FROM h GROUP BY 1, 2, 3""")
def fingerprint(spark, sf_dir):
    return report.fingerprint(halfhourly(spark, sf_dir), ["NEE", "Tair"], SITE).select("site_id", "date", "time", r("NEE"), r("Tair"))


@query(f"""SELECT site_id, CAST(hour(datetime) AS INTEGER) AS hour, {rs('NEE_mean', 'avg(NEE)')}, {rs('NEE_std', 'stddev_samp(NEE)')}, {rs('NEE_err', '0.3*stddev_samp(NEE)')} FROM h GROUP BY 1, 2""")
def diurnal_cycle(spark, sf_dir):
    return report.diurnal_cycle(halfhourly(spark, sf_dir), ["NEE"], SITE).select("site_id", "hour", r("NEE_mean"), r("NEE_std"), r("NEE_err"))


@query(f"""
, q AS (SELECT site_id, quantile_cont(NEE, 0.25) a, quantile_cont(NEE, 0.5) b, quantile_cont(NEE, 0.75) c FROM h GROUP BY 1)
, k AS (SELECT site_id, CAST(datetime AS DATE) AS date, CASE WHEN NEE BETWEEN b - 10*(c-a) AND b + 10*(c-a) THEN NEE END AS x FROM h JOIN q USING (site_id))
, s AS (SELECT site_id, date, CASE WHEN count(x) >= 36 THEN sum(x * 1800 * 12e-6) END AS v FROM k GROUP BY 1, 2)
, cal AS (SELECT site_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM s GROUP BY 1)
SELECT site_id, date, {rs('NEE', 'v')} FROM cal LEFT JOIN s USING (site_id, date)""")
def daily_carbon(spark, sf_dir):
    h = quality.smart_range_qc(halfhourly(spark, sf_dir), ["NEE"], SITE).withColumn("NEE", F.col("NEE_SmartY_qc"))
    return report.daily_carbon(h, ["NEE"], 18, SITE).select("site_id", "date", r("NEE"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t, o_orderdate FROM orders)
SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS datetime FROM o""")
def parse_datetime(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", report.parse_datetime(text).alias("datetime"))


@query(f"""SELECT site_id, datetime, {rs('source', 'CASE WHEN NEE >= 0 THEN NEE END')}, {rs('sink', 'CASE WHEN NEE <= 0 THEN NEE END')} FROM h""")
def sign_split(spark, sf_dir):
    source, sink = physics.sign_split(F.col("NEE"))
    return halfhourly(spark, sf_dir).select("site_id", "datetime", r("source", source), r("sink", sink))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders) SELECT make_date(y, 1, 1) AS boundary FROM y WHERE y > (SELECT min(y) FROM y)""")
def year_boundaries(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("datetime"))
    return report.year_boundaries(o)
