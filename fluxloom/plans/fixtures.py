"""The half-hourly flux table derived from ``events``, in Spark and in DuckDB, and tables made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAIL = """
, f AS (SELECT site_id, datetime, n, m, v, k, h,
               greatest(CAST(0 AS DOUBLE), 720 - 20*(h-12)*(h-12)) AS Rg FROM c)
, g AS (SELECT *, 8 + 0.1*k + 0.01*Rg AS Tair, 0.05 + v/500 AS ustar FROM f)
"""
LAST = """SELECT site_id, datetime, n,
       round(Rg, 6) AS Rg, round(0.6*Rg - 40, 6) AS Rn, round(Tair + 1e-9, 6) AS Tair,
       round(greatest(0, 0.8*(Tair - 4)) + 1e-9, 6) AS VPD, round(ustar + 1e-9, 6) AS ustar,
       round(CASE WHEN n = 1 AND floor(v) % 3 = 0 THEN NULL
                  WHEN Rg < 10 THEN (1 + 0.1*(Tair-10)) * least(1, ustar/0.2) + CASE WHEN m % 97 = 0 THEN 15 ELSE 0 END
                  ELSE 1 + 0.1*(Tair-10) - 30*Rg*0.1/(0.1*Rg+30) + 0.02*(k-50) END + 1e-9, 6) AS NEE
FROM g"""
SPARK_HEAD = """WITH c AS (
  SELECT CAST(floor(user_id/40) AS BIGINT) AS site_id, CAST(window.start AS timestamp_ntz) AS datetime,
         max(value) AS v, avg(CAST(get_json_object(props,'$.k') AS double)) AS k, count(*) AS n, max(event_id) AS m,
         CAST(hour(window.start) AS double) + minute(window.start)/60D AS h
  FROM (SELECT *, window(ts, '30 minutes') FROM {events}) GROUP BY CAST(floor(user_id/40) AS BIGINT), window)"""
DUCK_HEAD = """WITH c AS (
  SELECT CAST(floor(user_id/40) AS BIGINT) AS site_id, time_bucket(INTERVAL '30 minutes', ts) AS datetime,
         max(value) AS v, avg(CAST(json_extract_string(props,'$.k') AS DOUBLE)) AS k, count(*) AS n, max(event_id) AS m,
         CAST(hour(time_bucket(INTERVAL '30 minutes', ts)) AS DOUBLE) + minute(time_bucket(INTERVAL '30 minutes', ts))/60.0 AS h
  FROM events GROUP BY 1, 2, h)"""
#: DuckDB text to put before a query over ``h``, the half-hourly table.
DUCK = f"{DUCK_HEAD}{TAIL}, h AS ({LAST})"


def halfhourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value", "props")
    return spark.sql(SPARK_HEAD + TAIL + LAST, events=events)


def slot():
    return F.hour("datetime") * 2 + F.floor(F.minute("datetime") / 30) + F.dayofmonth("datetime") * 48


def era5_like(h: DataFrame) -> DataFrame:
    """A reanalysis table that lacks every 50th slot."""
    ta = F.lit(15.0) + (F.col("Tair") - 15) * 0.9
    return h.where(slot() % 50 != 0).select("site_id", "datetime", F.col("Rn").alias("Fn"), F.col("Rg").alias("Fsd"), (90 - 2 * F.col("VPD")).alias("RH"), F.lit(0.3).alias("Sws"), ta.alias("Ta"), (ta - 1).alias("Ts"), "VPD")


def flux_text(h: DataFrame) -> DataFrame:
    """Logger output as text columns."""
    t = lambda c: c.cast("string")
    flag = (F.col("n") % 3).cast("double")
    return h.select(
        "site_id", F.lit("f").alias("filename"), F.date_format("datetime", "yyyy-MM-dd").alias("date"), F.date_format("datetime", "HH:mm").alias("time"),
        t(F.dayofyear("datetime").cast("double")).alias("DOY"), t(F.coalesce(F.col("NEE") - 0.1, F.lit(-9999.0))).alias("co2_flux"),
        t(F.when(F.col("n") % 5 == 0, -9999.0).otherwise(0.1)).alias("co2_strg"), t(flag).alias("qc_co2_flux"), t(flag).alias("qc_H"), t(flag).alias("qc_LE"),
        t(0.3 * F.col("Rn")).alias("H"), t(0.4 * F.col("Rn")).alias("LE"), t(F.lit(0.01)).alias("ET"), t(F.col("Tair") + 273.15).alias("air_temperature"),
        t(90 - 2 * F.col("VPD")).alias("RH"), t(F.col("VPD")).alias("VPD"), t(F.lit(101325.0)).alias("air_pressure"), t(F.lit(2.5)).alias("wind_speed"),
        t(F.lit(180.0)).alias("wind_dir"), t(F.col("ustar")).alias("u*"),
    )


def biomet_text(h: DataFrame) -> DataFrame:
    t = lambda c: c.cast("string")
    return h.select(
        "site_id", F.date_format("datetime", "yyyy-MM-dd").alias("date"), F.date_format("datetime", "HH:mm").alias("time"),
        t(F.when(F.col("n") % 4 == 0, -9999.0).otherwise(F.col("Tair") + 273.15)).alias("TA_1_1_1"), t(F.col("Tair") + 272.15).alias("TS_1_1_1"),
        t(F.when(F.col("n") % 4 == 1, -9999.0).otherwise(80.0)).alias("RH_1_1_1"), t(F.col("Rg")).alias("SWIN_1_1_1"), t(F.lit(300.0)).alias("LWIN_1_1_1"),
        t(0.2 * F.col("Rg")).alias("SWOUT_1_1_1"), t(F.lit(340.0)).alias("LWOUT_1_1_1"), t(F.lit(0.3)).alias("SWC_1_1_1"), t(2 * F.col("Rg")).alias("PPFD_1_1_1"),
        t(F.lit(0.0)).alias("P_RAIN_1_1_1"), t(F.lit(-9999.0)).alias("SHF_1_1_1"),
    )


def write_logger(rows: DataFrame, folder: str, group_line: bool) -> str:
    """Text ``rows`` of a logger as CSV files, one folder of them for each site: a group line (or none), names, units, data."""
    names = [c for c in rows.columns if c != "site_id"]
    heads = [*([",".join(["file", *["data"] * (len(names) - 1)])] if group_line else []), ",".join(names), ",".join(f"[{k}]" for k in range(len(names)))]
    top = rows.select("site_id").distinct().select("site_id", F.posexplode(F.array(*map(F.lit, heads))).alias("at", "line")).select("site_id", F.lit("").alias("day"), "at", "line")
    line = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names])
    body = rows.select("site_id", F.concat("date", "time").alias("day"), F.lit(0).alias("at"), line.alias("line"))
    top.union(body).repartition("site_id").sortWithinPartitions("site_id", "day", "at").select("site_id", "line").write.partitionBy("site_id").text(folder)
    return folder
