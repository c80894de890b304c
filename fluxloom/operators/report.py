"""Tables for reports: fingerprint, diurnal cycle, daily carbon, dates, years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import col, keyed_join

#: Grams of carbon per square metre in a half hour of one micromole of CO2 per square metre and second.
CARBON = 1800 * 12e-6


def fingerprint(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each column by date and time of day, in long form."""
    return df.groupBy(*keys, F.to_date("datetime").alias("date"), F.date_format("datetime", "HH:mm").alias("time")).agg(*[F.avg(col(c)).alias(c) for c in cols])


def fingerprint_matrix(df: DataFrame, name: str, dates: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A row for each time of day, a column for each of the given dates."""
    return fingerprint(df, [name], keys).withColumn("date", F.date_format("date", "yyyy-MM-dd")).groupBy(*keys, "time").pivot("date", list(dates)).agg(F.first(col(name)))


def diurnal_cycle(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation and error bar (0.3 deviations) of each column by hour of day."""
    made = []
    for c in cols:
        made += [F.avg(col(c)).alias(f"{c}_mean"), F.stddev_samp(col(c)).alias(f"{c}_std"), (0.3 * F.stddev_samp(col(c))).alias(f"{c}_err")]
    return df.groupBy(*keys, F.hour("datetime").alias("hour")).agg(*made)


def daily_carbon(df: DataFrame, cols: Sequence[str] = ("GPP", "NEE", "RECO"), min_valid_hours: float = 18, keys: Sequence[str] = (), date: Column | None = None) -> DataFrame:
    """Daily sums in grams of carbon, for every day from a series' first to its last.

    A day's sum is null with fewer than two values for each valid hour; with none asked for, an empty day is 0.
    """
    day = F.to_date("datetime") if date is None else date
    made = []
    for c in cols:
        total = F.coalesce(F.sum(col(c) * CARBON), F.lit(0.0))
        made.append(F.when(F.count(col(c)) >= 2 * min_valid_hours, total).alias(c))
    sums = df.withColumn("date", day).where("date is not null").groupBy(*keys, "date").agg(*made)
    calendar = sums.groupBy(*keys).agg(F.min("date").alias("__a"), F.max("date").alias("__b")).select(*keys, F.explode(F.sequence("__a", "__b")).alias("date"))
    out = keyed_join(calendar, sums, [*keys, "date"], "left")
    return out.fillna(0.0, subset=list(cols)) if min_valid_hours == 0 else out


def parse_datetime(c: Column, fmt: str = "yyyyMMdd") -> Column:
    """By the given format, else by automatic parsing; null where neither does."""
    return F.coalesce(F.try_to_timestamp(c, F.lit(fmt)), F.try_to_timestamp(c)).cast("timestamp_ntz")


def year_boundaries(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1 January of each year after a series' first one."""
    years = df.select(*keys, F.year("datetime").alias("year")).where("year is not null").distinct()
    first = years.groupBy(*keys).agg(F.min("year").alias("__first"))
    later = keyed_join(years, first, keys).where("year > __first")
    return later.select(*keys, F.make_date("year", F.lit(1), F.lit(1)).alias("boundary"))
