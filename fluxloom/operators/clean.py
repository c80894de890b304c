"""Load: sentinels, quality flags, derived columns, canonical names, and the joins that build a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -9999.0
KEEP_TEXT = ("datetime", "date", "time", "filename", "site_id")
# Column names of the loggers' files and of the datasets that are exchanged.
LOADED = ["datetime", "DOY", "Tair", "Tsoil", "SWC_1_1_1", "SWIN_1_1_1", "PPFD_1_1_1", "RH_1_1_1", "air_pressure", "wind_speed", "wind_dir", "VPD", "Rn", "H", "LE", "NEE", "P_RAIN_1_1_1", "SHF_1_1_1", "u*"]
LOADED_NO_BIOMET = ["datetime", "DOY", "Tair", "air_pressure", "wind_speed", "wind_dir", "RH", "VPD", "H", "LE", "ET", "NEE", "u*"]
RAW_NAMES = {"SWC_1_1_1": "SWC", "SWIN_1_1_1": "SWIN", "PPFD_1_1_1": "PPFD", "RH_1_1_1": "RH", "SHF_1_1_1": "SHF", "P_RAIN_1_1_1": "pr", "air_pressure": "PA", "wind_speed": "WS", "wind_dir": "WD"}
ERA5_NAMES = {"Fn": "Rn_era5", "Fsd": "SWIN_era5", "RH": "RH_era5", "Sws": "SWC_era5", "Ta": "Tair_era5", "Ts": "Tsoil_era5", "VPD": "VPD_era5"}
CANONICAL = ["datetime", "DOY", "Tair", "Tsoil", "SWC", "SWIN", "PPFD", "RH", "ET", "VPD", "Rn", "Rg", "pr", "PA", "WS", "WD", "H", "LE", "NEE", "SHF", "u*", "Tair_era5", "Tsoil_era5", "SWC_era5", "SWIN_era5", "RH_era5", "VPD_era5", "Rn_era5", "pr_era5"]
CANONICAL_ERA5 = [c for c in CANONICAL if c.endswith("_era5")]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same name in which null keys meet, with the columns of ``left`` and the new ones of ``right``.

    Without keys ``right`` is one row for the whole table.
    """
    if not keys:
        return left.join(F.broadcast(right.limit(1)), F.lit(True), how)
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [left[f"`{k}`"].eqNullSafe(named[f"`__right_{k}`"]) for k in keys]
    return left.join(named, on, how).drop(*[f"__right_{k}" for k in keys])


def with_datetime(df: DataFrame) -> DataFrame:
    """date and time text joined to a wall-clock timestamp; null where it doesn't parse."""
    return df.withColumn("datetime", F.try_to_timestamp(F.concat_ws(" ", "date", "time")).cast("timestamp_ntz"))


def cast_measurements(df: DataFrame, keep: tuple[str, ...] = KEEP_TEXT) -> DataFrame:
    """All other columns as doubles; text that is no number, and NaN, is null."""
    def number(c: str) -> Column:
        d = col(c).try_cast("double")
        return F.when(~F.isnan(d), d).alias(c)

    return df.select([col(c) if c in keep else number(c) for c in df.columns])


def coalesce_sensor(primary: Column, backup: Column) -> Column:
    """The backup where the primary is the sentinel; a null primary stays null."""
    return F.when(primary == MISSING, backup).otherwise(primary)


def net_ecosystem_exchange(flux: Column, storage: Column, flag: Column) -> Column:
    bad = (flux == MISSING) | (storage == MISSING) | (flag == MISSING)
    return F.when(F.coalesce(bad, F.lit(False)), None).otherwise(flux + storage)


def net_radiation(sw_in: Column, lw_in: Column, sw_out: Column, lw_out: Column) -> Column:
    bad = (sw_in == MISSING) | (lw_in == MISSING) | (sw_out == MISSING) | (lw_out == MISSING)
    return F.when(F.coalesce(bad, F.lit(False)), None).otherwise(sw_in + lw_in - sw_out - lw_out)


def kelvin_to_celsius(c: Column) -> Column:
    return F.when(c == MISSING, None).otherwise(c - 273.15)


def drop_bad_quality(value: Column, flag: Column) -> Column:
    """Null where the flag is 2; a null flag keeps the value."""
    return F.when(flag == 2, None).otherwise(value)


def sentinel_to_null(df: DataFrame, sentinel: float = MISSING) -> DataFrame:
    numbers = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint")}
    return df.select([F.nullif(col(c), F.lit(sentinel)).alias(c) if c in numbers else col(c) for c in df.columns])


def join_biomet(flux: DataFrame, biomet: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Flux rows with the biomet row of the same time; columns in both come from the flux side."""
    on = [*keys, "datetime"]
    fresh = [c for c in biomet.columns if c in on or c not in flux.columns]
    return flux.join(biomet.select([col(c) for c in fresh]), on, "left")


def load_flux(flux: DataFrame, biomet: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Text tables of both loggers to the loaded table: cast, pair, derive, drop bad quality, clear sentinels.

    RH is backed up by the flux logger's, so that table's own RH and biomet's RH_1_1_1 both enter.
    """
    both = join_biomet(cast_measurements(with_datetime(flux)), cast_measurements(with_datetime(biomet)), keys)
    ta = coalesce_sensor(col("TA_1_1_1"), col("air_temperature"))
    nee = net_ecosystem_exchange(col("co2_flux"), col("co2_strg"), col("qc_co2_flux"))
    made = both.withColumns({
        "RH_1_1_1": coalesce_sensor(col("RH_1_1_1"), col("RH")),
        "Tair": kelvin_to_celsius(ta),
        "Tsoil": kelvin_to_celsius(col("TS_1_1_1")),
        "Rn": net_radiation(col("SWIN_1_1_1"), col("LWIN_1_1_1"), col("SWOUT_1_1_1"), col("LWOUT_1_1_1")),
        "NEE": drop_bad_quality(nee, col("qc_co2_flux")),
        "H": drop_bad_quality(col("H"), col("qc_H")),
        "LE": drop_bad_quality(col("LE"), col("qc_LE")),
    })
    return sentinel_to_null(made.select([col(c) for c in [*keys, *LOADED]]))


def load_flux_nobiomet(flux: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    one = cast_measurements(with_datetime(flux))
    nee = net_ecosystem_exchange(col("co2_flux"), col("co2_strg"), col("qc_co2_flux"))
    made = one.withColumns({
        "Tair": kelvin_to_celsius(col("air_temperature")),
        "NEE": drop_bad_quality(nee, col("qc_co2_flux")),
        "H": drop_bad_quality(col("H"), col("qc_H")),
        "LE": drop_bad_quality(col("LE"), col("qc_LE")),
    })
    return sentinel_to_null(made.select([col(c) for c in [*keys, *LOADED_NO_BIOMET]]))


def canonical_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in RAW_NAMES.items() if k in df.columns and v not in df.columns})


def era5_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in ERA5_NAMES.items() if k in df.columns})


def project_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([col(c) for c in names if c in df.columns])


def build_dataset(raw: DataFrame, era5: DataFrame | None = None, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """Canonical columns of the raw table, joined with reanalysis on keys and datetime; columns in both come from raw.

    Without a reanalysis table, reanalysis columns that the raw table has already are kept.
    """
    left = canonical_names(raw)
    if era5 is None:
        return project_existing(left, [*keys, *CANONICAL])
    on, right = [*keys, "datetime"], era5_names(era5)
    fresh = [c for c in right.columns if c in on or c not in left.columns]
    return project_existing(left.join(right.select([col(c) for c in fresh]), on, "inner"), [*keys, *CANONICAL])
