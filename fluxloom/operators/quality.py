"""Quality control: robust and manual ranges, dependencies, date ranges, despiking, summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import is_day, is_night
from . import scan
from .clean import col, keyed_join
from .quantiles import selected_quantiles
from .windows import positions

#: Date ranges that are written into a condition; more of them are a table.
MOST_LITERALS = 20
#: Rows of a despiking task, besides the half windows copied from its neighbours.
CHUNK_ROWS = 20_000


def numeric(df: DataFrame, cols: Sequence[str]) -> list[str]:
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return [c for c in cols if kinds[c] in ("double", "float", "integer", "long", "short", "decimal")]


def with_statistics(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of statistics for each series, joined back (a table of one row without keys)."""
    return keyed_join(df, stats, keys, "left")


def quartiles(c: Column, accuracy: int | None = None) -> Column:
    """Exact quartiles, which hold a count of each value of a group, or with ``accuracy`` approximate ones in bounded memory."""
    shares = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return F.percentile(c, shares) if accuracy is None else F.percentile_approx(c, shares, accuracy)


def quartile_table(df: DataFrame, cols: Sequence[str], keys: Sequence[str], accuracy: int | None, bounded: bool) -> DataFrame:
    """(keys, __<column> ...): the three quartiles of each column of each series."""
    if not bounded:
        return df.groupBy(*keys).agg(*[quartiles(col(c), accuracy).alias(f"__{c}") for c in cols])
    long = selected_quantiles(df, cols, (0.25, 0.5, 0.75), keys)
    return long.groupBy(*keys).agg(*[F.first(F.when(F.col("variable") == c, F.col("quantiles")), ignorenulls=True).alias(f"__{c}") for c in cols])


def smart_range_qc(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), k: float = 10.0, accuracy: int | None = None, bounded: bool = False) -> DataFrame:
    """Values outside median +- k IQR become null in <col>_SmartY_qc. One aggregate serves all columns.

    For very long series: ``accuracy`` asks for approximate quartiles, ``bounded`` for exact ones in bounded memory (``selected_quantiles``).
    """
    cols = numeric(df, cols)
    out = with_statistics(df, quartile_table(df, cols, keys, accuracy, bounded), keys)
    for c in cols:
        q = col(f"__{c}")
        spread = k * (q[2] - q[0])
        out = out.withColumn(f"{c}_SmartY_qc", F.when(col(c).between(q[1] - spread, q[1] + spread), col(c)))
    return out.drop(*[f"__{c}" for c in cols])


def range_qc(df: DataFrame, cols: Sequence[str], lower: Sequence[float], upper: Sequence[float]) -> DataFrame:
    if not len(cols) == len(lower) == len(upper):
        raise ValueError("one lower and one upper bound for each column")
    return df.withColumns({f"{c}_MaxMinValue_qc": F.when(col(c).between(lo, hi), col(c)) for c, lo, hi in zip(cols, lower, upper, strict=True)})


def range_reference_stats(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), accuracy: int | None = None, bounded: bool = False) -> DataFrame:
    """(keys, variable, median, q25, q75, min, max): what a person looks at before choosing bounds.

    ``accuracy`` and ``bounded`` are those of ``smart_range_qc``; the minimum and the maximum are the quantiles at 0 and 1.
    """
    cols = numeric(df, cols)
    if bounded:
        long = selected_quantiles(df, cols, (0.5, 0.25, 0.75, 0.0, 1.0), keys)
        return long.select(*keys, "variable", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("median", "q25", "q75", "min", "max"))])
    one = df.groupBy(*keys).agg(*[F.struct(quartiles(col(c), accuracy).alias("q"), F.min(col(c)).alias("min"), F.max(col(c)).alias("max")).alias(f"__{c}") for c in cols])
    each = one.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), col(f"__{c}").alias("s")) for c in cols])).alias("e"))
    return each.select(*keys, "e.variable", F.col("e.s.q")[1].alias("median"), F.col("e.s.q")[0].alias("q25"), F.col("e.s.q")[2].alias("q75"), F.col("e.s.min").alias("min"), F.col("e.s.max").alias("max"))


def dependency_qc(df: DataFrame, target: str, deps: Sequence[str], lower: Sequence[float], upper: Sequence[float], compat: bool = False, keys: Sequence[str] = (), unique_times: bool = True) -> DataFrame:
    """Keep ``target`` where each dependency lies in its bounds; a null dependency fails.

    ``compat`` tests only the last dependency, against the first bounds. With ``unique_times`` false
    a value stays if any row of the same time passes.
    """
    if compat:
        deps, lower, upper = deps[-1:], lower[:1], upper[:1]
    ok = F.lit(True)
    for d, lo, hi in zip(deps, lower, upper, strict=True):
        ok = ok & F.coalesce(col(d).between(lo, hi), F.lit(False))
    if not unique_times:
        ok = F.max(ok).over(Window.partitionBy(*keys, "datetime"))
    return df.withColumn(f"{target}_Dependency_qc", F.when(ok, col(target)))


def in_ranges(df: DataFrame, ranges: DataFrame, keys: Sequence[str] = (), into: str = "in_range") -> DataFrame:
    """``into``: whether a row's datetime lies in any of the inclusive ``ranges`` (keys, start, end), of which there may be any number.

    A sweep: ranges and rows in one order of time, where a row is inside if the latest end of all ranges that have
    begun is not before it. So a range is one row, long or short, overlapping or not, and no row meets more than one. Days
    are the tasks; a day starts with the latest end of the days before it. Ranges without a start or an end, or that end
    before they start, hold nothing; a row without a datetime is in no range.
    """
    clean_ranges = ranges.select(*[col(k) for k in keys], F.col("start").cast("timestamp_ntz").alias("__at"), F.col("end").cast("timestamp_ntz").alias("__until")).where("__at <= __until")
    rows = df.withColumn("__at", F.col("datetime")).withColumn("__row", F.lit(1))
    both = clean_ranges.withColumn("__row", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    swept = scan.running_max(both, F.col("__until"), ["__at", "__row"], F.to_date("__at"), keys, "__latest").where("__row = 1")
    hit = F.coalesce(F.col("__latest") >= F.col("__at"), F.lit(False))
    return swept.select(*[col(c) for c in df.columns if c != into], hit.alias(into))


def datetime_qc(df: DataFrame, target: str, ranges: Sequence[tuple[str, str]] | DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Values inside any inclusive range become null in <target>_Datetime_qc; ranges that don't parse are left out.

    ``ranges`` is a list of texts, for all series, or a table (keys, start, end). A few of a list are a condition, more of
    them and any table a sweep (``in_ranges``).
    """
    name = f"{target}_Datetime_qc"
    if isinstance(ranges, DataFrame):
        return in_ranges(df, ranges, keys, "__hit").withColumn(name, F.when(~F.col("__hit"), col(target))).drop("__hit")
    good = []
    for a, b in ranges:
        a, b = pd.to_datetime(a, errors="coerce"), pd.to_datetime(b, errors="coerce")
        if not (pd.isna(a) or pd.isna(b)):
            good.append((a.to_pydatetime(), b.to_pydatetime()))
    if not good:
        raise ValueError("no valid date range")
    if len(good) > MOST_LITERALS:
        listed = df.sparkSession.createDataFrame(good, "start timestamp_ntz, end timestamp_ntz")
        return datetime_qc(df, target, listed)
    stamp = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    hit = F.lit(False)
    for a, b in good:
        hit = hit | F.col("datetime").between(stamp(a), stamp(b))
    return df.withColumn(name, F.when(~F.coalesce(hit, F.lit(False)), col(target)))


def spikes(values: np.ndarray, night: np.ndarray, start: np.ndarray, half: int, k: float, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is a spike, and the median of its window.

    ``start``: row positions, ascending. A window holds the values of the same class within ``half`` rows.
    """
    flag, median = np.zeros(len(values), bool), np.full(len(values), np.nan)
    for kind in (False, True):
        rows = np.flatnonzero((night == kind) & ~np.isnan(values))
        if not len(rows):
            continue
        x, p = values[rows], start[rows]
        lo, hi = np.searchsorted(p, p - half), np.searchsorted(p, p + half, side="right")
        for a in range(0, len(rows), 1024):
            b = slice(a, a + 1024)
            n = hi[b] - lo[b]
            at = lo[b][:, None] + np.arange(n.max())
            inside = np.arange(n.max()) < n[:, None]
            grid = np.where(inside, x[np.minimum(at, len(x) - 1)], np.inf)
            m = middle(np.sort(grid, axis=1), n)
            mad = middle(np.sort(np.where(inside, np.abs(grid - m[:, None]), np.inf), axis=1), n)
            median[rows[b]] = m
            # a value just k MAD away is none, whatever the last bits of its binary form
            flag[rows[b]] = (n > fewest) & (np.round(np.abs(x[b] - m) - k * mad, 9) > 0)
    return flag, median


def middle(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    r = np.arange(len(ordered))
    return (ordered[r, (n - 1) // 2] + ordered[r, n // 2]) / 2


def despike(df: DataFrame, target: str, rg: str = "Rg", window: int = 480, k: float = 3.0, period: str = "both", replace_with_median: bool = False, keys: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """<target>_despiked: values further than k MAD from the median of their window become null, or the median.

    A window is the rows within window // 2 of a row, of its own day or night class, without nulls;
    windows of window // 8 values or fewer flag nothing. A null radiation counts as night and is
    treated in every ``period``. A long series is cut in chunks with half a window copied from each side.
    Only keys, positions, values and radiation go through the chunks; the result joins the rows by position.
    """
    if period not in ("both", "day", "night"):
        raise ValueError(f"period must be both, day or night, not {period!r}")
    half, fewest = window // 2, window // 8
    numbered = positions(df, keys).withColumn("__night", ~F.coalesce(is_day(col(rg)), F.lit(False)))
    narrow = numbered.select(*[col(k) for k in keys], "__pos", "__night", col(target).cast("double").alias("__x"), col(rg).cast("double").alias("__rg"))
    spread = narrow.withColumn("__chunk", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("__pos") - half) / chunk_rows)), F.floor((F.col("__pos") + half) / chunk_rows))))
    name = f"{target}_despiked"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "__pos long", f"`{name}` double"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__pos")
        chunk = rows["__chunk"].iloc[0]
        x = rows["__x"].to_numpy(float, na_value=np.nan)
        night, p = rows["__night"].to_numpy(bool), rows["__pos"].to_numpy()
        flag, median = spikes(x, night, p, half, k, fewest)
        radiation = rows["__rg"].to_numpy(float, na_value=np.nan)
        use = {"both": np.ones(len(x), bool), "day": radiation >= 10, "night": radiation < 10}[period] | np.isnan(radiation)
        out = np.where(flag & use, median if replace_with_median else np.nan, x)
        rows[name] = pd.Series(out, index=rows.index).astype(object).where(~np.isnan(out), None)
        return rows[p // chunk_rows == chunk][[*keys, "__pos", name]]

    done = spread.groupBy(*keys, "__chunk").applyInPandas(run, schema)
    return keyed_join(numbered, done, [*keys, "__pos"], "left").drop("__pos", "__night")


def qc_summary(df: DataFrame, target: str, qc_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Percent of rows kept, removed and missing, and the bounds of kept values."""
    a, b = col(target), col(qc_col)
    share = lambda c: F.count(F.when(c, 1)) / F.count("*") * 100
    return df.groupBy(*keys).agg(
        share(a.isNotNull() & b.isNotNull()).alias("kept_pct"), share(a.isNotNull() & b.isNull()).alias("removed_pct"),
        share(a.isNull()).alias("missing_pct"), F.min(b).alias("min_kept"), F.max(b).alias("max_kept"),
    )


def night(df: DataFrame, rg: str = "Rg") -> DataFrame:
    return df.where(is_night(col(rg)))


def day(df: DataFrame, rg: str = "Rg") -> DataFrame:
    return df.where(is_day(col(rg)))


def between_times(df: DataFrame, start: str | Column | None = None, end: str | Column | None = None) -> DataFrame:
    """Rows within the bounds, both inclusive and optional."""
    stamp = lambda t: F.lit(t).cast("timestamp_ntz") if isinstance(t, str) else t
    df = df.where(F.col("datetime") >= stamp(start)) if start is not None else df
    return df.where(F.col("datetime") <= stamp(end)) if end is not None else df
