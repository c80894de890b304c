"""Row positions, overlapping windows by arithmetic, and interpolation between anchors.

``whole_series=True`` takes each series as one task, which suits keyed series of up to some million rows and costs
one exchange; ``False`` cuts series into chunks (see ``scan``), whatever their length. The default is True with keys
and False without, as a table without keys is one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .clean import col, keyed_join

#: Rows of a chunk where rows have positions.
CHUNK_ROWS = 1 << 16


def entire(keys: Sequence[str], whole_series: bool | None) -> bool:
    if whole_series and not keys:
        raise ValueError("a table without keys is cut into chunks")
    return bool(keys) if whole_series is None else whole_series


def seconds(name: str) -> Column:
    return F.unix_timestamp(col(name).cast("timestamp"))


def positions(df: DataFrame, keys: Sequence[str] = (), whole_series: bool | None = None) -> DataFrame:
    """__pos: a row's place in its series by datetime, from 0; rows without a datetime come first.

    In chunks, the rows of each day are numbered apart, each after the rows of earlier days.
    """
    if entire(keys, whole_series):
        return df.withColumn("__pos", (F.row_number().over(Window.partitionBy(*keys).orderBy("datetime")) - 1).cast("long"))
    dated = df.withColumn("__day", F.to_date("datetime"))
    earlier = scan.of(keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # one short row for each day
    days = dated.groupBy(*keys, "__day").agg(F.count("*").alias("__rows")).select(*keys, "__day", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy(*keys, "__day").orderBy("datetime")) - 1
    placed = keyed_join(dated.withColumn("__place", place), days, [*keys, "__day"])
    return placed.withColumn("__pos", (F.col("__first") + F.col("__place")).cast("long")).drop("__day", "__first", "__place")


def row_windows(df: DataFrame, window_rows: int, shift_rows: int, keys: Sequence[str] = (), whole_series: bool | None = None) -> DataFrame:
    """Each row once for each window that holds it, with window (number), pos and start.

    Windows start at 0, S, 2S ... below N - W and hold W rows; a series of W rows or fewer has none.
    """
    placed = positions(df, keys, whole_series)
    if entire(keys, whole_series):
        n = placed.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    else:
        n = keyed_join(placed, df.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    lo = F.greatest(F.lit(0), F.floor((F.col("__pos") - window_rows) / shift_rows) + 1)
    hi = F.least(F.floor(F.col("__pos") / shift_rows), F.ceil((F.col("__n") - window_rows) / shift_rows) - 1)
    listed = n.withColumn("window", F.explode(F.when(hi >= lo, F.sequence(lo, hi))))
    return listed.withColumn("start", F.col("window") * shift_rows).withColumnRenamed("__pos", "pos").drop("__n")


def centred(df: DataFrame, window_days: int, step_days: int, keys: Sequence[str] = (), whole_series: bool | None = None) -> tuple[DataFrame, Column, Column]:
    """``df`` with seconds __t, and those of its series' first and last row, __t0 and __t1; and the first and last window that hold a row."""
    half, step = window_days // 2 * 86400, step_days * 86400
    timed = df.withColumn("__t", seconds("datetime"))
    if entire(keys, whole_series):
        one = Window.partitionBy(*keys)
        t = timed.withColumn("__t0", F.min("__t").over(one)).withColumn("__t1", F.max("__t").over(one))
    else:
        t = keyed_join(timed, df.groupBy(*keys).agg(F.min(seconds("datetime")).alias("__t0"), F.max(seconds("datetime")).alias("__t1")), keys)
    lo = F.greatest(F.lit(0), F.ceil((F.col("__t") - half - F.col("__t0")) / step))
    hi = F.least(F.floor((F.col("__t") + half - F.col("__t0")) / step), F.floor((F.col("__t1") - F.col("__t0")) / step))
    return t, lo, hi


def centre_of(window: Column, first: Column, step_days: int) -> Column:
    return F.timestamp_seconds(first + window * (step_days * 86400)).cast("timestamp_ntz")


def time_windows(df: DataFrame, window_days: int = 15, step_days: int = 2, keys: Sequence[str] = (), whole_series: bool | None = None) -> DataFrame:
    """Each row once for each centre within window_days // 2 days of it, both ends included; columns window and centre."""
    t, lo, hi = centred(df, window_days, step_days, keys, whole_series)
    listed = t.withColumn("window", F.explode(F.when(hi >= lo, F.sequence(lo, hi))))
    return listed.withColumn("centre", centre_of(F.col("window"), F.col("__t0"), step_days)).drop("__t", "__t0", "__t1")


def interpolate_by_position(df: DataFrame, value: str, keys: Sequence[str] = (), pos: str = "__pos", into: str | None = None, whole_series: bool | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Linear between the non-null anchors around a row; constant before the first and after the last."""
    anchor = F.when(col(value).isNotNull(), F.struct(F.col(pos).alias("p"), col(value).alias("v")))
    if entire(keys, whole_series):
        grown = Window.unboundedPreceding, 0
        order, back = Window.partitionBy(*keys).orderBy(pos), Window.partitionBy(*keys).orderBy(F.col(pos).desc())
        # the next anchor is the last one seen from the end: a frame that grows is one pass, one that shrinks is not
        two = df.withColumn("__a", F.last(anchor, ignorenulls=True).over(order.rowsBetween(*grown))).withColumn("__b", F.last(anchor, ignorenulls=True).over(back.rowsBetween(*grown)))
    else:
        two = scan.neighbours(df, anchor, [pos], F.floor(F.col(pos) / chunk_rows).cast("long"), keys, "__a", "__b")
    a, b = F.col("__a"), F.col("__b")
    inner = F.when(b["p"] == a["p"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(pos) - a["p"]) / (b["p"] - a["p"]))
    found = F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inner)
    return two.withColumn(into or value, found).drop("__a", "__b")


def interpolate_by_time(df: DataFrame, anchors: DataFrame, values: Sequence[str], keys: Sequence[str] = (), at: str = "centre", required: Sequence[str] | None = None, whole_series: bool | None = None) -> DataFrame:
    """``values`` of the anchors, linear in time on the rows of ``df``, extended along the outer segments.

    Anchors with a null in ``required`` (all values, if not given) or without a time are left out. A lone anchor is a constant.
    A row before the first anchor lies on the line of the first two, one from the last anchor on on that of the last two.
    """
    whole = anchors.dropna(subset=[*(values if required is None else required), at]).withColumn("__t", seconds(at).cast("double"))
    one = F.struct(F.col("__t").alias("t"), *[col(v).alias(v) for v in values])
    points = whole.select(*[col(k) for k in keys], "__t", one.alias("__one"))
    rows = df.withColumn("__t", seconds("datetime").cast("double")).withColumn("__row", F.lit(1))
    both = points.withColumn("__row", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    order = ["__t", "__row"]
    if entire(keys, whole_series):
        grown = Window.unboundedPreceding, 0
        there, back = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        met = both.withColumn("__a", F.last("__one", ignorenulls=True).over(there.rowsBetween(*grown))).withColumn("__b", F.last("__one", ignorenulls=True).over(back.rowsBetween(*grown)))
    else:
        met = scan.neighbours(both, F.col("__one"), order, scan.day_of(F.col("__t")), keys, "__a", "__b")
    ends = points.groupBy(*keys).agg(F.min_by("__one", "__t").alias("__first"), F.max_by("__one", "__t").alias("__last"))
    inner = keyed_join(points, ends, keys)
    seconds_in = inner.groupBy(*keys).agg(
        F.first("__first").alias("__first"), F.first("__last").alias("__last"),
        F.min_by("__one", F.when(F.col("__t") > F.col("__first.t"), F.col("__t"))).alias("__second"),
        F.max_by("__one", F.when(F.col("__t") < F.col("__last.t"), F.col("__t"))).alias("__late"),
    )
    found = keyed_join(met.where("__row = 1").drop("__one"), seconds_in, keys, "left")
    ahead = F.when(F.col("__a").isNull(), F.col("__first")).when(F.col("__b").isNull(), F.coalesce("__late", "__last")).otherwise(F.col("__a"))
    behind = F.when(F.col("__a").isNull(), F.coalesce("__second", "__first")).when(F.col("__b").isNull(), F.col("__last")).otherwise(F.col("__b"))
    found = found.withColumns({"__a": ahead, "__b": behind})
    a, b = F.col("__a"), F.col("__b")
    share = F.when(b["t"] == a["t"], F.lit(0.0)).otherwise((F.col("__t") - a["t"]) / (b["t"] - a["t"]))
    made = found.withColumns({f"__new_{v}": a[v] + (b[v] - a[v]) * share for v in values})
    return made.select(*[col(f"__new_{c}").alias(c) if c in values else col(c) for c in df.columns], *[col(f"__new_{v}").alias(v) for v in values if v not in df.columns])
