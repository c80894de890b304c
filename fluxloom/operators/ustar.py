"""Friction-velocity threshold: moving-point test and its bootstrap.

All steps group by (keys..., replicate, season, temperature group), so every replicate and season
of every site is one job. Replicates carry weights of rows, not copies of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import is_night
from ..session import shared_dir, stored
from .clean import col, keyed_join
from .quality import between_times
from .windows import positions

FALLBACK = {"forest": 0.1}
OTHER_FALLBACK = 0.01
TOLERANCES = (0.99, 0.90)
#: Replicates of a series that a task makes together, and rows of replicates that a task holds, about.
REPS_AT_ONCE, ROWS_AT_ONCE = 10, 500_000


def quantile_edges(df: DataFrame, name: str, q: int, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, edges): linear quantiles at i / q of the non-null values."""
    shares = F.array(*[F.lit(i / q) for i in range(q + 1)])
    x = col(name)
    edges = F.percentile(x, shares, F.when(x.isNotNull(), F.col(weight)).otherwise(0)) if weight else F.percentile(x, shares)
    return df.groupBy(*keys).agg(edges.alias("edges"))


def quantile_bin(df: DataFrame, name: str, q: int, keys: Sequence[str] = (), into: str = "bin", weight: str | None = None, keep_edges: str | None = None) -> DataFrame:
    """Equal-frequency bins 0 .. q-1: ties stay together, bins are closed on the right, null values have none.

    Groups whose edges repeat have no bins. Edges are rounded to nine decimals before a comparison.
    """
    edges = quantile_edges(df, name, q, keys, weight)
    inner = F.when(F.size(F.array_distinct("edges")) == q + 1, F.transform(F.slice("edges", 2, q - 1), lambda e: F.round(e, 9)))
    joined = keyed_join(df, edges.withColumn("__inner", inner), keys, "left")
    # the number of edges below a value: a plain sum over columns, which compiles, and no walk over an array
    number = sum((F.when(col(name) > F.col("__inner")[k], 1).otherwise(0) for k in range(q - 1)), F.lit(0))
    out = joined.withColumn(into, F.when(col(name).isNotNull() & F.col("__inner").isNotNull(), number)).drop("__inner")
    return out.withColumnRenamed("edges", keep_edges) if keep_edges else out.drop("edges")


def correlation_gate(df: DataFrame, tair: str, ustar: str, keys: Sequence[str], limit: float = 0.4, weight: str | None = None) -> DataFrame:
    """(keys, r, accepted): groups with |r| of temperature and u* below the limit, or undefined, pass."""
    both = df.where(col(tair).isNotNull() & col(ustar).isNotNull())
    # not corr(), which divides by zero where a group's temperature or u* is constant
    w, x, y = F.col(weight) if weight else F.lit(1), col(tair), col(ustar)
    means = both.groupBy(*keys).agg((F.sum(w * x) / F.sum(w)).alias("__mx"), (F.sum(w * y) / F.sum(w)).alias("__my"))
    dx, dy = x - F.col("__mx"), y - F.col("__my")
    sums = keyed_join(both, means, keys).groupBy(*keys).agg(F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    r = sums.select(*keys, F.when(F.col("xx") * F.col("yy") > 0, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))
    groups = df.select(*keys).distinct()
    return keyed_join(groups, r, keys, "left").withColumn("accepted", F.coalesce(F.abs("r") < limit, F.lit(True)))


def rounded_edges(df: DataFrame, name: str, into: str) -> DataFrame:
    """Edges as interval labels show them: rounded to the fewest decimals (3 or more) that keep them apart.

    Digits count from the first significant one below 1; the first edge is lowered by one unit.
    """
    edges = F.transform(name, lambda e: F.round(e, 12))

    def at(digits: Column) -> Column:
        def one(e: Column) -> Column:
            d = F.when((F.abs(e) >= 1) | (e == 0), digits).otherwise(-F.floor(F.log10(F.abs(e))) - 1 + digits)
            return F.bround(e * F.pow(F.lit(10.0), d)) / F.pow(F.lit(10.0), d)

        return F.transform(edges, one)

    apart = lambda p: F.size(F.array_distinct(at(p))) == F.size(edges)
    more = F.try_element_at(F.filter(F.sequence(F.lit(4), F.lit(19)), apart), F.lit(1))
    digits = F.when(apart(F.lit(3)), F.lit(3)).otherwise(F.coalesce(more, F.lit(3)))  # more digits are tried only where three don't do
    p = F.col("__digits")
    shown = F.transform(at(p), lambda e, i: F.when(i == 0, e - F.pow(F.lit(10.0), -p)).otherwise(e))
    return df.withColumn("__digits", digits).withColumn(into, shown).drop("__digits")


def binned_stats(df: DataFrame, edges: DataFrame, ustar: str, nee: str, keys: Sequence[str], bins: int, weight: str | None, label_rounding: bool) -> DataFrame:
    """``ustar_bin_stats`` by given ``edges`` (keys, edges): rows meet them once, and a group's bins come together in one short row."""
    w = F.col(weight) if weight else F.lit(1)
    # at twelve decimals: interpolation between equal values may differ in the last bits
    whole = edges.where(F.size(F.array_distinct(F.transform("edges", lambda e: F.round(e, 12)))) == bins + 1).select(*[col(k) for k in keys], F.col("edges").alias("__edges"))
    joined = keyed_join(df, whole, keys)
    number = sum((F.when(col(ustar) > F.round(F.col("__edges")[k], 9), 1).otherwise(0) for k in range(1, bins)), F.lit(0))
    got = F.when(col(nee).isNotNull(), w)
    each = joined.where(col(ustar).isNotNull()).groupBy(*keys, number.alias("bin")).agg((F.sum(got * col(nee)) / F.sum(got)).alias("mean_nee"), F.sum(w).alias("n"), F.first("__edges").alias("__edges"))
    return labelled_bins(each, keys, bins, label_rounding)


def labelled_bins(each: DataFrame, keys: Sequence[str], bins: int, label_rounding: bool) -> DataFrame:
    """(keys, bin, mean_nee, n, mid) of all bins from (keys, bin, mean_nee, n, __edges) of those with rows; a row without a bin keeps its group only."""
    found = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct("mean_nee", "n"))))
    made = each.groupBy(*keys).agg(F.first("__edges", ignorenulls=True).alias("__edges"), F.map_from_entries(found).alias("__found"))
    labelled = rounded_edges(made, "__edges", "__shown") if label_rounding else made.withColumn("__shown", F.col("__edges"))
    ends = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.struct(k.alias("bin"), ((F.get("__shown", k) + F.get("__shown", k + 1)) / 2).alias("mid"), F.try_element_at("__found", k).alias("of")))
    grid = labelled.select(*keys, F.explode(ends).alias("__b"))
    return grid.select(*keys, "__b.bin", "__b.of.mean_nee", F.coalesce("__b.of.n", F.lit(0)).cast("long").alias("n"), "__b.mid")


def ustar_bin_stats(df: DataFrame, ustar: str, nee: str, keys: Sequence[str], bins: int = 20, weight: str | None = None, label_rounding: bool = True) -> DataFrame:
    """(keys, bin, mean_nee, n, mid) of equal-frequency u* bins; empty bins have a null mean.

    Groups whose edges repeat give no rows.
    """
    return binned_stats(df, quantile_edges(df, ustar, bins, keys, weight), ustar, nee, keys, bins, weight, label_rounding)


def gated_edges(df: DataFrame, tair: str, ustar: str, keys: Sequence[str], bins: int, weight: str | None = None, limit: float = 0.4) -> DataFrame:
    """(keys, edges) of the groups that pass ``correlation_gate``: the edges of u* and the gate's sums are one aggregate."""
    both = col(tair).isNotNull() & col(ustar).isNotNull()
    w = F.when(both, F.col(weight) if weight else F.lit(1))
    x, y = col(tair), col(ustar)
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = F.percentile(y, shares, F.when(y.isNotNull(), F.col(weight)).otherwise(0)) if weight else F.percentile(y, shares)
    sums = df.groupBy(*keys).agg(edges.alias("edges"), *[F.sum(c).alias(f"__{k}") for k, c in products(w, x, y).items()])
    return sums.where(passes(limit)).select(*keys, "edges")


def products(w: Column, x: Column, y: Column) -> dict[str, Column]:
    return {"n": w, "x": w * x, "y": w * y, "xx": w * x * x, "yy": w * y * y, "xy": w * x * y}


def passes(limit: float) -> Column:
    """Whether the correlation, from the sums of ``products`` as columns __n, __x ..., is below the limit or undefined."""
    n, x, y, xx, yy, xy = (F.col(f"__{k}") for k in ("n", "x", "y", "xx", "yy", "xy"))
    vx, vy = xx - x * x / n, yy - y * y / n
    spread = (vx > 1e-12 * xx) & (vy > 1e-12 * yy)  # else a constant, up to rounding
    return F.coalesce(F.abs(F.when(spread, (xy - x * y / n) / F.sqrt(vx * vy))) < limit, F.lit(True))


def moving_point(stats: DataFrame, keys: Sequence[str], vegetation: str = "forest") -> DataFrame:
    """(keys, threshold): the first bin whose mean exceeds a tolerance times the mean of all later ones.

    All bins are tried with 0.99 first and only then with 0.90; none gives the vegetation's fallback.
    """
    later = Window.partitionBy(*keys).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    each = stats.withColumn("__later", F.avg("mean_nee").over(later))
    found = [F.min_by(F.when(F.col("mean_nee") > t * F.col("__later"), F.col("mid")), F.when(F.col("mean_nee") > t * F.col("__later"), F.col("bin"))) for t in TOLERANCES]
    return each.groupBy(*keys).agg(F.coalesce(*found, F.lit(FALLBACK.get(vegetation, OTHER_FALLBACK))).alias("threshold"))


def mpt_threshold(df: DataFrame, ustar: str = "u*", nee: str = "NEE", tair: str = "Tair", rg: str = "Rg", start=None, end=None, temp_groups: int = 6, nee_bins: int = 20, vegetation: str = "forest", keys: Sequence[str] = (), weight: str | None = None, label_rounding: bool = True) -> DataFrame:
    """(keys, threshold): median of the accepted temperature groups' thresholds, null if none is accepted."""
    keys = list(keys)
    rows = between_times(df, start, end).where(is_night(col(rg))).select(*keys, *[col(c).alias(c) for c in (ustar, nee, tair)], *([weight] if weight else []))
    grouped = quantile_bin(rows, tair, temp_groups, keys, "temp_group", weight).where("temp_group is not null")
    by = [*keys, "temp_group"]
    edges = gated_edges(grouped, tair, ustar, by, nee_bins, weight)
    stats = binned_stats(grouped, edges, ustar, nee, by, nee_bins, weight, label_rounding)
    found = moving_point(stats, by, vegetation).groupBy(*keys).agg(F.percentile("threshold", F.lit(0.5)).alias("threshold"))
    return keyed_join(rows.select(*keys).distinct(), found, keys, "left") if keys else found


def bootstrap_sample(df: DataFrame, replicates: int, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with ``rep`` and ``weight``: how often each of n draws with replacement took the row.

    Draw j of replicate b is a hash of (seed, keys, b, j), so it doesn't depend on partitioning. Draws
    are counted before they meet the rows; a row that no draw took has no row for that replicate.
    Replicates of a series are dealt to as many tasks before their draws are made.
    """
    keys = list(keys)
    placed = positions(df, keys)
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("__n"))
    label = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys], F.col("rep").cast("string"), F.col("j").cast("string"))
    dealt = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # short rows of much work: Spark would join them in one task
    draws = dealt.repartition(tasks, *keys, "rep").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    taken = draws.withColumn("__pos", F.conv(F.substr(F.md5(label), F.lit(1), F.lit(8)), 16, 10).cast("long") % F.col("__n"))
    counts = taken.groupBy(*keys, "rep", "__pos").agg(F.count("*").alias("weight"))
    return keyed_join(placed, counts.hint("merge"), [*keys, "__pos"])  # draws come from a short table and are many


#: A prime below 2^31, and multipliers by which a hash runs through its residues.
PRIME, REP_STRIDE, STRIDES, SHIFTS = 2_147_483_647, 1_000_003, (48_271, 40_692, 69_621), (15, 13, 16)
#: floor(PRIME * P(X <= k)) for a Poisson variable X of mean 1: beyond the last, no residue is left.
POISSON_CUTS = [int(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def poisson_sample(df: DataFrame, replicates: int, seed: int = 42, keys: Sequence[str] = (), identity: Sequence[str] = ("datetime",), reps: Column | None = None) -> DataFrame:
    """Rows with ``rep`` and ``weight``: a Poisson(1) weight for each replicate, in place of n draws with replacement.

    A weight is a hash of (seed, keys, identity, replicate), so it needs no position, no table of draws and no join, and
    doesn't depend on partitioning or on other rows. A replicate has n rows only on average. Rows of one key and identity
    have the same weights; a row of weight 0 has no row for that replicate. ``reps``, an array for each row, takes some replicates only.
    """
    name = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in [*keys, *identity]]))
    part = lambda at: F.conv(F.substr(name, F.lit(at), F.lit(7)), 16, 10).cast("long")
    named = df.withColumn("__a", part(1)).withColumn("__b", part(8))
    x = F.col("__x")
    each = named.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)) if reps is None else reps)).withColumn("__x", (F.col("__a") + F.col("rep").cast("long") * REP_STRIDE) % PRIME)
    for stride, shift in zip(STRIDES, SHIFTS, strict=True):
        each = each.withColumn("__x", (x * stride + F.col("__b")) % PRIME).withColumn("__x", x.bitwiseXOR(F.shiftright(x, shift)) % PRIME)
    # columns of their own, and a condition on the hash itself: Spark would compute a long expression again wherever it is used
    weight = sum((F.when(x >= c, 1).otherwise(0) for c in POISSON_CUTS), F.lit(0)).cast("long")
    return each.where(x >= POISSON_CUTS[0]).withColumn("weight", weight).drop("__a", "__b", "__x")


def bootstrap_thresholds(df: DataFrame, seasons: Sequence[tuple[str, str]] | None = None, n_bootstraps: int = 100, ustar: str = "u*", nee: str = "NEE", tair: str = "Tair", rg: str = "Rg", temp_groups: int = 6, nee_bins: int = 20, vegetation: str = "forest", seed: int = 42, keys: Sequence[str] = (), label_rounding: bool = True, draws: str = "multinomial") -> DataFrame:
    """(keys, rep, season, threshold) of every replicate and season, and its largest season's as 'overall'.

    Seasons are inclusive ranges and may overlap; without any, all rows are one season. ``draws`` is 'multinomial' (n draws
    with replacement) or 'poisson' (a weight for each row; day rows, which no threshold needs, are left out before).
    """
    keys = list(keys)
    values = [col(c).alias(n) for c, n in ((ustar, "__ustar"), (nee, "__nee"), (tair, "__tair"), (rg, "__rg"))]
    sample = replicate_rows(df.select(*[col(k) for k in keys], "datetime", *values), n_bootstraps, seed, keys, draws)
    if seasons:
        stamp = lambda t: F.lit(t).cast("timestamp_ntz")
        listed = [F.when(F.col("datetime").between(stamp(a), stamp(b)), F.lit(f"{a} to {b}")) for a, b in seasons]
        sample = sample.withColumn("season", F.explode(F.array_compact(F.array(*listed))))
    else:
        sample = sample.withColumn("season", F.lit("all"))
    own = [*keys, "__block", "rep"]
    each = replicate_thresholds(sample, [*own, "season"], temp_groups, nee_bins, vegetation, label_rounding)
    largest = F.array(F.struct(F.lit("overall").alias("season"), F.max("threshold").alias("threshold")))
    listed = each.groupBy(*own).agg(F.concat(F.collect_list(F.struct("season", "threshold")), largest).alias("__all"))
    return listed.select(*[col(k) for k in keys], "rep", F.explode("__all").alias("__e")).select(*[col(k) for k in keys], "rep", "__e.season", "__e.threshold")


def replicate_rows(narrow: DataFrame, replicates: int, seed: int, keys: Sequence[str], draws: str) -> DataFrame:
    """Night rows of (keys, datetime, __ustar, __nee, __tair, __rg) with __block, rep and weight, dealt by (keys, __block).

    A block is REPS_AT_ONCE replicates of a series. What is shuffled is a copy of the narrow rows for each block, and a
    block's replicates are made after that, so they are never shuffled, and steps that group by (keys, __block, ...) stay in their task.
    Draws are those of ``bootstrap_sample``, a row for each that took a night row: a block holds its series as an array, by position.
    """
    spark, names = narrow.sparkSession, ["datetime", "__ustar", "__nee", "__tair"]
    night = is_night(F.col("__rg"))
    if draws == "poisson":
        base = stored(narrow.where(night).select(*[col(k) for k in keys], *names), shared_dir(spark), "nights")
        rows = base.count()
    elif draws == "multinomial":
        one = F.struct("__pos", F.when(night, F.struct(*names)).alias("v"))
        base = stored(positions(narrow, keys).groupBy(*[col(k) for k in keys]).agg(F.sort_array(F.collect_list(one)).alias("__rows")), shared_dir(spark), "series")
        rows = base.agg(F.sum(F.size("__rows"))).first()[0] or 0
    else:
        raise ValueError(f"draws must be multinomial or poisson, not {draws!r}")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * replicates // ROWS_AT_ONCE))
    first = F.col("__block") * REPS_AT_ONCE
    reps = F.sequence(first, F.least(first + REPS_AT_ONCE, F.lit(replicates)) - 1)
    dealt = base.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // REPS_AT_ONCE)))).repartition(tasks, *[col(k) for k in keys], "__block")
    if draws == "poisson":
        return poisson_sample(dealt, replicates, seed, keys, reps=reps)
    each = dealt.withColumn("rep", F.explode(reps)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.size("__rows").cast("long") - 1)))
    label = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys], F.col("rep").cast("string"), F.col("j").cast("string"))
    place = (F.conv(F.substr(F.md5(label), F.lit(1), F.lit(8)), 16, 10).cast("long") % F.size("__rows")).cast("int")
    taken = each.withColumn("__at", F.explode(F.array(place)))  # a column of its own: a condition on it would compute the hash again
    found = taken.withColumn("__v", F.get("__rows", F.col("__at"))["v"]).where("__v is not null")
    return found.select(*[col(k) for k in keys], "__block", "rep", *[F.col("__v")[n].alias(n) for n in names], F.lit(1).cast("long").alias("weight"))


def apart(edges: Column, q: int) -> Column:
    """Whether q + 1 ascending edges differ."""
    return reduce(lambda a, b: a & b, [F.get(edges, F.lit(k)) < F.get(edges, F.lit(k + 1)) for k in range(q)])


def above(x: Column, edges: Column, q: int) -> Column:
    """The number of inner edges, at nine decimals, below x: short code, as Java runs long methods of generated code uncompiled."""
    return reduce(lambda a, b: a + b, [(x > F.rint(F.get(edges, F.lit(k)) * 1e9) / 1e9).cast("int") for k in range(1, q)])


def replicate_thresholds(sample: DataFrame, by: Sequence[str], temp_groups: int, bins: int, vegetation: str, label_rounding: bool, limit: float = 0.4) -> DataFrame:
    """(by, threshold): ``mpt_threshold`` of each replicate's rows (by, __ustar, __nee, __tair, weight), by windows and no joins.

    Rows that are dealt by some of ``by`` stay in their task from here to the thresholds.
    """
    x, y, w = F.col("__tair"), F.col("__ustar"), F.col("weight")
    edges = lambda c, q: F.percentile(c, F.array(*[F.lit(i / q) for i in range(q + 1)]), F.when(c.isNotNull(), w).otherwise(0))
    t, e = F.col("__t"), F.col("__edges")
    warm = sample.withColumn("__t", edges(x, temp_groups).over(Window.partitionBy(*by)))
    grouped = warm.withColumn("temp_group", F.when(x.isNotNull() & apart(t, temp_groups), above(x, t, temp_groups))).drop("__t")
    group = Window.partitionBy(*by, "temp_group")
    total = products(F.when(x.isNotNull() & y.isNotNull(), w), x, y)
    gated = grouped.withColumns({"__edges": edges(y, bins).over(group), **{f"__{k}": F.sum(c).over(group) for k, c in total.items()}})
    binned = gated.withColumn("bin", above(y, e, bins))
    own, got = [*by, "temp_group", "__fine"], F.when(F.col("__nee").isNotNull(), w)
    kept = [F.first(f"__{k}").alias(f"__{k}") for k in ("edges", *total)]
    bound = binned.groupBy(*by, "temp_group", "bin").agg((F.sum(got * F.col("__nee")) / F.sum(got)).alias("mean_nee"), F.sum(w).alias("n"), *kept)
    each = bound.withColumn("__fine", F.coalesce(F.col("temp_group").isNotNull() & apart(F.transform(e, lambda v: F.round(v, 12)), bins) & passes(limit), F.lit(False)))
    found = moving_point(labelled_bins(each, own, bins, label_rounding), own, vegetation)
    return found.groupBy(*by).agg(F.percentile(F.when(F.col("__fine"), F.col("threshold")), F.lit(0.5)).alias("threshold"))


def bootstrap_ustar(df: DataFrame, seasons: Sequence[tuple[str, str]] | None = None, n_bootstraps: int = 100, ustar: str = "u*", nee: str = "NEE", tair: str = "Tair", rg: str = "Rg", temp_groups: int = 6, nee_bins: int = 20, vegetation: str = "forest", seed: int = 42, keys: Sequence[str] = (), label_rounding: bool = True, draws: str = "multinomial") -> DataFrame:
    """(keys, season, u5, u50, u95): percentiles over the replicates of ``bootstrap_thresholds`` for each season, and 'overall'."""
    each = bootstrap_thresholds(df, seasons, n_bootstraps, ustar, nee, tair, rg, temp_groups, nee_bins, vegetation, seed, keys, label_rounding, draws)
    p = F.percentile("threshold", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = each.groupBy(*keys, "season").agg(p.alias("p"))
    return out.select(*keys, "season", F.col("p")[0].alias("u5"), F.col("p")[1].alias("u50"), F.col("p")[2].alias("u95"))
