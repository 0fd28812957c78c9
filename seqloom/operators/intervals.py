"""Intervals: islands, coverage and its gaps, joins by overlap, quantiles of what lies between.

Interval tables have a key (what is partitioned by), ``start`` and ``end``, best as
integers. Joins on overlap carry an equality on time bins, so that they hash or
merge and never compare every pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = Sequence[str]


def islands(df: DataFrame, keys: Keys, gap: float = 0, start: str = "start", end: str = "end", name: str = "island", touching: bool = True) -> DataFrame:
    """Numbers runs of intervals whose distance to all before is at most ``gap`` (below it, if not ``touching``).

    A long early interval holds an island open for all that follow within it.
    """
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) - reach > gap if touching else F.col(start) - reach >= gap
    new = F.when(reach.isNull() | apart, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merged(df: DataFrame, keys: Keys, gap: float = 0, start: str = "start", end: str = "end", touching: bool = True) -> DataFrame:
    """One row for each island: its keys, ``start``, ``end`` and how many ``parts`` it has."""
    by = [*keys, "island"]
    return islands(df, keys, gap, start, end, touching=touching).groupBy(*by).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("parts"))


def uncovered(df: DataFrame, keys: Keys, low: Column | float, high: Column | float, least: float = 0, start: str = "start", end: str = "end") -> DataFrame:
    """Stretches of ``low .. high`` that no interval covers, of length ``least`` or more: keys, ``start``, ``end``.

    Only keys that have an interval are listed; the rest are uncovered whole.
    """
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    by = Window.partitionBy(*keys).orderBy(start, end)
    cut = df.withColumn("__low", low).withColumn("__high", high)
    reach = F.coalesce(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("__low"))
    between = cut.withColumn("__from", F.greatest(reach, F.col("__low"))).withColumn("__to", F.least(F.col(start), F.col("__high")))
    last = cut.groupBy(*keys).agg(F.max(F.greatest(end, "__low")).alias("__from"), F.max("__high").alias("__to"))
    out = between.select(*keys, "__from", "__to").unionByName(last)
    return out.where((F.col("__to") - F.col("__from") >= least) & (F.col("__to") > F.col("__from"))).select(*keys, F.col("__from").alias("start"), F.col("__to").alias("end"))


def longest_uncovered(df: DataFrame, keys: Keys, low: Column | float, high: Column | float) -> DataFrame:
    """The longest stretch of ``low .. high`` that no interval covers, of several the first: keys, ``start``, ``end``."""
    longest = uncovered(df, keys, low, high).groupBy(*keys).agg(F.max(F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"))).alias("x"))
    return longest.select(*keys, (-F.col("x.s")).alias("start"), (F.col("x.n") - F.col("x.s")).alias("end"))


def _bins(df: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))


def overlap_join(a: DataFrame, b: DataFrame, keys: Keys, width: float, strict: bool = True, condition: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs of rows of ``a (.., a_start, a_end)`` and ``b (.., b_start, b_end)`` with equal keys that overlap.

    Both sides are cut into bins of ``width``, about the length of an interval; a
    pair is kept in the first bin that both have, so it comes once. ``how`` is
    ``inner``, ``left_semi`` or ``left_anti``; for the latter two, rows of ``a`` that
    are alike in all columns have the same fate.
    """
    bin_a, bin_b = _bins(a, "a_start", "a_end", width, "__bin"), _bins(b.withColumnsRenamed({k: f"__b_{k}" for k in keys}), "b_start", "b_end", width, "__bin_b")
    same = F.col("__bin") == F.col("__bin_b")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__b_{k}"))
    meets = (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) if strict else (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    if condition is not None:
        meets = meets & condition
    if how == "inner":
        first = F.col("__bin") == F.floor(F.greatest("a_start", "b_start") / width).cast("long")
        return bin_a.join(bin_b, same & meets & first).drop("__bin", "__bin_b", *(f"__b_{k}" for k in keys))
    met = bin_a.join(bin_b, same & meets, "left_semi").select(*(F.col(c).alias(f"__m_{c}") for c in a.columns)).distinct()
    alike = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in a.columns))
    return a.join(met, alike, how)


def shared(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length that two intervals have in common, zero if none."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def same_passage(a_start: Column, a_end: Column, b_start: Column, b_end: Column, share: float = 0.5) -> Column:
    """Whether the overlap is at least ``share`` of the shorter."""
    return shared(a_start, a_end, b_start, b_end) >= share * F.least(a_end - a_start, b_end - b_start)


def same_recording(a_zero: Column, b_zero: Column, within: float = 5.0) -> Column:
    """Whether two alignments put the track's beginning at about the same time."""
    return F.abs(a_zero - b_zero) <= within


def zero_time(start: Column, track_start: Column, speed: Column) -> Column:
    """When the track's beginning would have been heard."""
    return start - track_start / speed


def consecutive(df: DataFrame, keys: Keys, start: str = "start") -> DataFrame:
    """Intervals between consecutive starts: keys, ``start``, ``end``."""
    by = Window.partitionBy(*keys).orderBy(start)
    return df.select(*keys, F.col(start).alias("start"), F.lead(start).over(by).alias("end")).where("end is not null")


def clean_intervals(df: DataFrame, gaps: DataFrame, keys: Keys, width: float) -> DataFrame:
    """Intervals that touch no gap."""
    a = df.select(*keys, F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = gaps.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlap_join(a, b, keys, width, strict=False, how="left_anti").select(*keys, F.col("a_start").alias("start"), F.col("a_end").alias("end"))


def exclusive_quantile(values: Column, p: float) -> Column:
    """Quantile of a sorted array by the exclusive rule: place ``p * (n + 1)``, interpolated, held within the ends."""
    n = F.size(values)
    place = p * (n + 1)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(place).cast("int")))
    low, high = F.element_at(values, j), F.element_at(values, j + 1)
    return F.when(n == 1, F.get(values, F.lit(0)).cast("double")).when(n > 1, low + (high - low) * (place - j))


def quartiles(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """``n, q1, median, q3`` of each key by the exclusive rule; a key's values are held as one array."""
    held = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("__v"))
    return held.select(*keys, F.size("__v").alias("n"), *(exclusive_quantile(F.col("__v"), p).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))


def containing_first(inner: DataFrame, outer: DataFrame, keys: Keys, width: float, order: Sequence[Column]) -> DataFrame:
    """For each row of ``inner (a_start, a_end, a_id)`` the first row of ``outer (b_start, b_end, b_id)`` that holds it whole."""
    inside = (F.col("b_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("b_end"))
    met = overlap_join(inner, outer, keys, width, strict=False, condition=inside)
    rank = F.row_number().over(Window.partitionBy(*keys, "a_id").orderBy(*order))
    return met.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def estimate(length: Column, q1: Column, q3: Column, clean: Column, records: Column) -> tuple[Column, Column, Column]:
    """Least, likely and most tracks of a gap: from quartiles of clean intervals (three at least) and repeats counted."""
    low = F.when(clean >= 3, F.greatest(F.lit(1), F.rint(length / q3))).cast("int")
    high = F.when(clean >= 3, F.greatest(F.lit(1), F.rint(length / q1))).cast("int")
    likely = F.when((records == 0) | low.isNull(), records).otherwise(F.least(F.greatest(records, low), high))
    return low, likely.cast("int"), high
