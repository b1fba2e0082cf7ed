"""Exact quantiles of groups of any size, by distributed selection.

A group of no more than FEW values is one aggregate's buffer. In a larger one only counts are gathered: its values are
counted by range; the range that holds a wanted rank is cut anew, between the smallest and the largest value that were
seen in it, and so on until a range holds one value or so few that they fit in a row. No task ever holds a group's
values, and each round shuffles at most BINS counts for each task and wanted rank.

There are at most (rows / FEW) large groups. What is wanted of them is a small table; it is written before it is joined,
so that it is broadcast only if its size allows.

Defined results: null values do not count; NaN is larger than any number; a group without values has null quantiles;
ranks between two values are interpolated.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.sources.tables import written_once

#: Values of a group that one aggregate gathers.
FEW = 100_000
#: Ranges that a wanted rank's range is cut into; values that are sorted within a row.
BINS, ROW = 1024, 4096


def _same(groups: list[str], a: str, b: str) -> Column:
    return functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups))


def quantiles(rows: DataFrame, groups: list[str], value: str, fractions: dict[str, float], few: int = FEW, bins: int = BINS, row: int = ROW) -> DataFrame:
    """(groups, a column for each of `fractions`: name -> fraction) of every group of `rows`."""
    own = rows.select(*groups, F.col(value).cast("double").alias("v"))
    sizes = own.groupBy(*groups).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    large = written_once(sizes.filter(F.col("n") > few))
    plain = lambda x: x.groupBy(*groups).agg(*(F.percentile("v", p).alias(name) for name, p in fractions.items()))
    if large.isEmpty():
        return plain(own)
    small = own.alias("r").join(large.alias("l"), _same(groups, "r", "l"), "left_anti")
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)) for p in fractions.values()))))
    wanted = large.select(*groups, "n", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"))
    found = selected(own.filter("v IS NOT NULL"), wanted.drop("n"), groups, bins, row)
    at = F.map_from_entries(F.collect_list(F.struct("rank", "v")))
    known = large.alias("l").join(found.groupBy(*groups).agg(at.alias("at")).alias("f"), _same(groups, "l", "f")).select("l.*", "f.at")
    return plain(small).unionByName(known.select(*groups, *(_between(F.col("at"), (F.col("n") - 1) * p).alias(name) for name, p in fractions.items())))


def _between(at: Column, rank: Column) -> Column:
    a, b = F.element_at(at, F.floor(rank)), F.element_at(at, F.ceil(rank))
    return F.when(a == b, a).otherwise(a + (b - a) * (rank - F.floor(rank)))


def _scale(v: Column) -> Column:
    """A growing function of a number that grows as its logarithm on both sides of zero; infinities and NaN have places."""
    size = F.when(v == 0, 0.0).otherwise(F.log(F.abs(v)) + 750)
    return F.when(F.isnan(v), 2e4).otherwise(F.least(F.lit(1e4), F.greatest(F.lit(-1e4), F.signum(v) * size)))


def _place(v: Column, low: Column, high: Column) -> Column:
    """Where a value lies between two others, 0 to 1, not falling. Ranges of more than one order of magnitude are cut by
    `_scale`, others evenly, so that eight rounds or so find any number."""
    wide = _scale(high) - _scale(low) > 1
    part = lambda f: (f(v) - f(low)) / (f(high) - f(low))
    return F.when(wide, part(_scale)).otherwise(part(lambda x: x / 2))


def selected(own: DataFrame, wanted: DataFrame, groups: list[str], bins: int, row: int) -> DataFrame:
    """(groups, rank, v): the value of each wanted rank (from 0), from `own` (groups, v) and `wanted` (groups, rank, and what is
    known: the range low..high that holds it, `held` values in the range and `below` before it)."""
    columns = [*groups, "rank", "low", "high", "below", "held"]
    out = None
    while True:
        wanted = written_once(wanted.select(*columns))
        one, narrow = F.col("low") == F.col("high"), F.col("held") <= row
        inside = own.alias("r").join(wanted.filter(~one).alias("w"), _same(groups, "r", "w") & F.col("v").between(F.col("low"), F.col("high"))).select(*(f"w.{c}" for c in columns), "v")
        few = inside.filter(narrow).groupBy(*groups, "rank").agg(F.get(F.array_sort(F.collect_list("v")), (F.col("rank") - F.first("below")).cast("int")).alias("v"))
        done = written_once(wanted.filter(one).select(*groups, "rank", F.col("low").alias("v")).unionByName(few))
        out = done if out is None else out.unionByName(done)
        if wanted.filter(~one & ~narrow).isEmpty():
            return out
        place = _place(F.col("v"), F.col("low"), F.col("high"))
        bin_ = F.least(F.lit(bins - 1), F.floor(place * bins)).cast("int")
        counted = inside.filter(~narrow).withColumn("bin", bin_).groupBy(*groups, "rank", "below", "bin").agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("held").over(Window.partitionBy(*groups, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        placed = counted.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0)))
        wanted = placed.filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("held")))
