"""Exact quantiles of groups, the largest of which may be the whole table.

A quantile lies between two ranks of a group's sorted values.  Groups of up to
``SORTED`` values are sorted as arrays.  In a larger one the ranks are found by
selection: a histogram of the range that holds them, summed before it is
shuffled, tells the cell of each rank and the cell's own least and greatest
value, which are the next range; so no task ever holds or sorts such a group, and
its values are not shuffled at all.  A range of at most ``GATHERED`` values is
read off at last.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.session import ensure_checkpoint_dir

SORTED, GATHERED, CELLS = 1 << 16, 1 << 10, 1 << 10


class Quantile(NamedTuple):
    """The lower rank (from 1) of a quantile among n values, and its value from the ones at that rank and at the next."""

    rank: Callable[[Column], Column]
    value: Callable[[Column, Column, Column], Column]


def exclusive(percent: int) -> Quantile:
    """The exclusive percentile, which may lie beyond the extremes; a lone value is its own."""
    rank = lambda n: F.greatest(F.least(F.greatest(F.floor(F.lit(percent) * (n + 1) / 100), F.lit(1)), n - 1), F.lit(1))
    up = lambda n: F.lit(percent) * (n + 1) - rank(n) * 100
    return Quantile(rank, lambda n, low, high: F.when(n == 1, low).otherwise(low * (100 - up(n)) / 100.0 + high * up(n) / 100.0))


def inclusive(fraction: float) -> Quantile:
    """Linear interpolation between the closest ranks."""
    at = lambda n: (n - 1) * F.lit(fraction)
    share = lambda n: at(n) - F.floor(at(n))
    return Quantile(lambda n: F.floor(at(n)) + 1, lambda n, low, high: low * (1 - share(n)) + high * share(n))


def nearest_rank(fraction: float) -> Quantile:
    """The value whose rank from 0 is (n - 1) * fraction, halves to the even rank."""
    return Quantile(lambda n: 1 + F.bround(((n - 1) * F.lit(fraction)).cast("double"), 0), lambda n, low, high: low)


def _same(by: list[str], a: str, b: str) -> Column:
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))


def _ranks(wanted: dict[str, Quantile], n: Column) -> Column:
    """All ranks that the quantiles need, sorted, once each."""
    each = [q.rank(n).cast("long") for q in wanted.values()]
    return F.array_sort(F.array_distinct(F.array(*each, *(F.least(r + 1, n) for r in each))))


def _between(wanted: dict[str, Quantile], n: Column, at: Callable[[Column], Column]) -> list[Column]:
    """The quantiles from the values at their ranks."""
    rank = lambda q: q.rank(n).cast("long")
    return [q.value(n, at(rank(q)), at(F.least(rank(q) + 1, n))).alias(name) for name, q in wanted.items()]


def exact(df: DataFrame, by: list[str], value: str, wanted: dict[str, Quantile], limit: int = SORTED) -> DataFrame:
    """``by``, n and the quantiles of the values of each group; nulls and NaN do not count, and a group without values has no row."""
    # every round reads the values again: they are written once, whatever it takes to compute them
    ensure_checkpoint_dir(df.sparkSession)
    df = df.select(*by, F.col(value).cast("double").alias("_v")).checkpoint().where("_v is not null and not isnan(_v)")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    large = sizes.where(F.col("n") > limit).checkpoint()
    if large.isEmpty():
        return _sorted(df, by, wanted)
    if not by:
        return _selected(df, by, large, wanted)
    small = df.alias("v").join(large.alias("g"), _same(by, "v", "g"), "left_anti")
    heavy = df.alias("v").join(large.select(*by).alias("g"), _same(by, "v", "g"), "left_semi")
    return _sorted(small, by, wanted).unionByName(_selected(heavy, by, large, wanted))


def _sorted(df: DataFrame, by: list[str], wanted: dict[str, Quantile]) -> DataFrame:
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias("x")).where(F.size("x") > 0).withColumn("n", F.size("x").cast("long"))
    return g.select(*by, "n", *_between(wanted, F.col("n"), lambda r: F.element_at("x", r.cast("int"))))


def _selected(df: DataFrame, by: list[str], large: DataFrame, wanted: dict[str, Quantile]) -> DataFrame:
    # open ranges: the ranks in them, and how many values of the group lie below
    ranges = large.select(*by, F.monotonically_increasing_id().alias("range"), "_lo", "_hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), _ranks(wanted, F.col("n")).alias("ranks"))
    found = None
    while True:
        ranges = ranges.checkpoint()
        # of one value, or few enough to be read off
        done = ranges.where("_lo = _hi").select(*by, F.explode("ranks").alias("rank"), F.col("_lo").alias("v"))
        few = _in(df, by, ranges.where(f"_lo < _hi and held <= {GATHERED}")).groupBy(*by, "range", "below", "ranks").agg(F.array_sort(F.collect_list("_v")).alias("x"))
        few = few.select(*by, "x", "below", F.explode("ranks").alias("rank")).select(*by, "rank", F.element_at("x", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
        found = done.unionByName(few) if found is None else found.unionByName(done).unionByName(few)
        ranges = ranges.where(f"_lo < _hi and held > {GATHERED}")
        if ranges.isEmpty():
            break
        # rounding keeps the order of values, so cells are ordered; halves first, as a range may exceed the largest double.
        # The ends have cells of their own, so every round makes the range smaller, infinite ends included
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        inner = F.when(F.isnan(share), 1).otherwise(1 + F.least(F.floor(share * (CELLS - 2)), F.lit(CELLS - 3)).cast("int"))
        cell = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), CELLS - 1).otherwise(inner)
        cells = _in(df, by, ranges).groupBy(*by, "range", "below", "ranks", cell.alias("cell")).agg(F.count(F.lit(1)).alias("held"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # CELLS rows of a range at most
        upto = F.sum("held").over(Window.partitionBy("range").orderBy("cell"))
        cells = cells.withColumn("below", F.col("below") + upto - F.col("held"))
        own = F.filter("ranks", lambda r: (r > F.col("below")) & (r <= F.col("below") + F.col("held")))
        cells = cells.withColumn("ranks", own).where(F.size("ranks") > 0)
        # the first and the last value of a cell are known
        edge = lambda r: F.when(r == F.col("below") + 1, F.col("_lo")).when(r == F.col("below") + F.col("held"), F.col("_hi"))
        cells = cells.checkpoint()
        at_edge = cells.select(*by, F.explode("ranks").alias("rank"), "_lo", "_hi", "below", "held").withColumn("v", edge(F.col("rank"))).where("v is not null").select(*by, "rank", "v")
        found = found.unionByName(at_edge)
        ranges = cells.select(*by, F.monotonically_increasing_id().alias("range"), "_lo", "_hi", "below", "held", F.filter("ranks", lambda r: edge(r).isNull()).alias("ranks")).where(F.size("ranks") > 0)
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("x"))
    each = large.select(*by, "n").alias("g").join(values.alias("v"), _same(by, "g", "v")).select(*(F.col(f"g.{c}").alias(c) for c in by), "n", "x")
    return each.select(*by, "n", *_between(wanted, F.col("n"), lambda r: F.try_element_at("x", r)))


def _in(df: DataFrame, by: list[str], ranges: DataFrame) -> DataFrame:
    """Values with the range that holds them; ranges of a group do not overlap."""
    within = (F.col("v._v") >= F.col("g._lo")) & (F.col("v._v") <= F.col("g._hi"))
    return df.alias("v").join(ranges.alias("g"), _same(by, "v", "g") & within).select("v.*", "g.range", "g._lo", "g._hi", "g.below", "g.ranks")
