"""Words and characters of a text, and the alignment of two short arrays as a native fold (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case ASCII word tokens; an empty text has none."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: (c != "") & (c != " "))


def _steps(n: Column) -> Column:
    # sequence(1, 0) counts down, so an empty side needs its own branch
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n))


def alignment(ref: Column, hyp: Column) -> Column:
    """struct(edits, sub, del, ins) of one best alignment; on a tie substitution goes before deletion before insertion.

    Each cell carries its counts, so no backtrace is needed.
    """
    steps = _steps(F.size(hyp))
    cell = lambda e, s, d, i: F.struct(F.lit(e).alias("e") if isinstance(e, int) else e.alias("e"), s.alias("s"), d.alias("d"), i.alias("i"))
    z = F.lit(0)
    first = F.concat(F.array(cell(0, z, z, z)), F.transform(steps, lambda j: cell(j, z, z, j)))

    def pick(prev: Column, cur: Column, j: Column, r: Column) -> Column:
        up, left, diag = F.element_at(prev, j + 1), F.element_at(cur, -1), F.element_at(prev, j)
        cost = F.when(F.element_at(hyp, j) == r, 0).otherwise(1)
        best = F.least(diag["e"] + cost, up["e"] + 1, left["e"] + 1)
        return F.when(diag["e"] + cost == best, cell(best, diag["s"] + cost, diag["d"], diag["i"])).when(up["e"] + 1 == best, cell(best, up["s"], up["d"] + 1, up["i"])).otherwise(cell(best, left["s"], left["d"], left["i"] + 1))

    def row(prev: Column, r: Column) -> Column:
        start = F.element_at(prev, 1)
        return F.aggregate(steps, F.array(cell(start["e"] + 1, start["s"], start["d"] + 1, start["i"])), lambda cur, j: F.array_append(cur, pick(prev, cur, j, r)))

    return F.element_at(F.aggregate(ref, first, row), -1)
