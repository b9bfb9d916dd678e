"""Bootstrap intervals whose rounds are sums, so that no group meets in one task.

In the Poisson bootstrap each row takes part in a round with a weight of its own,
Poisson distributed with mean one; with many rows that is the multinomial draw.
The weight is an expression of the row's key, the round and a seed, so a row needs
no other row: weighted sums are added up by group and round before they are
shuffled, and an executor that is lost computes the same weights again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights are read off a number below this prime; squares of such numbers fit a long.
PRIME = 2_147_483_647
#: The number from which on a weight exceeds k, for k = 0, 1, ...
STEPS = [math.ceil(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(13)]


def poisson(key: Column, turn: Column, seed: int) -> Column:
    """A Poisson weight of mean one, from three rounds of mixing modulo ``PRIME``."""
    p = F.lit(PRIME)
    x0 = F.pmod(key.cast("long"), p)
    x1 = (x0 * 48271 + turn * 69621 + seed) % p
    x2 = (x1 * x1 + x0 * 16807 + turn) % p
    x3 = (x2 * x2 + x1 * 40692 + seed) % p
    out = F.when(x3 < STEPS[0], 0)
    for k, step in enumerate(STEPS[1:], 1):
        out = out.when(x3 < step, k)
    return out.otherwise(len(STEPS)).cast("long")


def poisson_sql(key: str, turn: str, seed: int) -> str:
    """The same weight as SQL text."""
    x0 = f"((({key}) % {PRIME} + {PRIME}) % {PRIME})"
    x1 = f"(({x0} * 48271 + {turn} * 69621 + {seed}) % {PRIME})"
    x2 = f"(({x1} * {x1} + {x0} * 16807 + {turn}) % {PRIME})"
    x3 = f"(({x2} * {x2} + {x1} * 40692 + {seed}) % {PRIME})"
    return f"(SELECT CASE {' '.join(f'WHEN x < {s} THEN {k}' for k, s in enumerate(STEPS))} ELSE {len(STEPS)} END FROM (SELECT {x3} AS x))"


def poisson_interval(df: DataFrame, by: list[str], key: str, num: str, den: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """``by``, n, lo and hi: the 95 % interval of sum(num) / sum(den) of each group.

    ``key`` is a number that tells rows apart.  A round without weight on ``den``
    is 0, and groups below two rows have no interval.
    """
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))).alias("turn")
    rows = df.select(*by, F.col(key).alias("_key"), F.col(num).alias("_num"), F.col(den).alias("_den"), turn)
    weight = poisson(F.col("_key"), F.col("turn"), seed)
    sums = rows.groupBy(*by, "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(weight * F.col("_num")).alias("a"), F.sum(weight * F.col("_den")).alias("b"))
    stat = F.when(F.col("b") != 0, F.col("a") / F.col("b")).otherwise(0.0)
    # ``rounds`` numbers a group
    g = sums.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(stat)).alias("x"))
    at = lambda share: F.when(F.col("n") > 1, F.get("x", F.lit(int(rounds * share))))
    return g.select(*by, "n", at(0.025).alias("lo"), at(0.975).alias("hi"))
