"""Cross-run ranks, guardrails, composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str, descending: bool = False) -> Column:
    """Rank from 1 with ties averaged; null values have none."""
    w = Window.partitionBy(*by)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(w.orderBy(order)) + (same - 1) / 2.0)


def rank_score(df: DataFrame, value: str, *by: str, descending: bool = True) -> DataFrame:
    """Adds ``score``: 1 for the best, 0 for the worst, ties share; null below two values."""
    n = F.count(value).over(Window.partitionBy(*by))
    return df.withColumn("score", F.when(n >= 2, 1.0 - (average_rank(value, *by, descending=descending) - 1.0) / (n - 1)))


def composite(scores: dict[str, float]) -> Column:
    """Weighted mean over the components that are there."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in scores.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in scores.items()), F.lit(0.0))
    return F.when(weight > 0, top / weight)


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Pearson correlation of average ranks; nan where a side is constant."""
    ranked = df.select(*by, average_rank(a, *by).alias("ra"), average_rank(b, *by).alias("rb"))
    return ranked.groupBy(*by).agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))
