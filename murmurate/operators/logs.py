"""Inference logs: resolving attempts, resuming, coverage, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META_ID = "__meta__"


def latest(log: DataFrame, key: str = "id", line: str = "line_no", ok: str = "ok") -> DataFrame:
    """One record per id: the last successful one, or else the first one.

    An aggregate of structs, so it combines on the map side and no id loads one
    task however often it was retried.
    """
    good = F.coalesce(F.col(ok), F.lit(False))
    rank = F.struct(good.cast("int").alias("g"), F.when(good, F.col(line)).otherwise(-F.col(line)).alias("o"))
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), rank).alias("r")).select(key, "r.*")


def sessions(log: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Records and session rows of one log."""
    return log.where(F.col(key) != META_ID), log.where(F.col(key) == META_ID)


def todo(manifest: DataFrame, log: DataFrame, key: str = "id", ok: str = "ok") -> DataFrame:
    """Manifest rows that no successful record covers."""
    return manifest.join(log.where(ok).select(key).distinct(), key, "left_anti")


def outcomes(manifest: DataFrame, best: DataFrame, key: str = "id") -> DataFrame:
    """Every manifest row with its record; ``failed`` and the reason (120 characters)."""
    joined = manifest.join(best, key, "left")
    failed = ~F.coalesce(F.col("ok"), F.lit(False))
    return joined.withColumn("failed", failed).withColumn("reason", F.when(failed, F.substring(F.coalesce("error", F.lit("no infer/empty")), 1, 120)))


def failure_runs(log: DataFrame, by: Column | str, line: str, ok: str, limit: int) -> DataFrame:
    """Runs of at least ``limit`` failures in a row (gaps and islands): first line and length."""
    w = Window.partitionBy(by).orderBy(line)
    marked = log.select(F.col(by).alias("by") if isinstance(by, str) else by.alias("by"), F.col(line).alias("line"), F.col(ok).alias("ok"), F.sum(F.col(ok).cast("int")).over(w).alias("island"))
    return marked.where(~F.col("ok")).groupBy("by", "island").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= limit).drop("island")


def lid_records(log: DataFrame, reader: bool = True) -> DataFrame:
    """Language-identification records by text id: a reader's view keeps one of each, the last successful one or else the first; a writer's view names the ids that are done."""
    rows = log.where((F.col("id") != META_ID) & (F.coalesce("id", F.lit("")) != "")).withColumn("id", F.col("id").cast("string"))
    return latest(rows) if reader else rows.where("ok").select("id").distinct()


def progress(lines: DataFrame, now: Column, stale_minutes: float = 30.0) -> DataFrame:
    """Of the output of running jobs (job, ts, line): done, total, the share and whether the job has been silent for too long."""
    pair = F.regexp_extract("line", r"(\d+)\s*/\s*(\d+)", 1), F.regexp_extract("line", r"(\d+)\s*/\s*(\d+)", 2)
    said = F.struct("ts", pair[0].try_cast("long").alias("done"), pair[1].try_cast("long").alias("total"))
    g = lines.groupBy("job").agg(F.max("ts").alias("heartbeat"), F.max_by(said, F.when(pair[0] != "", F.col("ts"))).alias("p"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("heartbeat")) / 60.0
    return g.select("job", "p.done", "p.total", F.round(F.try_divide("p.done", "p.total"), 4).alias("share"), F.round(age, 1).alias("silent_minutes"), (age > stale_minutes).alias("stale"))
