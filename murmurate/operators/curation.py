"""Dataset curation: screening, caps, splits, exclusions, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *cols: str) -> Column:
    """Deterministic order of rows: sha-256 of seed and values."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"), 256)


def cap_per(df: DataFrame, by: Column, limit: int, *order: Column | str) -> DataFrame:
    """At most ``limit`` rows of each group, first in order (Spark prunes before the shuffle)."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= limit).drop("_k")


def group_split(df: DataFrame, dataset: str, group: str, ratio: float, seed: int) -> DataFrame:
    """Adds ``split``; all rows of a group (a speaker) fall on one side, the first max(1, n * ratio rounded half to even) groups by hash, at most n - 1, validate."""
    groups = df.select(dataset, group).distinct()
    w = Window.partitionBy(dataset)
    n = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy(seeded(seed, dataset, group), group))
    take = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(float(ratio)), 0).cast("int")), n - 1)
    marked = groups.select(dataset, group, F.when(rank <= take, "validation").otherwise("train").alias("split"))
    return df.join(marked, [dataset, group])


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 0.5, "<0.5").when(seconds < 1.0, "0.5-1").when(seconds < 1.5, "1-1.5").when(seconds <= 2.0, "1.5-2").otherwise(">2")


def exclude(rows: DataFrame, samples: DataFrame, speakers: DataFrame, key: str, speaker: str) -> DataFrame:
    """Adds the exclusion of each row: the sample's rule before the speaker's."""
    s = samples.select(key, F.col("reason").alias("_s"))
    p = speakers.select(speaker, F.col("reason").alias("_p"))
    return rows.join(s, key, "left").join(p, speaker, "left").withColumn("excluded_by", F.when(F.col("_s").isNotNull(), "sample").when(F.col("_p").isNotNull(), "speaker")).withColumn("reason", F.coalesce("_s", "_p")).drop("_s", "_p")


def select_in_order(rows: DataFrame, ids: list[int], key: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted ids with their position, and the wanted ids that are missing; ``strict`` fails if there are any."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(enumerate(ids)), f"position long, {key} long")
    missing = want.join(rows.select(key), key, "left_anti")
    if strict and (gone := [r[key] for r in missing.orderBy("position").collect()]):  # at most the ids that were asked for
        raise ValueError(f"ids that are not there: {gone}")
    return rows.join(F.broadcast(want), key), missing


def in_subset(value: Column, subset: str, aliases: dict[str, str] | None = None) -> Column:
    """Whether a value holds any of the comma-separated names, letters and digits compared in lower case; an empty list takes all.

    With ``aliases`` a name must be one of them (any case) and stands for its value; another one fails.
    """
    names = [x.strip() for x in subset.split(",") if x.strip()]
    if aliases is not None:
        known = {k.casefold(): v for k, v in aliases.items()}
        if unknown := [x for x in names if x.casefold() not in known]:
            raise ValueError(f"no such subset: {unknown}")
        return F.lit(True) if not names else value.isin(*[known[x.casefold()] for x in names])
    plain = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")
    out = F.lit(not names)
    for x in names:
        out = out | F.contains(plain, F.lit("".join(c for c in x.lower() if c.isascii() and c.isalnum())))
    return out


def genuine(subset: Column) -> Column:
    """Not synthetic: the subset's name says that it is real."""
    return F.coalesce(F.startswith(subset, F.lit("real-")), F.lit(False))


def resolve_ids(rows: DataFrame, key: str, contents: list[str]) -> DataFrame:
    """One row for each id: n rows, the digests of the least and greatest content, and the verdict.

    Rows of one id with equal contents are repeats, of which one counts; with
    different contents they are a conflict, whatever their number.  Least and
    greatest digest tell that apart, so no pair of rows is formed and sums are
    made before the shuffle.  A null content differs from an empty one.
    """
    each = F.concat_ws("|", *[F.coalesce(F.sha2(F.col(c).cast("binary"), 256), F.lit("-")) for c in contents])
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(each).alias("first"), F.max(each).alias("last"))
    verdict = F.when(F.col("first") != F.col("last"), "conflict").when(F.col("n") > 1, "repeat").otherwise("single")
    return g.select(key, "n", F.sha2(F.col("first").cast("binary"), 256).alias("first"), F.sha2(F.col("last").cast("binary"), 256).alias("last"), verdict.alias("verdict"))


def without_repeats(rows: DataFrame, key: str, contents: list[str]) -> DataFrame:
    """``rows`` with one row for each id; ids with different contents fail, and the first of them are named."""
    bad = [r[key] for r in resolve_ids(rows, key, contents).where("verdict = 'conflict'").orderBy(key).limit(5).collect()]
    if bad:
        raise ValueError(f"ids with different contents: {', '.join(map(str, bad))}")
    return rows.dropDuplicates([key])


def reviewed(samples: DataFrame, excluded: DataFrame, *by: str) -> DataFrame:
    """The error rate of each run that holds excluded samples, without them: counts, sums, the ids left out in order and their signature.

    ``samples``: ``by``, id, ref_len, sub, del, ins; ``excluded``: id and rule (JSON
    text).  A sample without a length is not scored; a run without excluded samples
    has no row, and one whose kept samples have no length has no rate.  Runs are
    summed before they are shuffled.  The ids of a run's excluded samples come
    together in one row; they are a list that people wrote, not a share of the corpus.
    """
    rules = excluded.select(F.col("id").cast("string").alias("_id"), F.col("rule").alias("_rule"), F.lit(True).alias("_out"))
    j = samples.withColumn("_id", F.col("id").cast("string")).join(rules, "_id", "left")
    gone = F.coalesce(F.col("_out"), F.lit(False))
    kept = ~gone & F.col("ref_len").isNotNull()
    edits = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("sub", "del", "ins")), F.lit(0))
    g = j.groupBy(*by).agg(
        F.count_if(~gone).alias("n_total"),
        F.count_if(kept).alias("n_scored"),
        F.count_if(gone).alias("n_excluded"),
        F.coalesce(F.sum(F.when(kept, F.col("ref_len"))), F.lit(0)).cast("long").alias("total_ref_len"),
        F.coalesce(F.sum(F.when(kept, edits)), F.lit(0)).cast("long").alias("total_edits"),
        F.array_sort(F.collect_list(F.when(gone, F.struct("_id", "_rule")))).alias("x"),
    )
    quoted = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    lines = F.transform(F.array_distinct("x"), lambda s: F.concat(quoted(s["_id"]), F.lit(":"), F.coalesce(s["_rule"], F.lit("null"))))
    signature = F.substring(F.sha2(F.concat(F.lit("{"), F.array_join(lines, ","), F.lit("}")).cast("binary"), 256), 1, 12)
    rate = F.round(F.try_divide("total_edits", "total_ref_len"), 4)
    return g.where("n_excluded > 0").select(*by, rate.alias("err_rate"), "n_total", "n_scored", "n_excluded", F.transform("x", lambda s: s["_id"]).alias("excluded_ids"), "total_ref_len", "total_edits", signature.alias("exclusion_signature"))
