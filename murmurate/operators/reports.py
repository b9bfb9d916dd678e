"""Statistics of a report: languages with intervals, two rankings and their agreement, headline cards, averages of segments, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.functions.bootstrap import poisson_interval
from murmurate.operators.ranking import average_rank

#: Rounds and seed of a report's intervals.
ROUNDS, SEED = 4000, 20260917


def session_failed(comment: Column, marker: str) -> Column:
    """The comment tells of a session that broke down, which is the harness's fault and not the model's."""
    return F.contains(F.coalesce(comment, F.lit("")), F.lit(marker))


def language_stats(rows: DataFrame, key: str, marker: str, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """A row for each language of the scored rows (``gold`` is there): n, means, the mean's 95 % interval and failed sessions.

    ``rows`` has ``key`` (a number of each row), lang, code, cer, zh_cer, gold, asr
    and comment; means leave nulls out.  The interval comes from weights drawn by
    key, so no language meets in one task.
    """
    scored = rows.where("gold is not null")
    g = scored.groupBy("lang").agg(
        F.max("code").alias("code"),
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(c) for c in ("cer", "zh_cer", "gold", "asr")],
        F.count_if(session_failed(F.col("comment"), marker)).alias("failed"),
    )
    ends = poisson_interval(scored.withColumn("one", F.lit(1)), ["lang"], key, "gold", "one", rounds, seed).drop("n")
    return g.join(ends, g["lang"].eqNullSafe(ends["lang"]), "left").drop(ends["lang"])


def ranked_languages(stats: DataFrame, degenerate: tuple[str, ...] = ("zh",)) -> DataFrame:
    """``stats`` with rank_cer, rank_gold (1 is the best, ties share) and shift; languages whose code is degenerate have none.

    A row is a language, so the windows hold few rows.
    """
    ranks = ~F.coalesce("code", F.lit("")).isin(*degenerate)
    s = stats.withColumn("_c", F.when(ranks, F.col("zh_cer"))).withColumn("_g", F.when(ranks, F.col("gold"))).withColumn("_all", F.lit(0))
    out = s.withColumn("rank_cer", average_rank("_c", "_all")).withColumn("rank_gold", average_rank("_g", "_all", descending=True))
    return out.withColumn("shift", F.col("rank_cer") - F.col("rank_gold")).drop("_c", "_g", "_all")


def agreement(ranked: DataFrame) -> DataFrame:
    """One row: languages with both ranks, the correlation of the ranks (nan if a side is constant) and the greatest shift."""
    both = ranked.where("shift is not null")
    return both.agg(F.count(F.lit(1)).alias("languages"), F.corr("rank_cer", "rank_gold").alias("rho"), F.coalesce(F.max(F.abs("shift")), F.lit(0.0)).alias("max_shift"))


def cards(rows: DataFrame, marker: str) -> DataFrame:
    """One row of headline figures: all rows, means over scored ones, and over those whose session held."""
    scored = F.col("gold").isNotNull()
    clean = scored & ~session_failed(F.col("comment"), marker)
    mean = lambda where, c: F.avg(F.when(where, F.col(c)))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        mean(scored, "gold").alias("gold"),
        mean(scored, "asr").alias("asr"),
        mean(scored, "zh_cer").alias("zh_cer"),
        mean(clean, "gold").alias("clean_gold"),
        mean(clean, "cer").alias("clean_cer"),
        (F.count_if(scored) - F.count_if(clean)).alias("failed"),
    )


def segment_averages(items: DataFrame) -> DataFrame:
    """Scores of segments by dataset: mean of the recordings' means, mean by characters (null without any), mean of segments; and over all datasets the mean of the first and the mean of all recordings.

    ``items`` has dataset, recording, score and chars.  Sums of recordings are
    all that the later steps see; the last one holds a row a dataset.
    """
    recordings = items.groupBy("dataset", "recording").agg(F.avg("score").alias("mean"), F.sum("score").alias("s"), F.count("score").alias("n"), F.sum(F.col("score") * F.col("chars")).alias("ws"), F.sum("chars").alias("w"))
    sets = recordings.groupBy("dataset").agg(
        F.avg("mean").alias("recording_macro"),
        F.try_divide(F.sum("ws"), F.sum("w")).alias("char_weighted"),
        F.try_divide(F.sum("s"), F.sum("n")).alias("segment_micro"),
        F.sum("n").alias("n_segments"),
        F.count(F.lit(1)).alias("n_recordings"),
        F.sum("mean").alias("_means"),
    )
    whole = Window.partitionBy(F.lit(0))
    every = F.sum("_means").over(whole) / F.sum("n_recordings").over(whole)
    return sets.withColumn("dataset_macro", F.avg("recording_macro").over(whole)).withColumn("all_recordings", every).drop("_means")


def severity_counts(items: DataFrame, spans: str = "spans") -> DataFrame:
    """severity and n of the spans (structs with a severity) of all items; a span that names none is unknown."""
    return items.select(F.explode(spans).alias("s")).groupBy(F.coalesce("s.severity", F.lit("unknown")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def stream_warnings(r: dict[str, Column]) -> Column:
    """struct(ok, warnings) of one translated stream.

    ``r``: ok, hyp, chinese (whether the target is), al_s, src_s, from_tokens,
    wants_speech, has_speech and speech_err.  A failed stream has no other warning;
    a text made of tokens is a note and leaves it ok.
    """
    hyp = F.coalesce(r["hyp"], F.lit(""))
    letters = F.when(r["chinese"], F.regexp_count(hyp, F.lit("[一-鿿]"))).otherwise(F.regexp_count(hyp, F.lit("[A-Za-z]")))
    counts = F.struct(F.length(F.regexp_replace(hyp, r"(?U)\s+", "")).alias("solid"), letters.alias("letters"))
    # bound as an element, so that a text is read once and not by each rule
    return F.get(F.transform(F.array(counts), lambda c: _warned(r, c)), F.lit(0))


def _warned(r: dict[str, Column], counts: Column) -> Column:
    some = counts["solid"] > 0
    foreign = some & (F.try_divide(counts["letters"], counts["solid"]) < 0.5)
    bad = F.array_compact(
        F.array(
            F.when(~some, "empty"),
            F.when(foreign & r["chinese"], "not_chinese"),
            F.when(foreign & ~r["chinese"], "not_latin"),
            F.when(r["al_s"].isNull(), "no_lag").when(r["al_s"] < 0, "negative_lag").when((r["src_s"] != 0) & (r["al_s"] > r["src_s"] * 2 + 6), "large_lag"),
            F.when(r["wants_speech"] & ~r["has_speech"], "no_speech"),
            F.when(some & (r["speech_err"] > 0.6), "poor_speech"),
        )
    )
    notes = F.array_compact(F.array(F.when(r["from_tokens"], "from_tokens")))
    failed = F.struct(F.lit(False).alias("ok"), F.array(F.lit("failed")).alias("warnings"))
    return F.when(F.coalesce(r["ok"], F.lit(False)), F.struct((F.size(bad) == 0).alias("ok"), F.concat(bad, notes).alias("warnings"))).otherwise(failed)
