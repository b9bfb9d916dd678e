"""Runs compared: results as wide rows, guardrails, composites, compatibility, joins by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.operators.ranking import average_rank

# Metrics of each component, and whether more is better; weights of the components.
COMPONENTS = {
    "quality": {"xcomet": True, "chrF": True, "source_asr_error_rate": False, "term_recall": True},
    "latency": {"stable_ttfb_p50_s": False, "e2e_p95_ms": False, "finish_tail_p95_s": False, "long_dal_ca_ms": False},
    "stability": {"fail_rate": False, "retry_sample_rate": False, "segment_error_rate": False, "short_segment_rate": False, "anomaly_rate": False},
    "cost": {"requests_per_minute": False, "inference_p95_ms": False},
}
WEIGHTS = {"quality": 0.50, "latency": 0.25, "stability": 0.15, "cost": 0.10}
# Limits of the guardrails.
FAIL_RATE, RETRY_RATE, HARD_MAX_RATE, CHRF_GAP, ASR_GAP = 0.05, 0.05, 0.01, 1.5, 0.015

SUMMARY = "n_total long, n_ok long, low_coverage boolean, fail_rate double, retry_sample_rate double, xcomet double, chrF double, BLEU double, source_asr_error_rate double, term_recall double, translation_length_ratio_mean double, stable_ttfb_p50_s double, finish_tail_p95_s double, long_dal_ca_ms double, simult_vad struct<n_requests:long,audio_minutes:double,segments_per_minute:double,requests_per_minute:double,segment_lt_2s_rate:double,segment_gt_hard_max_rate:double,segment_reason_coverage:double,e2e_p95_ms:double,inference_p95_ms:double,segment_error_count:long,anomaly_counts:map<string,long>>"


def wide_rows(results: DataFrame) -> DataFrame:
    """One flat row of each result; ``results`` has arm, dataset and summary (a struct as in SUMMARY)."""
    s, v = (lambda c: F.col(f"summary.{c}")), (lambda c: F.col(f"summary.simult_vad.{c}"))
    count = F.aggregate(F.map_values(F.coalesce(v("anomaly_counts"), F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    n = F.when(v("n_requests") > 0, v("n_requests"))
    same = ["n_total", "n_ok", "fail_rate", "retry_sample_rate", "xcomet", "chrF", "BLEU", "source_asr_error_rate", "term_recall", "stable_ttfb_p50_s", "finish_tail_p95_s", "long_dal_ca_ms"]
    return results.select(
        "arm",
        "dataset",
        *[s(c).alias(c) for c in same],
        F.coalesce(s("low_coverage"), F.lit(False)).alias("low_coverage"),
        s("translation_length_ratio_mean").alias("length_ratio"),
        *[v(c).alias(c) for c in ("audio_minutes", "segments_per_minute", "requests_per_minute", "e2e_p95_ms", "inference_p95_ms")],
        v("segment_lt_2s_rate").alias("short_segment_rate"),
        v("segment_gt_hard_max_rate").alias("over_hard_max_rate"),
        v("segment_reason_coverage").alias("reason_coverage"),
        F.when(n.isNotNull(), F.coalesce(v("segment_error_count"), F.lit(0)) / n).alias("segment_error_rate"),
        F.when(n.isNotNull(), count / n).alias("anomaly_rate"),
        count.alias("anomaly_count"),
    )


def guardrails(rows: DataFrame) -> DataFrame:
    """arm, dataset and reasons of the rules that a row breaks; gaps are to the best of its dataset."""
    by = Window.partitionBy("dataset")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    chrf, asr = F.max("chrF").over(by) - F.col("chrF"), F.col("source_asr_error_rate") - F.min("source_asr_error_rate").over(by)
    broken = F.array_compact(
        F.array(
            F.when(F.col("low_coverage") | (zero("fail_rate") > FAIL_RATE), "coverage"),
            F.when(zero("retry_sample_rate") > RETRY_RATE, "retries"),
            F.when(zero("over_hard_max_rate") > HARD_MAX_RATE, "hard_max"),
            F.when(chrf > CHRF_GAP, "chrF_gap"),
            F.when(asr > ASR_GAP, "source_error_gap"),
        )
    )
    return rows.select("arm", "dataset", broken.alias("reasons"))


def component_scores(rows: DataFrame, components: dict[str, dict[str, bool]] = COMPONENTS) -> DataFrame:
    """arm and the mean rank score of each component: 1 for the best of a dataset's arms, 0 for the worst, ties share; a metric with fewer than two values counts nothing."""
    names = [(c, m, up) for c, metrics in components.items() for m, up in metrics.items() if m in rows.columns]
    long = rows.select("arm", "dataset", F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(m).alias("metric"), (F.col(m) if up else -F.col(m)).cast("double").alias("value")) for c, m, up in names]))).where("value is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy("dataset", "metric"))
    scored = long.withColumn("n", n).withColumn("rank", average_rank("value", "dataset", "metric", descending=True)).where("n >= 2")
    score = scored.withColumn("score", 1.0 - (F.col("rank") - 1.0) / (F.col("n") - 1))
    wide = score.groupBy("arm").pivot("component", list(components)).agg(F.round(F.avg("score"), 4))
    return rows.select("arm").distinct().join(wide, "arm", "left")


def compare(rows: DataFrame, expected: list[str]) -> DataFrame:
    """arm, components, composite_score, eligible, complete and winner (of all rows the same).

    Complete means that the arms are those expected and have the same datasets;
    only then the best eligible composite wins.  Of equal ones, the first by name.
    """
    scores = component_scores(rows)
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in WEIGHTS.items()), F.lit(0.0))
    broken = guardrails(rows).groupBy("arm").agg(F.sum(F.size("reasons")).alias("failures"))
    sets = rows.groupBy("arm").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"))
    arms = scores.join(broken, "arm").join(sets, "arm").select("arm", *WEIGHTS, F.when(weight > 0, F.round(top / weight, 4)).alias("composite_score"), (F.col("failures") == 0).alias("eligible"), "failures", "datasets")
    # a row for each arm from here on
    whole = Window.partitionBy(F.lit(0))
    same = F.size(F.collect_set("datasets").over(whole)) == 1
    known = F.array_sort(F.collect_set("arm").over(whole)) == F.array(*[F.lit(a) for a in sorted(expected)])
    best = F.max(F.when(F.col("eligible") & F.col("composite_score").isNotNull(), F.struct("composite_score"))).over(whole)
    named = F.min(F.when(F.col("eligible") & (F.col("composite_score") == best["composite_score"]), F.col("arm"))).over(whole)
    return arms.select("*", (same & known).alias("complete"), F.when(same & known, named).alias("winner"))


def compatible(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Models and datasets that fit: every needed capability is there (a simultaneous model also translates audio), and, where a model lists pairs, each source language has one with the target; ``*`` stands for all.

    Both are catalogues of a few hundred rows: ``models`` (model, caps, pairs of
    sources and targets), ``datasets`` (dataset, needs, sources, target).
    """
    caps = F.when(F.array_contains("caps", "simult"), F.array_union("caps", F.array(F.lit("translate_audio")))).otherwise(F.col("caps"))
    has = lambda a, x: F.array_contains(a, "*") | F.array_contains(a, x)
    pairs = F.coalesce(F.col("pairs"), F.array().cast("array<struct<source:array<string>,target:array<string>>>"))
    speaks = (F.size(pairs) == 0) | F.forall("sources", lambda s: F.exists(pairs, lambda p: has(p["source"], s) & has(p["target"], F.col("target"))))
    # a dataset meets the models that have its first need, so this is a join by key
    keyed = datasets.withColumn("key", F.coalesce(F.try_element_at("needs", F.lit(1)), F.lit("*")))
    able = models.withColumn("all_caps", caps).withColumn("key", F.explode(F.array_union(F.col("all_caps"), F.array(F.lit("*")))))
    return able.join(keyed, "key").where(F.size(F.array_except("needs", "all_caps")) == 0).where(speaks).select("model", "dataset")


def complete_groups(wanted: DataFrame, answers: DataFrame, group: str, key: str) -> DataFrame:
    """Answers of the groups in which every wanted id is answered; the others are dropped whole."""
    full = wanted.join(answers.select(group, key).distinct().withColumn("_there", F.lit(1)), [group, key], "left").groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count("_there").alias("there")).where("n = there").select(group)
    return answers.join(full, group, "left_semi")


def canonical_keys(events: DataFrame, named: DataFrame, session: str) -> DataFrame:
    """Events with the canonical key of their numeric id, or the id itself; ``named`` has the last name of each id."""
    keys = named.groupBy(session, "segment_id").agg(F.max_by("segment_key", "seq").alias("_key"))
    return events.join(keys, [session, "segment_id"], "left").withColumn("segment_key", F.coalesce(F.nullif("segment_key", F.lit("")), F.col("_key"), F.col("segment_id").cast("string"))).drop("_key")


def with_external(memory: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """Rows of ``memory`` and those of ``external`` that it lacks."""
    return memory.unionByName(external.join(memory.select(key).distinct(), key, "left_anti"))


def last_by_key(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The row that comes last of each key; keys are compared as text, so 7 and '7' are one."""
    text = F.trim(key.cast("string"))
    return rows.groupBy(text.alias("key")).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("key", "r.*")


def zipped(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Elements of two arrays by place; rows whose arrays differ in length fail the query."""
    both = left.join(right, key)
    fail = F.raise_error(F.concat(F.lit("lengths differ: "), F.col(key).cast("string"))).cast("array<struct<a:string,b:string>>")
    pairs = F.when(F.size(a) == F.size(b), F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")).cast("array<struct<a:string,b:string>>")).otherwise(fail)
    return both.select(key, F.posexplode(pairs).alias("pos", "p")).select(key, "pos", "p.a", "p.b")


def same_provenance(sessions: DataFrame, keys: list[str], wanted: dict[str, str]) -> Column:
    """One boolean: there are sessions, and each says exactly what is wanted (a null says nothing, so it fails)."""
    agree = F.lit(True)
    for k in keys:
        agree &= F.coalesce(F.col(k) == F.lit(wanted[k]), F.lit(False))
    return (F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and(agree), F.lit(False))
