"""Queries on a rescored run: screening of short audio, languages ranked, segments averaged, streams checked, report rows read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurate.functions.bootstrap import poisson_sql
from murmurate.operators import reports
from murmurate.plans.catalog import query, table
from murmurate.plans.more import wav
from murmurate.sources import audio, report_pages


@query("""
WITH a AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, '') AS label, coalesce(n_chars / 8000.0, 0) AS said, text, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, (ascii(ch) - 128) / 128.0 AS v FROM (SELECT doc_id, unnest(string_split(t, '')) AS ch FROM a WHERE t <> '' AND said <= 2.0)),
g AS (SELECT doc_id, count(*) AS n, sqrt(avg(v * v)) AS rms FROM s GROUP BY doc_id),
m AS (SELECT a.*, coalesce(n, 0) / 8000.0 AS actual_s, coalesce(rms, 0) AS rms, n IS NULL AS silent, len(regexp_extract_all(label, '[A-Za-z]+')) + len(regexp_extract_all(label, '[0-9]+')) AS units FROM a LEFT JOIN g USING (doc_id) WHERE said <= 2.0),
f AS (SELECT *, CASE WHEN actual_s > 0 THEN units / actual_s ELSE 0 END AS rate FROM m),
h AS (SELECT *, list_filter([CASE WHEN abs(actual_s - said) > greatest(0.1, actual_s * 0.05) THEN 'duration_mismatch' END, CASE WHEN units = 0 THEN 'no_lexical_label' END, CASE WHEN rms < pow(10, -55 / 20.0) THEN 'near_silent' END], lambda x: x IS NOT NULL) AS hard, list_filter([CASE WHEN actual_s < 0.2 THEN 'ultra_short_under_0.2s' WHEN actual_s < 0.5 THEN 'very_short_under_0.5s' END, CASE WHEN rms >= pow(10, -55 / 20.0) AND rms < pow(10, -42 / 20.0) THEN 'low_volume' END, CASE WHEN silent THEN 'many_zero_samples' END, CASE WHEN units > 0 AND rate < 0.35 THEN 'label_rate_too_low' END, CASE WHEN rate > CASE WHEN lang = 'en' THEN 8.0 ELSE 12.0 END THEN 'label_rate_too_high' END], lambda x: x IS NOT NULL) AS soft FROM f),
v AS (SELECT lang, CASE WHEN text IS NULL THEN said ELSE actual_s END AS sec, CASE WHEN text IS NULL OR len(hard) > 0 THEN 'reject' WHEN len(soft) > 0 THEN 'review' ELSE 'keep' END AS decision, CASE WHEN text IS NULL THEN ['decode_error'] ELSE list_concat(hard, soft) END AS flags FROM h),
l AS (SELECT 'scanned' AS kind, NULL AS decision, NULL AS name, said AS sec FROM a UNION ALL SELECT 'selected', NULL, NULL, sec FROM v UNION ALL SELECT 'decision', decision, NULL, sec FROM v UNION ALL SELECT 'language', decision, lang, sec FROM v UNION ALL SELECT 'bucket', decision, CASE WHEN sec < 0.5 THEN '0-0.5s' WHEN sec < 1.0 THEN '0.5-1s' WHEN sec < 1.5 THEN '1-1.5s' ELSE '1.5-2s' END, sec FROM v UNION ALL SELECT 'flag', NULL, unnest(flags), sec FROM v)
SELECT kind, decision, name, count(*) AS n, round(sum(sec) / 3600, 4)::DOUBLE AS hours FROM l GROUP BY kind, decision, name
""")
def screening_report(spark, d):
    """The texts as WAV bytes of 8000 samples a second, labelled with their source, screened up to two seconds."""
    r = table(spark, d, "documents").select(wav(F.col("text")).alias("audio"), (F.col("n_chars") / 8000.0).alias("said"), "lang", F.coalesce("source", F.lit("")).alias("label"))
    return audio.screening_report(r.repartition(spark.sparkContext.defaultParallelism), "audio", "said", "lang", "label")


#: A run's figures from the texts: different words, long words, marks and vowels by the thousand; the comment is the text.
RUN = """
w AS (SELECT doc_id, lang, lang AS code, text AS comment, length(text) AS c, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, len(regexp_extract_all(text, '[.,;:]')) AS marks, len(regexp_extract_all(text, '[aeiou]')) AS vowels FROM documents),
r AS (SELECT doc_id, lang, code, comment, CASE WHEN len(w) > 0 THEN floor(1000 * len(list_distinct(w)) / len(w)) / 1000.0 END AS gold, CASE WHEN len(w) > 0 THEN floor(1000 * len(list_filter(w, lambda x: length(x) > 4)) / len(w)) / 1000.0 END AS asr, CASE WHEN c > 0 THEN floor(1000 * marks / c) / 10.0 END AS cer, CASE WHEN c > 0 THEN floor(1000 * vowels / c) / 10.0 END AS zh_cer FROM w)
"""
MARKER, DEGENERATE = "token", ("es",)


def run(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", F.col("lang").alias("code"), F.col("text").alias("comment"), F.length("text").alias("c"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    share = lambda n, of, by: F.when(F.col(of) > 0, F.floor(1000 * n / F.col(of)) / by)
    t = t.withColumn("n", F.size("w"))
    return t.select(
        "doc_id",
        "lang",
        "code",
        "comment",
        share(F.size(F.array_distinct("w")), "n", 1000.0).alias("gold"),
        share(F.size(F.filter("w", lambda x: F.length(x) > 4)), "n", 1000.0).alias("asr"),
        share(F.regexp_count("comment", F.lit("[.,;:]")), "c", 10.0).alias("cer"),
        share(F.regexp_count("comment", F.lit("[aeiou]")), "c", 10.0).alias("zh_cer"),
    )


STATS = f"""
s AS (SELECT lang, max(code) AS code, count(*) AS n, avg(cer) AS cer, avg(zh_cer) AS zh_cer, avg(gold) AS gold, avg(asr) AS asr, count(*) FILTER (WHERE contains(coalesce(comment, ''), '{MARKER}')) AS failed FROM r WHERE gold IS NOT NULL GROUP BY lang),
k AS (SELECT lang, rank() OVER (ORDER BY zh_cer) + (count(*) OVER (PARTITION BY zh_cer) - 1) / 2.0 AS rank_cer, rank() OVER (ORDER BY gold DESC) + (count(*) OVER (PARTITION BY gold) - 1) / 2.0 AS rank_gold FROM s WHERE coalesce(code, '') NOT IN ('{DEGENERATE[0]}'))
"""


@query(f"""
WITH {RUN}, {STATS},
b AS (SELECT lang, turn, count(*) AS n, sum(w * gold) / nullif(sum(w), 0) AS stat FROM (SELECT lang, turn, gold, {poisson_sql('doc_id', 'turn', reports.SEED)} AS w FROM r, range({reports.ROUNDS}) t(turn) WHERE gold IS NOT NULL) GROUP BY ALL),
i AS (SELECT lang, max(n) AS n, list_sort(list(coalesce(stat, 0))) AS x FROM b GROUP BY lang)
SELECT s.lang, code, s.n, round(cer, 4) AS cer, round(zh_cer, 4) AS zh_cer, round(gold, 4) AS gold, round(asr, 4) AS asr, failed, round(CASE WHEN i.n > 1 THEN x[{reports.ROUNDS * 25 // 1000 + 1}] END, 4) AS lo, round(CASE WHEN i.n > 1 THEN x[{reports.ROUNDS * 975 // 1000 + 1}] END, 4) AS hi, rank_cer::DOUBLE AS rank_cer, rank_gold::DOUBLE AS rank_gold, (rank_cer - rank_gold)::DOUBLE AS shift
FROM s JOIN i ON s.lang IS NOT DISTINCT FROM i.lang LEFT JOIN k ON s.lang IS NOT DISTINCT FROM k.lang
""")
def language_ranks(spark, d):
    """Languages with intervals of 4000 rounds, ranked by the literal rate and by the score."""
    s = reports.ranked_languages(reports.language_stats(run(spark, d), "doc_id", MARKER), DEGENERATE)
    return s.select("lang", "code", "n", *[F.round(c, 4).alias(c) for c in ("cer", "zh_cer", "gold", "asr")], "failed", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "rank_cer", "rank_gold", "shift")


@query(f"WITH {RUN}, {STATS} SELECT count(*) AS languages, round(corr(rank_cer, rank_gold), 6) AS rho, coalesce(max(abs(rank_cer - rank_gold)), 0)::DOUBLE AS max_shift FROM k")
def rank_agreement(spark, d):
    s = run(spark, d).where("gold is not null").groupBy("lang").agg(F.max("code").alias("code"), F.avg("zh_cer").alias("zh_cer"), F.avg("gold").alias("gold"))
    return reports.agreement(reports.ranked_languages(s, DEGENERATE)).withColumn("rho", F.round("rho", 6))


@query(f"WITH {RUN}, q AS (SELECT *, gold IS NOT NULL AS scored, gold IS NOT NULL AND NOT contains(coalesce(comment, ''), '{MARKER}') AS clean FROM r) SELECT count(*) AS rows, round(avg(gold) FILTER (WHERE scored), 4) AS gold, round(avg(asr) FILTER (WHERE scored), 4) AS asr, round(avg(zh_cer) FILTER (WHERE scored), 4) AS zh_cer, round(avg(gold) FILTER (WHERE clean), 4) AS clean_gold, round(avg(cer) FILTER (WHERE clean), 4) AS clean_cer, count(*) FILTER (WHERE scored) - count(*) FILTER (WHERE clean) AS failed FROM q")
def report_cards(spark, d):
    c = reports.cards(run(spark, d), MARKER)
    return c.select("rows", *[F.round(x, 4).alias(x) for x in ("gold", "asr", "zh_cer", "clean_gold", "clean_cer")], "failed")


@query("WITH i AS (SELECT l_returnflag AS dataset, l_orderkey AS recording, l_discount::DOUBLE AS score, CAST(l_quantity AS BIGINT) AS chars FROM lineitem), r AS (SELECT dataset, recording, avg(score) AS m FROM i GROUP BY ALL), a AS (SELECT dataset, avg(m) AS recording_macro, count(*) AS n_recordings FROM r GROUP BY dataset), b AS (SELECT dataset, sum(score * chars) / sum(chars) AS char_weighted, avg(score) AS segment_micro, count(*) AS n_segments FROM i GROUP BY dataset) SELECT dataset, round(recording_macro, 6) AS recording_macro, round(char_weighted, 6) AS char_weighted, round(segment_micro, 6) AS segment_micro, n_segments, n_recordings, round((SELECT avg(recording_macro) FROM a), 6) AS dataset_macro, round((SELECT avg(m) FROM r), 6) AS all_recordings FROM a JOIN b USING (dataset)")
def segment_averages(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_orderkey").alias("recording"), F.col("l_discount").cast("double").alias("score"), F.col("l_quantity").cast("long").alias("chars"))
    s = reports.segment_averages(i)
    return s.select("dataset", "n_segments", "n_recordings", *[F.round(c, 6).alias(c) for c in ("recording_macro", "char_weighted", "segment_micro", "dataset_macro", "all_recordings")])


@query(r"""
WITH r AS (SELECT doc_id, doc_id % 17 <> 0 AS ok, coalesce(text, '') AS hyp, doc_id % 5 = 0 AS chinese, CASE WHEN doc_id % 7 > 0 THEN n_chars % 60 - 2.0 END AS al, doc_id % 20 AS src, doc_id % 3 = 0 AS tokens, doc_id % 2 = 0 AS wants, doc_id % 4 = 0 AS has, (doc_id % 10) / 10.0 AS err FROM documents),
k AS (SELECT *, length(regexp_replace(hyp, '\s', '', 'g')) AS solid, len(regexp_extract_all(hyp, '[一-鿿]')) AS han, len(regexp_extract_all(hyp, '[A-Za-z]')) AS latin FROM r),
b AS (SELECT *, list_filter([CASE WHEN solid = 0 THEN 'empty' END, CASE WHEN solid > 0 AND chinese AND han / solid < 0.5 THEN 'not_chinese' END, CASE WHEN solid > 0 AND NOT chinese AND latin / solid < 0.5 THEN 'not_latin' END, CASE WHEN al IS NULL THEN 'no_lag' WHEN al < 0 THEN 'negative_lag' WHEN src <> 0 AND al > src * 2 + 6 THEN 'large_lag' END, CASE WHEN wants AND NOT has THEN 'no_speech' END, CASE WHEN solid > 0 AND err > 0.6 THEN 'poor_speech' END], lambda x: x IS NOT NULL) AS bad FROM k)
SELECT CASE WHEN ok THEN len(bad) = 0 ELSE false END AS ok, CASE WHEN ok THEN array_to_string(list_concat(bad, CASE WHEN tokens THEN ['from_tokens'] ELSE [] END), ',') ELSE 'failed' END AS warnings, count(*) AS n FROM b GROUP BY ALL
""")
def stream_warnings(spark, d):
    k = F.col("doc_id")
    r = {"ok": k % 17 != 0, "hyp": F.col("text"), "chinese": k % 5 == 0, "al_s": F.when(k % 7 > 0, F.col("n_chars") % 60 - 2.0), "src_s": k % 20, "from_tokens": k % 3 == 0, "wants_speech": k % 2 == 0, "has_speech": k % 4 == 0, "speech_err": (k % 10) / 10.0}
    w = table(spark, d, "documents").select(reports.stream_warnings(r).alias("w"))
    return w.groupBy(F.col("w.ok").alias("ok"), F.array_join("w.warnings", ",").alias("warnings")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT doc_id, coalesce(lang, '?') AS lang_name, 'doc-' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'fine' ELSE '' END AS grade, CASE WHEN doc_id % 2 = 0 THEN 'a <b> & "c"' ELSE '' END AS comment, CASE WHEN doc_id % 9 > 0 THEN doc_id % 50 + 0.25 END::DOUBLE AS cer, CASE WHEN doc_id % 9 > 0 THEN CASE WHEN doc_id % 50 + 0.25 <= 10 THEN 'ok' WHEN doc_id % 50 + 0.25 < 30 THEN 'mid' ELSE 'bad' END ELSE '' END AS cls, (CASE WHEN doc_id % 9 > 0 THEN NULL ELSE 0.5 END)::DOUBLE AS f1_zh, sha256(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS gold_sha, coalesce(source, '') AS hyp_mt FROM documents
""")
def report_rows(spark, d):
    """Every document as the detail row of a report page of its own, and the row read back from the page."""
    k = F.col("doc_id")
    some = k % 9 > 0
    r = table(spark, d, "documents").select(
        "doc_id",
        F.coalesce("lang", F.lit("?")).alias("lang_name"),
        F.concat(F.lit("doc-"), k.cast("string")).alias("id"),
        F.col("source").alias("dur_desc"),
        F.when(k % 2 == 0, "fine").alias("grade"),
        F.when(k % 2 == 0, 'a <b> & "c"').alias("comment"),
        F.when(some, k % 50 + 0.25).alias("cer"),
        F.lit(None).cast("double").alias("wer"),
        F.when(some, k % 50 / 2.0).alias("zh_cer"),
        F.when(~some, F.lit(0.25)).alias("f1_asr"),
        F.when(~some, F.lit(0.5)).alias("f1_zh"),
        F.col("text").alias("gold_src"),
        F.lit("").alias("hyp_asr"),
        F.lit("").alias("gold_zh"),
        F.col("source").alias("hyp_mt"),
    )
    pages = r.select("doc_id", F.concat(F.lit(f"<h2>{report_pages.DETAIL}</h2><table><tr><th>-</th></tr>"), report_pages.detail_lines(r), F.lit("</table>")).alias("html"))
    back = report_pages.scored_rows(report_pages.table_rows(pages, "html", "doc_id"), "doc_id")
    return back.select("doc_id", "lang_name", "id", "grade", "comment", "cer", "cls", "f1_zh", F.sha2(F.regexp_replace("gold_src", r"\s", "").cast("binary"), 256).alias("gold_sha"), "hyp_mt")
