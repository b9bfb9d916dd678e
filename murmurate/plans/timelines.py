"""Queries on recordings and runs as they are shown: timelines, previews, language summaries, cards of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmurate.operators import timelines
from murmurate.plans.catalog import query, table

UNITS = r"len(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+|[㐀-鿿]'))"


@query(f"""
WITH s AS (SELECT conv_id AS id, turn AS nth, coalesce(text, '') AS t, greatest(1, {UNITS.format('text')}) AS w FROM conversations WHERE conv_id % 3 > 0),
w AS (SELECT id, nth, t, w, row_number() OVER (PARTITION BY id ORDER BY nth) AS k, sum(w) OVER (PARTITION BY id ORDER BY nth) AS upto, sum(w) OVER (PARTITION BY id) AS total, id % 3 = 1 OR count(*) FILTER (WHERE nth % 4 <> 3) OVER (PARTITION BY id) = count(*) OVER (PARTITION BY id) AS timed FROM s)
SELECT id, k AS index, round(CASE WHEN timed THEN nth * 2.5 ELSE (id % 7 + 60) * (upto - w) / total END, 3)::DOUBLE AS start_s, round(CASE WHEN timed THEN nth * 2.5 + 2 ELSE (id % 7 + 60) * upto / total END, 3)::DOUBLE AS end_s, t AS source_text, CASE WHEN timed THEN 'exact' ELSE 'estimated' END AS kind FROM w
UNION ALL SELECT id, k + 1, round(k * (id % 7 + 60) / n, 3)::DOUBLE, round((k + 1) * (id % 7 + 60) / n, 3)::DOUBLE, '', 'estimated' FROM (SELECT id, n, unnest(range(n)) AS k FROM (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 7 = 0 THEN 3 ELSE 4 END AS n FROM conversations WHERE conv_id % 3 = 0))
""")
def source_timeline(spark, d):
    """Conversations as recordings: with times, with some times, and without segments or text."""
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "id")
    recordings = c.select("id").distinct().select("id", (F.col("id") % 7 + 60.0).alias("duration_s"), F.lit("").alias("source_text"), F.lit(None).cast("string").alias("ref_text"))
    there = (F.col("id") % 3 == 1) | (F.col("turn") % 4 != 3)
    s = c.where("id % 3 > 0").select("id", F.col("turn").alias("nth"), F.when(there, F.col("turn") * 2500).alias("start_ms"), (F.col("turn") * 2500 + 2000).alias("end_ms"), F.col("text").alias("source_text"), F.lit("").alias("ref_text"))
    return timelines.source_timeline(recordings, s).drop("ref_text")


@query(f"""
WITH s AS (SELECT conv_id AS id, turn AS nth, trim(coalesce(text, '')) AS text, CASE WHEN (conv_id + turn) % 3 > 0 THEN 100.0 - turn * 1.5 END AS e FROM conversations WHERE conv_id % 2 = 0),
g AS (SELECT id, nth, text, least(90.0, greatest(0.0, e)) AS e FROM s WHERE e IS NOT NULL AND text <> '')
SELECT id, row_number() OVER (PARTITION BY id ORDER BY e, nth) AS index, round(least(90.0, greatest(0.0, e)), 3)::DOUBLE AS end_s, text, 'event' AS kind FROM g
UNION ALL SELECT id, 1, 90.0, 'conversation ' || id, 'estimated' FROM (SELECT DISTINCT conv_id AS id FROM conversations) WHERE id NOT IN (SELECT id FROM g)
""")
def translation_events(spark, d):
    """Turns of even conversations as saved stretches, some without an end; the others have one sentence."""
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "id")
    recordings = c.select("id").distinct().select("id", F.lit(90.0).alias("duration_s"), F.concat(F.lit("conversation "), F.col("id").cast("string")).alias("hyp"))
    end = F.when((F.col("id") + F.col("turn")) % 3 > 0, (100 - F.col("turn") * 1.5).cast("string")).otherwise("no number")
    saved = c.where("id % 2 = 0").select("id", F.col("turn").alias("nth"), F.lit(None).cast("string").alias("start_s"), end.alias("end_s"), F.lit(None).cast("string").alias("emitted_at_s"), "text")
    return timelines.translation_events(recordings, saved).select("id", "index", "end_s", "text", "kind")


@query("SELECT doc_id AS id, CASE WHEN source = 'src1' THEN coalesce(text, '') ELSE coalesce(text, '')[1:400] END AS source_text, length(coalesce(text, '')) AS source_chars, CASE WHEN doc_id % 2 = 0 THEN 7 WHEN doc_id % 3 = 0 THEN 2 END::BIGINT AS segment_count, coalesce(source = 'src1', false) AS longform FROM documents")
def preview_items(spark, d):
    """Previews of all documents; those of one source are long forms and shown whole."""
    k = F.col("doc_id")
    r = table(spark, d, "documents").select(k.alias("id"), F.col("text").alias("source_text"), F.lit("").alias("ref_text"), F.when(k % 3 == 0, F.array(F.lit(1), F.lit(2))).alias("segments"), F.when(k % 2 == 0, 7).alias("segment_count"), F.array(F.lit("x")).alias("terms"), F.lit("").alias("task"), "source")
    return timelines.previews(r, F.coalesce(F.col("source") == "src1", F.lit(False))).select("id", "source_text", "source_chars", "segment_count", "longform")


@query("""
WITH s AS (SELECT source, doc_id % 11 <> 0 AS ok, coalesce(lang, '?') || CASE WHEN doc_id % 4 = 0 THEN ' north' ELSE '' END AS label, CASE WHEN doc_id % 6 > 0 THEN (n_chars % 100) / 128.0 END AS c, CASE WHEN doc_id % 5 = 0 THEN (n_chars % 16) / 16.0 END AS r FROM documents),
l AS (SELECT source, label, count(*) AS n FROM s WHERE ok GROUP BY ALL),
m AS (SELECT source, count(*) AS n_labels, string_agg(label || '=' || n, ',' ORDER BY n DESC, label) AS labels FROM l GROUP BY source)
SELECT s.source, 200 AS n_expected, count(*) AS n_processed, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_fail, round(count(*) FILTER (WHERE ok) / count(*), 6) AS coverage, round(count(*) / 200, 6) AS progress, coalesce(any_value(n_labels), 0) AS n_labels, round(avg(c) FILTER (WHERE ok), 6) AS confidence_mean, round(avg(r) FILTER (WHERE ok), 6) AS rtf_mean, coalesce(any_value(labels), '') AS labels FROM s LEFT JOIN m ON s.source IS NOT DISTINCT FROM m.source GROUP BY s.source
""")
def lid_runs(spark, d):
    """Each source as a run of language identification."""
    k = F.col("doc_id")
    s = table(spark, d, "documents").select("source", (k % 11 != 0).alias("ok"), F.lit(None).cast("string").alias("label"), F.coalesce("lang", F.lit("?")).alias("pred_language"), F.when(k % 4 == 0, "north").alias("pred_dialect"), F.when(k % 6 > 0, F.col("n_chars") % 100 / 128.0).alias("confidence"), F.when(k % 5 == 0, F.col("n_chars") % 16 / 16.0).alias("service_rtf"), F.lit(200).alias("e"))
    r = timelines.lid_summary(s, "source", expected="e")
    return r.withColumn("labels", F.array_join(F.transform("labels", lambda x: F.concat_ws("=", x["label"], x["count"].cast("string"))), ","))


@query("""
WITH e AS (SELECT user_id AS job, ts, event_id AS seq, event_type AS t, event_id % 10 + 1 AS i, CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'segment' END AS phase, CASE WHEN event_id % 2 = 0 THEN 'text ' || event_id ELSE '' END AS said FROM events),
k AS (SELECT *, CASE t WHEN 'view' THEN (CASE WHEN phase = 'completed' THEN i ELSE i - 1 END) || '/10' WHEN 'click' THEN i || '/20' WHEN 'purchase' THEN '0/' || i END AS told FROM e)
SELECT job, arg_max(told, (ts, seq)) FILTER (WHERE told IS NOT NULL) AS progress, arg_max(i, (ts, seq)) FILTER (WHERE t = 'view') AS sample_index, arg_max(said, (ts, seq)) FILTER (WHERE t = 'view') AS latest_text, arg_max(phase, (ts, seq)) FILTER (WHERE t = 'view' AND phase = 'segment' AND said <> '') AS latest_phase, max(ts) FILTER (WHERE t = 'view') AS heartbeat FROM k GROUP BY job
""")
def job_cards(spark, d):
    """Each user's events as the output of a job."""
    k = F.col("event_id")
    i = k % 10 + 1
    record = F.to_json(F.struct(i.alias("sample_index"), F.lit(10).alias("sample_total"), F.when(k % 3 == 0, "completed").otherwise("segment").alias("phase"), F.when(k % 2 == 0, F.concat(F.lit("text "), k.cast("string"))).otherwise("").alias("latest_text")))
    t = F.col("event_type")
    line = F.when(t == "view", F.concat(F.lit("INFO " + timelines.MARKER), record)).when(t == "click", F.concat(F.lit("at "), i.cast("string"), F.lit("/20… fine"))).when(t == "purchase", F.concat(F.lit("待跑 "), i.cast("string"))).otherwise("3/4 of a word")
    lines = table(spark, d, "events").select(F.col("user_id").alias("job"), "ts", k.alias("seq"), line.alias("line"))
    c = timelines.job_cards(lines, F.lit("2026-01-01").cast("timestamp"))
    return c.select("job", "progress", F.col("record.sample_index").alias("sample_index"), F.col("record.latest_text").alias("latest_text"), "latest_phase", "heartbeat")
