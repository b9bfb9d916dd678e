"""Queries on whole runs: comparison of arms, joins by rule, orders, samples, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmurate.operators import curation, runs, scoring
from murmurate.plans.catalog import query, table
from murmurate.plans.more import SEG, segments

ARMS = """
a AS (SELECT l_returnflag AS arm, CAST(l_linenumber % 4 AS VARCHAR) AS dataset, count(*) AS n, round(50 + 100 * avg(l_discount), 6)::DOUBLE AS chrF, round(avg(l_tax), 6)::DOUBLE AS source_asr_error_rate, round(count(*) FILTER (WHERE l_quantity > 48) / count(*), 6) AS fail_rate, round(count(*) FILTER (WHERE l_quantity < 3) / count(*), 6) AS retry_sample_rate, round(count(*) FILTER (WHERE l_quantity = 50 AND l_tax = 0) / count(*), 6) AS over_hard_max_rate, round(avg(l_extendedprice), 4)::DOUBLE AS e2e_p95_ms, round(avg(l_quantity), 6)::DOUBLE AS requests_per_minute, false AS low_coverage FROM lineitem GROUP BY ALL)
"""


def arms(spark, d):
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 6)
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), (F.col("l_linenumber") % 4).cast("string").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(50 + 100 * F.avg("l_discount"), 6).cast("double").alias("chrF"),
        F.round(F.avg("l_tax"), 6).cast("double").alias("source_asr_error_rate"),
        share(F.col("l_quantity") > 48).alias("fail_rate"),
        share(F.col("l_quantity") < 3).alias("retry_sample_rate"),
        share((F.col("l_quantity") == 50) & (F.col("l_tax") == 0)).alias("over_hard_max_rate"),
        F.round(F.avg("l_extendedprice"), 4).cast("double").alias("e2e_p95_ms"),
        F.round(F.avg("l_quantity"), 6).cast("double").alias("requests_per_minute"),
        F.lit(False).alias("low_coverage"),
    )


BROKEN = f"{ARMS}, g AS (SELECT *, max(chrF) OVER (PARTITION BY dataset) - chrF AS cg, source_asr_error_rate - min(source_asr_error_rate) OVER (PARTITION BY dataset) AS ag FROM a), r AS (SELECT arm, dataset, list_filter([CASE WHEN low_coverage OR fail_rate > 0.05 THEN 'coverage' END, CASE WHEN retry_sample_rate > 0.05 THEN 'retries' END, CASE WHEN over_hard_max_rate > 0.01 THEN 'hard_max' END, CASE WHEN cg > 1.5 THEN 'chrF_gap' END, CASE WHEN ag > 0.015 THEN 'source_error_gap' END], lambda x: x IS NOT NULL) AS reasons FROM g)"


@query(f"WITH {BROKEN} SELECT arm, dataset, array_to_string(reasons, ',') AS reasons FROM r")
def guardrails(spark, d):
    return runs.guardrails(arms(spark, d)).select("arm", "dataset", F.array_join("reasons", ",").alias("reasons"))


METRICS = " UNION ALL ".join(f"SELECT arm, dataset, '{c}' AS component, '{m}' AS metric, {'' if up else '-'}{m} AS value FROM a" for c, m, up in (("quality", "chrF", True), ("quality", "source_asr_error_rate", False), ("latency", "e2e_p95_ms", False), ("stability", "fail_rate", False), ("stability", "retry_sample_rate", False), ("cost", "requests_per_minute", False)))
COMPARED = f"{BROKEN}, m AS ({METRICS}), k AS (SELECT *, rank() OVER (PARTITION BY dataset, metric ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, metric, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY dataset, metric) AS n FROM m), s AS (SELECT arm, component, round(avg(1.0 - (rk - 1.0) / (n - 1)), 4)::DOUBLE AS score FROM k WHERE n >= 2 GROUP BY ALL), p AS (SELECT arm, max(score) FILTER (WHERE component = 'quality') AS quality, max(score) FILTER (WHERE component = 'latency') AS latency, max(score) FILTER (WHERE component = 'stability') AS stability, max(score) FILTER (WHERE component = 'cost') AS cost FROM s GROUP BY arm), f AS (SELECT arm, CAST(sum(len(reasons)) AS BIGINT) AS failures, list_sort(list(dataset)) AS ds FROM r GROUP BY arm), z AS (SELECT p.*, round(0.5 * quality + 0.25 * latency + 0.15 * stability + 0.1 * cost, 4) AS composite_score, failures, failures = 0 AS eligible, ds FROM p JOIN f USING (arm)), w AS (SELECT count(DISTINCT ds) = 1 AND list_sort(list(arm)) = ['A', 'N', 'R'] AS complete, min(arm) FILTER (WHERE eligible AND composite_score = (SELECT max(composite_score) FROM z WHERE eligible)) AS best FROM z)"


@query(f"WITH {COMPARED} SELECT arm, quality, latency, stability, cost, composite_score, eligible, failures, complete, CASE WHEN complete THEN best END AS winner FROM z, w")
def arm_comparison(spark, d):
    return runs.compare(arms(spark, d), ["A", "N", "R"]).drop("datasets")


@query("WITH g AS (SELECT CAST(l_linenumber % 4 AS VARCHAR) AS dataset, l_returnflag AS arm, count(*) AS n, count(*) FILTER (WHERE l_quantity > 40) AS a, count(*) FILTER (WHERE l_quantity > 45) AS b, count(*) FILTER (WHERE l_quantity > 49) AS e FROM lineitem GROUP BY ALL) SELECT arm, dataset, n AS n_total, a + b AS anomaly_count, CASE WHEN b > 0 THEN (a + b) / b END AS anomaly_rate, CASE WHEN b > 0 THEN e / b END AS segment_error_rate FROM g")
def wide_results(spark, d):
    g = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 4).cast("string").alias("dataset"), F.col("l_returnflag").alias("arm")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("l_quantity") > k).alias(c) for c, k in (("a", 40), ("b", 45), ("e", 49))])
    # as the result file says it, in JSON
    text = F.to_json(F.struct(F.col("n").alias("n_total"), F.struct(F.col("b").alias("n_requests"), F.col("e").alias("segment_error_count"), F.create_map(F.lit("short"), "a", F.lit("late"), "b").alias("anomaly_counts")).alias("simult_vad")))
    return runs.wide_rows(g.select("arm", "dataset", F.from_json(text, runs.SUMMARY).alias("summary"))).select("arm", "dataset", "n_total", "anomaly_count", "anomaly_rate", "segment_error_rate")


@query("WITH m(model, caps, ps, pt) AS (VALUES ('sse', ['asr', 'simult'], ['zh', 'de'], ['*']), ('std', ['asr'], NULL, NULL), ('adv', ['asr', 'translate_audio', 'hotwords'], ['*'], ['en'])), d AS (SELECT source || ' ' || (doc_id % 6) || ' ' || lang AS dataset, any_value(CASE doc_id % 3 WHEN 0 THEN ['translate_audio'] WHEN 1 THEN ['asr'] ELSE ['asr', 'hotwords'] END) AS needs, [lang] AS sources, any_value(CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'zh' END) AS target FROM documents GROUP BY source, doc_id % 6, lang) SELECT model, dataset FROM m, d WHERE len(list_filter(needs, lambda x: NOT (list_contains(caps, x) OR (x = 'translate_audio' AND list_contains(caps, 'simult'))))) = 0 AND (ps IS NULL OR (len(list_filter(sources, lambda s: NOT (list_contains(ps, '*') OR list_contains(ps, s)))) = 0 AND (list_contains(pt, '*') OR list_contains(pt, target))))")
def capability_match(spark, d):
    """Which models can be run on the data sets that the documents fall into (by source, language and task)."""
    pair = "struct<source:array<string>,target:array<string>>"
    m = spark.createDataFrame([("sse", ["asr", "simult"], [(["zh", "de"], ["*"])]), ("std", ["asr"], None), ("adv", ["asr", "translate_audio", "hotwords"], [(["*"], ["en"])])], f"model string, caps array<string>, pairs array<{pair}>")
    kind = F.col("doc_id") % 6
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    needs = F.when(kind % 3 == 0, words("translate_audio")).when(kind % 3 == 1, words("asr")).otherwise(words("asr", "hotwords"))
    s = table(spark, d, "documents").select("source", "lang", kind.alias("kind"), needs.alias("needs"), F.when(kind % 2 == 0, "en").otherwise("zh").alias("target")).distinct()
    return runs.compatible(m, s.select(F.concat_ws(" ", "source", "kind", "lang").alias("dataset"), "needs", F.array("lang").alias("sources"), "target"))


# ---- joins by rule ---------------------------------------------------------------
@query("SELECT c.c_custkey AS sentence_id, o.o_orderkey AS source_id, c.c_name AS ref_text FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def sentence_pairs(spark, d):
    """Many source recordings of a sentence, one reference text."""
    refs = table(spark, d, "customer").select(F.col("c_custkey").alias("sentence_id"), F.col("c_name").alias("ref_text"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("sentence_id"), F.col("o_orderkey").alias("source_id")).join(refs, "sentence_id")


@query("WITH s AS (SELECT conv_id, turn // 2 AS seg, text FROM conversations WHERE turn % 2 = 0), t AS (SELECT conv_id, turn // 2 AS seg, text FROM conversations WHERE turn % 2 = 1) SELECT s.conv_id, count(*) AS segments, sha256(string_agg(s.text, chr(10) ORDER BY seg)) AS source_sha, sha256(string_agg(t.text, chr(10) ORDER BY seg)) AS target_sha FROM s JOIN t USING (conv_id, seg) GROUP BY s.conv_id")
def aligned_documents(spark, d):
    """Segments that both sides have, in order; the texts of one document are joined."""
    c = table(spark, d, "conversations")
    side = lambda k, name: c.where(F.col("turn") % 2 == k).select("conv_id", F.floor(F.col("turn") / 2).alias("seg"), F.col("text").alias(name))
    both = side(0, "s").join(side(1, "t"), ["conv_id", "seg"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("segments"), F.array_sort(F.collect_list(F.struct("seg", "s", "t"))).alias("x"))
    text = lambda name: F.sha2(F.array_join(F.transform("x", lambda v: v[name]), "\n").cast("binary"), 256)
    return both.select("conv_id", "segments", text("s").alias("source_sha"), text("t").alias("target_sha"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, max(o_orderkey) AS o_orderkey, CAST(count(*) AS BIGINT) AS versions FROM orders JOIN customer ON CAST(c_custkey AS VARCHAR) = CAST(o_custkey AS VARCHAR) GROUP BY 1")
def meeting_minutes(spark, d):
    """Keys meet as text; of several versions the last one counts."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    n = o.groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("versions"))
    known = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return runs.last_by_key(o, F.col("o_custkey"), "o_orderkey").select("key", "o_orderkey").join(n, "key").join(known, "key")


@query("WITH w AS (SELECT o_custkey, o_orderkey FROM orders), a AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 13 <> 0), f AS (SELECT o_custkey FROM w GROUP BY 1 HAVING count(*) = count(*) FILTER (WHERE o_orderkey % 13 <> 0)) SELECT a.o_custkey, a.o_orderkey FROM a JOIN f USING (o_custkey)")
def complete_responses(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return runs.complete_groups(o, o.where("o_orderkey % 13 <> 0"), "o_custkey", "o_orderkey")


@query("WITH n AS (SELECT user_id, event_id % 7 AS sid, arg_max('seg-' || event_id, event_id) AS k FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT e.event_id, coalesce(n.k, CAST(e.event_id % 7 AS VARCHAR)) AS segment_key FROM events e LEFT JOIN n ON n.user_id = e.user_id AND n.sid = e.event_id % 7 WHERE e.event_type = 'click'")
def speech_keys(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 7).alias("segment_id"), F.col("event_id").alias("seq"))
    named = e.where("event_type = 'view'").withColumn("segment_key", F.concat(F.lit("seg-"), F.col("event_id").cast("string")))
    return runs.canonical_keys(e.where("event_type = 'click'").withColumn("segment_key", F.lit("")), named, "user_id").select("event_id", "segment_key")


@query("SELECT c_custkey AS id, 'memory' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'external' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def job_list(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return runs.with_external(c.where("id % 2 = 0").withColumn("origin", F.lit("memory")), c.where("id % 3 = 0").withColumn("origin", F.lit("external")), "id")


@query("SELECT conv_id, turn AS pos, role AS a, CAST(length(text) AS VARCHAR) AS b FROM conversations")
def zipped_segments(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("string").alias("n")))).alias("x"))
    part = lambda name, out: c.select("conv_id", F.transform("x", lambda v: v[name]).alias(out))
    return runs.zipped(part("role", "l"), part("n", "r"), "conv_id", "l", "r").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT user_id, bool_and(event_type <> 'error' OR event_id % 11 <> 0) AND bool_and(coalesce(CAST(json_extract(props, '$.k') AS BIGINT) < 99, false)) AS may_resume FROM events GROUP BY user_id")
def migration_guard(spark, d):
    """A log may be taken over only if every session proves where it is from."""
    k = F.get_json_object("props", "$.k").cast("long")
    s = table(spark, d, "events").select("user_id", F.when((F.col("event_type") != "error") | (F.col("event_id") % 11 != 0), "m1").otherwise("m2").alias("model"), F.when(k < 99, "auto").alias("mode"))
    return s.groupBy("user_id").agg(runs.same_provenance(s, ["model", "mode"], {"model": "m1", "mode": "auto"}).alias("may_resume"))


# ---- orders and samples ------------------------------------------------------------
@query("SELECT doc_id, lang FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 100")
def shuffled_limit(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").orderBy(curation.seeded(42, "doc_id"), "doc_id").limit(100)


@query("SELECT user_id, event_id, event_type = 'error' AS failed, value AS err, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', coalesce(value, 0) DESC, event_id) AS place FROM events")
def review_order(spark, d):
    """Each user's samples: judged ones first, the worst on top; failed ones last."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"), F.col("value").alias("err"))
    w = Window.partitionBy("user_id").orderBy("failed", F.coalesce("err", F.lit(0.0)).desc(), "event_id")
    return e.withColumn("place", F.row_number().over(w).cast("long"))


@query("SELECT ps, name, row_number() OVER (ORDER BY name, ps, p, model) AS place, model FROM (SELECT DISTINCT p_size AS ps, p_brand AS name, CASE p_size % 4 WHEN 0 THEN 'adv' WHEN 1 THEN 'sse' WHEN 2 THEN 'other' ELSE 'light' END AS model, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 99 ELSE 3 END AS p FROM part)")
def batch_order(spark, d):
    # Models in the order of a batch.
    first = ("adv", "sse", "std", "light")
    model = F.when(F.col("p_size") % 4 == 0, "adv").when(F.col("p_size") % 4 == 1, "sse").when(F.col("p_size") % 4 == 2, "other").otherwise("light")
    b = table(spark, d, "part").select(F.col("p_size").alias("ps"), F.col("p_brand").alias("name"), model.alias("model")).distinct()
    at = F.array_position(F.array(*[F.lit(m) for m in first]), F.col("model"))
    priority = F.when(at == 0, 99).otherwise(at - 1)
    # batches are few: brands times sizes
    return b.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name", "ps", priority, "model")).cast("long"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY sha256('42:' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source, source AS doc_id FROM documents)) SELECT d.doc_id, CASE WHEN k <= n // 2 THEN 'tune' ELSE 'eval' END AS part FROM documents d JOIN r USING (source)")
def half_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    groups = docs.select("source").distinct()
    whole = Window.partitionBy(F.lit(0))  # one row a source
    half = groups.select("source", F.row_number().over(whole.orderBy(curation.seeded(42, "source"), "source")).alias("k"), F.count(F.lit(1)).over(whole).alias("n"))
    return docs.join(half, "source").select("doc_id", F.when(F.col("k") <= F.floor(F.col("n") / 2), "tune").otherwise("eval").alias("part"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 30")
def worst_thirty(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(30)


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS good, count(*) FILTER (WHERE toxic = 1) AS harness_failures FROM documents JOIN labels USING (doc_id) WHERE lang NOT IN ('zh') GROUP BY lang")
def language_report(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id").where(~F.col("lang").isin("zh"))
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg((F.col("quality") == 1).cast("double")), 4).alias("good"), F.count_if(F.col("toxic") == 1).alias("harness_failures"))


# ---- sets ------------------------------------------------------------------------
@query("WITH e AS (SELECT conv_id, unnest(regexp_extract_all(text, '[^.]+')) AS s FROM conversations) SELECT conv_id, count(DISTINCT trim(s)) AS sentences, sha256(string_agg(DISTINCT trim(s), '|' ORDER BY trim(s))) AS sha FROM e WHERE trim(s) <> '' GROUP BY conv_id")
def key_sentences(spark, d):
    """Sentences that any of the annotators of a meeting chose, once each."""
    s = table(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[^.]+"), F.lit(0))).alias("s")).select("conv_id", F.trim("s").alias("s")).where("s <> ''").distinct()
    return s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("sentences"), F.sha2(F.array_join(F.array_sort(F.collect_list("s")), "|").cast("binary"), 256).alias("sha"))


@query("WITH e AS (SELECT json_keys(CASE WHEN event_id % 4 = 0 THEN '{\"k\": 1, \"lang\": 2}' ELSE props END) AS have FROM events), m AS (SELECT list_sort(list_filter(['k', 'lang', 'speaker'], lambda w: NOT list_contains(have, w))) AS missing FROM e) SELECT array_to_string(missing, ',') AS missing, 3 - len(missing) AS there, count(*) AS n FROM m GROUP BY ALL")
def schema_check(spark, d):
    """Wanted fields that the records of a table lack, and how many records lack them."""
    wanted = F.array(*[F.lit(c) for c in ("k", "lang", "speaker")])
    props = F.when(F.col("event_id") % 4 == 0, '{"k": 1, "lang": 2}').otherwise(F.col("props"))
    missing = F.array_sort(F.array_except(wanted, F.json_object_keys(props)))
    return table(spark, d, "events").groupBy(F.array_join(missing, ",").alias("missing"), (3 - F.size(missing)).alias("there")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, 'documents' AS origin FROM documents UNION ALL SELECT page_id, 'pages' FROM pages")
def union_of_sources(spark, d):
    """Sources that are there, one below the other; a missing one is left out and told."""
    from murmurate.sources.corpora import union_available

    return union_available(spark, {"documents": (f"{d}/documents.parquet", "doc_id"), "pages": (f"{d}/pages.parquet", "page_id"), "gone": (f"{d}/gone.parquet", "id")})[0]


# ---- timelines --------------------------------------------------------------------
@query(rf"WITH {SEG}, w AS (SELECT id, segment_id, greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9]+|[㐀-鿿]'))) AS w, sum(dur) OVER (PARTITION BY id) AS total FROM seg), c AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY segment_id) AS cum, sum(w) OVER (PARTITION BY id) AS all_ FROM w) SELECT id, segment_id, round(total * (cum - w) / all_, 3)::DOUBLE AS start_s, round(total * cum / all_, 3)::DOUBLE AS end_s FROM c")
def estimated_timeline(spark, d):
    """Segments without times share the recording by their words."""
    s = segments(spark, d).withColumn("w", scoring.text_weight(F.col("text")))
    by = Window.partitionBy("id")
    c = s.select("id", "segment_id", "w", F.sum("dur").over(by).alias("total"), F.sum("w").over(by).alias("all_"), F.sum("w").over(by.orderBy("segment_id")).alias("cum"))
    return c.select("id", "segment_id", F.round(F.col("total") * (F.col("cum") - F.col("w")) / F.col("all_"), 3).alias("start_s"), F.round(F.col("total") * F.col("cum") / F.col("all_"), 3).alias("end_s"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS fed, count(*) AS total, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 4) AS coverage, count(*) FILTER (WHERE event_type = 'error') > 0 AS is_partial FROM events GROUP BY user_id")
def longform_coverage(spark, d):
    fed = F.count_if(F.col("event_type") != "error")
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy("user_id").agg(fed.alias("fed"), n.alias("total"), F.round(fed / n, 4).alias("coverage"), (fed < n).alias("is_partial"))


@query("SELECT l_orderkey, CAST(sum(round_even(l_quantity * 0.62, 0)) AS BIGINT) AS frames, CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN round_even(l_quantity * 0.62, 0) ELSE 0 END) AS BIGINT) AS speech FROM lineitem GROUP BY l_orderkey")
def frame_labels(spark, d):
    """Spans of a label as frames of sixteen milliseconds (256 of 16000 samples)."""
    n = F.bround((F.col("l_quantity") * 0.62).cast("double"), 0).cast("int")
    f = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array_repeat(F.col("l_linenumber") % 2, n)).alias("label"))
    return f.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("frames"), F.sum("label").alias("speech"))


@query("WITH v AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS updates, count(*) FILTER (WHERE event_type = 'signup') AS done FROM events GROUP BY user_id), k AS (SELECT user_id, event_id % 7 AS seg, count(DISTINCT event_id % 3) AS speakers FROM events WHERE event_type = 'view' GROUP BY ALL), r AS (SELECT user_id, count(*) AS published, count(*) FILTER (WHERE speakers > 1) AS revised FROM k GROUP BY user_id), t AS (SELECT user_id, event_id % 7 AS seg, count(DISTINCT event_id % 2) AS voices, min(event_id) FILTER (WHERE event_type = 'view') AS a, min(event_id) FILTER (WHERE event_type = 'click') AS b, min(event_id) FILTER (WHERE event_type = 'purchase') AS c, min(event_id) FILTER (WHERE event_type = 'signup') AS e FROM events WHERE event_type <> 'error' GROUP BY ALL), o AS (SELECT user_id, round(avg(CASE WHEN voices = 1 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS consistency, round(avg(CASE WHEN coalesce(a <= b AND b <= c AND c <= e, false) THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS order_rate FROM t GROUP BY user_id) SELECT v.user_id, updates, coalesce(published, 0) AS published, coalesce(revised, 0) AS revised, round(coalesce(revised / published, 0.0), 4) AS revision_rate, consistency, order_rate FROM v LEFT JOIN r USING (user_id) LEFT JOIN o USING (user_id)")
def speaker_timeline(spark, d):
    """Segments of a session: published and revised labels, one voice, and the order of the four events of a segment."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 7).alias("seg"))
    first = lambda t: F.min(F.when(F.col("event_type") == t, F.col("event_id")))
    is_view = F.col("event_type") == "view"
    k = e.where("event_type <> 'error'").groupBy("user_id", "seg").agg(
        F.count_if(is_view).alias("views"),
        F.count_distinct(F.when(is_view, F.col("event_id") % 3)).alias("speakers"),
        F.count_distinct(F.col("event_id") % 2).alias("voices"),
        *[first(t).alias(t) for t in ("view", "click", "purchase", "signup")],
    )
    order = F.coalesce((F.col("view") <= F.col("click")) & (F.col("click") <= F.col("purchase")) & (F.col("purchase") <= F.col("signup")), F.lit(False))
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    g = k.groupBy("user_id").agg(F.sum("views").alias("updates"), F.count_if(F.col("views") > 0).alias("published"), F.count_if(F.col("speakers") > 1).alias("revised"), rate(F.col("voices") == 1).alias("consistency"), rate(order).alias("order_rate"))
    return g.withColumn("revision_rate", F.round(F.coalesce(F.try_divide("revised", "published"), F.lit(0.0)), 4))
