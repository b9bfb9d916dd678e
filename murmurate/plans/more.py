"""Queries on segments, traces, runs and curation."""


import pandas as pd

from murmurate.functions.blocks import matching
from murmurate.functions.der import changed
from murmurate.sources import audio, corpora
from murmurate.streaming import sessions
from murmurate.plans.catalog import PAIRS, F, Window, bootstrap_groups, curation, diarization_error, english, poisson_interval, poisson_sql, query, ranking, spread, table, textnorm, trace, whole, whole_pairs

SEG = "seg AS (SELECT conv_id AS id, turn AS segment_id, role, text, length(text) / 10.0 AS dur, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) / 10.0 AS end_s FROM conversations)"


def segments(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("segment_id"), "role", "text", (F.length("text") / 10.0).alias("dur"), (F.sum(F.length("text")).over(w) / 10.0).alias("end_s"))


def trace_events(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "view", "append").when(F.col("event_type") == "click", "replace").when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "signup", "final")
    return e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), op.alias("op"), F.concat("event_type", F.get_json_object("props", "$.k")).alias("text"), F.col("value").alias("wall_s"))


RUNS = "runs AS (SELECT l_returnflag AS arm, l_linestatus AS dataset, avg(l_discount) AS quality, avg(l_tax) AS err, count(*) AS n FROM lineitem GROUP BY ALL)"


def runs(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("dataset")).agg(F.avg("l_discount").alias("quality"), F.avg("l_tax").alias("err"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {RUNS} SELECT arm, dataset, CASE WHEN count(*) OVER (PARTITION BY dataset) >= 2 THEN 1.0 - (rank() OVER (PARTITION BY dataset ORDER BY n DESC) + (count(*) OVER (PARTITION BY dataset, n) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY dataset) - 1) END::DOUBLE AS score FROM runs")
def arm_rank_score(spark, d):
    return ranking.rank_score(runs(spark, d), "n", "dataset").select("arm", "dataset", F.col("score").cast("double").alias("score"))


@query("WITH o AS (SELECT o_orderpriority AS grp, o_totalprice AS a, o_custkey AS b FROM orders), r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY a) + (count(*) OVER (PARTITION BY grp, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY grp ORDER BY b) + (count(*) OVER (PARTITION BY grp, b) - 1) / 2.0 AS rb FROM o) SELECT grp, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r GROUP BY grp")
def spearman_rank(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b"))
    return ranking.spearman(o, "a", "b", "grp").withColumn("rho", F.round("rho", 6))


@query("WITH s AS (SELECT l_orderkey, l_returnflag, l_quantity, l_discount FROM lineitem), r AS (SELECT l_returnflag, l_orderkey, avg(l_discount) AS m FROM s GROUP BY ALL) SELECT s.l_returnflag, round(avg(m), 6) AS macro, round(any_value(w), 6) AS weighted, round(any_value(u), 6) AS micro FROM r s JOIN (SELECT l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) AS w, avg(l_discount) AS u FROM s GROUP BY ALL) t USING (l_returnflag) GROUP BY ALL")
def three_level_averages(spark, d):
    li = table(spark, d, "lineitem")
    # one shuffle on the recording, then sums of sums
    r = li.groupBy("l_returnflag", "l_orderkey").agg(F.avg("l_discount").alias("m"), F.sum("l_discount").alias("s"), F.count("l_discount").alias("n"), F.sum(F.col("l_discount") * F.col("l_quantity")).alias("ws"), F.sum("l_quantity").alias("w"))
    return r.groupBy("l_returnflag").agg(F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum("ws") / F.sum("w"), 6).alias("weighted"), F.round(F.sum("s") / F.sum("n"), 6).alias("micro"))


@query(f"WITH {RUNS} SELECT arm, dataset, n, row_number() OVER (ORDER BY n < 100, n DESC, arm, dataset) AS place FROM runs")
def leaderboard_order(spark, d):
    return runs(spark, d).select("arm", "dataset", "n", F.row_number().over(Window.orderBy(F.col("n") < 100, F.desc("n"), "arm", "dataset")).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS delta FROM orders")
def result_history(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_totalprice").over(w).alias("before"), (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("delta"))


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def latest_per_model(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("o_orderkey"))
    return g


BUCKET = "CASE WHEN n_chars / 1000.0 < 0.5 THEN '<0.5' WHEN n_chars / 1000.0 < 1.0 THEN '0.5-1' WHEN n_chars / 1000.0 < 1.5 THEN '1-1.5' WHEN n_chars / 1000.0 <= 2.0 THEN '1.5-2' ELSE '>2' END"


@query(f"WITH b AS (SELECT lang, {BUCKET} AS bucket, n_chars FROM documents) SELECT lang, bucket, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM b GROUP BY GROUPING SETS ((lang, bucket), (lang), (bucket), ())")
def short_audio_report(spark, d):
    b = table(spark, d, "documents").select("lang", curation.duration_bucket(F.col("n_chars") / 1000.0).alias("bucket"), "n_chars")
    return b.groupingSets([["lang", "bucket"], ["lang"], ["bucket"], []], "lang", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY sha256(text) ORDER BY sha256('42:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 2")
def transcript_cap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("t"))
    return curation.cap_per(docs, F.col("t"), 2, curation.seeded(42, "doc_id"), "doc_id").select("doc_id", "lang")


@query("WITH g AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || lang || ':' || source), source) AS r, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, source FROM documents)) SELECT doc_id, CASE WHEN r <= least(greatest(1, CAST(round_even(n * 0.05, 0) AS INT)), n - 1) THEN 'validation' ELSE 'train' END AS split FROM documents JOIN g USING (lang, source)")
def speaker_split(spark, d):
    return curation.group_split(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", 0.05, 42).select("doc_id", "split")


@query("SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS k FROM documents) WHERE source <> 'src0' OR k <= 400")
def hash_cap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    hot = curation.cap_per(docs.where("source = 'src0'"), F.col("source"), 400, curation.seeded(7, "doc_id"), "doc_id")
    return docs.where("source <> 'src0'").unionByName(hot).select("doc_id")


@query("WITH s AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY sha256('3:' || source) LIMIT 5), k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('3:' || doc_id), doc_id) AS r FROM documents JOIN s USING (source)) SELECT doc_id, source FROM k WHERE r <= 4")
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    five = docs.select("source").distinct().orderBy(curation.seeded(3, "source")).limit(5)
    return curation.cap_per(docs.join(F.broadcast(five), "source"), F.col("source"), 4, curation.seeded(3, "doc_id"), "doc_id").select("doc_id", "source")


@query("SELECT item_id, sha256(item_id || chr(31) || text)[1:12] AS row_sha FROM benchmark")
def manifest_sha(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.substring(F.sha2(F.concat(F.col("item_id").cast("string"), F.lit("\x1f"), "text").cast("binary"), 256), 1, 12).alias("row_sha"))


@query("SELECT sha256(text) AS fp, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("fp")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("WITH r AS (SELECT coalesce(source, '') || '_' || sha256(coalesce(text, ''))[1:2] AS id, sha256(text) AS fp FROM documents), g AS (SELECT id, count(*) AS n, min(coalesce(fp, '-')) AS a, max(coalesce(fp, '-')) AS b FROM r GROUP BY id) SELECT id, n, sha256(a) AS first, sha256(b) AS last, CASE WHEN a <> b THEN 'conflict' WHEN n > 1 THEN 'repeat' ELSE 'single' END AS verdict FROM g")
def id_conflicts(spark, d):
    """Ids made of a source and a short digest, whose rows agree or not."""
    rows = table(spark, d, "documents").select(F.concat_ws("_", F.coalesce("source", F.lit("")), F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 2)).alias("id"), "text")
    return curation.resolve_ids(rows, "id", ["text"])


@query(f"WITH {SEG}, o AS (SELECT id, role AS who, end_s - dur AS a, end_s + 3 AS b FROM seg WHERE dur + 3 > 0), t AS (SELECT DISTINCT id, t FROM (SELECT id, a AS t FROM o UNION ALL SELECT id, b FROM o)), c AS (SELECT id, t AS a, lead(t) OVER (PARTITION BY id ORDER BY t) AS b FROM t), s AS (SELECT c.id, c.a, c.b, coalesce(string_agg(DISTINCT o.who, ',' ORDER BY o.who), '') AS who FROM c LEFT JOIN o ON o.id = c.id AND o.a <= c.a AND c.b <= o.b WHERE c.b IS NOT NULL GROUP BY ALL), m AS (SELECT *, coalesce(who <> lag(who) OVER (PARTITION BY id ORDER BY a), true) AS fresh FROM s), i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY id ORDER BY a) AS island FROM m) SELECT id, round(min(a), 3) AS start_s, round(max(b), 3) AS end_s, any_value(who) AS speakers, CASE WHEN any_value(who) = '' THEN 'silence' WHEN contains(any_value(who), ',') THEN 'overlap' ELSE 'single' END AS state FROM i GROUP BY id, island")
def speaker_states(spark, d):
    """Who speaks when in each conversation, every turn going on for three seconds after the next has begun."""
    s = segments(spark, d).select("id", F.col("role").alias("tier"), (F.col("end_s") - F.col("dur")).cast("double").alias("start_s"), (F.col("end_s") + 3).cast("double").alias("end_s"))
    return corpora.speaker_states(s).select("id", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.array_join("speakers", ",").alias("speakers"), "state")


def wav(text):
    """The bytes of a WAV file whose samples are the printable characters of a text; a null has none."""
    t = F.regexp_replace(text, "[^ -~]", "").cast("binary")
    word = lambda n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))
    size = F.octet_length(t)
    head = F.unhex(F.lit("57415645666d7420100000000100010040" + "1f0000401f000001000800" + "64617461"))
    return F.concat(F.lit("RIFF").cast("binary"), word(size + 36), head, word(size), t)


@query("WITH a AS (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents), s AS (SELECT doc_id, (ascii(ch) - 128) / 128.0 AS v FROM (SELECT doc_id, unnest(string_split(t, '')) AS ch FROM a WHERE t <> '')), g AS (SELECT doc_id, count(*) AS n, max(abs(v)) AS peak, sqrt(avg(v * v)) AS rms FROM s GROUP BY doc_id) SELECT a.doc_id, round(coalesce(n, 0) / 8000.0, 6)::DOUBLE AS actual_s, round(20 * log10(greatest(coalesce(peak, 0), 1e-12)), 2) AS peak_dbfs, round(20 * log10(greatest(coalesce(rms, 0), 1e-12)), 2) AS rms_dbfs, CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS zero_ratio FROM a LEFT JOIN g USING (doc_id)")
def audio_measures(spark, d):
    """Measures from bytes: each text's printable characters are the samples of an 8-bit WAV file at 8000 a second."""
    m = table(spark, d, "documents").select("doc_id", audio.measured(wav(F.col("text"))).alias("m"))
    return m.select("doc_id", F.round("m.actual_s", 6).alias("actual_s"), audio.dbfs(F.col("m.peak")).alias("peak_dbfs"), audio.dbfs(F.col("m.rms")).alias("rms_dbfs"), F.col("m.zero").alias("zero_ratio"))


CODES = ("en", "ar", "de", "fr", "es", "ru", "it", "pt", "nl", "pl", "tr", "vi", "id", "ja", "ko", "th", "zh", "yue", "sv", "uk", "en-US", "")


@query(f"WITH c AS (SELECT doc_id, (['{"', '".join(CODES)}'])[doc_id % {len(CODES)} + 1] AS code FROM documents) SELECT doc_id, CASE WHEN code = 'en' THEN 'en' WHEN code IN ('ar', 'de', 'fr', 'es', 'ru', 'it', 'pt', 'nl', 'pl', 'tr', 'vi', 'id', 'ko', 'th') THEN 'basic' WHEN code = 'ja' THEN 'ja' ELSE 'zh' END AS norm, CASE WHEN code IN ('en', 'ar', 'de', 'fr', 'es', 'ru', 'it', 'pt', 'nl', 'pl', 'tr', 'vi', 'id') THEN 'WER' ELSE 'CER' END AS metric FROM c")
def lang_router(spark, d):
    """Every code in turn."""
    code = F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("doc_id") % len(CODES)).cast("int"))
    return table(spark, d, "documents").select("doc_id", textnorm.router(code).alias("r")).select("doc_id", "r.norm", "r.metric")


@query(r"SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM benchmark")
def text_norm_basic(spark, d):
    return table(spark, d, "benchmark").select("item_id", textnorm.basic(F.col("text")).alias("norm"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def html_report_rows(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) / count(*) AS rate, avg(n_chars) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY lang ORDER BY n DESC, lang")
def lid_summary(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("quality") == 1) / F.count(F.lit(1))).alias("rate"), F.avg("n_chars").alias("mean_chars")).orderBy(F.desc("n"), "lang")


@query("SELECT doc_id, regexp_replace(text, 'token = \"[0-9a-f]+\"', 'token = \"***\"', 'g') AS redacted FROM documents WHERE contains(text, 'token = ')")
def config_redaction(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("token = "))).select("doc_id", F.regexp_replace("text", 'token = "[0-9a-f]+"', 'token = "***"').alias("redacted"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1) AS latin, len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1) < 0.5 AS spill FROM documents")
def language_spill(spark, d):
    ratio = F.regexp_count("text", F.lit("[A-Za-z]")) / F.greatest(F.length("text"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", ratio.alias("latin"), (ratio < 0.5).alias("spill"))


@query("SELECT p.pos AS position, d.doc_id, d.lang FROM (VALUES (0, 5), (1, 3), (2, 99999999), (3, 7)) p(pos, id) JOIN documents d ON d.doc_id = p.id")
def select_ids_in_order(spark, d):
    return curation.select_in_order(table(spark, d, "documents").select("doc_id", "lang"), [5, 3, 99999999, 7], "doc_id")[0].select(F.col("position").cast("int").alias("position"), "doc_id", "lang")


@query("SELECT doc_id, text[1:400] AS preview, length(text) AS n FROM documents")
def dataset_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 400).alias("preview"), F.length("text").cast("long").alias("n"))


@query("SELECT ('| ' || l_returnflag || ' | ' || count(*) || ' |') AS line FROM lineitem GROUP BY l_returnflag")
def markdown_table(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).select(F.format_string("| %s | %d |", "l_returnflag", "n").alias("line"))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return trace.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("WITH e AS (SELECT user_id, ts, value, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    """Sessions of each user: events no more than six hours apart."""
    s = sessions.sessions(table(spark, d, "events"), "user_id", "6 hours")
    return s.withColumn("total", F.round("total", 4))


@query("WITH e AS (SELECT *, event_id // 100 AS batch, ts + (hash_ * INTERVAL '1 minute') AS t FROM (SELECT *, (event_id * 7919) % 240 AS hash_ FROM events)), m AS (SELECT batch, max(t) AS t FROM e GROUP BY batch), b AS (SELECT batch, max(t) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m), l AS (SELECT e.*, coalesce(before - t > INTERVAL '90 minutes', false) AS late FROM e JOIN b USING (batch)) SELECT event_type, late, count(*) AS n, round(sum(value), 4) AS total FROM l GROUP BY ALL")
def late_rows(spark, d):
    """What a watermark of ninety minutes would drop from batches of a hundred events, whose times are shuffled by up to four hours."""
    shift = F.make_interval(mins=(F.col("event_id") * 7919 % 240).cast("int"))
    e = table(spark, d, "events").withColumn("batch", F.floor(F.col("event_id") / 100)).withColumn("ts", F.col("ts") + shift)
    late = sessions.lateness(e, "batch", "90 minutes")
    return late.groupBy("event_type", "late").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- Python where the semantics are sequential ------------------------------
@query()
def bootstrap_ci(spark, d):
    p = whole_pairs(spark, d).select("lang", "doc_id", whole.edit_distance(F.array_join("ref", ""), F.array_join("hyp", "")).cast("double").alias("edits"), F.length(F.array_join("ref", "")).cast("double").alias("n"))
    return bootstrap_groups(p, "lang", "doc_id", "edits", "n")


#: Rounds of the interval by weights, and its seed.
ROUNDS, SEED = 1000, 42


@query(f"WITH {PAIRS}, e AS (SELECT lang, doc_id, length(array_to_string(ref, '')) AS n, levenshtein(array_to_string(ref, ''), array_to_string(hyp, '')) AS edits FROM p1), w AS (SELECT lang, turn, n, edits, {poisson_sql('doc_id', 'turn', SEED)} AS w FROM e, range({ROUNDS}) r(turn)), s AS (SELECT lang, turn, count(*) AS n, sum(w * edits) / nullif(sum(w * n), 0) AS stat FROM w GROUP BY ALL), g AS (SELECT lang, max(n) AS n, list_sort(list(coalesce(stat, 0))) AS x FROM s GROUP BY lang) SELECT lang, n, CASE WHEN n > 1 THEN x[{ROUNDS * 25 // 1000 + 1}] END AS lo, CASE WHEN n > 1 THEN x[{ROUNDS * 975 // 1000 + 1}] END AS hi FROM g")
def bootstrap_poisson(spark, d):
    """The interval of the character error rate by weights drawn from each row's id, so a language is never in one task."""
    p = whole_pairs(spark, d).select("lang", "doc_id", whole.edit_distance(F.array_join("ref", ""), F.array_join("hyp", "")).alias("edits"), F.length(F.array_join("ref", "")).cast("long").alias("n"))
    return poisson_interval(p, ["lang"], "doc_id", "edits", "n", ROUNDS, SEED)


@query()
def zh_norm(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", textnorm.chinese_text(F.col("text")).alias("norm"))


@query()
def en_norm(spark, d):
    return spread(table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text")).select("doc_id", english.english_text(F.col("text")).alias("norm"))


@query()
def der(spark, d):
    s = segments(spark, d).select("id", F.struct((F.col("end_s") - F.col("dur")).alias("start"), F.col("end_s").alias("end"), F.col("role").alias("spk")).alias("s"))
    g = s.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s")).repartition(spark.sparkContext.defaultParallelism)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        # the hypothesis shifts every turn by half a second
        return v.map(lambda x: diarization_error([(a["start"], a["end"], a["spk"]) for a in x], [(a["start"] + 0.5, a["end"] + 0.5, "s" + a["spk"]) for a in x]))

    return g.select("id", score("s").alias("der"))


def blocks(ref, hyp):
    """struct(blocks, large): changed stretches of two texts, and those of eight characters or more."""

    def count(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        whole = r.notna() & h.notna()
        pairs = r[whole].tolist(), h[whole].tolist()
        b = [changed(x, y, z) for x, y, z in zip(*pairs, matching(*pairs), strict=True)]
        found = pd.DataFrame({"blocks": [len(x) for x in b], "large": [sum(y[4] for y in x) for x in b]}, index=r.index[whole], dtype="Int64")
        return found.reindex(r.index)

    return F.pandas_udf(count, "struct<blocks:long,large:long>")(ref, hyp)


@query()
def changed_blocks(spark, d):
    p = whole_pairs(spark, d).select("doc_id", F.array_join("ref", " ").alias("r"), F.array_join("hyp", " ").alias("h"))

    return p.select("doc_id", blocks(F.col("r"), F.col("h")).alias("c")).select("doc_id", "c.*")
