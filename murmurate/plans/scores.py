"""Queries of a score run: traces, literals, anomalies, languages, texts, review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmurate.functions import align, keywords, quantiles, whole
from murmurate.operators import curation, scoring
from murmurate.plans.catalog import PAIRS, query, table, whole_pairs
from murmurate.plans.more import SEG, blocks, segments, trace_events
from murmurate.streaming import trace

# ---- traces ----------------------------------------------------------------
#: Drafts start anew after each event that is no append; a final event starts the committed text anew.
EVENTS = """
e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'view' THEN 'append' WHEN 'click' THEN 'replace' WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'final' END AS op, event_type || CAST(json_extract(props, '$.k') AS VARCHAR) AS text, value FROM events),
k AS (SELECT *, sum(CASE WHEN op IN ('replace', 'commit', 'final') THEN 1 ELSE 0 END) OVER w AS r, sum(CASE WHEN op = 'final' THEN 1 ELSE 0 END) OVER w AS f FROM e WHERE op IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
s AS (SELECT *, coalesce(string_agg(CASE WHEN op IN ('append', 'replace') THEN text END, '') OVER (PARTITION BY user_id, r ORDER BY seq), '') AS draft, coalesce(string_agg(CASE WHEN op IN ('commit', 'final') THEN text END, ' ') OVER (PARTITION BY user_id, f ORDER BY seq), '') AS committed FROM k),
t AS (SELECT *, coalesce(lag(draft) OVER (PARTITION BY user_id ORDER BY seq), '') AS before FROM s),
u AS (SELECT *, CASE WHEN op = 'replace' THEN length(before) - len(list_filter(range(1, least(length(before), length(text)) + 1), lambda i: before[1:i] = text[1:i])) ELSE 0 END AS lost FROM t)
"""


@query(f"WITH {EVENTS} SELECT user_id, round(arg_min(value, seq) FILTER (WHERE draft <> '' OR committed <> ''), 3) AS ttfb_visible, round(arg_min(value, seq) FILTER (WHERE committed <> ''), 3) AS ttfb_stable, count(*) FILTER (WHERE op IN ('append', 'replace')) AS updates FROM u GROUP BY user_id")
def trace_summary(spark, d):
    return trace.summarize(trace_events(spark, d), "user_id").select("user_id", "ttfb_visible", "ttfb_stable", "updates")


@query(f"WITH {EVENTS}, g AS (SELECT user_id, count(*) FILTER (WHERE op IN ('append', 'replace')) AS updates, count(*) FILTER (WHERE lost > 0) AS revisions, CAST(sum(lost) AS BIGINT) AS revised_chars, length(replace(arg_max(text, seq) FILTER (WHERE op = 'final'), ' ', '')) AS size FROM u GROUP BY user_id) SELECT user_id, revisions, updates > 0 AS observable, CASE WHEN updates > 0 THEN round_even(revisions / updates, 4) END AS revision_rate, revised_chars, CASE WHEN updates > 0 AND size > 0 THEN round_even(revised_chars / size, 4) END AS churn_rate FROM g")
def trace_stability(spark, d):
    return trace.summarize(trace_events(spark, d), "user_id").select("user_id", "revisions", "observable", "revision_rate", "revised_chars", "churn_rate")


@query(f"WITH {EVENTS} SELECT user_id, seq, op, trim(committed || ' ' || draft) AS display_text, committed AS committed_text FROM u")
def trace_replay(spark, d):
    return trace.replay(trace_events(spark, d), "user_id")


@query("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS text FROM events), l AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY user_id ORDER BY seq), '') AS before FROM e) SELECT user_id, count(*) FILTER (WHERE text <> before) AS updates, count(*) FILTER (WHERE text <> before AND NOT starts_with(text, before)) AS revisions FROM l GROUP BY user_id")
def vendor_increments(spark, d):
    e = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.col("event_type").alias("text"))
    return trace.increments(e, "user_id")


@query(f"WITH {SEG}, w AS (SELECT id, segment_id, CAST(round(end_s * 1000) AS BIGINT) AS ms, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM seg) SELECT id, CAST(sum(n) AS BIGINT) AS units, CAST(sum(n * ms) AS BIGINT) AS delay_sum, max(ms) FILTER (WHERE n > 0) AS last_ms FROM w GROUP BY id")
def legacy_unit_delays(spark, d):
    s = segments(spark, d).withColumn("emitted_at_s", F.lit(None).cast("double"))
    commits = trace.legacy_events(s, "id")
    # the whole text again, from the settled segments: bounded by one recording
    final = commits.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("final_text")).withColumn("target_lang", F.lit("zh"))
    u = trace.unit_delays(commits, final, "id")
    ms = lambda x: F.round(x).cast("long")
    return u.select("id", F.size("delays").cast("long").alias("units"), F.aggregate("delays", F.lit(0).cast("long"), lambda a, x: a + ms(x)).alias("delay_sum"), ms(F.element_at("delays", -1)).alias("last_ms"))


# ---- literals ----------------------------------------------------------------
@query(rf"WITH {PAIRS}, v AS (SELECT doc_id, lang, CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END AS v, r FROM (SELECT doc_id, lang, unnest(regexp_extract_all(array_to_string(ref, ' '), '[0-9]+')) AS x, 1 AS r FROM p1 UNION ALL SELECT doc_id, lang, unnest(regexp_extract_all(array_to_string(hyp, ' '), '[0-9]+')), 0 FROM p1)), c AS (SELECT doc_id, lang, v, sum(r) AS nr, sum(1 - r) AS nh FROM v GROUP BY ALL) SELECT lang, CAST(sum(least(nr, nh)) AS BIGINT) AS hit, CAST(sum(nr) AS BIGINT) AS ref_total, CAST(sum(nh) AS BIGINT) AS hyp_total, round(sum(least(nr, nh)) / sum(nr), 4) AS recall, round(sum(least(nr, nh)) / sum(nh), 4) AS precision FROM c GROUP BY lang")
def numeric_literal_recall(spark, d):
    # a zero before a numeral is kept in a group of thousands only, which tokens don't have
    p = whole_pairs(spark, d).select("doc_id", "lang", scoring.numbers(F.array_join("ref", " ")).alias("r"), scoring.numbers(F.array_join("hyp", " ")).alias("h"))
    g = scoring.literal_hits(p, "lang", F.col("r"), F.col("h"))
    return g.withColumn("recall", F.round(F.try_divide("hit", "ref_total"), 4)).withColumn("precision", F.round(F.try_divide("hit", "hyp_total"), 4))


@query(r"WITH t AS (SELECT o_orderkey AS doc_id, o_orderpriority AS grp, strftime(o_orderdate, '%Y-%m-%d') AS iso, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders), v AS (SELECT doc_id, grp, iso AS v, 1 AS r, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS h FROM t UNION ALL SELECT doc_id, grp, CAST(y + 1 AS VARCHAR) || iso[5:], 0, 1 FROM t WHERE doc_id % 3 = 0) SELECT grp, CAST(sum(least(r, h)) AS BIGINT) AS hit, CAST(sum(r) AS BIGINT) AS total, round(sum(least(r, h)) / sum(r), 4) AS recall FROM v GROUP BY grp")
def date_literals(spark, d):
    """Orders told twice: as a Chinese date with noise out of range, and with slashes, every third a year late."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("dd"))
    late = F.when(F.col("doc_id") % 3 == 0, F.col("y") + 1).otherwise(F.col("y"))
    ref = F.format_string("ref %d年%d月%d日, not 2020-13-01 or 1999/1/40", "y", "m", "dd")
    hyp = F.format_string("due %d/%02d/%d.", late, "m", "dd")
    g = scoring.literal_hits(o, "grp", scoring.dates(ref), scoring.dates(hyp))
    return g.select("grp", "hit", F.col("ref_total").alias("total"), F.round(F.try_divide("hit", "ref_total"), 4).alias("recall"))


@query(f"WITH {PAIRS}, r AS (SELECT lang, len(hyp) / len(ref) AS x FROM p1 WHERE len(ref) > 0), v AS (SELECT lang, list_sort(list(x)) AS x, len(list(x)) AS n, avg(x) AS m FROM r GROUP BY lang), q AS (SELECT *, least(greatest(floor(50 * (n + 1) / 100.0), 1), n - 1)::BIGINT AS j50, least(greatest(floor(95 * (n + 1) / 100.0), 1), n - 1)::BIGINT AS j95 FROM v) SELECT lang, n, round(m, 3) AS ratio_mean, round(CASE WHEN n = 1 THEN x[1] ELSE (x[j50] * (100 - (50 * (n + 1) - j50 * 100)) + x[j50 + 1] * (50 * (n + 1) - j50 * 100)) / 100.0 END, 3) AS ratio_p50, round(CASE WHEN n = 1 THEN x[1] ELSE (x[j95] * (100 - (95 * (n + 1) - j95 * 100)) + x[j95 + 1] * (95 * (n + 1) - j95 * 100)) / 100.0 END, 3) AS ratio_p95 FROM q")
def translation_length_ratio(spark, d):
    r = whole_pairs(spark, d).where(F.size("ref") > 0).select("lang", (F.size("hyp") / F.size("ref")).alias("x"))
    q = quantiles.exact(r, ["lang"], "x", {"ratio_p50": quantiles.exclusive(50), "ratio_p95": quantiles.exclusive(95)})
    means = r.groupBy("lang").agg(F.round(F.avg("x"), 3).alias("ratio_mean"))
    return means.join(q, "lang").select("lang", "n", "ratio_mean", F.round("ratio_p50", 3).alias("ratio_p50"), F.round("ratio_p95", 3).alias("ratio_p95"))


#: Substitutions, deletions and insertions packed into one number, edits first; ties take the substitution, then the deletion.
ALIGN = "list_last(list_reduce(list_prepend(list_transform(range(0, len(hyp) + 1), lambda z: z * 1000000000001), list_transform(range(1, len(ref) + 1), lambda k: [k])), lambda prev, kk: list_reduce(list_prepend([prev[1] + 1000001000000 - 0], list_transform(range(1, len(hyp) + 1), lambda j: [j])), lambda cur, jj: list_append(cur, CASE WHEN hyp[jj[1]] = ref[kk[1]] THEN prev[jj[1]] WHEN prev[jj[1]] // 1000000000000 <= prev[jj[1] + 1] // 1000000000000 AND prev[jj[1]] // 1000000000000 <= list_last(cur) // 1000000000000 THEN prev[jj[1]] + 1000000000000 + 1000000000 * 1 WHEN prev[jj[1] + 1] // 1000000000000 <= list_last(cur) // 1000000000000 THEN prev[jj[1] + 1] + 1000001000000 ELSE list_last(cur) + 1000000000001 END))))"
BENCH = r"b0 AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS ref FROM benchmark), b1 AS (SELECT *, list_transform(list_filter(list_zip(ref, range(1, len(ref) + 1)), lambda s: (item_id * 7 + s[2]) % 11 <> 0), lambda s: CASE WHEN (item_id * 3 + s[2]) % 13 = 0 THEN 'x' WHEN (item_id + s[2]) % 17 = 0 THEN s[1] || ' y' ELSE s[1] END) AS h FROM b0), b AS (SELECT item_id, ref, string_split(array_to_string(h, ' '), ' ') AS hyp FROM b1)"


@query(f"WITH {BENCH}, p AS (SELECT item_id, len(ref) AS n, {ALIGN} AS v FROM b), c AS (SELECT n, v // 1000000000000 AS e, (v // 1000000000) % 1000 AS s, (v // 1000000) % 1000 AS dl, v % 1000000 AS i FROM p) SELECT count(*) AS n, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(s) AS BIGINT) AS subs, CAST(sum(dl) AS BIGINT) AS dels, CAST(sum(i) AS BIGINT) AS ins, round(sum(s) / greatest(sum(n), 1), 4) AS sub_rate, round(sum(dl) / greatest(sum(n), 1), 4) AS del_rate, round(sum(i) / greatest(sum(n), 1), 4) AS ins_rate, round(sum(i) / greatest(sum(n), 1), 4) AS extra_text_rate FROM c")
def alignment_rates(spark, d):
    """Substitutions, deletions and insertions over whole benchmark items."""
    a = bench_pairs(spark, d).select(F.size("ref").alias("n"), whole.alignment(F.col("ref"), F.col("hyp")).alias("a"))
    s, dl, i = (F.col("a")[k] for k in range(3))
    total = F.greatest(F.sum("n"), F.lit(1))
    rate = lambda c: F.round(F.sum(c) / total, 4)
    return a.agg(F.count(F.lit(1)).alias("n"), F.sum(s + dl + i).alias("edits"), F.sum(s).alias("subs"), F.sum(dl).alias("dels"), F.sum(i).alias("ins"), rate(s).alias("sub_rate"), rate(dl).alias("del_rate"), rate(i).alias("ins_rate"), rate(i).alias("extra_text_rate"))


def bench_pairs(spark, d):
    """item_id, ref and hyp words of benchmark items, hyp with fixed deletions, substitutions and insertions."""
    ref = table(spark, d, "benchmark").select("item_id", align.tokens(F.col("text")).alias("ref"))
    at = lambda i, k, m: (F.col("item_id") * k + i + 1) % m == 0
    word = lambda s: F.when(at(s["i"], 3, 13), F.lit("x")).when(at(s["i"], 1, 17), F.concat(s["x"], F.lit(" y"))).otherwise(s["x"])
    hyp = F.split(F.array_join(F.transform(F.filter(F.transform("ref", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~at(s["i"], 7, 11)), word), " "), " ")
    return ref.withColumn("hyp", hyp)


@query(f"WITH {BENCH}, p AS (SELECT item_id, len(ref) AS n, {ALIGN} AS v FROM b) SELECT item_id, CAST(n AS BIGINT) AS ref_len, CAST(v // 1000000000000 AS BIGINT) AS edits, CAST((v // 1000000000) % 1000 AS BIGINT) AS subs, CAST((v // 1000000) % 1000 AS BIGINT) AS dels, CAST(v % 1000000 AS BIGINT) AS ins FROM p")
def benchmark_alignment(spark, d):
    """The alignment of each benchmark item, by the kernel that whole documents go through."""
    a = bench_pairs(spark, d).select("item_id", F.size("ref").cast("long").alias("ref_len"), whole.edit_distance(F.col("ref"), F.col("hyp")).alias("edits"), whole.alignment(F.col("ref"), F.col("hyp")).alias("a"))
    return a.select("item_id", "ref_len", "edits", *[F.col("a")[k].alias(c) for k, c in enumerate(("subs", "dels", "ins"))])


@query(f"""WITH {BENCH}, p AS (SELECT item_id, len(ref) AS n, {ALIGN} AS v FROM b), s AS (SELECT item_id % 4 AS run, CAST(item_id AS VARCHAR) AS id, n, v // 1000000000000 AS edits, item_id % 5 = 0 AND item_id % 4 <> 3 AS gone, '{{"reason":"noise ' || item_id || '"}}' AS rule FROM p) SELECT run, round(sum(edits) FILTER (WHERE NOT gone) / sum(n) FILTER (WHERE NOT gone), 4) AS err_rate, count(*) FILTER (WHERE NOT gone) AS n_total, count(*) FILTER (WHERE NOT gone) AS n_scored, count(*) FILTER (WHERE gone) AS n_excluded, string_agg(id, ',' ORDER BY id) FILTER (WHERE gone) AS excluded_ids, CAST(coalesce(sum(n) FILTER (WHERE NOT gone), 0) AS BIGINT) AS total_ref_len, CAST(coalesce(sum(edits) FILTER (WHERE NOT gone), 0) AS BIGINT) AS total_edits, sha256('{{' || string_agg('"' || id || '":' || rule, ',' ORDER BY id) FILTER (WHERE gone) || '}}')[1:12] AS exclusion_signature FROM s GROUP BY run HAVING count(*) FILTER (WHERE gone) > 0""")
def reviewed_error_rate(spark, d):
    """The word error rate of four runs over benchmark items, without the items that were excluded from three of them."""
    a = bench_pairs(spark, d).select("item_id", F.size("ref").cast("long").alias("ref_len"), whole.alignment(F.col("ref"), F.col("hyp")).alias("a"))
    samples = a.select((F.col("item_id") % 4).alias("run"), F.col("item_id").alias("id"), "ref_len", *[F.col("a")[k].alias(c) for k, c in enumerate(("sub", "del", "ins"))])
    gone = table(spark, d, "benchmark").where("item_id % 5 = 0 and item_id % 4 <> 3").select(F.col("item_id").alias("id"), F.concat(F.lit('{"reason":"noise '), F.col("item_id").cast("string"), F.lit('"}')).alias("rule"))
    return curation.reviewed(samples, gone, "run").withColumn("excluded_ids", F.array_join("excluded_ids", ","))


@query(f"WITH {BENCH}, k AS (SELECT item_id, array_to_string(hyp, ' ') AS h, list_filter(ref, lambda w: length(w) >= 7) AS ws FROM b) SELECT item_id, CAST(len(list_filter(ws, lambda w: CASE WHEN length(w) % 3 = 0 THEN contains(h, w) WHEN length(w) % 2 = 1 THEN contains(h, 'zz' || w) OR contains(h, w[1:6]) ELSE contains(h, w) END)) AS BIGINT) AS hit, CAST(len(ws) AS BIGINT) AS total FROM k")
def keyword_hits(spark, d):
    """Keywords of each item's own, given as strings and as objects with a surface or aliases, that the output contains."""
    surface = lambda w: F.concat(F.lit('{"surface":"'), w, F.lit('"}'))
    aliases = lambda w: F.concat(F.lit('{"surface":"'), w, F.lit('","aliases":["zz'), w, F.lit('","'), F.substring(w, 1, 6), F.lit('"]}'))
    item = lambda w: F.when(F.length(w) % 3 == 0, surface(w)).when(F.length(w) % 2 == 1, aliases(w)).otherwise(F.concat(F.lit('"'), w, F.lit('"')))
    json = F.concat(F.lit("["), F.array_join(F.transform(F.filter("ref", lambda w: F.length(w) >= 7), item), ","), F.lit("]"))
    k = bench_pairs(spark, d).select("item_id", F.array_join("hyp", " ").alias("h"), json.alias("keywords"))
    return k.select("item_id", keywords.hits(F.col("h"), keywords.parsed(F.col("keywords"))).alias("k")).select("item_id", "k.hit", "k.total")


# ---- records -----------------------------------------------------------------
@query("SELECT CASE c_custkey % 4 WHEN 0 THEN 'summarize' WHEN 1 THEN 'asr' WHEN 2 THEN 'translate' ELSE 'asr' END AS task, count(*) AS n FROM customer GROUP BY 1")
def task_remap(spark, d):
    kind = F.when(F.col("c_custkey") % 4 == 0, "minutes").when(F.col("c_custkey") % 4 == 1, "formula").when(F.col("c_custkey") % 4 == 2, "translate")
    return table(spark, d, "customer").groupBy(scoring.task(kind).alias("task")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END AS edited, props AS raw FROM events) SELECT user_id, count(*) FILTER (WHERE coalesce(edited, '') <> '') AS edited, count(*) FILTER (WHERE coalesce(edited, '') = '') AS raw, CASE WHEN count(DISTINCT coalesce(edited, '') <> '') > 1 THEN 'mixed' WHEN bool_and(coalesce(edited, '') <> '') THEN 'edited' ELSE 'raw' END AS variant, CAST(sum(length(coalesce(nullif(edited, ''), raw))) AS BIGINT) AS chars FROM o GROUP BY user_id")
def output_variant(spark, d):
    edited = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type"))
    o = table(spark, d, "events").select("user_id", edited.alias("edited"), F.col("props").alias("raw"))
    v = o.select("user_id", scoring.variant(F.col("edited")).alias("v"), F.length(scoring.output(F.col("edited"), F.col("raw"))).alias("n"))
    return v.groupBy("user_id").agg(F.count_if(F.col("v") == "edited").alias("edited"), F.count_if(F.col("v") == "raw").alias("raw"), F.when(F.min("v") != F.max("v"), "mixed").otherwise(F.min("v")).alias("variant"), F.sum("n").alias("chars"))


@query("WITH l AS (SELECT user_id % 10 AS run, 1 + event_id % 3 AS workers, value, user_id % 10 < 6 AS has_meta, user_id % 10 = 7 AS concurrent FROM events) SELECT run, count(*) FILTER (WHERE CASE WHEN has_meta THEN workers = 1 ELSE NOT concurrent END) AS serial, round(avg(CASE WHEN CASE WHEN has_meta THEN workers = 1 ELSE NOT concurrent END THEN value END), 4) AS mean_s, count(*) AS n FROM l GROUP BY run")
def serial_records(spark, d):
    run = F.col("user_id") % 10
    s = scoring.serial(1 + F.col("event_id") % 3, run < 6, run == 7)
    return table(spark, d, "events").groupBy(run.alias("run")).agg(F.count_if(s).alias("serial"), F.round(F.avg(F.when(s, F.col("value"))), 4).alias("mean_s"), F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 0.0 ELSE value END AS v FROM events) SELECT user_id, count(*) FILTER (WHERE v <> 0) AS n_ttfb, round(avg(v) FILTER (WHERE v <> 0), 4) AS ttfb_mean, count(v) AS n_stable, round(avg(v), 4) AS stable_mean, round(count(v) / count(*), 4) AS coverage FROM x GROUP BY user_id")
def observed_means(spark, d):
    """A first-byte time of zero was not observed; every other figure counts unless it is null."""
    v = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, 0.0).otherwise(F.col("value"))
    x = table(spark, d, "events").select("user_id", v.alias("v"))
    return x.groupBy("user_id").agg(F.count_if(F.col("v") != 0).alias("n_ttfb"), F.round(F.avg(F.when(F.col("v") != 0, F.col("v"))), 4).alias("ttfb_mean"), F.count("v").alias("n_stable"), F.round(F.avg("v"), 4).alias("stable_mean"), F.round(F.count("v") / F.count(F.lit(1)), 4).alias("coverage"))


@query("WITH c AS (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(k || ':' || n, ',' ORDER BY k) AS counts FROM c GROUP BY user_id")
def counts_map(spark, d):
    c = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each kind of event: the map is small however many events there are
    return c.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat_ws(":", x["k"], x["n"].cast("string"))), ",").alias("counts"))


#: Segments with timings; texts repeat, one in seven ends before it starts, one in four records is not serial.
SPANS = f"{SEG}, sp AS (SELECT id, segment_id, end_s - dur AS start_s, CASE WHEN (id + segment_id) % 7 = 3 THEN end_s - dur - 1 WHEN (id + segment_id) % 7 = 5 THEN end_s - dur + 1.5 ELSE end_s END AS end_s, CASE WHEN segment_id % 4 = 1 THEN '  ' ELSE ' Part  ' || (id % 2) || CASE WHEN (id + segment_id) % 7 = 5 THEN '' ELSE ' of the Recording' END END AS text, (id * 37 + segment_id * 211) % 1500 AS queue_ms, (id * 53 + segment_id * 811) % 7000 AS e2e_ms, id % 4 <> 0 AS serial, CASE segment_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'pause' END AS cut_reason, CASE segment_id % 5 WHEN 0 THEN 'limit' END AS vad_reason FROM seg), sn AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM sp), sv AS (SELECT *, last_value(nullif(norm, '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM sn)"


def spans(spark, d):
    s = segments(spark, d)
    part = (F.col("id") + F.col("segment_id")) % 7
    start = F.col("end_s") - F.col("dur")
    t = s.select(
        "id",
        "segment_id",
        start.alias("start_s"),
        F.when(part == 3, start - 1).when(part == 5, start + 1.5).otherwise(F.col("end_s")).alias("end_s"),
        F.when(F.col("segment_id") % 4 == 1, "  ").otherwise(F.concat(F.lit(" Part  "), (F.col("id") % 2).cast("string"), F.when(part == 5, "").otherwise(" of the Recording"))).alias("text"),
        ((F.col("id") * 37 + F.col("segment_id") * 211) % 1500).alias("queue_ms"),
        ((F.col("id") * 53 + F.col("segment_id") * 811) % 7000).alias("e2e_ms"),
        (F.col("id") % 4 != 0).alias("serial"),
        F.when(F.col("segment_id") % 3 == 0, "").when(F.col("segment_id") % 3 == 1, "pause").alias("cut_reason"),
        F.when(F.col("segment_id") % 5 == 0, "limit").alias("vad_reason"),
    )
    w = Window.partitionBy("id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("previous", F.last(F.nullif(scoring.normal(F.col("text")), F.lit("")), ignorenulls=True).over(w))


@query(f"WITH {SPANS} SELECT id AS conv_id, segment_id AS turn FROM sv WHERE norm <> '' AND norm = previous")
def adjacent_dups(spark, d):
    return spans(spark, d).where((scoring.normal(F.col("text")) != "") & (scoring.normal(F.col("text")) == F.col("previous"))).select(F.col("id").alias("conv_id"), F.col("segment_id").alias("turn"))


@query(f"WITH {SPANS}, a AS (SELECT id, segment_id, unnest(list_filter([CASE WHEN round(end_s - start_s, 3) < 0 THEN 'invalid_segment_timestamps' END, CASE WHEN round(end_s - start_s, 3) >= 0 AND round(end_s - start_s, 3) < 2 AND length(regexp_replace(text, '\\s', '', 'g')) <= 12 THEN 'short_phrase_island' END, CASE WHEN round(end_s - start_s, 3) > 20.5 THEN 'hard_max_exceeded' END, CASE WHEN norm <> '' AND norm = previous THEN 'adjacent_duplicate_translation' END, CASE WHEN serial AND queue_ms > 1000 THEN 'queue_spike' END, CASE WHEN serial AND e2e_ms > 5000 THEN 'e2e_spike' END], lambda x: x IS NOT NULL)) AS type FROM sv) SELECT type, count(*) AS n, count(DISTINCT id) AS records FROM a GROUP BY type")
def anomaly_counts(spark, d):
    s = spans(spark, d)
    a = s.select("id", F.explode(scoring.anomalies({c: F.col(c) for c in s.columns}, 20.0)).alias("type"))
    return a.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("records"))


@query(f"WITH {SPANS} SELECT coalesce(nullif(cut_reason, ''), vad_reason) AS reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM sv GROUP BY 1")
def segment_reasons(spark, d):
    r = spans(spark, d).groupBy(scoring.reason({"cut_reason": F.col("cut_reason"), "vad_reason": F.col("vad_reason")}).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each reason
    return r.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


# ---- languages and texts -------------------------------------------------------
LANGUAGE_NAMES = ("English", " 中文 ", "Simplified Chinese", "zh-TW", "pt-BR", "Italian", "意大利文", "klingon", "", "urdu", "English (US)", "zho")
#: Every document with a language as people write it: every third by its own code.
NAMES = f"n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE (['{"', '".join(LANGUAGE_NAMES)}'])[doc_id % {len(LANGUAGE_NAMES)} + 1] END AS name FROM documents)"


@query(f"WITH {NAMES}, l AS (SELECT doc_id, name, lower(trim(name)) AS c FROM n) SELECT doc_id, name, CASE c WHEN 'english' THEN 'en' WHEN '中文' THEN 'zh' WHEN 'simplified chinese' THEN 'zh' WHEN 'italian' THEN 'it' WHEN 'urdu' THEN 'ur' ELSE c END AS code, CASE c WHEN 'english' THEN 'en' WHEN '中文' THEN 'zh' WHEN 'italian' THEN 'it' WHEN '意大利文' THEN 'it' ELSE string_split(c, '-')[-1] END AS short, CASE WHEN c LIKE '%english%' OR c = 'en' THEN 'en' WHEN c IN ('zh', 'zho', '中文', '简体中文') OR c LIKE '%chinese%' THEN 'zh' ELSE 'basic' END AS norm, NOT (c IN ('zh', 'zho', '中文', '简体中文') OR c LIKE '%chinese%') AS by_word FROM l")
def language_codes(spark, d):
    names = F.get(F.array(*[F.lit(x) for x in LANGUAGE_NAMES]), (F.col("doc_id") % len(LANGUAGE_NAMES)).cast("int"))
    n = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(names)
    docs = table(spark, d, "documents").select("doc_id", n.alias("name"))
    n = F.col("name")
    return docs.select("doc_id", "name", scoring.language_code(n).alias("code"), scoring.short_code(n).alias("short"), scoring.target_norm(n).alias("t")).select("doc_id", "name", "code", "short", "t.norm", "t.by_word")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) + len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) + len(regexp_extract_all(text, '[㐀-䶿一-鿿]')) AS units, greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9]+|[㐀-鿿]'))) AS weight, sha256(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')))[1:16] AS cap_key FROM documents")
def lexical_units(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", scoring.lexical_units(t).cast("long").alias("units"), scoring.text_weight(t).cast("long").alias("weight"), F.substring(F.sha2(scoring.normal(t).cast("binary"), 256), 1, 16).alias("cap_key"))


@query("WITH t AS (SELECT event_id, 'said' || CASE WHEN event_id % 2 = 0 THEN ' x <asr_text>system' || chr(10) || event_type || '<asr_text> ' ELSE '' END AS text, event_type FROM events) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'said' END AS body FROM t")
def reply_cleanup(spark, d):
    text = F.concat(F.lit("said"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" x <asr_text>system\n"), F.col("event_type"), F.lit("<asr_text> "))).otherwise(""))
    return table(spark, d, "events").select("event_id", scoring.reply_body(text).alias("body"))


@query("WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '你好' ELSE event_type END AS c, CASE event_id % 3 WHEN 0 THEN '' ELSE ' end' END AS dr, event_id % 5 = 0 AS rep FROM events) SELECT event_id, CASE WHEN rep AND dr <> '' THEN 'end' WHEN c = '' THEN trim(dr) WHEN dr = '' THEN c WHEN event_id % 4 = 1 THEN c || 'end' ELSE c || ' end' END AS shown FROM t")
def incremental_preview(spark, d):
    c = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "你好").otherwise(F.col("event_type"))
    dr = F.when(F.col("event_id") % 3 == 0, "").otherwise(" end")
    return table(spark, d, "events").select("event_id", scoring.preview(c, dr, F.col("event_id") % 5 == 0).alias("shown"))


@query("SELECT page_id, CASE WHEN contains(url, '/datasets/') THEN 'datasets/' || split_part(url, '/datasets/', 2) ELSE url END AS portable, CASE WHEN len(string_split(url, '/')) >= 3 THEN string_split(url, '/')[-2] ELSE '' END AS speaker, array_to_string(list_filter(string_split('/' || url, '/'), lambda x: x <> '')[-3:], '/') AS tail FROM pages")
def portable_ids(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", scoring.portable_path(u).alias("portable"), scoring.speaker(F.lit(None).cast("string"), u).alias("speaker"), scoring.portable_path(F.concat(F.lit("/"), u)).alias("tail"))


@query("WITH x AS (SELECT event_id, event_type AS hint FROM events) SELECT DISTINCT hint, '__lang-' || hint[1:12] || '-' || sha1(hint)[1:6] AS tag FROM x")
def language_tags(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("hint")).distinct().select("hint", scoring.language_tag(F.col("hint")).alias("tag"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '__failed__' WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'zh' || CASE WHEN event_id % 2 = 0 THEN ' wu' ELSE '' END ELSE '(unknown)' END AS label FROM events")
def lid_labels(spark, d):
    k = F.col("event_id")
    lab = scoring.lid_label(F.col("event_type") != "error", F.when(k % 3 == 0, F.col("event_type")), F.when(k % 3 == 1, "zh"), F.when((k % 3 == 1) & (k % 2 == 0), "wu"))
    return table(spark, d, "events").select("event_id", lab.alias("label"))


AUDIO = "m AS (SELECT l_orderkey AS id, l_linenumber AS nr, l_quantity / 10.0 AS actual_s, CASE WHEN l_linenumber = 3 THEN l_quantity / 10.0 + 1 ELSE l_quantity / 10.0 END AS expected_s, l_discount::DOUBLE / 3 AS rms, l_tax::DOUBLE / 4 AS clip, l_tax::DOUBLE * 4 AS zero, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '<x> two words' ELSE 'a few more words than that' END AS text, CASE WHEN l_returnflag = 'A' THEN 'en' ELSE 'zh' END AS lang, CASE WHEN l_linenumber = 5 THEN 4000 ELSE 16000 END AS sample_rate FROM lineitem)"


@query(f"WITH {AUDIO}, u AS (SELECT *, CASE WHEN text = '' THEN 0 WHEN starts_with(text, '<') THEN 3 ELSE 6 END AS units FROM m), f AS (SELECT *, units / actual_s AS rate, list_filter([CASE WHEN abs(actual_s - expected_s) > greatest(0.1, actual_s * 0.05) THEN 'duration_mismatch' END, CASE WHEN units = 0 THEN 'no_lexical_label' END, CASE WHEN rms < pow(10, -55 / 20.0) THEN 'near_silent' END], lambda x: x IS NOT NULL) AS hard FROM u), g AS (SELECT *, list_filter([CASE WHEN actual_s < 0.2 THEN 'ultra_short_under_0.2s' WHEN actual_s < 0.5 THEN 'very_short_under_0.5s' END, CASE WHEN starts_with(text, '<') THEN 'label_markup' END, CASE WHEN rms >= pow(10, -55 / 20.0) AND rms < pow(10, -42 / 20.0) THEN 'low_volume' END, CASE WHEN clip > 0.01 THEN 'heavy_clipping' END, CASE WHEN zero > 0.25 THEN 'many_zero_samples' END, CASE WHEN units > 0 AND rate < 0.35 THEN 'label_rate_too_low' END, CASE WHEN rate > CASE WHEN lang = 'en' THEN 8.0 ELSE 12.0 END THEN 'label_rate_too_high' END, CASE WHEN sample_rate < 8000 THEN 'low_sample_rate' END], lambda x: x IS NOT NULL) AS soft FROM f) SELECT CASE WHEN len(hard) > 0 THEN 'reject' WHEN len(soft) > 0 THEN 'review' ELSE 'keep' END AS decision, array_to_string(list_concat(hard, soft), ',') AS flags, count(*) AS n FROM g GROUP BY ALL")
def audio_triage(spark, d):
    k = F.col("l_linenumber")
    s = F.col("l_quantity") / 10.0
    m = {"actual_s": s.cast("double"), "expected_s": F.when(k == 3, s + 1).otherwise(s).cast("double"), "rms": F.col("l_discount").cast("double") / 3, "clip": F.col("l_tax").cast("double") / 4, "zero": F.col("l_tax").cast("double") * 4, "text": F.when(k == 1, "").when(k == 2, "<x> two words").otherwise("a few more words than that"), "lang": F.when(F.col("l_returnflag") == "A", "en").otherwise("zh"), "sample_rate": F.when(k == 5, 4000).otherwise(16000)}
    t = table(spark, d, "lineitem").select(scoring.triage(m).alias("t"))
    return t.groupBy(F.col("t.decision").alias("decision"), F.array_join("t.flags", ",").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH i AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'unreviewed' ELSE 'kept' END AS decision FROM events), g AS (SELECT user_id, bool_and(decision <> 'unreviewed') FILTER (WHERE event_type = 'error') AS done FROM i GROUP BY user_id) SELECT user_id, user_id % 3 <> 0 AND (user_id % 5 = 0 OR coalesce(done, true)) AS complete FROM g")
def review_completeness(spark, d):
    """Issues of a sample are its error events; every fourth is not judged yet."""
    e = table(spark, d, "events").where("event_type = 'error'")
    issue = F.col("event_id").cast("string")
    # decisions of one sample's issues, as a reviewer wrote them
    per = e.groupBy("user_id").agg(F.collect_list(issue).alias("issues"), F.map_from_entries(F.collect_list(F.struct(issue, F.when(F.col("event_id") % 4 != 0, "kept")))).alias("decisions"))
    users = table(spark, d, "events").select("user_id").distinct()
    done = scoring.review_complete(F.when(F.col("user_id") % 3 != 0, "good"), F.when(F.col("user_id") % 5 == 0, "out"), F.col("issues"), F.coalesce("decisions", F.create_map().cast("map<string,string>")))
    return users.join(per, "user_id", "left").select("user_id", done.alias("complete"))


@query("SELECT o_orderkey, o_totalprice / 600000.0 >= 0.5 OR o_orderkey % 9 >= 6 OR o_orderkey % 10 >= 8 AS large_error FROM orders")
def large_error_suggestion(spark, d):
    """An error rate of a half, a changed block of eight or more, or six blocks."""
    large = (F.col("o_totalprice") / 600000.0 >= 0.5) | (F.col("o_orderkey") % 9 >= 6) | (F.col("o_orderkey") % 10 >= 8)
    return table(spark, d, "orders").select("o_orderkey", large.alias("large_error"))


@query(r"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '((?:bearer|basic)\s+)([A-Za-z0-9+/._\-]{4,}={0,2})', '\1***', 'gi'), '((?:x-)?api[_-]?key|api[_-]?secret|access[_-]?token|authorization|token|secret|password|passwd|pwd|app[_-]?id|app[_-]?key)([\s:="'']+)([A-Za-z0-9+/._\-]{6,})', '\1\2***', 'gi'), '(://[^/@\s:]+:)([^@\s/]+)(@)', '\1***\3', 'g'), '\bsk-[A-Za-z0-9]{12,}', 'sk-***', 'g') AS clean FROM documents) SELECT doc_id, clean <> text AS redacted, sha256(clean) AS sha FROM r""")
def secret_redaction(spark, d):
    """Whole texts without the secrets that the rules name."""
    t = table(spark, d, "documents").select("doc_id", "text", scoring.redacted(F.col("text")).alias("clean"))
    return t.select("doc_id", (F.col("clean") != F.col("text")).alias("redacted"), F.sha2(F.col("clean").cast("binary"), 256).alias("sha"))


@query()
def suggested_errors(spark, d):
    """Whole texts whose output errs in half of the words, or changes eight characters in a row or six places: what a reviewer should look at."""
    p = whole_pairs(spark, d).select("doc_id", F.size("ref").alias("n"), whole.edit_distance(F.col("ref"), F.col("hyp")).alias("edits"), F.array_join("ref", " ").alias("r"), F.array_join("hyp", " ").alias("h"))
    c = p.select("doc_id", F.coalesce(F.try_divide("edits", "n"), F.lit(0.0)).alias("rate"), blocks(F.col("r"), F.col("h")).alias("b"))
    return c.select("doc_id", F.round("rate", 6).alias("rate"), "b.blocks", "b.large", ((F.col("rate") >= 0.5) | (F.col("b.large") > 0) | (F.col("b.blocks") >= 6)).alias("suggested"))
