"""Queries on figures of segments, emissions, embeddings and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurate.functions import bleu, keywords, quantiles, whole
from murmurate.operators import curation, scoring
from murmurate.plans.catalog import LOG, PAIRS, log, query, table, whole_pairs
from murmurate.plans.more import SEG, segments
from murmurate.plans.scores import SPANS, spans


def _exclusive_sql(p: int, v: str = "x") -> str:
    j = f"CAST(least(greatest(floor({p} * (n + 1) / 100.0), 1), n - 1) AS BIGINT)"
    return f"CASE WHEN n = 1 THEN {v}[1] ELSE {v}[{j}] * (100 - ({p} * (n + 1) - {j} * 100)) / 100.0 + {v}[{j} + 1] * ({p} * (n + 1) - {j} * 100) / 100.0 END"


# ---- latency -----------------------------------------------------------------
@query(f"WITH {LOG}, v AS (SELECT id, list_sort(list(elapsed_s)) AS x FROM log WHERE workers = 1 AND ok GROUP BY id), w AS (SELECT id, x, len(x) AS n FROM v) SELECT id, round({_exclusive_sql(50)}, 3) AS p50, round({_exclusive_sql(90)}, 3) AS p90, round({_exclusive_sql(95)}, 3) AS p95 FROM w")
def serial_latency_quantiles(spark, d):
    names = {f"p{p}": quantiles.exclusive(p) for p in (50, 90, 95)}
    q = quantiles.exact(log(spark, d).where("workers = 1 and ok"), ["id"], "elapsed_s", names)
    return q.select("id", *[F.round(p, 3).alias(p) for p in names])


@query(f"WITH {LOG}, v AS (SELECT id, list_sort(list(elapsed_s)) AS x FROM log GROUP BY id) SELECT id, x[1 + CAST(round_even((len(x) - 1) * 0.95, 0) AS BIGINT)] AS p95 FROM v")
def nearest_rank_latency(spark, d):
    return quantiles.exact(log(spark, d), ["id"], "elapsed_s", {"p95": quantiles.nearest_rank(0.95)}).select("id", "p95")


# ---- segments ------------------------------------------------------------------
@query(f"WITH {SPANS}, q AS (SELECT id % 5 AS run, id, round(end_s - start_s, 3) AS dur, nullif(cut_reason, '') IS NOT NULL OR vad_reason IS NOT NULL AS has_reason, queue_ms, e2e_ms, serial FROM sv), g AS (SELECT run, count(*) AS requests, sum(CASE WHEN dur >= 0 THEN dur END) AS audio, list_sort(list(dur) FILTER (WHERE dur >= 0)) AS x, count(*) FILTER (WHERE dur >= 0) AS n, avg(CASE WHEN has_reason THEN 1.0 ELSE 0 END) AS reason_coverage, list_sort(list(e2e_ms) FILTER (WHERE serial)) AS y, count(*) FILTER (WHERE serial) AS m FROM q GROUP BY run) SELECT run, requests, n AS segments, round(60 * requests / audio, 4) AS requests_per_minute, round(len(list_filter(x, lambda v: v < 2)) / n, 4) AS lt_2s, round(len(list_filter(x, lambda v: v > 15)) / n, 4) AS gt_15s, round(len(list_filter(x, lambda v: v > 20)) / n, 4) AS gt_20s, round(len(list_filter(x, lambda v: v > 12.5)) / n, 4) AS gt_soft, round(len(list_filter(x, lambda v: v > 25)) / n, 4) AS gt_hard, round({_exclusive_sql(50)}, 3) AS p50, round({_exclusive_sql(90)}, 3) AS p90, round({_exclusive_sql(95)}, 3) AS p95, x[n] AS longest, round(reason_coverage, 4)::DOUBLE AS reason_coverage FROM g")
def segment_vad_block(spark, d):
    """Of each run: rates by duration (its soft limit is 12.5 s, its hard one 25 s), percentiles, reasons."""
    s = spans(spark, d)
    dur = F.round(F.col("end_s") - F.col("start_s"), 3)
    s = s.select((F.col("id") % 5).alias("run"), F.when(dur >= 0, dur).alias("dur"), scoring.reason({"cut_reason": F.col("cut_reason"), "vad_reason": F.col("vad_reason")}).isNotNull().alias("has"))
    total = s.groupBy("run").agg(F.count(F.lit(1)).alias("requests"), F.sum("dur").alias("audio"), F.round(F.avg(F.col("has").cast("double")), 4).alias("reason_coverage"))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 4)
    d_ = F.col("dur")
    percentiles = quantiles.exact(s, ["run"], "dur", {f"p{p}": quantiles.exclusive(p) for p in (50, 90, 95)})
    block = s.where("dur is not null").groupBy("run").agg(F.count(F.lit(1)).alias("segments"), share(d_ < 2).alias("lt_2s"), share(d_ > 15).alias("gt_15s"), share(d_ > 20).alias("gt_20s"), share(d_ > 12.5).alias("gt_soft"), share(d_ > 25).alias("gt_hard"), F.max("dur").alias("longest"))
    block = block.join(percentiles.select("run", *[F.round(f"p{p}", 3).alias(f"p{p}") for p in (50, 90, 95)]), "run")
    return total.join(block, "run").select("run", "requests", "segments", F.round(60 * F.col("requests") / F.col("audio"), 4).alias("requests_per_minute"), "lt_2s", "gt_15s", "gt_20s", "gt_soft", "gt_hard", "p50", "p90", "p95", "longest", "reason_coverage")


#: Segments that overlap: each goes on for three seconds after the next has begun.
OVER = f"{SEG}, o AS (SELECT id, segment_id, end_s - dur AS a, end_s + 3 AS b, text FROM seg), e AS (SELECT id, segment_id AS event, end_s - dur / 2 + 7 AS tm FROM seg)"


@query(f"WITH {OVER}, c AS (SELECT e.id, e.event, min(o.segment_id) AS hit FROM e JOIN o ON o.id = e.id AND o.a <= e.tm AND e.tm < o.b GROUP BY ALL), l AS (SELECT id, max(segment_id) AS last FROM seg GROUP BY id) SELECT e.id, coalesce(hit, last) AS segment, count(*) AS events, string_agg(CAST(e.event AS VARCHAR), ' ' ORDER BY tm, e.event) AS text FROM e LEFT JOIN c USING (id, event) JOIN l USING (id) GROUP BY ALL")
def interval_join_longform(spark, d):
    """Events go to the first segment that holds their time, else to the last one, and their texts are joined there.

    A segment is in every minute that it touches, an event in one, so this is a
    join by recording and minute; the times are compared within it.
    """
    s = segments(spark, d)
    spans_ = s.select("id", F.col("segment_id").alias("x"), (F.col("end_s") - F.col("dur")).alias("t"), (F.col("end_s") + 3).alias("b"))
    events = s.select("id", F.col("segment_id").alias("x"), (F.col("end_s") - F.col("dur") / 2 + 7).alias("t"))
    step = 60.0
    bucket = lambda c: F.floor(c / step)
    left = spans_.withColumn("bucket", F.explode(F.sequence(bucket(F.col("t")), bucket(F.col("b")))))
    hit = events.withColumn("bucket", bucket(F.col("t"))).alias("e").join(left.alias("s"), (F.col("e.id") == F.col("s.id")) & (F.col("e.bucket") == F.col("s.bucket")) & (F.col("s.t") <= F.col("e.t")) & (F.col("e.t") < F.col("s.b")))
    first = hit.groupBy(F.col("e.id").alias("id"), F.col("e.x").alias("x")).agg(F.min("s.x").alias("hit"))
    last = spans_.groupBy("id").agg(F.max("x").alias("last"))
    put = events.join(first, ["id", "x"], "left").join(last, "id").withColumn("segment", F.coalesce("hit", "last"))
    # the events of one segment
    g = put.groupBy("id", "segment").agg(F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_list(F.struct("t", "x"))).alias("v"))
    return g.select("id", "segment", "events", F.array_join(F.transform("v", lambda v: v["x"].cast("string")), " ").alias("text"))


#: Words of each turn are heard when the turn is over; the reference is half as long again.
TOKENS = f"{SEG}, w AS (SELECT id, segment_id, round(end_s, 3)::DOUBLE AS g, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS k FROM seg), c AS (SELECT *, sum(k) OVER (PARTITION BY id ORDER BY segment_id) AS e, sum(k) OVER (PARTITION BY id) AS y, max(g) OVER (PARTITION BY id) - 5.0 AS T FROM w), t AS (SELECT *, min(CASE WHEN g >= T - 1e-6 AND k > 0 THEN e - k + 1 END) OVER (PARTITION BY id) AS tau FROM c), u AS (SELECT id, y, T, coalesce(tau, y) AS tau, g, unnest(range(CAST(e - k + 1 AS BIGINT), CAST(e + 1 AS BIGINT))) AS i FROM t WHERE T > 0)"


@query(f"WITH {TOKENS} SELECT id, max(y)::BIGINT AS tokens, round(sum(g - (i - 1) * T / y) / max(tau), 3)::DOUBLE AS al, round(sum(g - (i - 1) * T / ceil(y * 1.5)) / max(tau), 3)::DOUBLE AS laal FROM u WHERE i <= tau GROUP BY id")
def al_laal(spark, d):
    """Average lagging over tokens, and its length-adaptive form, whose pace is that of the longer of output and reference.

    Tokens of a turn share its delay, so a turn is a closed sum over its places.
    """
    s = segments(spark, d)
    by = Window.partitionBy("id")
    w = s.select("id", "segment_id", F.round("end_s", 3).cast("double").alias("g"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("k"))
    c = w.select("*", F.sum("k").over(by.orderBy("segment_id")).alias("e"), F.sum("k").over(by).alias("y"), (F.max("g").over(by) - 5.0).alias("T")).where("T > 0 and y > 0")
    tau = F.coalesce(F.min(F.when((F.col("g") >= F.col("T") - 1e-6) & (F.col("k") > 0), F.col("e") - F.col("k") + 1)).over(by), F.col("y"))
    t = c.withColumn("tau", tau).withColumn("a", F.col("e") - F.col("k") + 1).withColumn("b", F.least("e", "tau")).where("a <= b")
    n = F.col("b") - F.col("a") + 1
    places = (F.col("a") + F.col("b") - 2) * n / 2.0  # sum of (i - 1)
    lag = lambda size: F.round(F.sum(F.col("g") * n - places * F.col("T") / size) / F.max("tau"), 3)
    return t.groupBy("id").agg(F.max("y").alias("tokens"), lag(F.col("y")).alias("al"), lag(F.ceil(F.col("y") * 1.5)).alias("laal"))


# ---- texts ---------------------------------------------------------------------
BENCH_CHARS = r"b0 AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS ref FROM benchmark), b AS (SELECT item_id, ref, array_to_string(list_transform(list_filter(list_zip(string_split(ref, ''), range(1, length(ref) + 1)), lambda s: (item_id * 7 + s[2]) % 11 <> 0), lambda s: CASE WHEN (item_id * 3 + s[2]) % 13 = 0 THEN 'x' ELSE s[1] END), '') AS hyp FROM b0 WHERE ref <> '')"
_LCS = "list_last(list_reduce(list_prepend(list_transform(range(0, length(hyp) + 1), lambda z: 0), list_transform(range(1, length(ref) + 1), lambda k: [k])), lambda prev, kk: list_reduce(list_prepend([0], list_transform(range(1, length(hyp) + 1), lambda j: [j])), lambda cur, jj: list_append(cur, CASE WHEN hyp[jj[1]] = ref[kk[1]] THEN prev[jj[1]] + 1 ELSE greatest(list_last(cur), prev[jj[1] + 1]) END))))"


def bench_chars(spark, d) -> DataFrame:
    ref = table(spark, d, "benchmark").select("item_id", F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "").alias("ref")).where("ref <> ''")
    at = lambda i, k, m: (F.col("item_id") * k + i + 1) % m == 0
    marked = F.transform(F.filter(F.split("ref", ""), lambda c: c != ""), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return ref.withColumn("hyp", F.array_join(F.transform(F.filter(marked, lambda s: ~at(s["i"], 7, 11)), lambda s: F.when(at(s["i"], 3, 13), "x").otherwise(s["x"])), ""))


@query(f"WITH {BENCH_CHARS}, r AS (SELECT item_id, unnest(string_split(ref, '')) AS c FROM b), h AS (SELECT item_id, unnest(string_split(hyp, '')) AS c FROM b), rc AS (SELECT item_id, c, count(*) AS n FROM r GROUP BY ALL), hc AS (SELECT item_id, c, count(*) AS n FROM h GROUP BY ALL), o AS (SELECT item_id, sum(least(rc.n, hc.n)) AS hit FROM rc JOIN hc USING (item_id, c) GROUP BY item_id), l AS (SELECT item_id, length(ref) AS m, length(hyp) AS k, {_LCS} AS lcs FROM b) SELECT item_id, round(2.0 * hit / (m + k), 4)::DOUBLE AS r1, round(2.0 * lcs / (m + k), 4)::DOUBLE AS rl FROM l JOIN o USING (item_id)")
def rouge_char(spark, d):
    """Character ROUGE-1 and ROUGE-L as F1, rounded to four digits; an empty side gives 0."""
    b = bench_chars(spark, d).select("item_id", "ref", "hyp", whole.ngram_counts(F.col("ref"), F.col("hyp"), 1).alias("c"), whole.lcs(F.col("ref"), F.col("hyp")).alias("l"))
    f1 = lambda hit: F.round(F.coalesce(F.try_divide(2.0 * hit, F.length("ref") + F.length("hyp")), F.lit(0.0)), 4)
    return b.select("item_id", f1(F.col("c")[0]).alias("r1"), f1(F.col("l")).alias("rl"))


def _grams(n: int, side: str) -> str:
    return f"SELECT item_id, {n} AS k, {side}[i:i + {n - 1}] AS g, count(*) AS n FROM b, unnest(range(1, greatest(length({side}) - {n - 2}, 1))) t(i) GROUP BY ALL"


@query(f"WITH {BENCH_CHARS}, rg AS ({' UNION ALL '.join(_grams(n, 'ref') for n in range(1, 7))}), hg AS ({' UNION ALL '.join(_grams(n, 'hyp') for n in range(1, 7))}), m AS (SELECT item_id, k, sum(least(rg.n, hg.n)) AS hit FROM rg JOIN hg USING (item_id, k, g) GROUP BY ALL), a AS (SELECT item_id, k, sum(n) AS nr FROM rg GROUP BY ALL), c AS (SELECT item_id, k, sum(n) AS nh FROM hg GROUP BY ALL), q AS (SELECT item_id, sum(coalesce(hit, 0) / nh) / 6 AS p, sum(coalesce(hit, 0) / nr) / 6 AS r FROM a JOIN c USING (item_id, k) LEFT JOIN m USING (item_id, k) GROUP BY item_id) SELECT item_id, round(CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 1)::DOUBLE AS chrf FROM q")
def sentence_chrf(spark, d):
    """Character n-gram F-score of one to six characters, recall twice as heavy, in per cent with one digit."""
    c = bench_chars(spark, d).select("item_id", whole.ngram_counts(F.col("ref"), F.col("hyp"), 6).alias("c"))
    p = sum((F.coalesce(F.try_divide(F.col("c")[3 * n], F.col("c")[3 * n + 2]), F.lit(0.0)) for n in range(6)), F.lit(0.0)) / 6
    r = sum((F.coalesce(F.try_divide(F.col("c")[3 * n], F.col("c")[3 * n + 1]), F.lit(0.0)) for n in range(6)), F.lit(0.0)) / 6
    return c.select("item_id", F.round(F.coalesce(F.try_divide(500 * p * r, 4 * p + r), F.lit(0.0)), 1).alias("chrf"))


def _marked(side: str) -> str:
    t = f"' ' || replace({side}, chr(10), ' ') || ' '"
    for pattern, put in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{pattern}', '{put}', 'g')"
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"


def _orders(n: int, side: str) -> str:
    return f"SELECT item_id, {n} AS k, array_to_string({side}[i:i + {n - 1}], ' ') AS g, count(*) AS n FROM b, unnest(range(1, greatest(len({side}) - {n - 2}, 1))) t(i) GROUP BY ALL"


@query(f"WITH b AS (SELECT item_id, {_marked('text')} AS ref, {_marked("replace(replace(text, ' the ', ' a '), ', ', '; 3,5 ')")} AS hyp FROM benchmark), rg AS ({' UNION ALL '.join(_orders(n, 'ref') for n in range(1, 5))}), hg AS ({' UNION ALL '.join(_orders(n, 'hyp') for n in range(1, 5))}), m AS (SELECT k, sum(least(rg.n, hg.n)) AS hit FROM rg JOIN hg USING (item_id, k, g) GROUP BY k), t AS (SELECT k, sum(n) AS total FROM hg GROUP BY k), pr AS (SELECT avg(ln(hit / total)) AS lp FROM m JOIN t USING (k)), l AS (SELECT sum(len(ref)) AS r, sum(len(hyp)) AS h FROM b) SELECT round(100 * exp(lp) * CASE WHEN h < r THEN exp(1 - r / h) ELSE 1 END, 2) AS bleu, CAST(r AS BIGINT) AS ref_len, CAST(h AS BIGINT) AS hyp_len FROM pr, l")
def bleu_words(spark, d):
    """BLEU of raw texts, marks cut from words."""
    b = table(spark, d, "benchmark").select("text", F.replace(F.replace("text", F.lit(" the "), F.lit(" a ")), F.lit(", "), F.lit("; 3,5 ")).alias("hyp"))
    c = b.select(whole.ngram_counts(bleu.words(F.col("text")), bleu.words(F.col("hyp")), 4).alias("c"))
    s = c.agg(*[F.sum(F.col("c")[k]).cast("double").alias(f"c{k}") for k in range(12)])
    counts = lambda k: [F.col(f"c{3 * n + k}") for n in range(4)]
    return s.select(F.round(bleu.score(counts(0), counts(2), F.col("c1"), F.col("c2")), 2).alias("bleu"), F.col("c1").cast("long").alias("ref_len"), F.col("c2").cast("long").alias("hyp_len"))


@query(f"WITH {PAIRS}, k AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM benchmark) WHERE length(w) >= 7), a AS (SELECT w, unnest(CASE WHEN length(w) % 2 = 1 THEN [w, w[1:5]] ELSE [w] END) AS alias FROM k), t AS (SELECT doc_id, lang, array_to_string(ref, ' ') AS r, array_to_string(hyp, ' ') AS h FROM p1), s AS (SELECT doc_id, lang, w, bool_or(contains(r, alias)) AS said, bool_or(contains(h, alias)) AS hit FROM t, a GROUP BY ALL) SELECT lang, count(*) AS total, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 4) AS krr FROM s WHERE said GROUP BY lang")
def keyword_recall(spark, d):
    """Keywords that a text contains, and those of them that its output contains too.

    Keywords are words of the benchmark with seven letters or more; those of an
    odd length have their first five letters as an alias.
    """
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("w")).where("length(w) >= 7").distinct()
    alias = F.when(F.length("w") % 2 == 1, F.array("w", F.substring("w", 1, 5))).otherwise(F.array("w"))
    aliases = words.select(F.xxhash64("w").alias("keyword"), F.explode(alias).alias("alias"))
    texts = whole_pairs(spark, d).select("lang", F.array_join("ref", " ").alias("ref"), F.array_join("hyp", " ").alias("hyp"))
    found = keywords.shared(texts, "ref", "hyp", aliases)
    hits = F.count_if("hit")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), hits.alias("hits"), F.round(hits / F.count(F.lit(1)), 4).alias("krr"))


# ---- scores ----------------------------------------------------------------------
@query("WITH e AS (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot, sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS n FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(CASE WHEN n > 0 THEN dot / n WHEN n = 0 THEN 0 END, 6) AS cosine FROM e")
def cosine_pairs(spark, d):
    return _cosines(spark, d).withColumn("cosine", F.round("cosine", 6))


def _cosines(spark, d) -> DataFrame:
    """Cosine of each vector and the next; null without a next one, 0 for a zero vector."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id", "left")
    norm = F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))
    return j.select("vec_id", F.when(norm > 0, dot("x", "y") / norm).when(norm == 0, 0.0).alias("cosine"))


@query("WITH e AS (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS c FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id % 10 AS run, round(avg(c), 4) AS semantic_mean, round(count(c) / count(*), 4) AS coverage FROM e GROUP BY 1")
def semantic_coverage(spark, d):
    return _cosines(spark, d).groupBy((F.col("vec_id") % 10).alias("run")).agg(F.round(F.avg("cosine"), 4).alias("semantic_mean"), F.round(F.count("cosine") / F.count(F.lit(1)), 4).alias("coverage"))


@query("WITH s AS (SELECT event_id, user_id, event_type AS severity, value / 500.0 AS score FROM events), c AS (SELECT user_id, count(*) AS spans, count(*) FILTER (WHERE severity = 'error') AS critical, count(*) FILTER (WHERE severity = 'click') AS major, count(*) FILTER (WHERE severity = 'view') AS minor, round(avg(score), 4) AS mean_score, round(count(score) / count(*), 4) AS coverage FROM s GROUP BY user_id) SELECT * FROM c")
def span_severities(spark, d):
    """Scored spans of each sample: counts by severity, mean score and coverage; the model that scores them is not run here."""
    s = table(spark, d, "events").select("user_id", F.col("event_type").alias("severity"), (F.col("value") / 500.0).alias("score"))
    of = lambda v: F.count_if(F.col("severity") == v)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("spans"), of("error").alias("critical"), of("click").alias("major"), of("view").alias("minor"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.count("score") / F.count(F.lit(1)), 4).alias("coverage"))


THRESHOLDS = tuple(t / 100 for t in range(20, 81))


@query("WITH s AS (SELECT l.toxic AS truth, (d.n_chars % 101) / 100.0 AS p FROM labels l JOIN documents d USING (doc_id)), t AS (SELECT unnest(range(20, 81)) / 100.0 AS thr), c AS (SELECT thr, count(*) FILTER (WHERE p >= thr AND truth = 1) AS tp, count(*) FILTER (WHERE p >= thr AND truth = 0) AS fp, count(*) FILTER (WHERE p < thr AND truth = 1) AS fn, count(*) FILTER (WHERE p < thr AND truth = 0) AS tn FROM s, t GROUP BY thr), f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c), g AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM f) SELECT thr::DOUBLE AS thr, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS fnr, row_number() OVER (ORDER BY round(f1, 6) DESC, thr DESC) = 1 AS best FROM g")
def threshold_sweep(spark, d):
    """Confusion and rates at thresholds from 0.20 to 0.80; best is the highest F1, of equal ones the highest threshold.

    A score passes the thresholds up to its own, so a histogram of scores and
    running sums over it give every row: one pass, whatever the thresholds.
    """
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("toxic", (F.col("n_chars") % 101).alias("cell"))
    hist = s.groupBy("cell").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"))
    # a hundred and one cells at most; the thresholds are rows too, without counts
    marks = spark.range(20, 81).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    cells = hist.unionByName(marks).groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    one = Window.partitionBy(F.lit(0))
    up = one.orderBy(F.desc("cell"))
    c = cells.select("cell", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(one).alias("p"), F.sum("neg").over(one).alias("n")).where("cell between 20 and 80")
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.select((F.col("cell") / 100).alias("thr"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))
    c = c.withColumn("pr", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("re", zero(F.col("tp"), F.col("tp") + F.col("fn")))
    c = c.withColumn("f1", F.round(zero(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re")), 6))
    best = F.row_number().over(one.orderBy(F.desc("f1"), F.desc("thr"))) == 1
    return c.select("thr", "tp", "fp", "fn", "tn", F.round("pr", 6).alias("precision"), F.round("re", 6).alias("recall"), "f1", F.round(zero(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"), F.round(zero(F.col("fn"), F.col("fn") + F.col("tp")), 6).alias("fnr"), best.alias("best"))


@query("WITH x AS (SELECT doc_id FROM labels WHERE toxic = 1), y AS (SELECT d.*, CASE WHEN x.doc_id IS NOT NULL THEN 'sample' WHEN source IN ('src1', 'src2') THEN 'speaker' END AS excluded_by FROM documents d LEFT JOIN x USING (doc_id)) SELECT coalesce(excluded_by, 'kept') AS excluded_by, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars % 17) / sum(n_chars), 6) AS err_rate, bit_xor(('0x' || sha256(CAST(doc_id AS VARCHAR))[1:15])::BIGINT) AS signature FROM y GROUP BY 1")
def reviewed_metric(spark, d):
    """The error rate over what is left after exclusions, and of what is left out; ids are signed by a sum that needs no order."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    samples = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("reason"))
    speakers = spark.createDataFrame([("src1", "quality"), ("src2", "quality")], "source string, reason string")
    y = curation.exclude(docs, samples, speakers, "doc_id", "source")
    sign = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("long")
    return y.groupBy(F.coalesce("excluded_by", F.lit("kept")).alias("excluded_by")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.round(F.sum(F.col("n_chars") % 17) / F.sum("n_chars"), 6).alias("err_rate"), F.bit_xor(sign).alias("signature"))


# ---- sets and pages -----------------------------------------------------------------
@query("WITH t AS (SELECT DISTINCT conv_id, lower(w) AS source, upper(w) AS target FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM conversations)) SELECT conv_id, count(*) AS n, sha256(string_agg(source || '=' || target, ',' ORDER BY source)) AS sha FROM t GROUP BY conv_id")
def glossary_dedup(spark, d):
    """Pairs of a term and its translation, once each."""
    w = table(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("w"))
    t = w.select("conv_id", F.lower("w").alias("source"), F.upper("w").alias("target")).distinct()
    g = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("source", "target"))).alias("p"))
    return g.select("conv_id", "n", F.sha2(F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["source"], x["target"])), ",").cast("binary"), 256).alias("sha"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND contains(lower(concat_ws(' ', event_id, user_id, event_type, value, props, ts::DATE, 'x')), '77') ORDER BY event_id LIMIT 50 OFFSET 20")
def search_page(spark, d):
    """Samples of a label whose columns, put together, hold the search text; a page of at most two hundred."""
    e = table(spark, d, "events").where("event_type = 'click'")
    text = F.lower(F.concat_ws(" ", "event_id", "user_id", "event_type", "value", "props", F.to_date("ts"), F.lit("x")))
    return e.where(F.contains(text, F.lit("77"))).select("event_id", "user_id", "event_type").orderBy("event_id").offset(20).limit(min(50, 200))
