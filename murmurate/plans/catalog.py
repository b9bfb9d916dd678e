"""Registry of the named queries and their SQL oracles.

The stand-ins for domain tables (manifest, pairs, log, segments, trace) are
built from the driver's tables by the same rules on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmurate.functions import align, bleu, english, quantiles, textnorm, whole
from murmurate.functions.bootstrap import poisson_interval, poisson_sql
from murmurate.functions.der import bootstrap_groups, diarization_error
from murmurate.operators import curation, logs, ranking
from murmurate.session import spread, table
from murmurate.streaming import trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- stand-ins -----------------------------------------------------------
def whole_pairs(spark, d) -> DataFrame:
    """All words of each document."""
    return _pairs(spark, d, align.tokens(F.col("text")))


def _pairs(spark, d, ref) -> DataFrame:
    """ref and hyp tokens, hyp with fixed deletions and substitutions."""
    # texts are spread, not words: those are larger, and one task may read a whole file
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", ref.alias("ref"))
    at = lambda i, k, m: (F.col("doc_id") * k + i + 1) % m == 0
    hyp = F.transform(F.filter(F.transform("ref", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~at(s["i"], 7, 11)), lambda s: F.when(at(s["i"], 3, 13), F.lit("x")).otherwise(s["x"]))
    return docs.withColumn("hyp", hyp)


PAIRS = r"""
p0 AS (SELECT doc_id, lang, source, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS ref FROM documents),
p1 AS (SELECT *, list_transform(list_filter(list_zip(ref, range(1, len(ref) + 1)), lambda s: (doc_id * 7 + s[2]) % 11 <> 0), lambda s: CASE WHEN (doc_id * 3 + s[2]) % 13 = 0 THEN 'x' ELSE s[1] END) AS hyp FROM p0)
"""


def log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("line_no"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("elapsed_s"), (1 + F.col("event_id") % 3).alias("workers"), (1 + F.col("event_id") % 3).alias("attempts"), F.when(F.col("event_type") == "error", F.concat(F.lit("reason "), F.col("event_id") % 7)).alias("error"))


LOG = "log AS (SELECT user_id AS id, event_id AS line_no, event_type <> 'error' AS ok, value AS elapsed_s, 1 + event_id % 3 AS workers, 1 + event_id % 3 AS attempts, CASE WHEN event_type = 'error' THEN 'reason ' || (event_id % 7) END AS error FROM events)"


def _ngram_sql(n: int, side: str) -> str:
    return f"SELECT doc_id, {n} AS k, array_to_string({side}[i:i + {n - 1}], ' ') AS g, count(*) AS n FROM p1, unnest(range(1, greatest(len({side}) - {n - 2}, 1))) t(i) GROUP BY ALL"


# ---- alignment metrics on whole texts; edits of words have no oracle, as SQL folds take the square of a text's length
@query()
def edit_wer_by_lang(spark, d):
    e = whole_pairs(spark, d).select("lang", F.size("ref").alias("len"), whole.edit_distance(F.col("ref"), F.col("hyp")).alias("edits"))
    return e.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("ref_len"), F.sum("edits").alias("edits"), F.coalesce(F.try_divide(F.sum("edits"), F.sum("len")), F.lit(0.0)).alias("wer"), F.avg((F.col("edits") > 0).cast("double")).alias("ser"))


@query()
def alignment_counts(spark, d):
    """Substitutions, deletions and insertions of words in every text; ``benchmark_alignment`` and ``alignment_rates`` hold the same kernel to SQL."""
    a = whole_pairs(spark, d).select("doc_id", whole.alignment(F.col("ref"), F.col("hyp")).alias("a"))
    return a.select("doc_id", (F.col("a")[0] + F.col("a")[1] + F.col("a")[2]).alias("edits"), F.col("a")[0].alias("subs"), F.col("a")[1].alias("dels"), F.col("a")[2].alias("ins"))


@query()
def alignment_rates_by_lang(spark, d):
    """Error rates of each language over whole texts; extra text is what the output inserts."""
    a = whole_pairs(spark, d).select("lang", F.size("ref").alias("n"), whole.alignment(F.col("ref"), F.col("hyp")).alias("a"))
    total = F.greatest(F.sum("n"), F.lit(1))
    sums = {name: F.sum(F.col("a")[k]) for k, name in enumerate(("subs", "dels", "ins"))}
    rates = [F.round(c / total, 6).alias(f"{name}_rate") for name, c in sums.items()]
    return a.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("ref_len"), *[c.alias(name) for name, c in sums.items()], *rates, F.round(sums["ins"] / total, 6).alias("extra_text_rate"))


# the engine's own distance is of bytes; these texts are ASCII
@query(f"WITH {PAIRS} SELECT doc_id, CAST(length(array_to_string(ref, ' ')) AS BIGINT) AS ref_len, CAST(levenshtein(array_to_string(ref, ''), array_to_string(hyp, '')) AS BIGINT) AS edits FROM p1 WHERE len(ref) > 0")
def cer_pairs(spark, d):
    p = whole_pairs(spark, d).select("doc_id", F.array_join("ref", " ").alias("r"), F.array_join("hyp", " ").alias("h")).where("r <> ''")
    return p.select("doc_id", F.length("r").cast("long").alias("ref_len"), whole.edit_distance(F.replace("r", F.lit(" "), F.lit("")), F.replace("h", F.lit(" "), F.lit(""))).alias("edits"))


@query(f"WITH {PAIRS}, r AS (SELECT doc_id, unnest(ref) AS x FROM p1), h AS (SELECT doc_id, unnest(hyp) AS x FROM p1), rc AS (SELECT doc_id, x, count(*) AS n FROM r GROUP BY ALL), hc AS (SELECT doc_id, x, count(*) AS n FROM h GROUP BY ALL), o AS (SELECT doc_id, sum(least(rc.n, hc.n)) AS hit FROM rc JOIN hc USING (doc_id, x) GROUP BY doc_id) SELECT p1.doc_id, CASE WHEN len(ref) + len(hyp) > 0 THEN 2.0 * coalesce(hit, 0) / (len(ref) + len(hyp)) END AS rouge1 FROM p1 LEFT JOIN o USING (doc_id)")
def rouge_unigram(spark, d):
    p = whole_pairs(spark, d).select("doc_id", whole.ngram_counts(F.col("ref"), F.col("hyp"), 1).alias("c"))
    return p.select("doc_id", F.try_divide(2.0 * F.col("c")[0], F.col("c")[1] + F.col("c")[2]).alias("rouge1"))


@query()
def rouge_lcs(spark, d):
    return whole_pairs(spark, d).select("doc_id", whole.lcs(F.col("ref"), F.col("hyp")).alias("lcs"))


@query(f"WITH {PAIRS}, rg AS ({' UNION ALL '.join(_ngram_sql(n, 'ref') for n in range(1, 5))}), hg AS ({' UNION ALL '.join(_ngram_sql(n, 'hyp') for n in range(1, 5))}), m AS (SELECT k, sum(least(rg.n, hg.n)) AS hit FROM rg JOIN hg USING (doc_id, k, g) GROUP BY k), t AS (SELECT k, sum(n) AS total FROM hg GROUP BY k), pr AS (SELECT avg(ln(hit / total)) AS lp FROM m JOIN t USING (k)), l AS (SELECT sum(len(ref)) AS r, sum(len(hyp)) AS h FROM p1) SELECT 100 * exp(lp) * CASE WHEN h < r THEN exp(1 - r / h) ELSE 1 END AS bleu, CAST(r AS BIGINT) AS ref_len, CAST(h AS BIGINT) AS hyp_len FROM pr, l")
def bleu_corpus(spark, d):
    rows = whole_pairs(spark, d).select(whole.ngram_counts(F.col("ref"), F.col("hyp"), 4).alias("c"))
    s = rows.agg(*[F.sum(F.col("c")[k]).cast("double").alias(f"c{k}") for k in range(12)])
    counts = lambda k: [F.col(f"c{3 * n + k}") for n in range(4)]
    return s.select(bleu.score(counts(0), counts(2), F.col("c1"), F.col("c2")).alias("bleu"), F.col("c1").cast("long").alias("ref_len"), F.col("c2").cast("long").alias("hyp_len"))


# no oracle: its character n-grams are too many rows
@query()
def chrf_corpus(spark, d):
    rows = whole_pairs(spark, d).select(whole.character_counts(F.array_join("ref", ""), F.array_join("hyp", ""), 6).alias("c"))
    s = rows.agg(*[F.sum(F.col("c")[k]).cast("double").alias(f"c{k}") for k in range(18)])
    prec = sum((F.col(f"c{3 * n}") / F.col(f"c{3 * n + 2}") for n in range(6)), F.lit(0.0)) / 6
    rec = sum((F.col(f"c{3 * n}") / F.col(f"c{3 * n + 1}") for n in range(6)), F.lit(0.0)) / 6
    return s.select((100 * 5 * prec * rec / (4 * prec + rec)).alias("chrf"))


# ---- logs --------------------------------------------------------------------
@query(f"WITH {LOG} SELECT id, line_no, ok, elapsed_s, workers, attempts, error FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ok DESC, CASE WHEN ok THEN -line_no ELSE line_no END) AS k FROM log) WHERE k = 1")
def log_dedup(spark, d):
    return logs.latest(log(spark, d))


@query(f"WITH {LOG} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM log WHERE ok)")
def resume_todo(spark, d):
    return logs.todo(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), log(spark, d))


@query(f"WITH {LOG}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ok DESC, CASE WHEN ok THEN -line_no ELSE line_no END) AS k FROM log) WHERE k = 1), j AS (SELECT c_mktsegment, coalesce(ok, false) AS ok FROM customer LEFT JOIN b ON id = c_custkey) SELECT c_mktsegment, count(*) AS n_total, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE ok) / count(*) AS coverage, count(*) FILTER (WHERE ok) / count(*) < 0.95 AS low_coverage FROM j GROUP BY ALL")
def success_coverage(spark, d):
    o = logs.outcomes(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), logs.latest(log(spark, d)))
    g = o.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(~F.col("failed")).alias("n_ok"))
    return g.withColumn("coverage", F.col("n_ok") / F.col("n_total")).withColumn("low_coverage", F.col("coverage") < 0.95)


@query(f"WITH {LOG} SELECT workers, quantile_cont(elapsed_s::DOUBLE, 0.5) AS p50, quantile_cont(elapsed_s::DOUBLE, 0.95) AS p95, quantile_cont(elapsed_s::DOUBLE, 0.99) AS p99, count(*) AS calls, count(*) FILTER (WHERE ok) / count(*) AS success_rate FROM log GROUP BY workers")
def inclusive_quantiles(spark, d):
    calls = log(spark, d)
    counts = calls.groupBy("workers").agg(F.count(F.lit(1)).alias("calls"), (F.count_if("ok") / F.count(F.lit(1))).alias("success_rate"))
    q = quantiles.exact(calls, ["workers"], "elapsed_s", {"p50": quantiles.inclusive(0.5), "p95": quantiles.inclusive(0.95), "p99": quantiles.inclusive(0.99)})
    return counts.join(q, "workers", "left").select("workers", "p50", "p95", "p99", "calls", "success_rate")


@query(f"WITH {LOG} SELECT id, CAST(sum(greatest(0, attempts - 1)) AS BIGINT) AS retries, avg(CASE WHEN attempts > 1 THEN 1.0 ELSE 0.0 END) AS retry_rate FROM log GROUP BY id")
def retry_stats(spark, d):
    return log(spark, d).groupBy("id").agg(F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).alias("retries"), F.avg((F.col("attempts") > 1).cast("double")).alias("retry_rate"))


@query(f"WITH {LOG} SELECT error AS reason, count(*) AS n, min(line_no) AS first_line FROM log WHERE NOT ok GROUP BY error ORDER BY n DESC, first_line LIMIT 5")
def fail_reasons_top5(spark, d):
    return log(spark, d).where("not ok").groupBy(F.col("error").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")).orderBy(F.desc("n"), "first_line").limit(5)


@query(f"WITH {LOG}, m AS (SELECT id, line_no, ok, sum(CAST(ok AS INT)) OVER (PARTITION BY id ORDER BY line_no) AS island FROM log) SELECT id AS by, min(line_no) AS first_line, count(*) AS length FROM m WHERE NOT ok GROUP BY id, island HAVING count(*) >= 3")
def breaker_runs(spark, d):
    return logs.failure_runs(log(spark, d), "id", "line_no", "ok", 3)
