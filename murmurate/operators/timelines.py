"""Recordings shown: source and translation timelines, previews; runs shown: language summary and cards of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.operators.scoring import balanced_groups, lid_label, text_units, text_weight

#: Seconds of a stretch of a recording without segments.
STRETCH = 20.0
#: Characters of a text in a preview.
PREVIEW = 400
# The word that a progress line has before its record, the phases with a text, and the limits of its fields.
MARKER = "@@LONGFORM_PROGRESS "
TEXT_PHASES = ("partial", "revision", "segment")
ID_CHARS, TEXT_CHARS, PHASE_CHARS = 200, 240, 40
PROGRESS = "sample_index string, sample_total string, segments string, audio_s string, audio_total_s string, sample_id string, latest_text string, phase string"


def _shared(weighted: DataFrame, order: str) -> tuple[Column, Column]:
    """Shares of a recording's weight (columns id, w) before and after each row."""
    by = Window.partitionBy("id")
    total, upto = F.sum("w").over(by), F.sum("w").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return (upto - F.col("w")) / total, upto / total


def source_timeline(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """id, index (from 1), start_s, end_s, source_text, ref_text and kind of each stretch of a recording.

    ``recordings``: id, duration_s, source_text, ref_text; ``segments``: id, nth,
    start_ms, end_ms, source_text, ref_text.  Segments are exact if all of their
    recording's have both times, else they share its duration by their weight.  A
    recording without segments is cut into equal stretches of about 20 seconds,
    over which its sentences are spread in order.  Segments of one recording meet
    in one task, recordings do not.
    """
    by = Window.partitionBy("id")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    timed = F.min((F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()).cast("int")).over(by) == 1
    w = segments.select("*", text_weight(F.col("source_text")).alias("w"))
    before, after = _shared(w, "nth")
    cut = w.select("id", F.row_number().over(by.orderBy("nth")).alias("index"), timed.alias("timed"), "start_ms", "end_ms", before.alias("a"), after.alias("b"), text("source_text").alias("source_text"), text("ref_text").alias("ref_text"))
    j = cut.join(recordings.select("id", "duration_s"), "id")
    at = lambda ms, share: F.round(F.when(F.col("timed"), F.col(ms) / 1000.0).otherwise(F.col("duration_s") * F.col(share)), 3)
    known = j.select("id", "index", at("start_ms", "a").alias("start_s"), at("end_ms", "b").alias("end_s"), "source_text", "ref_text", F.when(F.col("timed"), "exact").otherwise("estimated").alias("kind"))

    rest = recordings.join(segments.select("id").distinct(), "id", "left_anti")
    # the added part of a second only rounds up
    n = F.greatest(F.lit(1), F.floor((F.col("duration_s") + STRETCH - 0.001) / STRETCH).cast("int"))
    groups = rest.select("id", "duration_s", n.alias("n"), F.posexplode(F.arrays_zip(balanced_groups(text_units(F.col("source_text")), n).alias("s"), balanced_groups(text_units(F.col("ref_text")), n).alias("r"))).alias("k", "g"))
    edge = lambda k: F.round(k * F.col("duration_s") / F.col("n"), 3)
    guessed = groups.select("id", (F.col("k") + 1).alias("index"), edge(F.col("k")).alias("start_s"), edge(F.col("k") + 1).alias("end_s"), F.col("g.s").alias("source_text"), F.col("g.r").alias("ref_text"), F.lit("estimated").alias("kind"))
    return known.unionByName(guessed)


def translation_events(recordings: DataFrame, saved: DataFrame) -> DataFrame:
    """id, index (from 1), start_s, end_s, emitted_at_s, text and kind of a recording's translated stretches, by their end.

    ``recordings``: id, duration_s, hyp; ``saved``: id, nth, start_s, end_s,
    emitted_at_s (numbers or texts) and text.  Saved ones need an end that is a
    number and a text; times are kept within the recording.  Where a recording has
    none of these, the sentences of its translation share the duration by weight.
    """
    number = lambda c: F.col(c).cast("string").try_cast("double")
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.col("duration_s"), number(c)))
    said = F.trim(F.coalesce("text", F.lit("")))
    good = saved.select("id", "nth", "start_s", "end_s", "emitted_at_s", said.alias("text")).where(number("end_s").isNotNull() & (F.col("text") != ""))
    j = good.join(recordings.select("id", "duration_s"), "id")
    # a missing number would be left out by least and greatest
    time = lambda c, v: F.when(number(c).isNotNull(), F.round(v, 3))
    rows = j.select("id", "nth", time("start_s", inside("start_s")).alias("start_s"), time("end_s", inside("end_s")).alias("end_s"), time("emitted_at_s", F.greatest(F.lit(0.0), number("emitted_at_s"))).alias("emitted_at_s"), "text")
    index = F.row_number().over(Window.partitionBy("id").orderBy("end_s", "nth"))
    known = rows.select("id", index.alias("index"), "start_s", "end_s", "emitted_at_s", "text", F.lit("event").alias("kind"))

    none = F.lit(None).cast("double")
    units = recordings.join(good.select("id").distinct(), "id", "left_anti").select("id", "duration_s", F.posexplode(text_units(F.col("hyp"))).alias("k", "text")).withColumn("w", text_weight(F.col("text")))
    _, after = _shared(units, "k")
    guessed = units.select("id", (F.col("k") + 1).alias("index"), none.alias("start_s"), F.round(F.col("duration_s") * after, 3).alias("end_s"), none.alias("emitted_at_s"), "text", F.lit("estimated").alias("kind"))
    return known.unionByName(guessed)


def previews(rows: DataFrame, longform: Column) -> DataFrame:
    """id, texts (whole ones of long forms, else their first 400 characters), their lengths, segment_count, term_count and task.

    ``rows``: id, source_text, ref_text, segments (array), segment_count (goes before the array's size), terms (array), task.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    short = lambda c: F.when(longform, text(c)).otherwise(F.substring(text(c), 1, PREVIEW)).alias(c)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return rows.select(
        "id",
        short("source_text"),
        short("ref_text"),
        F.length(text("source_text")).cast("long").alias("source_chars"),
        F.length(text("ref_text")).cast("long").alias("ref_chars"),
        F.coalesce(F.col("segment_count").cast("long"), size("segments")).alias("segment_count"),
        F.coalesce(size("terms"), F.lit(0)).alias("term_count"),
        F.coalesce(F.nullif("task", F.lit("")), F.lit("asr")).alias("task"),
        longform.alias("longform"),
    )


def lid_summary(samples: DataFrame, *by: str, expected: str | None = None) -> DataFrame:
    """One row of each run: counts, coverage, progress, means of what is there, and its labels with counts and rates, most frequent first.

    ``samples``: ``by``, ok, label, pred_language, pred_dialect, confidence,
    service_rtf and, if named, the run's expected number; failed samples count in
    no label or mean.  Samples are summed by label before they are shuffled; a run
    then has a row a label.
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    s = samples.select(*by, ok.alias("_ok"), F.when(ok, lid_label(ok, F.col("label"), F.col("pred_language"), F.col("pred_dialect"))).alias("_label"), F.when(ok, F.col("confidence")).alias("_c"), F.when(ok, F.col("service_rtf")).alias("_r"), (F.col(expected) if expected else F.lit(None)).cast("long").alias("_e"))
    g = s.groupBy(*by, "_label").agg(F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("ok"), F.max("_e").alias("e"), *[f(c).alias(f"{c}_{k}") for c in ("_c", "_r") for k, f in (("s", F.sum), ("n", F.count))])
    labels = F.array_sort(F.collect_list(F.when(F.col("_label").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("_label").alias("label")))))
    t = g.groupBy(*by).agg(F.sum("n").alias("n_processed"), F.sum("ok").alias("n_ok"), F.max("e").alias("e"), labels.alias("l"), *[F.sum(c).alias(c) for c in ("_c_s", "_c_n", "_r_s", "_r_n")])
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    n = F.coalesce(F.nullif("e", F.lit(0)), F.col("n_processed"))
    return t.select(
        *by,
        n.alias("n_expected"),
        "n_processed",
        "n_ok",
        (F.col("n_processed") - F.col("n_ok")).alias("n_fail"),
        share(F.col("n_ok"), F.col("n_processed")).alias("coverage"),
        share(F.col("n_processed"), n).alias("progress"),
        F.size("l").cast("long").alias("n_labels"),
        F.round(F.try_divide("_c_s", "_c_n"), 6).alias("confidence_mean"),
        F.round(F.try_divide("_r_s", "_r_n"), 6).alias("rtf_mean"),
        F.transform("l", lambda x: F.struct(x["label"].alias("label"), (-x["k"]).alias("count"), F.round(-x["k"] / F.col("n_ok"), 6).alias("rate"))).alias("labels"),
    )


def progress_record(line: Column, marker: str = MARKER) -> Column:
    """struct of a progress line's record (null for another line, or one whose numbers are none): counts at least 0, seconds with one digit, cut texts."""
    at = F.instr(line, F.lit(marker))
    raw = F.from_json(F.trim(F.substring(line, at + len(marker), F.length(line))), PROGRESS)
    whole = lambda c: F.floor(raw[c].try_cast("double")).cast("long")
    said = lambda c: F.coalesce(F.nullif(raw[c], F.lit("")), F.lit("0"))
    counts, seconds = ("sample_index", "sample_total", "segments"), ("audio_s", "audio_total_s")
    good = (at > 0) & (F.octet_length(F.coalesce(F.to_json(raw), F.lit(""))) > 2)
    for c in counts:
        good &= raw[c].isNull() | whole(c).isNotNull()
    for c in seconds:
        good &= said(c).try_cast("double").isNotNull()
    text = lambda c, n: F.substring(F.trim(F.coalesce(raw[c], F.lit(""))), 1, n)
    record = F.struct(
        *[F.greatest(F.when(raw[c].isNotNull(), F.lit(0)), whole(c)).alias(c) for c in counts],
        *[F.greatest(F.lit(0.0), F.round(said(c).try_cast("double"), 1)).alias(c) for c in seconds],
        text("sample_id", ID_CHARS).alias("sample_id"),
        text("latest_text", TEXT_CHARS).alias("latest_text"),
        F.substring(F.coalesce(F.nullif(raw["phase"], F.lit("")), F.lit("streaming")), 1, PHASE_CHARS).alias("phase"),
    )
    return F.when(F.coalesce(good, F.lit(False)), record)


def job_cards(lines: DataFrame, now: Column, stale_minutes: float = 30.0, marker: str = MARKER) -> DataFrame:
    """A card of each job from its output (job, ts, seq, line): progress, the last record, the last phase with a text, and how long ago the last record came.

    Progress is what the last line that tells of it says: a record (a sample
    counts when it is completed), ``n/N…``, or the number that is still to do.
    Only the last of each is kept while lines are summed, so a job may say any
    number of lines.
    """
    r = F.col("r")
    d = lines.select("job", "ts", "seq", "line", progress_record(F.col("line"), marker).alias("r"))
    done = F.greatest(F.lit(0).cast("long"), F.when(r["phase"] == "completed", r["sample_index"]).otherwise(r["sample_index"] - 1))
    own = F.when((r["sample_index"] > 0) & (r["sample_total"] > 0), F.concat_ws("/", done.cast("string"), r["sample_total"].cast("string")))
    pair = F.regexp_extract("line", r"(\d+/\d+)…", 1)
    left = F.regexp_extract("line", r"待跑 (\d+)", 1)
    told = F.when(r.isNotNull(), own).when(pair != "", pair).when(left != "", F.concat(F.lit("0/"), left))
    last = F.struct("ts", "seq")
    g = d.select("job", "ts", last.alias("at"), "r", told.alias("told")).groupBy("job").agg(
        F.max_by("told", F.when(F.col("told").isNotNull(), F.col("at"))).alias("progress"),
        F.max_by("r", F.when(r.isNotNull(), F.col("at"))).alias("record"),
        F.max_by(r["phase"], F.when(r["phase"].isin(*TEXT_PHASES) & (r["latest_text"] != ""), F.col("at"))).alias("latest_phase"),
        F.max(F.when(r.isNotNull(), F.col("ts"))).alias("heartbeat"),
    )
    age = (F.unix_timestamp(now) - F.unix_timestamp("heartbeat")) / 60.0
    return g.select("job", "progress", "record", "latest_phase", "heartbeat", F.round(age, 1).alias("silent_minutes"), (age > stale_minutes).alias("stale"))
