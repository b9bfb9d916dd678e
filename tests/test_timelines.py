"""Timelines, previews, language summaries and cards of jobs, against results worked out by hand."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from murmurate.operators import timelines

RECORDINGS = "id long, duration_s double, source_text string, ref_text string, hyp string"
SEGMENTS = "id long, nth int, start_ms long, end_ms long, source_text string, ref_text string"
SAVED = "id long, nth int, start_s string, end_s string, emitted_at_s string, text string"


def test_source_timeline(spark):
    recordings = spark.createDataFrame([(1, 10.0, None, None, None), (2, 12.0, "ignored. As there are segments", None, None), (3, 45.0, "One two. Three four! Five six?", "一二。三四。", None), (4, 0.0, None, "", None)], RECORDINGS)
    segments = spark.createDataFrame([(1, 5, 500, 1500, "a", None), (1, 2, 0, 499, None, "b"), (2, 0, 0, 1000, "one two three", ""), (2, 1, None, 2000, "你好", ""), (2, 2, None, None, "", "")], SEGMENTS)
    got = {}
    for r in timelines.source_timeline(recordings, segments).orderBy("id", "index").collect():
        got.setdefault(r["id"], []).append(tuple(r)[1:])
    assert got[1] == [(1, 0.0, 0.499, "", "b", "exact"), (2, 0.5, 1.5, "a", "", "exact")]
    # weights 3, 2 and 1 of 12 seconds
    assert got[2] == [(1, 0.0, 6.0, "one two three", "", "estimated"), (2, 6.0, 10.0, "你好", "", "estimated"), (3, 10.0, 12.0, "", "", "estimated")]
    assert got[3] == [(1, 0.0, 15.0, "One two.", "一二。", "estimated"), (2, 15.0, 30.0, "Three four!", "三四。", "estimated"), (3, 30.0, 45.0, "Five six?", "", "estimated")]
    assert got[4] == [(1, 0.0, 0.0, "", "", "estimated")]
    assert timelines.source_timeline(recordings.limit(0), segments.limit(0)).count() == 0


@pytest.mark.parametrize("seconds,stretches", [(0.0, 1), (20.0, 1), (20.001, 2), (39.9, 2), (40.0, 2), (40.5, 3)])
def test_stretches_round_up(spark, seconds, stretches):
    r = spark.createDataFrame([(1, seconds, "", "", "")], RECORDINGS)
    assert timelines.source_timeline(r, spark.createDataFrame([], SEGMENTS)).count() == stretches


def test_translation_events(spark):
    recordings = spark.createDataFrame([(1, 30.0, None, None, "unused"), (2, 30.0, None, None, "One two. Three four five six."), (3, 30.0, None, None, None)], RECORDINGS)
    saved = spark.createDataFrame([(1, 0, "1.5", "20", "21.25", " later "), (1, 1, None, "-3", None, "first"), (1, 2, "x", "99.5", "-1", "last"), (1, 3, "0", "5", None, "  "), (1, 4, "0", "soon", None, "no end"), (2, 0, None, None, None, "no end")], SAVED)
    got = {}
    for r in timelines.translation_events(recordings, saved).orderBy("id", "index").collect():
        got.setdefault(r["id"], []).append(tuple(r)[1:])
    assert got[1] == [(1, None, 0.0, None, "first", "event"), (2, 1.5, 20.0, 21.25, "later", "event"), (3, None, 30.0, 0.0, "last", "event")]
    assert got[2] == [(1, None, 10.0, None, "One two.", "estimated"), (2, None, 30.0, None, "Three four five six.", "estimated")]
    assert 3 not in got


def test_previews(spark):
    rows = [(1, "s" * 500, "r" * 300, [1, 2, 3], None, ["a"], None), (2, "s" * 500, None, None, 9, None, "mt"), (3, None, "", None, None, [], "")]
    df = spark.createDataFrame(rows, "id long, source_text string, ref_text string, segments array<int>, segment_count int, terms array<string>, task string")
    a, b, c = timelines.previews(df, F.col("id") == 2).orderBy("id").collect()
    assert (len(a["source_text"]), a["source_chars"], a["ref_chars"], a["segment_count"], a["term_count"], a["task"]) == (400, 500, 300, 3, 1, "asr")
    assert (len(b["source_text"]), b["ref_text"], b["segment_count"], b["term_count"], b["task"], b["longform"]) == (500, "", 9, 0, "mt", True)
    assert (c["source_text"], c["segment_count"], c["term_count"]) == ("", None, 0)


def test_lid_summary(spark):
    rows = [("a", True, "yue", None, None, 0.5, 0.1), ("a", True, None, "zh", "north", 0.7, None), ("a", True, "", "zh", "north", None, None), ("a", False, "en", "en", None, 0.9, 0.9), ("a", None, None, None, None, None, None), ("a", True, None, None, None, None, None), ("b", False, "x", None, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "run string, ok boolean, label string, pred_language string, pred_dialect string, confidence double, service_rtf double")
    a, b = timelines.lid_summary(df, "run").orderBy("run").collect()
    assert [tuple(x) for x in a["labels"]] == [("zh north", 2, 0.5), ("(unknown)", 1, 0.25), ("yue", 1, 0.25)]
    assert (a["n_expected"], a["n_processed"], a["n_ok"], a["n_fail"], a["coverage"], a["progress"], a["n_labels"], a["confidence_mean"], a["rtf_mean"]) == (6, 6, 4, 2, 0.666667, 1.0, 3, 0.6, 0.1)
    assert (b["n_ok"], b["coverage"], b["labels"], b["confidence_mean"]) == (0, 0.0, [], None)
    assert timelines.lid_summary(df.withColumn("e", F.lit(10)), "run", expected="e").orderBy("run").first()["progress"] == 0.6


def cards(spark, lines):
    t = lambda m: datetime.datetime(2026, 3, 1, 12, m)
    df = spark.createDataFrame([(job, t(m), k, line) for k, (job, m, line) in enumerate(lines)], "job string, ts timestamp, seq long, line string")
    return {r["job"]: r for r in timelines.job_cards(df, F.lit(t(59)).cast("timestamp")).collect()}


def record(**fields):
    return "12:00 " + timelines.MARKER + json.dumps(fields, ensure_ascii=False) + "\n"


def test_job_cards(spark):
    got = cards(
        spark,
        [
            ("a", 0, "待跑 40"),
            ("a", 1, "7/40… ok"),
            ("a", 2, "8/40 without the dots"),
            ("b", 0, record(sample_index=1, sample_total=3, phase="started", audio_total_s=61.26)),
            ("b", 10, record(sample_index=2, sample_total=3, phase="segment", latest_text=" 你好 ", segments=4, audio_s="30.04")),
            ("b", 20, record(sample_index=2, sample_total=3, phase="completed", segments=-1)),
            ("b", 40, timelines.MARKER + "{broken"),
            ("b", 41, record(sample_index="many")),
            ("b", 42, timelines.MARKER + "[1]"),
            ("c", 50, record(sample_index=1, latest_text="t" * 300, sample_id="i" * 300)),
            ("d", 1, None),
        ],
    )
    assert (got["a"]["progress"], got["a"]["record"], got["a"]["stale"]) == ("7/40", None, None)
    b = got["b"]
    assert (b["progress"], b["record"]["phase"], b["record"]["segments"], b["record"]["latest_text"], b["latest_phase"], b["silent_minutes"], b["stale"]) == ("2/3", "completed", 0, "", "segment", 39.0, True)
    c = got["c"]
    assert (c["progress"], c["record"]["phase"], len(c["record"]["latest_text"]), len(c["record"]["sample_id"]), c["record"]["sample_total"], c["latest_phase"], c["stale"]) == (None, "streaming", 240, 200, None, None, False)
    assert got["d"]["progress"] is None


def test_progress_records(spark):
    lines = [record(audio_s=30.04, audio_total_s=None, sample_index=2.9, sample_total=3), "nothing", None, record(audio_s="long")]
    a, *rest = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").coalesce(1).orderBy("k").select(timelines.progress_record(F.col("line"))).collect()]
    assert (a["audio_s"], a["audio_total_s"], a["sample_index"]) == (30.0, 0.0, 2) and rest == [None, None, None]
