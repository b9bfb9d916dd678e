import datetime

import pytest
from pyspark.sql import functions as F

from murmurate.functions import spans, whole
from murmurate.operators import curation, external, logs


def test_embeddings_are_fetched_once_and_may_fail(spark):
    d = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "", "a"), (4, "zz", "a"), (5, None, "a"), (6, "zero", "a")], "id long, ref string, hyp string")

    def embed(texts):
        if "zz" in texts:
            raise OSError("down")
        return [{"a": [1.0, 0.0], "b": [1.0, 1.0], "zero": [0.0, 0.0]}[t] for t in texts]

    got = {r["id"]: r["cosine"] for r in external.embedded(d, embed, size=1, retries=1, pause=0.0).collect()}
    assert got == {1: 1.0, 2: pytest.approx(0.5**0.5), 3: None, 4: None, 5: None, 6: 0.0}


def test_scores_and_retries(spark):
    d = spark.createDataFrame([(k, "x" * k) for k in range(5)], "id long, text string")
    got = external.scored(d, ["text"], lambda rows: [float(len(r["text"])) if r["text"] else None for r in rows], size=2)
    assert {r["id"]: r["score"] for r in got.collect()} == {0: None, 1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}
    s = external.score_summary(got.withColumn("run", F.lit("r")), "run").first()
    assert (s["mean"], s["coverage"]) == (2.5, 0.8)
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return batch

    assert external.patient(flaky, [1, 2], pause=0.0) == [1, 2] and len(calls) == 3
    assert external.patient(lambda b: b[:1], [1, 2], retries=0) == [None, None]


def test_speech_fidelity(spark):
    d = spark.createDataFrame([("1", "en", "a b c", "a x c"), ("2", "en", "d", None), ("3", "zh", "a b", "a b")], "id string, target_lang string, hyp string, transcript string")
    got = {r["target_lang"]: (r["samples"], r["tts_err"]) for r in external.speech_fidelity(d, whole.edit_distance, lambda c: F.split(c, " ")).collect()}
    assert got == {"en": (1, 0.3333), "zh": (1, 0.0)}


def test_spans():
    assert spans.reference_spans("今 天 好明 天 也 好", 3) == [(0, 3), (3, 7)]
    assert spans.reference_spans("今 天 好明 天 好a b", 3) == [(0, 3), (3, 8)]
    assert spans.reference_spans("今 天", 9) == [(0, 2)] and spans.reference_spans("今 天 好明", 3) == [(0, 4)]
    assert spans.character_map("abcd", "abXYd") == [0, 1, 2, 4, 5]
    assert spans.character_map("", "xy") == [2]
    assert [spans.word_cut("one two", k) for k in (0, 2, 3, 5, 9)] == [0, 3, 3, 3, 7] and spans.word_cut("abc", 1) == 1


def test_aligned_units(spark):
    d = spark.createDataFrame([("good day to all", "今 天 好明 天 也 好", "今天好 明天好", "good day two all"), (None, None, "x", None)], "s string, r string, h string, t string")
    got = [r["u"] for r in d.select(spans.units(F.col("s"), F.col("r"), F.col("h"), F.col("t")).alias("u")).collect()]
    assert [x["ref"] for x in got[0]] == ["今天好明天也好"] and got[1] == []
    u = spans.aligned_units("good day to all", "今 天 好明 天 也 好", "今天好 明天好", "good day two all", 3)
    assert [(x["ref"], x["hyp"], x["source"]) for x in u] == [("今天好", "今天好", "good"), ("明天也好", "明天好", "day to all")]


def test_subsets(spark):
    d = spark.createDataFrame([("Ji-Lu Mandarin",), ("Beijing",), (None,), ("real-home",)], "x string")
    take = lambda c: [r["x"] for r in d.where(c).collect()]
    assert take(curation.in_subset(F.col("x"), "ji lu, zz")) == ["Ji-Lu Mandarin"] and len(take(curation.in_subset(F.col("x"), " "))) == 4
    assert take(curation.in_subset(F.col("x"), "BJ", {"bj": "Beijing"})) == ["Beijing"]
    with pytest.raises(ValueError, match="xx"):
        curation.in_subset(F.col("x"), "xx", {"bj": "Beijing"})
    assert take(curation.genuine(F.col("x"))) == ["real-home"]


def test_job_logs(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 12, m)
    d = spark.createDataFrame([("a", t(0), "3/10 done"), ("a", t(5), "4 / 10"), ("a", t(6), "warm"), ("b", t(50), "hello")], "job string, ts timestamp, line string")
    got = {r["job"]: tuple(r)[1:] for r in logs.progress(d, F.lit(t(59)).cast("timestamp")).collect()}
    assert got == {"a": (4, 10, 0.4, 53.0, True), "b": (None, None, None, 9.0, False)}
    log = spark.createDataFrame([("1", 1, False), ("1", 2, True), ("__meta__", 3, True), ("2", 4, False), ("", 5, True)], "id string, line_no long, ok boolean")
    assert sorted((r["id"], r["ok"]) for r in logs.lid_records(log).collect()) == [("1", True), ("2", False)]
    assert [r["id"] for r in logs.lid_records(log, reader=False).collect()] == ["1"]
