import random

import pytest
from pyspark.sql import functions as F

from murmurate.streaming import trace

EVENTS = "id string, seq long, op string, text string, source_s double, wall_s double"


def talk(spark):
    rows = [("t", 0, "replace", "Hellx", 1.0, 1.2), ("t", 1, "replace", "Hello", 1.4, 1.7), ("t", 2, "commit", "Hello", 1.8, 2.1), ("t", 3, "append", " world", 2.2, 2.6), ("t", 4, "commit", "world", 2.5, 3.0), ("t", 5, "final", "Hello world", 3.0, 3.5)]
    return spark.createDataFrame(rows, EVENTS)


def test_summary(spark):
    r = trace.summarize(talk(spark), "id").first()
    assert r.asDict() == {"id": "t", "ttfb_visible": 1.2, "ttfb_stable": 2.1, "updates": 3, "revisions": 1, "observable": True, "revision_rate": 0.3333, "revised_chars": 1, "churn_rate": 0.1}
    rows = [("a", 0, "replace", "hello", 0.0, None), ("a", 1, "replace", "help me", 0.0, 2.0), ("a", 2, "commit", "help me", 0.0, 3.0), ("a", 3, "final", "help me", 0.0, 4.0), ("b", 0, "commit", "x", 1.0, None), ("c", 0, "odd", "x", 1.0, 1.0)]
    got = {r["id"]: r for r in trace.summarize(spark.createDataFrame(rows, EVENTS), "id").collect()}
    assert got["a"]["churn_rate"] == 0.3333 and got["a"]["revised_chars"] == 2 and got["a"]["ttfb_visible"] is None
    assert got["b"]["observable"] is False and got["b"]["churn_rate"] is None and got["b"]["revision_rate"] is None
    assert got["c"]["updates"] == 0 and got["c"]["ttfb_visible"] is None


def test_replay(spark):
    shown = [(r["display_text"], r["committed_text"]) for r in trace.replay(talk(spark), "id").orderBy("seq").collect()]
    assert shown == [("Hellx", ""), ("Hello", ""), ("Hello", "Hello"), ("Hello world", "Hello"), ("Hello world", "Hello world"), ("Hello world", "Hello world")]


def test_unit_delays(spark):
    final = spark.createDataFrame([("t", "Hello world", "en")], "id string, final_text string, target_lang string")
    for timing, delays, elapsed in (("stable", [1800.0, 2500.0], [2100.0, 3000.0]), ("visible", [1400.0, 2200.0], [1700.0, 2600.0])):
        r = trace.unit_delays(talk(spark), final, "id", timing).first()
        assert (r["prediction"], r["unit"], r["delays"], r["elapsed"]) == ("Hello world", "word", delays, elapsed)
    with pytest.raises(Exception, match="does not cover"):
        trace.unit_delays(talk(spark), final.withColumn("final_text", F.lit("Hello there")), "id").collect()


def test_legacy_trace(spark):
    s = spark.createDataFrame([("t", 0, "你好", 1.25, None), ("t", 1, "世界", None, 2.5), ("t", 2, " ", 3.0, None), ("t", 3, "x", None, None)], "id string, segment_id long, text string, end_s double, emitted_at_s double")
    commits = trace.legacy_events(s, "id")
    r = trace.unit_delays(commits, spark.createDataFrame([("t", "你好 世界", "zh")], "id string, final_text string, target_lang string"), "id").first()
    assert (r["prediction"], r["delays"], r["elapsed"]) == ("你好世界", [1250.0, 1250.0, 2500.0, 2500.0], None)
    assert trace.summarize(commits, "id").first()["observable"] is False


def test_record_drops_what_says_nothing(spark):
    rows = [("t", 0, "append", "", 1.0, 1.0), ("t", 1, "replace", "a", 1.0, 1.0), ("t", 2, "replace", "a", 2.0, None), ("t", 3, "commit", "  ", 2.0, 2.0), ("t", 4, "commit", " a ", None, 2.0004), ("t", 5, "final", " a", 3.0, 3.0)]
    got = [tuple(r)[1:] for r in trace.record(spark.createDataFrame(rows, EVENTS), "id").orderBy("seq").collect()]
    assert got == [(0, "replace", "a", 1.0, 1.0), (1, "commit", "a", 0.0, 2.0), (2, "final", "a", 3.0, 3.0)]


def test_units_and_prefixes(spark):
    assert trace.units("don't stop, 3 x_y!", "en") == ["don't", "stop", ",", "3", "x", "y", "!"]
    assert trace.units("你好 a", None) == ["你", "好", "a"]
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))) for _ in range(200)]
    d = spark.createDataFrame(rows, "a string, b string").select("a", "b", trace.common_prefix(F.col("a"), F.col("b")).alias("n"))
    assert all(r["n"] == trace.shared(r["a"], r["b"]) for r in d.collect())


def test_increments(spark):
    d = spark.createDataFrame([("t", 0, "a"), ("t", 1, "a b"), ("t", 2, "a c"), ("t", 3, "a c"), ("u", 0, None)], "id string, seq long, text string")
    got = {r["id"]: (r["updates"], r["revisions"]) for r in trace.increments(d, "id").collect()}
    assert got == {"t": (3, 1), "u": (0, 0)}


def test_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{k}", n, rng.choice(["append", "replace", "commit", "final", "odd"]), rng.choice(["a", "ab", "", None, "b c"]), 0.0, 0.0) for k in range(5) for n in range(20)]
    first, second = [r for r in rows if r[1] < 12], [r for r in rows if r[1] >= 12] + [("k0", 3, "append", "late", 0.0, 0.0)]
    source = f"{tmp_path}/in"
    out = {}

    def keep(df, _):
        out.update({r["id"]: r for r in df.collect()})

    for n, part in enumerate((first, second)):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = trace.replay_stream(spark.readStream.schema(EVENTS).parquet(source), "id")
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start()
        assert q.awaitTermination(120), n
    d = spark.createDataFrame(rows, EVENTS)
    want = {r["id"]: r for r in trace.summarize(d, "id").collect()}
    size = {}
    for r in trace.replay(d, "id").orderBy("seq").collect():
        size[r["id"]] = len(r["committed_text"])
    assert {k: (r["updates"], r["revisions"], r["committed_chars"], r["late"]) for k, r in out.items()} == {k: (r["updates"], r["revisions"], size[k], int(k == "k0")) for k, r in want.items()}
