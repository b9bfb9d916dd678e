import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmurate.operators import curation
from murmurate.streaming import sessions, trace

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
EVENTS = f"id string, {sessions.EVENT}, ts timestamp"


def events(seed, recordings=4, n=14):
    rng = random.Random(seed)
    rows = []
    for k in range(recordings):
        words = []
        for seq in range(n):
            op = "final" if seq == n - 1 else rng.choice(["append", "replace", "commit"])
            if op == "commit":
                words.append(rng.choice("abcde"))
            text = " ".join(words) if op == "final" else words[-1] if op == "commit" else rng.choice(["x", "xy", ""])
            rows.append((f"k{k}", seq, op, text, float(seq), float(seq) + 0.25, "en", T0 + timedelta(seconds=100 * k + seq)))
    return rows


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def test_closed_recordings_are_the_batch(spark, rocks, tmp_path):
    """Shuffled micro-batches give the delays of the batch walk, each recording once, and its state goes with it."""
    rows = events(1)
    rng = random.Random(2)
    source, out = f"{tmp_path}/in", {}
    seen = []

    def keep(df, _):
        for r in df.collect():
            seen.append(r["id"])
            out[r["id"]] = (r["prediction"], r["unit"], list(r["delays"]), list(r["elapsed"] or []))

    # recordings follow each other, their events are shuffled; the last row only moves the watermark
    end = [("end", 0, "append", "x", 0.0, 0.0, "en", T0 + timedelta(hours=2))]
    parts = [rows[:28], rows[28:], end, [("end", 1, "append", "y", 0.0, 0.0, "en", T0 + timedelta(hours=2, seconds=1))]]
    held = []
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = sessions.unit_delays_stream(spark.readStream.schema(EVENTS).parquet(source), "id", 60.0)
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None)
    d = spark.createDataFrame(events(1), EVENTS)
    finals = d.where("op = 'final'").select("id", F.col("text").alias("final_text"), "target_lang")
    want = {r["id"]: (r["prediction"], r["unit"], list(r["delays"]), list(r["elapsed"] or [])) for r in trace.unit_delays(d.drop("target_lang"), finals, "id").collect()}
    assert out == want and sorted(seen) == sorted(want)
    assert set(held) == {2}  # after each run the events and the clock of the last recording only


def test_delays_of_both_timings(spark):
    d = spark.createDataFrame(events(3), EVENTS)
    finals = d.where("op = 'final'").select("id", F.col("text").alias("final_text"), "target_lang")
    for timing in ("stable", "visible"):
        want = {r["id"]: (r["prediction"], r["unit"], list(r["delays"]), r["elapsed"] and list(r["elapsed"])) for r in trace.unit_delays(d.drop("target_lang"), finals, "id", timing).collect()}
        for k, part in d.toPandas().groupby("id"):
            got = sessions.delays_of(part.sample(frac=1, random_state=1), timing)
            assert got == want[k], (timing, k)
    assert sessions.delays_of(pd.DataFrame(columns=[f.split()[0] for f in sessions.EVENT.split(", ")])) == ("", "word", [], None)


def test_resume_writes_each_id_once(spark, tmp_path):
    """Runs that are stopped and started again from the checkpoint, with repeated and failed records."""
    schema = "id string, ok boolean, hyp string, ts timestamp"
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [("a", True, "1", at(0)), ("b", False, None, at(1)), ("a", True, "2", at(2)), ("c", None, "x", at(2))],
        [("a", True, "3", at(10)), ("b", True, "4", at(11)), ("b", True, "5", at(12))],
        [("b", True, "6", at(20)), ("c", True, "7", at(21))],
        [("c", True, "7", at(22))],
    ]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        q = sessions.write_batches(sessions.resumed(spark.readStream.schema(schema).parquet(source)), out, f"{tmp_path}/state")
        assert q.awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert sorted(r["id"] for r in got) == ["a", "b", "c"]


def test_repeated_batch_adds_nothing(spark, tmp_path):
    """A batch that is written again, as after a failure between the write and the commit, replaces its own rows."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1,), (2,)], "x int").coalesce(1).write.parquet(source)
    for checkpoint in ("one", "two"):  # the second run knows nothing of the first
        q = sessions.write_batches(spark.readStream.schema("x int").parquet(source), out, f"{tmp_path}/{checkpoint}")
        assert q.awaitTermination(120)
    assert sorted(r["x"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_sessions_and_late_rows(spark, tmp_path):
    """Late rows of a stream are kept in a table of their own, the same that the batch rule names."""
    schema = "k string, value double, ts timestamp, batch int"
    minutes = [[0, 5, 30], [29, 12, 60], [61, 49, 50, 1], []]
    parts = [[("u", 1.0, T0 + timedelta(minutes=m), b) for m in part] for b, part in enumerate(minutes)]
    source = f"{tmp_path}/in"
    for part in parts[:3]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        q = sessions.keep_late(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/out", f"{tmp_path}/state", "10 minutes")
        assert q.awaitTermination(120)
    minute = lambda df: sorted(int((r["ts"].replace(tzinfo=timezone.utc) - T0).total_seconds() // 60) for r in df.collect())
    late, on_time = spark.read.parquet(f"{tmp_path}/out/late").drop("batch"), spark.read.parquet(f"{tmp_path}/out/on_time").drop("batch")
    assert minute(late) == [1, 12, 49] and minute(on_time) == [0, 5, 29, 30, 50, 60, 61]
    rule = sessions.lateness(spark.createDataFrame(sum(parts, []), schema), "batch", "10 minutes")
    assert minute(rule.where("late")) == [1, 12, 49]
    runs = [(r["n"], r["total"]) for r in sessions.sessions(on_time, "k", "10 minutes").orderBy("start").collect()]
    assert runs == [(2, 2.0), (2, 2.0), (3, 3.0)]


def test_conflicting_ids(spark):
    rows = [("a", "x", b"1"), ("a", "x", b"1"), ("b", "x", b"1"), ("b", "y", b"1"), ("c", "x", None), ("c", "x", b""), ("d", None, b"1")] + [("hot", "t", b"2")] * 500
    d = spark.createDataFrame(rows, "id string, text string, audio binary").repartition(4)
    got = {r["id"]: (r["n"], r["verdict"], r["first"] == r["last"]) for r in curation.resolve_ids(d, "id", ["text", "audio"]).collect()}
    assert got == {"a": (2, "repeat", True), "b": (2, "conflict", False), "c": (2, "conflict", False), "d": (1, "single", True), "hot": (500, "repeat", True)}
    with pytest.raises(ValueError, match="b, c"):
        curation.without_repeats(d, "id", ["text", "audio"])
    assert curation.without_repeats(d.where("id in ('a', 'hot')"), "id", ["text", "audio"]).count() == 2
