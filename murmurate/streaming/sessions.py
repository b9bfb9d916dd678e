"""Streams that end: recordings that close, runs that resume, sessions, and rows that come too late.

Everything that is written is named by its micro-batch and written as a whole, so
a batch that is run again after a failure replaces its own rows and adds none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from murmurate.streaming.trace import Replay, by_character, shared, units

EVENT = "seq long, op string, text string, source_s double, wall_s double, target_lang string"
DELAYS = "prediction string, unit string, delays array<double>, elapsed array<double>"


def delays_of(events: pd.DataFrame, timing: str = "stable") -> tuple[str, str, list[float], list[float] | None]:
    """(prediction, unit, delays, elapsed) of the events of one recording; its final text is what is committed at its end."""
    events = events.sort_values("seq")
    target = next((x for x in events["target_lang"] if isinstance(x, str)), None)
    shown, state = [], Replay()
    for op, text, source, wall in zip(events["op"], events["text"], events["source_s"], events["wall_s"], strict=True):
        if state.step(op, text):
            shown.append((state.committed if timing == "stable" else state.shown(), source, wall))
    goal, chars = units(state.committed, target), by_character(state.committed, target)
    delays: list[float] = []
    elapsed: list[float | None] = []
    for text, source, wall in shown:
        if len(delays) == len(goal):
            break
        at = round((0.0 if source is None or source != source else source) * 1000, 3)
        for _ in range(shared(units(text, target), goal) - len(delays)):
            delays.append(at)
            elapsed.append(None if wall is None or wall != wall else max(at, round(wall * 1000, 3)))
    whole = elapsed if elapsed and None not in elapsed else None
    return ("" if chars else " ").join(goal), "char" if chars else "word", delays, whole


class _Closing(StatefulProcessor):
    """Keeps a recording's events until nothing has come for a gap of event time, then puts out its delays and forgets it."""

    def __init__(self, key: str, gap_ms: int, timing: str) -> None:
        self.key, self.gap_ms, self.timing = key, gap_ms, timing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        latest = before
        for pdf in rows:
            names = [f.split()[0] for f in EVENT.split(", ")]
            self.events.appendList([tuple(None if pd.isna(v) else v for v in r) for r in pdf[names].itertuples(index=False)])
            ms = int(pdf["ts"].max().timestamp() * 1000)
            latest = ms if latest is None else max(latest, ms)
        if latest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap_ms)
            self.handle.registerTimer(latest + self.gap_ms)
            self.last.update((latest,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in EVENT.split(", ")]
        events = pd.DataFrame([tuple(r) for r in self.events.get()], columns=names)
        self.events.clear()
        self.last.clear()
        found = delays_of(events, self.timing)
        yield pd.DataFrame({self.key: [key[0]], **{n: [v] for n, v in zip(("prediction", "unit", "delays", "elapsed"), found, strict=True)}})

    def close(self) -> None:
        pass


def unit_delays_stream(events: DataFrame, key: str, gap_s: float = 60.0, late: str = "30 seconds", timing: str = "stable") -> DataFrame:
    """``key`` and the delays of each recording, once it has been silent for ``gap_s`` of event time.

    ``events`` has ``key``, the fields of EVENT and the event time ``ts``.  Events
    may come in any order within the watermark; the sequence numbers order them.
    Events that come after their recording has closed begin a new one.
    """
    kind = dict(events.dtypes)[key]
    names = [f.split()[0] for f in EVENT.split(", ")]
    timed = events.select(key, *names, "ts").withWatermark("ts", late)
    return timed.groupBy(key).transformWithStateInPandas(_Closing(key, int(gap_s * 1000), timing), f"{key} {kind}, {DELAYS}", "Append", "EventTime")


def write_batches(stream: DataFrame, path: str, checkpoint: str, prepare=None) -> StreamingQuery:
    """Runs a stream through what there is; each micro-batch is a folder of its own, which a repeated batch overwrites."""

    def put(df: DataFrame, batch: int) -> None:
        (prepare(df, batch) if prepare else df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def resumed(log: DataFrame, key: str = "id", late: str = "1 hour") -> DataFrame:
    """The first successful record of each id of a log stream with the event time ``ts``.

    Ids are remembered for as long as the watermark lets a repetition come, and
    the memory of them is the query's checkpoint: a run that is stopped and started
    again goes on where it was, and its ids do not come twice.
    """
    return log.where(F.coalesce(F.col("ok"), F.lit(False))).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, gap: str = "10 minutes", late: str | None = None) -> DataFrame:
    """``key``, start, end, n and total of runs of events no more than ``gap`` apart; ``late`` sets a stream's watermark."""
    timed = events.withWatermark("ts", late) if late else events
    g = timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def lateness(events: DataFrame, batch: str, delay: str) -> DataFrame:
    """``events`` with ``late``: older by more than ``delay`` than the newest event of the batches before.

    That is the rule by which a watermark drops rows, told from the greatest time
    of each batch: the window runs over one row a batch, not over events.
    """
    newest = events.groupBy(batch).agg(F.max("ts").alias("t"))
    before = newest.select(batch, F.max("t").over(Window.partitionBy(F.lit(0)).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    behind = F.col("ts") < F.col("before") - F.expr(f"INTERVAL '{delay}'")
    return events.join(before, batch).withColumn("late", F.coalesce(behind, F.lit(False))).drop("before")


def keep_late(stream: DataFrame, folder: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    """Parts a stream into ``folder``/on_time and ``folder``/late, so that rows that a watermark would drop are kept.

    Each batch writes its newest time to ``folder``/newest beside its rows; a batch
    reads the times of those before it, so one that is run again decides alike.
    """
    spark: SparkSession = stream.sparkSession

    def put(df: DataFrame, batch: int) -> None:
        earlier = [f"{folder}/newest/batch={k}" for k in range(batch)]
        before = spark.read.schema("t timestamp").parquet(*earlier).agg(F.max("t")).first()[0] if earlier else None
        behind = F.col("ts") < F.lit(before).cast("timestamp") - F.expr(f"INTERVAL '{delay}'")
        parted = df.withColumn("late", F.coalesce(behind, F.lit(False)))
        for name, keep in (("late", F.col("late")), ("on_time", ~F.col("late"))):
            parted.where(keep).drop("late").write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        df.agg(F.max("ts").alias("t")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/newest/batch={batch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
