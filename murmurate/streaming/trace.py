"""Replay of incremental-output traces: one state machine for batches of sorted rows and for streams.

A trace is the ordered events of one recording.  A batch job sorts each
partition by recording and sequence and walks it once; the state is the
committed text and the draft of one recording, so a trace of any length needs
no array of its events.  The streaming job keeps the same state by key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = ("append", "replace", "commit", "final")
# Target languages whose unit is a character.
CHARACTER_TARGETS = ("zh", "yue", "ja", "ko", "中文", "简体中文", "日文", "韩文")
_UNIT = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[^\w\s]")
_HAN = re.compile("[㐀-鿿]")


def joined(left: str, right: str) -> str:
    """Both texts without outer white space and one space between them."""
    return " ".join(x for x in (left.strip(), right.strip()) if x)


def shared(a, b) -> int:
    """Length of the common prefix of two sequences."""
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return k
    return min(len(a), len(b))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings: the place of the first pair of characters that differ."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.length(a)).cast("int")


def by_character(text: str, target: str | None) -> bool:
    return (target or "").lower() in CHARACTER_TARGETS or bool(_HAN.search(text))


def units(text: str, target: str | None) -> list[str]:
    """Units of evaluation: characters without white space, or words and punctuation marks."""
    return [c for c in text if not c.isspace()] if by_character(text, target) else _UNIT.findall(text)


class Replay:
    """What a screen shows after each event, and the figures of a trace."""

    def __init__(self):
        self.committed = self.draft = self.last = ""
        self.visible = self.stable = None
        self.seen = self.held = False
        self.updates = self.revisions = self.erased = 0

    def step(self, op: str | None, text: str | None, wall: float | None = None) -> bool:
        """Takes an event; False for an unknown operation, which changes nothing."""
        text = text or ""
        if op == "append":
            self.draft += text
            self.updates += 1
        elif op == "replace":
            same = shared(self.draft, text)
            self.updates += 1
            if same < len(self.draft):
                self.revisions += 1
                self.erased += len(self.draft) - same
            self.draft = text
        elif op == "commit":
            self.committed, self.draft = joined(self.committed, text), ""
        elif op == "final":
            self.committed, self.draft = text.strip(), ""
            self.last = self.committed
        else:
            return False
        if not self.seen and (self.committed or self.draft.strip()):
            self.seen, self.visible = True, wall
        if not self.held and self.committed:
            self.held, self.stable = True, wall
        return True

    def shown(self) -> str:
        return joined(self.committed, self.draft)

    def summary(self, final: str | None = None) -> dict:
        """Nulls where nothing can be observed: no update, or no final text."""
        final = self.last if final is None else final
        size = len(final.replace(" ", ""))
        number = lambda x: None if x is None or x != x else round(x, 3)
        return {
            "ttfb_visible": number(self.visible),
            "ttfb_stable": number(self.stable),
            "updates": self.updates,
            "revisions": self.revisions,
            "observable": self.updates > 0,
            "revision_rate": round(self.revisions / self.updates, 4) if self.updates else None,
            "revised_chars": self.erased,
            "churn_rate": round(self.erased / size, 4) if self.updates and size else None,
        }


SUMMARY = "ttfb_visible double, ttfb_stable double, updates long, revisions long, observable boolean, revision_rate double, revised_chars long, churn_rate double"


def _sorted(events: DataFrame, key: str) -> DataFrame:
    return events.repartition(key).sortWithinPartitions(key, "seq")


def _walk(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple]:
    """(key, rows) of the recordings' parts in order; a recording may come in several parts."""
    for pdf in batches:
        if len(pdf):
            change = (pdf[key] != pdf[key].shift()).cumsum()
            for _, part in pdf.groupby(change, sort=False):
                yield part[key].iloc[0], part


def summarize(events: DataFrame, key: str) -> DataFrame:
    """One row per trace; ``events`` has key, seq, op, text, wall_s.  The final text is that of the last final event."""
    kind = dict(events.dtypes)[key]
    names = [key, *(c.split()[0] for c in SUMMARY.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, replay, out = None, None, []
        for k, part in _walk(batches, key):
            if replay is None or k != now:
                if replay is not None:
                    out.append({key: now, **replay.summary()})
                now, replay = k, Replay()
            for op, text, wall in zip(part["op"], part["text"], part["wall_s"], strict=True):
                replay.step(op, text, wall)
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if replay is not None:
            out.append({key: now, **replay.summary()})
        if out:
            yield pd.DataFrame(out, columns=names)

    return _sorted(events.select(key, "seq", "op", "text", F.col("wall_s").cast("double").alias("wall_s")), key).mapInPandas(run, f"{key} {kind}, {SUMMARY}")


def replay(events: DataFrame, key: str) -> DataFrame:
    """Every known event with the text on the screen and the committed text after it."""
    kind = dict(events.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for k, part in _walk(batches, key):
            if state is None or k != now:
                now, state = k, Replay()
            out = [(k, seq, op, state.shown(), state.committed) for seq, op, text in zip(part["seq"], part["op"], part["text"], strict=True) if state.step(op, text)]
            yield pd.DataFrame(out, columns=[key, "seq", "op", "display_text", "committed_text"])

    return _sorted(events.select(key, F.col("seq").cast("long").alias("seq"), "op", "text"), key).mapInPandas(run, f"{key} {kind}, seq long, op string, display_text string, committed_text string")


def record(events: DataFrame, key: str) -> DataFrame:
    """Raw adapter events as a trace: empty appends and commits and replacements that change nothing are dropped, the rest is numbered from 0."""
    kind = dict(events.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, draft, n = None, "", 0
        for k, part in _walk(batches, key):
            if n == 0 or k != now:
                now, draft, n = k, "", 0
            out = []
            for op, text, source, wall in zip(part["op"], part["text"], part["source_s"], part["wall_s"], strict=True):
                text = text or ""
                if op in ("commit", "final"):
                    text = text.strip()
                if (op in ("append", "commit") and not text) or (op == "replace" and text == draft) or op not in OPS:
                    continue
                draft = draft + text if op == "append" else text if op == "replace" else ""
                out.append((k, n, op, text, round(0.0 if source is None or source != source else source, 3), None if wall is None or wall != wall else round(wall, 3)))
                n += 1
            yield pd.DataFrame(out, columns=[key, "seq", "op", "text", "source_s", "wall_s"])

    d = events.select(key, "seq", "op", "text", F.col("source_s").cast("double").alias("source_s"), F.col("wall_s").cast("double").alias("wall_s"))
    return _sorted(d, key).mapInPandas(run, f"{key} {kind}, seq long, op string, text string, source_s double, wall_s double")


def unit_delays(events: DataFrame, finals: DataFrame, key: str, timing: str = "stable") -> DataFrame:
    """Milliseconds of source audio, and of the wall clock, after which each unit of the final text stands.

    ``finals`` has key, final_text and target_lang.  ``stable`` asks for the
    committed text, ``visible`` for what the screen shows.  A trace whose end
    does not cover its final text fails the query; elapsed is null if any event
    that covers a unit has no wall clock, and never before the source's clock.
    """
    if timing not in ("stable", "visible"):
        raise ValueError("timing is stable or visible")
    kind = dict(events.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done() -> pd.DataFrame:
            if len(delays) < len(goal):
                raise ValueError(f"the trace of {now} does not cover its final text")
            text = ("" if chars else " ").join(goal)
            whole = elapsed if elapsed and None not in elapsed else None
            return pd.DataFrame({key: [now], "prediction": [text], "unit": ["char" if chars else "word"], "delays": [delays], "elapsed": [whole]})

        now, state, goal, chars = None, None, [], False
        delays: list = []
        elapsed: list = []
        for k, part in _walk(batches, key):
            if state is None or k != now:
                if state is not None:
                    yield done()
                final, target = (part["final_text"].iloc[0] or "").strip(), part["target_lang"].iloc[0]
                now, state, goal, chars, delays, elapsed = k, Replay(), units(final, target), by_character(final, target), [], []
            for op, text, source, wall in zip(part["op"], part["text"], part["source_s"], part["wall_s"], strict=True):
                if not state.step(op, text) or len(delays) == len(goal):
                    continue
                covered = shared(units(state.committed if timing == "stable" else state.shown(), target), goal)
                at = round((source if source == source else 0.0) * 1000, 3)
                for _ in range(covered - len(delays)):
                    delays.append(at)
                    elapsed.append(None if wall is None or wall != wall else max(at, round(wall * 1000, 3)))
        if state is not None:
            yield done()

    d = events.select(key, "seq", "op", "text", F.coalesce(F.col("source_s").cast("double"), F.lit(0.0)).alias("source_s"), F.col("wall_s").cast("double").alias("wall_s")).join(finals.select(key, "final_text", "target_lang"), key)
    return _sorted(d, key).mapInPandas(run, f"{key} {kind}, prediction string, unit string, delays array<double>, elapsed array<double>")


def legacy_events(segments: DataFrame, key: str) -> DataFrame:
    """Old results know only when segments were settled: a commit each, without a wall clock; segments without text or time are left out."""
    at = F.coalesce("emitted_at_s", "end_s").cast("double")
    return segments.where((F.trim(F.coalesce("text", F.lit(""))) != "") & at.isNotNull()).select(key, F.col("segment_id").alias("seq"), F.lit("commit").alias("op"), F.trim("text").alias("text"), F.round(at, 3).alias("source_s"), F.lit(None).cast("double").alias("wall_s"))


def increments(events: DataFrame, key: str) -> DataFrame:
    """Of services that send the whole text each time: how often it changed, and how often other than by growing."""
    before = F.lag("text", 1, "").over(Window.partitionBy(key).orderBy("seq"))
    d = events.select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(before, F.lit("")).alias("before"))
    changed = F.col("text") != F.col("before")
    return d.groupBy(key).agg(F.count_if(changed).alias("updates"), F.count_if(changed & ~F.startswith("text", F.col("before"))).alias("revisions"))


def replay_stream(events: DataFrame, key: str) -> DataFrame:
    """Committed characters, updates, revisions and late events of each trace after each micro-batch; events older than the state are dropped and counted."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        replay, (seq, late) = Replay(), (-1, 0)
        if state.exists:
            replay.committed, replay.draft, seq, replay.updates, replay.revisions, replay.erased, late = state.get
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples():
                if r.seq <= seq:
                    late += 1
                    continue
                seq = r.seq
                replay.step(r.op, r.text)
        state.update((replay.committed, replay.draft, int(seq), replay.updates, replay.revisions, replay.erased, late))
        yield pd.DataFrame({key: [k[0]], "committed_chars": [len(replay.committed)], "updates": [replay.updates], "revisions": [replay.revisions], "late": [late]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, committed_chars long, updates long, revisions long, late long", "committed string, draft string, seq long, updates long, revisions long, erased long, late long", "update", "NoTimeout")


def windowed(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Beyond the traces: event-time tumbling windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
