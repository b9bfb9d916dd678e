"""Language identification by cross-parsing.

A suffix automaton of labelled text of each language is walked along a text:
each phrase is the longest match from where the last one ended, and the
language that needs the fewest phrases for the text's length wins (the
cross-parsing estimate of relative entropy, Ziv and Merhav 1993).

Texts are lower-cased and reduced to letters and single spaces, as UTF-8 bytes.
A whole batch is parsed at once: each text is cut into blocks of ``BLOCK``
bytes, which step through a dense transition table together, and a block's parse
is then mended from where the one before it ended, so phrases run across blocks
and the counts are those of one parse from the text's start to its end.

The labelled text is a bounded sample, fixed by ``DOCS`` and ``SAMPLE_BYTES``
per language: the documents with the smallest hash of their id.  Only this
sample is broadcast; each Python worker builds the automata once.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
equal phrase counts go to the label that sorts first; a null doc_id takes part
in prediction, not in learning; without labelled text every document is
``und``; repeated rows get the same answer; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.llm import textops as T

UNKNOWN = "und"
DOCS = 60
SAMPLE_BYTES = 48_000
BLOCK = 2048
#: Rows parsed together.
ROWS = 1000
#: Lanes that step together.
LANES = 8192
#: Blocks from which on they are mended one by one.
FEW = 48
_NOT_LETTER = re.compile(r"[\W\d_]+")


def reduce_text(text: str | None) -> bytes:
    """Lower-case letters, with one space for all between them."""
    return _NOT_LETTER.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


class Automaton:
    """Suffix automaton (Blumer et al. 1985) as a dense table for greedy parsing.

    An entry is the next state's row times two, plus one if the step begins a
    new phrase.  A byte that cannot continue the phrase starts the next one.
    """

    def __init__(self, text: bytes, classes: np.ndarray, width: int):
        steps: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in classes[np.frombuffer(text, np.uint8)].tolist():
            new = len(steps)
            steps.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    copy = len(steps)
                    steps.append(dict(steps[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        n = len(steps)
        root = np.zeros(width, np.int32)
        for c, t in steps[0].items():
            root[c] = t
        table = np.tile((root * width * 2 + 1).astype(np.int32), (n, 1))
        counts = np.fromiter((len(s) for s in steps), np.int64, n)
        rows = np.repeat(np.arange(n), counts)
        cols = np.fromiter((c for s in steps for c in s), np.int64, len(rows))
        to = np.fromiter((t for s in steps for t in s.values()), np.int64, len(rows))
        inner = rows > 0  # from the root every step begins a phrase
        table[rows[inner], cols[inner]] = (to[inner] * width * 2).astype(np.int32)
        self.table = table.ravel()


class Parser:
    """Counts of phrases of texts in each language."""

    def __init__(self, samples: dict[str, bytes]):
        self.labels = sorted(samples)
        seen = np.unique(np.frombuffer(b"".join(samples.values()), np.uint8))
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.automata = [Automaton(samples[k], self.classes, self.width) for k in self.labels]

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        off = np.concatenate([[0], np.cumsum(size)])
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = off[owner] + nth * BLOCK
        length = np.minimum(BLOCK, off[owner + 1] - begin)
        buf = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        out = np.zeros((len(texts), len(self.labels)), np.int64)
        for m, auto in enumerate(self.automata):
            out[:, m] = np.bincount(owner, weights=_phrases(auto.table, buf, begin, length, nth > 0), minlength=len(texts))
        return out


def _phrases(table: np.ndarray, buf: np.ndarray, begin: np.ndarray, length: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that begin in each block; a phrase goes on from a block into the one that follows it.

    All blocks are first parsed from the root.  Then each block that follows
    another is parsed again from where that one ended, until a phrase begins
    where the first parse began one too: from there both are the same.  Blocks
    that never fall into step hand a new end to the next one, in rounds.
    """
    starts = np.zeros(len(buf), bool)
    count = np.zeros(len(begin), np.int64)
    ends = np.zeros(len(begin), np.int32)
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), LANES):
        lanes = order[a : a + LANES]
        lb, ll = begin[lanes], length[lanes]
        active = np.searchsorted(-ll, -np.arange(ll[0]), "left")  # lanes longer than each step
        state = np.zeros(len(lanes), np.int32)
        for step in range(int(ll[0])):
            k = active[step]
            at = lb[:k] + step
            to = table[state[:k] + buf[at]]
            starts[at] = to & 1
            state[:k] = to >> 1
        ends[lanes] = state
    if len(begin):
        count += np.add.reduceat(starts.astype(np.int64), begin)
    open_ = np.flatnonzero(follows)
    while len(open_):
        lanes, state = open_, ends[open_ - 1]
        changed = []
        step = 0
        while len(lanes) > FEW:
            over = length[lanes] <= step
            if over.any():
                differs = over.copy()
                differs[over] = ends[lanes[over]] != state[over]
                ends[lanes[differs]] = state[differs]
                changed.append(lanes[differs])
                lanes, state = lanes[~over], state[~over]
            at = begin[lanes] + step
            to = table[state + buf[at]]
            new, old = (to & 1).astype(bool), starts[at]
            count[lanes] += new.astype(np.int64) - old
            starts[at] = new
            on = ~(new & old)
            lanes, state = lanes[on], to[on] >> 1
            step += 1
        late = [lane for lane, now in zip(lanes.tolist(), state.tolist(), strict=True) if _one(table, buf, starts, count, ends, int(begin[lane]), int(length[lane]), step, lane, now)]
        changed.append(np.array(late, np.int64))
        after = np.unique(np.concatenate(changed)) + 1
        after = after[after < len(begin)]
        open_ = after[follows[after]]
    return count


def _one(table: np.ndarray, buf: np.ndarray, starts: np.ndarray, count: np.ndarray, ends: np.ndarray, begin: int, length: int, step: int, lane: int, state: int) -> bool:
    """The rest of one block, byte by byte; True if its end changes."""
    steps, text, old = memoryview(table), memoryview(buf[begin + step : begin + length]), memoryview(starts.view(np.uint8)[begin + step : begin + length])
    more = 0
    for k, c in enumerate(text):
        to = steps[state + c]
        new, state = to & 1, to >> 1
        if new:
            if old[k]:
                count[lane] += more
                return False
            more += 1
            old[k] = 1
        elif old[k]:
            more -= 1
            old[k] = 0
    count[lane] += more
    if ends[lane] == state:
        return False
    ends[lane] = state
    return True


def parser(samples: dict[str, bytes]) -> Parser:
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    return T.resident(("parser", key), lambda: Parser(samples))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, docs_per_label: int = DOCS, limit: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Labelled sample text of each language, at most ``limit`` bytes of at most ``docs_per_label`` documents."""
    own = docs.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    by = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id")
    chosen = own.select("lang", "doc_id").withColumn("k", F.row_number().over(by)).where(F.col("k") <= docs_per_label).select("doc_id").distinct()
    # docs_per_label ids of each label; the text of a long document is needed only up to the limit
    rows = own.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "doc_id", F.substring("text", 1, limit).alias("text")).collect()
    rows.sort(key=lambda r: (r["lang"], hashlib.md5(str(r["doc_id"]).encode()).digest(), r["text"] or ""))
    out: dict[str, bytes] = {}
    for r in rows:
        have = out.get(r["lang"], b"")
        if len(have) < limit:
            out[r["lang"]] = (have + reduce_text(r["text"]) + b" ")[:limit]
    return {k: v for k, v in out.items() if v.strip()}


def predict(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score and phrases per byte in the winning language; other columns of ``docs`` stay."""
    T.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, score double, phrase_rate double"])
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = [reduce_text(t) for t in batch.column(text_at).to_pylist()]
            n = len(texts)
            label, score, rate = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan)
            some = np.fromiter((len(t) > 0 for t in texts), bool, n)
            if shared.value and some.any():
                p = parser(shared.value)
                counts = p.count(texts)
                best = counts.argmin(axis=1)
                least = counts.min(axis=1)
                rest = np.partition(counts, 1, axis=1)[:, 1] if counts.shape[1] > 1 else np.maximum(least, 1)
                size = np.fromiter((len(t) for t in texts), np.int64, n)
                label[some] = np.array(p.labels, object)[best[some]]
                # confidence: how many of the runner-up's phrases are saved, a lone language counts in full
                score[some] = np.clip(1 - least[some] / np.maximum(rest[some], 1), 0, 1) if counts.shape[1] > 1 else 1.0
                rate[some] = least[some] / size[some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)], [*batch.schema.names, "lang_pred", "score", "phrase_rate"])
            T.release()

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = predict(d.select("doc_id", "text"), learn(d))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
