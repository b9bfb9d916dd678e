"""Importance resampling towards a target distribution, by hashed n-gram counts.

1. A map turns every text into its features, the runs of one and two words, and
   writes their buckets as packed 16-bit numbers: a binary column, whose Arrow
   form is one stream with the documents' offsets.
2. The counting pass sorts the streams of a task and run-length encodes them;
   runs of a task are merged, so a task puts out a row a bucket at most, and the
   rows are summed by bucket.
3. A bucket's gain is the log ratio of its smoothed share of the target to that
   of the corpus.  The gains, one for each bucket, go to all tasks, which gather
   them along the streams and sum them by document (``np.add.reduceat``).
4. Gumbel noise from a hash of the doc_id makes the highest scores a draw without
   replacement.  Ranks come from a range sort: the place in a sorted partition,
   plus the rows of the partitions before it.

Defined cases: a null text, or one without words, has no features and the weight
zero; very long texts count whole; a null doc_id is hashed as the empty string
and comes after others of its score; repeated rows are rows of their own, with
ranks of their own; nothing is drawn from an empty table, or if fewer than one
row would be; an empty target has smoothed counts only; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.llm import textops as T
from murmurate.llm.scratch import save

BUCKETS = 10_000
#: Words of a document that can be drawn, the share that is drawn in per cent, and the seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Buckets that are sorted at once.
SORTED = 1 << 22


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a slice's features, by document, and where each document's begin."""
    low = T.LOWER[buf]
    mask = T.ALNUM[low]
    starts, ends = T.runs(mask, off)
    first = T.row_starts(np.searchsorted(off, starts, "right") - 1, len(off) - 1)
    if not len(starts):
        return np.zeros(0, np.uint16), np.zeros(len(off), np.int64)
    size = ends - starts
    begin = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1] + 1, out=begin[1:])
    spaced = np.full(int(begin[-1] + size[-1] + 1), 0x20, np.uint8)
    spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[mask]
    end = begin + size
    words = np.diff(first)
    last = np.zeros(len(size), bool)
    last[first[1:][words > 0] - 1] = True
    pair = np.flatnonzero(~last)
    text = spaced.tobytes()
    a = np.concatenate([begin, begin[pair]])
    b = np.concatenate([end, end[pair + 1]])
    order = np.argsort(np.concatenate([np.arange(len(size)), pair]), kind="stable")
    found = np.fromiter((crc32(text[s:e]) % BUCKETS for s, e in zip(a[order].tolist(), b[order].tolist(), strict=True)), np.uint16, len(a))
    return found, np.concatenate([[0], np.cumsum(2 * words - (words > 0))])


def streams(items: DataFrame, name: str) -> DataFrame:
    """name, n_words and the packed buckets of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        for batch in batches:
            for i, j, buf, off in T.slices(batch.column(1)):
                found, first = features(buf, off)
                n = np.diff(first)
                packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((first * 2).astype(np.int64)), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array((n + 1) // 2), packed.cast(pa.binary())], [name, "n_words", "stream"])

    T.small_batches(items.sparkSession)
    kind = dict(items.dtypes)[name]
    return items.select(name, F.col("text").cast("string")).mapInArrow(run, f"{name} {kind}, n_words long, stream binary")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a column of streams and their offsets, without a copy of each."""
    buf, off = T.buffers(column.cast(pa.large_binary()))
    return buf[off[0] : off[-1]].view(np.uint16), (off - off[0]) // 2


def counts(packed: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: ``BUCKETS`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found, _ = unpacked(batch.column(0))
            for a in range(0, len(found), SORTED):
                part = np.sort(found[a : a + SORTED])
                begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                total[part[begin]] += np.diff(np.append(begin, len(part)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    found = packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in found.collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """The gain of each bucket, in thousandths of a natural logarithm."""
    s, t = sum(corpus.values()), sum(target.values())
    gain = lambda k: math.floor(1000 * math.log((target.get(k, 0) + 1) * (s + BUCKETS) / ((corpus.get(k, 0) + 1) * (t + BUCKETS))))
    return np.array([gain(k) for k in range(BUCKETS)], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise of a document, in thousandths."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and score; ``nth`` is the row's place in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        at = 0
        for batch in batches:
            found, off = unpacked(batch.column(2))
            n = np.diff(off)
            weight = np.zeros(len(n), np.int64)
            some = np.flatnonzero(n)
            if len(some):
                weight[some] = np.add.reduceat(gain[found], off[some]) // n[some]
            score = weight + np.fromiter(map(noise, batch.column(0).to_pylist()), np.int64, len(n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n), pa.array(weight), pa.array(score), pa.array(np.arange(at, at + len(n)))], ["doc_id", "n_words", "n_features", "weight", "score", "nth"])
            at += len(n)

    return packed.select("doc_id", "n_words", "stream").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long, nth long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` with the rank by falling score of the first ``drawn`` rows, null behind them."""
    order = scored.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "nth")
    placed = save(order.select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("place")), "sorted")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, sums = 0, {}
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"]):
        sums[r["part"]] = before
        before += r["n"]
    start = placed.sparkSession.createDataFrame(list(sums.items()), "part long, before long")
    rank = F.col("before") + F.col("within") + 1
    found = placed.withColumn("part", part).withColumn("within", within).join(F.broadcast(start), "part")
    return found.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; ``rank`` is null if it isn't drawn."""
    packed = save(streams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "streams")
    gain = gains(counts(packed), counts(streams(target.select(F.lit(0).alias("item"), "text"), "item")))
    scored = save(scores(packed, gain), "scores")
    able = F.col("n_words") >= LEAST_WORDS
    drawn = percent * scored.where(able).count() // 100
    rest = scored.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(able), drawn).unionByName(rest)
