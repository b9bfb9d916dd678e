"""Quality rules: hashed n-gram log-likelihood ratio of two multinomials.

Words and word pairs are hashed into ``BUCKETS`` buckets.  One multinomial is
fitted to trusted documents, one to the raw corpus; a document's score is the
mean over its n-grams of log(p_trusted / p_raw).  A trusted document is scored
with its own counts taken out of the trusted multinomial, as all others have none
in it; so its score is what it would be without its label.  The threshold is the
one that best tells the labelled documents apart by these scores (balanced
accuracy over a histogram), and every document is compared with it: no sampling,
no randomness.

All labelled documents take part: labels are joined to the documents, and of
these only counts by bucket and a histogram of scores are gathered, which have
fixed sizes.

Base rules (word counts, symbols, repeated lines, repeated three-word windows)
are counted in the same pass as the score.

Defined cases: a null text is an empty one and fails the base rules; a document
without n-grams scores 0; a null doc_id is never labelled; without labelled
documents of both kinds the threshold is -inf, so the base rules alone decide; repeated rows
are judged alike (each row takes out its own counts once); very long texts are measured whole, in slices of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.llm import textops as T

BITS = 16
BUCKETS = 1 << BITS
SMOOTH = 1.0
#: Score histogram for the threshold: from LOW to HIGH in BINS steps.
LOW, HIGH, BINS = -8.0, 4.0, 1200

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CHAR = np.ones(256, bool)  # bytes that begin a code point
_CHAR[0x80:0xC0] = False


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each row."""
    done = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=done[1:])
    return done[off[1:]] - done[off[:-1]]


def ngrams(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word and of each pair of neighbours in a row."""
    shift = np.uint64(64 - BITS)
    one = (h >> shift).astype(np.int64)
    same = np.flatnonzero(rows[1:] == rows[:-1])
    two = (T.combine(h[same], h[same + 1]) >> shift).astype(np.int64)
    return np.concatenate([one, two]), np.concatenate([rows, rows[same]])


def _trusted(column: pa.Array) -> np.ndarray:
    """Which rows are trusted; those without a label are not."""
    return column.fill_null(False).to_numpy(zero_copy_only=False)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with ``trusted``: true, false for distrusted ones, null for those without a label or with a doubtful one."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    trusted = F.when(F.expr("q = 1 and coalesce(t, 0) = 0"), True).when(F.col("q") == 0, False)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # an id and a flag of each label are broadcast; a shuffle would move every text three times
    return texts.join(F.broadcast(lab.select("doc_id", trusted.alias("trusted")).where("trusted is not null")), "doc_id", "left")


def count_ngrams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in the raw corpus and in the trusted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = _trusted(batch.column(2))
            for i, j, buf, off in T.slices(batch.column(1)):
                h, rows, _, _ = T.words(buf, off, T.SPACED, False)
                g, at = ngrams(h, rows)
                raw += np.bincount(g, minlength=BUCKETS)
                own += np.bincount(g[good[i:j][at]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(own[some])], ["bucket", "raw", "own"])

    rows = docs.mapInArrow(run, "bucket long, raw long, own long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toPandas()
    raw, own = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], own[rows["bucket"]] = rows["raw"], rows["own"]
    return raw, own


class Model(NamedTuple):
    """Counts of the trusted documents, and what they back off to."""

    own: np.ndarray  # counts of each bucket in the trusted documents
    p_raw: np.ndarray
    prior: float  # weight of p_raw in the trusted multinomial

    def ratio(self) -> np.ndarray:
        """log(p_trusted / p_raw) of each bucket."""
        return np.log((self.own + self.prior * self.p_raw) / (self.own.sum() + self.prior) / self.p_raw)

    def without(self, g: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log ratio of each n-gram (bucket, row) of trusted documents, with the counts of its own row taken out."""
        key, inverse, n = np.unique(at * BUCKETS + g, return_inverse=True, return_counts=True)
        bucket = key % BUCKETS
        rest = self.own.sum() - np.bincount(at)[key // BUCKETS]
        return np.log((self.own[bucket] - n + self.prior * self.p_raw[bucket]) / (rest + self.prior) / self.p_raw[bucket])[inverse]


def fit(docs: DataFrame, smooth: float = SMOOTH) -> Model:
    raw, own = count_ngrams(docs)
    # the trusted multinomial backs off to the raw one, so that a bucket neither has seen is neutral
    return Model(own, (raw + smooth) / (raw.sum() + smooth * BUCKETS), smooth * BUCKETS)


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """MEASURES of every document of ``marked``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.ratio()))

    def one(buf: np.ndarray, off: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        n = len(off) - 1
        h, rows, starts, _ = T.words(buf, off, T.SPACED, False)
        first = T.row_starts(rows, n)
        n_words = np.diff(first)
        spaced = T.SPACED[buf]
        g, at = ngrams(h, rows)
        model, ratio = shared.value
        weight, mine = ratio[g], own[at]
        if mine.any():
            weight[mine] = model.without(g[mine], at[mine])
        total = np.bincount(at, weights=weight, minlength=n)
        score = total / np.maximum(np.bincount(at, minlength=n), 1)
        salt = T.mix(np.arange(1, n + 1, dtype=np.uint64))
        # lines with a word that equal an earlier line
        ls, le = T.runs(buf != 0x0A, off)
        lh = T.hash_spans(buf, ls, le)
        words_before = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(spaced, out=words_before[1:])
        has = words_before[le] > words_before[ls]
        lrow = np.searchsorted(off, ls[has], "right") - 1
        key = lh[has] ^ salt[lrow]
        _, kept = np.unique(key, return_index=True)
        dup = np.bincount(lrow, minlength=n) - np.bincount(lrow[kept], minlength=n)
        # words in windows of three that the text has twice
        w, wat = T.windows(h, first, 3)
        _, inverse, counts = np.unique(w ^ salt[rows[wat]], return_inverse=True, return_counts=True)
        hit = wat[counts[inverse] > 1]
        again = np.zeros(len(h), bool)
        for k in range(3):
            again[hit + k] = True
        return [n_words, _sums(spaced & _CHAR[buf], off), _sums(_SYMBOL[buf], off), dup, np.bincount(rows[again], minlength=n), score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in MEASURES.split(", ")]
        for batch in batches:
            own = _trusted(batch.column(2))
            for i, j, buf, off in T.slices(batch.column(1)):
                cols = one(buf, off, own[i:j])
                arrays = [batch.column(0).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in cols[:-1]), pa.array(cols[-1])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, MEASURES)


def threshold(docs: DataFrame, model: Model) -> float:
    """The score below which labelled documents are mostly distrusted; -inf without labelled documents of both kinds."""
    scored = [measure(docs.where(kind), model).select("score", F.lit(q).alias("q")) for q, kind in enumerate(("not trusted", "trusted"))]
    step = (HIGH - LOW) / BINS
    bin_ = F.least(F.greatest(F.floor((F.col("score") - LOW) / step), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = scored[0].unionByName(scored[1]).groupBy(bin_.alias("bin"), "q").count().collect()
    n = np.zeros((2, BINS))
    for r in rows:
        n[r["q"], r["bin"]] += r["count"]
    if not n.sum(axis=1).all():
        return float("-inf")
    share = n / n.sum(axis=1, keepdims=True)
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(share, axis=1)], axis=1)
    gain = below[0] - below[1]  # distrusted documents dropped less trusted ones dropped
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return LOW + step * float(best[len(best) // 2])  # the middle of the widest choice


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """MEASURES, base_failed and kept of every document."""
    docs = marked(docs, labels)
    model = fit(docs)
    cut = threshold(docs, model)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, model).select("*", failed.alias("base_failed"), (~failed & (F.col("score") >= cut)).alias("kept"))
