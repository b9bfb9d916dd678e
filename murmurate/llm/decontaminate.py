"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the documents into shards of about ``SHARD_BYTES``, and
stores, for each shard and term, the term's positions as delta-coded bytes, and
a directory of the shard's documents.  It is a map; no posting is shuffled.
``search`` takes the postings of the terms that the queries use to one task per
shard, starts every window from its rarest term in the shard, and intersects
the offset-adjusted lists from the rarest to the most common.  A phrase has
every term in its place; for a proximity match each may stand up to ``slop``
words away from it, in the same document.

Shards have a bounded size (a single longer document is a shard of its own),
so no term or source can make a task large.  Queries are broadcast in blocks of
at most ``BLOCK_WORDS`` words; each block is matched with all shards.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII
characters, compared by 64-bit hashes.

Defined cases: a null text has no words; a null doc_id stays null; repeated
rows are judged alike; an item without words matches nothing; rows that share
an item_id are one item; an item with a null id marks words but is not listed;
empty tables give no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.llm import textops as T
from murmurate.llm.scratch import save

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 250_000
#: Words that a term may stand away from its place in a proximity match, and free places between documents.
SLOP, HOLE = 1, 4
#: Places looked at together in a shard.
CANDIDATES = 2_000_000

INDEX = "shard long, term long, n long, postings binary"
HITS = "shard long, row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, near array<struct<start:long,end:long>>, items array<long>"


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low bits first; and the number of bytes of each value."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << (7 * k))
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    begin = end - size
    for k in range(int(size.max()) if len(size) else 0):
        some = np.flatnonzero(size > k)
        out[begin[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[some] > k + 1).astype(np.uint8) << 7)
    return out, size


def unvarint(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    nth = np.arange(len(data)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * nth), begin)


class _Shard:
    """Words of some documents; a hole in the numbering parts neighbours."""

    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.ids: list = []
        self.counts: list[np.ndarray] = []
        self.bytes = self.next = 0

    def add(self, ids: list, buf: np.ndarray, off: np.ndarray) -> None:
        h, rows, _, _ = T.words(buf, off, T.ALNUM, True)
        self.hashes.append(h)
        self.places.append(np.arange(len(h)) + rows * HOLE + self.next)
        self.counts.append(np.diff(T.row_starts(rows, len(ids))))
        self.ids += ids
        self.bytes += len(buf)
        self.next += len(h) + len(ids) * HOLE

    def rows(self, shard: int) -> pa.RecordBatch:
        h, places = np.concatenate(self.hashes), np.concatenate(self.places)
        self.hashes, self.places = [], []
        order = np.argsort(h, kind="stable")
        h, places = h[order], places[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        delta = np.diff(places, prepend=0)
        delta[begin] = places[begin]
        data, size = varint(delta)
        ends = np.cumsum(size)
        cuts = np.concatenate([ends[begin] - size[begin], [len(data)]]).astype(np.int64)
        postings = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).cast(pa.binary())
        counts = np.concatenate(self.counts).astype(np.int64)
        known = np.array([x is not None for x in self.ids], np.int64)
        ids = np.array([x or 0 for x in self.ids], np.int64)
        directory = np.concatenate([ids, known, counts]).tobytes()
        n = np.concatenate([[len(ids)], np.diff(np.append(begin, len(h)))]).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(begin) + 1, shard, np.int64)),
                pa.concat_arrays([pa.array([None], pa.int64()), pa.array(h[begin].view(np.int64))]),
                pa.array(n),
                pa.concat_arrays([pa.array([directory], pa.binary()), postings]),
            ],
            ["shard", "term", "n", "postings"],
        )


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """INDEX rows: postings of every term of every shard, and the shard's directory where term is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        part, nth, shard = TaskContext.get().partitionId() << 32, 0, _Shard()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, buf, off in T.slices(batch.column(1)):
                shard.add(ids[i:j], buf, off)
                if shard.bytes >= shard_bytes:
                    yield shard.rows(part + nth)
                    nth, shard = nth + 1, _Shard()
        if shard.ids:
            yield shard.rows(part + nth)

    T.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


class Queries:
    """Windows of items: term numbers in ``vocabulary``, grouped by length."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int):
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        found: dict[bytes, tuple[np.ndarray, set]] = {}
        for item, h in items:
            t = np.searchsorted(self.vocabulary, h).astype(np.int32)
            size = min(window, len(t))
            for k in range(len(t) - size + 1 if size else 0):
                found.setdefault(t[k : k + size].tobytes(), (t[k : k + size], set()))[1].add(item)
        self.groups = []
        for size in sorted({len(t) for t, _ in found.values()}):
            own = [(t, s) for t, s in found.values() if len(t) == size]
            self.groups.append((np.stack([t for t, _ in own]), [sorted(x for x in s if x is not None) for _, s in own]))


def item_words(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "replace")
    return T.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), T.ALNUM, True)[0]


def query_blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Queries]:
    """The items in blocks; one block at a time is on the driver."""
    block: list[tuple[int | None, np.ndarray]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        h = item_words(row["text"])
        if len(h):
            block.append((row["item_id"], h))
            size += len(h)
        if size >= block_words:
            yield Queries(block, window)
            block, size = [], 0
    yield Queries(block, window)


def _intersect(q: Queries, counts: np.ndarray, keys: np.ndarray, span: int, slop: int) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """(window numbers, group, length, first place) of matches; keys: term number times span plus place, sorted."""
    at = np.concatenate([[0], np.cumsum(counts)])
    for g, (terms, _) in enumerate(q.groups):
        n = counts[terms]
        alive = np.flatnonzero(n.min(axis=1) > 0)
        if not len(alive):
            continue
        size = terms.shape[1]
        order = np.argsort(n[alive], axis=1, kind="stable")
        rare = terms[alive, order[:, 0]]
        load = np.cumsum(counts[rare])
        lo = 0
        while lo < len(alive):
            hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + CANDIDATES, "right")))
            own = np.arange(lo, hi)
            reps = counts[rare[own]]
            win = np.repeat(own, reps)
            nth = np.arange(len(win)) - np.repeat(np.cumsum(reps) - reps, reps)
            first = keys[at[rare[win]] + nth] - rare[win].astype(np.int64) * span - order[win, 0]
            if slop:
                first = np.concatenate([first + d for d in range(-slop, slop + 1)])
                win = np.tile(win, 2 * slop + 1)
                win, first = win[first >= 0], first[first >= 0]
            for k in range(1, size):
                col = order[win, k]
                want = terms[alive[win], col].astype(np.int64) * span + first + col
                pos = np.searchsorted(keys, want)
                near = np.full(len(want), slop + 1, np.int64)
                for p in (pos, pos - 1) if slop else (pos,):
                    inside = (p >= 0) & (p < len(keys))
                    near[inside] = np.minimum(near[inside], np.abs(keys[p[inside]] - want[inside]))
                ok = near <= slop
                win, first = win[ok], first[ok]
                if not len(win):
                    break
            if len(win):
                yield alive[win], g, size, first
            lo = hi


def _search_shard(q: Queries, table: pa.Table, slop: int) -> pa.Table:
    term = table.column("term")
    blobs = table.column("postings")
    is_dir = term.is_null().to_numpy(zero_copy_only=False)
    raw = np.frombuffer(blobs[int(np.flatnonzero(is_dir)[0])].as_py(), np.int64)
    docs = len(raw) // 3
    ids, known, n_words = raw[:docs], raw[docs : 2 * docs], raw[2 * docs :]
    start = np.cumsum(n_words + HOLE) - (n_words + HOLE)  # place of each document's first word
    span = int(start[-1] + n_words[-1] + HOLE)
    own = np.flatnonzero(~is_dir)
    number = np.searchsorted(q.vocabulary, term.fill_null(0).to_numpy().view(np.uint64)[own])
    own, number = own[np.argsort(number)], np.sort(number)
    size = table.column("n").to_numpy()[own]
    counts = np.zeros(len(q.vocabulary), np.int64)
    counts[number] = size
    items: list[list[int]] = [[] for _ in range(docs)]
    spans: list[list[dict]] = [[] for _ in range(docs)]
    near: list[list[dict]] = [[] for _ in range(docs)]
    if len(own):
        delta = unvarint(np.frombuffer(b"".join(blobs[int(k)].as_py() for k in own), np.uint8))
        total = np.cumsum(delta)
        begin = np.cumsum(size) - size
        places = total - np.repeat(total[begin] - delta[begin], size)
        keys = np.repeat(number.astype(np.int64) * span, size) + places
        for width, out in ((0, spans), (slop, near)):
            if width == 0 and out is near:
                break
            mark = np.zeros(span + WINDOW + 1, np.int64)
            for win, g, length, first in _intersect(q, counts, keys, span, width):
                doc = np.searchsorted(start, first, "right") - 1
                ok = (doc >= 0) & (first >= start[doc]) & (first + length <= start[doc] + n_words[doc])
                win, first, doc = win[ok], first[ok], doc[ok]
                np.add.at(mark, first, 1)
                np.add.at(mark, first + length, -1)
                if out is spans:
                    for d, w in set(zip(doc.tolist(), win.tolist(), strict=True)):
                        items[d] += q.groups[g][1][w]
            lo, hi = T.runs(np.cumsum(mark)[:span] > 0, np.array([0, span]))
            doc = np.searchsorted(start, lo, "right") - 1
            for d, a, b in zip(doc.tolist(), (lo - start[doc]).tolist(), (hi - start[doc]).tolist(), strict=True):
                out[d].append({"start": a, "end": b})
    shard = table.column("shard")[0].as_py()
    return pa.table(
        {
            "shard": pa.array([shard] * docs, pa.int64()),
            "row": pa.array(range(docs), pa.int64()),
            "doc_id": pa.array(ids, mask=known == 0),
            "n_words": pa.array(n_words),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "near": pa.array(near, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64())),
        }
    )


def _searcher(shared, slop: int):
    def run(shard: pa.Table) -> pa.Table:
        T.vacate()
        return _search_shard(shared.value, shard, slop)

    return run


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """HITS: every document with the word spans that windows of the items cover, those of proximity matches where ``slop`` asks for them, and the items of phrases.

    ``index`` must be a written table (shards are named by the task that built them).
    """
    if not 0 <= slop < HOLE:
        raise ValueError(f"slop is 0 to {HOLE - 1}")
    spark = index.sparkSession
    found: list[DataFrame] = []
    for q in query_blocks(benchmark, window, block_words):
        shared = spark.sparkContext.broadcast(q)
        # at most block_words terms
        terms = spark.createDataFrame([(int(x),) for x in q.vocabulary.view(np.int64)], "term long")
        used = index.where("term is null").unionByName(index.where("term is not null").join(F.broadcast(terms), "term", "left_semi").select("shard", "term", "n", "postings"))
        found.append(used.groupBy("shard").applyInArrow(_searcher(shared, slop), HITS))
    if len(found) == 1:
        return found[0]
    whole = found[0]
    for df in found[1:]:
        whole = whole.unionByName(df)
    merged = whole.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("spans", _union("spans")).withColumn("near", _union("near"))


def _union(spans: str) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(
        spans,
        empty,
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(F.array_append(acc, s)),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """The contract's columns, and ``n_near``: words in windows whose terms stand in their places or up to ``slop`` words away."""
    index = save(build_index(docs), "postings")
    hits = search(index, benchmark, window, slop)
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    words = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return hits.select("doc_id", "n_words", words("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (words("spans") > 0).alias("contaminated"), words("near").alias("n_near"))
