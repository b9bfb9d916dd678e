"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised, q = 1 + floor(log_BASE(count)),
and the filter holds (n-gram, 1) to (n-gram, q).  A worker finds q by probing
level after level until one is missing (Talbot and Osborne 2007).  A token's
probability interpolates the pair's relative frequency with an add-one word
probability, both from quantised counts:

    p(w|h) = LAMBDA * f(hw) / F(h) + (1 - LAMBDA) * (f(w) + 1) / (N + V + 1)

where f is the smallest count of a level and F the largest, so that over the
vocabulary and the unseen word the probabilities add up to at most one, but for
the filter's false positives (a pair that was never seen passes at 2.4 %).

Counting is a map with local sums, then one task per block of hashes merges its
counts and fills its part of the filter, sized by what it holds, so the filter
grows with the corpus.  Blocks are hashes of n-grams, so no frequent word loads
one task.  The blocks are written to the shared folder and broadcast in slices
of at most ``SLICE_BYTES``; a pass scores the tokens whose pair falls in its
slice, and sums over passes (by a hash of the text, the same in every job) are
exact, so memory is bounded at any size (small
models need one pass).  The same blocks carry the exact word counts for the
base score.

Tokens: A-Z lower-cased, words between ASCII white space, then one end token
per text; n-grams are 64-bit hashes.

Defined cases: a null text is an empty one, one end token; a null doc_id is
trained on; repeated rows count each; an empty corpus gives an empty result;
without training tokens every token is unknown; very long texts are scored
whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurate.llm import textops as T
from murmurate.llm.scratch import save

BASE = 1.5
LAMBDA = 0.25
BITS_PER_ENTRY = 8
PROBES = 4
SLICE_BYTES = 192 << 20
#: Tokens summed up in a task before their counts go out.
CHUNK_TOKENS = 2_000_000
END = np.uint64(0x1F83D9ABFB41BD6B)
BEGIN = np.uint64(0x5BE0CD19137E2179)
_WORD = np.uint64(0x3C6EF372FE94F82B)

COUNTS = "block int, kind int, keys binary, counts binary"
MODEL = "block int, kind int, n long, total long, bits long, filter binary, keys binary, counts binary"
SCORES = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, of the pair with the token before it, and its row."""
    n = len(off) - 1
    h, rows, _, _ = T.words(buf, off, T.SPACED, True)
    all_ = np.full(len(h) + n, END)
    all_[np.arange(len(h)) + rows] = h
    owner = np.empty(len(all_), np.int64)
    owner[np.arange(len(h)) + rows] = rows
    ends = T.row_starts(rows, n)[1:] + np.arange(n)
    owner[ends] = np.arange(n)
    before = np.empty(len(all_), np.uint64)
    before[1:] = all_[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = BEGIN
    return all_, T.combine(before, all_), owner


def word_key(h: np.ndarray) -> np.ndarray:
    return T.mix(h ^ _WORD)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def least(q: np.ndarray) -> np.ndarray:
    """Smallest count of a level; level 0 is unseen."""
    return np.where(q > 0, np.ceil(BASE ** (q - 1.0) - 1e-9), 0.0)


def most(q: np.ndarray) -> np.ndarray:
    """Largest count of a level."""
    return np.where(q > 0, np.maximum(np.ceil(BASE ** (q * 1.0) - 1e-9) - 1, least(q)), 0.0)


def _places(keys: np.ndarray, levels: np.ndarray | int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    step = np.asarray(levels).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    a = T.mix(keys + step)
    b = T.mix(a ^ np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
    size = np.asarray(bits).astype(np.uint64)
    for _ in range(PROBES):
        yield (((a >> np.uint64(32)) * size) >> np.uint64(32)).astype(np.int64)
        a = a + b


def fill(keys: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> tuple[int, np.ndarray]:
    """Bits and bytes of a filter with these n-grams."""
    q = level(counts)
    entries = int(q.sum())
    bits = max(64, -(-entries * bits_per_entry // 8) * 8)
    flags = np.zeros(bits, bool)
    each = np.repeat(keys, q)
    lev = np.arange(entries) - np.repeat(np.cumsum(q) - q, q) + 1
    for p in _places(each, lev, bits):
        flags[p] = True
    return bits, np.packbits(flags, bitorder="little")


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _small(counts: np.ndarray) -> bytes:
    """Counts as LEB128 bytes."""
    from murmurate.llm.decontaminate import varint

    return varint(counts)[0].tobytes()


def _large(data: bytes) -> np.ndarray:
    from murmurate.llm.decontaminate import unvarint

    return unvarint(np.frombuffer(data, np.uint8))


def count(docs: DataFrame, block_bits: int) -> DataFrame:
    """COUNTS: partial sums of words (kind 1) and pairs (kind 2), sorted by key, by block (the key's first bits)."""

    def out(kind: int, hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(hashes), return_counts=True)
        cut = np.searchsorted(keys >> np.uint64(64 - block_bits), np.arange((1 << block_bits) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()),
                pa.array(np.full(len(some), kind), pa.int32()),
                pa.array([keys[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()),
                pa.array([_small(n[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
            ],
            ["block", "kind", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: list[np.ndarray] = []
        two: list[np.ndarray] = []
        for batch in batches:
            for _, _, buf, off in T.slices(batch.column(0)):
                h, pair, _ = tokens(buf, off)
                one.append(word_key(h))
                two.append(pair)
                if sum(map(len, one)) >= CHUNK_TOKENS:
                    yield from out(1, one)
                    yield from out(2, two)
                    one, two = [], []
        if one:
            yield from out(1, one)
            yield from out(2, two)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)


def build(counts: DataFrame, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """MODEL: the filter of each block, and for words the exact counts."""

    def merge(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        keys = np.frombuffer(b"".join(x.as_py() for x in t.column("keys")), np.uint64)
        keys, n = _sum(keys, np.concatenate([_large(x.as_py()) for x in t.column("counts")]))
        bits, data = fill(keys, n, bits_per_entry)
        exact = kind == 1
        return pa.table(
            {
                "block": t.column("block").slice(0, 1),
                "kind": t.column("kind").slice(0, 1),
                "n": pa.array([len(keys)], pa.int64()),
                "total": pa.array([int(n.sum())], pa.int64()),
                "bits": pa.array([bits], pa.int64()),
                "filter": pa.array([data.tobytes()], pa.binary()),
                "keys": pa.array([keys.tobytes() if exact else None], pa.binary()),
                "counts": pa.array([_small(n) if exact else None], pa.binary()),
            }
        )

    return counts.groupBy("block", "kind").applyInArrow(merge, MODEL)


class Filter:
    """Blocks of a filter; ``levels`` probes them."""

    def __init__(self, block_bits: int, rows: list[tuple[int, int, bytes]]):
        self.shift = np.uint64(64 - block_bits)
        self.bits = np.zeros(1 << block_bits, np.int64)
        self.at = np.zeros(1 << block_bits, np.int64)
        rows = sorted(rows, key=lambda r: r[0])
        done = 0
        for block, bits, data in rows:
            self.bits[block], self.at[block] = bits, done
            done += len(data)
        self.data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        q = np.zeros(len(keys), np.int64)
        block = (keys >> self.shift).astype(np.int64)
        some = np.flatnonzero(self.bits[block] > 0)
        at = 1
        while len(some):
            k, b = keys[some], block[some]
            ok = np.ones(len(some), bool)
            for p in _places(k, at, self.bits[b]):
                ok &= (self.data[self.at[b] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 > 0
            some = some[ok]
            q[some] = at
            at += 1
        return q


class Slice:
    """What one pass broadcasts: pair filter and exact word counts of some blocks, and the whole word filter."""

    def __init__(self, block_bits: int, lo: int, hi: int, words: Filter, pairs: Filter, keys: np.ndarray, counts: np.ndarray, n: int, v: int):
        self.block_bits, self.lo, self.hi = block_bits, lo, hi
        self.words, self.pairs, self.keys, self.counts, self.n, self.v = words, pairs, keys, counts, n, v

    def mine(self, keys: np.ndarray) -> np.ndarray:
        block = (keys >> np.uint64(64 - self.block_bits)).astype(np.int64)
        return (block >= self.lo) & (block < self.hi)

    def score(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        rows = len(off) - 1
        h, pair, owner = tokens(buf, off)
        key, inverse = np.unique(word_key(h), return_inverse=True)
        # exact counts for the base score, of the words in this slice
        own = self.mine(key)
        pos = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        c = np.where(self.keys[pos] == key, self.counts[pos], 0) if len(self.keys) else np.zeros(len(key), np.int64)
        floor = self.n + self.v + 1
        base = np.where(own, np.log10((c + 1) / floor), 0.0)[inverse]
        known = (own & (c > 0))[inverse]
        # the model, for the pairs in this slice
        q1 = self.words.levels(key)
        f1 = least(q1)[inverse]
        pk, pinv = np.unique(pair, return_inverse=True)
        f2 = least(self.pairs.levels(pk))[pinv]
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        context = np.concatenate([[0.0], most(q1)[inverse][:-1]])
        context[first] = max(self.documents, 1)
        ratio = np.where(context > 0, np.minimum(1.0, f2 / np.maximum(context, 1)), 0.0)
        p = LAMBDA * ratio + (1 - LAMBDA) * (f1 + 1) / floor
        logp = np.where(self.mine(pair), np.log10(p), 0.0)
        sums = lambda w: np.bincount(owner, weights=w, minlength=rows)
        n_tokens = np.bincount(owner, minlength=rows) * (self.lo == 0)
        return [n_tokens, sums(known).astype(np.int64), sums(base), sums(logp)]

    documents = 0


def _slices(model: DataFrame, block_bits: int, limit: int) -> Iterator[Slice]:
    sizes = model.groupBy("block").agg(F.sum(F.when(F.col("kind") == 2, F.length("filter")).otherwise(12 * F.col("n"))).alias("size"), F.sum(F.when(F.col("kind") == 1, F.col("total"))).alias("total"), F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("n")).collect()
    n, v = sum(r["total"] or 0 for r in sizes), sum(r["n"] or 0 for r in sizes)
    size = np.zeros(1 << block_bits, np.int64)
    for r in sizes:
        size[r["block"]] = r["size"]
    words = Filter(block_bits, [(r["block"], r["bits"], bytes(r["filter"])) for r in model.where("kind = 1").select("block", "bits", "filter").toLocalIterator()])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), limit, "right")) + lo)
        part = model.where((F.col("block") >= lo) & (F.col("block") < hi))
        pairs = Filter(block_bits, [(r["block"], r["bits"], bytes(r["filter"])) for r in part.where("kind = 2").select("block", "bits", "filter").toLocalIterator()])
        exact = [(np.frombuffer(bytes(r["keys"]), np.uint64), _large(bytes(r["counts"])).astype(np.int32 if n < 2**31 else np.int64)) for r in part.where("kind = 1").orderBy("block").select("keys", "counts").toLocalIterator()]
        keys = np.concatenate([k for k, _ in exact]) if exact else np.zeros(0, np.uint64)
        yield Slice(block_bits, lo, hi, words, pairs, keys, np.concatenate([c for _, c in exact]) if exact else np.zeros(0, np.int64), n, v)
        lo = hi


def score(docs: DataFrame, limit: int = SLICE_BYTES, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; more bits an entry, fewer false positives."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = d.where(~held_out(F.col("doc_id")))
    block_bits = int(np.clip(np.ceil(np.log2(int(spark.conf.get("spark.sql.shuffle.partitions")) * 8)), 8, 16))
    model = save(build(count(train, block_bits), bits_per_entry), "bloom")
    with_row = d.withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    passes: list[DataFrame] = []
    T.small_batches(spark)
    n = 0
    texts = None
    for part in _slices(model, block_bits, limit):
        n = part.n
        if texts is None:
            texts = train.count()
        part.documents = texts
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in SCORES.split(", ")]
            for batch in batches:
                for i, j, buf, off in T.slices(batch.column(2), 3 << 20):
                    cols = shared.value.score(buf, off)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(c) for c in cols)], names)

        passes.append(with_row.select("row", "doc_id", "text").mapInArrow(run, SCORES))
    whole = passes[0]
    if len(passes) > 1:
        for df in passes[1:]:
            whole = whole.unionByName(df)
        # rows of one text and doc_id are alike: their sums are parted among them again
        copies = F.col("copies")
        sums = whole.groupBy("row", "doc_id").agg((F.count(F.lit(1)) / len(passes)).cast("int").alias("copies"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
        one = sums.select("doc_id", *((F.col(c) / copies).cast("long").alias(c) for c in ("n_tokens", "n_known")), *((F.col(c) / copies).alias(c) for c in ("base_score", "score")), F.array_repeat(F.lit(0), copies).alias("r"))
        whole = one.withColumn("r", F.explode("r"))
    return whole.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
