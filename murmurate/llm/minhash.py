"""MinHash near-duplicate detection.

1. A map hashes the distinct four-word shingles of each text with ``HASHES``
   multiply-shift functions and keeps the minima as ``BANDS`` bands of ``ROWS``
   minima.  Texts with equal shingle sets are one node (the smallest doc_id
   stands for it).
2. Nodes that share a band's key are candidates.  Only their texts are read
   again, for the full shingle set and a signature of 16 bits a minimum, so the
   wide columns of all other documents are neither kept nor shuffled.  In each
   bucket every node is
   paired with the bucket's smallest node: one row a member, however large the
   bucket.  Pairs whose signatures agree in fewer than ``AGREE`` of the places
   are dropped; the rest are confirmed on the full shingle sets.
3. Components come from alternating large-star and small-star rounds.
4. Buckets that still hold several components are paired with another member,
   for a few rounds, each linear in the bucket; then what is still apart is
   compared completely, in blocks: pairs of different components whose
   signatures agree are confirmed on full sets within the block, which puts out
   a spanning forest of its links, not all of them.  After that no candidate
   pair of different components is untested, so nothing hangs on the choice of
   members.
5. Components again, from all confirmed links.

With 40 bands of 5 a pair at the threshold of 0.8 shares a bucket with
probability 1 - 1e-7.

The sizes of open buckets are written before they are joined, so that both sides
of that join are plain shuffles, whose heavy partitions Spark's adaptive
execution splits; no member list is ever one row.

Defined cases: a text with fewer than four words is one shingle of all its
words; a null text or one without words has no shingles, is linked with nothing
and is its own component; a null doc_id is never linked, its component_id is
null and it is kept; rows that share a doc_id are one node; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.llm import textops as T
from murmurate.llm.scratch import discard, save

SHINGLE = 4
BANDS, ROWS, HASHES = 40, 5, 256
#: Share of equal minima from which a pair is compared exactly; at a similarity of 0.8 it lies four deviations below the mean.
AGREE = 0.70
#: Rounds after the first: all but the last pair each bucket's members with one more member, the last compares what is still apart.
TURNS = 5
#: Members, and shingles, of an open bucket that are compared with each other in one task.
BLOCK, BLOCK_SHINGLES = 4096, 2 << 20
#: Sets that are compared with one set at once.
AT_ONCE = 64

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)

_LAST = np.int64(2**63 - 1)

SIGNATURES = "doc_id long, n_shingles long, set1 long, set2 long, bands binary"
NODES = "node long, n long, bands binary, sig binary, shingles binary"


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within a row, and the start of each row in them."""
    n = len(off) - 1
    h, rows, _, _ = T.words(buf, off, T.SPACED, True)
    first = T.row_starts(rows, n)
    w, at = T.windows(h, first, k)
    owner = rows[at]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([T.combine(np.array([counts[r]], np.uint64), *h[first[r] : first[r + 1], None])[0] for r in short], np.uint64)
        w, owner = np.concatenate([w, whole]), np.concatenate([owner, short])
    order = np.lexsort((w, owner))
    w, owner = w[order], owner[order]
    keep = np.ones(len(w), bool)
    keep[1:] = (w[1:] != w[:-1]) | (owner[1:] != owner[:-1])
    w, owner = w[keep], owner[keep]
    return w, np.searchsorted(owner, np.arange(n + 1))


def minima(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``HASHES`` minima of each of the sets, none empty, and their band keys; a row for each set."""
    sig = np.zeros((HASHES, len(first)), np.uint32)
    keys = np.zeros((BANDS, len(first)), np.uint64)
    if len(first):
        for k in range(HASHES):
            sig[k] = np.minimum.reduceat(w * _A[k] + _B[k], first) >> np.uint64(32)
    for b in range(BANDS):
        keys[b] = T.combine(np.full(len(first), b + 1, np.uint64), *(sig[b * ROWS + r].astype(np.uint64) for r in range(ROWS)))
    return np.ascontiguousarray(sig.T), np.ascontiguousarray(keys.T)


def signatures(docs: DataFrame) -> DataFrame:
    """SIGNATURES of every row; the last three columns are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        for batch in batches:
            for i, j, buf, off in T.slices(batch.column(1)):
                w, first = shingle_sets(buf, off)
                n = np.diff(first)
                some = np.flatnonzero(n)
                _, keys = minima(w, first[some])
                set1, set2, bands = ([None] * (j - i) for _ in range(3))
                for r, key in zip(some.tolist(), keys, strict=True):
                    digest = hashlib.blake2b(w[first[r] : first[r + 1]].tobytes(), digest_size=16).digest()
                    set1[r], set2[r] = np.frombuffer(digest, np.int64).tolist()
                    bands[r] = key.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(set1, pa.int64()), pa.array(set2, pa.int64()), pa.array(bands, pa.binary())],
                    ["doc_id", "n_shingles", "set1", "set2", "bands"],
                )

    T.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURES)


def band_keys(nodes: DataFrame) -> DataFrame:
    """A row (key, node) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], ["key", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "key long, node long")


def agreement(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree and whose set sizes allow the threshold."""
    sig = nodes.select("node", "n", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    both = both.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * 80))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in (2, 3))
                ok = pa.array((x == y).mean(axis=1) >= AGREE)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])
            T.release()

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def candidates(buckets: DataFrame, docs: DataFrame) -> DataFrame:
    """NODES of the buckets' nodes, read again from the documents; empty sets are left out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        for batch in batches:
            for i, j, buf, off in T.slices(batch.column(1)):
                w, first = shingle_sets(buf, off)
                n = np.diff(first)
                some = np.flatnonzero(n)
                sig, keys = minima(w, first[some])
                each = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(n[some].astype(np.int64)), each(keys), each(sig.astype(np.uint16)), each(w[first[r] : first[r + 1]] for r in some)],
                    ["node", "n", "bands", "sig", "shingles"],
                )

    return d.mapInArrow(sets, NODES)


def confirm(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= 80 * union."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common > 0 and 100 * common >= 80 * (len(p) + len(q) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])
            T.release()

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def linked_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Confirmed pairs; written in between, so that a task needs one Python worker, not one for each step."""
    return confirm(save(agreement(pairs, nodes), "agreed"), nodes)


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """(node, component) of every linked node, the smallest node being the component.

    Large-star connects a node's larger neighbours with its smallest one,
    small-star its smaller neighbours and itself; they alternate until nothing
    changes (Kiveris et al. 2014).  Only minima are gathered by node, so a hub
    is no burden.  Every round is written to the shared folder.
    """
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, edges = edges, save(small, name)
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) after more links: only the components that they join are a graph, not all links again."""
    end = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = found.join(end("a"), "a", "left").join(end("b"), "b", "left")
    small = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    known = comps.join(small.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return save(known.unionByName(small.join(comps.select("node"), "node", "left_anti").select("node", "component")), "components")


def grouped(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, component) of the buckets that hold more than one component, equal buckets once."""
    m = buckets.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("x"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("h")).where("lo <> hi")
    once = mixed.groupBy("x", "n", "h").agg(F.min("key").alias("key")).select("key", "n")
    return m.join(once, "key")


def star_pairs(held: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket with the bucket's member that comes first in this turn's order, if their components differ."""
    first = held.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("pivot"), F.col("component").alias("pc"))).alias("f")).select("key", "f.pivot", "f.pc")
    return held.join(first, "key").where("component <> pc").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()


def linked(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of ``others`` reach the threshold with ``one``; sorted sets, none empty."""
    size = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.searchsorted(one, every)
    at[at == len(one)] = 0
    common = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(size) - size)
    return 100 * common >= 80 * (len(one) + size - common)


def _block(t: pa.Table) -> pa.Table:
    """Links of a cell of a bucket that join components: every pair of different components is tested once, until it is joined."""
    key, p, q = (t.column(c)[0].as_py() for c in ("key", "p", "q"))
    node, comp, n, own = (t.column(c).to_numpy() for c in ("node", "component", "n", "own"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
    bands = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
    _, root = np.unique(comp, return_inverse=True)
    a, b = [], []
    right = np.flatnonzero(own == q)
    for i in np.flatnonzero(own == p):
        j = right[right > i] if p == q else right
        j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * 80)]
        # a pair is tested in the first of the buckets that it shares
        j = j[np.where(bands[j] == bands[i], bands[i], _LAST).min(axis=1) == key]
        j = j[np.count_nonzero(sig[j] == sig[i], axis=1) >= AGREE * HASHES]
        while len(j):
            some, j = j[:AT_ONCE], j[AT_ONCE:]
            for x in some[linked(sets[i], [sets[x] for x in some])]:
                if root[x] != root[i]:
                    a.append(node[i])
                    b.append(node[x])
                    root[root == root[x]] = root[i]
            j = j[root[j] != root[i]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def open_links(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """Confirmed links between different components in buckets of several components.

    A bucket beyond ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles is compared
    block by block.  Sets are at hand in each cell, and a cell puts out only
    links that join what it has not joined yet: fewer rows than it has members.
    """
    sized = held.select("key", "node", "component").join(nodes.select("node", "n"), "node")
    blocks = sized.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("g"))
    dealt = sized.drop("n").join(save(blocks, "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("g").cast("long")).cast("int"))
    dealt = dealt.select("key", "node", "component", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))).alias("cell"))
    dealt = dealt.select("key", "cell.p", "cell.q", "own", "node", "component").join(nodes, "node")
    found = dealt.groupBy("key", "p", "q").applyInArrow(_block, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    sigs = save(signatures(docs), "signatures")
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    rep = save(some.groupBy("set1", "set2").agg(F.min(F.struct("doc_id", "bands")).alias("f")).select("set1", "set2", F.col("f.doc_id").alias("node"), "f.bands"), "representatives")
    keys = band_keys(rep)
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "pivot")
    buckets = save(keys.join(shared, "key"), "buckets")
    nodes = save(candidates(buckets, docs), "nodes")
    pairs = buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = save(linked_pairs(pairs, nodes), "links")
    comps = save(components(links), "components")
    for turn in range(1, TURNS + 1):
        held = save(grouped(buckets, comps), "held")
        if held.isEmpty():
            break
        last = turn == TURNS
        found = save(open_links(held, nodes) if last else linked_pairs(star_pairs(held, turn), nodes), "links")
        if found.isEmpty() and not last:
            continue
        comps = merged(comps, found)
    found = sigs.select("doc_id", "n_shingles", "set1", "set2").join(rep.drop("bands"), ["set1", "set2"], "left").join(comps, "node", "left")
    # rows that share a doc_id are one document
    joint = F.coalesce("component", "node", "doc_id")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), joint).alias("component_id")).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
