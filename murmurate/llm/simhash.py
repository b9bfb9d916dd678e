"""SimHash near-duplicate detection by a binary trie self-join.

1. A map hashes every four-word shingle of a text with XXH64 and keeps the
   majority of each of the 64 bits.  Equal fingerprints are one node (the
   smallest doc_id stands for it), however many documents share them.
2. Two fingerprints that differ in at most ``BUDGET`` bits agree in one whole
   part of ``BUDGET + 1`` parts of their bits.  So each is dealt once for each
   part, with that part's bits moved to the top: what shares a part is a binary
   trie whose root lies below the part.  A trie of more than ``LIMIT``
   fingerprints is dealt again by parts of its remaining bits, until none is
   larger; a trie below d equal bits holds 2 ** (64 - d) fingerprints at most,
   so this ends.
3. A task walks its tries in pairs of nodes, starting with each root and itself:
   a pair splits into the pairs of its children, the differing bits add up, and
   a pair goes as soon as they exceed the budget.  Nodes are ranges of the sorted
   fingerprints.  A pair of nodes also goes if all that lies below both is known
   to be one component, so a dense group of near copies costs no square.
4. A task puts out a forest of links, fewer than it has fingerprints, and
   components come from alternating large-star and small-star.

Defined cases: a null text or one without words has the fingerprint zero and is
linked like any other; fewer than four words are one shingle; very long texts
are hashed whole; a bit is set in over half of the shingles, so a tie leaves it
unset; a null doc_id keeps its fingerprint, is never linked and has a null
component_id; rows that share a doc_id are one document, whose fingerprints are
all linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.llm import textops as T
from murmurate.llm.minhash import components
from murmurate.llm.scratch import save

SHINGLE, SEED = 4, 42
BITS, BUDGET = 64, 4
#: Fingerprints of a trie that one task walks; a larger one is dealt by parts of its remaining bits.
LIMIT = 1 << 18
#: Bits of a trie below which it is not dealt again.
LAST_BITS = 10
#: Node pairs of a trie that are taken at once, and products of two nodes' sizes that are compared without further splits.
AT_ONCE, LEAF = 1 << 15, 64
#: Shingles whose bits are spread out at once.
SPREAD = 1 << 15


def fingerprints(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The fingerprint of every row of a slice."""
    mask = T.SPACED[buf]
    starts, ends = T.runs(mask, off)
    first = T.row_starts(np.searchsorted(off, starts, "right") - 1, len(off) - 1)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(starts):
        return out
    # all words of the slice with one space behind each
    size = ends - starts
    begin = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1] + 1, out=begin[1:])
    spaced = np.full(int(begin[-1] + size[-1] + 1), 0x20, np.uint8)
    spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = T.LOWER[buf[mask]]
    words = np.diff(first)
    n = np.where(words < SHINGLE, np.minimum(words, 1), words - SHINGLE + 1)
    upto = np.concatenate([[0], np.cumsum(n)])
    head = np.arange(upto[-1]) - np.repeat(upto[:-1] - first[:-1], n)
    tail = np.minimum(head + SHINGLE, np.repeat(first[1:], n)) - 1
    text, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin[head].tolist(), (begin + size)[tail].tolist(), strict=True)), np.uint64, len(head))
    alone = n == 1
    out[alone] = h[upto[:-1][alone]]
    for r in np.flatnonzero(n > 1).tolist():
        own, ones = h[upto[r] : upto[r + 1]], np.zeros(BITS, np.int64)
        for a in range(0, len(own), SPREAD):
            ones += np.unpackbits(own[a : a + SPREAD].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return out


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        for batch in batches:
            for i, j, buf, off in T.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fingerprints(buf, off).view(np.int64))], ["doc_id", "fp"])

    T.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def join_components(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a and b; ``root`` names each one's component by its smallest member."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


class Tries:
    """Tries over sorted values; those from start[i] to start[i + 1] agree in their ``depth[i]`` highest bits."""

    def __init__(self, values: np.ndarray, member: np.ndarray, start: np.ndarray, depth: np.ndarray) -> None:
        self.values, self.member, self.start, self.depth = values, member, start, depth
        self.root = np.arange(int(member.max()) + 1 if len(member) else 0)

    def link(self) -> np.ndarray:
        """The component of every member; members within the budget of each other share one."""
        if len(self.values) > 1:
            # neighbours in the order of a trie first: dense groups become one component before the walk
            near = np.bitwise_count(self.values[1:] ^ self.values[:-1]) <= BUDGET
            near[self.start[1:-1] - 1] = False
            i = np.flatnonzero(near)
            join_components(self.root, self.member[i], self.member[i + 1])
            self.label()
            self.walk()
        return self.root

    def label(self) -> None:
        self.comp = self.root[self.member]
        self.changes = np.concatenate([[0], np.cumsum(self.comp[1:] != self.comp[:-1])])

    def walk(self) -> None:
        lo, hi = self.start[:-1], self.start[1:]
        stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int64), self.depth.astype(np.int64))]
        while stack:
            part = stack.pop()
            while stack and len(part[0]) < AT_ONCE // 4:
                part = tuple(np.concatenate(x) for x in zip(part, stack.pop(), strict=True))
            if len(part[0]) > AT_ONCE:
                stack.append(tuple(x[AT_ONCE:] for x in part))
                part = tuple(x[:AT_ONCE] for x in part)
            a, b, c, d, wrong, depth = part
            known = (self.changes[b - 1] == self.changes[a]) & (self.changes[d - 1] == self.changes[c]) & (self.comp[a] == self.comp[c])
            leaf = (b - a) * (d - c) <= LEAF
            self.compare(*(x[leaf & ~known] for x in (a, b, c, d)))
            if len(rest := np.flatnonzero(~leaf & ~known)):
                stack.append(self.children(*(x[rest] for x in part)))

    def children(self, a, b, c, d, wrong, depth) -> tuple[np.ndarray, ...]:
        """The pairs of children of pairs of nodes that stay within the budget; a node with itself has each pair once."""
        bit = np.uint64(BITS - 1) - depth.astype(np.uint64)
        m, k = self.middle(a, b, bit), self.middle(c, d, bit)
        own = a == c
        some = (np.ones(len(a), bool), np.ones(len(a), bool), ~own, np.ones(len(a), bool))
        ends = ((a, m, c, k, 0), (m, b, k, d, 0), (m, b, c, k, 1), (a, m, k, d, 1))
        found = []
        for ok, (p, q, r, s, more) in zip(some, ends, strict=True):
            ok = ok & (p < q) & (r < s) & (wrong + more <= BUDGET)
            found.append((p[ok], q[ok], r[ok], s[ok], wrong[ok] + more, depth[ok] + 1))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def middle(self, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Where the child with the bit set begins in each node."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            one = (self.values[np.minimum(mid, len(self.values) - 1)] >> bit) & np.uint64(1) == 1
            hi = np.where(open_ & one, mid, hi)
            lo = np.where(open_ & ~one, mid + 1, lo)
        return lo

    def compare(self, a, b, c, d) -> None:
        """Compares all that lies below small pairs of nodes."""
        if not len(a):
            return
        n = (b - a) * (d - c)
        rel = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(d - c, n)
        i, j = np.repeat(a, n) + rel // wide, np.repeat(c, n) + rel % wide
        ok = (i < j) & (self.comp[i] != self.comp[j])
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(self.values[i] ^ self.values[j]) <= BUDGET
        if ok.any():
            join_components(self.root, self.member[i[ok]], self.member[j[ok]])
            self.label()


def parts(left: int) -> list[tuple[int, int]]:
    """(first, length) of the parts of so many bits; two values that differ in ``BUDGET`` bits agree in one of them."""
    size = [left // (BUDGET + 1) + (k < left % (BUDGET + 1)) for k in range(BUDGET + 1)]
    return [(sum(size[:k]), size[k]) for k in range(BUDGET + 1)]


def turned(value: F.Column, left: int, by: int) -> F.Column:
    """The lowest ``left`` bits rotated to the left by ``by`` places, those above them kept."""
    if not by:
        return value
    if left == BITS:
        return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, BITS - by))
    mask = (1 << left) - 1
    low = value.bitwiseAND(F.lit(mask))
    ring = F.shiftleft(low, by).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftrightunsigned(low, left - by))
    return value.bitwiseAND(F.lit(~mask)).bitwiseOR(ring)


def deal(rows: DataFrame, depth: int) -> dict[int, DataFrame]:
    """(path, value, node) of each part of the bits below ``depth``, by the depth that their tries begin at."""
    left = BITS - depth
    by_depth: dict[int, list] = {}
    for k, (first, size) in enumerate(parts(left)):
        by_depth.setdefault(depth + size, []).append(F.struct((F.col("path") * (BUDGET + 2) + k + 1).alias("path"), turned(F.col("value"), left, first).alias("value"), "node"))
    return {d: rows.select(F.explode(F.array(*each)).alias("e")).select("e.*") for d, each in by_depth.items()}


def trie_links(rows: DataFrame, depth: int, limit: int = LIMIT) -> DataFrame:
    """Links (a, b), a forest for each batch of tries; a trie is what agrees in path and in the ``depth`` highest bits, a batch what is gathered beyond ``limit``."""

    def found(path: np.ndarray, value: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        top = value >> np.uint64(BITS - depth)
        start = np.concatenate([[0], np.flatnonzero((path[1:] != path[:-1]) | (top[1:] != top[:-1])) + 1, [len(path)]])
        names, member = np.unique(node, return_inverse=True)
        root = Tries(value, member, start, np.full(len(start) - 1, depth)).link()
        x = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[root[x]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        waiting, n = [held], 0
        for batch in batches:
            path, value, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            waiting.append((path, value.view(np.uint64), node))
            n += len(path)
            if n < limit:
                continue
            held = tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
            # the last trie may go on in the next batch
            last = (held[0] != held[0][-1]) | (held[1] >> np.uint64(BITS - depth) != held[1][-1] >> np.uint64(BITS - depth))
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield found(*(x[:cut] for x in held))
            waiting = [tuple(x[cut:].copy() for x in held)]
            n = len(waiting[0][0])
        held = tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
        if len(held[0]):
            yield found(*held)
        T.release()

    dealt = rows.withColumn("top", F.shiftrightunsigned("value", BITS - depth)).repartition("path", "top")
    return dealt.sortWithinPartitions("path", "value").select("path", "value", "node").mapInArrow(run, "a long, b long")


def near_links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that join all (value, node) within the budget of each other."""
    work = {0: nodes.select(F.lit(0).cast("long").alias("path"), "value", "node")}
    tries: list[DataFrame] = []
    while work:
        depth, rows = work.popitem()
        for below, dealt in deal(rows, depth).items():
            top = F.shiftrightunsigned("value", BITS - below)
            heavy = dealt.groupBy("path", top.alias("top")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("path", "top")
            if BITS - below > LAST_BITS and not (heavy := save(heavy, "heavy")).isEmpty():
                dealt = dealt.withColumn("top", top)
                again = save(dealt.join(heavy, ["path", "top"], "left_semi").select("path", "value", "node"), "again")
                work[below] = work[below].unionByName(again) if below in work else again
                dealt = dealt.join(heavy, ["path", "top"], "left_anti").select("path", "value", "node")
            tries.append(trie_links(dealt, below, limit))
    links = tries[0]
    for more in tries[1:]:
        links = links.unionByName(more)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    prints = save(hashed(docs), "fingerprints")
    named = prints.where("doc_id is not null")
    nodes = save(named.groupBy("fp").agg(F.min("doc_id").alias("node")).select(F.col("fp").alias("value"), "node"), "nodes")
    rep = nodes.select(F.col("value").alias("fp"), "node")
    several = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    several = named.join(several, "doc_id", "left_semi").join(rep, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comps = components(near_links(nodes).unionByName(several))
    found = prints.join(rep, "fp", "left").join(comps, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
