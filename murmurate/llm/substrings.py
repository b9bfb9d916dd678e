"""Exact-substring deduplication with suffix arrays.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts anywhere
else.  Beside that, passages are counted: a word lies in one if a string of
``PASSAGE`` whole words (or of ``WIDTH`` bytes, where the words take more) that
holds the word also stands at a word's start of another document.

Every such string has an anchor, the first smallest seed hash among its first
``WIDTH``/2 bytes and half of its words, which depends on the string alone; each
start belongs to one anchor.  So:

1. A map cuts every text into anchors and emits, for each, a hash of the bytes
   at the anchor that all its strings hold, and a hash of the whole context of
   the starts that it owns.
2. Anchors seen once have no repeats.  Anchors whose whole context is seen
   twice are repeats throughout.  What is left (an anchor seen again in another
   context: the edges of repeated passages) goes on, one context of each kind.
3. Such contexts are dealt to shards by anchor.  Each shard builds a suffix
   array by Larsson-Sadakane refinement (of blocks aligned at the anchors, as
   equal strings have them in the same place), takes Kasai's common prefixes,
   and marks the owned starts whose neighbours share ``WIDTH`` bytes, or
   ``PASSAGE`` words.
4. An anchor with very many contexts is split over several shards; these also
   put out their starts as sorted lists of string hashes, which are cut at fixed
   keys by binary search, and the lists of one key range are merged.
5. Marks are joined to the texts, united, and the rest is hashed.

The filter in 1 and 2 loses nothing: two equal strings have equal anchors.
A text is named by a 64-bit hash of itself, so it keeps its name in every job,
whatever executors come or go, and exact copies are one text.  Strings are
compared by 64-bit hashes where they don't meet in a suffix array, and contexts
agree in two of them.

Defined cases: a null text is an empty one; texts shorter than WIDTH lose
nothing; repeated rows are each other's repeats; a null doc_id stays null; very
long texts are cut as a whole, by a work array of some 100 bytes for each of
their bytes; an empty table gives an empty result; other columns are ignored.
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

WIDTH = 400
#: Words of a passage.
PASSAGE = 51
#: Contexts of one anchor in a shard before it is split.
SPLIT = 2000
#: Bytes of starts that one task merges across shards.
MERGE = 8 << 20
#: Bytes to which contexts are rounded when they look for partners.
GRID = 32
#: Bytes of contexts that a shard should have, and of texts cut at once.
SHARD = SLICE = 1 << 20

#: What a span of starts says: strings of bytes that are repeated, passages of words.
BYTES, WORDS = 1, 2

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(pow(int(_P), -1, 1 << 64))
#: Order of the bytes in a suffix array: 0 parts contexts, white space comes next, so that texts which end a word in the same place lie together.
_SPACES = np.flatnonzero(~T.SPACED)
_RANKED = np.zeros(256, np.uint8)
_RANKED[_SPACES] = np.arange(1, len(_SPACES) + 1)
_RANKED[T.SPACED] = len(_SPACES) + 1 + np.minimum(np.arange(250), 248)
_FIRST_LETTER = len(_SPACES) + 1

#: ``span`` is the number of owned starts beyond the first, and the anchor's place after it, in 16 bits each.
ANCHORS = "fp long, ctx long, row long, lo int, span int"
CONTEXTS = "fp long, ctx long, row long, lo long, n long, parts long, opens boolean, context binary, own long, at long"
MARKS = "kind int, row long, lo long, hi long, keys binary, starts binary"


class Prefix:
    """Hashes of all substrings of a byte array."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _Q)]))
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _P)]))[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(T._BYTE[buf] * power, out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return T.mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo])


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, the first one lowest; zeros follow the last."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf), np.dtype("<u8"), padded, 0, (1,)).astype(np.uint64)


def _word_starts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where a word starts, within its row."""
    new = mask.copy()
    new[1:] &= ~mask[:-1]
    first = off[:-1][off[:-1] < len(mask)]
    new[first] = mask[first]
    return np.flatnonzero(new)


def anchors(buf: np.ndarray, off: np.ndarray, width: int = WIDTH, words: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, row, first owned start (within the row) and span, as in ANCHORS."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    half, some, n = width // 2, (words - 1) // 2, len(buf)
    size = np.diff(off)
    ws = _word_starts(T.SPACED[buf], off)
    row_ws = np.searchsorted(ws, off)
    full = np.flatnonzero(np.diff(row_ws) >= words)
    starts = np.maximum(size - width + 1, 0)
    starts[full] = np.maximum(starts[full], ws[row_ws[full + 1] - words] - off[full] + 1)
    if not starts.sum():
        return none
    row = np.repeat(np.arange(len(size), dtype=np.int32), starts)
    p = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + off[row]
    # the word start that comes ``some`` after each place, or the row's end
    later = np.zeros(n + 1, np.int32)
    later[ws + 1] = 1
    later = np.cumsum(later, dtype=np.int32)  # starts before each place
    far = np.append(ws, np.full(some + 1, n))

    def reach(at: np.ndarray, r: np.ndarray) -> np.ndarray:
        k = later[np.minimum(at + 1, n)] + some - 1
        inside = k < row_ws[r + 1]
        return np.minimum(np.where(inside, far[np.minimum(k, len(far) - 1)], off[r + 1]), np.minimum(at + half, off[r + 1]))

    end = np.minimum(reach(p, row), off[row + 1] - 1)
    low = (T.mix(_words(buf)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    level = (np.log2(end - p + 1) + 1e-9).astype(np.int8)
    at = np.empty(len(p), np.int64)
    span = 1
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            at[own] = (np.minimum(low[p[own]], low[end[own] - span + 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low[:-span] = np.minimum(low[:-span], low[span:])
        span *= 2
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    lo, hi, a, r = p[first], p[last], at[first], row[first]
    h = Prefix(buf)
    stop = np.minimum(hi + width, off[r + 1])
    ctx = T.combine(h.of(lo, stop), (a - lo).astype(np.uint64), (hi - lo).astype(np.uint64), (stop - lo).astype(np.uint64))
    return h.of(a, reach(a, r)).view(np.int64), ctx.view(np.int64), r.astype(np.int64), lo - off[r], (hi - lo) | (a - lo) << 16


def _cut(word: np.ndarray, place: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first ``left`` bytes of the words at places, the first one highest; none if that is not positive."""
    out = np.zeros(len(place), np.uint64)
    some = left > 0
    gone = np.uint64(8) * (8 - np.clip(left[some], 1, 8)).astype(np.uint64)
    out[some] = (word[place[some]] << gone >> gone).byteswap()
    return out


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and for each key the place in it where its equals begin."""
    by = np.argsort(key)
    ordered = key[by]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    rank = np.empty(len(key), np.int64)
    rank[by] = np.repeat(begin, np.diff(np.append(begin, len(key))))
    return by, rank


def _sort_tied(order: np.ndarray, rank: np.ndarray, key) -> None:
    """Sorts ``order`` deeper, in place, where ``rank`` (the place where a suffix's equals begin) is shared; ``key`` gives the next key of some suffixes."""
    own = rank[order]
    head = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    if not len(tied):
        return
    s, own = order[tied], own[tied]
    both = own << np.int64(len(tied).bit_length()) | _groups(key(s))[1]
    by = np.argsort(both)
    both = both[by]
    order[tied] = s[by]
    begin = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    rank[order[tied]] = np.repeat(tied[begin], np.diff(np.append(begin, len(tied))))


def _block_ranks(key: np.ndarray, row: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, from 1 on, of the ``wanted`` runs of ``depth`` blocks; a run ends with its row.

    Refinement as of Larsson and Sadakane (2007): runs sorted to a depth are sorted
    deeper by the ranks of runs further on, in groups that are still tied.  As many
    ranks as fit into 64 bits make a key, and only runs whose rank the rest needs go on.
    """
    n = len(key)
    bits = n.bit_length()
    each = max(62 // bits, 2)
    # depths from the last to the first: places that are read at each
    plan: list[list[int]] = []
    while depth > 1:
        before = -(-depth // each)
        plan.append(sorted({min(k * before, depth - before) for k in range(1, each)} - {0}))
        depth = before
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
    end = np.repeat(last, np.diff(np.append(-1, last)))
    need = [np.flatnonzero(wanted)]
    for hops in plan:
        more = np.zeros(n, bool)
        more[need[-1]] = True
        for hop in hops:
            at = need[-1] + hop
            more[at[at <= end[need[-1]]]] = True
        need.append(np.flatnonzero(more))
    places = need.pop()
    rank = np.zeros(n, np.int64)
    rank[places] = _groups(key[places])[1] + 1
    for hops in reversed(plan):
        places = need.pop()
        joined = rank[places]
        for hop in hops:
            at = places + hop
            inside = at <= end[places]
            joined = joined << np.int64(bits) | np.where(inside, rank[np.where(inside, at, 0)], 0)
        rank[places] = _groups(joined)[1] + 1
    return rank


def suffix_array(word: np.ndarray, begin: np.ndarray, size: np.ndarray, own: np.ndarray, at: np.ndarray, fp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The owned suffixes sorted, the ranks of all places (those that agree in ``depth`` bytes share one), and where an anchor's suffixes at one distance begin.

    ``word`` has eight bytes from each place on; a context starts at each
    ``begin`` and owns its first ``own`` places.  Equal strings have their anchor
    in the same place, so suffixes are sorted by anchor and distance to it, and
    then by their bytes.  Blocks of eight bytes that are aligned at the anchors
    thus serve all suffixes: they alone are ranked, an eighth of the places.
    """
    phase = at % 8
    count = np.maximum(-(-(size - phase) // 8), 0)
    base = np.cumsum(count) - count
    row = np.repeat(np.arange(len(size)), count)
    rel = phase[row] + 8 * (np.arange(len(row)) - base[row])
    # owned suffixes: place, context, and the first block at or after the place
    who = np.repeat(np.arange(len(size)), own)
    lead = np.arange(len(who)) - np.repeat(np.cumsum(own) - own, own)
    place = begin[who] + lead
    first = (lead - phase[who] + 7) // 8
    inside = first < count[who]
    block = np.where(inside, base[who] + first, 0)
    steps = max(depth - 7, 0) // 8
    ranks = np.zeros(len(row), np.int64)
    if steps and len(row):
        wanted = np.zeros(len(row), bool)
        wanted[block[inside]] = True
        ranks = _block_ranks(_cut(word, begin[row] + rel, size[row] - rel), row, wanted, steps)
    ahead = np.where(inside, ranks[block], 0) if len(row) else np.zeros(len(who), np.int64)

    def bytes_from(offset: int):
        return lambda s: _cut(word, place[s] + np.minimum(offset, (size[who] - lead)[s]), np.minimum((size[who] - lead)[s], depth) - offset)

    anchor = np.unique(fp, return_inverse=True)[1]
    order, rank = _groups(anchor[who] << np.int64(17) | (at[who] - lead))
    own_group = rank[order]
    fresh = np.concatenate([[True], own_group[1:] != own_group[:-1]])[: len(order)]
    for key in (bytes_from(0), lambda s: ahead[s], bytes_from(max(depth - 16, 0)), bytes_from(max(depth - 8, 0))):
        _sort_tied(order, rank, key)
    out = np.zeros(len(word), np.int64)
    out[place] = rank
    return place[order], out, fresh


#: Words of eight bytes that are compared at once.
_AHEAD = np.arange(0, 48, 8)


def common_prefixes(word: np.ndarray, order: np.ndarray, rank: np.ndarray, fresh: np.ndarray, begin: np.ndarray, count: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it, at most ``cap``; 0 where an anchor and distance begin (``fresh``).

    ``order`` holds ``count`` suffixes from each ``begin``.  Kasai's rule (a suffix
    shares at least one byte less than the suffix one place before) runs in all
    these stretches at once; it holds while the neighbour's next suffix is in the
    order too and the two are not tied; tied ones share ``cap`` bytes.
    """
    n = len(word)
    chosen = np.zeros(n + 1, bool)
    chosen[order] = True
    before = np.full(n, -1)
    before[order[1:]] = np.where(fresh[1:], -1, order[:-1])
    word = np.append(word, np.zeros(cap + 16 * len(_AHEAD), np.uint64))
    out = np.zeros(n, np.int32)
    lanes = np.argsort(-count, kind="stable")
    base, count = begin[lanes], count[lanes]
    h = np.zeros(len(base), np.int64)
    carry = np.zeros(len(base), bool)
    for step in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -step, "left"))
        i = base[:live] + step
        j = before[i]
        h = np.where((j >= 0) & carry[:live], np.maximum(h[:live] - 1, 0), 0)
        tied = (j >= 0) & (rank[i] == rank[j])
        h[tied] = cap
        go = np.flatnonzero((j >= 0) & (h < cap))
        while len(go):
            x = word[(i[go] + h[go])[:, None] + _AHEAD] ^ word[(j[go] + h[go])[:, None] + _AHEAD]
            differ = x != 0
            end = differ.any(axis=1)
            if end.any():
                part = go[end]
                k = differ[end].argmax(axis=1)
                low = x[end][np.arange(len(part)), k]
                low &= ~low + np.uint64(1)
                # the lowest set bit tells how many bytes are equal
                h[part] += 8 * k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
                go = go[~end]
            h[go] += 8 * len(_AHEAD)
            go = go[h[go] < cap]
        h = np.minimum(h, np.minimum(cap, n - np.maximum(i, j)))
        out[i] = h
        carry = (j >= 0) & chosen[j + 1] & ~tied
    return out[order]


def _passages(buf: np.ndarray, opens: np.ndarray, begin: np.ndarray, size: np.ndarray, own: np.ndarray, width: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owned places where a string of ``words`` words starts, the bytes of each (at most ``width``), and its context."""
    inner = buf >= _FIRST_LETTER
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    first[begin[~opens]] = False
    ws = np.flatnonzero(first)
    who = np.searchsorted(begin, ws, "right") - 1
    stop = np.flatnonzero(~inner)
    k = np.flatnonzero(ws - begin[who] < own[who])
    last = np.minimum(k + words - 1, len(ws) - 1)
    here = (k + words - 1 < len(ws)) & (who[last] == who[k])
    length = np.where(here, stop[np.minimum(np.searchsorted(stop, ws[last]), len(stop) - 1)] - ws[k], width + 1)
    rest = begin[who[k]] + size[who[k]] - ws[k]
    ok = here | (rest >= width)  # more than width bytes: its first ones stand for it
    return ws[k][ok], np.minimum(length, width)[ok], who[k][ok]


def _ranked(texts: list[bytes], stops: np.ndarray) -> np.ndarray:
    """All contexts, each with a 0 behind it, as ranks of bytes."""
    buf = _RANKED[np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)]
    buf[stops] = 0
    return buf


def _partners(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, own: np.ndarray, at: np.ndarray, fp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Contexts that can share a string with another one of their anchor.

    All strings of a context hold what lies between its last start and the
    nearest of their ``ends``; rounded to steps of ``GRID`` about the anchor, that
    must stand in the partner too.
    """
    h = Prefix(buf)
    anchor = begin + at
    left = np.maximum(at - (own - 1), 0) // GRID * GRID
    right = (ends - anchor) // GRID * GRID
    keep = np.zeros(len(begin), bool)
    for q in np.unique(left * (1 << 20) + np.maximum(right, 0)):
        x, y = int(q >> 20), int(q & ((1 << 20) - 1))
        some = np.flatnonzero((right >= 0) & (at >= x) & (size - at >= y))
        key = T.combine(fp[some].view(np.uint64), h.of(anchor[some] - x, anchor[some] + y))
        _, group, n = np.unique(key, return_inverse=True, return_counts=True)
        asks = np.zeros(len(n), bool)
        asks[group[(left[some] == x) & (right[some] == y)]] = True
        keep[some[((n > 1) & asks)[group]]] = True
    return keep


def _shard(width: int, words: int, ranges: int):
    """Spans of marked starts (kind BYTES or WORDS, a context's worth), and sorted hashes of the strings of split anchors (kind 0, by range)."""

    def run(t: pa.Table) -> pa.Table:
        T.vacate()
        texts = t.column("context").to_pylist()
        size = np.array([len(x) for x in texts])
        begin = np.cumsum(size + 1) - (size + 1)
        buf = _ranked(texts, begin + size)
        own, opens = t.column("own").to_numpy(), t.column("opens").to_numpy()
        at, length, c = _passages(buf, opens, begin, size, own, width, words)
        ends = np.where(size >= width, begin + width, begin - 1)
        ends[ends < begin] = np.iinfo(np.int64).max
        np.minimum.at(ends, c, at + length)
        none = ends == np.iinfo(np.int64).max
        ends[none] = begin[none] - 1
        keep = _partners(buf, begin, size, own, t.column("at").to_numpy(), t.column("fp").to_numpy(), ends) | (t.column("parts").to_numpy() > 1)
        t = t.filter(pa.array(keep))
        if not t.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip((x.split()[0] for x in MARKS.split(", ")), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})
        # owned starts are told by the context's length unless the text ends in it
        texts = [x for x, k in zip(texts, keep, strict=True) if k]
        size, own, opens = size[keep], own[keep], opens[keep]
        rows, lo, n, parts = (t.column(x).to_numpy() for x in ("row", "lo", "n", "parts"))
        begin = np.cumsum(size + 1) - (size + 1)
        buf = _ranked(texts, begin + size)
        word = _words(buf)
        who = np.repeat(np.arange(len(texts)), size + 1)
        rel = np.arange(len(buf)) - begin[who]
        is_own = rel < own[who]
        at, fp = t.column("at").to_numpy(), t.column("fp").to_numpy()
        order, rank, fresh = suffix_array(word, begin, size, own, at, fp, width)
        shared = common_prefixes(word, order, rank, fresh, begin, own, width)
        # bytes: a neighbour shares them all; contexts seen twice are marked already
        like = shared >= width
        hit = np.zeros(len(buf), bool)
        hit[order] = like | np.append(like[1:], False)
        hit &= (n == 1)[who] & (size[who] - rel >= width)
        out: list[tuple] = []

        def put(kind: int, a: np.ndarray, b: np.ndarray) -> None:
            c = who[a]
            out.append((np.full(len(a), kind), rows[c], lo[c] + rel[a], lo[c] + rel[b], [None] * len(a), [None] * len(a)))

        a, b = T.runs(hit, np.append(begin, len(buf)))
        put(BYTES, a, b - 1)
        # words: the same string starts a word in another text
        at, length, c = _passages(buf, opens, begin, size, own, width, words)
        if len(at):
            place = np.empty(len(buf), np.int64)
            place[order] = np.arange(len(order))
            by = np.argsort(place[at])
            at, length, c = at[by], length[by], c[by]
            same = np.zeros(len(at), bool)
            if len(at) > 1:
                spots = place[at]
                least = np.minimum.reduceat(shared[: spots[-1] + 1], spots[:-1] + 1)
                same[1:] = (least >= length[1:]) & (length[1:] == length[:-1])
            group = np.cumsum(~same) - 1
            own_row = np.where(n[c] > 1, -1 - c, rows[c])  # a context of several texts differs from any one
            cut = np.flatnonzero(~same)
            several = (np.minimum.reduceat(own_row, cut) != np.maximum.reduceat(own_row, cut))[group] & (n[c] == 1)
            # neighbouring words of a context are one span
            by = np.argsort(at)
            at, length, c, several = at[by], length[by], c[by], several[by]
            edge = np.concatenate([[True], (several[1:] != several[:-1]) | (c[1:] != c[:-1])])
            a = np.flatnonzero(edge)
            b = np.append(a[1:], len(at)) - 1
            put(WORDS, at[a[several[a]]], at[b[several[a]]])
        apart = parts[who] > 1
        if apart.any():
            h = Prefix(buf)
            s = np.flatnonzero(is_own & apart & (size[who] - rel >= width))
            w = np.flatnonzero(apart[at]) if len(at) else np.zeros(0, np.int64)
            keys = np.concatenate([h.of(s, s + width), T.mix(h.of(at[w], at[w] + length[w]) + np.uint64(WORDS))])
            place, kind = np.concatenate([s, at[w]]), np.repeat([BYTES, WORDS], [len(s), len(w)])
            by = np.argsort(keys)
            keys, place, kind = keys[by], place[by], kind[by]
            cut = np.searchsorted(keys >> np.uint64(32), (np.arange(ranges + 1) * 2**32 // ranges).astype(np.uint64))  # the list is cut by binary search
            cut[-1] = len(keys)
            for r in np.flatnonzero(np.diff(cut)):
                q = place[cut[r] : cut[r + 1]]
                ids = np.stack([rows[who[q]], lo[who[q]] + rel[q], n[who[q]], kind[cut[r] : cut[r + 1]]]).astype(np.int64)
                out.append(([0], [r], [0], [0], [keys[cut[r] : cut[r + 1]].tobytes()], [ids.tobytes()]))
        cols = [np.concatenate([x[k] for x in out]) for k in range(4)] + [sum((x[k] for x in out), []) for k in (4, 5)]
        T.release()
        return pa.table({"kind": pa.array(cols[0], pa.int32()), "row": pa.array(cols[1], pa.int64()), "lo": pa.array(cols[2], pa.int64()), "hi": pa.array(cols[3], pa.int64()), "keys": pa.array(cols[4], pa.binary()), "starts": pa.array(cols[5], pa.binary())})

    return run


def _merge(t: pa.Table) -> pa.Table:
    """Starts of one key range that have an equal in another place, found by binary search in the merged lists."""
    keys = np.frombuffer(b"".join(x.as_py() for x in t.column("keys")), np.uint64)
    row, lo, n, kind = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(4, -1) for x in t.column("starts")], axis=1)
    by = np.argsort(keys, kind="stable")  # the lists are sorted runs
    row, lo, n, kind = row[by], lo[by], n[by], kind[by]
    whole = keys[by]
    left, right = np.searchsorted(whole, whole, "left"), np.searchsorted(whole, whole, "right")
    mark = np.where(n > 1, -1 - np.arange(len(row)), row)
    begin = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, np.int64)
    nth = np.searchsorted(begin, np.arange(len(whole)), "right") - 1
    several = (np.minimum.reduceat(mark, begin) != np.maximum.reduceat(mark, begin))[nth] if len(whole) else np.zeros(0, bool)
    hit = (n == 1) & np.where(kind == BYTES, right - left > 1, several)
    return pa.table({"row": row[hit], "lo": lo[hit], "hi": lo[hit], "kind": pa.array(kind[hit], pa.int32())})


def _contexts(width: int):
    """The contexts of the wanted anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        names = [c.split()[0] for c in CONTEXTS.split(", ")]
        for batch in batches:
            e = batch.column(2)
            each = np.diff(e.offsets.to_numpy())
            if not each.sum():
                continue
            flat = e.flatten()
            fp, ctx, n, parts, lo, span = (flat.field(k) for k in range(6))
            text = np.repeat(np.arange(batch.num_rows), each)
            data = [x.as_py().encode("utf-8", "surrogatepass") for x in batch.column(1)]
            a, own = lo.to_numpy(), (span.to_numpy() & 0xFFFF) + 1
            opens = [x == 0 or data[k][x - 1] in _BLANK for k, x in zip(text.tolist(), a.tolist(), strict=True)]
            cut = [data[k][x : x + y + width - 1] for k, x, y in zip(text.tolist(), a.tolist(), own.tolist(), strict=True)]
            rows = batch.column(0).to_numpy()[text]
            yield pa.RecordBatch.from_arrays([fp, ctx, pa.array(rows), pa.array(a.astype(np.int64)), n, parts, pa.array(opens), pa.array(cut, pa.binary()), pa.array(own.astype(np.int64)), pa.array((span.to_numpy() >> 16).astype(np.int64))], names)
            T.release()

    return run


_BLANK = frozenset(_SPACES.tolist())


def repeats(docs: DataFrame, width: int = WIDTH, words: int = PASSAGE) -> DataFrame:
    """(row, lo, hi, kind): spans of starts of repeated strings; ``docs`` has row (a hash of the text) and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, buf, off in T.slices(batch.column(1), SLICE):
                fp, ctx, r, lo, span = anchors(buf, off, width, words)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(ctx), pa.array(ids[i:j][r].astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(span.astype(np.int32))], ["fp", "ctx", "row", "lo", "span"])
                T.release()

    T.small_batches(docs.sparkSession)
    found = save(docs.mapInArrow(cut, ANCHORS), "anchors")
    classes = found.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "lo", "span")).alias("one"), F.max("row").alias("most"))
    classes = classes.select("fp", "ctx", "n", "one", (F.col("one.row") != F.col("most")).alias("across"))
    seen = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("times"), F.bool_and("across").alias("settled"))
    again = save(classes.join(seen.where("times > 1"), "fp"), "classes")
    # repeats throughout; all of their places
    twice = save(found.join(again.where("n > 1").select("fp", "ctx", "kinds", "across"), ["fp", "ctx"]), "twice")
    discard(found)
    whole = twice.select("row", "lo", (F.col("lo") + F.col("span").bitwiseAND(0xFFFF)).alias("hi"), F.when(F.col("across"), F.lit(BYTES | WORDS)).otherwise(F.lit(BYTES)).alias("kind"))

    parts = F.ceil(F.col("kinds") / SPLIT).alias("parts")
    ones = again.where("kinds > 1 and not settled and (n = 1 or across)").select("fp", "ctx", F.least("n", F.lit(2)).cast("long").alias("n"), parts, "one.*")
    # places of a context that one text alone repeats: any of them may be in a passage that other texts have
    alone = twice.where("kinds > 1 and not across").groupBy("fp", "ctx", "row", "lo", "span").agg(F.first(parts).alias("parts")).select("fp", "ctx", F.lit(1).cast("long").alias("n"), "parts", "row", "lo", "span")
    edges = ones.unionByName(alone)
    wanted = edges.groupBy("row").agg(F.collect_list(F.struct("fp", "ctx", "n", "parts", "lo", "span")).alias("e"))
    # exact copies are cut once
    once = docs.groupBy("row").agg(F.first("text").alias("text"))
    held = save(once.join(wanted, "row").select("row", "text", "e").mapInArrow(_contexts(width), CONTEXTS), "contexts")
    discard(again)
    size = held.agg(F.sum(F.length("context")), F.sum(F.when(F.col("parts") > 1, F.col("own")))).first()
    shards, ranges = max(1, (size[0] or 0) // SHARD), max(1, (size[1] or 0) * 40 // MERGE)
    shard = F.pmod(F.xxhash64("fp", F.when(F.col("parts") > 1, F.pmod("ctx", "parts"))), F.lit(shards))
    marks = save(held.withColumn("shard", shard).drop("ctx").groupBy("shard").applyInArrow(_shard(width, words, ranges), MARKS), "marks")
    discard(held)
    across = marks.where("kind = 0").groupBy("row").applyInArrow(_merge, "row long, lo long, hi long, kind int")
    inner = marks.where("kind > 0").select("row", "lo", "hi", "kind")
    # a text that stands in several rows is a passage of all of them
    copies = docs.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size")).where("n > 1").select("row", F.lit(0).cast("long").alias("lo"), F.col("size").cast("long").alias("hi"), F.lit(BYTES | WORDS).alias("kind"))
    return whole.select("row", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "kind").unionByName(inner).unionByName(across).unionByName(copies)


def _joined(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans with those that overlap or touch made one."""
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[new], hi[np.append(new[1:], len(hi)) - 1]


def _passage_words(data: bytes, lo: np.ndarray, hi: np.ndarray, width: int, words: int) -> int:
    """Words in strings of ``words`` words (or ``width`` bytes) that start in the spans."""
    buf = np.frombuffer(data, np.uint8)
    starts, ends = T.runs(T.SPACED[buf], np.array([0, len(buf)]))
    k = np.flatnonzero((np.arange(len(starts)) + words <= len(starts)) | (starts + width <= len(data)))
    nth = np.searchsorted(lo, starts[k], "right") - 1
    k = k[(nth >= 0) & (starts[k] <= hi[nth])]
    until = np.minimum(np.minimum(k + words, len(starts)), np.searchsorted(ends, starts[k] + width, "right"))
    until = np.maximum(until, k + 1)
    mark = np.zeros(len(starts) + 1, np.int64)
    np.add.at(mark, k, 1)
    np.add.at(mark, until, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def remove(docs: DataFrame, width: int = WIDTH, words: int = PASSAGE) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.xxhash64(text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # written, so that the join below is of two plain shuffles: a text that stands in very many rows is then split over tasks
    spans = save(repeats(d.select("row", "text"), width, words).groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "kind")).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_words"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
        for batch in (b.slice(i, T.CHUNK_ROWS) for b in batches for i in range(0, b.num_rows, T.CHUNK_ROWS)):
            out: list[list] = [[] for _ in types]
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                removed = n_spans = passage = 0
                kept = data
                if own.is_valid and len(own):
                    s = own.values
                    lo, hi, kind = (s.field(k).to_numpy() for k in range(3))
                    strings = (kind & BYTES > 0) & (lo + width <= len(data))
                    if strings.any():
                        a, b = _joined(lo[strings], np.minimum(hi[strings] + width, len(data)))
                        removed, n_spans = int((b - a).sum()), len(a)
                        kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
                    if (kind & WORDS).any():
                        passage = _passage_words(data, *_joined(lo[kind & WORDS > 0], hi[kind & WORDS > 0]), width, words)
                for col, v in zip(out, (len(data), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept, passage), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names)
            T.release()

    whole = d.join(spans, "row", "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passage_words long")
