"""Alignment counts of whole texts: Arrow UDFs, as native folds take the square of a text's length.

Distances, alignments and subsequences use bit vectors in Python integers (64
cells to a word), overlaps count n-grams once.  A null side gives null.

The tie rule of an alignment: seen from the end of both texts, equal units are
matched; else a substitution goes before a deletion, and that before an
insertion.  Edits do not depend on it, their split does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the texts whose n-grams are counted at once.
TOGETHER = 1 << 16


def _places(a: Sequence) -> dict:
    """Bit set of the positions of each unit."""
    at: dict = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    out = {}
    for x, where in at.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in where:
            bits[i >> 3] |= 1 << (i & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _common(a: Sequence, b: Sequence) -> tuple[int, int]:
    """Lengths of the common start and of the common end of what follows it."""
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    n, end = 0, end - k
    while n < end and a[-1 - n] == b[-1 - n]:
        n += 1
    return k, n


def _step(eq: int, up: int, down: int, mask: int) -> tuple[int, int, int, int]:
    """One unit of the second text: vertical differences (one more, one less) after it, and the horizontal ones on the way."""
    flat = (((eq & up) + up) ^ up) | eq
    right, left = down | (flat | up) & mask ^ mask, up & flat
    r, n, steep = right << 1 | 1, left << 1, eq | down
    return n & mask | (steep | r) & mask ^ mask, r & steep & mask, right, left


def edits(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance by the bit vectors of Myers, in Hyyrö's form; in a band, which is widened until the distance fits."""
    k, n = _common(a, b)
    a, b = a[k : len(a) - n], b[k : len(b) - n]
    if not len(a) or not len(b):
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    places, more = _places(a), len(a) - len(b)
    slack = 8 + len(a) // 64
    while 3 * (more + 2 * slack) < 2 * len(a):
        if (found := _banded(places, len(a), b, slack)) <= more + 2 * slack:
            return found
        slack *= 3
    last = len(a) - 1
    mask = (1 << len(a)) - 1
    up, down, score = mask, 0, len(a)
    for y in b:
        up, down, right, left = _step(places.get(y, 0), up, down, mask)
        score += (right >> last & 1) - (left >> last & 1)
    return score


def _banded(places: dict, rows: int, b: Sequence, slack: int) -> int:
    """The distance if it is at most the difference of the lengths and twice ``slack``, else a number beyond that.

    Such an alignment keeps to diagonals from ``slack`` below the first to ``slack``
    above the last, so a column needs the bits of these only; they move on by one
    place a column.  The score is followed on the uppermost diagonal down to the
    last row, and along that row to its end, so ``slack`` is below the length of ``b``.
    """
    above = rows - len(b) + slack
    width = above + slack + 1
    mask, top = (1 << width) - 1, width - 1
    places = {x: bits << slack for x, bits in places.items()}
    up, down, score = ((1 << above + 1) - 1) << slack, 0, above
    for j, y in enumerate(b):
        eq = places.get(y, 0) >> j & mask
        flat = ((((eq & up) + up) ^ up) | eq | down) & mask
        right, left = down | (flat | up) ^ mask, flat & up
        beyond = j + above - rows
        if beyond < 0:
            score += 1 - (flat >> top)
        else:
            bit = top - 1 - beyond
            score += (right >> bit & 1) - (left >> bit & 1)
        flat >>= 1
        up, down = left | (flat | right) ^ mask, flat & right
    return score


def operations(ref: Sequence, hyp: Sequence) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of the alignment that the tie rule names.

    The differences are kept at every ``block``-th unit of ``hyp`` only, about
    the root of its length; the way back computes each block again, so the
    memory is that of a few hundred rows, not of the table.
    """
    # the way back begins with matches of equal ends; a common start is not cut, as ties may lie in it
    n, end = 0, min(len(ref), len(hyp))
    while n < end and ref[-1 - n] == hyp[-1 - n]:
        n += 1
    ref, hyp = ref[: len(ref) - n], hyp[: len(hyp) - n]
    if not len(ref) or not len(hyp):
        return 0, len(ref), len(hyp)
    places, mask, size = _places(ref), (1 << len(ref)) - 1, len(ref) // 8 + 1
    block = max(1, int(len(hyp) ** 0.5))
    kept, up, down = [], mask, 0
    for j, y in enumerate(hyp):
        if j % block == 0:
            kept.append((up, down))
        up, down, _, _ = _step(places.get(y, 0), up, down, mask)
    i, j = len(ref), len(hyp)
    sub = dele = ins = 0
    flat = bytes(size)
    for first in range((len(kept) - 1) * block, -1, -block):
        if not i:
            break
        up, down = kept[first // block]
        # rows[t]: vertical differences after first + t units, horizontal ones into it
        rows = [(up.to_bytes(size, "little"), down.to_bytes(size, "little"), flat, flat)]
        for y in islice(hyp, first, j):
            up, down, right, left = _step(places.get(y, 0), up, down, mask)
            rows.append(tuple(x.to_bytes(size, "little") for x in (up, down, right, left)))
        while i and j > first:
            if ref[i - 1] == hyp[j - 1]:
                i, j = i - 1, j - 1
                continue
            byte, bit = (i - 1) >> 3, 1 << (i - 1 & 7)
            before, now = rows[j - first - 1], rows[j - first]
            ahead = bool(now[2][byte] & bit) - bool(now[3][byte] & bit)
            above = bool(before[0][byte] & bit) - bool(before[1][byte] & bit)
            if ahead + above == 1:
                sub, i, j = sub + 1, i - 1, j - 1
            elif now[0][byte] & bit:
                dele, i = dele + 1, i - 1
            else:
                ins, j = ins + 1, j - 1
    return sub, dele + i, ins + j


def subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence."""
    places, mask = _places(a), (1 << len(a)) - 1
    v = mask
    for y in b:
        u = v & places.get(y, 0)
        v = (v + u | v - u) & mask
    return len(a) - v.bit_count()


def overlaps(a: Sequence, b: Sequence, most: int) -> list[int]:
    """For each n up to ``most``: common n-grams (as multisets), n-grams of a, n-grams of b."""
    out = []
    for n in range(1, most + 1):
        x, y = (Counter(s if n == 1 else zip(*(s[k:] for k in range(n)), strict=False)) for s in (a, b))
        common = sum(min(c, y[g]) for g, c in x.items() if g in y)
        out += [common, max(len(a) - n + 1, 0), max(len(b) - n + 1, 0)]
    return out


def character_overlaps(a: Sequence[str], b: Sequence[str], most: int) -> list[list[int]]:
    """``overlaps`` of many pairs of strings at once, by sorted numbers of a pair and its n characters."""
    codes, ids = np.unique(np.frombuffer("".join([*a, *b]).encode("utf-32-le"), np.uint32), return_inverse=True)
    bits = max(int(len(codes) - 1).bit_length(), 1)
    if bits * most + len(a).bit_length() > 63:  # too many characters for one number
        return [overlaps(x, y, most) for x, y in zip(a, b, strict=True)]
    sizes = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
    ids, split = ids.astype(np.int64), int(sizes[0].sum())
    sides, out = [], np.zeros((len(a), 3 * most), np.int64)
    for own, size in zip((ids[:split], ids[split:]), sizes, strict=True):
        sides.append((own, np.repeat(np.arange(len(size)), size), np.arange(len(own)), np.repeat(np.cumsum(size), size)))
    grams = [np.zeros(len(side[0]), np.int64) for side in sides]
    for n in range(1, most + 1):
        keys = []
        for k, (own, row, at, end) in enumerate(sides):
            before = grams[k][: max(len(own) - n + 1, 0)]
            grams[k] = before << bits | own[n - 1 :]
            whole = at[: len(before)] + n <= end[: len(before)]
            keys.append(np.sort((row[: len(before)] << n * bits | grams[k])[whole]))
            out[:, 3 * n - 2 + k] = np.maximum(sizes[k] - n + 1, 0)
        x, y = keys
        # the m-th of equal n-grams of one side is common if the other has m
        turn = np.arange(len(x)) - np.searchsorted(x, x, "left")
        common = turn < np.searchsorted(y, x, "right") - np.searchsorted(y, x, "left")
        out[:, 3 * n - 3] = np.bincount(x[common] >> n * bits, minlength=len(a))
    return out.tolist()


def _column(f, kind: str, a: Column, b: Column) -> Column:
    def each(r: pd.Series, h: pd.Series) -> pd.Series:
        found = [None if x is None or y is None else f(x, y) for x, y in zip(r, h, strict=True)]
        return pd.Series(found, dtype="Int64" if kind == "long" else object)

    return F.pandas_udf(each, kind)(a, b)


def edit_distance(a: Column, b: Column) -> Column:
    return _column(edits, "long", a, b)


def alignment(ref: Column, hyp: Column) -> Column:
    """array(substitutions, deletions, insertions)."""
    return _column(operations, "array<long>", ref, hyp)


def lcs(a: Column, b: Column) -> Column:
    return _column(subsequence, "long", a, b)


def ngram_counts(a: Column, b: Column, most: int) -> Column:
    return _column(lambda x, y: overlaps(x, y, most), "array<long>", a, b)


def character_counts(a: Column, b: Column, most: int) -> Column:
    """``ngram_counts`` of strings."""

    def each(r: pd.Series, h: pd.Series) -> pd.Series:
        found = pd.Series([None] * len(r), dtype=object)
        some = np.flatnonzero(r.notna() & h.notna())
        size = np.cumsum(r.iloc[some].str.len().to_numpy(np.int64))
        for part in np.split(some, np.flatnonzero(np.diff(size // TOGETHER)) + 1):
            for k, c in zip(part, character_overlaps(r.iloc[part].tolist(), h.iloc[part].tolist(), most), strict=True):
                found.iat[k] = c
        return found

    return F.pandas_udf(each, "array<long>")(a, b)
