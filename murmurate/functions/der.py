"""Diarization error, difference blocks and seeded bootstrap: Arrow UDFs."""

from __future__ import annotations

import difflib
import random

import numpy as np
import pandas as pd


def best_total(gain: np.ndarray) -> float:
    """The largest sum of a one-to-one map of rows to columns, by shortest augmenting paths with prices."""
    cost = -(gain if gain.shape[0] <= gain.shape[1] else gain.T)
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    row_of, col_of = np.full(cols, -1), np.full(rows, -1)
    for start in range(rows):
        far = cost[start] - row_price[start] - col_price
        came, seen = np.full(cols, start), np.zeros(cols, bool)
        while True:
            j = int(np.where(seen, np.inf, far).argmin())
            seen[j] = True
            if row_of[j] < 0:
                break
            i = row_of[j]
            way = far[j] + cost[i] - row_price[i] - col_price
            better = ~seen & (way < far)
            far[better], came[better] = way[better], i
        passed = seen & (row_of >= 0)
        row_price[row_of[passed]] += far[j] - far[passed]
        col_price[passed] -= far[j] - far[passed]
        row_price[start] += far[j]
        while True:  # turn the path round
            i = came[j]
            row_of[j] = i
            col_of[i], j = j, col_of[i]
            if i == start:
                break
    return float(-cost[np.arange(rows), col_of].sum())


def diarization_error(ref: list[tuple[float, float, str]], hyp: list[tuple[float, float, str]]) -> float | None:
    """(false alarm + miss + confusion) / reference time under the best one-to-one speaker map.

    One sweep over the ends of all turns; a speaker who overlaps himself speaks
    once, and turns that do not end after they begin are silent.
    """
    total = sum(e - s for s, e, _ in ref)
    if total <= 0:
        return None
    names = [{k: i for i, k in enumerate(sorted({k for *_, k in side}))} for side in (ref, hyp)]
    ends = sorted((t, side, names[side][k], step) for side, turns in enumerate((ref, hyp)) for s, e, k in turns if s < e for t, step in ((s, 1), (e, -1)))
    joint = np.zeros((len(names[0]), len(names[1])))
    open_: tuple[dict, dict] = ({}, {})
    wrong, before = 0.0, 0.0
    for t, side, who, step in ends:
        if t > before and (open_[0] or open_[1]):
            wrong += max(len(open_[0]), len(open_[1])) * (t - before)
            for a in open_[0]:
                for b in open_[1]:
                    joint[a, b] += t - before
        before = t
        n = open_[side].get(who, 0) + step
        if n:
            open_[side][who] = n
        else:
            del open_[side][who]
    return (wrong - (best_total(joint) if joint.size else 0.0)) / total


class Matcher(difflib.SequenceMatcher):
    """Finds the same blocks of two strings as its base without junk, by hashed slices; the base takes the square of a text's length."""

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        a, b = self.a[alo:ahi], self.b[blo:bhi]

        def first(n: int) -> tuple[int, int] | None:
            seen = {hash(b[j : j + n]) for j in range(len(b) - n + 1)}
            for i in range(len(a) - n + 1):
                if hash(a[i : i + n]) in seen and (j := b.find(a[i : i + n])) >= 0:
                    return i, j
            return None

        # blocks of ``size`` exist, the earliest is ``at``; none has ``none``
        size, at, none, known = 0, (0, 0), min(len(a), len(b)) + 1, False
        while none - size > 1:
            n = (size + none) // 2 if known else min(max(2 * size, 1), none - 1)
            if found := first(n):
                i, j = at = found
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                size = n
            else:
                none, known = n, True
        return difflib.Match(alo + at[0], blo + at[1], size)


def changed(ref: str, hyp: str, blocks: list[tuple[int, int, int]], gap: int = 1, large: int = 8) -> list[tuple[int, int, int, int, bool]]:
    """Changed stretches of two texts, from their blocks; stretches at most ``gap`` apart are one, ``large`` flags long ones."""
    out: list[list[int]] = []
    a = c = 0
    for i, j, n in [*blocks, (len(ref), len(hyp), 0)]:
        if a < i or c < j:
            if out and a - out[-1][1] <= gap:
                out[-1][1], out[-1][3] = i, j
            else:
                out.append([a, i, c, j])
        a, c = i + n, j + n
    return [(a, b, c, d, max(b - a, d - c) >= large) for a, b, c, d in out]


def diff_blocks(ref: str, hyp: str, gap: int = 1, large: int = 8) -> list[tuple[int, int, int, int, bool]]:
    """The changed stretches of one pair; ``blocks.matching`` finds the blocks of many at once."""
    return changed(ref, hyp, Matcher(None, ref, hyp, autojunk=False).get_matching_blocks(), gap, large)


def bootstrap_ci(num: list[float], den: list[float], rounds: int = 1000, seed: int = 42) -> tuple[float, float] | None:
    """95 % interval of sum(num) / sum(den) over resampled rows; null below two rows."""
    n = len(num)
    if n < 2:
        return None
    # the numbers of random.Random(seed).choices, drawn by numpy
    *words, at = random.Random(seed).getstate()[1]
    rng = np.random.RandomState()
    rng.set_state(("MT19937", words, at))
    top, bottom = np.asarray(num, float), np.asarray(den, float)
    stats = []
    for _ in range(rounds):
        pick = (rng.random_sample(n) * n).astype(np.int64)
        d = bottom[pick].sum()
        stats.append(float(top[pick].sum() / d) if d else 0.0)
    stats.sort()
    return stats[int(rounds * 0.025)], stats[int(rounds * 0.975)]


def bootstrap_groups(df, key: str, order: str, num: str, den: str, rounds: int = 1000, seed: int = 42):
    """(key, lo, hi) for each group; only the two numbers of a row travel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        ci = bootstrap_ci(pdf[num].tolist(), pdf[den].tolist(), rounds, seed)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "lo": [ci[0] if ci else None], "hi": [ci[1] if ci else None]})

    kind = dict(df.dtypes)[key]
    return df.select(key, order, num, den).groupBy(key).applyInPandas(run, f"{key} {kind}, lo double, hi double")
