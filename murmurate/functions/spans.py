"""Long texts cut into aligned units: reference spans, a character map, cuts at words."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a unit, at least.
SHORTEST = 24


def _han(c: str) -> bool:
    return "㐀" <= c <= "鿿"


def reference_spans(text: str, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Spans of the text without white space, parted where two Chinese characters touch; a last one that is too short goes to the one before."""
    joints, n = [], 0
    for k, c in enumerate(text):
        if c.isspace():
            continue
        if n and not text[k - 1].isspace() and _han(text[k - 1]) and _han(c):
            joints.append(n)
        n += 1
    cuts = [0]
    for b in [*joints, n]:
        if b - cuts[-1] >= shortest:
            cuts.append(b)
    if cuts[-1] < n:
        cuts = [*cuts[:-1], n] if len(cuts) > 1 else [0, n]
    return list(zip(cuts, cuts[1:], strict=False))


def character_map(ref: str, hyp: str) -> list[int]:
    """The place in ``hyp`` of each place in ``ref``; changed runs are shared out evenly."""
    out: list[int] = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, ref, hyp, autojunk=False).get_opcodes():
        out += range(c, d) if tag == "equal" else [c + (d - c) * k // (b - a) for k in range(b - a)]
    return [*out, len(hyp)]


def word_cut(text: str, target: int) -> int:
    """The space next to a place, the one before it if both are as near; the place itself in a text without."""
    if not 0 < target < len(text):
        return min(max(target, 0), len(text))
    spaces = [k for k in (text.rfind(" ", 0, target + 1), text.find(" ", target)) if k >= 0]
    return min(spaces, key=lambda k: abs(k - target)) if spaces else target


def source_cuts(text: str, spans: list[tuple[int, int]], total: int) -> list[int]:
    """Cuts of another language's text at the same shares, each no sooner than the one before it."""
    raw = [0, *(word_cut(text, round(len(text) * end / total)) for _, end in spans[:-1]), len(text)]
    return [max(a, b) for a, b in zip(raw, [raw[0], *raw[:-1]], strict=True)]


def aligned_units(source: str | None, reference: str | None, output: str | None, transcript: str | None, shortest: int = SHORTEST) -> list[dict]:
    """Units with the part of each text; none for a reference without characters."""
    ref, hyp = (re.sub(r"\s+", "", x or "") for x in (reference, output))
    if not ref:
        return []
    spans = reference_spans(reference or "", shortest)
    at = character_map(ref, hyp)
    said, heard = source or "", (transcript or "").strip()
    a, b = source_cuts(said, spans, len(ref)), source_cuts(heard, spans, len(ref))
    return [{"ref": ref[x:y], "hyp": hyp[at[x] : at[y]], "source": said[a[k] : a[k + 1]].strip(), "transcript": heard[b[k] : b[k + 1]].strip()} for k, (x, y) in enumerate(spans)]


def _all(source: pd.Series, reference: pd.Series, output: pd.Series, transcript: pd.Series) -> pd.Series:
    return pd.Series([aligned_units(*x) for x in zip(source, reference, output, transcript, strict=True)], dtype=object)


def units(source: Column, reference: Column, output: Column, transcript: Column) -> Column:
    """Array of aligned units, by an Arrow function (the character map is a sequential difference)."""
    return F.pandas_udf(_all, "array<struct<ref:string,hyp:string,source:string,transcript:string>>")(source, reference, output, transcript)
