"""BLEU as the common tool has it: two tokenisers, clipped counts, exponential smoothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[㐀-䶿一-鿿豈-﫿　-〿＀-￯]"


def _cut_marks(text: Column) -> Column:
    """Marks apart from words; full stops and commas stay within numbers."""
    t = F.regexp_replace(text, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


def words(text: Column) -> Column:
    """Tokens of a text with spaces between words."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for name, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return _cut_marks(F.concat(F.lit(" "), t, F.lit(" ")))


def characters(text: Column) -> Column:
    """Each Chinese character is a token, the rest as in words."""
    return _cut_marks(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), f"({HAN})", " $1 "))


def by_character(sample: Column) -> Column:
    """Whether more than three in ten of a reference's characters are Chinese (of at most 2,000, as the rule has it)."""
    head = F.substring(F.coalesce(sample, F.lit("")), 1, 2000)
    return F.regexp_count(head, F.lit("[一-鿿]")) / F.greatest(F.length(head), F.lit(1)) > 0.3


def score(hits: list[Column], totals: list[Column], ref_len: Column, hyp_len: Column) -> Column:
    """BLEU in per cent from clipped and total counts of each order: an order without a hit counts as half, a quarter, .. of one; an order without n-grams gives 0."""
    logs, misses = F.lit(0.0), F.lit(0)
    for hit, total in zip(hits, totals, strict=True):
        misses = misses + F.when(hit == 0, 1).otherwise(0)
        logs = logs + F.log(F.when(hit > 0, hit / total).otherwise(1.0 / (F.pow(F.lit(2.0), misses) * total)))
    brevity = F.when(hyp_len < ref_len, F.exp(1 - ref_len / hyp_len)).otherwise(1.0)
    return F.when(F.least(*totals) > 0, 100 * brevity * F.exp(logs / len(hits))).otherwise(0.0)
