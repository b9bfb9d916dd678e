"""Secret scanning in DataFrame functions only.

Base rules find assignments, access keys and hex runs.  The method adds strings
that look random: every maximal run of base-64 letters is a candidate; the
candidate's encoding is inferred from the characters that it uses; three tests
ask whether it could be a uniform draw from that encoding (chi-squared over the
alphabet, Wald-Wolfowitz runs about the middle of the alphabet, and lag-one
serial correlation); the smallest of the three p-values, corrected for three
tests, is the battery's p-value.  A run that meets a base span is cut there, and what is left of
it is tested.  Ordinary strings fail the battery: their
p-values crowd at 0, those of random strings have a known distribution.  So the
upper part of a class's p-values (by encoding and length) tells how many random
strings it has, and its cut is the lowest at which at most a share ``FDR`` of
the reported strings is ordinary (the false-discovery estimate of Storey 2002,
with ordinary strings as the false ones).  Only strings long enough for the
battery to have power (``MIN_BITS``) and mixed take part.  Mixed means a digit and a
letter, or two changes from lower to upper case.  So random strings of lower-case
letters only, of upper-case letters only or of digits only are never reported
by it, at any length, nor letters of both cases with fewer than two such
changes; digit runs of 16 or more are found by the hex rule.  There is no other
threshold: a class without random strings reports none, one of random strings
all.  The cut is found from a histogram of p-values of all candidates (bounded by
classes times bins), so no class is ever gathered in one task; bins are
``STEPS`` to a halving, so a p-value counts as at most 2 ** (1 / STEPS) of itself.

Spans are in code points, the end is exclusive.  Defined cases: a null text is
an empty one and has no spans; a null doc_id stays; repeated rows are reported
once each; equal starts are ordered by kind; very long texts are scanned whole,
at a cost that grows with the square of their matches, as spans are one array;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurate.llm.scratch import save

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the greedy run of 18 or more characters
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Characters of a candidate, and of a piece of one.
LEAST = 20
FDR = 0.05
#: P-values above it count the random strings of a class.
MIDDLE = 0.5
#: Strings above the middle with which a class speaks for itself.
FEW = 5
#: Least length times bits per character; below it the battery can't tell a word from a draw.
MIN_BITS = 100
#: Bins of p-values to each halving, and halvings; smaller p-values share the last bin.
STEPS, HALVINGS = 8, 64
#: Name, characters allowed, alphabet in order.
ENCODINGS = (
    ("digits", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[0-9A-Za-z+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def _matches(text: Column, pattern: str, keep) -> Column:
    """Spans (start, end, value) of the leftmost non-overlapping matches.

    The text between matches and the matches alternate, so running lengths give
    the positions; ``keep`` filters by the matched string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    walk = F.aggregate(
        F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.array_append(acc["spans"], F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("value"))).alias("spans"),
        ),
    )["spans"]
    return F.filter(F.when(F.size(found) == 0, F.array().cast("array<struct<start:int,end:int,value:string>>")).otherwise(walk), keep)


def _normal_tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal; a rational approximation of erfc, error below 1.2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x - 1.26551223 + poly * t)


def _bind(array: Column, **fields) -> Column:
    """Adds fields, each a function of the element, to an array of structs."""
    return F.transform(array, lambda e: _with(e, **{k: f(e) for k, f in fields.items()}))


def _with(e: Column, **fields: Column) -> Column:
    for k, v in fields.items():
        e = e.withField(k, v)
    return e


def bin_of(p: Column) -> Column:
    """Bin b holds p-values over 2 ** (-(b + 1) / STEPS) up to 2 ** (-b / STEPS), the last bin all below."""
    return F.floor(-STEPS * F.log2(F.least(F.lit(1.0), F.greatest(p, F.lit(2.0**-HALVINGS))))).cast("int")


def battery(cands: Column) -> Column:
    """Adds encoding, length class, p-value bin and power to an array of structs with a ``value``."""

    def pick(e: Column, column: int) -> Column:
        out = F.lit(None).cast("string")
        for enc in reversed(ENCODINGS):
            out = F.when(e["value"].rlike(enc[1]), F.lit(enc[column])).otherwise(out)
        return out

    a = _bind(cands, encoding=lambda e: pick(e, 0), alphabet=lambda e: pick(e, 2), body=lambda e: F.translate(F.regexp_replace(e["value"], "=+$", ""), "_-", "/+"))
    a = F.filter(a, lambda e: e["encoding"].isNotNull())
    a = _bind(
        a,
        n=lambda e: F.length(e["body"]).cast("double"),
        k=lambda e: F.length(e["alphabet"]).cast("double"),
        x=lambda e: F.transform(F.split(e["body"], ""), lambda ch: F.position(ch, e["alphabet"]).cast("double") - 1.0),
    )
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda s, v: s + f(v))
    ahead = lambda e: F.slice(e["x"], F.lit(2), F.size(e["x"]) - 1)
    behind = lambda e: F.slice(e["x"], F.lit(1), F.size(e["x"]) - 1)
    a = _bind(
        a,
        squares=lambda e: total(F.array_distinct(F.split(e["body"], "")), lambda ch: F.pow(e["n"] - F.length(F.replace(e["body"], ch, F.lit(""))), F.lit(2.0))),
        s1=lambda e: total(e["x"], lambda v: v),
        s2=lambda e: total(e["x"], lambda v: v * v),
        s11=lambda e: total(F.zip_with(behind(e), ahead(e), lambda u, v: u * v), lambda v: v),
        n1=lambda e: total(e["x"], lambda v: F.when(v >= e["k"] / 2, 1.0).otherwise(0.0)),
        runs=lambda e: 1.0 + total(F.zip_with(behind(e), ahead(e), lambda u, v: F.when((u >= e["k"] / 2) != (v >= e["k"] / 2), 1.0).otherwise(0.0)), lambda v: v),
    )

    def p_chi(e: Column) -> Column:  # Wilson-Hilferty; only too uneven counts speak against a draw
        df = e["k"] - 1.0
        chi2 = F.greatest(e["k"] / e["n"] * e["squares"] - e["n"], F.lit(1e-9))
        z = (F.pow(chi2 / df, F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        return F.when(z > 0, _normal_tail(z) / 2).otherwise(1.0 - _normal_tail(z) / 2)

    def p_runs(e: Column) -> Column:  # Wald-Wolfowitz about the middle of the alphabet
        n0 = e["n"] - e["n1"]
        mean = 1.0 + 2.0 * e["n1"] * n0 / e["n"]
        var = (mean - 1.0) * (mean - 2.0) / (e["n"] - 1.0)
        return F.when((e["n1"] < 1) | (n0 < 1) | (var <= 0), F.lit(0.0)).otherwise(_normal_tail((e["runs"] - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))

    def p_serial(e: Column) -> Column:
        spread = e["s2"] - e["s1"] * e["s1"] / e["n"]
        rho = (e["s11"] - e["s1"] * e["s1"] / e["n"]) / F.greatest(spread, F.lit(1e-9))
        return F.when(spread <= 0, F.lit(0.0)).otherwise(_normal_tail(rho * F.sqrt(e["n"])))

    mixed = lambda v: (v.rlike("[0-9]") & v.rlike("[A-Za-z]")) | v.rlike("[a-z][A-Z].*[a-z][A-Z]")
    return F.transform(
        a,
        lambda e: F.struct(
            e["start"].alias("start"),
            e["end"].alias("end"),
            F.concat_ws("/", e["encoding"], F.floor(F.log2(e["n"])).cast("string")).alias("class"),
            bin_of(3.0 * F.least(p_chi(e), p_runs(e), p_serial(e))).alias("bin"),
            (mixed(e["value"]) & (e["n"] * F.log2(e["k"]) >= MIN_BITS)).alias("power"),
        ),
    )


def pieces(candidate: Column, base: Column) -> Column:
    """What is left of a candidate beside the base spans, as spans of ``LEAST`` characters or more.

    The candidate is cut at the base spans that touch it, taken by their start; an
    untouched candidate is its own only piece.
    """
    touching = F.array_sort(F.filter(base, lambda b: (b["start"] < candidate["end"]) & (candidate["start"] < b["end"])))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    walk = F.aggregate(
        touching,
        F.struct(candidate["start"].alias("at"), empty.alias("out")),
        lambda acc, b: F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"),
            F.when(b["start"] > acc["at"], F.array_append(acc["out"], F.struct(acc["at"].alias("start"), b["start"].alias("end")))).otherwise(acc["out"]).alias("out"),
        ),
    )
    rest = F.concat(walk["out"], F.array(F.struct(walk["at"].alias("start"), candidate["end"].alias("end"))))
    value = lambda p: F.substring(candidate["value"], p["start"] - candidate["start"] + 1, p["end"] - p["start"])
    cut = F.transform(F.filter(rest, lambda p: p["end"] - p["start"] >= LEAST), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), value(p).alias("value")))
    return F.when(F.size(touching) == 0, F.array(candidate)).otherwise(cut)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base (spans of the base rules) and cands (tested strings, cut where they meet base spans)."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    tag = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    always = lambda s: F.lit(True)
    base = F.concat(
        tag(_matches(text, ASSIGN, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12), 0),
        tag(_matches(text, ACCESS, always), 1),
        tag(_matches(text, HEX, always), 2),
    )
    d = d.select("doc_id", "text", base.alias("base"), _matches(text, CANDIDATE, always).alias("cands"))
    free = F.flatten(F.transform("cands", lambda c: pieces(c, F.col("base"))))
    return d.select("doc_id", "text", "base", battery(free).alias("cands"))


def uniform_tail(p: Column) -> Column:
    """Share of random strings whose corrected smallest p-value is above ``p``."""
    return F.pow(1.0 - F.least(p, F.lit(1.0)) / 3.0, F.lit(3.0))


def cuts(found: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """The last reported bin of each class of encoding and length that reports any (at most encodings x 32 rows reach the driver).

    Strings with p-values above ``MIDDLE`` tell how many random ones a class has;
    what a cut lets in beyond the share of them that lies above it is ordinary.
    The cut is the lowest at which ordinary strings are no more than ``fdr`` of
    what is reported; the number of random ones is taken two standard errors up,
    which is little in a large class.  A class with fewer than ``FEW`` above the middle is given
    one more, so that a single string can be found, and no cut below ``fdr``.
    """
    hist = found.select(F.explode("cands").alias("c")).where("c.power").groupBy(F.col("c.class").alias("class"), F.col("c.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    middle = int(-STEPS * math.log2(MIDDLE)) - 1
    by_class = Window.partitionBy("class")
    top = F.coalesce(F.sum(F.when(F.col("bin") <= middle, F.col("n"))).over(by_class), F.lit(0))
    few = top < FEW
    cum = hist.select("*", F.sum("n").over(by_class.orderBy("bin")).alias("above"), ((top + F.greatest(few.cast("double"), 2 * F.sqrt(top.cast("double")))) / uniform_tail(F.lit(MIDDLE))).alias("random"), few.alias("few"))
    allowed = ~F.col("few") | (F.col("bin") < int(-STEPS * math.log2(fdr)))
    ordinary = F.col("above") - F.col("random") * uniform_tail(F.pow(F.lit(2.0), -(F.col("bin") + 1) / STEPS))
    rows = cum.where(allowed & (ordinary <= fdr * F.col("above"))).groupBy("class").agg(F.max("bin").alias("cut")).collect()
    return {r["class"]: r["cut"] for r in rows}


def scan(docs: DataFrame, fdr: float = FDR, with_text: bool = True) -> DataFrame:
    """doc_id, text (if asked for) and spans (sorted array of start, kind number, end) of every document.

    Spans and tested strings are written once, as the cut needs them before any
    can be reported; so the rules and the battery run once over every text.
    """
    found = find(docs)
    found = save(found if with_text else found.drop("text"), "candidates")
    by_class = cuts(found, fdr)
    cut = F.create_map(*[F.lit(x) for pair in sorted(by_class.items()) for x in pair]) if by_class else F.create_map().cast("map<string,int>")
    keep = lambda c: c["power"] & (c["bin"] <= F.coalesce(F.try_element_at(cut, c["class"]), F.lit(-1)))
    random = F.transform(F.filter("cands", keep), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", *["text"] * with_text, F.array_sort(F.concat("base", random)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digests(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """The contract's columns."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scan(docs, fdr, with_text=False).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, fdr: float = FDR, mask: str = "[SECRET]") -> DataFrame:
    """doc_id, text and n_spans with every span replaced by ``mask``; overlapping spans are one."""
    walk = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))).otherwise(acc["out"]).alias("out"),
        ),
    )
    d = scan(docs, fdr).select("doc_id", "text", "spans", walk.alias("w"))
    text = F.concat(F.concat_ws("", "w.out"), F.substring("text", F.col("w.at") + 1, F.length("text")))
    return d.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(text).alias("text"), F.size("spans").alias("n_spans"))
