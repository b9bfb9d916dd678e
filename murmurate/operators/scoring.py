"""Column rules of a score run: literals, anomalies, languages, texts.

All are expressions.  A null input gives a null output, or what the function's
own text says; an empty text has no literals, units or flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and codes of languages.
LANGUAGE_CODES = {
    "英文": "en", "english": "en", "中文": "zh", "简体中文": "zh", "simplified chinese": "zh", "chinese": "zh", "粤语": "yue", "cantonese": "yue",
    "日文": "ja", "japanese": "ja", "韩文": "ko", "korean": "ko", "西班牙文": "es", "spanish": "es", "法文": "fr", "french": "fr",
    "德文": "de", "german": "de", "俄文": "ru", "russian": "ru", "arabic": "ar", "dutch": "nl", "indonesian": "id", "italian": "it",
    "malay": "ms", "portuguese": "pt", "thai": "th", "turkish": "tr", "urdu": "ur", "vietnamese": "vi",
}
NUMBER = r"(?<![\d.])[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?![\d.])"
DATE = r"(?<!\d)(\d{4})(?:年|[-/.])(\d{1,2})(?:月|[-/.])(\d{1,2})(?:日)?(?!\d)"
REASON_KEYS = ("segment_reason", "cut_reason", "vad_reason", "reason")


def task(kind: Column) -> Column:
    """Minutes are summaries, formulas are read as speech, a missing task is speech."""
    return F.when(kind == "minutes", "summarize").when((kind == "formula") | kind.isNull(), "asr").otherwise(kind)


def output(edited: Column, raw: Column) -> Column:
    """The edited text if there is one, else the raw one."""
    return F.coalesce(F.nullif(edited, F.lit("")), raw)


def variant(edited: Column) -> Column:
    return F.when(F.coalesce(edited, F.lit("")) != "", "edited").otherwise("raw")


def serial(workers: Column, has_meta: Column, concurrent: Column) -> Column:
    """New logs say the workers of each record; old ones, without a session row, are taken at the caller's word."""
    return F.when(has_meta, F.coalesce(workers == 1, F.lit(False))).otherwise(~concurrent)


def reason(segment: dict[str, Column]) -> Column:
    """The first of the reason keys that is not empty."""
    return F.coalesce(*[F.nullif(segment[k].cast("string"), F.lit("")) for k in REASON_KEYS if k in segment])


def numbers(text: Column) -> Column:
    """Arabic numerals in plain notation: no group commas, no zeros before or after; a percent sign stays."""

    def plain(raw: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(raw, "[%,]", ""), r"^\+", "")
        value = F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        value = F.regexp_replace(value, r"^(-?)0+(?=\d)", "$1")
        return F.concat(value, F.when(F.endswith(raw, F.lit("%")), "%").otherwise(""))

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), plain)


def dates(text: Column) -> Column:
    """Explicit dates as yyyy-mm-dd; months and days out of range are none."""
    t = F.coalesce(text, F.lit(""))
    part = lambda k: F.regexp_extract_all(t, F.lit(DATE), F.lit(k))
    parts = F.arrays_zip(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))
    number = lambda x: x.cast("int")
    good = F.filter(parts, lambda p: number(p["m"]).between(1, 12) & number(p["d"]).between(1, 31))
    return F.transform(good, lambda p: F.concat(p["y"], F.lit("-"), F.lpad(p["m"], 2, "0"), F.lit("-"), F.lpad(p["d"], 2, "0")))


def literal_hits(pairs: DataFrame, by: str, ref: Column, hyp: Column) -> DataFrame:
    """``by``, hit, ref_total and hyp_total: multiset intersection of two arrays, row by row.

    One row for each value of a document and side, summed before the shuffle.
    """
    each = F.concat(F.transform(ref, lambda v: F.struct(v.alias("v"), F.lit(1).alias("r"), F.lit(0).alias("h"))), F.transform(hyp, lambda v: F.struct(v.alias("v"), F.lit(0).alias("r"), F.lit(1).alias("h"))))
    counts = pairs.select("doc_id", by, F.inline_outer(each)).groupBy("doc_id", by, "v").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    return counts.groupBy(by).agg(F.sum(F.least("r", "h")).alias("hit"), F.sum("r").alias("ref_total"), F.sum("h").alias("hyp_total"))


def anomalies(s: dict[str, Column], hard_max: float) -> Column:
    """Names of what is wrong with a segment, in the order of the rules.

    ``s`` has start_s, end_s, text, previous (the last normalised text before it
    that is not empty), queue_ms, e2e_ms and serial.
    """
    dur = F.round(s["end_s"] - s["start_s"], 3)
    compact = F.regexp_replace(F.coalesce(s["text"], F.lit("")), r"\s+", "")
    norm = normal(s["text"])
    return F.array_compact(
        F.array(
            F.when(dur < 0, "invalid_segment_timestamps"),
            F.when((dur >= 0) & (dur < 2) & (F.length(compact) <= 12), "short_phrase_island"),
            F.when(dur > hard_max + 0.5, "hard_max_exceeded"),
            F.when((norm != "") & (norm == s["previous"]), "adjacent_duplicate_translation"),
            F.when(s["serial"] & (s["queue_ms"] > 1000), "queue_spike"),
            F.when(s["serial"] & (s["e2e_ms"] > 5000), "e2e_spike"),
        )
    )


def normal(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def language_code(name: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, raw), raw)


def short_code(name: Column) -> Column:
    """The code of a language, or the part after the last hyphen."""
    raw = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    few = {k: v for k, v in LANGUAGE_CODES.items() if k in ("中文", "简体中文", "chinese", "英文", "english", "日文", "japanese", "韩文", "korean", "德文", "german", "italian")} | {"意大利文": "it"}
    known = F.create_map(*[F.lit(x) for pair in few.items() for x in pair])
    return F.coalesce(F.try_element_at(known, raw), F.element_at(F.split(raw, "-"), -1))


def target_norm(lang: Column) -> Column:
    """struct(norm, by_word) of a translation's target language."""
    code = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    pick = lambda a, b: F.struct(F.lit(a).alias("norm"), F.lit(b).alias("by_word"))
    english = code.isin("en", "english", "英文") | F.contains(code, F.lit("english"))
    chinese = code.isin("zh", "zho", "chinese", "中文", "简体中文") | F.contains(code, F.lit("chinese"))
    return F.when(english, pick("en", True)).when(chinese, pick("zh", False)).otherwise(pick("basic", True))


def lexical_units(text: Column) -> Column:
    """Chinese characters, English words and numbers."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[㐀-䶿一-鿿]")) + F.regexp_count(t, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?")) + F.regexp_count(t, F.lit(r"\d+(?:[.,]\d+)?"))


def text_weight(text: Column) -> Column:
    """Words and Chinese characters, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+|[㐀-鿿]")))


def text_units(text: Column) -> Column:
    """Sentences: cut at line ends, after sentence marks, and after a full stop before a capital."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\n+|(?<=[。！？!?])|(?<=\.)(?=\s+[A-Z])")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def balanced_groups(units: Column, count: Column) -> Column:
    """Sentences as ``count`` groups of about equal weight, in order; empty ones at the end if sentences are few.

    A group ends before the sentence that would take it over the mean weight of
    what is left, as long as groups are left.
    """
    weights = F.aggregate(units, F.lit(0), lambda a, u: a + text_weight(u))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("w"), weights.alias("left"))

    def step(s: Column, u: Column) -> Column:
        slots = F.greatest(F.lit(1), count - F.size(s["done"]))
        close = (s["w"] > 0) & (s["w"] + text_weight(u) > s["left"] / slots) & (F.size(s["done"]) < count - 1)
        return F.struct(
            F.when(close, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"),
            F.when(close | (s["w"] == 0), u).otherwise(F.concat(s["now"], F.lit(" "), u)).alias("now"),
            F.when(close, text_weight(u)).otherwise(s["w"] + text_weight(u)).alias("w"),
            F.when(close, s["left"] - s["w"]).otherwise(s["left"]).alias("left"),
        )

    end = F.aggregate(units, start, step)
    groups = F.array_append(end["done"], end["now"])
    return F.concat(groups, F.array_repeat(F.lit(""), F.greatest(count - F.size(groups), F.lit(0))))


def reply_body(text: Column, marker: str = "<asr_text>") -> Column:
    """The last part that is not empty after the marker, without lines of the chat template; a text without it stays."""
    frames = F.filter(F.transform(F.split(text, marker), lambda f: F.trim(f)), lambda f: f != "")
    last = F.coalesce(F.try_element_at(frames, F.lit(-1)), F.lit(""))
    body = F.trim(F.regexp_replace(last, r"(?im)^\s*(?:system|user|assistant|language(?:\s+[A-Za-z-]+)*)\s*$", ""), F.lit(" \n\t\r"))
    return F.when(F.contains(text, F.lit(marker)) & (body != ""), body).otherwise(text)


def preview(confirmed: Column, draft: Column, replaces: Column) -> Column:
    """Confirmed text and draft, with a space between them unless a Chinese character stands at the seam."""
    c, d = F.trim(F.coalesce(confirmed, F.lit(""))), F.trim(F.coalesce(draft, F.lit("")))
    seam = F.concat(F.right(c, F.lit(1)), F.left(d, F.lit(1))).rlike(r"[㐀-鿿]")
    return F.when(F.coalesce(replaces, F.lit(False)) & (d != ""), d).when((c == "") | (d == ""), F.concat(c, d)).otherwise(F.concat(c, F.when(seam, "").otherwise(" "), d))


def portable_path(path: Column) -> Column:
    """What follows ``/datasets/``, or the last three parts of an absolute path."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), "/")
    at = F.locate("/datasets/", p)
    return F.when(at > 0, F.concat(F.lit("datasets/"), F.substring(p, at + 10, F.length(p)))).when(F.startswith(p, F.lit("/")), tail).otherwise(p)


def speaker(named: Column, path: Column) -> Column:
    """The speaker, or the folder that holds the file of a path of three parts or more."""
    parts = F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(F.nullif(named.cast("string"), F.lit("")), F.when(F.size(parts) >= 3, F.element_at(parts, -2)).otherwise(""))


def language_tag(hint: Column) -> Column:
    """Part of a file's name that tells a language hint: 12 letters or digits and a digest."""
    s = F.trim(F.coalesce(hint, F.lit("")))
    keep = F.substring(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""), 1, 12)
    return F.when(s == "", "").otherwise(F.concat(F.lit("__lang-"), F.coalesce(F.nullif(keep, F.lit("")), F.lit("hint")), F.lit("-"), F.substring(F.sha1(s.cast("binary")), 1, 6)))


def lid_label(ok: Column, label: Column, language: Column, dialect: Column) -> Column:
    named = F.concat_ws(" ", F.nullif(language, F.lit("")), F.nullif(dialect, F.lit("")))
    return F.when(~F.coalesce(ok, F.lit(False)), "__failed__").otherwise(F.coalesce(F.nullif(label, F.lit("")), F.nullif(named, F.lit("")), F.lit("(unknown)")))


# Secrets in settings and logs, and what stands for them, in this order.
REDACTIONS = (
    (r"(?i)((?:bearer|basic)\s+)([A-Za-z0-9+/._\-]{4,}={0,2})", "$1***"),
    (r"(?i)((?:x-)?api[_-]?key|api[_-]?secret|access[_-]?token|authorization|token|secret|password|passwd|pwd|app[_-]?id|app[_-]?key)([\s:=\"']+)([A-Za-z0-9+/._\-]{6,})", "$1$2***"),
    (r"(://[^/@\s:]+:)([^@\s/]+)(@)", "$1***$3"),
    (r"\bsk-[A-Za-z0-9]{12,}", "sk-***"),
)


def redacted(text: Column) -> Column:
    for pattern, put in REDACTIONS:
        text = F.regexp_replace(text, pattern, put)
    return text


def triage(m: dict[str, Column]) -> Column:
    """struct(decision, flags) of measured audio: peak and rms amplitude, shares of clipped and zero samples, durations, label."""
    units = lexical_units(m["text"])
    rate = F.when(m["actual_s"] > 0, units / m["actual_s"]).otherwise(0.0)
    hard = F.array_compact(
        F.array(
            F.when(F.abs(m["actual_s"] - F.coalesce(m["expected_s"], F.lit(0.0))) > F.greatest(F.lit(0.1), m["actual_s"] * 0.05), "duration_mismatch"),
            F.when(units == 0, "no_lexical_label"),
            F.when(m["rms"] < 10 ** (-55 / 20), "near_silent"),
        )
    )
    review = F.array_compact(
        F.array(
            F.when(m["actual_s"] < 0.2, "ultra_short_under_0.2s").when(m["actual_s"] < 0.5, "very_short_under_0.5s"),
            F.when(F.coalesce(m["text"], F.lit("")).rlike(r"<[^>]+>|\[[^\]]+\]"), "label_markup"),
            F.when((m["rms"] >= 10 ** (-55 / 20)) & (m["rms"] < 10 ** (-42 / 20)), "low_volume"),
            F.when(m["clip"] > 0.01, "heavy_clipping"),
            F.when(m["zero"] > 0.25, "many_zero_samples"),
            F.when((units > 0) & (rate < 0.35), "label_rate_too_low"),
            F.when(rate > F.when(m["lang"] == "en", 8.0).otherwise(12.0), "label_rate_too_high"),
            F.when(m["sample_rate"] < 8000, "low_sample_rate"),
        )
    )
    decision = F.when(F.size(hard) > 0, "reject").when(F.size(review) > 0, "review").otherwise("keep")
    return F.struct(decision.alias("decision"), F.concat(hard, review).alias("flags"))


def decibels(amplitude: Column) -> Column:
    return 20 * F.log10(F.greatest(amplitude, F.lit(1e-12)))


def review_complete(data_decision: Column, scope: Column, issues: Column, decisions: Column) -> Column:
    """A reviewed sample: its data are judged, and its scope, or every issue of the score (``decisions`` maps issue to decision)."""
    judged = lambda d: F.coalesce(d, F.lit("unreviewed")) != "unreviewed"
    return judged(data_decision) & (judged(scope) | F.forall(F.coalesce(issues, F.array().cast("array<string>")), lambda i: judged(F.try_element_at(decisions, i))))
