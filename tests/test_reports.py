"""Report statistics, the screening report and report pages, against plain Python."""

import collections
import hashlib
import json
import math
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from murmurate.functions import textnorm
from murmurate.operators import curation, reports
from murmurate.sources import audio, report_pages

FIELDS = "key long, lang string, code string, cer double, zh_cer double, gold double, asr double, comment string"


def scored(spark):
    rows = []
    for k in range(240):
        lang = ["Deutsch", "Italiano", "日本語", "中文"][k % 4]
        gold = None if k % 11 == 0 else ((k * 37) % 100 + 10 * (k % 4)) / 200
        rows.append((k, lang, {"Deutsch": "de", "Italiano": "it", "日本語": "ja", "中文": "zh"}[lang], float(k % 13), float(k % 7 + 3 * (k % 4)), gold, None if k % 5 == 0 else 0.5, None if k % 3 else "x service_unavailable y"))
    return rows, spark.createDataFrame(rows, FIELDS)


def test_language_stats_and_ranks(spark):
    rows, df = scored(spark)
    got = {r["lang"]: r for r in reports.ranked_languages(reports.language_stats(df, "key", "service_unavailable", rounds=400)).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        if r[5] is not None:
            by[r[1]].append(r)
    for lang, group in by.items():
        r = got[lang]
        gold = [x[5] for x in group]
        assert r["n"] == len(group) and r["gold"] == pytest.approx(statistics.mean(gold)) and r["failed"] == sum("service_unavailable" in (x[7] or "") for x in group)
        assert r["asr"] == pytest.approx(statistics.mean(x[6] for x in group if x[6] is not None))
        # the interval of a mean is about two standard errors wide on each side
        error = statistics.pstdev(gold) / math.sqrt(len(gold))
        assert r["lo"] < r["gold"] < r["hi"] and 3 * error < r["hi"] - r["lo"] < 5 * error
    ranks = sorted((x for x in got if x != "中文"), key=lambda x: got[x]["zh_cer"])
    assert [got[x]["rank_cer"] for x in ranks] == [1, 2, 3] and got["中文"]["rank_cer"] is None and got["中文"]["shift"] is None
    best = sorted(ranks, key=lambda x: -got[x]["gold"])
    assert [got[x]["rank_gold"] for x in best] == [1, 2, 3]


def test_agreement_and_ties(spark):
    df = spark.createDataFrame([("a", "a", 1.0, 0.9), ("b", "b", 2.0, 0.5), ("c", "c", 2.0, 0.7), ("d", "d", 3.0, 0.1)], "lang string, code string, zh_cer double, gold double")
    ranked = reports.ranked_languages(df)
    assert [(r["rank_cer"], r["rank_gold"]) for r in ranked.orderBy("lang").collect()] == [(1, 1), (2.5, 3), (2.5, 2), (4, 4)]
    r = reports.agreement(ranked).first()
    assert r["languages"] == 4 and r["max_shift"] == 0.5 and r["rho"] == pytest.approx(statistics.correlation([1, 2.5, 2.5, 4], [1, 3, 2, 4]))
    assert tuple(reports.agreement(ranked.limit(0)).first()) == (0, None, 0.0)


def test_cards(spark):
    rows, df = scored(spark)
    c = reports.cards(df, "service_unavailable").first()
    kept = [r for r in rows if r[5] is not None]
    clean = [r for r in kept if "service_unavailable" not in (r[7] or "")]
    assert c["rows"] == len(rows) and c["failed"] == len(kept) - len(clean)
    assert c["clean_gold"] == pytest.approx(statistics.mean(r[5] for r in clean)) and c["clean_cer"] == pytest.approx(statistics.mean(r[3] for r in clean)) and c["gold"] == pytest.approx(statistics.mean(r[5] for r in kept))
    assert reports.cards(df.limit(0), "x").first()["gold"] is None


def test_segment_averages_and_severities(spark):
    items = [("x", "r1", 0.5, 10), ("x", "r1", 0.7, 30), ("x", "r2", 0.1, 5), ("y", "r1", 0.9, 0), ("y", "r3", 0.3, 0)]
    got = {r["dataset"]: r for r in reports.segment_averages(spark.createDataFrame(items, "dataset string, recording string, score double, chars long")).collect()}
    assert got["x"]["recording_macro"] == pytest.approx((0.6 + 0.1) / 2) and got["x"]["char_weighted"] == pytest.approx((5 + 21 + 0.5) / 45) and got["x"]["segment_micro"] == pytest.approx(1.3 / 3)
    assert got["y"]["char_weighted"] is None and (got["y"]["n_segments"], got["y"]["n_recordings"]) == (2, 2)
    assert {round(r["dataset_macro"], 9) for r in got.values()} == {round((0.35 + 0.6) / 2, 9)} and {round(r["all_recordings"], 9) for r in got.values()} == {round((0.6 + 0.1 + 0.9 + 0.3) / 4, 9)}
    spans = spark.createDataFrame([([("major",), (None,)],), ([("major",)],), ([],), (None,)], "spans array<struct<severity:string>>")
    assert {tuple(r) for r in reports.severity_counts(spans).collect()} == {("major", 2), ("unknown", 1)}


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, (True, [])),
        ({"ok": False}, (False, ["failed"])),
        ({"hyp": "  \n"}, (False, ["empty"])),
        ({"hyp": "hello 你好 world"}, (False, ["not_chinese"])),
        ({"hyp": "你好", "chinese": False}, (False, ["not_latin"])),
        ({"al": None}, (False, ["no_lag"])),
        ({"al": -0.5}, (False, ["negative_lag"])),
        ({"al": 26.5}, (False, ["large_lag"])),
        ({"al": 26.5, "src": None}, (True, [])),
        ({"tokens": True}, (True, ["from_tokens"])),
        ({"wants": True}, (False, ["no_speech"])),
        ({"err": 0.61}, (False, ["poor_speech"])),
    ],
)
def test_stream_warnings(spark, change, want):
    v = {"ok": True, "hyp": "今天天气很好", "chinese": True, "al": 2.0, "src": 10.0, "tokens": False, "wants": False, "has": False, "err": None} | change
    df = spark.createDataFrame([tuple(v.values())], "ok boolean, hyp string, chinese boolean, al double, src double, tokens boolean, wants boolean, has boolean, err double")
    c = F.col
    w = df.select(reports.stream_warnings({"ok": c("ok"), "hyp": c("hyp"), "chinese": c("chinese"), "al_s": c("al"), "src_s": c("src"), "from_tokens": c("tokens"), "wants_speech": c("wants"), "has_speech": c("has"), "speech_err": c("err")}).alias("w")).first()["w"]
    assert (w["ok"], w["warnings"]) == want


def wav(values, rate=8000):
    body = struct.pack(f"<{len(values)}h", *values)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_screening_report(spark):
    loud = lambda n: [8000 if k % 2 else -8000 for k in range(n)]
    rows = [
        (wav(loud(8000)), 1.0, "en", "one two"),  # kept
        (wav(loud(4800)), 0.6, None, "好好"),  # kept, of no language
        (wav(loud(2400)), 0.3, "zh", "好"),  # very short: review
        (wav([0] * 8000), 1.0, "zh", "好"),  # silent: reject
        (b"no audio", 1.7, "en", "one"),  # reject, by expected seconds
        (wav(loud(80)), 9.0, "en", "one"),  # longer than asked for: scanned only
        (wav(loud(8000)), None, "en", "one"),  # no expected seconds: selected, mismatch
    ]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audio.screening_report(spark.createDataFrame(rows, "audio binary, said double, lang string, label string"), "audio", "said", "lang", "label").collect()}
    assert got["scanned", None, None][0] == 7 and got["selected", None, None][0] == 6
    assert {d: got["decision", d, None][0] for d in ("keep", "review", "reject")} == {"keep": 2, "review": 1, "reject": 3}
    assert got["language", "keep", "unknown"][0] == 1 and got["bucket", "review", "0-0.5s"][0] == 1 and got["bucket", "reject", "1.5-2s"][0] == 1 and got["bucket", "reject", "1-1.5s"][0] == 2
    assert got["flag", None, "decode_error"][0] == 1 and got["flag", None, "near_silent"][0] == 1 and got["flag", None, "duration_mismatch"][0] == 1 and got["flag", None, "very_short_under_0.5s"][0] == 1
    assert got["decision", "reject", None][1] == round((1.0 + 1.7 + 1.0) / 3600, 4)
    assert audio.screening_report(spark.createDataFrame([], "audio binary, said double, lang string, label string"), "audio", "said", "lang", "label").count() == 0


DETAILS = "lang_name string, id string, dur_desc string, grade string, comment string, cer double, wer double, zh_cer double, f1_asr double, f1_zh double, gold_src string, hyp_asr string, gold_zh string, hyp_mt string"


def test_detail_rows_round_trip(spark):
    rows = [
        ("日本語", "ja_1", "12 s", "good", "a < b & c", 9.5, None, 12.25, 0.5, 0.75, 'x <b>&amp;"y"</b>\nz', "", "译文", "译 文"),
        ("Deutsch", "de_1", None, None, None, None, 31.5, None, None, None, None, "t" * 70000, "", None),
    ]
    df = spark.createDataFrame(rows, DETAILS).coalesce(1)
    lines = [r[0] for r in df.select(report_pages.detail_lines(df)).collect()]
    page = f"<table><tr><td>1</td></tr></table><h2>{report_pages.DETAIL}</h2>\n<table>\n<tr><th>a</th></tr>\n" + "\n".join(lines) + "</table>"
    pages = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None), (4, "")], "page_id long, html string")
    got = report_pages.scored_rows(report_pages.table_rows(pages, "html", "page_id"), "page_id").orderBy("nth").collect()
    assert len(got) == 2 and [r["cls"] for r in got] == ["ok", ""]
    for r, want in zip(got, rows, strict=True):
        for name, value in zip(DETAILS.replace(" string", "").replace(" double", "").split(", "), want, strict=True):
            if name in ("cer", "wer", "zh_cer", "f1_asr", "f1_zh"):
                assert r[name] == value, name
            else:
                assert r[name] == (value or ""), name


def test_table_rows_as_others_write_them(spark):
    row = '<tr class="bad x"><td>Fran&ccedil;ais<br/>fr&#95;1<BR>9 s</td><td><b>weak</b><br>one<br />two</td><td>译中CER 4.5%</td><td><div class="lab">金标源语</div><div class="txt">a<br>b</div><div class="txt">stray</div></td></tr>'
    page = f"{report_pages.DETAIL}<table><tr><th>h</th></tr>{row}<tr><td>only</td></tr></table>"
    a, b = report_pages.scored_rows(report_pages.table_rows(spark.createDataFrame([(page,)], "html string"), "html")).orderBy("nth").collect()
    assert (a["lang_name"], a["id"], a["dur_desc"], a["grade"], a["comment"], a["cls"]) == ("Français", "fr_1", "9 s", "weak", "one two", "bad x")
    # the literal rate of a page that has no other is read as both
    assert (a["cer"], a["zh_cer"], a["wer"], a["gold_src"], a["hyp_mt"]) == (4.5, 4.5, None, "a\nb", "")
    assert (b["lang_name"], b["id"], b["grade"], b["comment"], b["cer"]) == ("only", None, "", "", None)


def test_page_is_written_in_order(spark, tmp_path):
    df = spark.range(100).repartition(7).select("id", (F.col("id") / 3).alias("rate"))
    report_pages.write_page(spark, str(tmp_path), "A & B", [report_pages.table_section(df, "First", [F.desc("id")], {"rate": (10.0, 30.0)}), report_pages.table_section(df.limit(0), "None <", ["id"])])
    page = "\n".join(open(f.removeprefix("file:"), encoding="utf-8").read().rstrip("\n") for f in report_pages.page_files(spark, str(tmp_path)))
    assert page.startswith("<!doctype html>") and page.endswith("</body></html>") and "<h1>A &amp; B</h1>" in page and "<h2>None &lt;</h2>" in page
    back = report_pages.table_rows(spark.createDataFrame([(page,)], "html string"), "html", heading="First").orderBy("nth").collect()
    assert [int(r["cells"][0]) for r in back if r["cells"]] == list(range(99, -1, -1))


@pytest.mark.parametrize("text,want", [("5㎏ ﬁne ½ ㍿", "5kg fine 1 2 株式会社"), ("Café ÉTÉ", "café été"), ("Hallo [Musik] <unk> (lacht) Welt!", "hallo welt"), ("a　b c", "a b c"), ("x² + y", "x2 y"), ("", ""), (None, None)])
def test_basic(spark, text, want):
    assert spark.range(1).select(textnorm.basic(F.lit(text).cast("string")).alias("t")).first()["t"] == want


def test_reviewed_error_rate(spark):
    rows = [("a", "1", 10, 1, 0, 1), ("a", "2", 5, 5, None, 0), ("a", "10", 7, 1, 1, 1), ("a", "3", None, 1, 1, 1), ("b", "1", 4, 0, 0, 0), ("c", "7", 4, 1, 0, 0), ("c", "2", None, 9, 9, 9)]
    samples = spark.createDataFrame(rows, "run string, id string, ref_len long, sub long, del long, ins long")
    rules = {"2": {"note": "ü", "reason": "noise"}, "10": {"reason": 'a "b"'}, "99": {}}
    excluded = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for k, v in rules.items()], "id string, rule string")
    got = {r["run"]: r.asDict() for r in curation.reviewed(samples, excluded, "run").collect()}
    sign = lambda *ids: hashlib.sha256(json.dumps({i: rules[i] for i in ids}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
    assert got["a"] == {"run": "a", "err_rate": 0.2, "n_total": 2, "n_scored": 1, "n_excluded": 2, "excluded_ids": ["10", "2"], "total_ref_len": 10, "total_edits": 2, "exclusion_signature": sign("10", "2")}
    assert "b" not in got and (got["c"]["err_rate"], got["c"]["exclusion_signature"]) == (0.25, sign("2"))
