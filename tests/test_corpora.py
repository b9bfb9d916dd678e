import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from murmurate.operators import runs, scoring
from murmurate.sources import corpora, readers, writers


def put(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    if mode == "gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_results(spark, tmp_path):
    put(tmp_path / "m-a__d.json", '{"summary": {"n_ok": 1}}')
    put(tmp_path / "m-a__d.json.__rerun_2", '{"summary": {"n_ok": 9}}')
    put(tmp_path / "m__x__e.json.__rerun_1", '{"summary": {"n_ok": 2}}')
    put(tmp_path / "list__f.json", "[1, 2]")
    got = rows(corpora.results(spark, str(tmp_path), "summary struct<n_ok:long>", ["m", "m__x"]).select("file", "model", "dataset", "staged", "r.summary.n_ok"), "file", "model", "dataset", "staged", "n_ok")
    assert got == [("m-a__d.json", "m-a", "d", False, 1), ("m__x__e.json", "m__x", "e", True, 2)]


def test_exclusions(spark, tmp_path):
    put(tmp_path / "c" / "d1.json", '{"samples": {"u1": {"reason": "bad"}}, "speakers": {"s1": {"action": "keep"}}}')
    put(tmp_path / "n" / "d1" / "exclusions.json", '{"samples": {"u9": {"reason": "old"}}}')
    put(tmp_path / "n" / "d2" / "exclusions.json", '{"samples": {"u2": {"action": "exclude"}}}')
    got = rows(corpora.exclusion_policies(spark, f"{tmp_path}/c", f"{tmp_path}/n"), "dataset", "kind", "key", "action", "reason")
    assert got == [("d1", "sample", "u1", "exclude", "bad"), ("d1", "speaker", "s1", "keep", None), ("d2", "sample", "u2", "exclude", None)]


def test_cuts_and_tables(spark, tmp_path):
    cut = {"id": "a", "supervisions": [{"text": "hi"}], "recording": {"sources": [{"source": "data/x/a.wav"}]}}
    put(tmp_path / "cuts.jsonl.gz", json.dumps(cut) + "\n" + json.dumps({"id": "b", "supervisions": []}) + "\n", "gz")
    assert rows(corpora.cuts(spark, str(tmp_path / "cuts.jsonl.gz")), "id", "ref_text", "audio_path") == [("a", "hi", "x/a.wav")]
    put(tmp_path / "content.txt", "a.wav\t1\t2\t3\tfirst\nshort\t1\n")
    assert rows(corpora.columns_by_place(spark, str(tmp_path / "content.txt"), {"wav": 0, "text": 4}, 5), "wav", "text") == [("a.wav", "first")]
    put(tmp_path / "q.csv", '﻿id,text\n1,"a, ""b""\nc"\n')
    assert rows(corpora.quoted(spark, str(tmp_path / "q.csv")), "id", "text") == [("1", 'a, "b"\nc')]
    put(tmp_path / "s.tsv", "metric\tvalue\nLongYAAL (CU)\t12.5\nother\tn/a\nno tab\n")
    assert rows(corpora.scores(spark, str(tmp_path / "s.tsv")), "name", "number", "text") == [("long_yaal", 12.5, None), ("other", None, "n/a")]
    put(tmp_path / "l.scv", "name,0.0,0.5,1,0.5,0.9,0\n")
    assert rows(corpora.label_spans(spark, str(tmp_path / "l.scv")), "nth", "start_s", "end_s", "label") == [(0, 0.0, 0.5, 1), (1, 0.5, 0.9, 0)]


def test_lines_are_numbered_by_file(spark, tmp_path):
    put(tmp_path / "d" / "a.txt", "1\n\n2\n")
    put(tmp_path / "d" / "b.txt", "3\n4\n")
    assert rows(readers.numbered(spark, str(tmp_path / "d")), "line_no", "line") == [(0, "1"), (0, "3"), (1, ""), (1, "4"), (2, "2")]


def test_json_corpora(spark, tmp_path):
    put(tmp_path / "t.jsonl", json.dumps({"id": "1", "src": " a ", "ref": "b", "terms": {"x": ["y", "z"]}}) + "\n" + json.dumps({"id": "2", "src": "", "ref": "b"}) + "\n")
    r = corpora.term_translations(spark, str(tmp_path / "t.jsonl")).collect()
    assert len(r) == 1 and r[0]["keywords"][0].asDict() == {"keyword": "x", "aliases": ["y", "z"]} and r[0]["source_text"] == "a"
    note = {"duration": 9, "segment": [{"src_text": " s ", "trg_text": "t", "start_time": 1, "end_time": 2, "utterance": [{"term": [{"src": "a", "trg": "b"}, {"src": "a", "trg": "b"}, {"src": "", "trg": "c"}]}]}, {"src_text": "u", "trg_text": " "}, {"src_text": "v", "trg_text": "w"}]}
    put(tmp_path / "n" / "v1.json", json.dumps(note))
    put(tmp_path / "n" / "v2.json", json.dumps({"segment": []}))
    r = corpora.annotations(spark, str(tmp_path / "n")).collect()
    assert [(x["id"], x["source_text"], x["ref_text"], [tuple(t) for t in x["terms"]]) for x in r] == [("v1", "s\nv", "t\nw", [("a", "b")])]
    put(tmp_path / "k" / "talk.asr.json", '{"transcript": "a", "translation": "b", "offset": 1.0005, "duration": 2}\n{"asr": "c", "translation": ""}\n{"asr": "d", "translation": "e", "offset": 4}\n')
    r = corpora.talks(spark, str(tmp_path / "k")).first()
    assert r["id"] == "talk" and [tuple(s) for s in r["segments"]] == [(1000, 3000, "a", "b"), (4000, 4000, "d", "e")]
    s = spark.createDataFrame([(1, "ctx", [" a ", "", None, "b"]), (2, None, ["x"]), (3, "y", [])], "id long, context string, discussion array<string>")
    assert rows(corpora.summaries(s), "id", "source_text", "ref_text") == [("vcsum_1", "ctx", "a\nb")]
    cell = json.dumps({"annotators": [{"sentences": [{"id": 2, "text": "q"}]}, {"sentences": [{"id": 1, "text": "p"}, {"id": 2, "text": "q"}]}, {}], "topics": ["t"]})
    m = spark.createDataFrame([("m1", cell), ("m2", '{"topics": ["t", "u"]}'), ("m3", "{}")], "meeting_key string, cell string")
    assert rows(corpora.meeting_points(m), "meeting_key", "ref_text") == [("m1", "p\nq"), ("m2", "t\nu")]


GRID = '''item []:
    item [1]:
        name = "spk"
        intervals [1]:
            xmin = 0
            xmax = 1.5
            text = "he said ""hi"""
        intervals [2]:
            xmin = 1.5
            xmax = 2
            text = ""
    item [2]:
        name = "文本"
        intervals [1]:
            xmin = 0.25
            xmax = 2
            text = "全文"
'''


def test_marked_up_corpora(spark, tmp_path):
    put(tmp_path / "g" / "r1.TextGrid", GRID)
    assert rows(corpora.text_grids(spark, str(tmp_path / "g")), "id", "tier", "start_s", "end_s", "text") == [("r1", "spk", 0.0, 1.5, 'he said "hi"'), ("r1", "文本", 0.25, 2.0, "全文")]
    put(tmp_path / "x.xml.gz", '<set><doc id="d1" task="TRANS"><p>a &amp; <b>c</b></p></doc><doc id="d2" task="ASR">no</doc></set>', "gz")
    assert rows(corpora.marked_tasks(spark, str(tmp_path / "x.xml.gz")), "id", "text") == [("d1", "a & c")]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, data in (("w/u1.wav", b"one"), ("w/u2.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("u3.wav", b"three")
    got = rows(corpora.archive_members(spark, f"{tmp_path}/[ab].*", (".wav",)), "member", "content")
    assert [(m, bytes(c)) for m, c in got] == [("u3.wav", b"three"), ("w/u1.wav", b"one")]
    put(tmp_path / "text", "u1 hello there\nu9 gone\n")
    assert rows(corpora.looked_up(spark, str(tmp_path / "text"), f"{tmp_path}/a.tar.gz"), "id", "ref_text") == [("u1", "hello there")]


def test_embedded_audio(spark):
    d = spark.createDataFrame([(1, "a", (b"x", "p/f.wav")), (2, "", (b"y", None))], "id long, sentence string, audio struct<bytes:binary,path:string>")
    assert rows(corpora.embedded_audio(d, "sentence", "/out/", 2), "id", "ref_text", "audio_path") == [("1", "a", "/out/f.wav")]
    with pytest.raises(ValueError, match="3 were expected"):
        corpora.embedded_audio(d, "sentence", "/out", 3)


def test_missing_sources_are_told(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/a")
    d, missing = corpora.union_available(spark, {"a": (f"{tmp_path}/a", "id"), "b": (f"{tmp_path}/b", "id")})
    assert d.count() == 2 and missing == ["b"]
    with pytest.raises(ValueError):
        corpora.union_available(spark, {"b": (f"{tmp_path}/b", "id")})


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", None)], "id string, n long")
    with pytest.raises(Exception, match="n is null"):
        writers.write_json(d, f"{tmp_path}/bad", required=("n",))
    writers.append_log(d, f"{tmp_path}/log")
    writers.append_log(d.where("n = 1"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 3
    spark.readStream.schema("id string, n long").json(f"{tmp_path}/log")
    q = writers.stream_log(spark.readStream.schema("id string, n long").json(f"{tmp_path}/log"), f"{tmp_path}/copy", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and spark.read.json(f"{tmp_path}/copy").count() == 3
    samples = spark.createDataFrame([("s1", None, 0.25, "h"), ("s2", "failed", None, None), ("s3", None, 0.5, "k")], "id string, error string, err_rate double, hyp_norm string")
    manifest = spark.createDataFrame([("s1", "en", "src", "ref")], "id string, lang string, source_text string, ref_text string")
    infer = spark.createDataFrame([("s1", "hyp", (1.0, None, 0.5))], "id string, hyp string, extra struct<al_s:double,laal_s:double,ttfb_s:double>")
    got = {r["id"]: r for r in writers.sample_export(samples, manifest, infer, "en-zh").collect()}
    assert set(got) == {"s1", "s3"} and got["s1"]["metrics"]["chrF"] == 75.0 and got["s1"]["translation"] == "hyp"
    assert got["s3"]["metrics"]["chrF"] is None and got["s3"]["translation"] == "k"
    pack = spark.createDataFrame([("u", "w/u.wav", " hi ", "en", "ds", 1.2, "all", "train"), ("v", "w/v.wav", None, "zh", "ds", 0.4, "all", "validation")], "id string, audio_path string, transcription string, language string, source_dataset string, duration double, variant string, split string")
    writers.write_pack(writers.training_records(pack, F.lit("x")), f"{tmp_path}/pack")
    assert rows(spark.read.json(f"{tmp_path}/pack"), "variant", "split", "text") == [("all", "train", "language English<asr_text>hi"), ("all", "validation", "language Chinese<asr_text>")]
    records = spark.createDataFrame([("a", "x")], "id string, prediction string")
    segs = spark.createDataFrame([("a", 1, "a.wav", 1.0, 1.0, "r \n2", "s2"), ("a", 0, "a.wav", 0.0, 1.0, "r1", "s1"), ("z", 0, "z.wav", 0.0, 1.0, "no", "no")], "id string, nth long, wav string, offset double, duration double, reference string, source_text string")
    writers.delay_assets(records, segs, f"{tmp_path}/assets")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/assets/references").collect()] == ["r1", "r 2"]
    h = spark.createDataFrame([("<a>", 0.5), (None, None)], "t string, v double")
    assert [r["line"] for r in writers.html_rows(h, {"v": (0.1, 0.5)}).collect()] == ['<tr><td>&lt;a&gt;</td><td class="bad">0.5000</td></tr>', '<tr><td>–</td><td class="">–</td></tr>']


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_literals(spark):
    assert value(spark, scoring.numbers(F.lit("1,234.50 and 007, +3% -0.10, x2 v1.2.3 100 0"))) == ["1234.5", "7", "3%", "-0.1", "2", "100", "0"]
    assert value(spark, scoring.dates(F.lit("2024年3月5日 and 1999/13/01, 2001-1-31. 12024-01-01"))) == ["2024-03-05", "2001-01-31"]
    assert value(spark, scoring.numbers(F.lit(None).cast("string"))) == []


def test_text_rules(spark):
    assert value(spark, scoring.text_units(F.lit("One. Two? three\nFour. five. Six"))) == ["One.", "Two?", "three", "Four. five.", "Six"]
    assert value(spark, scoring.reply_body(F.lit("x<asr_text>system\n\nuser\nreal text<asr_text> "))) == "real text"
    assert value(spark, scoring.reply_body(F.lit("the system said"))) == "the system said"
    assert value(spark, scoring.preview(F.lit("你好"), F.lit("world"), F.lit(False))) == "你好world"
    assert value(spark, scoring.portable_path(F.lit("/a/b/c/d/e.wav"))) == "c/d/e.wav"
    assert value(spark, scoring.speaker(F.lit(None).cast("string"), F.lit("a/S01/x.wav"))) == "S01"
    assert value(spark, scoring.language_tag(F.lit(" "))) == "" and value(spark, scoring.language_tag(F.lit("en US!"))).startswith("__lang-enUS-")
    assert value(spark, scoring.short_code(F.lit("en-zh"))) == "zh"
    assert value(spark, scoring.review_complete(F.lit("ok"), F.lit(None).cast("string"), F.array(F.lit("a")), F.create_map(F.lit("a"), F.lit("unreviewed")))) is False


def test_compatible_and_guards(spark):
    d = spark.createDataFrame([("s", "m1", "auto"), ("s", "m1", None), ("t", "m1", "auto")], "run string, model string, mode string")
    got = {r["run"]: r["ok"] for r in d.groupBy("run").agg(runs.same_provenance(d, ["model", "mode"], {"model": "m1", "mode": "auto"}).alias("ok")).collect()}
    assert got == {"s": False, "t": True}
    a = spark.createDataFrame([("x", ["1", "2"])], "id string, a array<string>")
    with pytest.raises(Exception, match="lengths differ"):
        runs.zipped(a, a.select("id", F.slice("a", 1, 1).alias("b")), "id", "a", "b").collect()


def test_balanced_groups(spark):
    units = F.array(*[F.lit(x) for x in ("a b c", "d", "e f", "g h i j")])
    assert value(spark, scoring.balanced_groups(units, F.lit(2))) == ["a b c d", "e f g h i j"]
    assert value(spark, scoring.balanced_groups(units, F.lit(1))) == ["a b c d e f g h i j"]
    assert value(spark, scoring.balanced_groups(F.array(F.lit("a")), F.lit(3))) == ["a", "", ""]
    assert value(spark, scoring.balanced_groups(F.array().cast("array<string>"), F.lit(2))) == ["", ""]


def test_event_lines_keep_objects(spark, tmp_path):
    put(tmp_path / "e.jsonl", '{"a": 1}\n\n[1]\n"x"\n{"a": 2}\n{"a": ')
    assert rows(readers.json_lines(spark, str(tmp_path / "e.jsonl"), "a long", objects_only=True), "a") == [(1,), (2,)]
    put(tmp_path / "f.jsonl", '{"a": 1}\n{"a": \n{"a": 2}')
    with pytest.raises(Exception, match="malformed"):
        readers.json_lines(spark, str(tmp_path / "f.jsonl"), "a long", objects_only=True).collect()


def test_missing_ids_fail(spark):
    from murmurate.operators import curation

    d = spark.range(5).withColumnRenamed("id", "doc_id")
    assert [r["doc_id"] for r in curation.select_in_order(d, [3, 1], "doc_id", strict=True)[0].orderBy("position").collect()] == [3, 1]
    with pytest.raises(ValueError, match="9"):
        curation.select_in_order(d, [3, 9], "doc_id", strict=True)


def test_hotwords(spark, tmp_path):
    put(tmp_path / "ids", "u1 u1\nu2\nu1\n")
    put(tmp_path / "text", "u1 see the red fox\nu2 nothing\nu3 red\n")
    put(tmp_path / "wav", "/a/u1-0007.wav\n/a/u2.flac\n")
    got = rows(corpora.hotword_set(spark, str(tmp_path / "ids"), str(tmp_path / "text"), str(tmp_path / "wav"), ["fox", "red", "red fox", ""]), "id", "audio_path", "keywords")
    assert got == [("u1", "/a/u1-0007.wav", ["fox", "red", "red fox"]), ("u2", "/a/u2.flac", [])]
    put(tmp_path / "g.jsonl", '{"id": "1", "audio": "a.wav", "text": "x"}\n{"id": "2", "audio": "b.wav"}\n')
    assert rows(corpora.golden(spark, str(tmp_path / "g.jsonl")), "id", "audio_path", "ref_text") == [("1", "a.wav", "x")]


def test_numbers_read_back():
    from murmurate.functions import textnorm

    for n in [*range(0, 3000), 10203, 120000, 1020304, 10**8, 2 * 10**8 + 5, 305 * 10**8 + 20, 12345678]:
        assert textnorm.arabic_number(textnorm.chinese_number(str(n))) == str(n), n
    for words, number in (("一百二", "120"), ("一百零二", "102"), ("三千五", "3500"), ("两万三", "23000"), ("二零二四", "2024"), ("负三点五", "-3.5"), ("十", "10"), ("点五", None), ("abc", None), ("三点", None)):
        assert textnorm.arabic_number(words) == number, words
