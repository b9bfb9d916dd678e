"""Readers and writers on small files."""

import pytest

from murmurate.sources import readers, writers

ROW = "id string, ok boolean"


def test_json_lines(spark, tmp_path):
    good = '{"id": "a", "ok": true}\n\n{"id": "b", "ok": false}\n'
    (tmp_path / "torn.jsonl").write_text(good + '{"id": "c", "o')
    torn = str(tmp_path / "torn.jsonl")
    assert [tuple(r[:2]) for r in readers.json_lines(spark, torn, ROW).orderBy(*readers.ORDER).collect()] == [("a", True), ("b", False)]
    with pytest.raises(Exception, match="malformed line"):
        readers.json_lines(spark, torn, ROW, "strict").collect()
    (tmp_path / "broken.jsonl").write_text("{nope\n" + good)
    broken = str(tmp_path / "broken.jsonl")
    with pytest.raises(Exception, match="malformed line"):
        readers.json_lines(spark, broken, ROW).collect()
    assert readers.json_lines(spark, broken, ROW, "skip").count() == 2


def test_transcripts(spark, tmp_path):
    (tmp_path / "text").write_text("u1 hello  there\nu2 bye\nu3\n")
    (tmp_path / "wav.scp").write_text("u1 /a/u1.wav\nu3 /a/u3.wav\n")
    found = readers.transcripts(spark, str(tmp_path / "text"), str(tmp_path / "wav.scp")).collect()
    assert [tuple(r) for r in found] == [("u1", "hello  there", "/a/u1.wav")]


def test_tables_and_parallel_text(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("﻿id\ttext\n1\ta \"b\n", encoding="utf-8")
    assert [r.asDict() for r in readers.tab_separated(spark, str(tmp_path / "t.tsv")).collect()] == [{"id": "1", "text": 'a "b'}]
    (tmp_path / "s").write_text("one\n\nthree\n")
    (tmp_path / "r").write_text("eins\nzwei\ndrei\n")
    found = readers.parallel_text(spark, str(tmp_path / "s"), str(tmp_path / "r")).orderBy("line_no").collect()
    assert [tuple(r) for r in found] == [(0, "one", "eins"), (2, "three", "drei")]


def test_numbers_over_splits(spark, tmp_path):
    (tmp_path / "n").write_text("".join(f"line {i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = readers.numbered(spark, str(tmp_path / "n")).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.line) for r in found] == [(i, f"line {i}") for i in range(500)]


def test_marked_segments(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<set><doc docid="d1" lang="en"><p><seg id="1">a &amp; b</seg>\n<seg id="2"> c </seg></p></doc><doc docid="d2"><seg id="1">x</seg></doc>')
    found = readers.marked_segments(spark, str(tmp_path / "x.xml")).collect()
    assert [tuple(r) for r in found] == [("d1", "1", "a & b"), ("d1", "2", "c"), ("d2", "1", "x")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", "x"), (2, None, "y")], "n int, t string, split string")
    assert [r.line for r in writers.markdown_rows(df).collect()] == ["| 1 | a\\|b | x |", "| 2 |  | y |"]
    writers.write_json(df, str(tmp_path / "out"), "split")
    assert spark.read.json(str(tmp_path / "out")).where("split = 'x'").count() == 1
