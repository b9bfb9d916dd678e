"""Text corpora and logs as DataFrames.

Lines keep their order in the columns ``file``, ``block`` and ``nth``: the
file, the start of the split and a number that rises within it.  No line is
gathered in one task, so a file may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("file", "block", "nth")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and the place of every line that is not blank."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return read.withColumn("nth", F.monotonically_increasing_id()).where(F.trim("value") != "")


def json_lines(spark: SparkSession, path: str, schema: str, tail: str = "forgive", objects_only: bool = False) -> DataFrame:
    """Records of JSON Lines.  A malformed line fails the query, except that

    * ``forgive`` drops it where it is the last line of its file (a torn append),
    * ``skip`` drops it anywhere, ``strict`` nowhere.

    ``objects_only`` drops lines of JSON that are no object, wherever they stand.
    """
    if tail not in ("forgive", "skip", "strict"):
        raise ValueError(f"unknown rule {tail}")
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    read = lines(spark, path)
    if objects_only:
        other = ~F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull()
        read = read.where(~other)
    read = read.withColumn("r", row).withColumn("bad", F.col("r").isNull() | F.col("r._bad").isNotNull())
    if tail == "skip":
        read = read.where(~F.col("bad"))
    else:
        spare = F.lit(False)
        if tail == "forgive":
            # one row a file: the place of its last line
            last = read.groupBy("file").agg(F.max(F.struct("block", "nth")).alias("last"))
            read = read.join(last, "file")
            spare = F.struct("block", "nth") == F.col("last")
        fail = F.raise_error(F.concat(F.lit("malformed line in "), F.col("file"))).cast("boolean")
        read = read.where(F.when(F.col("bad") & spare, F.lit(False)).when(F.col("bad"), fail).otherwise(F.lit(True)))
    return read.select("r.*", *ORDER).drop("_bad")


def keyed(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Two columns parted by the first white space of a line; lines without a second one are dropped."""
    part = F.split(F.trim("value"), r"\s+", 2)
    return lines(spark, path).where(F.size(part) == 2).select(part[0].alias(key), part[1].alias(value))


def transcripts(spark: SparkSession, text_path: str, audio_path: str) -> DataFrame:
    """id, ref_text and audio_path of utterances that both files name."""
    return keyed(spark, text_path, "id", "ref_text").join(keyed(spark, audio_path, "id", "audio_path"), "id")


def tab_separated(spark: SparkSession, path: str) -> DataFrame:
    """A headed table; a byte order mark before the first name is removed."""
    read = spark.read.csv(path, sep="\t", header=True, quote="")
    return read.toDF(*(c.lstrip("﻿") for c in read.columns))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line and its number in the file from 0, blank lines counted; splits are numbered by their own counts and then shifted."""
    read = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("nth", F.monotonically_increasing_id())
    # lines of a split are consecutive, and a split is one row here: the window below holds splits, not lines
    splits = read.groupBy("file", "block").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return read.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("nth") - F.col("first")).alias("line_no"), "line")


def parallel_text(spark: SparkSession, source_path: str, target_path: str) -> DataFrame:
    """Pairs of lines with the same number; pairs with a blank side are dropped."""
    s = numbered(spark, source_path).select("line_no", F.col("line").alias("source_text"))
    t = numbered(spark, target_path).select("line_no", F.col("line").alias("ref_text"))
    return s.join(t, "line_no").where("trim(source_text) <> '' and trim(ref_text) <> ''")


def unescape(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def marked_segments(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, seg_id and text of ``<doc docid=..><seg id=..>`` markup that need not be well-formed; a file is a row."""
    whole = spark.read.text(path, wholetext=True).select("value")
    docs = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)(<doc\b.*?</doc>)"), F.lit(1))).alias("doc"))
    segs = docs.select(F.regexp_extract("doc", r'(?is)^<doc\b[^>]*?docid="([^"]*)"', 1).alias("doc_id"), F.explode(F.regexp_extract_all("doc", F.lit(r"(?is)(<seg\b[^>]*>.*?</seg>)"), F.lit(1))).alias("seg"))
    return segs.select("doc_id", F.regexp_extract("seg", r'(?is)^<seg\b[^>]*?id="([^"]*)"', 1).alias("seg_id"), F.trim(unescape(F.regexp_extract("seg", r"(?is)>(.*)</seg>$", 1))).alias("text"))
