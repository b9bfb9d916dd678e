"""Corpora, results and archives as DataFrames; each file is read by a task, none on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmurate.sources import archives
from murmurate.sources.readers import json_lines, keyed, lines

# Names of scores as files show them.
SCORE_NAMES = {
    "BLEU": "bleu", "chrF": "chrf", "COMET": "comet",
    "LongYAAL (CU)": "long_yaal", "LongYAAL (CA)": "ca_long_yaal",
    "LongAL (CU)": "long_al", "LongAL (CA)": "ca_long_al",
    "LongLAAL (CU)": "long_laal", "LongLAAL (CA)": "ca_long_laal",
    "LongAP (CU)": "long_ap", "LongAP (CA)": "ca_long_ap",
    "LongDAL (CU)": "long_dal", "LongDAL (CA)": "ca_long_dal",
}


def union_available(spark: SparkSession, sources: dict[str, tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """(doc_id, origin) of all sources that can be read, and the names of those that can't; ``sources`` has a path and an id column by name."""
    there, missing = [], []
    for name, (path, key) in sources.items():
        try:
            there.append(spark.read.parquet(path).select(F.col(key).alias("doc_id"), F.lit(name).alias("origin")))
        except AnalysisException:
            missing.append(name)
    if not there:
        raise ValueError(f"no source can be read: {missing}")
    whole = there[0]
    for df in there[1:]:
        whole = whole.unionByName(df)
    return whole, missing


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def results(spark: SparkSession, folder: str, schema: str, models: list[str]) -> DataFrame:
    """Result files ``<model>__<dataset>.json`` as rows: file, mtime, model, dataset and r.

    A staged rerun (``.json.__rerun_..``) stands in only where its final file is
    missing, the newest of several; the model is the longest known prefix of the
    name, or what stands before the two underscores.  Files that are no JSON object are left out.
    """
    read = spark.read.option("pathGlobFilter", "*.json*").text(folder, wholetext=True).select("value", "_metadata.file_name", F.col("_metadata.file_modification_time").alias("mtime"))
    staged = F.col("file_name").rlike(r"\.json\.__rerun_")
    final = F.regexp_replace("file_name", r"\.json\.__rerun_.*$", ".json")
    rows = read.select("value", "file_name", "mtime", staged.alias("staged"), final.alias("file")).where(F.col("file").endswith(".json"))
    best = rows.groupBy("file").agg(F.max_by(F.struct("value", "mtime", "staged"), F.struct(~F.col("staged"), "mtime", "file_name")).alias("x")).select("file", "x.*")
    stem = F.regexp_replace("file", r"\.json$", "")
    known = F.array(*[F.lit(m) for m in sorted(models, key=lambda m: (-len(m), m))]) if models else F.array().cast("array<string>")
    model = F.coalesce(F.try_element_at(F.filter(known, lambda m: F.startswith(stem, F.concat(m, F.lit("__")))), F.lit(1)), F.split(stem, "__")[0])
    out = best.withColumn("model", model).withColumn("dataset", F.substring(stem, F.length(model) + 3, F.length(stem)))
    return out.withColumn("r", F.from_json("value", schema)).where(F.col("r").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))).select("file", "mtime", "staged", "model", "dataset", "r")


def exclusion_policies(spark: SparkSession, central: str, nested: str) -> DataFrame:
    """dataset, kind (sample or speaker), key, action, reason of the policy files; a dataset's central file goes before the one in its folder."""
    rule = "map<string,struct<action:string,reason:string>>"

    def read(path: str, rank: int, name: Column) -> DataFrame:
        t = spark.read.text(path, wholetext=True).select(name.alias("dataset"), F.from_json("value", f"samples {rule}, speakers {rule}").alias("p"))
        return t.withColumn("rank", F.lit(rank))

    file = F.col("_metadata.file_path")
    both = read(f"{central}/*.json", 0, F.regexp_replace(base_name(file), r"\.json$", "")).unionByName(read(f"{nested}/*/exclusions.json", 1, F.element_at(F.split(file, "/"), -2)))
    one = both.withColumn("k", F.row_number().over(Window.partitionBy("dataset").orderBy("rank"))).where("k = 1")
    part = lambda kind: one.select("dataset", F.lit(kind[:-1]).alias("kind"), F.explode_outer(F.col(f"p.{kind}")).alias("key", "x")).where("key is not null").select("dataset", "kind", "key", F.coalesce("x.action", F.lit("exclude")).alias("action"), "x.reason")
    return part("samples").unionByName(part("speakers"))


def cuts(spark: SparkSession, path: str) -> DataFrame:
    """id, ref_text and audio_path of gzipped cut lists; cuts without text are dropped."""
    c = json_lines(spark, path, "id string, supervisions array<struct<text:string>>, recording struct<sources:array<struct<source:string>>>", "strict")
    source = F.coalesce(F.try_element_at("recording.sources", F.lit(1))["source"], F.lit(""))
    return c.select("id", F.try_element_at("supervisions", F.lit(1))["text"].alias("ref_text"), F.regexp_replace(source, "^data/", "").alias("audio_path")).where("coalesce(ref_text, '') <> ''")


def columns_by_place(spark: SparkSession, path: str, names: dict[str, int], least: int, sep: str = "\t") -> DataFrame:
    """Columns of a table without a head; lines with fewer than ``least`` columns are dropped."""
    part = F.split("value", re.escape(sep), -1)
    return lines(spark, path).where(F.size(part) >= least).select(*[F.get(part, F.lit(k)).alias(n) for n, k in names.items()])


def quoted(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A headed table whose cells may be quoted and hold line ends."""
    read = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True)
    return read.toDF(*(c.lstrip("﻿") for c in read.columns))


def summaries(rows: DataFrame) -> DataFrame:
    """id, source_text and ref_text of meetings from ``id, context, discussion``: points are trimmed and joined by line ends; rows without either are dropped."""
    points = F.filter(F.transform("discussion", lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.select(F.concat(F.lit("vcsum_"), F.col("id").cast("string")).alias("id"), F.col("context").alias("source_text"), F.array_join(points, "\n").alias("ref_text")).where("coalesce(source_text, '') <> '' and ref_text <> ''")


def term_translations(spark: SparkSession, path: str) -> DataFrame:
    """id, source_text, ref_text and keywords of lines with a map of terms; a keyword's aliases are the term's translations."""
    c = json_lines(spark, path, "id string, src string, ref string, terms map<string,array<string>>", "strict")
    return c.select("id", F.trim("src").alias("source_text"), F.trim("ref").alias("ref_text"), F.transform(F.map_entries(F.coalesce("terms", F.create_map().cast("map<string,array<string>>"))), lambda e: F.struct(e["key"].alias("keyword"), e["value"].alias("aliases"))).alias("keywords")).where("coalesce(source_text, '') <> '' and coalesce(ref_text, '') <> ''")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """id, segments, texts and terms of annotation files (one JSON object each); terms are kept once, in order."""
    schema = "vid string, duration long, segment array<struct<src_text:string,trg_text:string,start_time:long,end_time:long,utterance:array<struct<term:array<struct<src:string,trg:string>>>>>>"
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("a"), F.regexp_replace(base_name(F.col("_metadata.file_path")), r"\.json$", "").alias("stem"))
    full = F.filter(F.coalesce("a.segment", F.array().cast("array<struct<src_text:string,trg_text:string,start_time:bigint,end_time:bigint,utterance:array<struct<term:array<struct<src:string,trg:string>>>>>>")), lambda s: (F.trim(F.coalesce(s["src_text"], F.lit(""))) != "") & (F.trim(F.coalesce(s["trg_text"], F.lit(""))) != ""))
    segments = F.transform(full, lambda s: F.struct(s["start_time"].alias("start_ms"), s["end_time"].alias("end_ms"), F.trim(s["src_text"]).alias("source_text"), F.trim(s["trg_text"]).alias("ref_text")))
    said = F.flatten(F.transform("a.segment", lambda s: F.flatten(F.transform(F.filter(F.coalesce(s["utterance"], F.array().cast("array<struct<term:array<struct<src:string,trg:string>>>>")), lambda u: u["term"].isNotNull()), lambda u: u["term"]))))
    terms = F.array_distinct(F.filter(F.transform(said, lambda x: F.struct(F.trim(F.coalesce(x["src"], F.lit(""))).alias("source"), F.trim(F.coalesce(x["trg"], F.lit(""))).alias("target"))), lambda x: (x["source"] != "") & (x["target"] != "")))
    text = lambda c: F.array_join(F.transform("segments", lambda s: s[c]), "\n")
    d = t.select(F.coalesce("a.vid", "stem").alias("id"), F.col("a.duration").alias("duration_ms"), segments.alias("segments"), F.coalesce(terms, F.array().cast("array<struct<source:string,target:string>>")).alias("terms"))
    return d.where(F.size("segments") > 0).select("*", text("source_text").alias("source_text"), text("ref_text").alias("ref_text"))


def talks(spark: SparkSession, path: str) -> DataFrame:
    """id and segments of talks whose file has a sentence a line, with offset and duration in seconds."""
    t = json_lines(spark, path, "transcript string, asr string, translation string, offset double, duration double", "strict")
    source, ref = F.trim(F.coalesce(F.nullif("transcript", F.lit("")), "asr")), F.trim("translation")
    start = F.coalesce("offset", F.lit(0.0))
    ms = lambda c: F.bround(c * 1000, 0).cast("long")
    s = t.select(F.regexp_replace(base_name(F.col("file")), r"\.asr\.json$", "").alias("id"), F.struct("block", "nth", ms(start).alias("start_ms"), ms(start + F.coalesce("duration", F.lit(0.0))).alias("end_ms"), source.alias("source_text"), ref.alias("ref_text")).alias("s")).where("coalesce(s.source_text, '') <> '' and coalesce(s.ref_text, '') <> ''")
    return s.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x.dropFields("block", "nth")).alias("segments"))


def marked_tasks(spark: SparkSession, path: str, task: str = "TRANS") -> DataFrame:
    """id and text of the documents of one task in gzipped XML; a file is a row."""
    from murmurate.sources.readers import unescape

    whole = spark.read.text(path, wholetext=True).select("value")
    docs = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)(<doc\b.*?</doc>)"), F.lit(1))).alias("doc")).where(F.regexp_extract("doc", r'(?is)^<doc\b[^>]*?task="([^"]*)"', 1) == task)
    inner = F.regexp_replace(F.regexp_replace("doc", r"(?is)^<doc\b[^>]*>|</doc>$", ""), r"(?s)<[^>]+>", " ")
    return docs.select(F.regexp_extract("doc", r'(?is)^<doc\b[^>]*?\bid="([^"]*)"', 1).alias("id"), F.trim(F.regexp_replace(unescape(inner), r"\s+", " ")).alias("text"))


def text_grids(spark: SparkSession, path: str) -> DataFrame:
    """id, tier, start_s, end_s and text of every interval of TextGrid files that has text."""
    whole = spark.read.text(path, wholetext=True).select("value", F.regexp_replace(base_name(F.col("_metadata.file_path")), r"\.TextGrid$", "").alias("id"))
    tiers = whole.select("id", F.posexplode(F.split("value", r"(?m)(?=^\s*item \[\d+\]:)")).alias("n", "tier"))
    named = tiers.select("id", "n", F.regexp_extract("tier", r'(?m)^\s*name = "(.*)"\s*$', 1).alias("name"), "tier").where("name <> ''")
    spans = named.select("id", "n", "name", F.posexplode(F.regexp_extract_all("tier", F.lit(r'(?m)(intervals \[\d+\]:\s*xmin = [\d.]+\s*xmax = [\d.]+\s*text = "(?:[^"]|"")*")'), F.lit(1))).alias("k", "s"))
    text = F.replace(F.regexp_extract("s", r'(?s)text = "(.*)"$', 1), F.lit('""'), F.lit('"'))
    number = lambda c: F.regexp_extract("s", rf"{c} = ([\d.]+)", 1).cast("double")
    return spans.select("id", F.col("name").alias("tier"), F.col("n").alias("tier_no"), "k", number("xmin").alias("start_s"), number("xmax").alias("end_s"), text.alias("text")).where("text <> ''")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """name, number and text of each line after the first; known names are shortened, what is no number stays text."""
    known = F.create_map(*[F.lit(x) for pair in SCORE_NAMES.items() for x in pair])
    from murmurate.sources.readers import numbered

    t = numbered(spark, path).where("line_no > 0 and instr(line, '\t') > 0")
    key, value = F.regexp_extract("line", r"^([^\t]*)\t", 1), F.regexp_extract("line", r"^[^\t]*\t(.*)$", 1)
    number = value.try_cast("double")
    return t.select(F.coalesce(F.try_element_at(known, key), key).alias("name"), number.alias("number"), F.when(number.isNull(), value).alias("text"))


def label_spans(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, start_s, end_s and label of comma-separated triplets after a name."""
    whole = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), ",").alias("v"), base_name(F.col("_metadata.file_path")).alias("file"))
    n = F.floor((F.size("v") - 1) / 3).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    s = whole.select("file", F.explode(F.transform(at, lambda k: F.struct(k.alias("nth"), F.get("v", 3 * k + 1).cast("double").alias("start_s"), F.get("v", 3 * k + 2).cast("double").alias("end_s"), F.get("v", 3 * k + 3).cast("int").alias("label")))).alias("s"))
    return s.select("file", "s.*")


def archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...], range_bytes: int = archives.RANGE_BYTES) -> DataFrame:
    """archive, member and content of the members of the tar and zip files at ``path`` (a file, a folder or a pattern).

    Each task reads a range of members, one at a time, so archives of any size are shared out.
    """
    archives.register(spark)
    # names only; the contents are not read here
    found = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    return spark.read.format(archives.NAME).option("suffixes", ",".join(suffixes)).option("range_bytes", str(range_bytes)).load(",".join(found))


def speaker_states(spans: DataFrame, key: str = "id", speaker: str = "tier") -> DataFrame:
    """``key``, start_s, end_s, speakers (sorted) and state of a recording between any two times at which somebody begins or ends.

    State is silence, single or overlap.  One walk over the sorted ends of a
    recording's spans; a speaker whose spans overlap or touch goes on speaking,
    spans that do not end after they begin are left out, and stretches of the same
    speakers are one.  Before the first span and after the last one there is no state.
    """
    kind, who = dict(spans.dtypes)[key], dict(spans.dtypes)[speaker]
    ends = spans.where("start_s < end_s").select(key, F.col(speaker).alias("who"), F.explode(F.array(F.struct(F.col("start_s").alias("t"), F.lit(1).alias("step")), F.struct(F.col("end_s").alias("t"), F.lit(-1).alias("step")))).alias("e")).select(key, "who", "e.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before, since, last, active = None, None, None, (), {}
        for pdf in batches:
            out = []
            for k, name, t, step in zip(pdf[key], pdf["who"], pdf["t"], pdf["step"], strict=True):
                if k != now or since is None:
                    if since is not None and before > since:
                        out.append((now, since, before, list(last)))
                    now, since, last, active = k, t, (), {}
                elif t > before:
                    speaking = tuple(sorted(active))
                    if speaking != last:
                        if before > since:
                            out.append((k, since, before, list(last)))
                        since, last = before, speaking
                before = t
                active[name] = active.get(name, 0) + step
                if not active[name]:
                    del active[name]
            yield pd.DataFrame(out, columns=[key, "start_s", "end_s", "speakers"])
        if since is not None and before > since:
            yield pd.DataFrame([(now, since, before, list(last))], columns=[key, "start_s", "end_s", "speakers"])

    walked = ends.repartition(key).sortWithinPartitions(key, "t", F.desc("step")).mapInPandas(run, f"`{key}` {kind}, start_s double, end_s double, speakers array<{who}>")
    state = F.when(F.size("speakers") == 0, "silence").when(F.size("speakers") == 1, "single").otherwise("overlap")
    return walked.withColumn("state", state)


def looked_up(spark: SparkSession, text_path: str, archives: str, suffix: str = ".wav") -> DataFrame:
    """id, ref_text and content: texts by id and the archive members of the same name."""
    audio = archive_members(spark, archives, (suffix,)).select(F.regexp_replace(base_name(F.col("member")), re.escape(suffix) + "$", "").alias("id"), "content")
    return keyed(spark, text_path, "id", "ref_text").join(audio, "id")


def embedded_audio(rows: DataFrame, text: str, folder: str, expected: int | None = None) -> DataFrame:
    """id, ref_text, audio_path and the audio's digest of Parquet rows ``id, audio struct<bytes,path>``; another number of rows than ``expected`` fails."""
    d = rows.select(F.col("id").cast("string").alias("id"), F.col(text).alias("ref_text"), F.concat(F.lit(folder.rstrip("/") + "/"), F.coalesce(base_name(F.col("audio.path")), F.concat(F.col("id").cast("string"), F.lit(".wav")))).alias("audio_path"), F.sha2("audio.bytes", 256).alias("audio_sha256"))
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} rows, {expected} were expected")
    return d.where("coalesce(ref_text, '') <> ''")


def meeting_points(rows: DataFrame) -> DataFrame:
    """meeting_key, ref_text: distinct key sentences of all annotators in order of place, or the topics where nobody marked one.

    ``rows`` has meeting_key and cell, a JSON object with annotators' ``sentences`` (id and text) and ``topics``.
    """
    c = rows.select("meeting_key", F.from_json("cell", "annotators array<struct<sentences:array<struct<id:long,text:string>>>>, topics array<string>").alias("c"))
    marked = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("c.annotators", lambda a: a["sentences"].isNotNull()), lambda a: a["sentences"]))))
    text = F.array_join(F.transform(marked, lambda s: s["text"]), "\n")
    return c.select("meeting_key", F.coalesce(F.nullif(text, F.lit("")), F.array_join("c.topics", "\n")).alias("ref_text")).where("coalesce(ref_text, '') <> ''")


def with_keywords(rows: DataFrame, words: list[str], text: str = "ref_text") -> DataFrame:
    """``rows`` with the hotwords that each text holds, in the order of the list; one automaton finds them all in one walk of the text.

    The list is a parameter that each worker holds; it is the caller's and does not come from the rows.
    """
    wanted = [w for w in dict.fromkeys(words) if w]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, w in enumerate(wanted):
            machine.add_word(w, k)
        machine.make_automaton()
        for pdf in batches:
            found = [[wanted[k] for k in sorted({k for _, k in machine.iter(x or "")})] if wanted else [] for x in pdf[text]]
            yield pdf.assign(keywords=found)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, keywords array<string>")


def hotword_set(spark: SparkSession, ids_path: str, text_path: str, audio_path: str, words: list[str]) -> DataFrame:
    """id, ref_text, audio_path and keywords of the listed utterances that have a text and an audio file; a file is named by its stem up to the last hyphen."""
    ids = lines(spark, ids_path).select(F.split(F.trim("value"), r"\s+")[0].alias("id")).distinct()
    audio = lines(spark, audio_path).select(F.trim("value").alias("audio_path")).withColumn("id", F.regexp_replace(base_name(F.col("audio_path")), r"(-[^-]*)?\.[^.]*$", ""))
    return with_keywords(ids.join(keyed(spark, text_path, "id", "ref_text"), "id").join(audio, "id"), words)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Formula items: id, audio_path, and the spoken form as the text; items without either are dropped."""
    g = json_lines(spark, path, "id string, audio string, audio_path string, text string, ref_text string", "strict")
    return g.select("id", F.coalesce("audio_path", "audio").alias("audio_path"), F.coalesce("ref_text", "text").alias("ref_text")).where("audio_path is not null and coalesce(ref_text, '') <> ''")
