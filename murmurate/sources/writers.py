"""Sinks: JSON records, logs that grow, exports of samples and training packs, Markdown and HTML tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# Language names of training records.
RECORD_LANGUAGE = {"en": "English"}


def write_json(df: DataFrame, path: str, *by: str, required: tuple[str, ...] = ()) -> None:
    """JSON Lines, a folder for each value of ``by``; the commit protocol shows all files or none.

    A null in a ``required`` column fails the job before anything is shown.
    """
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)))
    df.write.mode("overwrite").partitionBy(*by).json(path)


def append_log(records: DataFrame, path: str) -> None:
    """Adds records to a log of JSON Lines; files that are there are not touched, so a lost job loses only itself."""
    records.write.mode("append").json(path)


def stream_log(records: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same for a stream: each micro-batch once, by the checkpoint."""
    return records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def sample_export(samples: DataFrame, manifest: DataFrame, infer: DataFrame, label: str) -> DataFrame:
    """A metric record of each sample without an error: texts of the manifest and the run, and chrF where there is a reference.

    ``samples`` (id, error, err_rate, hyp_norm), ``manifest`` (id, lang,
    source_text, ref_text), ``infer`` (id, hyp, extra); the last two may lack ids.
    """
    m = manifest.select("id", "lang", "source_text", "ref_text")
    i = infer.select("id", "hyp", "extra")
    j = samples.where(F.col("error").isNull()).join(m, "id", "left").join(i, "id", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    chrf = F.when(some("ref_text").isNotNull() & F.col("err_rate").isNotNull(), F.round((1 - F.col("err_rate")) * 100, 2))
    return j.select(
        "id",
        F.lit(label).alias("label"),
        "lang",
        F.coalesce(some("source_text"), F.col("ref_text")).alias("source_text"),
        F.when(some("source_text").isNotNull(), F.col("ref_text")).alias("reference_translation"),
        F.coalesce(some("hyp"), F.col("hyp_norm")).alias("translation"),
        F.struct(chrf.alias("chrF"), F.col("extra.al_s").alias("al_s"), F.col("extra.laal_s").alias("laal_s"), F.col("extra.ttfb_s").alias("ttfb_s")).alias("metrics"),
    )


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def delay_assets(records: DataFrame, segments: DataFrame, path: str) -> None:
    """Hypotheses, speech segments, references and sources as four folders; lines of the last three are in one order.

    ``records`` as of ``trace.unit_delays``; ``segments`` (id, nth, wav, offset, duration, reference, source_text).
    """
    records.write.mode("overwrite").json(f"{path}/hypothesis")
    kept = segments.join(records.select(F.col(records.columns[0]).alias("id")), "id", "left_semi").repartitionByRange("id", "nth").sortWithinPartitions("id", "nth")
    kept.select("wav", "offset", "duration").write.mode("overwrite").json(f"{path}/speech_segments")
    kept.select(one_line(F.col("reference")).alias("value")).write.mode("overwrite").text(f"{path}/references")
    kept.select(one_line(F.col("source_text")).alias("value")).write.mode("overwrite").text(f"{path}/sources")


def training_records(rows: DataFrame, bucket: Column) -> DataFrame:
    """Speech training records: a language line, the marker and the transcript."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RECORD_LANGUAGE.items() for x in p]), F.col("language")), F.lit("Chinese"))
    text = F.concat(F.lit("language "), name, F.lit("<asr_text>"), F.trim(F.coalesce("transcription", F.lit(""))))
    return rows.select(F.col("audio_path").alias("audio"), text.alias("text"), F.lit("").alias("prompt"), "source_dataset", F.col("id").alias("source_id"), F.col("language").alias("source_language"), "duration", bucket.alias("duration_bucket"), "variant", "split")


def write_pack(records: DataFrame, path: str) -> None:
    """A folder for each variant and split."""
    records.write.mode("overwrite").partitionBy("variant", "split").json(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """A line ``| a | b |`` for each row; a null is an empty cell and a bar is escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |")).alias("line"))


def markdown_head(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]


def shade(value: Column, good: float, bad: float) -> Column:
    """ok, mid or bad by two limits; a null has none."""
    return F.when(value.isNull(), "").when(value <= good, "ok").when(value < bad, "mid").otherwise("bad")


def html_rows(df: DataFrame, shaded: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A table row for each row; texts are escaped, numbers have four digits, shaded columns a class."""

    def cell(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        text = F.format_number(F.col(c), 4) if kind in ("double", "float") else F.col(c).cast("string")
        for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(raw), F.lit(name))
        mark = F.concat(F.lit(' class="'), shade(F.col(c), *shaded[c]), F.lit('"')) if shaded and c in shaded else F.lit("")
        return F.concat(F.lit("<td"), mark, F.lit(">"), F.coalesce(text, F.lit("–")), F.lit("</td>"))

    return df.select(F.concat(F.lit("<tr>"), *(cell(c) for c in df.columns), F.lit("</tr>")).alias("line"))
