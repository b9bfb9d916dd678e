"""Measures of audio from the bytes of WAV files.

A file is read as RIFF chunks; whole-number samples of 8 to 32 bits and floating
point ones are scaled to -1..1, channels are averaged, and the measures are taken
with numpy over a batch's files.  A file that can't be read has an error and no
measures: it is a row, not a failure.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.operators import scoring

MEASURES = "sample_rate int, channels int, frames long, actual_s double, peak double, rms double, clip double, zero double, decode_error string"
#: Amplitudes from which on a sample is clipped, and below which it is zero.
CLIPPED, SILENT = 0.999, 1e-7
# Format tags of WAV files.
WHOLE, FLOATING, EXTENSIBLE = 1, 3, 0xFFFE


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name; one that is said to be longer than the file ends with it, as files written to a pipe have no true length."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    out: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        out.setdefault(data[at : at + 4], data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def samples(data: bytes) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1, a row for each frame, and the frames a second."""
    parts = chunks(data)
    form = parts.get(b"fmt ", b"")
    if len(form) < 16:
        raise ValueError("no format chunk")
    tag, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == EXTENSIBLE and len(form) >= 26:
        tag = int.from_bytes(form[24:26], "little")
    if not channels or not rate or frame != channels * bits // 8:
        raise ValueError(f"{channels} channels of {bits} bits in frames of {frame} bytes at {rate} a second")
    if b"data" not in parts:
        raise ValueError("no data chunk")
    raw = parts[b"data"]
    raw = raw[: len(raw) - len(raw) % frame]
    if tag == WHOLE and bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif tag == WHOLE and bits in (16, 32):
        x = np.frombuffer(raw, f"<i{bits // 8}").astype(np.float32 if bits == 16 else np.float64) / (1 << bits - 1)
    elif tag == WHOLE and bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64) / (1 << 23)
    elif tag == FLOATING and bits in (32, 64):
        x = np.frombuffer(raw, f"<f{bits // 8}")
    else:
        raise ValueError(f"format {tag} of {bits} bits")
    return x.astype(np.float32).reshape(-1, channels), rate


def measure(data: bytes | None) -> dict:
    """The measures of one file; a file without frames is silent."""
    try:
        if data is None:
            raise ValueError("no bytes")
        x, rate = samples(data)
    except ValueError as e:
        return {"decode_error": str(e)}
    mono = x.mean(axis=1)
    loud = np.abs(mono)
    n = len(mono)
    return {
        "sample_rate": rate,
        "channels": x.shape[1],
        "frames": n,
        "actual_s": n / rate,
        "peak": float(loud.max()) if n else 0.0,
        "rms": float(np.sqrt(np.mean(np.square(mono, dtype=np.float64)))) if n else 0.0,
        "clip": float((loud >= CLIPPED).mean()) if n else 0.0,
        "zero": float((loud < SILENT).mean()) if n else 1.0,
    }


def measured(content: Column) -> Column:
    """struct of MEASURES of a column of WAV bytes."""
    names = [f.split()[0] for f in MEASURES.split(", ")]

    def each(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(None if x is None else bytes(x)) for x in data], columns=names).astype({"sample_rate": "Int32", "channels": "Int32", "frames": "Int64", "decode_error": object})

    return F.pandas_udf(each, f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>")(content)


def dbfs(amplitude: Column) -> Column:
    """Decibels below full scale, two digits."""
    return F.round(20 * F.log10(F.greatest(amplitude, F.lit(1e-12))), 2)


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """file and MEASURES of WAV files; a file is a row, so none is over 2 GB."""
    read = spark.read.format("binaryFile").load(path)
    return read.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), measured(F.col("content")).alias("m")).select("file", "m.*")


def screened(rows: DataFrame, content: str, expected: str, lang: str, text: str) -> DataFrame:
    """``rows`` without their bytes, with the measures, decision and flags; what can't be read is rejected as decode_error."""
    d = rows.withColumn("_m", measured(F.col(content))).drop(content)
    m = {k: F.col(f"_m.{k}") for k in ("actual_s", "rms", "clip", "zero", "sample_rate")}
    verdict = scoring.triage(m | {"expected_s": F.col(expected), "lang": F.col(lang), "text": F.col(text)})
    broken = F.struct(F.lit("reject").alias("decision"), F.array(F.lit("decode_error")).alias("flags"))
    both = F.when(F.col("_m.decode_error").isNotNull(), broken).otherwise(verdict)
    return d.withColumn("_v", both).select(*[c for c in rows.columns if c != content], "_m.*", "_v.decision", "_v.flags")


# Upper limits and names of the duration buckets of a screening report; what is longer is in the last.
BUCKETS = ((0.5, "0-0.5s"), (1.0, "0.5-1s"), (1.5, "1-1.5s"))
LAST_BUCKET = "1.5-2s"


def screening_report(rows: DataFrame, content: str, expected: str, lang: str, text: str, limit: float = 2.0) -> DataFrame:
    """kind, decision, name, n and hours of a screening of all rows of at most ``limit`` expected seconds.

    Kinds are scanned (all rows), selected, decision, and by name language (of a
    decision; a null is unknown), bucket (of a decision) and flag.  A row takes
    its measured seconds, or the expected ones if it can't be read.  Each row is
    measured once and gives a handful of lines, which are summed before the shuffle.
    """
    said = F.coalesce(F.col(expected).cast("double"), F.lit(0.0))
    marked = rows.select(F.col(content).alias("_content"), said.alias("_said"), (said <= limit).alias("_short"), F.coalesce(F.col(lang), F.lit("unknown")).alias("_lang"), F.col(text).alias("_text"))
    s = screened(marked.withColumn("_content", F.when(F.col("_short"), F.col("_content"))), "_content", "_said", "_lang", "_text")
    seconds = F.coalesce("actual_s", "_said")
    bucket = F.lit(LAST_BUCKET)
    for most, name in reversed(BUCKETS):
        bucket = F.when(seconds < most, name).otherwise(bucket)
    none = F.lit(None).cast("string")

    def line(kind: str, decision: Column, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), decision.alias("decision"), name.alias("name"), F.when(F.lit(kind) == "scanned", F.col("_said")).otherwise(seconds).alias("seconds"))

    verdict = F.col("decision")
    short = F.concat(
        F.array(line("selected", none, none), line("decision", verdict, none), line("language", verdict, F.col("_lang")), line("bucket", verdict, bucket)),
        F.transform("flags", lambda f: line("flag", none, f)),
    )
    scanned = F.array(line("scanned", none, none))
    lines = s.select(F.inline(F.when(F.col("_short"), F.concat(scanned, short)).otherwise(scanned)))
    return lines.groupBy("kind", "decision", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds") / 3600, 4).alias("hours"))
