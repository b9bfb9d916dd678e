"""Work of models outside the engine: texts are sent once, in batches, and what comes back is joined.

A model is any function from a list of texts (or records) to a list of answers.
It runs in Python workers; a batch that fails is tried again with growing
pauses, and then its answers are null, so that a scorer that is down costs a
metric and not the job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patient(call: Callable[[list], list], batch: list, retries: int = 2, pause: float = 0.5) -> list:
    """The answers to one batch; nulls if every try fails or the number of answers is wrong."""
    for attempt in range(retries + 1):
        try:
            answers = list(call(batch))
            if len(answers) == len(batch):
                return answers
        except Exception:  # noqa: BLE001  (whatever an outside service raises)
            pass
        if attempt < retries:
            time.sleep(pause * 2**attempt)
    return [None] * len(batch)


def embedded(pairs: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 32, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """``pairs`` (id, ref, hyp) with the cosine of both texts' vectors; each distinct text that is not empty is sent once."""
    texts = pairs.select(F.explode(F.array("ref", "hyp")).alias("text")).where("coalesce(text, '') <> ''").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), size):
                part = pdf["text"].iloc[k : k + size].tolist()
                yield pd.DataFrame({"text": part, "vector": patient(embed, part, retries, pause)})

    vectors = texts.mapInPandas(run, "text string, vector array<double>").where("vector is not null")
    side = lambda c, v: vectors.select(F.col("text").alias(c), F.col("vector").alias(v))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("u", "u")) * F.sqrt(dot("v", "v"))
    both = pairs.join(side("ref", "u"), "ref", "left").join(side("hyp", "v"), "hyp", "left")
    return both.select("id", "ref", "hyp", F.when(norm > 0, dot("u", "v") / norm).when(norm == 0, 0.0).alias("cosine"))


def scored(rows: DataFrame, columns: list[str], score: Callable[[list[dict]], list[float | None]], size: int = 32, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """``rows`` with the score of each; a null stands where the scorer gave none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), size):
                part = pdf.iloc[k : k + size]
                yield part.assign(score=patient(score, part[columns].to_dict("records"), retries, pause))

    return rows.mapInPandas(run, f"{fields}, score double")


def score_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Mean of the scores that are there, and their share."""
    return rows.groupBy(*by).agg(F.round(F.avg("score"), 4).alias("mean"), F.round(F.count("score") / F.count(F.lit(1)), 4).alias("coverage"))


def speech_fidelity(samples: DataFrame, error: Callable[[Column, Column], Column], norm: Callable[[Column], Column]) -> DataFrame:
    """Errors of speech read back against the text that was to be said: ``samples`` (id, target_lang, hyp, transcript); samples without a transcript count for nothing."""
    d = samples.where("transcript is not null").select("id", "target_lang", norm(F.col("hyp")).alias("ref"), norm(F.col("transcript")).alias("said"))
    return d.select("id", "target_lang", F.size("ref").alias("n"), error(F.col("ref"), F.col("said")).alias("edits")).groupBy("target_lang").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("edits") / F.greatest(F.sum("n"), F.lit(1)), 4).alias("tts_err"))
