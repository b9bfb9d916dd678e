"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Each stage works on all rows that the stage before kept and returns the columns
of ``documents``; the last returns packed pieces.

Defined cases: rows that agree in doc_id and text are one document, of which one
row stays; rows that share a doc_id with different texts are documents of their
own until decontamination, which drops all rows of a doc_id that has a passage;
a null doc_id counts as one of its own.  Null texts have no letters and are
rejected by the first stage.  Very long texts are read whole by every stage.
Empty tables pass through all stages; columns beyond those of documents are
dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmurate.llm import decontaminate, language, minhash, packing, secrets
from murmurate.llm.scratch import save
from murmurate.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("doc_id"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; ``lang`` becomes the predicted one."""
    d = docs.select(*COLUMNS)
    found = language.predict(d, language.learn(d)).where(F.col("lang_pred") != language.UNKNOWN)
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates."""
    d = docs.select(*COLUMNS).withColumn("name", F.xxhash64("doc_id", "text"))
    groups = minhash.near_duplicates(d.select(F.col("name").alias("doc_id"), "text")).select(F.col("doc_id").alias("name"), F.col("component_id").alias("group"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name"))
    stays = groups.join(d.select("name", "doc_id"), "name").groupBy("group").agg(first.alias("f")).select("f.name")
    one = Window.partitionBy("name").orderBy("lang", "source")
    return d.join(stays, "name", "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    found = decontaminate.contamination(_named(docs), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("name")).distinct()
    d = docs.select(*COLUMNS).withColumn("name", F.coalesce(F.col("doc_id"), F.xxhash64("text")))
    return d.join(found, "name", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the text; no document goes."""
    clean = secrets.redact(docs.select(F.struct("doc_id", "lang", "source").alias("doc_id"), "text"))
    return clean.select("doc_id.doc_id", "text", "doc_id.lang", "doc_id.source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of power-of-two lengths."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("pack", pack),
]
#: Language and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
