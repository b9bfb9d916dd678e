"""Session and storage helpers shared by every package."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables (a file or a folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that one task gets when rows are spread.
SPREAD_BYTES = 4 << 20
#: Rows of whole texts that a Python worker gets at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session at ``BATCH_ROWS`` rows or less: a worker holds a batch several times over, as Arrow, as objects and as results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table as read, dealt evenly into tasks whose number grows with the table's files.

    A file may be one task, and the number of cores says nothing about a table's
    size; three tasks a core at least, as the time that a text takes is not in
    proportion to its length.  Files of many copies are small, so a task may still
    have very many rows; Python workers get them in small batches.
    """
    small_batches(df.sparkSession)
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    size = files.agg(F.sum("size")).first()[0] or 0
    return df.repartition(max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and
    the master is local (tests on one machine) a folder of our own is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "murmurate-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()
