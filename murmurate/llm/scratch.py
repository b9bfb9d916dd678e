"""Tables written between stages, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from murmurate.session import ensure_checkpoint_dir


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet beside the checkpoints and reads it again.

    The table cuts the lineage: what follows reads files that outlive any
    executor.  The folder is the one in spark.checkpoint.dir.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/murmurate/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables; only for those that no table or query still to be run reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
