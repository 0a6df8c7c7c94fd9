"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir; on a local master without one, a new temporary folder."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame, files: int | None = None, last: bool = False) -> DataFrame:
    """Cut the lineage in the shared folder, in at most ``files`` files.

    With ``last``, shuffle files that only the cut lineage used are given up at once
    and not when the driver happens to collect its garbage: they hold whole texts.
    """
    shared_folder(df.sparkSession)
    out = (df.coalesce(max(1, files)) if files is not None else df).checkpoint()
    if last:
        released(df.sparkSession)
    return out


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, smaller than a checkpoint, and its path; the caller removes it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def released(spark) -> None:
    """Give up the shuffle files of all data frames that nothing refers to any more."""
    gc.collect()
    time.sleep(2)  # Python's references are given back in the background
    spark.sparkContext._jvm.System.gc()
