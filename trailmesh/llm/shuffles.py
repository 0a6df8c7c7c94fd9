"""Stages of an operator as tables of the shared folder, whose shuffle files Spark removes when a stage is written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from trailmesh.llm.lineage import removed, shared_folder

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of each query as soon as it ends."""
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def stage_written(df: DataFrame, name: str = "stage") -> DataFrame:
    """The rows as a table of their own in the shared folder; any executor can read it after others are lost."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffle_files_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def stages_removed(*tables: DataFrame) -> None:
    """Remove written stages that no later stage reads."""
    for t in tables:
        removed(t.sparkSession, t.stage_path)
