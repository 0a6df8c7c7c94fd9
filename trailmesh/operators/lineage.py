"""Results that several parts of a plan read, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def computed_once(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of ``spark.checkpoint.dir``; without one, a cache that lost executors' parts are computed again for."""
    context = df.sparkSession.sparkContext
    where = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None and where:
        context.setCheckpointDir(where)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()
