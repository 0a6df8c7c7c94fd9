"""Bounded pooling of embeddings and gallery similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pool_top_k(df: DataFrame, keys: list[str], vector: str, confidence: str, order: str, k: int) -> DataFrame:
    """Confidence-weighted, normalised mean of the k most confident vectors of each group, one row per dimension."""
    best = W.partitionBy(*keys).orderBy(F.desc(confidence), order)
    top = df.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= k)
    parts = top.select(*keys, F.col(confidence).alias("_c"), F.posexplode(vector).alias("dim", "_v"))
    mean = parts.groupBy(*keys, "dim").agg((F.sum(F.col("_c") * F.col("_v").cast("double")) / F.sum("_c")).alias("_m"))
    length = F.sqrt(F.sum(F.col("_m") * F.col("_m")).over(W.partitionBy(*keys)))
    return mean.withColumn("value", F.col("_m") / length).drop("_m")
