"""Joins of many rows with one row per key, where a few keys have very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with a 512th of all rows is heavy, so at most 512 keys are; small tables have none.
SHARE, LEAST, SALTS = 512, 1000, 64


def heavy_keys(counts: DataFrame, key: str, n: str) -> list:
    """Keys of counts(key, n) that have so large a share of all rows; at most ``SHARE`` of them."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.filter(F.col(n) >= max(LEAST, -(-total // SHARE))).select(key).collect()]


def salted(rows: DataFrame, one_each: DataFrame, keys: list[str], heavy: Column, by: list[str]) -> DataFrame:
    """Inner join on keys; rows of heavy keys are dealt to ``SALTS`` tasks by a hash of ``by``, their one row is copied to each."""
    deal = F.when(heavy, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left, right = rows.withColumn("_salt", deal), one_each.withColumn("_salt", F.explode(copies))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
