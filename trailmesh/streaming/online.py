"""The streaming side: sessions by watermark, and association of closed tracklets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.operators.association import Config, associate_offline


def tracklets_of_stream(frames: DataFrame, keys: list[str], ts: str, gap: str, late: str, min_rows: int = 1) -> DataFrame:
    """Closed tracklets: sessions of each key, emitted once the watermark has passed them.

    A step of exactly ``gap`` still belongs to a session. Rows later than the watermark are lost here; the round
    engine of ``streaming.rounds`` takes them in.
    """
    s = frames.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    s = s.groupBy(F.session_window(ts, f"{gap} 1 microsecond").alias("w"), *keys).agg(F.count("*").alias("n_frames"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    return s.filter(F.col("n_frames") >= min_rows).drop("w")


def associate_batches(tracklets: DataFrame, path: str, config: Config) -> DataFrame:
    """All tracklets written so far, associated again: the result does not depend on batch boundaries."""
    return associate_offline(tracklets.sparkSession.read.parquet(path), config)


def upsert_by_key(target: str, keys: list[str], order: str):
    """A foreachBatch sink that keeps the last row of each key; a replayed batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    def read(spark) -> DataFrame:
        rows = spark.read.parquet(target)
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct("_epoch", order)).alias("r"))
        return last.select("r.*").drop("_epoch", "epoch")

    return write, read
