"""Frame fixtures, output updates and motion tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = (
    "schema_version int, cam_id string, frame_id bigint, ts_ms bigint, frame_pts_ns bigint, frame_width int, frame_height int, embed_dim int, "
    "detections array<struct<local_track_id:bigint,bbox:array<double>,confidence:double,class_id:int,embedding:string>>, stamps map<string,double>"
)
MOT = "frame bigint, id bigint, x double, y double, w double, h double, conf double, a double, b double, c double"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of frames; a malformed line or another schema version is an error."""
    df = spark.read.schema(FRAME).option("mode", "FAILFAST").json(path)
    ok = F.coalesce(F.col("schema_version"), F.lit(1)) == 1
    return df.withColumn("schema_version", F.when(ok, 1).otherwise(F.raise_error(F.lit("schema_version"))))


def detections(frames: DataFrame) -> DataFrame:
    """One row per detection; frames without any keep a row of nulls."""
    return frames.select("cam_id", "frame_id", "ts_ms", "frame_width", "frame_height", F.explode_outer("detections").alias("d")).select("*", "d.*").drop("d")


def write_frames(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").json(path)


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MOT).csv(path)


def write_mot(rows: DataFrame, path: str) -> None:
    """frame,id,x,y,w,h,conf,-1,-1,-1 ordered by frame and id."""
    out = rows.select("frame", "id", "x", "y", "w", "h", "conf", F.lit(-1), F.lit(-1), F.lit(-1))
    out.orderBy("frame", "id").write.mode("overwrite").csv(path)


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    """Latency records; lines that cannot be read are left out."""
    kind = "run_id string, cam_id string, frame_id bigint, tracklet_id string, global_id bigint, kind string, t0_source string, stamps map<string,double>"
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path)
