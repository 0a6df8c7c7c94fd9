"""The frame contract as column expressions, and regions of interest on the ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.functions import geometry as G

VERSION = 1
#: Share of the frame by which a box may stand over its edge, and the tolerance of a unit vector's norm.
OVER, NORM = 0.02, 1e-2


def vector_dim(v: Column) -> Column:
    return F.when(v.isNotNull(), F.size(v))


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e))


def frame_issues(frames: DataFrame, with_vectors: bool = True) -> DataFrame:
    """Add ``issues``: codes of all broken rules of frames(schema_version, cam_id, frame_width, frame_height, ts_ms, embed_dim, detections).

    detections(local_track_id, x, y, w, h, confidence, embedding), or instead of the embedding its ``dim`` and ``norm``
    (both null without one), so that no vector need travel to its frame. Codes of a detection carry its track: ``duplicate:7``.
    Frame codes come first, then those of the detections in order.
    """
    measured = "norm" in frames.schema["detections"].dataType.elementType.names
    rule = lambda bad, code: F.when(F.coalesce(bad, F.lit(True)), F.lit(code))
    frame = [
        rule(F.col("schema_version") != VERSION, "version"),
        rule(F.col("cam_id") == "", "camera"),
        rule((F.col("frame_width") <= 0) | (F.col("frame_height") <= 0), "frame_size"),
        rule(F.col("ts_ms") <= 0, "ts"),
    ]

    def own(d: Column, i: Column) -> Column:
        before = F.slice("detections", F.lit(1), i)
        beyond = lambda at, size, limit: (d[at] < -OVER * F.col(limit)) | (d[at] + d[size] > (1 + OVER) * F.col(limit))
        codes = [
            (F.exists(before, lambda e: e["local_track_id"] == d["local_track_id"]), "duplicate"),
            (F.coalesce((d["w"] <= 0) | (d["h"] <= 0), F.lit(True)), "box_side"),
            (F.coalesce(beyond("x", "w", "frame_width") | beyond("y", "h", "frame_height"), F.lit(False)), "overflow"),
            (F.coalesce(~d["confidence"].between(0.0, 1.0), F.lit(True)), "confidence"),
        ]
        if with_vectors:
            dim, norm = (d["dim"], d["norm"]) if measured else (vector_dim(d["embedding"]), vector_norm(d["embedding"]))
            codes += [(dim.isNotNull() & (F.col("embed_dim") > 0) & (dim != F.col("embed_dim")), "dimension"), (dim.isNotNull() & ~F.coalesce(F.abs(norm - 1) <= NORM, F.lit(False)), "norm")]
        tag = F.concat(F.lit(":"), d["local_track_id"].cast("string"))
        return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.concat(F.lit(code), tag)) for bad, code in codes]))

    found = F.flatten(F.transform(F.coalesce("detections", F.array().cast(frames.schema["detections"].dataType)), own))
    return frames.withColumn("issues", F.concat(F.array_compact(F.array(*frame)), found))


def strictly(frames: DataFrame) -> DataFrame:
    """Frames without issues; reading one that has any raises."""
    fault = F.raise_error(F.concat(F.col("cam_id"), F.lit(": "), F.concat_ws("; ", "issues"))).cast("boolean")
    return frames.filter(F.when(F.size("issues") == 0, F.lit(True)).otherwise(fault))


def in_region(detections: DataFrame, cameras: DataFrame, rois: DataFrame, margin_m: float = 0.0) -> DataFrame:
    """Add ``gx``, ``gy`` and ``kept`` to detections(cam, x, y, w, h): whether the raw bottom centre is in the camera's region.

    cameras(cam, matrix); rois(cam, x_lo, x_hi, y_lo, y_hi) in metres, half open, null ends open, widened by
    ``margin_m``. Cameras without a region keep all; a point that cannot be projected is out. A region of a camera
    without a matrix raises, for it would let everything through.
    """
    d = detections.join(rois.withColumn("_roi", F.lit(True)), "cam", "left").join(cameras.select("cam", "matrix"), "cam", "left")
    m = [F.element_at("matrix", i) for i in range(1, 10)]
    g = G.project(m, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h"))
    d = d.withColumn("_g", g)
    above = lambda c, lo: F.col(lo).isNull() | (F.col(c) >= F.col(lo) - margin_m)
    below = lambda c, hi: F.col(hi).isNull() | (F.col(c) < F.col(hi) + margin_m)
    inside = F.coalesce(above("_g.x", "x_lo") & below("_g.x", "x_hi") & above("_g.y", "y_lo") & below("_g.y", "y_hi"), F.lit(False)) & F.col("_g").isNotNull()
    lost = F.raise_error(F.concat(F.lit("region without a calibration: "), F.col("cam"))).cast("boolean")
    kept = F.when(F.col("_roi").isNull(), F.lit(True)).when(F.col("matrix").isNull(), lost).otherwise(inside)
    return d.select(*detections.columns, F.col("_g.x").alias("gx"), F.col("_g.y").alias("gy"), kept.alias("kept"))


def dropped_by_camera(marked: DataFrame) -> DataFrame:
    """cam, n_dropped, n_total of rows with ``kept``."""
    return marked.groupBy("cam").agg(F.count_if(~F.col("kept")).alias("n_dropped"), F.count("*").alias("n_total"))
